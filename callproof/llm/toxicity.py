"""Toxicity: a lexicon trie met by Levenshtein automata, with scores from context windows.

*Lexicon.*  Words of labelled texts are counted by label (copies of a text once, by what stands around the word).  Every
whole word, of any length, and every beginning of a word of ``STEM`` to ``LONGEST`` letters is a candidate; those that
stand almost only in toxic texts, by a likelihood ratio too large for chance, become entries, all of them: their number
is bounded by the labelled rows that are read.  An entry of ``STEM`` to ``LONGEST`` letters covers the words that begin
with it, a shorter or longer one only the word itself.

*Matching.*  The automaton of a word (its states are rows of edit distances cut off beyond the limit, kept
and reused with their transitions) is intersected with the trie of the entries: one walk of the trie gives all
entries within the limit of the word or of its beginning.  A word can only match if one of an entry's equal
parts stands in it almost in place, so most words are settled by a few set look-ups.  The edits allowed grow
with the entry's length.  What a match is worth (exact or misspelled, whole word or beginning) is the
log-odds that it shows on the labelled words.

*Context.*  A match inside quotation marks, or with words of saying or writing in the window around it,
counts as quoted; a word of address in the window makes it direct.  A small logistic regression on the best
and the summed worth of direct, plain and quoted matches gives the score.

Labels are learned from at most ``TRAIN_ROWS`` labelled rows (about; by hash of the id), so training does not grow
with the corpus; every text is scored whole, where it is read.

Defined results: a null or empty text has no match and gets the score of a text without one, as have all texts
if no entry is found; without a training row every score is 0; equal texts get equal scores; repeated rows are
scored once each; a null ``doc_id`` is never a training row; further columns are ignored, or kept by ``kept_rows``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ._common import cut, give_back, table
from .classifier import remainder, training_sample

TRAIN_ROWS = 20_000
#: Letters of the beginnings of words that can be entries; other entries are whole words.
STEM, LONGEST = 4, 12
WINDOW = 5
#: Log-likelihood ratio of an entry; what chance gives once in some millions of beginnings.
LEAST_RATIO = 16
WORDS_KEPT = 400_000
#: How surely a way of matching that was never seen on labelled words is taken as toxic, and what a match is worth at most.
UNSEEN, MOST_WORTH = 0.8, 4.0
#: Words of saying and writing, and of address, in the languages at hand: what is taken where the caller passes none.
REPORTING = frozenset("said says say wrote writes write called calls quoted quote quotes word words term dit disait écrit appelé mot terme sagte sagt schrieb nannte wort begriff dijo dice escribió llamó palabra término".split())
ADDRESS = frozenset("you your yours u tu te toi vous ton ta du dich dein deine ihr usted tú ti vosotros".split())
OPENING, CLOSING = frozenset("\"“„«‘'"), frozenset("\"”“»’'")
_LETTERS = re.compile(r"[^\W_]+")


def plain(word: str) -> str:
    """A word in lower case without marks around it; what is inside stays."""
    if word.isalpha():
        return word.lower()
    found = _LETTERS.search(word)
    if not found:
        return ""
    end = len(word)
    while not word[end - 1].isalnum():
        end -= 1
    return word[found.start() : end].lower()


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


def covers_beginnings(entry: str) -> bool:
    return STEM <= len(entry) <= LONGEST


class Trie:
    """The entries, letter by letter."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        #: The most edits that an entry below a node allows.
        self.most: list[int] = [0]
        for k, entry in enumerate(entries):
            at, allowed = 0, edits_allowed(len(entry))
            for letter in entry:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                self.most[at] = max(self.most[at], allowed)
                at = self.next[at][letter]
            self.most[at] = max(self.most[at], allowed)
            self.ends[at] = k
        # an edit spoils at most one of k + 1 parts, and moves the others by k places at most
        self.parts: dict[tuple[int, int], set[str]] = {}
        for entry in entries:
            most = edits_allowed(len(entry))
            cuts = [round(i * len(entry) / (most + 1)) for i in range(most + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for move in range(-most, most + 1):
                    if a + move >= 0:
                        self.parts.setdefault((a + move, b - a), set()).add(entry[a:b])

        # the same as one pattern: a part at its place, from the start of the word
        at_place = ["(?s:.{%d})(?:%s)" % (a, "|".join(map(re.escape, sorted(parts)))) for (a, _), parts in sorted(self.parts.items())]
        self.pattern = re.compile("|".join(at_place)) if at_place else None

    def may_match(self, word: str) -> bool:
        return self.pattern is not None and self.pattern.match(word) is not None


class Automata:
    """Levenshtein automata by limit: states are rows of distances, shared by all words of a length."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.limit = max((edits_allowed(len(e)) for e in trie.entries), default=0)
        self.longest = max(map(len, trie.entries), default=0)
        self.steps: dict[tuple, tuple] = {}

    def step(self, state: tuple[int, ...], where: int) -> tuple[int, ...]:
        """The state after one more entry letter; the bits of ``where`` mark the places of the word that have it."""
        key = (state, where)
        if (out := self.steps.get(key)) is None:
            most = self.limit + 1
            row = [min(state[0] + 1, most)]
            for j in range(len(state) - 1):
                row.append(min(state[j] + (not where >> j & 1), state[j + 1] + 1, row[j] + 1, most))
            if len(self.steps) > 500_000:
                self.steps.clear()
            out = self.steps[key] = tuple(row)
        return out

    def matches(self, word: str) -> list[tuple[int, int, int]]:
        """(entry, edits, 1 if only a beginning of the word) for each entry within its limit."""
        trie, found, limit = self.trie, [], self.limit
        most = self.longest + limit + 1  # what is beyond can be no part of a match, and the word no whole one
        word = word[:most] + ("…" if len(word) > most else "")
        places: dict[str, int] = {}
        for j, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << j
        todo = [(0, tuple(min(j, limit + 1) for j in range(len(word) + 1)))]
        while todo:
            node, state = todo.pop()
            best = min(state)
            if best > trie.most[node]:
                continue
            if (k := trie.ends[node]) >= 0:
                entry = trie.entries[k]
                whole = state[-1] <= edits_allowed(len(entry))
                if whole or (best <= edits_allowed(len(entry)) and covers_beginnings(entry)):
                    found.append((k, state[-1] if whole else best, 0 if whole else 1))
            for letter, below in trie.next[node].items():
                todo.append((below, self.step(state, places.get(letter, 0))))
        return found


class Matcher:
    """The best-known entry of each word, and what the match is worth."""

    def __init__(self, entries: list[str], worth: dict[tuple[int, int, int], float] | None = None, reporting: frozenset[str] = REPORTING, address: frozenset[str] = ADDRESS):
        self.reporting, self.address = reporting, address
        self.trie = Trie(entries)
        self.automata = Automata(self.trie)
        self.worth = worth
        self.known: dict[str, float] = {}
        self.clean: set[str] = set()

    def all_matches(self, word: str) -> list[tuple[int, int, int]]:
        return self.automata.matches(word) if word and self.trie.may_match(word) else []

    def value(self, raw: str) -> float:
        """The worth of a word as it stands in a text; 0 without a match."""
        if raw in self.clean:
            return 0.0
        if (out := self.known.get(raw)) is None:
            if len(self.known) + len(self.clean) > WORDS_KEPT:
                self.known.clear()
                self.clean.clear()
            out = max((self.worth.get(m, 0.0) for m in self.all_matches(plain(raw))), default=0.0)
            if out > 0:
                self.known[raw] = out
            else:
                self.clean.add(raw)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Best and summed worth of direct, plain and quoted matches."""
        out = np.zeros(6)
        words = text.split() if text else []
        # most words are known to match nothing, and go at once
        some = {w for w in set(words).difference(self.clean) if self.value(w) > 0}
        hits = [k for k, w in enumerate(words) if w in some] if some else []
        for k in hits:
            around = [plain(w) for w in words[max(0, k - WINDOW) : k + WINDOW + 1]]
            kind = 2 if quoted(words, k) or not self.reporting.isdisjoint(around) else 0 if not self.address.isdisjoint(around) else 1
            v = self.value(words[k])
            out[kind] = max(out[kind], v)
            out[3 + kind] += v
        out[3:] = np.log1p(out[3:])
        return out


def quoted(words: list[str], at: int) -> bool:
    """Whether quotation marks open at or before the word and close at or after it, within the window."""
    opens = any(words[k][0] in OPENING for k in range(max(0, at - WINDOW), at + 1))
    return opens and any(words[k].rstrip(".,;:!?")[-1:] in CLOSING for k in range(at, min(len(words), at + WINDOW + 1)))


COUNTED = StructType([StructField("word", StringType()), StructField("around", LongType()), StructField("doc", LongType()), StructField("clean", LongType())])


def word_counts(sample: DataFrame) -> DataFrame:
    """``sample(text, y)`` -> ``(word, around, doc, clean)``: a row per word of a toxic text, and clean texts counted by word.

    ``around`` hashes the words before and after (of several places, the lowest), ``doc`` the text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: set[tuple[str, int, int]] = set()
        clean: Counter = Counter()
        for rows in batches:
            for text, y in zip(rows["text"], rows["y"], strict=True):
                words = [p for w in (text or "").split() if (p := plain(w))]
                if y:
                    least: dict[str, int] = {}
                    for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
                        around = xxhash.xxh64_intdigest(f"{a} {b}") >> 1
                        least[w] = min(around, least.get(w, around))
                    doc = xxhash.xxh64_intdigest(text or "") >> 1
                    toxic.update((w, x, doc) for w, x in least.items())
                else:
                    clean.update(set(words))
            if len(toxic) + len(clean) > WORDS_KEPT:
                yield frame(toxic, clean)
                toxic, clean = set(), Counter()
        if toxic or clean:
            yield frame(toxic, clean)

    def frame(toxic, clean) -> pd.DataFrame:
        rows = [*toxic, *((w, None, None) for w in clean)]
        return pd.DataFrame({"word": [r[0] for r in rows], "around": pd.Series([r[1] for r in rows], dtype=object), "doc": pd.Series([r[2] for r in rows], dtype=object), "clean": [0] * len(toxic) + [*clean.values()]})

    return sample.select("text", "y").mapInPandas(count, COUNTED).groupBy("word", "around", "doc").agg(F.sum("clean").alias("clean"))


def by_label(counts: DataFrame, key: str) -> DataFrame:
    """``(key, toxic, clean)``.  A toxic text counts once, and copies of a text, which share what stands around a word, count once."""
    per_text = counts.groupBy(key, "doc").agg(F.min("around").alias("around"), F.sum("clean").alias("clean"))
    per_place = per_text.groupBy(key, "around").agg(F.count("doc").alias("docs"), F.sum("clean").alias("clean"))
    return per_place.groupBy(key).agg(F.least(F.count("around"), F.sum("docs")).alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame, toxic_share: float) -> list[str]:
    """The words and beginnings of words that stand far more in toxic texts than chance allows.

    A beginning can only be an entry if one of its words is as toxic, so beginnings are made of the words that share
    their first letters with such a word, and words that stand apart are left out before anything is multiplied.
    """
    per_word = counts.groupBy("word").agg(F.count("doc").alias("t"), F.coalesce(F.sum("clean"), F.lit(0)).alias("c"))
    strong = per_word.where(F.col("t") >= 4 * F.col("c")).select("word", F.substring("word", 1, STEM).alias("first")).where("word <> ''")
    firsts = strong.groupBy("first").agg(F.max(F.length("word")).alias("longest"))
    size = F.length("word")
    near = counts.withColumn("first", F.substring("word", 1, STEM)).join(firsts, "first").where("word <> ''")
    lengths = F.when(size >= STEM, F.sequence(F.lit(STEM), F.least(size, F.lit(LONGEST), F.greatest("longest", F.lit(STEM)))))
    lengths = F.when(F.when(size >= STEM, size > LONGEST).otherwise(True), F.concat(F.coalesce(lengths, F.array().cast("array<int>")), F.array(size))).otherwise(lengths)
    stems = near.select(F.explode(lengths).alias("n"), "word", "around", "doc", "clean")
    stems = by_label(stems.withColumn("stem", F.substring("word", F.lit(1), F.col("n"))), "stem")
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = F.col("toxic") * F.log(p / toxic_share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - toxic_share))).otherwise(0.0)
    good = stems.where((F.col("toxic") >= 4) & (p >= 0.8)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    rows = good.orderBy(F.desc("ratio"), F.desc(F.length("stem")), "stem").collect()  # each stands in several labelled texts, so their number is bounded with them
    out: list[str] = []
    kept, begun = set(), set()
    for r in rows:  # of stems that begin alike, the strongest (of equals the longest) stays
        stem = r["stem"]
        beginnings = [stem[:n] for n in range(1, len(stem) + 1)]
        if not any(b in kept and covers_beginnings(b) for b in beginnings) and not (stem in begun and covers_beginnings(stem)):
            out.append(stem)
            kept.add(stem)
            begun.update(beginnings)
    return out


def worths(counts: DataFrame, entries: list[str], toxic_share: float) -> dict[tuple[int, int, int], float]:
    """What each way to match an entry is worth: log-odds of toxic on the labelled words, 0 if weak."""
    shape = StructType([StructField("m", ArrayType(IntegerType())), StructField("toxic", LongType()), StructField("clean", LongType())])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries)
        for rows in batches:
            out = [([*m], t, c) for w, t, c in zip(rows["word"], rows["toxic"], rows["clean"], strict=True) for m in matcher.all_matches(w)]
            yield pd.DataFrame(out, columns=["m", "toxic", "clean"])

    found = by_label(counts, "word").mapInPandas(match, shape).groupBy("m").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # misspellings of one entry are rare, so they share a prior by the way of matching
    rows = found.collect()  # at most entries x 3 edits x 2 ways
    by_entry: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
    for r in rows:
        by_entry.setdefault(r["m"][0], {})[(r["m"][1], r["m"][2])] = (r["toxic"], r["clean"])
    prior: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        both = prior.setdefault((r["m"][1], r["m"][2]), [0, 0])
        both[0] += r["toxic"]
        both[1] += r["clean"]
    out = {}
    for way in ((edits, part) for edits in range(max((edits_allowed(len(e)) for e in entries), default=0) + 1) for part in (0, 1)):
        prior.setdefault(way, [0, 0])
    for k in range(len(entries)):
        own = by_entry.get(k, {})
        for way, (t, c) in prior.items():
            share = (t + 2 * UNSEEN) / (t + c + 2)
            a, b = own.get(way, (0, 0))
            p = (a + 4 * share) / (a + b + 4)
            value = math.log(p / (1 - p)) - math.log(toxic_share / (1 - toxic_share))
            if value > 1:
                out[(k, *way)] = min(value, MOST_WORTH)
    return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*np.ones(x.shape[1] - 1), 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Entries, worths, words of context and weights: all that scoring needs, bounded by the labelled rows read."""

    def __init__(self, entries: list[str], worth: dict, weights: np.ndarray, reporting: frozenset[str] = REPORTING, address: frozenset[str] = ADDRESS):
        self.entries, self.worth, self.weights, self.reporting, self.address = entries, worth, weights, reporting, address

    def matcher(self) -> Matcher:
        return Matcher(self.entries, self.worth, self.reporting, self.address)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, *, rows: int = TRAIN_ROWS, reporting: frozenset[str] = REPORTING, address: frozenset[str] = ADDRESS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns the lexicon, what matches are worth and the weights of the context from labelled rows.

    ``reporting`` and ``address`` are the words that make a match quoted or direct.
    """
    sample = cut(training_sample(docs, labels, label, keep, rows, id_col=id_col, text_col=text_col))  # bounded by rows
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return Model([], {}, np.array([*np.zeros(6), -30.0 if not toxic else 30.0]), reporting, address)
    share = toxic / n
    counts = cut(word_counts(sample))
    entries = lexicon(counts, share)
    worth = worths(counts, entries, share)

    @F.pandas_udf(ArrayType(DoubleType()))
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(entries, worth, reporting, address)
        for batch in texts:
            yield pd.Series([matcher.features(t) for t in batch])

    # texts with the same features count together, so few rows reach the driver: at most the sample's
    seen = sample.select(features("text").alias("x"), "y").groupBy("x", "y").count().orderBy("x", "y").collect()
    x = np.repeat(np.array([r["x"] for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([r["y"] for r in seen], float), [r["count"] for r in seen])
    return Model(entries, worth, fitted(x, y), reporting, address)


def score_column(spark, model: Model):
    """A column function: text -> the chance that it is toxic."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the labelled rows

    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        m = shared.value
        matcher = m.matcher()
        for batch in texts:
            logit = np.array([matcher.features(t) @ m.weights[:-1] + m.weights[-1] for t in batch], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, *, mod: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, "toxic", remainder("label_id", mod) != held, id_col=id_col, text_col=text_col)
    scored = score_column(docs.sparkSession, model)
    held_out = F.coalesce(remainder(id_col, mod) == held, F.lit(False))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept_rows(docs: DataFrame, corpus: DataFrame, labels: DataFrame, *, mod: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not found toxic; learned from labelled rows of ``corpus``."""
    model = train(corpus, labels, "toxic", remainder("label_id", mod) != held, id_col=id_col, text_col=text_col)
    return docs.where(score_column(docs.sparkSession, model)(F.col(text_col).cast("string")) < 0.5)


def op8_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
