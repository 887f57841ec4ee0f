"""Byte-pair encoding by speculation and verification, and decoding.

Per word, greedy longest-match proposes tokens.  A proposal is right exactly when
every token, and every adjacent pair of tokens, is what exact merging makes of its
own characters; so the distinct pairs of a whole batch of words are looked up in a
sorted table of verdicts with numpy, pairs not seen before are judged once, and only
the words with a failing pair undergo exact merging.  Proposing and merging, too, go
through all new words of a batch together, a numpy step for each letter of the longest
token and for each merge of the word with the most.  Each distinct word is encoded
once per worker (the table of words is emptied when full, so memory is bounded).

Defined results: a null or empty text has no tokens; special-token strings in a text
become their ids, as the tokenizer file's own library does; a text of any length is
encoded whole; rows with equal text get equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Words, and chunks, that a worker keeps; the tables are emptied beyond.
WORDS_KEPT = 300_000
#: Characters of texts that are encoded together.
GROUP_CHARS = 2_000_000
PAIR_SHIFT = 20
#: Letters of a word that is merged together with others, and words that are merged together.
ROW_LETTERS, ROWS = 32, 8192
#: Added to the byte that ends a word and has the suffix; what stands between words; room for both in a key.
LAST, BETWEEN, CODE_SHIFT = 256, 512, 10
#: The rank of a pair that is not merged.
NEVER = np.iinfo(np.int32).max
#: Control letters at which str.split() would split, but which are no white space here.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Splitter:
    """What a tokenizer file says about cutting texts into words and spelling them, without its vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.read(json.load(f))

    def read(self, spec: dict) -> None:
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.letters = byte_letters()
        self.space = regex.compile(r"\p{White_Space}+").split

    def normal(self, text: str) -> str:
        """Canonical composition and lower case letter by letter (no final-sigma rule); white space only separates words."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def words(self, chunk: str) -> list[str]:
        """The words of a piece between white space; plain ones, the most, are told without the pattern."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and chunk[-1] in ".,":
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def spelled(self, word: str) -> str:
        """A word in the letters that stand for its bytes."""
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))

    def chunks(self, text: str | None) -> list[str]:
        """The pieces of a text between white space; no word spans two of them.  Special tokens are pieces."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return [c for i, part in enumerate(self.cut(text)) for c in ([part] if i % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        text = self.normal(text)
        return text.split() if not any(c in text for c in SEPARATORS) else [c for c in self.space(text) if c]


class Numbers:
    """Whole numbers by whole numbers from 0 on: keys lie in one array, in their own place or the next free one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 where there is none."""
        at = self.place(keys)
        met = self.keys.take(at)
        out = self.values.take(at)
        on = np.flatnonzero((met != keys) & (met >= 0))
        out[met != keys] = -1
        while len(on):
            at[on] = place = (at[on] + 1) & self.mask
            met = self.keys.take(place)
            same = met == keys[on]
            out[on[same]] = self.values.take(place[same])
            on = on[~same & (met >= 0)]
        return out


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Bpe(Splitter):
    """An encoder for a tokenizer file of byte-level BPE with a word-end suffix."""

    def read(self, spec: dict) -> None:
        super().read(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): i for i, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.pair_keys = np.zeros(0, np.int64)
        self.pair_good = np.zeros(0, bool)
        self.exact_words = 0
        self.ids = [*range(max(self.tokens) + 1)]  # lists of ids share these numbers
        self.texts = {i: str(i) for i in self.ids}
        self.code_symbols = [*self.letters, *[c + self.suffix for c in self.letters]]
        self.code_ids = np.array([self.vocab.get(s, -1) for s in self.code_symbols])
        whole = [(self.vocab[a], self.vocab[b], self.vocab[a + b], i) for (a, b), i in self.ranks.items()]
        left, right, made, rank = np.array(whole, np.int64).reshape(-1, 4).T
        self.merges = Numbers(left << PAIR_SHIFT | right, rank)
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[rank] = made
        self.plant()

    def plant(self) -> None:
        """The letters of all tokens, and the tree of their beginnings."""
        code = {c: k for k, c in enumerate(self.letters)}
        spelled = {i: [code.get(s[0], BETWEEN) for s in self.symbols(t)] for t, i in self.vocab.items()}
        self.token_sizes = np.zeros(len(self.ids), np.int64)
        ids = np.fromiter(spelled, np.int64, len(spelled))
        self.token_sizes[ids] = sizes = np.fromiter(map(len, spelled.values()), np.int64, len(spelled))
        self.token_codes = np.fromiter(chain.from_iterable(spelled.values()), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        if self.suffix:
            self.token_codes[ends[np.fromiter((t.endswith(self.suffix) and len(t) > len(self.suffix) for t in self.vocab), bool, len(ids))] - 1] += LAST
        self.token_starts = np.zeros(len(self.ids), np.int64)
        self.token_starts[ids] = starts = ends - sizes
        node, made = np.zeros(len(ids), np.int64), 1
        keys = []
        for depth in range(int(sizes.max())):
            here = np.flatnonzero(sizes > depth)
            own, back = np.unique(node[here] << CODE_SHIFT | self.token_codes[starts[here] + depth], return_inverse=True)
            node[here] = made + back
            made += len(own)
            keys.append(own)
        edges = np.concatenate(keys)
        self.tree = Numbers(edges, np.arange(1, made))
        self.token_of = np.full(made, -1, np.int64)
        self.token_of[node] = ids

    def merge(self, symbols: list[str]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        if len(symbols) > 64:
            return self.merge_long(symbols)
        rank, never = self.ranks.get, len(self.ranks)
        pairs = [rank(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while pairs and (low := min(pairs)) < never:
            i = pairs.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank((symbols[i], symbols[i + 1]), never)
            if i:
                pairs[i - 1] = rank((symbols[i - 1], symbols[i]), never)
        return [self.vocab[s] for s in symbols]

    def merge_long(self, symbols: list[str]) -> list[int]:
        """The same with a heap, for words of many letters."""
        left = [*range(-1, len(symbols) - 1)]
        right = [*range(1, len(symbols)), -1]
        rank = self.ranks.get
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            right[i] = right[j]
            right[j] = -1
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := rank((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, (symbols[a], symbols[b])))
        return [self.vocab[s] for s in symbols if s]

    def symbols(self, token: str) -> list[str]:
        """The letters of a token, the suffix joined to the last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    def merge_all(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, and how many ids each has; words of like length go together, very long ones alone."""
        counts, starts = np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
        made: list[np.ndarray] = []
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], ROW_LETTERS, "right"))
        for at in range(0, short, ROWS):
            part = order[at : min(at + ROWS, short)]
            ids, counts[part] = self.merge_rows(codes[stretches(starts[part], sizes[part])], sizes[part])
            made.append(ids)
        for k in order[short:].tolist():
            ids = self.merge([self.code_symbols[c] for c in codes[starts[k] : starts[k] + sizes[k]].tolist()])
            counts[k] = len(ids)
            made.append(np.array(ids, np.int64))
        where = np.cumsum(counts[order]) - counts[order]
        back = np.empty(len(order), np.int64)
        back[order] = where
        return np.concatenate(made)[stretches(back, counts)] if made else np.zeros(0, np.int64), counts

    def merge_rows(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words as rows of a table: in each turn every word merges its pair of lowest rank, the leftmost of equals.

        A row ends with an empty place, which is also what is left of the next row's first.
        """
        wide = int(sizes.max()) + 1
        inside = np.arange(wide) < sizes[:, None]
        ids = np.full(inside.size, -1, np.int64)
        ids[inside.ravel()] = self.code_ids[codes]
        left, right = np.arange(-1, len(ids) - 1), np.arange(1, len(ids) + 1)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            r = self.merges.get(np.where((a < 0) | (b < 0), -1, a << PAIR_SHIFT | b))
            return np.where(r < 0, NEVER, r).astype(np.int32)

        ranks = rank(ids, np.r_[ids[1:], -1])
        rows, stays = np.arange(len(sizes)), inside.ravel()
        while len(rows):
            own = ranks.reshape(-1, wide)[rows]
            at = own.argmin(1)
            low = own[np.arange(len(rows)), at]
            rows, at, low = (x[low < NEVER] for x in (rows, at, low))
            i = rows * wide + at
            j, before = right[i], left[i]
            after = right[j]
            ids[i] = new = self.made[low]
            right[i], left[after] = after, i
            stays[j], ranks[j] = False, NEVER
            ranks[i], ranks[before] = rank(new, ids[after]), rank(ids[before], new)
        out = ids[stays]
        if (out < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        return out, stays.reshape(-1, wide).sum(1)

    def longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place, and its letters; -1 and 1 where there is none."""
        token, size = np.full(len(codes), -1, np.int64), np.ones(len(codes), np.int64)
        at = np.flatnonzero(codes != BETWEEN)
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            node = self.tree.get(node << CODE_SHIFT | codes[at + depth])
            on = node >= 0
            at, node = at[on], node[on].astype(np.int64)
            depth += 1
            met = self.token_of[node]
            token[at[met >= 0]], size[at[met >= 0]] = met[met >= 0], depth
        return token, size

    def propose(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over words with a mark after each: the tokens (-1 where it gets stuck) and the number of the word of each."""
        token, size = self.longest(codes)
        follow, at, n = memoryview(np.arange(len(codes)) + size), 0, len(codes)
        starts: list[int] = []
        add = starts.append
        while at < n:
            add(at)
            at = follow[at]
        places = np.array(starts, np.int64)
        mark = codes[places] == BETWEEN
        return token[places[~mark]], np.cumsum(mark)[~mark]

    def judge(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (or single token, paired with itself shifted out of range) stands after exact merging."""
        keys, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        seen = np.zeros(len(keys), bool)
        inside = at < len(self.pair_keys)
        seen[inside] = self.pair_keys[at[inside]] == keys[inside]
        if not seen.all():
            new = keys[~seen]
            want = np.stack([(new >> PAIR_SHIFT) - 1, (new & ((1 << PAIR_SHIFT) - 1)) - 1], 1)
            sizes = np.where(want < 0, 0, self.token_sizes[want])
            ids, counts = self.merge_all(self.token_codes[stretches(self.token_starts[want].ravel(), sizes.ravel())], sizes.sum(1))
            last = np.cumsum(counts) - 1
            good = (counts == (want >= 0).sum(1)) & (ids[last] == want[:, 1]) & ((want[:, 0] < 0) | (ids[last - counts + 1] == want[:, 0]))
            self.pair_keys, self.pair_good = np.insert(self.pair_keys, at[~seen], new), np.insert(self.pair_good, at[~seen], good)
        return self.pair_good[np.searchsorted(self.pair_keys, keys)][back]

    def learn(self, words: set[str]) -> None:
        """Encodes words not known yet: propose all, verify all pairs together, merge the failing ones."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        words = [w for w in words if w not in known]
        known.update((w, older[w]) for w in words if w in older)
        words = [w for w in words if w not in known]
        if not words:
            return
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(words))
        codes = np.frombuffer(b"\0".join([*data, b""]), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        codes[ends] = BETWEEN
        if self.suffix:
            codes[ends - 1] += LAST
        token, word = self.propose(codes)
        before = np.r_[-1, token[:-1]]
        first = np.diff(word, prepend=-1) > 0
        before[first] = -1  # the first token is judged alone
        bad = (token < 0) | ((before < 0) & ~first)
        bad[~bad] = ~self.judge((before[~bad] + 1) << PAIR_SHIFT | (token[~bad] + 1))
        failed = np.bincount(word[bad], minlength=len(words)) > 0
        self.exact_words += int(failed.sum())
        right = np.flatnonzero(~failed)
        merged = np.flatnonzero(failed)
        exact, counts = self.merge_all(codes[stretches((ends - sizes)[merged], sizes[merged])], sizes[merged])
        for which, ids, n in ((right, token[~failed[word]], np.bincount(word, minlength=len(words))[right]), (merged, exact, counts)):
            flat = [*map(self.ids.__getitem__, ids.tolist())]
            to = np.cumsum(n)
            known.update((words[k], flat[a:b]) for k, a, b in zip(which.tolist(), (to - n).tolist(), to.tolist(), strict=True))

    def encode_chunks(self, chunks: list[str]) -> Iterator[list[int]]:
        """The ids of each chunk; all chunks' new words are verified together."""
        for at in range(0, len(chunks), WORDS_KEPT // 4):
            part = chunks[at : at + WORDS_KEPT // 4]
            words = [[] if c in self.special else self.words(c) for c in part]
            self.learn(set(chain.from_iterable(words)))
            known = self.known
            for chunk, own in zip(part, words, strict=True):
                yield [self.special[chunk]] if chunk in self.special else known[own[0]] if len(own) == 1 else [i for w in own for i in known[w]]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        chunks = self.chunks(text)
        ids = dict(zip(known := list(dict.fromkeys(chunks)), self.encode_chunks(known), strict=True))
        return np.fromiter(chain.from_iterable(map(ids.__getitem__, chunks)), np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids; the file names no decoder, so they are joined by one space."""
        return " ".join([*map(self.tokens.__getitem__, ids)])


class ChunkTable:
    """What ``values(chunks)`` gives for every chunk met, kept in two generations.

    When the younger is full the older is dropped, so common chunks stay and memory is bounded.
    """

    def __init__(self, split, values, keep: int | None = None):
        self.split, self.values, self.young, self.old = split, values, {}, {}
        self.keep = WORDS_KEPT if keep is None else keep
        self.fixed: dict = {}  # entries that stay

    def texts(self, texts: Iterable[str | None]) -> Iterator[list]:
        """For each text, the values of its chunks in order."""
        group, size = [], 0
        for text in texts:
            group.append(self.split(text))
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self.pieces(group)
                group, size = [], 0
        yield from self.pieces(group)

    def pieces(self, group: list[list[str]]) -> Iterator[list]:
        """For each list of chunks, their values."""
        if len(self.young) > self.keep:
            self.young, self.old = dict(self.fixed), self.young
        young, old = self.young, self.old
        missing = set().union(*group).difference(young)
        young.update((c, old[c]) for c in missing if c in old)
        fresh = [c for c in missing if c not in young]
        young.update(zip(fresh, self.values(fresh), strict=True))
        for chunks in group:
            yield [*map(young.__getitem__, chunks)]


_OPEN: dict[str, Bpe] = {}
_TABLES: dict[tuple[str, str], ChunkTable] = {}


def opened(path: str) -> Bpe:
    """The encoder for a file, opened once per worker."""
    if path not in _OPEN:
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


def chunk_table(path: str, use: str, make) -> ChunkTable:
    """The table of ``make(ids)`` by chunk, kept by the worker for its later tasks under the name of its use."""
    if (path, use) not in _TABLES:
        bpe = opened(path)
        _TABLES[(path, use)] = ChunkTable(bpe.chunks, lambda chunks: map(make, bpe.encode_chunks(chunks)))
    return _TABLES[(path, use)]


def encode_column(path: str):
    """A column function: text -> array<int> of ids."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = chunk_table(path, "ids", tuple)
        for batch in texts:
            yield pd.Series([np.fromiter(chain.from_iterable(v), np.int32) for v in table.texts(batch)])

    return encoded


def decode_column(path: str):
    """A column function: array<int> of ids -> text."""

    @F.pandas_udf(StringType())
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = opened(path)
        for batch in ids:
            yield pd.Series([bpe.decode([] if x is None else x) for x in batch])

    return decoded


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    shape = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    @F.pandas_udf(shape)
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = opened(path)
        # ids and tokens are joined by one space, so the chunks' strings can be joined as they are
        table = chunk_table(path, "texts", lambda ids: (" ".join([*map(bpe.texts.__getitem__, ids)]), bpe.decode(ids)))
        for batch in texts:
            out = []
            for values in table.texts(batch):
                ids, tokens = (" ".join([*filter(None, v)]) for v in zip(*values, strict=True)) if values else ("", "")
                out.append((ids.count(" ") + (ids != ""), _sha(ids), _sha(tokens)))
            yield pd.DataFrame(out, columns=shape.names)

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col).cast("string")).alias("d")).select("doc_id", "d.*")


def vocabulary() -> str:
    """Where the public vocabulary file of the registered queries is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
