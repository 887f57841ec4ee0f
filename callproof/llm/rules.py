"""Quality rules with thresholds that adapt to the language and source.

Each text gets counts (words, symbols, repeated lines and words, letter cases) and from them a few
ratios.  Mergeable quantile sketches (KLL) of every ratio are built per language and source, with
partial aggregation, and merged upwards per language and over all.  From a sketch's quartiles come
fences, ``q75 + reach * max(q75 - q25, least spread)``; a group of fewer than ``least_rows`` texts
uses its language's sketch, and a language that small the sketch over all.  The texts are then joined
with the fences of their group.  The group table has one row per language and source; up to ``MOST_BROADCAST``
groups, counted, it is broadcast, so texts are not shuffled; beyond, a hot source is split as a skewed join.

Besides, the fixed base rules reject texts of fewer than ``BASE_WORDS`` words or with too many words in
repeated five-word windows.

Defined results: a null or empty text has no words and fails the base rules; null language or source is a
group of its own; a ratio that is undefined rejects nothing; repeated rows are judged alike and returned
once each; an empty table gives an empty result; further columns are ignored, or kept by ``kept_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import cut, give_back, unused

WINDOW = 5
BASE_WORDS = 10
BASE_REPEATS = 20
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\v\f\r "
#: Ratio -> (lower fence too?, least spread).
RATIOS = {"word_length": (True, 0.6), "symbols": (False, 0.05), "marks": (False, 0.04), "capitals": (False, 0.06), "repeats": (False, 0.05)}
REACH = 5.0
LEAST_ROWS = 100
SKETCH_K = 400
#: Groups whose fences are broadcast: 100 bytes each.
MOST_BROADCAST = 50_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_letters"]
SHAPE = StructType([StructField(n, LongType()) for n in COUNTS])

_SYMBOLS = np.array([*SYMBOLS.encode()])
_SPACE = np.array([*SPACE.encode()])
_CAPITALS, _SMALL = slice(65, 91), slice(97, 123)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of words that is found twice or more in the text."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    # windows are numbered pair by pair, so that equal numbers mean equal windows
    grams, size = ids, 1
    while size < window:
        step = min(size, window - size)
        ahead = grams[step:]
        key = grams[: len(ahead)] * (len(words) + 1) + ahead
        grams, size = np.unique(key, return_inverse=True)[1], size + step
    again = np.bincount(grams)[grams] > 1
    if not again.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, as named in ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "replace")
    words = data.split()  # at ASCII white space only
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = len(data) - int(bins[128:192].sum()) - int(bins[_SPACE].sum())
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    capitals = int(bins[_CAPITALS].sum())
    return (len(words), letters, int(bins[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), int(bins[_MARKS].sum()), capitals, capitals + int(bins[_SMALL].sum()))


@F.pandas_udf(SHAPE)
def counts_column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    give_back()
    for batch in texts:
        yield pd.DataFrame([counts_of(t) for t in batch], columns=COUNTS)


def ratios(c: str) -> dict[str, Column]:
    """The ratios, each null where it is undefined, from a struct of counts."""
    part = lambda a, b: F.try_divide(F.col(f"{c}.{a}").cast("double"), F.col(f"{c}.{b}"))
    return {
        "word_length": part("word_chars", "n_words"),
        "symbols": part("n_symbols", "n_words"),
        "marks": part("n_marks", "word_chars"),
        "capitals": part("n_capitals", "n_letters"),
        "repeats": part("n_repeat_words", "n_words"),
    }


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < BASE_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > BASE_REPEATS * F.col(f"{c}.n_words"))


def fences(counted: DataFrame, *, reach: float = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``counted(lang, source, c)`` -> ``(lang, source, fence)`` with bounds for every ratio."""
    named = ratios("c")
    sketches = counted.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(v, SKETCH_K).alias(k) for k, v in named.items()])
    sketches = cut(sketches)  # used three times; one row per group

    def merged(by: list[str]) -> DataFrame:
        sums = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, SKETCH_K).alias(k) for k in named]]
        return sketches.groupBy(*by).agg(*sums) if by else sketches.agg(*sums)

    def bounds() -> list[Column]:
        out = []
        for k, (low, spread) in RATIOS.items():
            some = F.kll_sketch_get_n_double(k) > 0
            q = lambda r, k=k, some=some: F.when(some, F.kll_sketch_get_quantile_double(F.col(k), F.lit(r)))
            width = F.greatest(q(0.75) - q(0.25), F.lit(spread)) * reach
            out += [(q(0.75) + width).alias(f"{k}_max"), ((q(0.25) - width) if low else F.lit(None).cast("double")).alias(f"{k}_min")]
        return out

    total = merged([]).select(*bounds()).first()  # one row of a few numbers
    of_all = F.struct(*[F.lit(total[c]).cast("double").alias(c) for c in total.asDict()])
    own = sketches.select("lang", "source", "n", F.struct(*bounds()).alias("own"))
    by_lang = merged(["lang"]).select(F.col("lang").alias("lang_"), F.col("n").alias("lang_n"), F.struct(*bounds()).alias("of_lang"))
    best = F.when(F.col("n") >= least_rows, F.col("own")).when(F.col("lang_n") >= least_rows, F.col("of_lang")).otherwise(of_all)
    found = cut(own.join(by_lang, own["lang"].eqNullSafe(by_lang["lang_"])).select("lang", "source", best.alias("fence")))
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def within(c: str, fence: str) -> Column:
    """Whether every defined ratio lies inside its fences."""
    tests = []
    for k, v in ratios(c).items():
        tests.append(F.coalesce(v <= F.col(f"{fence}.{k}_max"), F.lit(True)))
        if RATIOS[k][0]:
            tests.append(F.coalesce(v >= F.col(f"{fence}.{k}_min"), F.lit(True)))
    return reduce(lambda a, b: a & b, tests)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed`` and ``kept``."""
    counted = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counts_column(F.col(text_col).cast("string")).alias("c")))
    limits = fences(counted, reach=reach, least_rows=least_rows).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["lang_"]) & counted["source"].eqNullSafe(limits["source_"]), "left")
    failed = base_failed("c")
    return joined.select("doc_id", *[F.col(f"c.{n}") for n in COUNTS[:5]], failed.alias("base_failed"), (~failed & within("c", "fence")).alias("kept"))


def kept_rows(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    c, fence, lang, source = (unused(docs, n) for n in ("c_", "fence_", "fence_lang", "fence_source"))
    counts = counts_column(F.col(text_col).cast("string"))
    limits = fences(docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counts.alias("c")), reach=reach, least_rows=least_rows)
    limits = limits.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("fence").alias(fence))
    own = docs.withColumn(c, counts)
    joined = own.join(limits, own[lang_col].eqNullSafe(limits[lang]) & own[source_col].eqNullSafe(limits[source]), "left")
    # one condition over both sides: a part of it that needs the counts only would be moved below the join, and they be made again there
    return joined.where(F.when(~base_failed(c), within(c, fence))).select(*[docs[x] for x in docs.columns])


def op6_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return quality_rules(table(spark, sf_dir, "documents"))
