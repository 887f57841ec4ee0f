"""Runs of periodic words, found online by a sparse diagonal DP, and texts collapsed to one period of each.

The words of a text are read once.  At word ``i`` an earlier occurrence of the same word at ``i - q`` is a match on the
diagonal of lag ``q``; matches that follow each other make an active diagonal, of which only the start of its stretch of
words is kept.  A diagonal ends at the first word that does not match, and then emits its run at once if the stretch is long
enough.  Two things keep the diagonals sparse, and both lose nothing:

* A run has at least ``2 q`` matches, so a diagonal of lag ``q`` need only be looked for at every ``2^k``-th word, ``2^k`` being
  the greatest power of two up to ``q``, and only opened where the ``2^k`` words before match as well; its start is then
  found by going back to the first match.  So all words together look at ``n log n`` earlier occurrences at most, however
  often a word stands in the text.
* A lag that is a multiple of an active period whose stretch already spans it has exactly the same stretch (both ends of the
  one are ends of the other), whose smallest period is then not the lag; it is never opened.  So a run is emitted with its
  smallest period, and few diagonals are active at a word.

Defined results: a null, empty or white-space text has no words, no runs and an empty collapsed text; rows are independent, so
repeated rows and null ids are returned as they are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import table

LEAST_WORDS = 6
LEAST_PERIODS = 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def found_runs(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of each maximal stretch of ``least`` words and ``periods`` periods or more, as soon as it ends."""
    if periods < 3:
        raise ValueError("a run needs three periods at least")
    longest = len(words) // periods
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    stored = memoryview(array("L", ids)).cast("B")  # stretches of it are compared as bytes, without copies
    size = array("L").itemsize
    earlier: list[list[int] | None] = [None] * len(numbers)
    active: dict[int, int] = {}
    for i, word in enumerate(ids):
        if active:
            for lag in [q for q in active if ids[i - q] != word]:
                start = active.pop(lag)
                if i - start >= max(least, periods * lag):
                    yield start, i - start, lag
        seen = earlier[word]
        if seen is None:
            earlier[word] = [i]
            continue
        reach = min(2 * (i & -i), longest + 1)  # lags below it may be opened here
        if i - seen[-1] < reach:
            for j in reversed(seen):
                lag = i - j
                if lag >= reach:
                    break
                half = 1 << (lag.bit_length() - 1)
                if lag in active or j < half or ids[i - 1] != ids[j - 1] or ids[i - half] != ids[j - half]:
                    continue
                if any(lag % q == 0 and i - start >= lag for q, start in active.items()) or stored[(i - half) * size : i * size] != stored[(j - half) * size : j * size]:
                    continue
                start = j - half
                while start and ids[start - 1] == ids[start - 1 + lag]:
                    start -= 1
                active[lag] = start
        seen.append(i)
    for lag, start in active.items():
        if len(words) - start >= max(least, periods * lag):
            yield start, len(words) - start, lag


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, kept, strict=True) if k]


def runs_column(least: int, periods: int):
    """The runs of a text by start, then period, and the collapsed text."""

    @F.pandas_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def runs(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            own = sorted(found_runs(words, least, periods), key=lambda r: (r[0], r[2]))
            out.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in own], b" ".join(collapsed(words, own)).decode()))
        return pd.DataFrame(out, columns=["n_words", "runs", "collapsed"])

    return runs


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``; nothing is shuffled."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), runs_column(least, periods)(text).alias("r")).select("doc_id", "r.*")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length over period; of several that with the smallest start, then period.

    Fractions of numbers of words differ by more than a double's precision up to some ten million words a text.
    """
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


@F.pandas_udf(StringType())
def looped(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """Texts of the query: every tenth one by its seed repeats a stretch of its words up to its end."""
    out = []
    for text, seed in zip(texts, seeds, strict=True):
        if seed == seed and seed is not None and int(seed) % 10 == 0 and (words := words_of(text)):
            n, g = len(words), int(seed) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join([*words[:a], *(words[a + k % p] for k in range(n - a))]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped("text", F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    best = longest_run(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words of a text on its diagonal, islands of which are stretches; one that has a smaller period too is left out.
OP13_SQL = r"""
with recursive ids as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as ops
  from documents
), hashed as (
  select doc_id, w, len(w) as n,
    xor(list_reduce(list_prepend(4294967295::bigint, ops), lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint) as h
  from ids
), placed as (
  select *, (h // 10) % greatest(n, 1) as a, 3 + (h // 10) % 8 as times from hashed
), looped as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // times) + 1] end) else w end as w from placed
), tokens as (
  select doc_id, n, unnest(w) as word, unnest(range(n)) as i from looped
), pairs as (
  select b.doc_id, b.i - a.i as q, b.i from tokens a join tokens b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= b.n
), stretches as (
  select doc_id, q, min(i) - q as start, count(*) + q as length
  from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island
  having count(*) + q >= greatest(6, 4 * q)
), runs as (
  select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length
), best as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -(length / period), s := start, p := period)) as r
  from runs group by doc_id
), dropped as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from tokens anti join dropped using (doc_id, i) group by doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, r.s as start, r.l as length, r.p as period, 1000 * r.l // r.p as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join best b on d.doc_id = b.doc_id left join kept k on d.doc_id = k.doc_id
"""
