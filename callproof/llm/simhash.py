"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Every text becomes a 64-bit fingerprint; texts whose fingerprints differ in at
most ``radius`` bits are linked, and linked texts form one component.

Equal fingerprints are merged first, so a group of copies, however large, is one
row.  The distinct fingerprints are dealt into blocks by population count (a
count with many fingerprints is sliced further), and only pairs of blocks whose
counts lie within the radius are compared: a difference in population count is
a lower bound of the number of differing bits.  Inside a pair of blocks the same
bound is used again on the counts of the four 16-bit words: these form tiles, and
only tile pairs whose counts differ by no more than the radius in all are
compared, by numpy exclusive-or and bit counts.  A task returns a spanning forest
of the links that it found, never all pairs, so what leaves it is linear in what
it read.  The comparison is exact, so its work still grows with the square of the
number of distinct fingerprints, with the small constant that the bounds leave.

Defined results: a null or empty text, or one of white space only, has fingerprint
zero and is linked like any other; repeated rows are returned once each; a null
``doc_id`` is kept, and is never the id of a component unless all its ids are null;
``keep_one`` decides by row, so texts that share an id, or have none, stand each for themselves;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import cut, unused

SHINGLE_WORDS = 4
RADIUS = 4
#: Fingerprints in a slice of a population count: 0.5 MB each side of a task.
SLICE = 65536
#: Pairs compared, and links held, at once: some 20 MB.
TILE_PAIRS = 1_000_000
SEED = 42
#: Edges that a task makes trees of at once, and such tasks at least.
EDGES_HELD, LEAST_TASKS = 250_000, 8


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) > words:
        ends, starts = ends[words - 1 :], starts[: len(parts) - words + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: unsigned 64 bits over its word shingles, repeats included."""
    return folded(shingle_hashes(text, words))


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed longs with the same bits."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


class Forest:
    """Keeps a spanning forest of the links seen so far between ``size`` nodes."""

    def __init__(self, size: int):
        self.root = np.arange(size, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > TILE_PAIRS:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest node of each node's tree, with all links so far in."""
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.held = [], 0
            while True:
                a, b = self.root[a], self.root[b]
                apart = a != b
                if not apart.any():
                    break
                a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
                np.minimum.at(self.root, a, b)
                while (self.root != (up := self.root[self.root])).any():
                    self.root = up
        return self.root


def tiles(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the bit counts of the four words, where each tile starts in it, and each tile's counts."""
    counts = np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = ((counts[:, 0] * 17 + counts[:, 1]) * 17 + counts[:, 2]) * 17 + counts[:, 3]
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    return order, starts, counts[order[starts]].astype(np.int8)


def compare(left: np.ndarray, right: np.ndarray, radius: int, found) -> None:
    """Calls ``found(i, j)`` with index arrays of all pairs of left and right within the radius."""
    lo, ls, lc = tiles(left)
    ro, rs, rc = tiles(right)
    sizes = np.diff(np.r_[rs, len(right)])
    sorted_right = right[ro]
    for at, end, counts in zip(ls.tolist(), [*ls[1:].tolist(), len(left)], lc, strict=True):
        near = np.abs(rc - counts).sum(axis=1, dtype=np.int16) <= radius
        if not near.any():
            continue
        to = np.flatnonzero(np.repeat(near, sizes))
        others = sorted_right[to]
        step = max(1, TILE_PAIRS // len(to))
        for a in range(at, end, step):
            mine = lo[a : min(a + step, end)]
            i, j = np.nonzero(np.bitwise_count(left[mine][:, None] ^ others[None, :]) <= radius)
            if len(i):
                found(mine[i], ro[to[j]])


def block_links(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links in one pair of blocks; ``side`` is 0, 1, or 2 for a block with itself."""
    prints = rows["fp"].to_numpy(np.int64).view(np.uint64)
    side = rows["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    forest = Forest(len(prints))
    if len(left) and len(right):
        compare(np.ascontiguousarray(prints[left]), np.ascontiguousarray(prints[right]), radius, lambda i, j: forest.add(left[i], right[j]))
    root = forest.settle()
    child = np.flatnonzero(root != np.arange(len(root)))
    signed = prints.view(np.int64)
    return pd.DataFrame({"a": signed[child], "b": signed[root[child]]})


def nearest_links(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """For each fingerprint of one pair of blocks its link to the nearest other one within the radius (of several, the first)."""
    prints = rows["fp"].to_numpy(np.int64).view(np.uint64)
    side = rows["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    best = np.full(len(prints), np.iinfo(np.int64).max)

    def met(i: np.ndarray, j: np.ndarray) -> None:
        i, j = left[i], right[j]
        i, j = i[i != j], j[i != j]
        bits = np.bitwise_count(prints[i] ^ prints[j]).astype(np.int64) << 40
        np.minimum.at(best, i, bits | j)
        np.minimum.at(best, j, bits | i)

    if len(left) and len(right):
        compare(np.ascontiguousarray(prints[left]), np.ascontiguousarray(prints[right]), radius, met)
    own = np.flatnonzero(best != np.iinfo(np.int64).max)
    signed = prints.view(np.int64)
    return pd.DataFrame({"a": signed[own], "b": signed[best[own] & ((1 << 40) - 1)]})


def links(prints: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE, block=block_links) -> DataFrame:
    """``prints(fp long, distinct)`` -> links ``(a, b)`` that connect exactly what lies within the radius, or what ``block`` gives."""
    counts = dict(prints.groupBy(F.bit_count("fp").alias("n")).count().collect())  # 65 rows at most
    slices = [-(-counts.get(n, 0) // slice_rows) for n in range(65)]
    known = F.array(*[F.lit(s) for s in slices])
    own = prints.select("fp", F.bit_count("fp").cast("int").alias("n")).withColumn("s", F.pmod(F.xxhash64("fp"), F.get(known, F.col("n"))).cast("int"))
    partner = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.col("n") - radius, F.lit(0)), F.least(F.col("n") + radius, F.lit(64))),
            lambda m: F.transform(
                F.filter(F.sequence(F.lit(0), F.greatest(F.get(known, m), F.lit(1)) - 1), lambda _: F.get(known, m) > 0),
                lambda t: F.struct(m.alias("n"), t.alias("s")),
            ),
        )
    )
    me = F.struct("n", "s")
    dealt = own.select("fp", me.alias("me"), F.explode(partner).alias("to")).select(
        "fp",
        F.least("me", "to").alias("low"),
        F.greatest("me", "to").alias("high"),
        F.when(F.col("me") == F.col("to"), 2).when(F.col("me") < F.col("to"), 0).otherwise(1).alias("side"),
    )
    return dealt.groupBy("low", "high").applyInPandas(lambda rows: block(rows, radius), "a long, b long")


EDGES = StructType([StructField("a", LongType()), StructField("b", LongType())])


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges ``(a, b)`` of a task, ``EDGES_HELD`` at a time, as trees of one level: each node with the smallest of its tree."""
    held: list[pd.DataFrame] = []

    def trees() -> pd.DataFrame:
        pairs = pd.concat(held)
        nodes, at = np.unique(np.concatenate([pairs["a"], pairs["b"]]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.add(at[: len(pairs)], at[len(pairs) :])
        root = forest.settle()
        child = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": nodes[child], "b": nodes[root[child]]})

    for rows in batches:
        held.append(rows)
        if sum(map(len, held)) >= EDGES_HELD:
            yield trees()
            held = []
    if held:
        yield trees()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of ``edges(a, b)`` -> ``(node, root)``, root the smallest long reachable; a root itself has no row.

    First each task makes trees of some ``EDGES_HELD`` edges, so that a node has few parents however many edges it had.  In
    each round a node and its other parents go below the smallest of them, and every node below its parent's parent.  It
    ends when no node has several parents and no parent has one; each round is checkpointed.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = max(LEAST_TASKS, -(-edges.count() // EDGES_HELD))
    edges = edges.coalesce(tasks).mapInPandas(local_forest, EDGES)
    for _ in range(rounds):
        parents = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))
        below = F.concat(F.array(F.struct(F.col("a"), F.lit(False).alias("moved"))), F.transform(F.filter("all", lambda x: x != F.col("m")), lambda x: F.struct(x.alias("a"), F.lit(True).alias("moved"))))
        linked = parents.select(F.explode(below).alias("e"), F.col("m").alias("b")).select("e.a", "b", "e.moved")
        up = parents.select(F.col("a").alias("of"), F.col("m").alias("top"))
        moved = linked.join(up, F.col("b") == F.col("of"), "left").select("a", F.coalesce("top", "b").alias("b"), (F.col("moved") | F.col("top").isNotNull()).alias("moved"))
        state = cut(moved)
        edges = state.select("a", "b")
        if state.where("moved").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct(fp, ...)`` with the ``root`` of each fingerprint's component."""
    nodes = components(links(distinct.select("fp"), radius))
    return distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(*[distinct[c] for c in distinct.columns], F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, component_docs``."""
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col).cast("string")).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    found = rooted(distinct, radius)
    totals = found.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_docs"))
    classes = found.join(totals, "root").select("fp", "component_id", "component_docs")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_docs")


def text_key(text: Column) -> Column:
    """With its ``doc_id``, what a row is found by again."""
    return F.xxhash64(text.cast("string"))


#: Rows to leave out, by id and key, that are sent to all tasks at most: some 20 MB.
MOST_BROADCAST = 200_000


def one_each(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each ``root`` of ``rows(doc_id, text_key, root)``: that of the smallest id, nulls last, then of the smallest key.

    The rows to leave out are usually few; up to ``MOST_BROADCAST``, counted, no text is shuffled.
    """
    counted = cut(rows.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies")))
    best = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "copies")).alias("k"))
    keep = cut(best.select("k.doc_id", "k.text_key", "k.copies"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    others = counted.select("doc_id", "text_key").alias("a").join(keep.where("copies = 1").alias("b"), same, "left_anti")
    kept, repeated = found_rows(docs, cut(others), id_col, text_col, "left_anti"), keep.where("copies > 1")
    return kept if repeated.isEmpty() else kept.unionByName(found_rows(docs, repeated, id_col, text_col).dropDuplicates([id_col, text_col]))


def found_rows(docs: DataFrame, some: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` that are (``left_semi``) or are not (``left_anti``) among ``some(doc_id, text_key)``."""
    own_id, own_key = unused(docs, "other_id"), unused(docs, "other_key")
    named = some.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    named = F.broadcast(named) if some.count() <= MOST_BROADCAST else named
    return docs.join(named, docs[id_col].eqNullSafe(named[own_id]) & (text_key(docs[text_col]) == named[own_key]), how)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the smallest id, null ids last."""
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), fingerprint_column(F.col(text_col).cast("string")).alias("fp")))
    roots = rooted(cut(prints.select("fp").distinct()), radius)
    return one_each(docs, prints.join(roots, "fp").select("doc_id", "text_key", "root"), id_col, text_col)


def op1_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
