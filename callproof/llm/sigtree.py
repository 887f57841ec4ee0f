"""Jaccard join of n-gram sets by signature trees: exact links, as one component id per document.

Texts are sets of word shingles; two are linked when the Jaccard similarity of their sets is ``similarity`` or more.  Equal sets
are one node, so exact copies, however many, are one row.

*Which sets meet.*  Linked sets differ in few shingles, ``d`` at most for their sizes.  So every set is cut by hash into more
than ``d`` parts, and two linked sets have at least one part wholly in common; there are some parts to spare, so that parts of
fewer than ``THIN`` shingles, which say little, are left out unless a set has too many of them.  Sizes are divided into classes,
each with its own number of parts; a set just above a class's end takes part in it too.  A node whose parts nobody shares has no link
and goes no further: what is shuffled for it is one long per part, a part having some eight shingles.  Nodes that share parts,
however indirectly, form a group, and only within groups are sets compared.

*How they are compared.*  The sets of a task stand in a signature tree: a leaf holds a set's size and a bitmap of its hashed
shingles, an inner node the OR of its children's bitmaps and the ranges of their sizes and groups.  Two trees (or one and itself)
are gone through together from the top; a pair of nodes is dropped when no pair of sets below it can overlap enough: by the
ranges of sizes, by the bits that the two bitmaps share (and how many shingles may hide behind one bit), and when all sets
below both are in one component already.  Pairs of leaves that are left are checked by their whole sets.  A task returns a
spanning forest of its links, never all pairs.

*Groups of any size.*  Small groups share tasks.  A group over ``SLICE_SETS`` sets or ``SLICE_SHINGLES`` shingles is sliced by hash; first every slice
is compared with the next one, then the sets that are not in the group's largest component by then, in slices of their own, with all slices.  Within a
component no further link can matter, so nothing is lost, and the second step is empty where near copies are alike.

Defined results: a null or empty text, or one of white space only, has no shingles and is linked with nothing, its component
being its own id; a text of fewer words than a shingle has is one shingle; repeated rows are returned once each; a null
``doc_id`` is kept and is never the id of a component that has another; an empty table gives an empty result; further columns
are ignored.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import cut, give_back, table
from .simhash import Forest, components, found_rows, shingle_hashes, text_key

SHINGLE_WORDS = 3
#: Numerator and denominator of the least similarity.
SIMILARITY = (90, 100)
#: Parts of fewer shingles are left out where enough others remain.
THIN = 3
#: Ratio of the ends of a class of sizes, at least.
CLASS_RATIO = 4 / 3
#: Sets, and shingles, that a slice of a group has at most.
SLICE_SETS, SLICE_SHINGLES = 2048, 1 << 20
#: Children of an inner node; bits of a leaf's bitmap for each shingle, and at most.
FAN, BITS_EACH, MOST_BITS = 8, 16, 1 << 16
#: Pairs of nodes, and words of bitmaps, looked at together.
PAIRS_HELD, WORDS_HELD = 1 << 14, 1 << 21
#: Texts that a task turns to sets together.
TEXTS_HELD = 256
EDGE_SCHEMA = "a long, b long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Classes:
    """Classes of sizes: the first size of each, and how many shingles linked sets of a class differ in at most."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        self.low = [1]

    def differing(self, c: int) -> int:
        a = self.first(c + 1) - 1
        return (self.den - self.num) * (a + a * self.den // self.num) // (self.den + self.num)

    def first(self, c: int) -> int:
        while len(self.low) <= c:
            last = self.low[-1]
            self.low.append(max(last + 1, int(last * CLASS_RATIO), -(-last * self.den // self.num)))
        return self.low[c]

    def of(self, size: int) -> list[int]:
        """The class of a size, and the one below if a set of that one can be linked."""
        self.first(0)
        while self.low[-1] <= size:
            self.first(len(self.low))
        c = int(np.searchsorted(self.low, size, side="right")) - 1
        return [c, c - 1] if c and size * self.num <= (self.low[c] - 1) * self.den else [c]


def part_keys(own: np.ndarray, classes: Classes) -> np.ndarray:
    """The keys by which a set (its sorted hashes) meets all sets that can be linked with it."""
    found = []
    if len(own):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(own), dtype=np.uint64)]
        high = own >> np.uint64(32)
        for c in classes.of(len(own)):
            if not (most := classes.differing(c)):
                continue  # only equal sets are linked, and those are one node
            parts = most + 1 + max(1, most // 10)
            ends = np.searchsorted((high * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            keys = mixed((sums[ends[1:]] - sums[ends[:-1]]) ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64((c + 1) << 40)))
            thin = np.diff(ends) < THIN
            found.append(keys[~thin] if thin.sum() < parts - most else keys)
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as lists of longs."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if len(arrays) else np.zeros(0, np.int64)))


def by_text(docs: DataFrame, made: str, make: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The columns of ``docs`` but the last, its text, with what ``make`` gives for ``TEXTS_HELD`` texts at a time."""
    kept = len(docs.columns) - 1
    schema = StructType([*docs.schema.fields[:kept], *StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_HELD):
                part = batch.slice(at, TEXTS_HELD)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(kept)), *make(part.column(kept).to_pylist())], names=schema.names)

    return docs.mapInArrow(run, schema)


def nodes_of(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The node of a text (the hash of its set), the size of its set, and its keys."""
    classes = Classes(similarity)

    def make(texts: list[str | None]) -> list[pa.Array]:
        rows = [(node_of(s), len(s), part_keys(s, classes)) for s in (shingle_set(t, words) for t in texts)]
        return [pa.array(signed([r[0] for r in rows])), pa.array(np.array([r[1] for r in rows], np.int32)), lists_of([r[2] for r in rows])]

    return by_text(docs, "node long, size int, keys array<long>", make)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """The node of a text, and its set."""
    def make(texts: list[str | None]) -> list[pa.Array]:
        rows = [shingle_set(t, words) for t in texts]
        return [pa.array(signed([*map(node_of, rows)])), lists_of(rows)]

    return by_text(docs, "node long, shingles array<long>", make)


class Tree:
    """A signature tree over sets, bottom level first; ``order`` says which set each leaf is."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray, bits: int):
        sizes = np.array([*map(len, sets)], np.int64)
        first = np.array([s[0] for s in sets], np.uint64)  # the least hash: near copies mostly share it
        self.order = np.lexsort((first, (np.log(sizes) / np.log(CLASS_RATIO)).astype(np.int64), group))
        sizes, group = sizes[self.order], group[self.order]
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for leaf, k in enumerate(self.order):
            at = sets[k] & np.uint64(bits - 1)
            np.bitwise_or.at(words[leaf], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        hidden = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [{"bits": words, "low": sizes, "high": sizes, "hidden": hidden, "first": group, "last": group}]
        while len(self.levels[-1]["low"]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below["low"]), FAN)
            over = {"bits": np.bitwise_or, "low": np.minimum, "high": np.maximum, "hidden": np.maximum, "first": np.minimum, "last": np.maximum}
            self.levels.append({k: f.reduceat(below[k], starts, axis=0) for k, f in over.items()})

    def rooted(self, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest component below every node."""
        out = [(root[self.order],) * 2]
        while len(out[-1][0]) > 1:
            starts = np.arange(0, len(out[-1][0]), FAN)
            out.append((np.minimum.reduceat(out[-1][0], starts), np.maximum.reduceat(out[-1][1], starts)))
        return out


def possible(left: dict, right: dict, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether some set below ``a`` and some set below ``b`` can be linked."""
    num, den = similarity
    fits = (left["first"][a] <= right["last"][b]) & (right["first"][b] <= left["last"][a])
    fits &= (den * left["high"][a] >= num * right["low"][b]) & (den * right["high"][b] >= num * left["low"][a])
    at = np.flatnonzero(fits)
    step = max(1, WORDS_HELD // left["bits"].shape[1])
    for k in range(0, len(at), step):
        own = at[k : k + step]
        x, y = a[own], b[own]
        most = np.bitwise_count(left["bits"][x] & right["bits"][y]).sum(axis=1, dtype=np.int64) + np.minimum(left["hidden"][x], right["hidden"][y])
        most = np.minimum(most, np.minimum(left["high"][x], right["high"][y]))
        fits[own] = (num + den) * most >= num * (left["low"][x] + right["low"][y])
    return fits


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of ``own`` each of the others has; all are sorted."""
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    at[at == len(own)] = 0
    return np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def check_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, forest: Forest, similarity: tuple[int, int]) -> None:
    """Adds to the forest the links among pairs of sets, leaving out pairs that are connected when their turn comes."""
    num, den = similarity
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
        k = int(i[own[0]])
        root = forest.settle()
        others = j[own]
        others = others[root[others] != root[k]]
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            common = overlaps(sets[k], [sets[x] for x in some])
            union = len(sets[k]) + np.array([len(sets[x]) for x in some]) - common
            hit = some[den * common >= num * union]
            if len(hit):
                forest.add(np.full(len(hit), k), hit)


def traverse(sets: list[np.ndarray], left: Tree, left_at: np.ndarray, right: Tree, right_at: np.ndarray, forest: Forest, similarity: tuple[int, int]) -> None:
    """Goes through two trees together; ``left_at`` and ``right_at`` say which of ``sets`` their sets are.  The same tree twice is a self-join."""
    same = left is right
    deep, wide = len(left.levels) - 1, len(right.levels) - 1
    waiting = [(deep, wide, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    roots = None
    while waiting:
        p, q, a, b = waiting.pop()
        if len(a) > PAIRS_HELD:
            waiting.append((p, q, a[PAIRS_HELD:], b[PAIRS_HELD:]))
            a, b = a[:PAIRS_HELD], b[:PAIRS_HELD]
        if roots is None:
            root = forest.settle()
            roots = left.rooted(root[left_at]), right.rooted(root[right_at])
        (alow, ahigh), (blow, bhigh) = roots[0][p], roots[1][q]
        apart = (alow[a] != ahigh[a]) | (blow[b] != bhigh[b]) | (alow[a] != blow[b])
        a, b = a[apart], b[apart]
        keep = possible(left.levels[p], right.levels[q], a, b, similarity)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if not p and not q:
            apart = a != b if same else np.full(len(a), True)
            check_pairs(sets, left_at[left.order[a[apart]]], right_at[right.order[b[apart]]], forest, similarity)
            roots = None
            continue
        x, y = a[:, None], b[:, None]
        if p >= q:  # one step down on the higher side, or on both
            x = x * FAN + np.arange(FAN)
        if q >= p:
            y = y * FAN + np.arange(FAN)
        x, y = (np.broadcast_to(z, (len(a), x.shape[1], y.shape[1])).ravel() for z in (x[:, :, None], y[:, None, :]))
        p, q = p - (p >= q), q - (q >= p)
        inside = (x < len(left.levels[p]["low"])) & (y < len(right.levels[q]["low"]))
        if same:
            inside &= x <= y
        waiting.append((p, q, x[inside], y[inside]))


def width(sizes: np.ndarray) -> int:
    """Bits of the bitmaps of a tree over sets of these sizes."""
    return int(min(MOST_BITS, max(256, 1 << int(BITS_EACH * int(sizes.max()) - 1).bit_length())))


def group_links(rows: pd.DataFrame, similarity: tuple[int, int]) -> pd.DataFrame:
    """A forest of the links in a task: ``node, shingles, root`` (its group), ``side`` (0 left, 1 right, 2 both)."""
    rows = rows.drop_duplicates(["node", "side"])
    nodes = rows["node"].to_numpy(np.int64)
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]]
    number, at = np.unique(nodes, return_inverse=True)
    forest = Forest(len(number))
    first = {int(n): k for k, n in reversed([*enumerate(at)])}
    whole = [sets[first[k]] for k in range(len(number))]
    side = rows["side"].to_numpy()
    groups = np.unique(rows["root"].to_numpy(np.int64), return_inverse=True)[1]
    sizes = np.array([*map(len, sets)], np.int64)
    largest = np.zeros(groups.max() + 1, np.int64)
    np.maximum.at(largest, groups, sizes)
    bits = np.array([width(largest[k : k + 1]) for k in range(len(largest))])[groups]
    for b in np.unique(bits):
        own = bits == b
        tree = lambda of: Tree([sets[k] for k in of], groups[of], int(b))  # noqa: B023, E731
        both, left, right = (np.flatnonzero(own & (side == s)) for s in (2, 0, 1))
        if len(both):
            one = tree(both)
            traverse(whole, one, at[both], one, at[both], forest, similarity)
        if len(left) and len(right):
            traverse(whole, tree(left), at[left], tree(right), at[right], forest, similarity)
    root = forest.settle()
    child = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": number[child], "b": number[root[child]]})


def groups_of(facts: DataFrame) -> DataFrame:
    """``facts(node, keys)`` -> ``(node, root)`` of the nodes that share keys, roots included."""
    keyed = facts.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    tops = components(keyed.join(shared, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    return tops.union(tops.select("root", "root").distinct())


def comparing(tasks: DataFrame, keys: list[str], similarity: tuple[int, int]) -> DataFrame:
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return group_links(rows, similarity)

    return tasks.groupBy(*keys).applyInPandas(compare, EDGE_SCHEMA)


def slices(sets: DataFrame, shingles: int, most: int) -> DataFrame:
    """``sets(root, node, size)`` -> ``(root, slices)``: how many slices each group needs."""
    need = F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum("size") / F.lit(shingles)))
    return sets.groupBy("root").agg(need.cast("int").alias("slices"))


def slice_of(n: str):
    return F.pmod(F.xxhash64("node", F.lit("slice")), F.col(n)).cast("int")


def all_links(sets: DataFrame, similarity: tuple[int, int], *, most_sets: int = SLICE_SETS, most_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """``sets(root, node, size, shingles)`` -> links ``(a, b)`` that connect exactly what is linked within groups."""
    counts = cut(slices(sets.select("root", "node", "size"), most_shingles, most_sets))
    sets = sets.join(counts, "root")
    small = sets.where("slices <= 1")
    bins = max(1, -(-(small.agg(F.sum("size")).first()[0] or 0) // most_shingles))
    found = comparing(small.select("node", "shingles", "root", F.lit(2).alias("side"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin")), ["bin"], similarity)
    if counts.where("slices > 1").isEmpty():
        return found
    large = sets.where("slices > 1").withColumn("slice", slice_of("slices"))
    pairs = F.explode(F.array_distinct(F.array(F.col("slice"), F.pmod(F.col("slice") + 1, F.col("slices")))))
    chained = cut(comparing(large.select("node", "shingles", "root", F.lit(2).alias("side"), pairs.alias("task")), ["root", "task"], similarity))
    tops = components(chained).select("node", F.col("root").alias("top"))
    placed = cut(large.select("root", "node", "size", "slices", "slice").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node")))
    main = placed.groupBy("root", "top").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("top", F.struct("n", "top")).alias("main"))
    rest = cut(placed.join(main, "root").where("top <> main").select("root", "node", "size", "slices"))
    if rest.isEmpty():
        return found.union(chained)
    parts = cut(slices(rest, most_shingles, most_sets).withColumnRenamed("slices", "parts"))
    left = rest.join(parts, "root").select("root", "node", slice_of("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"))
    right = placed.join(parts, "root").select("root", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slice", F.lit(1).alias("side"))
    dealt = left.unionByName(right).join(large.select("node", "shingles"), "node")
    return found.union(chained).union(comparing(dealt.select("node", "shingles", "root", "side", "part", "slice"), ["root", "part", "slice"], similarity))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, component_docs``."""
    text = F.col(text_col).cast("string")
    rows = cut(nodes_of(docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text")), words, similarity))
    facts = cut(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min_by(F.struct("doc_id", "text_key"), "text_key").alias("r")))
    groups = cut(groups_of(facts))
    wanted = cut(facts.join(groups, "node").select("r.doc_id", "r.text_key", "node", "root", "size"))
    sets = found_rows(docs, wanted.select("doc_id", "text_key").distinct(), id_col, text_col)
    sets = sets_of(sets.select(text.alias("text")), words).dropDuplicates(["node"])
    sets = cut(wanted.select("node", "root", "size").join(sets, "node"))
    tops = components(all_links(sets, similarity))
    classes = facts.select("node", "low", "n").join(tops, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_docs"))
    classes = classes.join(totals, "root").select("node", "component_id", "component_docs")
    linked = rows.where("size > 0").select("doc_id", "node", F.col("size").cast("long").alias("n_shingles")).join(classes, "node").select("doc_id", "n_shingles", "component_id", "component_docs")
    alone = rows.where("size = 0").select("doc_id", F.lit(0).cast("long"), "doc_id", F.lit(1).cast("long"))
    return linked.union(alone)


def op12_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
