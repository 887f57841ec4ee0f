"""Near duplicates by SimHash, made whole by an exact join: texts whose word shingles have a Jaccard similarity of ``similarity`` or more.

Texts are linked when the sets of their five-word shingles are as similar as that; linked texts form one component, and every
link counts.  Equal sets are one node.  Three steps leave out only what cannot have a link:

*Shared shingles.*  A linked set has at most ``|x| - ceil(similarity * |x|)`` shingles that the other one has not.  So of any
part of its shingles (here those in ``SHARE`` eighths of the hashes) all but that many are in another set too; nodes of which
this is not so, mostly nearly all, go no further.

*Groups.*  The shingles of the nodes that are left are ordered: those in the same part of the hashes first, from the rarest to the
most frequent, then all others by their hash.  Linked sets have one in common among their first ``|x| - ceil(similarity * |x|) + 1``
(prefix filter), and those of one set only need not be looked up.  Few sets, mostly small ones, reach beyond that part, so
only its shingles are dealt and counted.  Nodes that share such a shingle, however indirectly, form a group.

*Links.*  SimHash's tiled comparison, at a radius that suits the similarity (at 0.8 some ten of 64 bits differ, give or take
three), pairs each fingerprint of a group with the nearest other one of each pair of blocks, and these pairs are checked with
both whole sets.  That connects most groups; the others are compared exactly by signature trees (``sigtree.all_links``), which
find the links where a fingerprint is further away or another one is nearer.  Tasks return spanning forests, never all pairs.

Defined results: a null or empty text, or one of white space only, has the empty set, and all such are one component;
a text of fewer than five words is one shingle; a null ``doc_id`` is kept; an empty table gives an empty result.  Shingles and
sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, laid_down, removed
from .sigtree import all_links, by_text, groups_of, lists_of, node_of, sets_of, signed
from .simhash import components, folded, found_rows, links, nearest_links, one_each, shingle_hashes, text_key

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits by which fingerprints of candidates may differ.
NEAR = 16
#: Eighths of the hashes in which shingles are first looked for in other sets.
SHARE = 3


def ratio(similarity: float) -> tuple[int, int]:
    """Numerator and denominator of a similarity."""
    exact = Fraction(str(similarity)).limit_denominator(10**6)
    return exact.numerator, exact.denominator


def missing(size: Column, similarity: tuple[int, int]) -> Column:
    """How many shingles of a set of this size a linked one may lack at most."""
    return F.floor(size * F.lit(similarity[1] - similarity[0]) / F.lit(similarity[1]) + F.lit(1e-9)).cast("int")


def nodes_of(docs: DataFrame, words: int) -> DataFrame:
    """The node of a text (the hash of its set), its fingerprint, the size of its set, and the shingles that are looked for first."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        hashes = [shingle_hashes(t, words) for t in texts]
        sets = [np.unique(h) for h in hashes]
        some = [own[(own & np.uint64(7)) < SHARE] for own in sets]
        return [pa.array(signed([*map(node_of, sets)])), pa.array(signed([*map(folded, hashes)])), pa.array(np.array([*map(len, sets)], np.int32)), lists_of(some)]

    return by_text(docs, "node long, fp long, size int, some array<long>", make)


def sharing(rows: DataFrame, facts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``facts(node, size, first, rows, ...)`` without the nodes too many of whose shingles are in no other set; ``rows(node, some)``.

    What is exploded is dealt by shingle once; copies of a text are counted as often as they are there.
    """
    same = Window.partitionBy("key")
    keyed = rows.select("node", F.explode("some").alias("key")).select("node", (F.min("node").over(same) != F.max("node").over(same)).alias("met"))
    counts = keyed.where("met").groupBy("node").agg(F.count("*").alias("shared"))
    found = F.coalesce("shared", F.lit(0))
    return facts.join(counts, "node", "left").where(found >= F.col("rows") * (F.col("first") - missing(F.col("size"), similarity))).drop("shared")


def prefixes(sets: DataFrame, similarity: tuple[int, int], share: int = 8) -> DataFrame:
    """``sets(node, size, shingles)`` -> ``(node, keys)``: of the first shingles of each set those that another set may have.

    First come the shingles in ``share`` eighths of the hashes, rarest first, then the others as they stand.  Only the former are
    exploded, and dealt by shingle once.  ``more`` is how many are asked for beyond the former; a node may have two rows.
    """
    early = lambda x: x.bitwiseAND(F.lit(7)) < share
    parted = sets.select("node", "shingles", F.filter("shingles", early).alias("some")).withColumn("more", missing(F.size("shingles"), similarity) + 1 - F.size("some"))
    one = parted.select("node", "more", F.explode("some").alias("shingle"))
    often = one.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).where("n > 1")
    own = often.groupBy("node", "more").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    first = F.col("more") + F.size("own")  # those of one set only come before
    rare = own.where(first > 0).select("node", F.slice("own", F.lit(1), first).alias("own")).select("node", F.transform("own", lambda x: x["shingle"]).alias("keys"))
    beyond = parted.where("more > 0").select("node", F.slice(F.filter("shingles", lambda x: ~early(x)), F.lit(1), F.col("more")).alias("keys"))
    return rare.union(beyond)


def checked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are as similar as asked for."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(similarity[1] * F.col("common") >= similarity[0] * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def print_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that SimHash finds near: ``prints(node, fp)``, a row per node.  Not all that are; see ``set_links``."""
    one = cut(prints.groupBy("fp").agg(F.min("node").alias("low")))
    alike = prints.join(one, "fp").where("node <> low").select(F.col("node").alias("x"), F.col("low").alias("y"))
    ends = lambda end, node: one.select(F.col("fp").alias(end), F.col("low").alias(node))
    linked = links(one.select("fp"), radius, block=nearest_links).join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    return alike.union(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def set_links(nodes: DataFrame, sets: DataFrame, similarity: tuple[int, int], radius: int) -> DataFrame:
    """``nodes(root, node, size, fp)`` and ``sets(node, shingles)`` -> links ``(a, b)`` that connect exactly what is linked within groups.

    Links between near fingerprints come first; groups that these leave in several components are compared by their sets.
    """
    place = lambda end: nodes.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    pairs = print_pairs(nodes.select("node", "fp"), radius).distinct().join(place("a"), "a").join(place("b"), "b").where("a_root = b_root").select("a", "b")
    near = cut(checked(pairs, sets, similarity))
    tops = components(near).withColumnRenamed("root", "top")
    parts = nodes.select("node", "root").join(tops, "node", "left").groupBy("root").agg(F.count_distinct(F.coalesce("top", "node")).alias("parts"))
    apart = nodes.select("root", "node", "size").join(parts.where("parts > 1"), "root", "left_semi")
    return near.union(all_links(cut(apart.join(sets, "node").select("root", "node", "size", "shingles")), similarity))


def roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = NEAR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, root``, the root being that of its component.

    The shingles that are looked for first are removed when they have been; sets stay by node, apart from their groups.  Sets are
    written as they are made; only where rows are repeated, id and text, are they dealt by node to have each once.
    """
    text, least = F.col(text_col).cast("string"), ratio(similarity)
    looked, path = laid_down(nodes_of(docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text")), words))
    facts = looked.where("size > 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first(F.size("some")).alias("first"), F.count("*").alias("rows"), F.min_by(F.struct("doc_id", "text_key"), "text_key").alias("r"))
    wanted = cut(sharing(looked, facts, least).select("r.doc_id", "r.text_key", "node", "fp", "size"))
    rows = cut(looked.select("doc_id", "text_key", "node"))
    removed(docs.sparkSession, path)
    sets = found_rows(docs, wanted.select("doc_id", "text_key").distinct(), id_col, text_col)
    sets = cut(sets_of(sets.select(text.alias("text")), words).select("node", F.size("shingles").alias("size"), "shingles"))
    if sets.count() > wanted.count():
        sets = cut(sets.dropDuplicates(["node"]))
    groups = groups_of(cut(prefixes(sets, least, SHARE)))
    tops = components(set_links(cut(wanted.select("node", "fp", "size").join(groups, "node")), sets.select("node", "shingles"), least, radius))
    return rows.join(tops, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the smallest id, null ids last."""
    return one_each(docs, roots(docs, id_col, text_col, words=words, similarity=similarity), id_col, text_col)
