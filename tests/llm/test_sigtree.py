import random

import numpy as np
import pandas as pd
import pytest
from callproof.llm import sigtree

SCHEMA = "doc_id long, text string, n_shingles int"


def plain_set(text, words=3):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute(rows, words=3, num=90, den=100):
    sets = [plain_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if len(sets[j]) * num > den * len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if sets[i] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(rnd, n, words=120, changes=3, vocabulary=400):
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = [t for words in (4, 9, 12, 13, 20, 33, 60, 150, 700) for _ in range(3) for t in near_copies(rnd, 8, words, max(2, words // 40))]
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 90))) for _ in range(40)]
    out += [None, "", " \t\n", "one", "one", "ONE", "one two", "Two words", "a b c", "a b c d"] + [out[0]] * 20
    rnd.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], SCHEMA)
    got = rows_of(sigtree.jaccard_join(df))
    assert got == brute(texts)
    assert len({c for _, _, c in got}) < len(got) * 0.8  # there are links


@pytest.mark.parametrize("similarity", [(1, 2), (80, 100), (95, 100), (1, 1)])
def test_other_similarities(spark, texts, similarity):
    some = texts[::2]
    assert rows_of(sigtree.jaccard_join(spark.createDataFrame([(i, t, 0) for i, t in some], SCHEMA), words=2, similarity=similarity)) == brute(some, 2, *similarity)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "f g h i"), (None, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    assert rows_of(sigtree.jaccard_join(df)) == sorted([(None, 3, 5), (None, 3, 5), (5, 3, 5), (None, 2, None), (None, 0, None)], key=str)
    assert sigtree.jaccard_join(df.limit(0)).count() == 0


def test_linked_sets_share_a_key():
    """At every size, sets that just reach the similarity, at either end of their classes."""
    rng = np.random.default_rng(2)
    classes = sigtree.Classes((90, 100))
    for size in [*range(1, 80), 100, 333, 1000, 4001]:
        own = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for gone in {0, size // 19, size // 20, size // 10}:
            for more in {0, size // 19, size // 20, size // 9}:
                other = np.unique(np.r_[own[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)])
                common = size - gone
                if len(other) and 100 * common >= 90 * (size + len(other) - common) and gone + more:
                    assert np.intersect1d(sigtree.part_keys(own, classes), sigtree.part_keys(other, classes)).size, (size, gone, more)


def links_of(rows, similarity=(90, 100)):
    found = sigtree.group_links(rows, similarity)
    return {tuple(sorted(x)) for x in found.itertuples(index=False)}


def test_trees_prune_and_find(monkeypatch):
    """The traversal finds what all pairs find, and checks few pairs."""
    rnd = random.Random(4)
    sets = [np.unique(np.array([*map(hash, plain_set(t))], np.int64).view(np.uint64)) for k in range(30) for t in near_copies(rnd, 10, 150, 8)]
    rows = pd.DataFrame({"node": np.arange(len(sets)), "shingles": [s.view(np.int64) for s in sets], "root": 7, "side": 2})
    checked = []
    plain = sigtree.overlaps
    monkeypatch.setattr(sigtree, "overlaps", lambda own, others: checked.append(len(others)) or plain(own, others))
    forest = sigtree.Forest(len(sets))
    for a, b in links_of(rows):
        forest.add(np.array([a]), np.array([b]))
    want = sigtree.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                want.add(np.array([i]), np.array([j]))
    assert (forest.settle() == want.settle()).all() and len(set(want.root.tolist())) < 290
    assert sum(checked) < 1500  # of 44,850 pairs
    two = rows.assign(side=np.arange(len(sets)) % 2)
    split = sigtree.Forest(len(sets))
    for a, b in links_of(two) | {tuple(x) for half in (0, 1) for x in links_of(two[two["side"] == half].assign(side=2))}:
        split.add(np.array([a]), np.array([b]))
    assert (split.settle() == want.settle()).all()


def test_large_groups_are_sliced(spark):
    """One group many times a slice: components as from one task."""
    rnd = random.Random(9)
    texts = near_copies(rnd, 90, 90, 6) + near_copies(rnd, 10, 90, 1)
    sets = [np.unique(np.array([*map(hash, plain_set(t))], np.int64).view(np.uint64)) for t in texts]
    rows = pd.DataFrame({"node": np.arange(len(sets)), "shingles": [s.view(np.int64) for s in sets], "root": 3, "side": 2})
    want = sigtree.Forest(len(sets))
    for a, b in links_of(rows):
        want.add(np.array([a]), np.array([b]))
    df = spark.createDataFrame([(3, k, len(s), s.view(np.int64).tolist()) for k, s in enumerate(sets)], "root long, node long, size int, shingles array<long>")
    got = sigtree.Forest(len(sets))
    for r in sigtree.all_links(df, (90, 100), most_sets=12).collect():
        got.add(np.array([r["a"]]), np.array([r["b"]]))
    assert (got.settle() == want.settle()).all() and len(set(want.root.tolist())) > 3


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in sigtree.table(spark, sf, "documents").collect()]
    assert rows_of(sigtree.op12_query(spark, sf)) == brute(rows)
