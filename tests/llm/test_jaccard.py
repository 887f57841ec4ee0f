import random
from pathlib import Path

import numpy as np
import pandas as pd
from callproof.llm import jaccard, simhash
from callproof.llm._common import checkpoint_dir, table

import corpus_pipeline

SCHEMA = "doc_id long, text string, root string, n_chars long"


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The ids kept, and the number of linked pairs of different texts."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                linked += a != b
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(map(min, groups.values())), linked


def test_stage_keeps_one_of_each_group(spark, sf):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(words, k=12))
    texts = [None, "", " \t", "one", "One", "a b c d", "a b c d e", line]
    for k in range(60):
        base = rng.choices(words, k=rng.randint(20, 150))
        texts += [" ".join(base), " ".join(base).upper(), line + " " + " ".join(base)]
        for _ in range(12 if k < 3 else 4):  # near and far: from one changed word to too many
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], SCHEMA)
    want, linked = brute(rows)
    assert linked > 100
    got = corpus_pipeline.near_duplicates(spark, df, sf)
    kept = {r["doc_id"] for r in got.collect()}
    # only what is alike goes (so the brute-force survivors stay), and nearly all of that
    assert got.columns == df.columns and kept >= {*want} and len(rows) - len(kept) >= 0.95 * (len(rows) - len(want))
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = brute(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert kept >= {*want} and len(rows) - len(kept) >= 0.85 * (len(rows) - len(want))


def test_nearest_links():
    rng = np.random.default_rng(3)
    prints = np.unique(np.r_[rng.integers(0, 2**63, 60), rng.integers(0, 4, 40) << 3])
    both = pd.DataFrame({"fp": prints, "side": rng.integers(0, 2, len(prints))})
    alone = both.assign(side=2)
    apart = np.bitwise_count(prints[:, None].view(np.uint64) ^ prints[None, :].view(np.uint64)).astype(int)
    for rows, may in ((both, both["side"].to_numpy()[:, None] != both["side"].to_numpy()[None, :]), (alone, ~np.eye(len(prints), dtype=bool))):
        d = np.where(may, apart, 99)
        got = simhash.nearest_links(rows, 20)
        want = [k for k in range(len(prints)) if d[k].min() <= 20]
        assert got["a"].tolist() == prints[want].tolist()
        assert [d[k, [*prints].index(b)] for k, b in zip(want, got["b"], strict=True)] == d[want].min(1).tolist()


def test_no_link_is_left_out(spark):
    """Short texts that are alike, but whose fingerprints are further apart than the radius, or nearer to others."""
    rng = random.Random(5)
    texts = []
    for k in range(400):
        base = [f"v{rng.randrange(90)}" for _ in range(rng.randint(8, 14))]
        texts += [" ".join(base), " ".join([*base, f"end{k}"]), " ".join([f"start{k}", *base[:-1]])]
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint(t, jaccard.SHINGLE_WORDS) for t in texts]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(grams(texts[i]) & grams(texts[j])) >= 0.8 * len(grams(texts[i]) | grams(texts[j]))]
    assert sum((prints[i] ^ prints[j]).bit_count() > jaccard.NEAR for i, j in linked) > 5
    want, _ = brute(rows)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_set_links_are_whole_whatever_simhash_finds(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=80)
        texts += [" ".join(base[k:] + rng.choices(words, k=k)) for k in (0, 2, 4, 6, 8, 10)]
    rows = list(enumerate(texts))
    want, linked = brute(rows)
    assert linked > 12
    for radius in (0, jaccard.NEAR):
        got = jaccard.roots(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius).groupBy("root").agg({"doc_id": "min"}).collect()
        assert sorted(r["min(doc_id)"] for r in got) == want


def test_shingles_are_dealt_once(spark):
    """Whether a shingle is in other sets, and in how many, is settled where it was dealt to, without a second shuffle of all of them."""

    def exploded(df):
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Generate explode")

    rows = spark.createDataFrame([(1, [1, 2, 3, 4]), (1, [1, 2, 3, 4]), (2, [4, 5, 6, 7]), (3, [1, 2, 3, 8]), (4, [9, 10, 11, 12])], "node long, some array<long>")
    facts = spark.createDataFrame([(1, 5, 4, 2), (2, 5, 4, 1), (3, 5, 4, 1), (4, 5, 4, 1)], "node long, size int, first int, rows long")
    near = jaccard.sharing(rows, facts, (4, 5))
    assert sorted(r["node"] for r in near.collect()) == [1, 3] and exploded(near) == 1
    sets = spark.createDataFrame([(1, 5, [1, 2, 3, 4, 5]), (2, 5, [2, 3, 4, 5, 6]), (3, 5, [3, 4, 5, 6, 2]), (4, 5, [9, 10, 11, 12, 3])], "node long, size int, shingles array<long>")
    first = jaccard.prefixes(sets, (4, 5))
    assert {r["node"]: r["keys"] for r in first.collect()} == {1: [2], 2: [6, 2], 3: [6, 2]} and exploded(first) == 1


def test_shingles_looked_for_first_take_no_place_afterwards(spark):
    """Of texts that nothing is like, only ids and hashes stay in the shared folder, not a good third of their shingles."""
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    held = lambda: {f: f.stat().st_size for f in folder.rglob("*") if f.is_file() and not f.name.startswith(".")}
    rng, before = random.Random(2), held()
    rows = [(k, " ".join(str(rng.randrange(10**9)) for _ in range(2000))) for k in range(100)]
    found = jaccard.roots(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.select("root").distinct().count() == 100
    assert sum(n for f, n in held().items() if f not in before) < 100 * 1000


def test_prefixes_stay_in_the_part_that_is_looked_for_first(spark):
    rng = np.random.default_rng(5)
    sets = []
    for size in [*range(1, 40), *[200] * 20]:
        one = rng.integers(0, 2**64, size, np.uint64)
        other = one.copy()
        other[: max(1, size // 10)] = rng.integers(0, 2**64, max(1, size // 10), np.uint64)
        sets += [np.unique(one), np.unique(other), np.unique(np.r_[one, rng.integers(0, 2**64, 1, np.uint64)])]
    df = spark.createDataFrame([(k, len(s), s.view(np.int64).tolist()) for k, s in enumerate(sets)], "node long, size int, shingles array<long>")
    keys = {}
    for r in jaccard.prefixes(df, (4, 5), jaccard.SHARE).collect():
        keys.setdefault(r["node"], set()).update(r["keys"])
    linked = 0
    for a, x in enumerate(sets):
        early = int(((x & np.uint64(7)) < jaccard.SHARE).sum())
        if early > len(x) // 5:
            assert all(k & 7 < jaccard.SHARE for k in keys.get(a, ()))
        for b, y in enumerate(sets[:a]):
            common = len(np.intersect1d(x, y))
            if 5 * common >= 4 * (len(x) + len(y) - common):
                linked += 1
                assert keys[a] & keys[b]
    assert linked > 50
