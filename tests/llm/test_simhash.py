import random

import numpy as np
import xxhash
from callproof.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, n_chars long"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper(), t]
    texts += ["", None, " \t\n", "one", "a b c", "a b c d", "x " * 20_000]
    rows = [(k * 3 % 1000 + 1, t) for k, t in enumerate(texts)] + [(None, "one"), (None, "only here"), (7, base[0]), (7, base[0])]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], SCHEMA)
    assert rows_of(simhash.near_duplicates(df)) == brute(rows)


def test_small_slices_give_the_same(spark):
    rng = random.Random(5)
    prints = list({rng.getrandbits(64) for _ in range(300)})
    for p in prints[:100]:
        prints.append(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = set()
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                want.add(frozenset((a, b)))

    def groups(pairs):
        root = {p: p for p in prints}
        for pair in pairs:
            a, b = [*pair]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[a] = b
        out = {}
        for p in prints:
            q = p
            while root[q] != q:
                q = root[q]
            out.setdefault(q, set()).add(p)
        return sorted(map(sorted, out.values()))

    for size in (7, 100_000):
        got = [{r["a"] % 2**64, r["b"] % 2**64} for r in simhash.links(df, slice_rows=size).collect()]
        assert all(frozenset(g) in want or len(g) == 2 for g in got)
        assert groups(got) == groups(want)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(80)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 81)} | {1001: 1000}


def test_keep_one_and_empty(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "other words stand here now"), (None, "nothing like it at all here")]
    df = spark.createDataFrame([(a, b, "x", len(b)) for a, b in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    rows = [
        (5, "a b c d e f"), (None, "a b c d e f"), (None, "nothing like it at all here"), (None, "and one more text without id"), (None, "and one more text without id"),
        (1, "first of two words apart"), (2, "first of two words apart"), (2, "second text of the id two stands"), (8, "second text of the id two stands"),
    ]
    df = spark.createDataFrame([(a, b, "x", len(b)) for a, b in rows], SCHEMA)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect()))
    assert got == [(0, rows[3][1]), (0, rows[2][1]), (1, rows[5][1]), (2, rows[7][1]), (5, rows[0][1])]
