import hashlib
import random

import pytest
from callproof.llm import periodic
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(words, least=6, periods=4):
    """Every lag by itself; a stretch that has a smaller period too is left out."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            smaller = any(all(words[k] == words[k - p] for k in range(s + p, i)) for p in range(1, q))
            if i - s >= max(least, periods * q) and not smaller:
                out.append((s, i - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7), st.integers(1, 7), st.integers(1, 40)), max_size=6)


@settings(max_examples=500, deadline=None)
@given(pieces, st.sampled_from([(6, 4), (1, 3), (3, 5)]))
def test_runs(parts, asked):
    words = [w for block, times, most in parts for w in (block * times)[:most]]
    assert sorted(periodic.found_runs(words, *asked), key=lambda r: (r[0], r[2])) == brute(words, *asked)


def test_online():
    """A run is emitted when it ends, before later ones, and a few periods are too few for the pruning."""
    words = b"x a b a b a b a b y c c c c c c c z".split()
    assert list(periodic.found_runs(words)) == [(1, 8, 2), (10, 7, 1)]
    with pytest.raises(ValueError):
        list(periodic.found_runs(words, 6, 2))


def test_long_texts():
    rnd = random.Random(3)
    block = [str(rnd.randrange(500)).encode() for _ in range(3333)]
    assert list(periodic.found_runs([b"a"] * 50_000)) == [(0, 50_000, 1)]
    assert list(periodic.found_runs(block * 12)) == [(0, 3333 * 12, 3333)]
    few = [rnd.choice([b"a", b"b"]) for _ in range(600)]
    assert sorted(periodic.found_runs(few), key=lambda r: (r[0], r[2])) == brute(few)


def test_collapsed():
    words = b"x a b a b a b a b y".split()
    assert periodic.collapsed(words, brute(words)) == b"x a b y".split()
    assert periodic.collapsed(words, []) == words


def test_operator(spark):
    """Nulls, empty texts, repeated rows, other white space, and columns with the result's names."""
    rows = [(1, None, 1), (None, "a  a  a  a \ta \na ", 2), (2, "", 3), (2, "", 3), (3, "one two", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted([(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()], key=str)
    assert got == sorted([(1, 0, [], ""), (None, 6, [(0, 6, 1)], "a "), (2, 0, [], ""), (2, 0, [], ""), (3, 2, [], "one two")], key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_longest_run(spark):
    runs = [(9, 12, 3), (3, 8, 2), (0, 6, 2), (3, 4, 1)]
    df = spark.createDataFrame([([{"start": s, "length": n, "period": q} for s, n, q in x],) for x in (runs, [])], "runs array<struct<start: long, length: long, period: long>>")
    assert [r["b"] and tuple(r["b"]) for r in df.select(periodic.longest_run(df["runs"]).alias("b")).collect()] == [(3, 4, 1), None]


def test_query(spark, sf):
    """The query's digests against the plain version, on the texts that it loops."""
    docs = periodic.table(spark, sf, "documents").selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) as h")
    want = {}
    for r in docs.collect():
        words = r["text"].encode().split()
        n, g = len(words), r["h"] // 10
        if r["h"] % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words) if n < 2000 else sorted(periodic.found_runs(words), key=lambda x: (x[0], x[2]))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want[r["doc_id"]] = (len(runs), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    got = {r["doc_id"]: (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) for r in periodic.op13_query(spark, sf).collect()}
    assert got == want
