"""Windows cut into stretches against plain loops over whole keys."""

import random

import pytest
from callproof.operators import detect, flow, joins, stretches, versions
from pyspark.sql import functions as F


def log(seed, n=300, keys=(None, "a", "b")):
    rng = random.Random(seed)
    return [(k, rng.choice(keys), float(rng.randrange(0, 50_000)), rng.choice(["x", "y", None])) for k in range(n)]


@pytest.mark.parametrize("own", [True, False])
def test_carried_last(spark, own):
    rows = log(1)
    df = spark.createDataFrame(rows, "seq long, k string, t double, v string").withColumn("b", F.floor(F.col("t") / 3600))
    got = {r["seq"]: r["m"] for r in stretches.carried_last(df, ["k"], "b", ["t", "seq"], F.col("v"), "m", own=own).collect()}
    seen, want = {}, {}
    for seq, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before = seen.get(k)
        seen[k] = v if v is not None else before
        want[seq] = seen[k] if own else before
    assert got == want


@pytest.mark.parametrize("block", [3, 10, 100_000])
def test_scores_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(flow, "BLOCK", block)
    rows = [(s, k, t, v or "z") for s, k, t, v in log(2, keys=(1, 2, None))]
    df = spark.createDataFrame(rows, "seq long, sid long, t double, api string")
    sums, total, follow = {}, {}, {}
    for sid in (1, 2, None):
        apis = [r[3] for r in sorted((r for r in rows if r[1] == sid), key=lambda r: (r[2], r[0]))]
        for k, a in enumerate(apis):
            total[a] = total.get(a, 0) + 1
            for back in range(1, min(3, k) + 1):
                sums[a, apis[k - back]] = sums.get((a, apis[k - back]), 0) + 0.5 ** (back - 1)
            if k:
                follow[apis[k - 1], a] = follow.get((apis[k - 1], a), 0) + 1
    got = {(r["api"], r["source_api"]): r["score"] for r in flow.lookback_score(df).collect()}
    assert got == pytest.approx({p: s / total[p[0]] for p, s in sums.items()})
    got = {(r["i"], r["j"]): r["p"] for r in flow.transitions(df, "api").collect()}
    assert got == pytest.approx({p: n / sum(m for q, m in follow.items() if q[0] == p[0]) for p, n in follow.items()})


def test_versions_over_stretches(spark):
    rng = random.Random(3)
    vs = [("t", str(pk), v, (0 if v == 0 else v * 2900 + pk), f"{pk}-{v}", 20 * 2900 + pk) for pk in range(3) for v in range(21)]
    looks = [(k, "t", str(rng.randrange(4)), rng.uniform(0, 62_000)) for k in range(200)]
    versioned = spark.createDataFrame(vs, "table string, pk string, ver int, ts_s long, row string, last_ts_s long")
    got = {r["id"]: (r["found"], r["row"]) for r in versions.version_at(spark.createDataFrame(looks, "id long, table string, pk string, t double"), versioned).collect()}
    for k, _, pk, t in looks:
        mine = [v for v in vs if v[1] == pk]
        found = bool(mine) and t <= mine[0][5]
        past = [v for v in mine if v[2] == 0 or v[3] <= (t - 1) // 1]
        assert got[k] == ((True, past[-1][4]) if found else (False, None))


def test_next_end_over_stretches(spark):
    marks = [(g, kind, float(t), s) for s, (g, kind, t) in enumerate([("a", "start", 10), ("b", "end", 20), ("a", "start", 9000), ("a", "end", 90_000), ("b", "start", 100_000), ("a", "start", 95_000)])]
    out = detect.sequence_windows(spark.createDataFrame(marks, "grp string, kind string, t double, seq long"))
    assert sorted(tuple(r) for r in out.select("window_id", "grp", "start", "end").collect()) == [(0, "a", 10.0, 90_000.0), (2, "a", 9000.0, 90_000.0)]


def test_merge_targets_over_stretches(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(0, 4000)), 1, rng.choice("ab"), "u", rng.choice("pq")) for k in range(250)]
    df = spark.createDataFrame(rows, "seq long, t double, sid long, api string, auth string, args string")
    line = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {}
    for k, r in enumerate(line):
        if r[3] != "a":
            continue
        p = next((x for x in reversed(line[:k]) if x[3] == "b"), None)
        n = next((x for x in line[k + 1 :] if x[3] == "b"), None)
        gap = lambda x: abs(r[1] - x[1]) if x else float("inf")  # noqa: B023, E731
        for x in (p, n) if gap(p) < gap(n) else (n, p):
            if x and gap(x) <= 60 and x[5] == r[5]:
                want[x[0]] = min(want.get(x[0], r[0]), r[0])
                break
    assert {r["target_seq"]: r["source_seq"] for r in joins.merge_targets(df, "a", "b").collect()} == want


def test_window_totals(spark):
    rng = random.Random(6)
    calls = [(k, rng.choice([None, *(x / 4 for x in range(80))]) if k % 3 else 7200.5, rng.choice([1, 2, None])) for k in range(400)]
    ends = [None, -1e300, -5.0, 3.0, 3.25, 7200.5, 1e15, float("inf")]
    windows = [(k, rng.choice(ends) if k % 2 else rng.randrange(90) / 4, rng.choice(ends) if k % 3 else rng.randrange(90) / 4, rng.choice([1, 2, None])) for k in range(200)]
    windows += windows[:50]
    own, spans = spark.createDataFrame(calls, "seq long, t double, g int"), spark.createDataFrame(windows, "window_id long, start double, end double, g int")
    for on in ((), ("g",)):
        want = {}
        for w, a, b, g in windows:
            held = [s for s, t, h in calls if None not in (a, b, t) and a <= t <= b and (not on or g is not None and g == h)]
            if held:
                n, first = want.get(w, (0, held[0]))
                want[w] = (n + len(held), min(first, *held, held[0]))
        for bucket in (1.0, 3600.0):
            assert {r[0]: (r[1], r[2]) for r in detect.window_totals(own, spans, on=on, bucket=bucket).collect()} == want
    assert detect.window_totals(own.where("seq < 0"), spans).count() == detect.window_totals(own, spans.where("window_id < 0")).count() == 0


def test_window_totals_makes_no_pairs(spark):
    # 2.5 billion pairs of calls and windows
    calls = spark.range(100_000).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("t"))
    windows = spark.range(50_000).select(F.col("id").alias("window_id"), F.col("id").cast("double").alias("start"), (99_999.0 - F.col("id")).alias("end"))
    out = detect.window_totals(calls, windows)
    assert out.where("n_calls <> 100000 - 2 * window_id or first_seq <> window_id").count() == 0 and out.count() == 50_000
