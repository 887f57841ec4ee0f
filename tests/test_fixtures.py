"""Hand fixtures with exact rows for the rules of each operator."""

import json
import math
import random

import pytest
from callproof.functions import calls as fc
from callproof.functions import nested
from callproof.operators import detect, expansion, flow, joins, keys, pairing, profile, routing, rules, versions
from callproof.plans import enrichment
from callproof.sources import logs, snapshots
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def stack_pairs(lines):
    out, open_ = [], {}
    for pos, api, enter in lines:
        if enter:
            open_.setdefault(api, []).append(pos)
        elif open_.get(api):
            out.append((api, open_[api].pop(), pos))
    return sorted(out, key=str)


def test_pairing_equals_a_stack(spark):
    rng = random.Random(1)
    lines = [(k, rng.choice("ab"), rng.random() < 0.5) for k in range(600)]
    lines = [(0, "a", False), *[(k + 1, a, e) for k, a, e in lines]]
    df = spark.createDataFrame(lines, "pos long, api string, is_enter boolean")
    for n in (1, 8):
        assert rows(pairing.pair_calls(df.repartition(n)), "api", "enter_pos", "exit_pos") == stack_pairs(lines)
    for stretch in (1, 7, 100):
        assert rows(pairing.pair_calls(df, stretch=stretch), "api", "enter_pos", "exit_pos") == stack_pairs(lines)


def test_calls_of_pairs(spark):
    lines = spark.createDataFrame(
        [(1, "a", True, 1.0, '["x"]', "h", None, None, None), (2, "a", False, 2.0, None, None, False, "7", ""), (3, "a", True, 3.0, "[]", "h", None, None, None), (4, "a", False, 4.0, None, None, True, "7", "boom")],
        "pos long, api string, is_enter boolean, time double, arguments string, headers string, has_error boolean, returned string, throwable string",
    )
    out = pairing.calls_of_pairs(lines, pairing.pair_calls(lines))
    assert rows(out, "enter_pos", "response_time", "has_error", "response", "throwable") == [(1, 2.0, False, "7", None), (3, 4.0, True, None, "boom")]


def test_routing(spark):
    routes = [("root", "/api"), ("long", "/api/users"), ("mid", "/api/orders/{id}/lines"), ("again", "/api/users/"), ("old", "/x")]
    catalogue = spark.createDataFrame([(a, u, k) for k, (a, u) in enumerate(routes)], "api string, url_path string, position int")
    paths = ["/api/users/7?x=1", "/api/orders/9/lines/", "/api", "/none", "/api/usersfoo", "/x/1/2"]
    flows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = routing.route_urls(flows, catalogue, keep_unmatched=True)
    got = {r["path"]: (r["api"], r["p"]) for r in kept.withColumn("p", fc.path_params(F.col("path"), F.col("prefix"))).collect()}
    assert got["/api/users/7?x=1"] == ("again", {"path_param_0": "7"})
    assert got["/api/orders/9/lines/"] == ("mid", {"path_param_0": "9", "path_param_1": "lines"})
    assert got["/api"][0] == "root" and got["/none"][0] is None and got["/api/usersfoo"][0] == "again"
    assert routing.route_urls(flows, catalogue).count() == 5
    large = routing._joined(flows, catalogue.withColumn("prefix", fc.static_prefix(F.col("url_path"))).groupBy("prefix").agg(F.max_by("api", "position").alias("api")), "path", True)
    assert {r["path"]: r["api"] for r in large.collect()} == {p: a for p, (a, _) in got.items()}
    assert routing.route_urls(flows, catalogue.limit(0), keep_unmatched=True).where("api is null").count() == 6


def scan_related(calls, pairs, tolerance=600, most=20):
    out = []
    for seq, t, api, auth in calls:
        for a, source in pairs:
            if a != api:
                continue
            earlier = sorted([c for c in calls if c[2] == source and c[1] <= t], key=lambda c: (c[1], c[0]))[-most:]
            for c in reversed(earlier):
                if c[3] == auth and t - c[1] <= tolerance:
                    out.append((seq, source, c[0]))
                    break
    return sorted(out)


def test_related_calls_equal_a_scan(spark):
    schema = "seq long, t double, api string, auth string"
    rng = random.Random(2)
    calls = [(k, rng.randrange(0, 4000) / 2, rng.choice("abc"), rng.choice(["u", "v", None])) for k in range(400)]
    pairs = [("a", "b"), ("a", "c"), ("b", "b")]
    flows = spark.createDataFrame(pairs, "api string, source_api string")
    # a call of its own API at the same time is one of the earlier ones, itself included
    got = rows(joins.asof_related_call(spark.createDataFrame(calls, schema).repartition(8), flows), "seq", "source_api", "related_seq")
    assert got == sorted(scan_related(calls, pairs), key=str)


@pytest.mark.parametrize("gap,between,match", [(0.0, 0, True), (600.0, 0, True), (600.1, 0, False), (50.0, 19, True), (50.0, 20, False)])
def test_related_call_edges(spark, gap, between, match):
    calls = [(1, 1000.0, "b", None)] + [(10 + k, 1000.0 + gap / 2, "b", "other") for k in range(between)] + [(99, 1000.0 + gap, "a", None)]
    df = spark.createDataFrame(calls, "seq long, t double, api string, auth string")
    flows = spark.createDataFrame([("a", "b")], "api string, source_api string")
    assert (rows(joins.asof_related_call(df, flows), "seq", "related_seq") == [(99, 1)]) == match


@pytest.mark.parametrize("gap,match", [(599.9, True), (600.0, False)])
def test_nearest_edges(spark, gap, match):
    df = spark.createDataFrame([(1, 1000.0, "a"), (2, 1000.0 + gap, "b"), (3, 1000.0 + 2 * gap, "a")], "seq long, t double, api string")
    assert rows(joins.nearest_event(df, "a", "b")) == [(2, 1 if match else None)]
    assert rows(joins.nearest_event(df, "a", "b", direction="after")) == [(2, 3 if match else None)]
    assert rows(joins.nearest_event(df, None, "b")) == [(2, 1 if match else None)]


def version_scan(changes, t):
    """(found, row): versions of one key as (ts, before, after)."""
    if not changes or t > max(c[0] for c in changes):
        return False, None
    cut, row = math.floor(t - 1), changes[0][1]
    for ts, _, after in changes:
        if ts < cut:
            row = after
    return True, row


def test_versions_equal_a_scan(spark):
    rng = random.Random(3)
    changes, lookups = {}, []
    pos, out = 0, []
    for pk in "abcd":
        ts, value = 100, None if pk == "a" else "start"
        changes[pk] = []
        for _ in range(rng.randint(1, 30)):
            ts += rng.randint(0, 4)
            after = None if rng.random() < 0.2 else f"v{pos}"
            changes[pk].append((ts, value, after))
            out.append((pk, pos, ts, value, after))
            value, pos = after, pos + 1
    lookups = [(k, rng.choice("abcde"), 90 + rng.randrange(0, 400) / 4) for k in range(400)]
    versions_df = versions.row_versions(spark.createDataFrame(out, "pk string, pos long, ts_s long, before string, after string"), keys=("pk",))
    got = {r["seq"]: (r["found"], r["row"]) for r in versions.version_at(spark.createDataFrame(lookups, "seq long, pk string, t double").repartition(8), versions_df, keys=("pk",)).collect()}
    assert got == {k: version_scan(changes.get(pk, []), t) for k, pk, t in lookups}


def test_overlay(spark):
    joined = spark.createDataFrame([(1, 100.0, 7, "new"), (2, 50.0, 7, "new"), (3, 20.0, 7, "new"), (4, 20.0, 8, None)], "seq long, t double, id long, `u@name` string")
    log = spark.createDataFrame([("7", 1, 40, {"name": "old"}, None), ("7", 2, 60, None, {"name": "new"}), ("8", 3, 60, {"name": "gone"}, None)], "pk string, pos long, ts_s long, before map<string,string>, after map<string,string>")
    rowsv = versions.row_versions(log, keys=("pk",))
    get = lambda missing: {r["seq"]: r["u@name"] for r in versions.overlay(joined, rowsv, pk="id", columns={"u@name": F.element_at("row", F.lit("name"))}, lookup_missing=missing).collect()}
    assert get(False) == {1: "new", 2: None, 3: "old", 4: None}
    assert get(True)[4] == "gone"


def test_change_chain_and_shards(spark):
    keys_df = spark.createDataFrame([("orders", ["id"]), ("pairs", ["a", "b"])], "`table` string, primary_keys array<string>")
    item = lambda b, a, v: [(b, a, v)]
    log = [
        (1, "insert", "db", "orders", 10, item(None, None, {"id": "1", "x": "a"})), (2, "update", "db", "orders_other", 9, item({"id": "1", "x": "b"}, {"id": "1", "x": "c"}, None)),
        (3, "update", "db", "orders", 12, item({"id": "1", "x": "c"}, {"id": "2", "x": "c"}, None)), (4, "insert", "db", "pairs", 12, item(None, None, {"a": "1", "b": "1"})), (5, "insert", "else", "orders", 12, item(None, None, {"id": "9"})),
    ]
    changes = versions.normalized_changes(spark.createDataFrame(log, logs.CHANGE_SCHEMA), keys_df, schema="db")
    assert rows(changes, "pos", "table", "pk") == [(1, "orders", "1"), (2, "orders", "1"), (3, "orders", "1")]
    text = changes.withColumns({"before": F.to_json("before"), "after": F.to_json("after")})
    assert rows(versions.validate_changes(text), "pos", "violation") == [(2, "old value differs"), (2, "time goes back"), (3, "key changed")]
    with pytest.raises(ValueError):
        versions.merge_changes(text, text)
    with pytest.raises(ValueError):
        versions.merge_tables([text, text.drop("pos")])


def test_fk_join_rules(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "seq long, k long")
    right = spark.createDataFrame([(5, "five"), (None, "none")], "id long, name string")
    assert rows(joins.fk_join(left, right, "k", "id", "r"), "seq", "`r@name`") == [(1, "five"), (2, None), (3, None)]
    with pytest.raises(ValueError):
        joins.fk_join(left, right.union(right), "k", "id", "r")
    with pytest.raises(TypeError):
        joins.fk_join(left, right, "k", "name", "r")


def test_enrichment_plan(spark):
    calls = spark.createDataFrame([(1, 10.0, "a", "u", 5, 6), (2, 5.0, "b", "u", 5, 6)], "seq long, t double, api string, auth string, k long, k2 long")
    tables = {"t": spark.createDataFrame([(5, "five"), (6, "six")], "id long, name string"), "dup": spark.createDataFrame([(5,), (5,)], "id long")}
    flows = spark.createDataFrame([("a", "b")], "api string, source_api string")
    plan = [("k", "t", "id"), ("k2", "t", "id"), ("k", "dup", "id"), ("response.x", "t", "id")]
    r = enrichment.enrich_calls(calls, tables, plan, flows, api="a").first()
    assert r["db_info"].asDict() == {"t#0": (5, "five"), "t#1": (6, "six")} and r["related"]["b"] == 2


def test_overlap_threshold_and_inclusion(spark):
    a = spark.createDataFrame([(k, str(k)) for k in range(10)] + [(None, None)], "x long, s string")
    b = spark.createDataFrame([(0,), (1,)], "y long")
    c = spark.createDataFrame([(0,), (1,), (2,)], "z long")
    values = keys.column_values({"a": a, "b": b, "c": c})
    got = {(r["from_column"], r["to_column"]): r["ratio"] for r in keys.fk_overlap(values).collect()}
    assert ("x", "y") not in got and got[("x", "z")] == 0.3 and got[("y", "x")] == 1.0 and not any("s" in k for k in got)
    related = spark.createDataFrame([("b", "a")], "from_table string, to_table string")
    assert rows(keys.fk_overlap(values, related), "from_column", "to_column") == [("y", "x")]
    assert rows(keys.inclusion_deps(values), "from_column", "to_column") == [("y", "x"), ("y", "z"), ("z", "x")]


def test_cardinalities(spark):
    df = spark.createDataFrame([(1, "a", "p", "u", ["m", "n"]), (1, "a", "q", "u", None), (2, "b", "r", "u", ["m"]), (None, "z", "z", "z", ["z"])], "k long, oo string, om string, mo string, mm array<string>")
    assert dict(rows(keys.pair_cardinality(df, "k", ["oo", "om", "mo", "mm"]))) == {"oo": "one_to_one", "om": "one_to_many", "mo": "many_to_one", "mm": "many_to_many"}


def test_expansion_of_nulls(spark):
    df = spark.sql("select array(array(1, 2), null, array()) as l, array(map('f', 1), null, map('g', cast(null as int)), map('f', cast(null as int))) as m union all select null, null")
    out = df.select(nested.array_flatten(F.col("l")).alias("f"), nested.array_exists(F.col("m"), "f").alias("e"), nested.array_len(F.col("l")).alias("n"), nested.array_idx(F.col("l"), 9).alias("i")).collect()
    assert out[0].asDict() == {"f": [1, 2, None], "e": [True, None, False, True], "n": 3, "i": None}
    assert out[1].asDict() == {"f": None, "e": None, "n": None, "i": None}


def test_expand_table_names(spark):
    df = spark.sql("select named_struct('a', 1, 'b', array(named_struct('c', 2))) as s, map('k', array(1)) as m")
    out, made = expansion.expand_table(df, array_max=1, lengths=True, keys=True)
    names = [e.name for e in made]
    assert set(names) >= {"s.a", "s.b", "s.b#length", "s.b[0]", "s.b[0].c", "s.b[].c", "m#key", "m#value", "m#value#length", "m#value[0]"} and len(set(names)) == len(names)
    assert out.first()["s.b[].c"] == [2] and "s.b[].c" in {e.name for e in made if e.uniform} and "s.b[0].c" not in {e.name for e in made if e.uniform}
    empty = expansion.compress_uniform(spark.sql("select array(1, 1) as `x[]`, array(1, 2) as `y[]` union all select null, null"), ["x[]", "y[]"])
    assert empty.columns == ["x", "y[]"] and rows(empty, "x") == [(1,), (None,)]


def kinds(spark, *texts):
    df = spark.createDataFrame([("a", "$", t) for t in texts], "api string, path string, j string").select("api", "path", F.try_parse_json("j").alias("v"))
    return profile.path_level(df).first()


@pytest.mark.parametrize("texts,kind", [(["1", "2.5e0"], "float"), (["1", '"x"'], "unknown"), (["null", "null"], "null"), (["true", "1"], "unknown"), (["[1]", "[]"], "array"), (['{"a":1}', "null"], "object"), (["true", "false"], "bool")])
def test_kinds(spark, texts, kind):
    assert kinds(spark, *texts)["kind"] == kind


@pytest.mark.parametrize("optional,required,shape", [(5, 1, "object"), (6, 1, "dict"), (0, 30, "object"), (0, 31, "dict")])
def test_object_or_map(spark, optional, required, shape):
    full = {f"r{k}": 1 for k in range(required)}
    texts = [full | {f"o{k}": 1} for k in range(optional)] + [full]
    df = spark.createDataFrame([("a", "$", str(t).replace("'", '"')) for t in texts], "api string, path string, j string").select("api", "path", F.try_parse_json("j").alias("v"))
    assert profile.object_or_map(profile.object_keys(df)).first()["kind"] == shape


def test_api_schemas_paths(spark):
    df = spark.createDataFrame([("a", '{"x": {"y": [1, {"z": "t"}]}, "n": null}'), ("a", '{"x": {"y": []}}'), ("b", "7")], "api string, j string").select("api", F.try_parse_json("j").alias("v"))
    got = {(r["api"], r["path"]): r["kind"] for r in profile.api_schemas(df).collect()}
    assert profile.schema_view(profile.api_schemas(df)).where("api = 'b'").first()["placeholder"] == "<some int value>"
    assert got == {("a", "$"): "object", ("a", "$.x"): "object", ("a", "$.n"): "null", ("a", "$.x.y"): "array", ("a", "$.x.y[]"): "unknown", ("a", "$.x.y[].z"): "str", ("b", "$"): "int"}


def test_schemas_of_any_depth(spark):
    text = '{"k":' * 12 + "[7]" + "}" * 12
    df = spark.createDataFrame([("a", text)], "api string, j string").select("api", F.try_parse_json("j").alias("v"))
    got = {r["path"]: r["kind"] for r in profile.api_schemas(df).collect()}
    assert len(got) == 14 and got["$" + ".k" * 12] == "array" and got["$" + ".k" * 12 + "[]"] == "int"
    assert profile.api_schemas(df.limit(0)).count() == 0


def test_schemas_of_odd_keys(spark):
    """Keys that look like paths stay apart, and a field is told from one that some records lack."""
    texts = ['{"a.b": 1, "a": {"b": "t"}, "x[]": 1, "x": ["t"], "m{}": null, "q\\"": 2, "": true}', '{"a": {"b": "u", "c": 1}, "x": []}']
    df = spark.createDataFrame([("a", t) for t in texts], "api string, j string").select("api", F.try_parse_json("j").alias("v"))
    out = profile.api_schemas(df).collect()
    got = {r["path"]: (r["kind"], r["always_exists"]) for r in out}
    assert len(got) == len(out) and got == {
        "$": ("object", None), '$."a.b"': ("int", False), "$.a": ("object", True), "$.a.b": ("str", True), "$.a.c": ("int", False), '$."x[]"': ("int", False), "$.x": ("array", True), "$.x[]": ("str", None),
        '$."m{}"': ("null", False), '$."q\\""': ("int", False), '$.""': ("bool", False),
    }


def brute_schema(values, max_optional, max_keys):
    """The schema of JSON values by plain recursion: path -> (kind, rows)."""
    out = {}

    def go(steps, own):
        kinds = {"null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "str" if isinstance(v, str) else "array" if isinstance(v, list) else "object" for v in own}
        known = kinds - {"null"}
        kind = "null" if not known else known.pop() if len(known) == 1 else "unknown"
        objects = [v for v in own if isinstance(v, dict)]
        keys = sorted({k for v in objects for k in v})
        is_map = len(keys) > max_keys or sum(any(k not in v for v in objects) for k in keys) > max_optional
        out[steps] = ("dict" if kind == "object" and is_map else kind, len(own))
        if items := [x for v in own if isinstance(v, list) for x in v]:
            go(steps + "[]", items)
        if is_map:
            go(steps + "{}", [x for v in objects for x in v.values()])
        else:
            for k in keys:
                go(f"{steps}.{k}", [v[k] for v in objects if k in v])

    go("$", values)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_schemas_with_maps_in_maps(spark, seed, monkeypatch):
    """Maps found only when the values of a map above are taken together, against plain recursion."""
    rnd = random.Random(seed)

    def value(depth):
        kind = rnd.choice("imoooal") if depth < 4 else "i"
        if kind == "m":
            return {f"u{rnd.randrange(60)}": value(depth + 1) for _ in range(rnd.randrange(5))}
        if kind == "o":
            return {k: value(depth + 1) for k in rnd.sample("abcd", rnd.randrange(4))}
        return [value(depth + 1) for _ in range(rnd.randrange(3))] if kind == "a" else None if kind == "l" else rnd.choice([1, "t", True])

    values = [{"m": {f"k{rnd.randrange(9)}": {"sub": {f"x{rnd.randrange(9)}": 1 for _ in range(rnd.randrange(4))}} for _ in range(3)}, "v": value(0)} for _ in range(25)]
    df = spark.createDataFrame([("a", json.dumps(v)) for v in values], "api string, j string").select("api", F.try_parse_json("j").alias("v"))
    for held in (100_000, 20):
        monkeypatch.setattr(profile, "NODES_HELD", held)
        got = {r["path"]: (r["kind"], r["rows"]) for r in profile.api_schemas(df, max_optional=2, max_keys=6).collect()}
        assert got == brute_schema(values, 2, 6)


def test_view_leaves_header_arguments_out(spark):
    df = spark.createDataFrame([("a", '{"arguments": {"headers": {"x": "1"}, "header": "2", "headerless": 3}}')], "api string, j string").select("api", F.try_parse_json("j").alias("v"))
    assert rows(profile.schema_view(profile.api_schemas(df)), "path", "placeholder") == [("$.arguments.headerless", "<some int value>")]


def test_shape_signature(spark):
    df = spark.createDataFrame([('{"b":[{"x":1},{"x":1,"y":"t"}],"a":null}',), ('{"a":true,"b":[]}',), ('[[1]]',)], "j string")
    assert [r[0] for r in df.select(profile.shape_signature("j")).collect()] == ['{"a":"null","b":[{"x":"int","y":"str"},"extra"]}', '{"a":"bool","b":[]}', '[["int"]]']


def test_trimming(spark):
    df = spark.createDataFrame([('{"a":{"b":null,"c":[1,2,3,4]},"d":[{"e":null}],"f":null}',), (None,)], "j string")
    assert [r[0] for r in df.select(profile.trimmed_json(F.col("j"))).collect()] == ['{"a":{"c":[1,2,3,"<extra list items . . .>"]},"d":[{"e":null}]}', None]


def test_profile_of_odd_columns(spark):
    df = spark.sql("select cast(null as int) as i, array(1, 2) as a, map('k', 1) as m, named_struct('x', 1) as s union all select 3, null, null, named_struct('x', 1)")
    got = {r["column"]: r.asDict() for r in profile.profile_columns(df).collect()}
    assert [(got[c]["kind"], got[c]["nulls"], got[c]["distinct"], got[c]["len_max"]) for c in "iams"] == [("int", 1, 1, None), ("array", 1, 1, 2), ("dict", 1, None, 1), ("object", 0, 1, None)]
    assert {(r["column"], r["rows"]) for r in profile.profile_columns(df.limit(0)).collect()} == {(c, 0) for c in "iams"}


def test_sharded_merge(spark):
    schema = "seq long, t double, api string, auth string, args string, data array<long>"
    calls = [
        (1, 0.0, "s", "u", "x", []), (2, 10.0, "b", "u", "x", [20]), (3, 20.0, "a", "u", "x", [30]), (4, 30.0, "b", "u", "x", [40]),  # a tie goes to the next
        (5, 100.0, "s", "u", "x", []), (6, 110.0, "b", "u", "x", [60]), (7, 165.0, "a", "u", "x", [70]), (8, 170.0, "b", "v", "x", [80]),  # the nearer is another's: fall back, 55 s
        (9, 400.0, "s", "u", "x", []), (10, 410.0, "a", "u", "x", [100]), (11, 470.0, "b", "u", "x", [110]), (12, 475.0, "a", "u", "x", [120]),  # 60 s is near enough, one append each
    ]
    df = joins.sessions(spark.createDataFrame(calls, schema), "s", bucket_s=100)
    assert [r["sid"] for r in df.orderBy("seq").collect()] == [1] * 4 + [2] * 4 + [3] * 4
    got = {r["seq"]: r["data"] for r in joins.merge_sharded_calls(df, "a", "b").collect()}
    assert got[4] == [40, 30] and got[2] == [20] and got[3] == [30, 20]
    assert got[6] == [60, 70] and got[8] == [80] and got[11] == [110, 100]


def test_windows_and_detection(spark, tmp_path):
    marks = spark.createDataFrame([(1, 10.0, detect.START + "w1"), (2, 20.0, detect.END + "w1"), (3, 12.0, detect.START + "w1"), (4, 30.0, detect.START + "lone"), (5, 31.0, "/other")], "seq long, t double, path string")
    windows = detect.marker_windows(marks)
    assert rows(windows) == [("w1", 12.0, 20.0)]
    calls = spark.createDataFrame([(k, t, "a", "x" if k == 2 else None) for k, t in ((1, 11.9), (2, 12.0), (3, 20.0), (4, 20.1))], "seq long, t double, api string, att_name string")
    inside = detect.window_calls(calls, windows)
    assert rows(inside, "seq") == [(2,), (3,)]
    marked = inside.withColumn("headers", F.when(F.col("att_name").isNotNull(), F.create_map(F.lit("X-Att-Int"), F.lit("1"), F.lit("x-att-name"), F.col("att_name")))).drop("att_name")
    found = detect.violations(marked, [rules.Rule("r", "b", F.lit(False), "no")])
    assert rows(found, "seq", "att_name", "is_attack", "detected", "rule_id") == [(2, "x", True, False, None)]
    assert rows(detect.detection_recall(found, windows)) == [(0, 1, 0.0)]
    own = [rules.Rule("r", "a", F.col("seq") < 3, "late"), rules.Rule("t", "a", None), rules.Rule("n", "a", F.lit(None).cast("boolean"), "null")]
    checks = rules.check_rules(calls, own)
    assert rows(checks.where("seq = 2"), "rule_id", "passed", "message") == [("n", False, "null"), ("r", True, None), ("t", True, None)]
    found = detect.violations(marked, own)
    assert rows(found, "seq", "rule_id", "detected") == [(2, "n", True), (2, "r", False), (2, "t", False), (3, "n", True), (3, "r", True)]
    assert rows(detect.detection_recall(found, windows)) == [(1, 1, 1.0)]
    assert rows(rules.failure_reasons(checks), "rule_id", "n_failed", "reasons") == [("n", 4, ["null"]), ("r", 2, ["late"]), ("t", 0, [])]
    logs.write_violations(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == found.count()
    assert rows(rules.gate_rules(checks), "rule_id") == [("t",)]
    with pytest.raises(ValueError):
        rules.assert_silent(checks)


def test_valid_windows(spark):
    one = {"x-att-name": "n", "x-att-idx": "1", "X-Att-Int": "i", "x-att-file": "f"}
    marks = [("one", one), ("one", {}), ("one", {"X-Att-Name": "n"}), ("one", None), ("two", one), ("two", {"X-Att-Name": "m"}), ("bad", one | {"X-Att-File": "attack_list_wrong_food.py"}), ("none", {}), ("half", {"x-att-name": "n"})]
    df = spark.createDataFrame(marks, "window_id string, headers map<string,string>")
    assert dict(rows(detect.valid_windows(df), "window_id", "valid")) == {"one": True, "two": False, "bad": False, "none": False, "half": False}
    assert dict(rows(detect.valid_windows(df, ignored_files=()), "window_id", "valid"))["bad"]
    named = df.where("window_id in ('one', 'half')").select(detect.attack_name(F.col("headers")).alias("n"), detect.is_attack(F.col("headers")).alias("a"))
    assert rows(named) == [("f", True), (None, False), (None, False), (None, False), (None, False)]


def test_next_end_of_long_groups(spark):
    rng = random.Random(5)
    marks = [(k, float(rng.randrange(400)), rng.choice(["start", "end", None]), rng.randrange(2)) for k in range(500)]
    df = spark.createDataFrame(marks, "seq long, t double, kind string, grp long")
    want = []
    for seq, t, kind, grp in marks:
        later = [m[1] for m in sorted(marks, key=lambda m: (m[1], m[0])) if m[3] == grp and m[2] == "end" and (m[1], m[0]) > (t, seq)]
        if kind == "start" and later:
            want.append((seq, later[0]))
    assert rows(detect.sequence_windows(df), "window_id", "end") == sorted(want, key=str)


def test_covering_stretches(spark):
    """Each stretch of a window is covered once, by few pieces, at any length and place."""
    rnd = random.Random(8)
    spans = [(0, 0), (-5, 3), (7, 6), (-87_600, 0), (1, 87_600), (5, 10**9 + 5)] + [(a := rnd.randrange(-300, 300), a + rnd.randrange(200)) for _ in range(60)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", detect.covering(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        pieces = [(x["place"] * detect.RADIX ** x["level"], detect.RADIX ** x["level"]) for x in r["c"]]
        assert sum(n for _, n in pieces) == max(0, r["b"] - r["a"] + 1) and len(pieces) < 100
        if r["b"] - r["a"] < 1000:
            assert sorted(k for at, n in pieces for k in range(at, at + n)) == list(range(r["a"], r["b"] + 1))


def test_windows_of_ten_years(spark):
    calls = spark.createDataFrame([(k, k * 1e7) for k in range(60)], "seq long, t double")
    windows = spark.createDataFrame([(1, 0.0, 3.2e8), (2, 5e7, 5e7), (3, 9e7, 8e7), (4, None, 1e9), (5, 1.5e7, 2.5e7)], "window_id int, start double, end double")
    got = rows(detect.window_calls(calls, windows), "window_id", "seq")
    assert got == sorted([*((1, k) for k in range(33)), (2, 5), (5, 2)], key=str)


def test_any_pair_keeps_equal_rows(spark):
    left = spark.createDataFrame([(1, 2, {"m": 1}), (1, 2, {"m": 1}), (3, 4, None), (None, 1, None), (5, None, None)], "g int, x int, m map<string,int>")
    right = spark.createDataFrame([(1, 3), (1, 1), (3, 4), (None, 9), (5, 1), (7, None)], "g int, y int")
    want = {"<": [True, True, False], "<=": [True, True, True], ">": [True, True, False], ">=": [True, True, True], "=": [False, False, True], "!=": [True, True, False]}
    for op, holds in want.items():
        assert rows(joins.any_pair_holds(left.drop("m"), right, ["g"], ("x", op, "y")), "g", "holds") == sorted([(1, holds[0]), (1, holds[1]), (3, holds[2]), (5, False), (None, False)], key=str)
    out = joins.any_pair_holds(left, right, ["g"], F.col("l.x") < F.col("r.y"))
    assert rows(out, "g", "holds") == sorted([(1, True), (1, True), (3, False), (5, False), (None, False)], key=str) and out.columns == ["g", "x", "m", "holds"]


def test_errors_stay_with_their_check(spark):
    """Errors of any kind, of functions without a form that gives null too: one failed check each, told, and no setting changed."""
    rows_in = [(1, "a", [1, 2], "x", 0), (2, "a", [5], "7", 3), (3, "a", None, None, None), (4, "a", [1, 2], "9", 5)]
    calls = spark.createDataFrame(rows_in, "seq long, api string, v array<int>, t string, k int")
    r = rules.Rule
    three = F.lit(3)
    own = [
        r("zero", "a", F.element_at("v", F.lit(0)) > 3, "z"), r("number", "a", F.to_number("t", F.lit("9")) > 8, "small"), r("fine", "a", F.col("k") >= 0, "null"),
        r("keys", "a", F.map_from_arrays(F.array("k", three), F.array(F.lit(1), F.lit(2)))[3] > 0, "m"), r("text", "a", F.expr("map(k, 1, 3, 2)[3] > 0"), "m"),
        r("entries", "a", F.map_from_entries(F.array(F.struct(F.col("k").alias("k"), F.lit(1).alias("v")), F.struct(three.alias("k"), F.lit(2).alias("v"))))[3] > 0, "m"),
        r("said", "a", F.when(F.col("k") == 3, F.raise_error(F.concat(F.lit("no "), "t"))).otherwise(F.lit(True)), "s"), r("way", "a", F.when(F.col("k") != 0, 1 / F.col("k") > 0).otherwise(F.lit(True)), "w"),
        r("cast", "a", F.col("t") > 3, "c"),
    ]
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = {(x["rule_id"], x["seq"]): (x["passed"], x["message"]) for x in rules.check_rules(calls, own).collect()}
    assert spark.conf.get("spark.sql.ansi.enabled") == before and len(got) == 36
    assert [got["zero", k][1] for k in (1, 2, 3)] == ["[INVALID_INDEX_OF_ZERO] element_at(v, 0)"] * 2 + ["z"]
    assert [got["number", k] for k in (1, 2, 3, 4)] == [(False, "[INVALID_FORMAT] to_number(t, '9')"), (False, "small"), (False, "small"), (True, None)]
    for name in ("keys", "text", "entries"):
        assert [got[name, k] for k in (1, 2, 3, 4)] == [(True, None), (False, "[DUPLICATED_MAP_KEY]"), (False, "[NULL_MAP_KEY]"), (True, None)]
    assert [got["said", k] for k in (1, 2, 3, 4)] == [(True, None), (False, "[USER_RAISED_EXCEPTION] no 7"), (True, None), (True, None)]
    assert [got["fine", k][0] for k in (1, 2, 3, 4)] == [True, True, False, True] and all(got["way", k][0] for k in (1, 2, 3, 4))
    assert [got["cast", k] for k in (1, 2, 3, 4)] == [(False, "[CAST_INVALID_INPUT] `>`(t, 3)"), (True, None), (False, "c"), (True, None)]
    pairs = spark.createDataFrame([(2, 1)], "seq long, related_seq long")
    both = rules.check_pair_rules(calls, pairs, [r("zero", "a", F.element_at("a.v", F.lit(0)) > 3, "z"), r("fine", "a", F.col("b.k") > F.col("a.k"), "f")])
    assert rows(both, "rule_id", "passed", "message") == [("fine", True, None), ("zero", False, "[INVALID_INDEX_OF_ZERO] element_at(a.v, 0)")]
    with pytest.raises(ValueError, match="transform_keys"):
        rules.check_rules(calls, [r("t", "a", F.transform_keys(F.create_map("t", "k"), lambda k, v: k)["x"] > 0, "t")])


def test_an_error_in_a_rule_is_a_failed_check(spark):
    calls = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 2, "7"), (3, "b", 0, "x")], "seq long, api string, k int, text string")
    bad = [rules.Rule("divide", "a", 1 / F.col("k") > 0, "d"), rules.Rule("cast", "a", F.col("text").cast("int") > 0, "c"), rules.Rule("place", "a", F.array("k")[F.col("k")] == 0, "p")]
    assert rows(rules.check_rules(calls, bad), "seq", "rule_id", "passed") == [(1, "cast", False), (1, "divide", False), (1, "place", True), (2, "cast", True), (2, "divide", True), (2, "place", False)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    pairs = spark.createDataFrame([(3, 1)], "seq long, related_seq long")
    assert rows(rules.check_pair_rules(calls, pairs, [rules.Rule("r", "b", 1 / F.col("a.k") > 0, "d")]), "passed", "message") == [(False, "[DIVIDE_BY_ZERO] `/`(1, a.k)")]


def test_repeated_keys_keep_the_last(spark):
    df = spark.createDataFrame([("Order(id=1, id=2, price=5) Empty()",)], "line string")
    assert [o["fields"] for o in df.select(fc.class_objects(F.col("line"))).first()[0]] == [{"id": "2", "price": "5"}, {}]
    kinds = {(k, v): df.select(fc.field_kind(F.lit(k), F.lit(v))).first()[0] for k, v in (("price", "12.5"), ("price", "12"), ("unitprice", "-3"), ("n", "+3"), ("n", ".5"), ("n", "5."), ("n", "x"))}
    assert kinds == {("price", "12.5"): "float", ("price", "12"): "str", ("unitprice", "-3"): "str", ("n", "+3"): "int", ("n", ".5"): "float", ("n", "5."): "float", ("n", "x"): "str"}
    both = F.create_map(F.lit("headers"), F.lit("1"), F.lit("httpHeaders"), F.lit("2"), F.lit("a"), F.lit("3"))
    assert df.select(fc.header_argument_renamed(both)).first()[0] == {"a": "3", "headers": "1"}


def test_json_or_text(spark):
    df = spark.createDataFrame([("[1, 2]",), ('a "b"',), ("7",), (None,)], "v string")
    assert [r[0] for r in df.select(fc.json_or_text(F.col("v"))).collect()] == ["[1,2]", '"a \\"b\\""', "7", "null"]


def test_merged_keys(spark):
    schema = "`table` string, primary_keys array<string>, all_columns array<string>"
    same = spark.createDataFrame([("orders", ["id"], ["id", "x"]), ("orders_other", ["id"], ["id", "x"]), ("user", ["u"], ["u"])], schema)
    assert rows(versions.merge_table_keys(same), "table") == [("orders",), ("user",)]
    with pytest.raises(ValueError):
        versions.merge_table_keys(spark.createDataFrame([("orders", ["id"], ["id"]), ("orders_other", ["k"], ["k"])], schema))
    whole = versions.merge_tables([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a long")])
    assert rows(whole) == [(1,), (2,)]


def test_unsure_versions(spark):
    log = spark.createDataFrame([("p", 1, 100, "a", "b"), ("p", 2, 101, "b", "c"), ("p", 3, 500, "c", "d")], "pk string, pos long, ts_s long, before string, after string")
    looked = spark.createDataFrame([(t, "p") for t in (50.0, 101.5, 101.5, 110.0, 499.5, 600.0)], "t double, pk string")
    out = versions.ambiguous_versions(looked, versions.row_versions(log, keys=("pk",)), keys=("pk",))
    assert rows(out, "t", "changes", "none_before") == [(101.5, 2, True), (50.0, 0, True)]


def test_places_of_lines_do_not_depend_on_splits(spark, tmp_path):
    """Several files, many splits: a line's place is that in all files by name; blank lines count and are dropped."""
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = [[json.dumps({"methodName": f"m{k}{j}", "isEnter": j % 2 == 0, "time": 1.0}) if j % 7 else " " for j in range(40)] for k in range(3)]
    for k, own in enumerate(texts):
        (folder / f"part-{k}.jsonl").write_text("\n".join(own) + "\n")
    want = [(at, json.loads(t)["methodName"]) for at, t in enumerate(t for own in texts for t in own) if t.strip()]
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("128m", "600b", "150b"):
            spark.conf.set(name, size)
            assert sorted(tuple(r) for r in logs.read_lines(spark, str(folder)).select("pos", "methodName").collect()) == want
    finally:
        spark.conf.set(name, before)


def test_calls_of_lines(spark, tmp_path):
    lines = [("a", True, 1.0, False, None, None), ("a", True, 2.0, False, None, None), ("a", False, 3.0, True, "x", " boom "), ("a", False, 4.0, None, " ", None), ("a", False, 5.0, False, "lost", None)]
    text = "\n".join(json.dumps({"methodName": m, "isEnter": e, "time": t, "hasError": h, "returnObj": r, "throwable": w}) for m, e, t, h, r, w in lines)
    (tmp_path / "own.jsonl").write_text(text)
    out = pairing.calls_of_lines(logs.read_lines(spark, str(tmp_path / "own.jsonl")))
    assert [tuple(r) for r in out.select("time", "response_time", "has_error", "response", "throwable").collect()] == [(1.0, 4.0, False, None, None), (2.0, 3.0, True, None, "boom")]


def test_repeated_and_missing_names(spark):
    df = spark.sql("select array('a', 'b', 'a', null) as n, array('1', '2', '3', '4', '5') as v union all select null, array('1') union all select array(), array()")
    got = df.select(fc.named_arguments(F.col("n"), F.col("v")).alias("m")).collect()
    assert sorted((r["m"] for r in got), key=str) == sorted([{"b": "2", "a": "3"}, {}, {}], key=str)


def test_shapes_of_odd_texts(spark):
    """Text that is no JSON, nulls and values of any depth have a defined result."""
    deep = "[" * 2000 + "1" + "]" * 2000
    df = spark.createDataFrame([(1, "{oops"), (2, None), (3, ""), (4, deep), (5, '{"a":[1,2]}')], "k int, t string")
    got = {r["k"]: (r["s"], r["d"]) for r in df.select("k", profile.shape_signature("t").alias("s"), profile.trimmed_json(F.col("t"), 1).alias("d")).collect()}
    assert got[1] == ('"str"', '"{oops"') and got[2] == (None, None) and got[3] == ('"str"', '""') and got[5] == ('{"a":["int","extra"]}', '{"a":[1,2]}'.replace("[1,2]", f'[1,"{profile.EXTRA}"]'))
    assert got[4][0] in ('"str"', "[" * 2000 + '"int"' + "]" * 2000) and got[4][1] in (deep, '"str"')


def test_equalities_of_many_columns(spark):
    """Classes of equal columns, nulls and zeros of either sign equal; five hundred columns are planned at once."""
    df = spark.createDataFrame([("x", 1, 1, 1, 0.0, None), ("x", 2, 2, 5, -0.0, None), ("y", 3, 3, 3, 1.0, None)], "api string, a int, b int, c int, d double, e int")
    out = rules.mine_equalities(df.withColumn("f", F.col("d") * 1).withColumn("g", F.col("e")), list("abcdefg"))
    assert rows(out, "api", "a", "b") == [("x", "a", "b"), ("x", "d", "f"), ("x", "e", "g"), ("y", "a", "b"), ("y", "a", "c"), ("y", "b", "c"), ("y", "d", "f"), ("y", "e", "g")]
    assert rules.mine_equalities(df, ["a", "c"]).where("api = 'x'").count() == 0 and rules.mine_equalities(df, ["a"]).count() == 0
    wide = spark.range(50).select(F.lit("x").alias("api"), *[(F.col("id") * (k // 2)).alias(f"c{k}") for k in range(500)])
    assert rules.mine_equalities(wide, wide.columns[1:]).count() == 250


def test_versions_of_a_busy_row(spark):
    """Stretches of any length give the versions of one window."""
    rnd = random.Random(4)
    log = [("t", rnd.choice("ab"), k, k // 3, str(k - 1), str(k)) for k in range(40)]
    df = spark.createDataFrame(log, "table string, pk string, pos long, ts_s long, before string, after string")
    want = rows(versions.row_versions(df))
    assert all(rows(versions.row_versions(df, stretch=n)) == want for n in (1, 7)) and len(want) == 42


def test_sketches_drop_only_hopeless_pairs(spark, monkeypatch):
    """Columns of many sizes and overlaps: the same pairs and numbers as without sketches, and fewer pairs joined."""
    monkeypatch.setattr(keys, "JUDGED", 64)
    rnd = random.Random(12)
    columns = {f"c{k}": [*rnd.sample(range(k % 3 * 6000, k % 3 * 6000 + 8000), rnd.choice([3, 40, 900, 4000]))] for k in range(9)} | {"all": list(range(20000))}
    df = spark.createDataFrame([("t" + c[-1], c, "int", str(v)) for c, own in columns.items() for v in own], "table string, column string, kind string, value string")
    want = {(a, b): (len(set(x) & set(y)), len(x)) for a, x in columns.items() for b, y in columns.items() if a != b}
    for threshold in (0.2, 0.9):
        likely = {(r["from_column"], r["to_column"]): r for r in keys.likely_pairs(df, threshold, size=256).collect()}
        good = {p for p, (n, size) in want.items() if n > threshold * size}
        assert good <= set(likely) and len(likely) < len(want)
        monkeypatch.setattr(keys.likely_pairs, "__kwdefaults__", {"size": 256})
        found = {(r["from_column"], r["to_column"]): (r["shared"], r["values"]) for r in keys.shared_values(df, threshold=threshold).collect()}
        assert all(found[p] == want[p] for p in good) and all(found[p] == want[p] for p in found)


@pytest.mark.parametrize("direction", ["before", "after"])
@pytest.mark.parametrize("api", ["a", None])
def test_nearest_event_on_busy_seconds(spark, direction, api):
    """Crowded and empty stretches, ties, and matches just in and out of reach, against a plain look-up."""
    rnd = random.Random(5)
    times = [rnd.choice([rnd.randrange(0, 4000) / 1.0, 100 + rnd.randrange(40) / 40, 1500.0, rnd.uniform(-50, 50)]) for _ in range(400)]
    log = [(k, t, rnd.choice("abc")) for k, t in enumerate(times)]
    sign = 1 if direction == "before" else -1
    want = []
    for seq, t, name in log:
        if name == "b":
            others = [(u * sign, k * sign, k, u) for k, u, n in log if (api is None or n == api) and (u * sign, k * sign) < (t * sign, seq * sign)]
            best = max(others, default=None)
            want.append((seq, best[2] if best and abs(best[3] - t) < 60 else None))
    df = spark.createDataFrame(log, "seq long, t double, api string")
    assert rows(joins.nearest_event(df, api, "b", direction=direction, tolerance=60)) == sorted(want, key=str)


def test_rule_files(spark, tmp_path):
    (tmp_path / "rules.jsonl").write_text('{"domain":[{"api":"a","related_fields":{"include_env":true},"quantifier":"forall"}],"premise":{"premise_position":"derive","premise_type":"true"},"predicate":{"is_true_precisely":false,"desc":"d","py_code":"x","num_args":1}}\n')
    own = logs.read_rules(spark, str(tmp_path / "rules.jsonl"))
    logs.write_rules(own, str(tmp_path / "back"))
    back = logs.read_rules(spark, str(tmp_path / "back")).first()
    assert back["domain"][0]["api"] == "a" and back["domain"][0]["related_fields"] == {"include_env": True} and back["predicate"]["num_args"] == 1


def test_pair_rules_and_python_rules(spark):
    calls = spark.createDataFrame([(1, 0.0, "a", 5), (2, 1.0, "b", 6), (3, 5000.0, "b", 9)], "seq long, t double, api string, v long")
    pairs = joins.nearest_event(calls, "a", "b")
    out = rules.check_pair_rules(calls, pairs, [rules.Rule("r", "b", F.col("b.v") > F.col("a.v"), "small")])
    assert rows(out, "seq", "passed", "message") == [(2, True, None), (3, False, "Cannot find related event")]
    tests = {"ok": ("a", lambda c: None), "no": ("a", lambda c: False), "error": ("a", lambda c: 1 // 0), "other": ("b", lambda c: True)}
    got = {(r["seq"], r["rule_id"]): (r["passed"], r["message"]) for r in rules.check_python_rules(calls, tests).collect()}
    assert got == {(1, "ok"): (True, None), (1, "no"): (False, None), (1, "error"): (False, "ZeroDivisionError: integer division or modulo by zero"), (2, "other"): (True, None), (3, "other"): (True, None)}


def test_tokens(spark):
    import base64
    import json

    pay = base64.urlsafe_b64encode(json.dumps({"id": "u1", "roles": ["ROLE_USER", "ROLE_ADMIN"]}).encode()).decode().rstrip("=")
    df = spark.createDataFrame([(f"Bearer h.{pay}.s",), (None,), ("Bearer a.b",), ("Bearer h.%%%.s",)], "h string")
    assert [tuple(r[0]) for r in df.select(fc.token_context(F.col("h"))).collect()] == [("u1", True, True), ("", False, False), ("", False, False), ("", False, False)]


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(1714671296.705,)], "t double")
    text = df.select(fc.time_text(F.col("t")).alias("x"))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert text.first()["x"] == "2024-05-02 17:34:56.705000"
            assert abs(text.select(fc.time_seconds(F.col("x"))).first()[0] - 1714671296.705) < 1e-5
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_files(spark, tmp_path):
    path = str(tmp_path / "calls")
    df = spark.createDataFrame([("2024-01-01 00:00:00.0", "a", '{"k": 1}', {"h": "1"})], "time string, api string, arguments string, headers map<string,string>")
    logs.write_calls(df, path, compression="gzip")
    assert rows(logs.read_calls(spark, path, partitions=2), "api", "arguments") == [("a", '{"k": 1}')]
    (tmp_path / "lines.json").write_text('{"methodName":"m","isEnter":true,"time":1.5,"arguments":["1"]}\n\n{"methodName":"m","isEnter":false,"time":2.5}\n')
    assert rows(logs.read_lines(spark, str(tmp_path / "lines.json")), "methodName", "isEnter") == [("m", False), ("m", True)]
    (tmp_path / "rel.json").write_text('[["a", "b", "c", "d"]]')
    assert rows(logs.read_relations(spark, str(tmp_path / "rel.json"))) == [("a", "b", "c", "d")]
    (tmp_path / "map.json").write_text('{"a": ["a", "b"], "c": []}')
    assert rows(logs.read_flow_map(spark, str(tmp_path / "map.json"))) == [("a", "b")]
    assert "t" not in snapshots.snapshot_tables({"t": df.limit(0)})


def test_flow_edges(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 1.0, "login"), (3, 2.0, "y"), (4, 3.0, "x")], "seq long, t double, api string")
    sid = joins.sessions(df, "login")
    assert rows(flow.session_lengths(sid)) == [(0, 1), (1, 3)]
    assert rows(flow.session_lengths(joins.sessions(df.where("seq > 1"), "login"))) == [(0, 0), (1, 3)]
    got = {(r["api"], r["source_api"]): r["score"] for r in flow.lookback_score(sid, rounds=2, decay=0.5).collect()}
    assert got == {("y", "login"): 1.0, ("x", "y"): 0.5, ("x", "login"): 0.25}
    assert rows(flow.encode_events(df), "seq", "code") == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_stream_checks(spark, tmp_path):
    from callproof.streaming import checks

    path = str(tmp_path / "in")
    spark.sql("select 1L as seq, 'a' as api, timestamp '2024-01-01 00:01:00' as ts, 5 as v union all select 2L, 'a', timestamp '2024-01-01 00:02:00', 50").write.parquet(path)
    stream = spark.readStream.schema("seq long, api string, ts timestamp, v int").parquet(path)
    rule = [rules.Rule("small", "a", F.col("v") < 10, "large")]
    for name, frame, mode in (("checks", checks.stream_checks(stream, rule), "append"), ("counts", checks.failure_counts(stream, rule), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert rows(spark.table("checks"), "seq", "passed") == [(1, True), (2, False)]
    assert rows(spark.table("counts"), "rule_id", "n_failed") == [("small", 1)]
