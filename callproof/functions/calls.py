"""Column functions on the parts of a call: headers, arguments, paths, bodies, times, identity, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENV, QUERY = "__env__", "__query__"
#: APIs whose name differs between logs and catalogue: fixed values of the system at hand.
RENAMED = {
    "execute.service.ExecuteServiceImpl.ticketCollect": "execute.serivce.ExecuteServiceImpl.ticketCollect",
    "execute.service.ExecuteServiceImpl.ticketExecute": "execute.serivce.ExecuteServiceImpl.ticketExecute",
}
HEADER_ARGUMENTS = ("httpHeaders", "httpHeader", "headers", "header")


def prefixed(headers: Column, prefix: str) -> Column:
    """The entries whose key begins with the prefix, without it."""
    own = F.map_filter(headers, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def plain_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.startswith(k, F.lit(ENV)) & ~F.startswith(k, F.lit(QUERY)))


def last_of_each(entries: Column) -> Column:
    """Entries ``struct<key, value>`` as a map in which the last entry of a key stands."""
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def json_or_text(text: Column) -> Column:
    """A value as JSON text: the text itself if it parses, else a JSON string of it."""
    quoted = F.to_json(F.array(text))
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def named_arguments(names: Column, values: Column) -> Column:
    """Positional arguments by name; the longer of the two is cut, of a repeated name the last value stands, and one without a name is left out."""
    n = F.least(F.size(names), F.size(values))
    pairs = F.zip_with(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.when(names.isNotNull() & values.isNotNull() & (n > 0), last_of_each(F.filter(pairs, lambda e: e["key"].isNotNull()))).otherwise(F.expr("cast(map() as map<string,string>)"))


def static_prefix(path: Column) -> Column:
    """The part of a route before its first ``{parameter}``, without a slash at its end."""
    return F.rtrim(F.substring_index(path, "{", 1), F.lit("/"))


def path_values(path: Column, prefix: Column) -> Column:
    """The segments of a path after the matched prefix; query text and outer slashes are cut."""
    rest = F.substring_index(F.substring(path, F.length(prefix) + 1, F.length(path)), "?", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, "^/", ""), "/$", "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "/"))


def path_params(path: Column, prefix: Column) -> Column:
    """``path_param_i`` -> segment."""
    values = path_values(path, prefix)
    return F.map_from_entries(F.transform(values, lambda v, k: F.struct(F.concat(F.lit("path_param_"), k.cast("string")), v)))


def body_arguments(body: Column) -> Column:
    """A body that is a JSON object gives its fields, any other the one field ``body``; no body none."""
    fields = F.from_json(body, "map<string,string>")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(body)), F.lit("OBJECT")), F.lit(False))
    return F.when(is_object, fields).when(body.isNotNull() & (body != ""), F.create_map(F.lit("body"), body)).otherwise(F.expr("cast(map() as map<string,string>)"))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def time_text(seconds: Column) -> Column:
    """Epoch seconds as UTC text to the microsecond, whatever the session's zone."""
    text = F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), _epoch()).cast("string")
    rest = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
    return F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(rest, 6, "0"))


def time_seconds(text: Column) -> Column:
    """UTC text to the microsecond as epoch seconds; null where it is blank or no time."""
    return F.timestamp_diff("MICROSECOND", _epoch(), text.try_cast("timestamp_ntz")) / F.lit(1e6)


def renamed_api(api: Column, names: dict[str, str] = RENAMED) -> Column:
    """The name that the catalogue has."""
    for old, new in names.items():
        api = F.when(api == old, new).otherwise(api)
    return api


def authorization(headers: Column) -> Column:
    """The header in either case."""
    return F.coalesce(F.element_at(headers, F.lit("Authorization")), F.element_at(headers, F.lit("authorization")))


def token_context(header: Column) -> Column:
    """``struct<user_id, is_user, is_admin>`` of a bearer token's payload; anonymous where it is none."""
    parts = F.split(F.regexp_replace(header, "^Bearer ", ""), r"\.")
    middle = F.when(F.size(parts) == 3, F.translate(F.get(parts, F.lit(1)), "-_", "+/"))
    payload = F.from_json(F.try_to_binary(middle, F.lit("base64")).cast("string"), "id string, roles array<string>")
    return F.struct(
        F.coalesce(payload["id"], F.lit("")).alias("user_id"),
        F.coalesce(F.array_contains(payload["roles"], "ROLE_USER"), F.lit(False)).alias("is_user"),
        F.coalesce(F.array_contains(payload["roles"], "ROLE_ADMIN"), F.lit(False)).alias("is_admin"),
    )


def check_record(arguments: Column, response: Column, headers: Column, env: Column, fields: list[str] | None = None) -> Column:
    """A flat map ``argument.x``, ``response.x``, ``header.x``, ``env.x``; a response that is no object is ``response``.

    With ``fields``, exactly those keys, null where absent.
    """
    named = lambda m, p: F.transform_keys(F.coalesce(m, F.expr("cast(map() as map<string,string>)")), lambda k, v: F.concat(F.lit(p), k))
    inner = F.from_json(response, "map<string,string>")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(response)), F.lit("OBJECT")), F.lit(False))
    answer = F.when(is_object, named(inner, "response.")).when(response.isNotNull(), F.create_map(F.lit("response"), response)).otherwise(F.expr("cast(map() as map<string,string>)"))
    flat = F.map_concat(named(arguments, "argument."), answer, named(headers, "header."), named(env, "env."))
    if fields is None:
        return flat
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.element_at(flat, F.lit(f)) for f in fields]))


def section_text(arguments: Column, response: Column, headers: Column, env: Column, include: dict[str, bool]) -> Column:
    """JSON text of the chosen sections of a call, with keys as in ``check_record``."""
    none = F.expr("cast(map() as map<string,string>)")
    pick = lambda name, c: c if include.get(name, False) else none
    answer = response if include.get("response", False) else F.lit(None).cast("string")
    return F.to_json(check_record(pick("arguments", arguments), answer, pick("headers", headers), pick("env", env)))


def header_argument_renamed(arguments: Column) -> Column:
    """Arguments that carry headers all under the name ``headers``; of several the last of ``HEADER_ARGUMENTS`` stands."""
    rest = F.map_filter(arguments, lambda k, v: ~k.isin(*HEADER_ARGUMENTS))
    own = F.coalesce(*[F.element_at(arguments, F.lit(n)) for n in reversed(HEADER_ARGUMENTS)])
    some = F.exists(F.map_keys(arguments), lambda k: k.isin(*HEADER_ARGUMENTS))
    return F.when(some, F.map_concat(rest, F.create_map(F.lit("headers"), own))).otherwise(rest)


def execute_record(parts: dict[str, Column], include: dict[str, bool], related: dict[str, tuple[Column, dict[str, Column]]] | None = None, related_include: dict[str, bool] | None = None) -> Column:
    """JSON text of the included parts of a call, nested; parts that are null stay as null.

    ``related``: API -> whether there is a related call, and its parts, of which ``related_include`` chooses; an API
    without a related call stays as null.
    """
    chosen = [c.alias(n) for n, c in parts.items() if include.get(n, False)]
    if related is not None:
        own = lambda inner: [c.alias(n) for n, c in inner.items() if (related_include or {}).get(n, False)]
        empty = F.expr("cast(map() as map<string,string>)")
        events = [F.when(there, F.struct(*own(inner)) if own(inner) else empty).alias(api) for api, (there, inner) in related.items()]
        chosen.append((F.struct(*events) if events else empty).alias("related_events"))
    return F.to_json(F.struct(*chosen) if chosen else F.expr("cast(map() as map<string,string>)"), {"ignoreNullFields": "false"})


#: Parts of keys whose digits are text: fixed values of the legacy format.
TEXT_KEYS = ("consigneePhone", "phoneNumber", "password", "phone", "price")
#: How the legacy format writes numbers, the bearer token and the order's difference: fixed values.
DECIMAL, WHOLE = r"^[+-]?([0-9]*\.[0-9]+|[0-9]+\.[0-9]*)$", r"^[+-]?[0-9]+$"
BEARER, DIFFERENCE = r'authorization:"Bearer ([^"]+)"', r"orderMoneyDifference=([0-9]+\.[0-9]+)"


def _line_fields(line: Column) -> Column:
    """What a line says outside its objects: the bearer token and the order's difference, as entries."""
    entry = lambda key, pattern: F.struct(F.lit(key).alias("key"), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("value"))
    return F.filter(F.array(entry("orderMoneyDifference", DIFFERENCE), entry("authorization", BEARER)), lambda e: e["value"].isNotNull())


def class_objects(line: Column) -> Column:
    """``Class(k=v, …)`` objects of a legacy line: ``array<struct<class, fields map>>``.

    Of a repeated key the last value stands.  An object with fields also gets the line's token and difference.
    """
    names = F.regexp_extract_all(line, F.lit(r"([A-Z]\w*)\(([^()]*)\)"), F.lit(1))
    bodies = F.regexp_extract_all(line, F.lit(r"([A-Z]\w*)\(([^()]*)\)"), F.lit(2))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"))
    own = lambda b: F.transform(F.filter(F.split(b, r",\s*"), lambda p: F.contains(p, F.lit("="))), pair)
    fields = lambda b: F.when(F.size(own(b)) > 0, last_of_each(F.concat(own(b), _line_fields(line)))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda x: F.struct(x["n"].alias("class"), fields(x["b"]).alias("fields")))


def string_object(line: Column, name: str) -> Column:
    """The fields of a ``string name`` class: the first 36 characters of an identifier, and the line's token; null without one."""
    found = F.nullif(F.regexp_extract(line, "[0-9a-fA-F-]{36}", 0), F.lit(""))
    token = F.filter(_line_fields(line), lambda e: e["key"] == "authorization")
    return F.when(found.isNotNull(), last_of_each(F.concat(F.array(F.struct(F.lit(name).alias("key"), found.alias("value"))), token)))


def field_kind(key: Column, value: Column) -> Column:
    """What a legacy field's text becomes: float, int or str.  Decimals come first; digits stay text where the key holds one of ``TEXT_KEYS``."""
    is_text = key.rlike("|".join(TEXT_KEYS))
    return F.when(value.rlike(DECIMAL), "float").when(value.rlike(WHOLE) & ~is_text, "int").otherwise("str")


#: The layout of a legacy log line: a fixed value.
LINE = (
    r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+)\s.*?Entering in Method: (.*?), Class: (.*?), Arguments: \[(.*?)\], Request Headers: (.*?), Execution Time: (\d+) milliseconds, Return: (.*)$"
)


def log_line(line: Column) -> Column:
    """The parts of a legacy log line; null where the line has another layout."""
    part = lambda k: F.regexp_extract(line, LINE, k)
    names = ("time", "method", "class", "arguments", "headers", "millis", "returned")
    return F.when(line.rlike(LINE), F.struct(*[part(k + 1).alias(n) for k, n in enumerate(names)]))


#: How the headers of a legacy line write the authorization: a fixed value.
AUTHORIZATION = r'authorization:("|\s)(.*?)("|,)'


def declared_arguments(line: Column, declared: str) -> Column:
    """The arguments of a legacy line by a list of ``type name`` fields, as text; null where the line has another layout.

    ``authorization`` is taken from the headers and ``headers`` is all of them; the others follow the order of the
    arguments, and those without one are left out.
    """
    parts = log_line(line)
    values = F.transform(F.split(parts["arguments"], ", "), lambda v: F.regexp_replace(v, r"[\[\]]", ""))
    entries, place = [], 0
    for name in (f.split(" ")[1] for f in declared.split(", ")):
        if name == "authorization":
            value = F.try_element_at(F.regexp_extract_all(line, F.lit(AUTHORIZATION), F.lit(2)), F.lit(-1))
        elif name == "headers":
            value = parts["headers"]
        else:
            value, place = F.get(values, F.lit(place)), place + 1
        entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return F.when(parts.isNotNull(), last_of_each(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))
