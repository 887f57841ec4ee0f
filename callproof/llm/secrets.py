"""Secret scans with DataFrame functions only: known forms, and windows of high entropy.

Three known forms are found by patterns.  Besides, every run of token letters of ``WINDOW`` or more is a
candidate: a window of ``WINDOW`` letters slides over it, its letter counts and ``sum(c * log2(c))`` are kept
up to date by the letter that enters and the letter that leaves, and the highest entropy met is compared with
the threshold of the candidate's character class.  Candidates on the allow-list are suppressed.

That is the narrow scan, which is also written in SQL.  The wide scan, used for masking and for the query, adds hex in either
case, letters alone and digits alone, and the allow-list takes only the part of a candidate that holds a sample.

Places are code points, end exclusive.  The pieces between the matches of a pattern give the places of the
matches, so texts are scanned whole, and nothing is shuffled.

Defined results: a null or empty text has no span; repeated rows are returned once each; a null ``doc_id`` is
kept; an empty table gives an empty result; further columns are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table, unused

#: Known forms: name, pattern, the group whose length counts, its least length.
FORMS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class, by the first pattern that fits, and the bits that a window needs; letters or digits alone never do.
CLASSES = [("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", 3.0), ("mixed", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])", 3.7), ("cased", r"^(?=.*[A-Za-z])(?=.*[0-9])", 3.5)]
#: The same classes as tests without look-ahead, for engines that have none.
CLASS_TESTS = [("^[0-9a-f]+$", "[0-9]", "[a-f]", 3.0), ("[A-Z]", "[a-z]", "[0-9]", 3.7), ("[A-Za-z]", "[0-9]", "[0-9]", 3.5)]
#: Candidates that are no secrets: identifiers in the common layout, and made-up samples.
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|1234567890|abcdefghij|0123456789abcdef"
#: Further classes of the wide scan: hex in either case, letters alone that often change case, digits alone.
WIDE = [("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0), ("letters", r"^(?=.*[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z])[A-Za-z+/_=-]+$", 3.8), ("digits", r"^[0-9]+$", 2.8)]
#: What the wide scan takes out of a candidate that is no identifier: the parts that hold a made-up sample, with their separators.
ALLOWED_PART = rf"[+/_=-]*[A-Za-z0-9]*(?:{ALLOWED.split('$|')[1]})[A-Za-z0-9]*[+/_=-]*"
MASK = "[secret]"


#: What a scan looks for, where it pays: a run is tried from its first letter only.
_RUN = {"[0-9a-f]{24,}": "(?<![0-9a-f])[0-9a-f]{24,}", CANDIDATE: "(?<![A-Za-z0-9+/_=-])" + CANDIDATE}
#: Items that running values go over in one go, and letters of a part of a text.
CHUNK, PART = 256, 4096
#: Letters whose counts share a long, and the bits of a count.
PACKED, COUNT_BITS = 12, 5


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value as a bound variable: a lambda that reads it does not make it anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, value, joined) -> Column:
    """For each item what the values of all items before it come to, from 0: ``array<bigint>``.

    It runs over chunks of items first and then within each, so no long array is copied for every item.
    """
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() as array<bigint>)")

    def walked(values: Column, at: Column) -> Column:
        step = lambda acc, v: F.struct(joined(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def in_chunks(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(CHUNK)), lambda k: F.slice(values, k, F.lit(CHUNK)))
        totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, joined))
        return F.when(F.size(values) > 0, F.flatten(F.zip_with(chunks, walked(totals, zero), walked))).otherwise(none)

    return bound(F.transform(items, value), in_chunks)


def places(text: Column, pattern: str) -> Column:
    """``array<struct<start, end>>`` of a pattern's matches, leftmost and non-overlapping."""
    pattern = _RUN.get(pattern, pattern)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(sizes: Column) -> Column:
        before = running(sizes, lambda x: x["g"] + x["m"], lambda at, n: at + n)
        return F.zip_with(sizes, before, lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["m"]).alias("end")))

    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).cast("long").alias("g"), F.char_length(m).cast("long").alias("m")))
    return bound(sizes, placed)


def highest_entropy(word: Column) -> Column:
    """The highest Shannon entropy of any window of ``WINDOW`` letters of a candidate.

    The counts of the letters in the window are kept in a few longs, ``COUNT_BITS`` bits each; the letter that enters and
    the one that leaves change them and the window's ``sum(c * log2(c))``, of which the least gives the entropy.
    """
    longs = -(-len(ALPHABET) // PACKED)
    weight = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]
    gain = F.array(*[F.lit(weight[c + 1] - weight[c]) for c in range(WINDOW + 1)])
    number = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    place = lambda k: F.struct((k / PACKED).cast("int").alias("q"), (k % PACKED * COUNT_BITS).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["e"], x["l"]

        def count(k: Column) -> Column:
            held = acc[f"n{longs - 1}"]
            for j in reversed(range(longs - 1)):
                held = F.when(k["q"] == j, acc[f"n{j}"]).otherwise(held)
            return F.call_function("shiftright", held, k["at"]).bitwiseAND(F.lit(2**COUNT_BITS - 1).cast("long")).cast("int")

        one = lambda k, j: F.when(k["q"] == j, F.call_function("shiftleft", F.lit(1).cast("long"), k["at"])).otherwise(F.lit(0).cast("long"))
        kept = [(acc[f"n{j}"] + one(enters, j) - one(leaves, j)).alias(f"n{j}") for j in range(longs)]
        lost = F.when(leaves.isNotNull(), F.get(gain, count(leaves) - 1)).otherwise(0.0)
        won = F.get(gain, count(enters) - F.when(enters == leaves, 1).otherwise(0))
        # a window is full when the next letter pushes one out of it
        return F.struct(*kept, (acc["s"] - lost + won).alias("s"), F.when(leaves.isNotNull(), F.least(acc["low"], acc["s"])).otherwise(acc["low"]).alias("low"))

    start = F.struct(*[F.lit(0).cast("long").alias(f"n{j}") for j in range(longs)], F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"))
    full = float(WINDOW)

    def walked(letters: Column) -> Column:
        pairs = F.transform(letters, lambda k, i: F.struct(k.alias("e"), F.when(i >= WINDOW, F.get(letters, i - WINDOW)).alias("l")))
        return F.aggregate(pairs, start, step, lambda acc: F.lit(math.log2(full)) - F.least(acc["low"], acc["s"]) / full)

    return bound(F.transform(number, place), walked)


def reaches(word: Column, classes: list[list[tuple[str, str, float]]]) -> Column:
    """Whether a candidate's best window reaches the threshold of its character class; of several lists, the lowest."""
    needs = []
    for own in classes:
        need = F.lit(None).cast("double")
        for _, pattern, bits in reversed(own):
            need = F.when(word.rlike(pattern), bits).otherwise(need)
        needs.append(need)
    # a hair below, so that sums kept step by step decide as sums made anew
    return bound(F.least(*needs) if len(needs) > 1 else needs[0], lambda need: F.when(need.isNotNull(), highest_entropy(word) >= need - 1e-9).otherwise(False))


def suspicious(word: Column, wide: bool) -> Column:
    """Whether a candidate is no sample and reaches its threshold; if ``wide``, so for what stands beside a sample too."""
    allowed = word.rlike(ALLOWED)
    if not wide:
        return F.when(allowed, False).otherwise(reaches(word, [CLASSES]))
    beside = F.filter(F.split(F.regexp_replace(word, ALLOWED_PART, " "), " "), lambda part: F.char_length(part) >= WINDOW)
    # an identifier has no such part, so it stays whole
    rest = F.exists(beside, lambda part: F.when(part.rlike(ALLOWED), False).otherwise(reaches(part, [CLASSES, WIDE])))
    return F.when(allowed, rest).otherwise(reaches(word, [CLASSES, WIDE]))


def _form_spans(text: Column, rank: int, none: Column) -> Column:
    """The spans of one known form; matches that are too short are dropped after matching."""
    kind, pattern, group, least = FORMS[rank]
    at = places(text, pattern)
    if group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.char_length(g))
        good = F.transform(F.filter(F.arrays_zip(at.alias("p"), sizes.alias("g")), lambda x: x["g"] >= least), lambda x: x["p"])
    else:
        good = F.filter(at, lambda p: p["end"] - p["start"] >= least)
    spans = F.transform(good, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(_RUN.get(pattern, pattern)), spans).otherwise(none)


def _number_of(rank: int) -> Column:
    return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{FORMS[rank][0]}")


def all_spans(text: Column, wide: bool) -> Column:
    """``array<struct<start, rank, end, kind>>`` of all spans, by start and then by kind as listed."""
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string>>)")
    parts = [_form_spans(text, rank, none) for rank in range(len(FORMS))]
    words = F.regexp_extract_all(text, F.lit(_RUN[CANDIDATE]), F.lit(0))
    both = F.arrays_zip(places(text, CANDIDATE).alias("p"), words.alias("w"))
    good = F.filter(both, lambda x: suspicious(x["w"], wide))
    spans = F.transform(good, lambda x: F.struct(x["p"]["start"].alias("start"), F.lit(len(FORMS)).alias("rank"), x["p"]["end"].alias("end"), F.lit(ENTROPY).alias("kind")))
    parts.append(F.when(text.rlike(_RUN[CANDIDATE]), spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", wide: bool = False) -> DataFrame:
    """The rows with all spans of their text as an array; its name gets a ``_`` where ``docs`` has it."""
    return docs.withColumn(unused(docs, spans_col), all_spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")), wide))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, wide: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, counts of the known forms, their digest, and all spans as text."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), spans_col="found", wide=wide).select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(FORMS))
    return found.select("doc_id", *map(_number_of, range(len(FORMS))), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", *, wide: bool = True) -> DataFrame:
    """The rows with every span of their text (overlapping ones together) replaced by ``MASK``.

    ``chars_col``, where there is one, is set to the new length of a changed text.
    """
    spans = unused(docs, "found_spans")
    text = F.col(text_col)
    found = with_spans(docs, text_col, spans, wide)
    own = F.col(spans)
    # pieces are cut from parts of the text, so that none is looked for from the text's beginning
    parts = F.transform(F.sequence(F.lit(0), F.char_length(text), F.lit(PART)), lambda k: F.substring(text, k + 1, F.lit(PART)))

    def piece(held: Column, a: Column, b: Column) -> Column:
        first, last = (a / PART).cast("int"), (b / PART).cast("int")
        inner = F.array_join(F.slice(held, first + 2, last - first - 1), "")
        tail = F.substring(F.get(held, first), (a % PART).cast("int") + 1, F.lit(PART))
        head = F.substring(F.get(held, last), F.lit(1), (b % PART).cast("int"))
        return F.when(first == last, F.substring(F.get(held, first), (a % PART).cast("int") + 1, (b - a).cast("int"))).otherwise(F.concat(tail, inner, F.coalesce(head, F.lit(""))))

    def cleaned(held: Column) -> Column:
        covered = running(own, lambda s: s["end"], lambda at, end: F.greatest(at, end))
        # a span that begins inside those before it has no text of its own before it
        between = F.array_compact(F.zip_with(own, covered, lambda s, at: F.when(s["start"] >= at, piece(held, at, s["start"]))))
        return F.array_join(F.array_append(between, piece(held, F.array_max(F.transform(own, lambda s: s["end"])), F.char_length(text).cast("long"))), MASK)

    clean = bound(parts, cleaned)
    hit = F.size(spans) > 0
    out = found.withColumn(text_col, F.when(hit, clean).otherwise(text))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(hit, F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.drop(spans)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), wide=True)


def _sql() -> str:
    """The same in DuckDB's SQL: every window's entropy is counted anew."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def at(pattern: str) -> str:
        return f"""list_transform(range(1, len(regexp_extract_all(text, {quote(pattern)})) + 1), lambda i:
            coalesce(list_sum(list_transform(string_split_regex(text, {quote(pattern)})[1:i], lambda g: length(g))), 0)
            + coalesce(list_sum(list_transform(regexp_extract_all(text, {quote(pattern)})[1:i - 1], lambda m: length(m))), 0))"""

    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(FORMS):
        kinds.append(f"""select row, unnest({at(pattern)}) as s, unnest(regexp_extract_all(text, {quote(pattern)})) as m, unnest(regexp_extract_all(text, {quote(pattern)}, {group})) as g, {rank} as rank, '{kind}' as kind, {least} as least from docs where regexp_matches(text, {quote(pattern)})""")
    need = "null"
    for a, b, c, bits in reversed(CLASS_TESTS):
        need = f"case when regexp_matches(m, '{a}') and regexp_matches(m, '{b}') and regexp_matches(m, '{c}') then {bits} else {need} end"
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
known as (select row, cast(s as bigint) as s, cast(s + length(m) as bigint) as e, rank, kind from ({' union all '.join(kinds)}) where length(g) >= least),
candidates as (select row, unnest({at(CANDIDATE)}) as s, unnest(regexp_extract_all(text, {quote(CANDIDATE)})) as m from docs where regexp_matches(text, {quote(CANDIDATE)})),
scored as (select row, s, m, {need} as need, list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy'))) as bits from candidates where not regexp_matches(m, {quote(ALLOWED)})),
spans as (select * from known union all select row, cast(s as bigint), cast(s + length(m) as bigint), {len(FORMS)}, '{ENTROPY}' from scored where bits >= need - 1e-9),
said as (select row, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < {len(FORMS)}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from spans group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join said using (row)
"""


OP10_SQL = _sql()
