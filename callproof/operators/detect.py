"""Windows of a log, violations in them, and what they amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .rules import Rule, verdicts
from .stretches import carried_last, joined_on

START, END = "/attack_start_marker?uuid=", "/attack_end_marker?uuid="
BUCKET_S = 3600.0


def marker_windows(flows: DataFrame, *, path: str = "path", t: str = "t") -> DataFrame:
    """``window_id, start, end`` from start and end markers with one uuid; the last of each counts, a lone one is dropped."""
    marks = flows.where(F.startswith(path, F.lit("/attack_"))).select(
        F.regexp_extract(path, r"^/attack_(start|end)_marker\?uuid=(.+)$", 1).alias("kind"), F.regexp_extract(path, r"^/attack_(start|end)_marker\?uuid=(.+)$", 2).alias("window_id"), F.col(t).alias("t"), F.col("seq")
    ).where(F.col("kind") != "")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("t")), F.when(F.col("kind") == kind, F.col("seq")))
    return marks.groupBy("window_id").agg(last("start").alias("start"), last("end").alias("end")).where(F.col("start").isNotNull() & F.col("end").isNotNull())


def sequence_windows(marks: DataFrame) -> DataFrame:
    """``marks(grp, kind, t, seq)``: each start with the next end of its group.

    Seen from the end of the log the next end is the last one before, so the frame only grows.
    """
    seen = marks.withColumns({"_t": -F.col("t"), "_seq": -F.col("seq"), "_b": F.floor(-F.col("t") / BUCKET_S)})
    return carried_last(seen, ["grp"], "_b", ["_t", "_seq"], F.when(F.col("kind") == "end", F.col("t")), "end", own=False).where((F.col("kind") == "start") & F.col("end").isNotNull()).select(F.col("seq").alias("window_id"), "grp", F.col("t").alias("start"), "end")


#: Each level of the index joins so many stretches of the one below; so many levels there are.
RADIX, LEVELS = 4, 20


def covering(first: Column, last: Column) -> Column:
    """``array<struct<level, place>>``: the largest aligned stretches that together are the stretches ``first`` to ``last``.

    Of each level at most some six, so a window of ten years is some fifty, whatever its hours.
    """
    def of(level: Column) -> Column:
        size, over = F.pow(F.lit(RADIX), level).cast("long"), F.pow(F.lit(RADIX), level + 1).cast("long")
        inside = lambda n: (F.ceil(first / n).cast("long"), F.floor((last + 1) / n).cast("long"))
        (low, high), (a, b) = inside(size), inside(over)
        places = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        found = F.when(a < b, F.concat(places(low, a * RADIX), places(b * RADIX, high))).otherwise(places(low, high))
        return F.transform(found, lambda p: F.struct(level.cast("int").alias("level"), p.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of))


def window_calls(calls: DataFrame, windows: DataFrame, *, on: tuple[str, ...] = (), bucket: float = BUCKET_S) -> DataFrame:
    """Calls with the windows that hold them, both ends included: an equi-join on stretches of time, then the exact test.

    Stretches are joined to longer ones, level by level; a window is the few largest that it is made of, and a call has one
    row for each level that any window uses, so both stay short for windows of any length.  A window that ends before it starts, or has no
    start or end, holds nothing.
    """
    place = lambda c: F.floor(F.col(c) / bucket).cast("long")
    spans = windows.where(F.col("start") <= F.col("end")).withColumn("_n", F.explode(covering(place("start"), place("end")))).withColumns({"_level": F.col("_n.level"), "_place": F.col("_n.place")}).drop("_n")
    used = F.array(*[F.lit(r["_level"]) for r in spans.select("_level").distinct().orderBy("_level").collect()]).cast("array<int>")  # LEVELS at most
    own = calls.withColumn("_level", F.explode(used)).withColumn("_place", F.floor(place("t") / F.pow(F.lit(RADIX), F.col("_level"))).cast("long"))
    return own.join(spans, ["_level", "_place", *on]).where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end"))).drop("_level", "_place")


def window_totals(calls: DataFrame, windows: DataFrame, *, on: tuple[str, ...] = (), bucket: float = BUCKET_S) -> DataFrame:
    """``window_id, n_calls, first_seq``: how many calls the windows hold, both ends included, and the least ``seq``; windows without calls are left out.

    What ``window_calls`` gives, counted without a row per call and window.  The times of calls are numbered (within stretches of
    ``bucket`` seconds, and after those before), so that a window is a range of numbers; ranges are joined to totals of aligned
    ones, level by level, and a window adds up the few largest that it is made of.
    """
    known = calls.where(F.col("t").isNotNull())
    low, high, n = known.agg(F.min("t"), F.max("t"), F.count("*")).first()
    # what lies outside the log holds nothing
    inside = windows.where((F.col("start") <= F.col("end")) & (F.col("start") <= F.lit(high)) & (F.col("end") >= F.lit(low)))
    inside = inside.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})
    times = known.groupBy(*on, "t").agg(F.count("*").alias("_calls"), F.min("seq").alias("_first")).withColumn("_side", F.lit(1))
    # of equal times a start comes before the calls and an end after them
    marks = lambda c, side: inside.select(*on, F.col(c).alias("t"), F.lit(side).alias("_side")).distinct()
    both = times.unionByName(marks("start", 0), allowMissingColumns=True).unionByName(marks("end", 2), allowMissingColumns=True)
    both = both.withColumn("_stretch", F.floor(F.col("t") / bucket).cast("long"))
    past = Window.partitionBy(*on).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy(*on, "_stretch").agg(F.count("_calls").alias("_times")).select(*on, "_stretch", F.coalesce(F.sum("_times").over(past), F.lit(0)).alias("_before"))
    line = Window.partitionBy(*on, "_stretch").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined_on(both.withColumn("_n", F.count("_calls").over(line)), before, [*on, "_stretch"])
    placed = cut(placed.select(*on, "t", "_side", "_calls", "_first", (F.col("_before") + F.col("_n")).alias("_n")))  # read three times

    levels = [k for k in range(LEVELS) if RADIX**k <= max(n, 1)]
    place = F.floor(F.col("_n") / F.pow(F.lit(RADIX), F.col("_level"))).cast("long")
    totals = placed.where("_side = 1").withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).groupBy(*on, "_level", place.alias("_place")).agg(F.sum("_calls").alias("_calls"), F.min("_first").alias("_first"))
    at = lambda c, side, name: placed.where(F.col("_side") == side).select(*on, F.col("t").alias(c), F.col("_n").alias(name))
    spans = inside.join(at("start", 0, "_from"), [*on, "start"]).join(at("end", 2, "_to"), [*on, "end"])
    spans = spans.select("window_id", *on, F.explode(covering(F.col("_from"), F.col("_to") - 1)).alias("_p")).select("window_id", *on, F.col("_p.level").alias("_level"), F.col("_p.place").alias("_place"))
    return spans.join(totals, [*on, "_level", "_place"]).groupBy("window_id").agg(F.sum("_calls").alias("n_calls"), F.min("_first").alias("first_seq"))


#: Files whose attacks are left out, and the headers of an attack in either case: fixed values of the system at hand.
IGNORED_FILES = ("attack_detail_likecollect.py", "attack_profile_information_others.py", "attack_profile_post_others.py", "attack_profile_saved_others.py", "attack_list_wrong_food.py", "attack_order_consign_wrong_date.py")
ATTACK_HEADERS = {"name": ("x-att-name", "X-Att-Name"), "idx": ("x-att-idx", "X-Att-Idx"), "int": ("x-att-int", "X-Att-Int"), "file": ("x-att-file", "X-Att-File")}


def attack_values(headers: Column, part: str) -> Column:
    """The values of one attack header, in either case: an array of none, one or two."""
    return F.array_compact(F.array(*[F.element_at(headers, F.lit(h)) for h in ATTACK_HEADERS[part]]))


def is_attack(headers: Column) -> Column:
    """Whether a call is marked as an attack: by the header of its interval."""
    return F.coalesce(F.size(attack_values(headers, "int")) > 0, F.lit(False))


def attack_name(headers: Column) -> Column:
    """The name of a marked call: its file, else its name; null for other calls."""
    return F.when(is_attack(headers), F.coalesce(F.get(attack_values(headers, "file"), F.lit(0)), F.get(attack_values(headers, "name"), F.lit(0))))


def valid_windows(calls: DataFrame, *, ignored_files: tuple[str, ...] | list[str] = IGNORED_FILES) -> DataFrame:
    """``calls(window_id, headers)`` -> per window with calls, whether it holds exactly one attack and none of an ignored file.

    One attack: one name, one index and one interval among all headers, in either case.  A set has one member where its
    least is its greatest, so no set is gathered.
    """
    def one(part: str) -> Column:
        values = attack_values(F.col("headers"), part)
        low, high = F.min(F.array_min(values)), F.max(F.array_max(values))
        return F.coalesce(low == high, F.lit(False))

    ignored = F.coalesce(F.bool_or(F.exists(attack_values(F.col("headers"), "file"), lambda f: f.isin(*ignored_files))), F.lit(False)) if ignored_files else F.lit(False)
    return calls.groupBy("window_id").agg((one("name") & one("idx") & one("int") & ~ignored).alias("valid"), F.count("*").alias("n_calls"))


def violations(calls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per failed check, and per check of an attack-marked call; marked calls of APIs without a rule are listed as missed.

    ``calls(seq, window_id, api, headers, ...)`` with all that the rules read.  Rules and marks are evaluated in one
    projection, so calls are read once and not shuffled.
    """
    marked = is_attack(F.col("headers"))
    seen = calls.select("window_id", "seq", "api", attack_name(F.col("headers")).alias("att_name"), marked.alias("is_attack"), F.explode_outer(verdicts(rules, F.col("api"), rows=calls)).alias("c"))
    detected = F.coalesce(~F.col("c.passed"), F.lit(False))
    return seen.where(detected | F.col("is_attack")).select("window_id", "seq", "api", "c.rule_id", "att_name", "is_attack", detected.alias("detected"), "c.message")


def detected_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with whether anything was detected in it."""
    hit = found.groupBy("window_id").agg(F.bool_or("detected").alias("detected"))
    return windows.select("window_id").distinct().join(hit, "window_id", "left").select("window_id", F.coalesce("detected", F.lit(False)).alias("detected"))


def detection_recall(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Detected windows, all windows and their ratio."""
    out = detected_windows(found, windows).agg(F.count_if("detected").alias("n_detected"), F.count("*").alias("n_windows"))
    return out.withColumn("recall", F.try_divide(F.col("n_detected").cast("double"), F.col("n_windows")))


def confusion(rows: DataFrame, flagged: Column, truth: Column) -> DataFrame:
    """True and false positives and negatives."""
    return rows.agg(F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & ~truth).alias("tn"), F.count_if(~flagged & truth).alias("fn"))
