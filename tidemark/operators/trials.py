"""Trial tables read from event streams (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward
from .scans import HOT_ROWS, scan


def trial_number(events: DataFrame, on: list[str], order: list[str], code: str, start: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events with trial: how many start markers there are up to each row of its session."""
    return scan(events, on, order, hot_rows, trial=("upto", F.when(F.col(code) == start, 1).otherwise(0))).withColumn("trial", F.col("trial").cast("int"))


def trial_info(events: DataFrame, on: list[str], order: list[str], code: str, start: int, flags: dict[str, int], choices: list[int]) -> DataFrame:
    """One row a trial, from a start marker to before the next; the last, open one of a session is dropped. Flags tell
    whether a code occurs; choices are the first two of the listed codes."""
    x = trial_number(events, on, order, code, start).where("trial > 0")
    picked = F.array_sort(F.collect_list(F.when(F.col(code).isin(choices), F.struct(*order, code))))
    got = x.groupBy(*on, "trial").agg(
        F.min(order[0]).alias("start_time"), *[F.max(F.col(code) == c).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("events"), picked.alias("_c")
    )
    got = scan(got, on, ["trial"], _after=("lead", F.col("trial"))).where("_after IS NOT NULL").drop("_after")
    return got.select("*", F.get("_c", F.lit(0))[code].alias("first_choice"), F.get("_c", F.lit(1))[code].alias("second_choice")).drop("_c")


# Codes of the trial table and the ranges and bases that others are counted from.
BLOCKS, CONDITIONS, MORPHS, ERRORS, ERROR_DIGITS = (10, 49), (50, 99), (3400, 3500), (101, 139), (3, 7)
PLACEHOLDER, STIMULUS, DISTANCE_BASE, RIGHT_DIGIT = 3006, 3101, 10_000, 4


def trial_table(events: DataFrame, on: list[str], order: list[str], code: str, start: int, correct: int = 1, wrong: int = 2, start_at: int | None = None, end_at: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row a trial, from a start marker to the next; a session's last, open one is dropped. Times are of order's first
    column.

    correct and wrong tell whether their code occurs. error is the last error code, condition_target and morph_target the
    first of their ranges and condition_distractor and morph_distractor the last of the others, each less its base, or 0.
    placeholder_distance follows a placeholder's code; distance, side and offset stand two, three and four codes behind a
    stimulus's, the offset negative to the left; of several the last counts, but right and left hold whether any was.
    base_block is the latest block code before the start, null if there is none. With start_at or end_at a trial's times
    are those of the first such codes, and trials without both are left out. A trial's codes are held as one array, a
    session's are not.
    """
    between = lambda c, ends: F.col(c).between(*ends)
    x = scan(
        events.select(*on, *order, F.col(code).cast("long").alias("_code")), on, order, hot_rows,
        trial=("upto", (F.col("_code") == start).cast("int")), base_block=("last", F.when(between("_code", BLOCKS), F.col("_code") - BLOCKS[0])),
    ).where("trial > 0")
    place = F.struct(*order)
    first_at = lambda c: F.min(F.when(F.col("_code") == c, F.col(order[0])))
    got = x.groupBy(*on, "trial").agg(
        F.min(order[0]).alias("start_time"), F.min_by("base_block", place).alias("base_block"), F.array_sort(F.collect_list(F.struct(*order, "_code"))).alias("_rows"),
        first_at(start_at if start_at is not None else start).alias("_from"), first_at(end_at if end_at is not None else start).alias("_to"),
    )
    got = scan(got, on, ["trial"], hot_rows, end_time=("lead", F.col("start_time"))).where("end_time IS NOT NULL").withColumn("_c", F.concat(F.col("_rows._code"), F.array(F.lit(start).cast("long"))))
    if start_at is not None or end_at is not None:
        got = got.where("_from IS NOT NULL AND _to IS NOT NULL")
        got = got.withColumns({"start_time": F.col("_from"), "end_time": F.col("_to") if end_at is not None else F.col("end_time")})
    hits = lambda ends, more="": F.expr(f"filter(_c, c -> c BETWEEN {ends[0]} AND {ends[1]}{more})")
    got = got.withColumns({
        "_errors": hits(ERRORS, f" AND c % 10 BETWEEN {ERROR_DIGITS[0]} AND {ERROR_DIGITS[1]}"), "_conditions": hits(CONDITIONS), "_morphs": hits(MORPHS),
        "_at_placeholder": F.expr(f"filter(sequence(0, size(_c) - 1), i -> _c[i] = {PLACEHOLDER})"), "_at_stimulus": F.expr(f"filter(sequence(0, size(_c) - 1), i -> _c[i] = {STIMULUS})"),
    })
    last = lambda c, base: F.expr(f"coalesce(try_element_at({c}, -1) - {base}, 0)")
    others = lambda c, base: F.expr(f"CASE WHEN size({c}) > 1 THEN element_at({c}, -1) - {base} ELSE 0 END")
    behind = lambda c, k: f"get(_c, try_element_at({c}, -1) + {k})"
    right = f"get(_c, i + 3) % 10 = {RIGHT_DIGIT}"
    offset = f"{behind('_at_stimulus', 4)} - {DISTANCE_BASE}"
    return got.select(
        *on, "trial", "start_time", "end_time", F.array_contains("_c", correct).alias("correct"), F.array_contains("_c", wrong).alias("wrong"), last("_errors", ERRORS[0] - 1).alias("error"),
        F.expr(f"coalesce(get(_conditions, 0) - {CONDITIONS[0]}, 0)").alias("condition_target"),
        others("_conditions", CONDITIONS[0]).alias("condition_distractor"), F.expr(f"coalesce(get(_morphs, 0) - {MORPHS[0]}, 0)").alias("morph_target"), others("_morphs", MORPHS[0]).alias("morph_distractor"),
        F.expr(f"coalesce({behind('_at_placeholder', 1)} - {DISTANCE_BASE}, 0)").alias("placeholder_distance"), F.expr(f"coalesce({behind('_at_stimulus', 2)} - {DISTANCE_BASE}, 0)").alias("distance"),
        F.expr(f"coalesce(CASE WHEN {behind('_at_stimulus', 3)} % 10 = {RIGHT_DIGIT} THEN {offset} ELSE -({offset}) END, 0)").alias("offset"),
        F.expr(f"coalesce(exists(_at_stimulus, i -> {right}), false)").alias("right"), F.expr(f"coalesce(exists(_at_stimulus, i -> NOT ({right})), false)").alias("left"), "base_block",
    )


def trial_payloads(events: DataFrame, on: list[str], order: list[str], code: str, start: int) -> DataFrame:
    """Each trial's events as an array of (t since its first, code), in order."""
    x = trial_number(events, on, order, code, start).where("trial > 0")
    got = x.groupBy(*on, "trial").agg(F.array_sort(F.collect_list(F.struct(*order, code))).alias("_e"))
    first = F.col("_e")[0][order[0]]
    return got.select(*on, "trial", F.transform("_e", lambda e: F.struct((e[order[0]] - first).alias("t"), e[code].alias("code"))).alias("events"))


def attach_payloads(starts: DataFrame, on: list[str], trial: str, start: str, payloads: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """starts (on, trial, start) with an array a payload, by name: its rows from the trial's start to before the next
    one's, as (t since the start, columns) in order. A payload is (rows, time, columns, those of them to be counted from
    the trial's first row); a trial without rows has null."""
    got = starts
    for name, (rows, time, columns, zeroed) in payloads.items():
        own = asof_backward(rows.select(*on, time, *columns), starts.select(*on, F.col(start).alias("_start"), F.col(trial).alias("_trial")), on, time, "_start", ["_trial"])
        item = F.struct((F.col(time) - F.col("_start_found")).alias("t"), *columns)
        listed = own.where("_trial_found IS NOT NULL").groupBy(*on, F.col("_trial_found").alias(trial)).agg(F.array_sort(F.collect_list(item)).alias("_l"))
        first = F.col("_l")[0]
        moved = F.transform("_l", lambda e: F.struct(e["t"].alias("t"), *[(e[c] - first[c] if c in zeroed else e[c]).alias(c) for c in columns]))
        got = got.join(listed.select(*on, trial, moved.alias(name)), [*on, trial], "left")
    return got


def typical_bins(events: DataFrame, on: list[str], order: list[str], time: str, longest_gap: float) -> DataFrame:
    """(k, mean_time): the mean time of the k-th event since its session's first, over the sessions without a long gap
    that have the most frequent number of events (the smaller one of equals)."""
    w = Window.partitionBy(*on).orderBy(*order)
    own = Window.partitionBy(*on)
    x = events.withColumn("k", F.row_number().over(w)).withColumn("_gap", F.col(time) - F.lag(time).over(w))
    x = x.withColumn("_widest", F.max("_gap").over(own)).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_t0", F.min(time).over(own)).where(F.col("_widest") < longest_gap)
    sizes = x.where("k = 1").groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    modal = sizes.orderBy(F.col("_c").desc(), "_n").limit(1).select("_n")
    return x.join(F.broadcast(modal), "_n").groupBy("k").agg(F.avg(F.col(time) - F.col("_t0")).alias("mean_time"))


def bar_info(df: DataFrame, code: str, base: int, directions: int, parameter: str) -> DataFrame:
    """Direction of coded bars (code less base, in tenths), snapped to a grid of so many directions; rows of each and
    whether the parameter is the same in all of them."""
    step = 360 / directions
    x = df.withColumn("direction", (F.col(code) - base) / 10).withColumn("snapped", F.round(F.col("direction") / step) * step)
    return x.groupBy("direction", "snapped").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(parameter) == 1).alias("consistent"))


def paired_identity(a: Column, b: Column, pairs: dict[int, int]) -> Column:
    """"a b", a missing one filled with the other's partner."""
    both = {**pairs, **{v: k for k, v in pairs.items()}}
    partner = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    return F.concat_ws(" ", F.coalesce(a, partner[b]).cast("string"), F.coalesce(b, partner[a]).cast("string"))
