"""Event logs as tables: lines ``ts,[object_id],LogTypes::Kind,payload...`` and what is read from them (section A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import HOT_ROWS, Scan, scan

LINE = r"^([^,]*),\[(\d+)\],LogTypes::(\w+),?(.*)$"


def parse_lines(lines: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """(keep, ts, object_id, kind, payload array) of the lines whose time is a number; other lines are left out."""
    at = lambda k: F.regexp_extract(text, LINE, k)
    x = lines.select(*keep, at(1).try_cast("double").alias("ts"), at(2).try_cast("long").alias("object_id"), at(3).alias("kind"), F.split(at(4), ",").alias("payload"))
    return x.where("ts IS NOT NULL AND kind != ''")


def read_event_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log files as lines with their file and number within it; files are read whole, line by line, in order."""
    lines = spark.read.text(paths).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("_block", "_id")))
    return parse_lines(numbered, "value", "file", "line_no")


def header(lines: DataFrame, session: str, line_no: str, text: str = "value", most: int = 40) -> DataFrame:
    """(session, level, start_time, fields map) of each log: the first and last word of its first line, and the values
    of the lines after it, at most so many, up to a blank line or one that starts with 0. ``key: value`` is one field;
    ``key:a: value,b: value`` are the two fields keya and keyb. Other lines are skipped; of a key the last value counts.
    """
    w = Window.partitionBy(session).orderBy(line_no)
    x = lines.select(session, line_no, F.col(text).alias("_t"), F.row_number().over(w).alias("_k"))
    over = F.max(((F.col("_k") > 1) & ((F.trim("_t") == "") | F.col("_t").startswith("0"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.where(F.col("_k") <= most + 1).withColumn("_over", over).where("_over = 0")
    part = F.split("_t", ":")
    middle = F.split(part[2], ",")
    field = lambda k, v: F.struct(k.alias("k"), F.trim(v).alias("v"))
    found = F.when(F.size(part) == 2, F.array(field(part[0], part[1]))).when(
        (F.size(part) == 4) & (F.size(middle) == 2), F.array(field(F.concat(part[0], part[1]), middle[0]), field(F.concat(part[0], middle[1]), part[3]))
    )
    pairs = x.where("_k > 1").select(session, line_no, F.posexplode(found).alias("_p", "f"))
    last = pairs.groupBy(session, "f.k").agg(F.max_by("f.v", F.struct(line_no, "_p")).alias("v"))
    fields = last.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
    words = F.split(F.trim("_t"), r"\s+")
    first = x.where("_k = 1").select(session, words[0].alias("level"), F.element_at(words, -1).alias("start_time"))
    return first.join(fields, session, "left")


def event_markers(log: DataFrame, session: str = "session", order: str = "line_no", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Marker rows with code and device time, and the description of the next line if that is one."""
    x = scan(log, [session], [order], hot_rows, _nk=("lead", F.col("kind")), _np=("lead", F.col("payload"))).where("kind = 'Eventmarker'")
    return x.select(session, order, "ts", F.get("payload", F.lit(0)).try_cast("long").alias("code"), F.get("payload", F.lit(1)).try_cast("double").alias("device_ts"), F.when(F.col("_nk") == "Description", F.get("_np", F.lit(0))).alias("description"))


def object_registry(log: DataFrame, session: str = "session", order: str = "line_no") -> DataFrame:
    """(session, object_id, repeat, name, start, end): lifetimes of re-used ids; an object ends one line before the
    next with its id begins, the last one is open."""
    w = Window.partitionBy(session, "object_id").orderBy(order)
    born = log.where("kind = 'Guid'")
    return born.select(session, "object_id", (F.row_number().over(w) - 1).alias("repeat"), F.get("payload", F.lit(0)).alias("name"), F.col(order).alias("start"), (F.lead(order).over(w) - 1).alias("end"))


def named_objects(log: DataFrame, name_kinds: list[str], session: str = "session", order: str = "line_no", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, object_id, repeat, type, name, start, end) of logs in which a Guid row is followed by the row that names
    its object: type is the place of that row's kind among name_kinds, name the last part of its payload. Lifetimes are
    as in ``object_registry``. A Guid row whose next row is of another object or kind is an error."""
    x = scan(log, [session], [order], hot_rows, _next=("lead", F.struct("object_id", "kind", "payload"))).where("kind = 'Guid'")
    kinds = F.array(*map(F.lit, name_kinds))
    kind = F.array_position(kinds, F.col("_next.kind")) - 1
    good = F.coalesce((F.col("_next.object_id") == F.col("object_id")) & (kind >= 0), F.lit(False))
    where = F.concat(F.lit("no naming row after the Guid row "), F.col(order).cast("string"), F.lit(" of session "), F.col(session).cast("string"))
    x = x.withColumn("type", F.when(good, kind).otherwise(F.raise_error(where).cast("long")).cast("int")).withColumn("name", F.rtrim(F.element_at("_next.payload", -1)))
    x = scan(x.select(session, "object_id", "type", "name", order), [session, "object_id"], [order], hot_rows, repeat=("before", F.lit(1)), _later=("lead", F.col(order)))
    return x.select(session, "object_id", F.col("repeat").cast("int").alias("repeat"), "type", "name", F.col(order).alias("start"), (F.col("_later") - 1).alias("end"))


def state_times(log: DataFrame, registry: DataFrame, state: str, kind: str, session: str = "session", order: str = "line_no") -> DataFrame:
    """Rows of a kind that belong to objects of a state, by the object's lifetime."""
    own = registry.where(F.col("name").startswith(state)).select(session, "object_id", "repeat", "start", F.coalesce("end", F.lit(9223372036854775807)).alias("end"))
    x = log.where(F.col("kind") == kind).join(own, [session, "object_id"]).where(F.col(order).between(F.col("start"), F.col("end")))
    return x.select(session, "object_id", "repeat", "ts", order)


def typed_params(log: DataFrame, session: str = "session", order: str = "line_no", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Header lines (names) zipped with the next line of the object (values): one typed row a parameter, in the column
    of its type: number (Float, Int), flag (Bool, written as a number or a word), vector (X=.. Y=.. Z=..), else string.
    A value line is of kind ParameterValues, or of its header's kind without "Header"; one of another type is none."""
    value_line = F.col("kind").endswith("Values") | F.col("kind").endswith("Parameter")
    x = log.where(F.col("kind").endswith("Header") | value_line)
    x = scan(x, [session, "object_id"], [order], hot_rows, _n=("lead", F.struct("payload", "kind", "ts"))).withColumns({"_v": F.col("_n.payload"), "_vk": F.col("_n.kind"), "value_ts": F.col("_n.ts")})
    own = F.col("_vk").endswith("Values") | (F.concat("_vk", F.lit("Header")) == F.col("kind"))
    x = x.where(F.col("kind").endswith("Header") & own).withColumn("type", F.regexp_extract("kind", "^(.*)ParameterHeader$", 1))
    z = x.select(session, "object_id", "value_ts", "type", F.explode(F.arrays_zip(F.col("payload").alias("name"), F.col("_v").alias("value"))).alias("p"))
    text = F.col("p.value")
    number = F.col("type").isin("Float", "Int")
    return z.select(session, "object_id", "value_ts", F.col("p.name").alias("name"), "type", F.when(number, text.try_cast("double")).alias("number"), F.when(F.col("type") == "Bool", F.coalesce(text.try_cast("long") != 0, text.try_cast("boolean"))).alias("flag"), F.when(F.col("type") == "Vector", vector(text)).alias("vector"), F.when(~F.col("type").isin("Float", "Int", "Bool", "Vector"), F.rtrim(text)).alias("string"))


def initial_only(params: DataFrame, session: str = "session") -> DataFrame:
    """The parameters that an object's first value line set."""
    w = Window.partitionBy(session, "object_id")
    return params.withColumn("_f", F.min("value_ts").over(w)).where("value_ts = _f").drop("_f")


def param_history(params: DataFrame, session: str = "session") -> DataFrame:
    """(session, object_id, name, type, history): each parameter's values over time, as an array of (ts, number, flag,
    vector, string) without those that repeat the value before."""
    w = Window.partitionBy(session, "object_id", "name", "type").orderBy("value_ts", "number", "flag", "vector", "string")
    value = F.struct("number", "flag", "vector", "string")
    changed = params.withColumn("_b", F.lag(value).over(w)).where(~F.col("_b").eqNullSafe(value))
    return changed.groupBy(session, "object_id", "name", "type").agg(F.array_sort(F.collect_list(F.struct(F.col("value_ts").alias("ts"), "number", "flag", "vector", "string"))).alias("history"))


def vector(text: Column) -> Column:
    """X, Y and Z of ``X=1 Y=2 Z=3``; a part that is no number is null."""
    part = lambda k: F.regexp_extract(text, rf"{k}=(\S+)", 1).try_cast("double")
    return F.struct(part("X").alias("x"), part("Y").alias("y"), part("Z").alias("z"))


def object_track(log: DataFrame, session: str = "session") -> DataFrame:
    """Locations with the rotations of the same object and time, in one row; either side may be missing."""
    one = lambda kind, name: log.where(F.col("kind") == kind).select(session, "object_id", "ts", vector(F.get("payload", F.lit(0))).alias(name))
    return one("Location", "location").join(one("Rotation", "rotation"), [session, "object_id", "ts"], "full_outer")


def kind_rows(log: DataFrame, kind: str, fields: list[tuple[str, str]], *keep: str) -> DataFrame:
    """Rows of one kind with their payload as typed columns (name, type)."""
    return log.where(F.col("kind") == kind).select(*keep, "ts", *[F.get("payload", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(fields)])


def lines_after(lines: DataFrame, doc: str, line_no: str, text: str, pattern: str, skip: int, n: int) -> DataFrame:
    """Lines skip to skip + n - 1 after each line that holds the pattern, with that line's number."""
    hits = lines.where(F.col(text).contains(pattern)).select(doc, F.col(line_no).alias("hit"))
    wanted = hits.select(doc, "hit", F.explode(F.sequence(F.col("hit") + skip, F.col("hit") + skip + n - 1)).alias(line_no))
    return wanted.join(lines, [doc, line_no])


def count_matches(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")
