"""Data sources for recordings that lie in a folder a session: event logs and trial-segmented signals.

    spark.read.format("trial_log").load(folder)        lines of folder/session=<s>/*.log
    spark.read.format("trial_signal").load(folder)     samples of folder/session=<s>/*.parquet, times by its meta.json

A session's file is a partition; of many files, some that follow each other are. Filters on session (equal, in) and on the range of a time choose files and row groups
before anything is read; Spark applies all the others. Folders are opened by pyarrow's file systems, so they must be of
a kind that these reach; tables that only Spark reads are for ``spark.read``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .eventlog import LINE

#: Bytes of a log's lines, and rows of a signal, that are parsed at once.
LINES_AT_ONCE, ROWS_AT_ONCE = 8 << 20, 1 << 16
#: Partitions beyond which files are read several at a time, and the bytes of files that are still put together.
PARTITIONS, TOGETHER = 256, 64 << 20
META = "meta.json"
LOG_SCHEMA = "session string, line_no bigint, ts double, object_id bigint, kind string, payload array<string>"
SIGNAL_SCHEMA = "session string, trial bigint, channel bigint, sample bigint, t double, value double"


class File(InputPartition):
    def __init__(self, session: str, path: str, size: int = 0):
        self.session, self.path, self.size = session, path, size
        self.more: list[File] = []


class _Reader(DataSourceReader):
    """Files of the wanted sessions, and bounds of time for what a file can leave out."""

    suffix, time = "", ""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a recording's folder is needed: load(folder)")
        self.folder = options["path"]
        self.sessions: set[str] | None = None
        self.low, self.high = -float("inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("session",) and isinstance(f, (EqualTo, In)):
                own = set(f.value) if isinstance(f, In) else {f.value}
                self.sessions = own if self.sessions is None else self.sessions & own
                continue
            if f.attribute == (self.time,) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            elif f.attribute == (self.time,) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            yield f  # bounds only leave rows out early: Spark still compares

    def partitions(self) -> list[File]:
        system, top = fs.FileSystem.from_uri(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(top, allow_not_found=False)):
            name = re.fullmatch(r"session=(.*)", info.base_name)
            session = name and unquote(name[1])
            if name and (self.sessions is None or session in self.sessions):
                found += [File(session, x.path, x.size) for x in system.get_file_info(fs.FileSelector(info.path)) if x.is_file and x.path.endswith(self.suffix)]
        found.sort(key=lambda f: f.path)
        together, each, size = [], -(-len(found) // PARTITIONS), 0
        for f in found:
            if together and len(together[-1].more) + 1 < each and size + f.size <= TOGETHER:
                together[-1].more.append(f)
                size += f.size
            else:
                together.append(f)
                size = f.size
        return together

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is wanted
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        for file in (partition, *partition.more):
            yield from self.read_file(system, file)


class LogReader(_Reader):
    suffix, time = ".log", "ts"

    def read_file(self, system: fs.FileSystem, partition: File) -> Iterator[pa.RecordBatch]:
        line = re.compile(LINE)
        with system.open_input_stream(partition.path) as f:
            number, rest = 0, b""
            while True:
                block = f.read(LINES_AT_ONCE)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                rows = []
                for raw in lines if block or lines != [b""] else []:
                    number += 1
                    m = line.match(raw.decode("utf-8", "replace").rstrip("\r"))
                    try:
                        ts = float(m[1]) if m else None
                    except ValueError:
                        continue
                    if m and self.low <= ts <= self.high:
                        rows.append((partition.session, number, ts, int(m[2]), m[3], m[4].split(",")))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in LOG_SCHEMA.split(", ")])
                if not block:
                    return


class SignalReader(_Reader):
    suffix, time = ".parquet", "t"

    def read_file(self, system: fs.FileSystem, partition: File) -> Iterator[pa.RecordBatch]:
        try:
            with system.open_input_stream(f"{partition.path.rsplit('/', 1)[0]}/{META}") as f:
                meta = json.loads(f.read())
            rate, start = float(meta["sample_rate"]), float(meta["starting_time"])
        except (FileNotFoundError, KeyError) as e:
            raise ValueError(f"session {partition.session} has no sample_rate and starting_time in its {META}") from e
        with system.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.names.index("sample")
            for k in range(file.num_row_groups):
                seen = file.metadata.row_group(k).column(at).statistics
                if seen is not None and seen.has_min_max and (start + seen.max / rate < self.low or start + seen.min / rate > self.high):
                    continue
                for batch in file.iter_batches(ROWS_AT_ONCE, [k], ["trial", "channel", "sample", "value"]):
                    trial, channel, sample = (batch.column(i).cast(pa.int64()) for i in range(3))
                    t = pc.add(pc.divide(sample.cast(pa.float64()), rate), start)
                    session = pa.array([partition.session] * len(batch), pa.string())
                    yield pa.RecordBatch.from_arrays([session, trial, channel, sample, t, batch.column(3).cast(pa.float64())], [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")])


class TrialLog(DataSource):
    """Event logs; lines that are none are counted in line_no and left out."""

    @classmethod
    def name(cls) -> str:
        return "trial_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


class TrialSignal(DataSource):
    """Signals with the time of every sample; a session without sample rate or starting time is an error."""

    @classmethod
    def name(cls) -> str:
        return "trial_signal"

    def schema(self) -> str:
        return SIGNAL_SCHEMA

    def reader(self, schema) -> SignalReader:
        return SignalReader(self.options)


def register(spark: SparkSession) -> None:
    """Both formats, with their filters pushed down, for this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrialLog)
    spark.dataSource.register(TrialSignal)


def write_log(lines: DataFrame, folder: str, session: str, order: list[str], text: str) -> None:
    """A file a session of a log's lines, in order: folder/session=<s>/*.log. Tasks write the files of their sessions
    themselves, one open at a time, so that nothing is moved or renamed after them; a task that is run again writes the
    same ones. Sessions that are null or empty have files of their own below one name, as in Spark's partitions."""
    own = lines.withColumns({"_session": F.col(session).cast("string"), "_line": F.col(text)})
    sorted_ = own.repartition("_session").sortWithinPartitions("_session", *order).select("_session", "_line")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        held, out, files = None, None, 0
        try:
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                low = 0
                for high in range(1, len(names) + 1):
                    if high < len(names) and names[high] == names[low]:
                        continue
                    if out is None or names[low] != held:
                        if out is not None:
                            out.close()
                        held, files = names[low], files + 1
                        below = f"{top}/session={quote(held, safe='') if held else '__HIVE_DEFAULT_PARTITION__'}"
                        system.create_dir(below)
                        out = system.open_output_stream(f"{below}/{'log' if held else 'null' if held is None else 'empty'}.log")
                    out.write("".join(f"{x or ''}\n" for x in texts[low:high]).encode())
                    low = high
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    system, top = fs.FileSystem.from_uri(folder)
    if system.get_file_info(top).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    system.create_dir(top)
    sorted_.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def write_signal(sig: DataFrame, folder: str, session: str, meta: DataFrame) -> None:
    """A folder a session of samples (trial, channel, sample, value), in order of sample, with its meta.json of meta's
    row (session, sample_rate, starting_time)."""
    own = sig.select(F.col(session).cast("string").alias("session"), "trial", "channel", "sample", "value")
    own.repartition("session").sortWithinPartitions("session", "sample").write.partitionBy("session").parquet(folder)
    line = F.to_json(F.struct("sample_rate", "starting_time"))
    keys = meta.select(F.col(session).cast("string").alias("session"), line.alias("line"))

    def put(rows: Iterator) -> Iterator:
        system, top = fs.FileSystem.from_uri(folder)
        for batch in rows:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_output_stream(f"{top}/session={name}/{META}") as f:
                    f.write(text.encode())
            yield batch.select(["session"])

    keys.mapInArrow(put, "session string").count()
