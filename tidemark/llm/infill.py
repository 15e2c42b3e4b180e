"""Fill-in-middle documents, cut through a piecewise-linear learned index of their boundaries.

A text of n units has n + 1 boundaries; their offsets grow with their rank, nearly along lines. ``boundary_index`` fits
segments to all of a text's offsets, each within ERROR code points of them, and keeps what is left at every rank in one
byte. ``offset_at`` predicts a rank's offset from its segment and adds what was left there, so it is exact. The index is
a column: a text is split once, however many cuts are drawn from it later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, tidied

#: Code points by which a segment may miss an offset; residuals take one byte.
ERROR = 100
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are left plain, and of 100 others so many get the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

INDEX = "struct<units:bigint,segments:array<struct<rank:bigint,offset:bigint,slope:double>>,residuals:binary>"
_SEGMENT = pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])
_WINDOW = 512


def boundaries(text: str) -> np.ndarray:
    """Offsets of all boundaries, 0 and the length included; a unit is a run of A-Z and a-z or any other code point."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    low = points | 0x20
    letter = (low >= 97) & (low <= 122) & (points < 128)
    inside = letter[:-1] & letter[1:]
    return np.concatenate(([0], np.flatnonzero(~inside) + 1, [len(points)] if len(points) else [])).astype(np.int64)


def predicted(offset, slope, steps):
    return offset + np.floor(slope * steps + 0.5).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(segments (rank, offset, slope), residuals): greedy, each as long as some line through its first offset stays
    within the error of all the others; residuals are what the prediction must be corrected by, at every rank."""
    segments, residuals, at, n = [], np.zeros(len(offsets), np.int64), 0, len(offsets)
    while at < n:
        stop, low, high, width = at + 1, -np.inf, np.inf, _WINDOW
        while stop < n:
            part = offsets[stop : stop + width] - offsets[at]
            steps = np.arange(stop - at, stop - at + len(part))
            lows = np.maximum(np.maximum.accumulate((part - error) / steps), low)
            highs = np.minimum(np.minimum.accumulate((part + error) / steps), high)
            broken = np.flatnonzero(lows > highs)
            good = int(broken[0]) if len(broken) else len(part)
            if good:
                low, high, stop = lows[good - 1], highs[good - 1], stop + good
            if good < len(part):
                break
            width *= 2
        slope = float((low + high) / 2) if stop - at > 1 else 0.0
        residuals[at:stop] = offsets[at:stop] - predicted(offsets[at], slope, np.arange(stop - at))
        segments.append((at, int(offsets[at]), slope))
        at = stop
    return segments, residuals


def boundary_index(docs: DataFrame, text_col: str = "text", index_col: str = "boundaries", error: int = ERROR) -> DataFrame:
    """docs with the index of every whole text's boundaries added (a column of this name is replaced).

    It holds the number of units, the segments and a signed byte for each rank. Null counts as empty: no unit, one
    boundary. Other columns pass through; repeated rows are indexed each; an empty table stays empty.
    """
    if not 0 <= error <= 126:
        raise ValueError("residuals take one byte: error must be from 0 to 126")
    kept = docs.drop(index_col)
    at, names = kept.columns.index(text_col), [*kept.columns, index_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                units, ends, flat, left = [], [0], [], []
                for text in part.column(at).to_pylist():
                    offsets = boundaries(text or "")
                    segments, residuals = fit(offsets, error)
                    units.append(len(offsets) - 1)
                    flat += segments
                    ends.append(len(flat))
                    left.append(residuals.astype(np.int8).tobytes())
                columns = [pa.array(x, t) for x, t in zip(zip(*flat), (pa.int64(), pa.int64(), pa.float64()))] if flat else [pa.array([], f.type) for f in _SEGMENT]
                segments = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SEGMENT)))
                index = pa.StructArray.from_arrays([pa.array(units, pa.int64()), segments, pa.array(left, pa.binary())], ["units", "segments", "residuals"])
                yield pa.RecordBatch.from_arrays([*part.columns, index], names)

    return kept.mapInArrow(tidied(run), f"{kept.schema.simpleString()[len('struct<') : -1]},{index_col}:{INDEX}")


def offset_at(index: Column, rank: Column) -> Column:
    """The offset of a text's boundary of a rank from 0 to its units: its segment's line, corrected by the residual."""
    segment = F.try_element_at(F.filter(index["segments"], lambda s: s["rank"] <= rank), F.lit(-1))
    byte = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    residual = F.when(byte > 127, byte - 256).otherwise(byte)
    return segment["offset"] + F.floor(segment["slope"] * (rank - segment["rank"]) + 0.5).cast("long") + residual


def draws(id_col: str, epoch: int = 1) -> list[Column]:
    """Four whole numbers below 2**32 for a document in an epoch; a null id draws as the empty text."""
    text = F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with units, form, prefix_chars, middle_chars and output added (columns of these names are replaced).

    The two cuts fall at boundaries of ranks drawn evenly from the document's id and the epoch, so reruns agree, and
    rows of one id and text get one output. form is plain where the text is empty or null, holds a mark, or is among the
    plain of 100; of the others suffix_first of 100 are spm, the rest psm. A plain text is its own output and has null
    chars. Lengths are code points. An empty table stays empty.
    """
    h = draws(id_col, epoch)
    kept = docs.drop("units", "form", "prefix_chars", "middle_chars", "output", "_index", "_form", "_h", "_cut")
    x = boundary_index(kept, text_col, "_index")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.col("_index.units")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    as_is = (n == 0) | marked | (F.pmod(F.col("_h")[2], F.lit(100)) >= 100 - plain)
    form = F.when(as_is, "plain").when(F.pmod(F.col("_h")[3], F.lit(100)) < suffix_first, "spm").otherwise("psm")
    first, second = (F.pmod(F.col("_h")[k], n + 1) for k in (0, 1))
    x = x.withColumn("_h", F.array(*h)).withColumn("_form", form)
    cuts = F.struct(*(offset_at(F.col("_index"), r).alias(a) for a, r in (("p", F.least(first, second)), ("m", F.greatest(first, second)))))
    x = x.withColumn("_cut", F.when(F.col("_form") != "plain", cuts))
    p, m = F.col("_cut.p").cast("int"), F.col("_cut.m").cast("int")
    prefix, middle = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m - p)
    suffix = F.substring(text, m + 1, F.lit(2**31 - 1) - m)
    out = F.when(F.col("_form") == "plain", text)
    out = out.when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    out = out.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return x.select(
        *kept.columns, n.alias("units"), F.col("_form").alias("form"),
        F.col("_cut.p").alias("prefix_chars"), (F.col("_cut.m") - F.col("_cut.p")).alias("middle_chars"), out.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from: its parts between the marks, in their old order.

    No part holds a mark, and no mark starts inside another or can be made up across the end of a part, so the first of
    each is the one that was put there. A null form counts as plain.
    """

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        """What lies between the leading mark a and the mark b, then up to the middle's mark, then after that."""
        rest = F.substring(output, F.lit(len(a) + 1), F.lit(2**31 - 1))
        tail = F.substring_index(rest, MIDDLE, -1)
        head = F.substring_index(rest, MIDDLE, 1)
        return F.substring_index(head, b, 1), F.substring_index(head, b, -1), tail

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    back, front, centre = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(front, centre, back)).otherwise(output)


def oracle_sql() -> str:
    """DuckDB SQL for the digests of documents: units as a list of matches, cut by slices of that list."""
    unit = "regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, {unit} AS u, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {100 - PLAIN} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
