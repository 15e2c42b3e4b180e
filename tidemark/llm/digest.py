"""Document fingerprints of improbable features.

Byte windows are ranked by how improbable they are: the entropy-coded length of a window under the corpus's own byte
pairs, in sixteenths of a bit. A window that is the most improbable within its neighbourhood is a feature; features go,
in text order, into a chain of Bloom filters, and likeness is the normalised overlap of the filters' bits.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

WINDOW, REACH = 8, 4
BITS, HASHES, FEATURES = 2048, 5, 128
#: Share of the range from a chance overlap to a full one that counts as no likeness.
CUT = 0.3
#: Least mean length of a run of neighbouring documents.
LENGTH = 1000


def surprisal(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sixteenths of a bit of each byte after each other, from the pairs of bytes of all texts.

    Tasks count pairs; 65,536 sums at most reach the driver.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for text in batch.column(0):
                b = np.frombuffer((text.as_py() or "").encode("utf-8"), np.uint8)
                if len(b) > 1:
                    sums += np.bincount(b[:-1].astype(np.uint16) << 8 | b[1:], minlength=1 << 16)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full(1 << 16, 0.5)
    counts[[r["pair"] for r in rows]] += [r["n"] for r in rows]
    counts = counts.reshape(256, 256)
    return np.minimum(np.round(-16 * np.log2(counts / counts.sum(1, keepdims=True))), 1 << 12).astype(np.int64).ravel()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def features(raw: bytes, bits: np.ndarray) -> np.ndarray:
    """Hashes of a text's features, in order, each once: windows that no window within reach exceeds in improbability,
    the first of equals. A shorter text that isn't empty is one feature."""
    b = np.frombuffer(raw, np.uint8)
    window, reach = WINDOW, REACH
    n = len(b) - window + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(raw)], np.uint64) if raw else np.empty(0, np.uint64)
    cost = np.concatenate(([0], np.cumsum(bits[b[:-1].astype(np.uint16) << 8 | b[1:]])))
    rank = (cost[window - 1 :] - cost[:n]) * (1 << 32) - np.arange(n)
    wide = 2 * reach + 1
    count = -(-(n + 2 * reach) // wide)
    padded = np.full(count * wide, -(1 << 62), np.int64)
    padded[reach : reach + n] = rank
    blocks = padded.reshape(count, wide)
    forward = np.maximum.accumulate(blocks, axis=1).ravel()
    backward = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    picked = np.flatnonzero(rank == np.maximum(backward[:n], forward[wide - 1 : wide - 1 + n]))
    held = np.zeros((len(picked), -(-window // 8) * 8), np.uint8)
    held[:, :window] = b[picked[:, None] + np.arange(window)]
    words = held.view(np.uint64)
    h = np.zeros(len(picked), np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h + words[:, k] + np.uint64(0x632BE59BD9B4E019))
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, a row of BITS booleans each, FEATURES features in each but the last."""
    chain = np.zeros((-(-len(hashes) // FEATURES), BITS), bool)
    row = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        chain[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return chain


def to_text(chain: np.ndarray, count: int) -> str:
    return f"{count}:{np.packbits(chain).tobytes().hex()}"


def from_text(fingerprint: str) -> tuple[np.ndarray, int]:
    count, bits = fingerprint.split(":")
    return np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8)).reshape(-1, BITS).astype(bool), int(count)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters of the best overlap with a filter of the other chain.

    Two empty chains are alike, an empty one is unlike all others.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    own, other = x.sum(1)[:, None], y.sum(1)[None]
    chance, full = own * other / BITS, np.minimum(own, other)
    cut = chance + CUT * (full - chance)
    score = np.clip((x @ y.T - cut) / (full - cut), 0, 1)
    return float((score.max(1) * own[:, 0]).sum() / own.sum())


def fingerprint(text: str | None, bits: np.ndarray) -> tuple[np.ndarray, str]:
    found = features((text or "").encode("utf-8"), bits)
    chain = filters(found)
    return chain, to_text(chain, len(found))


def fingerprints(docs: DataFrame, bits: np.ndarray, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text added; null counts as empty, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shared.value)[1])

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def edited_text(text: str, other: str) -> str:
    """The last third (rounded down) of a text's code points replaced by the first as many, or all, of another's."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def neighbour_likeness(docs: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, the next one by descending id (after the last: the first), and an edit that mixes the two.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each
    row of docs: null texts count as empty, null ids come last, rows of equal ids are ordered by a hash of their texts,
    a single row is its own next, an empty table gives none. Rows are dealt to runs of that order, each of which starts
    with a row drawn by hash; the runs grow with the root of the rows, in number and in length, and one id may fill any
    number of them. A run also gets the row that starts the next one. Tasks read sorted runs row by row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = docs.count()
    length = LENGTH + math.isqrt(n // 4)
    drawn = base.where(F.pmod(F.xxhash64("id", "h", F.lit(9)), F.lit(length)) == 0).select("id", "h").distinct().collect()
    lowest = base.select("id", "h").orderBy(F.col("id").desc_nulls_last(), "h").limit(1).collect()
    # descending ids as ascending keys, null last
    place = lambda own, h: (1 << 63 if own is None else -own, h)
    shared = spark.sparkContext.broadcast((sorted({place(*r) for r in [*drawn, *lowest]}), bits))

    @F.arrow_udf("array<struct<run:int,follows:boolean>>")
    def deal(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        starts, out = shared.value[0], []
        for own, h in zip(ids.to_pylist(), hashes.to_pylist()):
            key = place(own, h)
            run = bisect.bisect_right(starts, key) - 1
            out.append([{"run": run, "follows": False}] + [{"run": (run - 1) % len(starts), "follows": True}] * (starts[run] == key))
        return pa.array(out, pa.list_(pa.struct([("run", pa.int32()), ("follows", pa.bool_())])))

    dealt = base.select("id", "text", "h", F.explode(deal("id", "h")).alias("x")).select("x.run", "x.follows", "id", "h", "text")
    order = ["run", "follows", F.col("id").desc_nulls_last(), "h", "text"]
    runs = dealt.repartition("run").sortWithinPartitions(*order).drop("h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value[1]
        kinds = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        held, out = None, []

        def row(now: tuple, after: tuple) -> tuple:
            mixed = edited_text(now[2], after[2])
            chain, printed = fingerprint(mixed, bits)
            return (now[1], len(now[2]), hashlib.sha256(mixed.encode()).hexdigest(), now[4], printed, likeness(now[3], chain), likeness(now[3], after[3]))

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

        for batch in batches:
            for run, follows, own, text in zip(*batch.columns):
                run, follows = run.as_py(), follows.as_py()
                if follows and (held is None or held[0] != run):
                    continue  # the run's last row has met its next one already
                now = (run, own.as_py(), text.as_py(), *fingerprint(text.as_py(), bits))
                if held is not None:
                    out.append(row(held, now))
                held = None if follows else now
                if len(out) >= 256:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return runs.mapInArrow(tidied(compare), schema).withColumnRenamed("id", id_col)
