"""Near-duplicate embeddings by sorted projection passes.

A pass gives every vector a key, the signs of its centred projections on random directions, and orders the vectors of a
label by it; each is compared with the next ``window`` ones. How many passes a label needs follows from its size and
from how closely its vectors lie together, so that a pair at the cosine sought is missed with a stated small chance.
Passes carry vectors as single-precision numbers with a bound of their error: pairs that the bound decides are taken,
the few others are verified in double precision. Components of the pairs then get their exact links: all vectors of a
component are compared, block by block, so that groups larger than a window lose none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_counted, tidied

#: Vectors of a block when a component, or a label too dense for passes, is compared whole.
BLOCK = 4096
BITS = 62
#: What a shuffled copy of a vector costs, in comparisons; and how often the cost of comparing a label whole its passes
#: may reach: whole comparison is kept for labels so dense that keys hardly part their vectors.
COPY, FAVOUR = 100, 4


def agreement(cosine: float, spread: float) -> float:
    """Chance that a random plane through a label's mean leaves a pair at the cosine on one side, spread being the mean
    squared distance of unit vectors from that mean."""
    inner = 1 - (1 - cosine) / max(spread, 1e-12)
    return 1 - math.acos(max(-1.0, min(1.0, inner))) / math.pi


def passes_needed(n: int, spread: float, cosine: float, window: int, missed: float) -> int:
    """Passes after which a lone pair at the cosine is missed with at most the chance given; 0 if comparing all vectors
    of the label costs less than a part (1 / FAVOUR) of that. Copies count as well as comparisons, of either way.

    A pass shows a pair if its first t signs agree, 2^t being the label's size over the window.
    """
    depth = max(0.0, math.log2(max(1.0, n / window)))
    if depth == 0:
        return 1
    shown = agreement(cosine, spread) ** depth
    if shown < 1e-12:  # a plane through the mean parts such a pair as a rule
        return 0
    passes = math.ceil(math.log(missed) / math.log1p(-shown)) if shown < 1 else 1
    whole = n / 2 + math.ceil(n / BLOCK) * COPY
    return 0 if passes * (window + COPY) > FAVOUR * whole else max(1, passes)


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    window: int = 32,
    missed: float = 0.01,
    seed: int = 1,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of table; only rows with equal, non-null labels link.

    Equal vectors of a label are one class: it takes part once and its size is added to the links. Vectors that are
    null, empty, zero, or hold null or non-finite components, and those of null labels, link with nothing; vectors of
    different lengths don't link. A null id keeps its row, unlinked. Rows of one id are different vectors, and each has
    its own links; component_id is the smallest id reached. An empty table gives no rows.
    """
    own = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    fit = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    # two hashes stand for a vector, so that rows find their class without carrying it
    hashed = own.withColumns({"fit": F.coalesce(fit, F.lit(False)), "h1": F.xxhash64("vec", F.lit(1)), "h2": F.xxhash64(F.lit(2), "vec")})
    per = hashed.where("fit").groupBy("label", "h1", "h2").agg(F.first("vec").alias("vec"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = cut(per.select(F.monotonically_increasing_id().alias("c"), "label", "h1", "h2", "vec", "low", "copies"))
    if classes.isEmpty():
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    def unit(vectors: pa.Array) -> list[np.ndarray]:
        found = [np.asarray(v.values, float) for v in vectors]
        found = [v / np.abs(v).max() for v in found]
        return [v / np.linalg.norm(v) for v in found]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number and sum of a label's unit vectors, of each length."""
        sums: dict[tuple, list] = {}
        for batch in batches:
            for label, v in zip(batch.column(0).to_pylist(), unit(batch.column(1))):
                held = sums.setdefault((label, len(v)), [0, np.zeros(len(v))])
                held[0] += 1
                held[1] += v
            if len(sums) > 1000:
                yield packed(sums)
                sums = {}
        if sums:
            yield packed(sums)

    def packed(sums: dict[tuple, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], ["label", "dim", "n", "total"])

    part = classes.select("label", "vec").mapInArrow(tidied(tally), "label string, dim int, n long, total array<double>")
    each = part.select("label", "dim", "n", F.posexplode("total").alias("k", "x")).groupBy("label", "dim", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    stats = cut(each.groupBy("label", "dim").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total")))
    placed = join_counted(classes.withColumn("dim", F.size("vec")), stats, ["label", "dim"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once a pass: its key, its numbers in single precision, and the length of their error. Vectors of
        labels that are compared whole have pass -1 and go to blocks instead. A pass's planes follow from its number, so
        none are kept; what is held is one pass over a few hundred vectors."""
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64()]
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for start in range(0, len(batch), 256):
                piece = batch.slice(start, 256)
                rows, centred, counts = [], [], []
                for c, label, dim, n, total, v in zip(*(piece.column(k).to_pylist() for k in (0, 1, 2, 4)), piece.column(5), unit(piece.column(3))):
                    mean = np.asarray(total.values, float) / n
                    counts.append(passes_needed(n, max(0.0, 1 - float(mean @ mean)), cosine, window, missed))
                    single = v.astype(np.float32)
                    rows.append((c, label, dim, n, single.tobytes(), float(np.linalg.norm(v - single.astype(float)))))
                    centred.append(v - mean)

                def batch_of(own: list[int], p: int, keys: list[int]) -> pa.RecordBatch:
                    found = [(*rows[i][:4], p, key, *rows[i][4:]) for i, key in zip(own, keys)]
                    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["c", "label", "dim", "n", "pass", "key", "half", "error"])

                if not all(counts):
                    own = [i for i, k in enumerate(counts) if not k]
                    yield batch_of(own, -1, [0] * len(own))
                for dim in sorted({r[2] for r in rows}):
                    for p in range(max(k for r, k in zip(rows, counts) if r[2] == dim)):
                        own = [i for i, (r, k) in enumerate(zip(rows, counts)) if r[2] == dim and k > p]
                        planes = np.random.default_rng([seed, dim, p]).normal(size=(dim, BITS))
                        yield batch_of(own, p, ((np.stack([centred[i] for i in own]) @ planes > 0) @ weights).tolist())

    spread = placed.select("c", "label", "dim", "vec", "n", "total").mapInArrow(tidied(project), "c long, label string, dim int, n long, pass int, key long, half binary, error double")

    def decided(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surely linked, perhaps linked) of all pairs of single-precision rows with their errors."""
        near = a @ b.T
        bound = ea[:, None] + eb[None] + ea[:, None] * eb[None] + 1e-9
        return near - bound >= cosine, near + bound >= cosine

    def pairs_of(c: np.ndarray, sure: np.ndarray, perhaps: np.ndarray, at: np.ndarray, to: np.ndarray, root: np.ndarray) -> list[tuple]:
        """Pairs (a, b, sure) that unite groups, or that are to be verified and lie in different groups so far."""
        out = []
        for i in np.flatnonzero(sure.any(1)):
            linked = to[sure[i]]
            groups, first = np.unique(root[linked], return_index=True)
            new = groups != root[at[i]]
            if new.any():
                out += [(c[at[i]], c[j], True) for j in linked[first[new]]]
                groups = np.append(groups, root[at[i]])
                root[np.isin(root, groups)] = groups.min()
        for i, j in np.argwhere(perhaps & ~sure & (root[at][:, None] != root[to][None])):
            out.append((c[at[i]], c[to[j]], False))
        return out

    edge_fields = "a long, b long, sure boolean"
    names = ["a", "b", "sure"]

    def slide(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows along rows in order; the last rows of a batch are seen again with the next, and the first and last
        rows of the task are handed on, as rows (task, place) that another task puts together."""
        from pyspark import TaskContext

        task, held, first, seen = TaskContext.get().partitionId(), None, None, 0
        fields = ["label", "dim", "pass"]
        for pdf in pdfs:
            if not len(pdf):
                continue
            if first is None or len(first) < window:
                first = pdf.head(window) if first is None else pd.concat([first, pdf.head(window - len(first))])
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            found = windows(rows, 0 if held is None else len(held))
            held, seen = rows.tail(window), seen + len(pdf)
            yield pd.DataFrame(found, columns=names).assign(boundary=-1, half=None, error=None, c=None, place=None, **{f: None for f in fields})
        if held is not None:
            ends = [held.assign(boundary=task + 1, place=np.arange(len(held))), first.assign(boundary=task, place=window + np.arange(len(first)))]
            yield pd.concat(ends).assign(a=None, b=None, sure=None)

    def windows(rows: pd.DataFrame, old: int) -> list[tuple]:
        """Pairs of rows at most window apart of which one is not among the first old."""
        c, error, out = rows["c"].to_numpy(np.int64), rows["error"].to_numpy(float), []
        group = rows.groupby(["pass", "label", "dim"], sort=False, dropna=False).ngroup().to_numpy()
        root = np.arange(len(rows))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            m = np.stack([np.frombuffer(x, np.float32) for x in rows["half"].iloc[at]]).astype(float)
            for start in range(0, len(at), window):
                i, j = np.arange(start, min(start + window, len(at))), np.arange(start, min(start + 2 * window, len(at)))
                sure, perhaps = decided(m[i], m[j], error[at[i]], error[at[j]])
                gap = j[None] - i[:, None]
                new = (gap > 0) & (gap <= window) & (at[j] >= old)[None]
                out += pairs_of(c, sure & new, perhaps & new, at[i], at[j], root)
        return out

    ordered = spread.where("pass >= 0").repartitionByRange("pass", "label", "dim", "key", "c").sortWithinPartitions("pass", "label", "dim", "key", "c")
    slid = cut(ordered.drop("key", "n").mapInPandas(slide, f"{edge_fields}, boundary long, half binary, error double, c long, place long, label string, dim int, pass int"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """Windows over the end of a task: its last rows, then the first of the next."""
        pdf = pdf.sort_values("place", ignore_index=True)
        return pd.DataFrame(windows(pdf, int((pdf["place"] < window).sum())), columns=names)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs of two blocks of a label."""
        pdf = pdf.sort_values("c", ignore_index=True)
        c, error, root, out = pdf["c"].to_numpy(np.int64), pdf["error"].to_numpy(float), np.arange(len(pdf)), []
        m = np.stack([np.frombuffer(x, np.float32) for x in pdf["half"]]).astype(float)
        everything = np.arange(len(pdf))
        for start in range(0, len(pdf), 256):
            i = everything[start : start + 256]
            sure, perhaps = decided(m[i], m, error[i], error)
            later = everything[None] > i[:, None]
            out += pairs_of(c, sure & later, perhaps & later, i, everything, root)
        return pd.DataFrame(out, columns=names)

    blocks = F.ceil(F.col("n") / BLOCK)
    dense = spread.where("pass < 0").withColumn("block", F.pmod(F.xxhash64("c"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dense = dense.select("label", "dim", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "c", "half", "error")
    found = slid.where("boundary < 0").select(*names).unionByName(slid.where("boundary >= 0").groupBy("boundary").applyInPandas(across, edge_fields))
    found = cut(found.unionByName(dense.groupBy("label", "dim", "p", "q").applyInPandas(whole, edge_fields)).distinct())

    doubtful = cut(found.where("NOT sure").select("a", "b").distinct())
    ends = cut(doubtful.select(F.col("a").alias("c")).unionByName(doubtful.select(F.col("b").alias("c"))).distinct())
    vectors = cut(join_counted(classes.select("c", "vec"), ends, "c"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [float(x @ y) >= cosine for x, y in zip(unit(batch.column(2)), unit(batch.column(3)))]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    both = doubtful.join(vectors.toDF("a", "x").hint("merge"), "a").join(vectors.toDF("b", "y").hint("merge"), "b")
    verified = both.select("a", "b", "x", "y").mapInArrow(tidied(verify), "a long, b long")
    roots = cut(components(found.where("sure").select("a", "b").unionByName(verified)).withColumnRenamed("node", "c"))

    members = join_counted(classes.select("c", "vec", "copies", "low"), roots, "c")
    size = cut(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.min("low").alias("component")))
    blocked = join_counted(members.drop("low"), size, "root").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = blocked.select("root", "block", "c", "vec", "copies", other).select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "c", "vec", "copies")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = key[1], key[2]
        pdf = pdf.sort_values("c", ignore_index=True)
        m = np.stack(pdf["vec"].to_numpy()).astype(float)
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        side, copies = pdf["block"].to_numpy(), pdf["copies"].to_numpy()
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        got = np.zeros(len(pdf), np.int64)
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            close = m[i] @ m[right].T >= cosine
            close[i[:, None] == right[None]] = False
            got[i] += close @ copies[right]
            if p != q:
                got[right] += copies[i] @ close
        return pd.DataFrame({"c": pdf["c"], "links": got})

    linked = pairs.groupBy("root", "p", "q").applyInPandas(count, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))
    lows = join_counted(roots, size.select("root", "component"), "root").select("c", "component")
    known = classes.select("c", "label", "h1", "h2", "low", "copies").join(linked.join(lows, "c"), "c", "left")
    known = cut(known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component")))
    rows = hashed.select("id", "fit", *[F.when(F.col("fit"), F.col(c)).alias(c) for c in ("label", "h1", "h2")])
    got = join_counted(rows, known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return got.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
