"""A byte-level convolutional network in numpy that scores the quality of whole documents.

Filters of four bytes slide over every byte; each chunk of 256 bytes (chunks overlap by half) keeps every filter's
maximum; the mean and the maximum over all chunks feed one logistic unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

TAPS, FILTERS, HALF = 4, 16, 128


def to_bytes(text: str | None) -> np.ndarray:
    """A text's UTF-8 bytes, padded with zero bytes to one filter's width at least; null counts as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return raw if len(raw) >= TAPS else np.concatenate([raw, np.zeros(TAPS - len(raw), np.uint8)])


class Network:
    """taps[k, byte] are the filters' weights for a byte at place k; head weighs the 2 x FILTERS pooled features."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self._pairs = None

    def params(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.head, self.shift]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The taps summed over two neighbouring bytes, for every pair of bytes."""
        if self._pairs is None:
            t = self.taps
            self._pairs = (
                (t[0][:, None] + t[1][None] + self.bias).reshape(-1, FILTERS),
                (t[2][:, None] + t[3][None]).reshape(-1, FILTERS),
            )
        return self._pairs

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def halves(self, b: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each half chunk, from the pair tables; piece by piece to bound memory."""
        first, second = self.pairs()
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        out = []
        for at in range(0, len(b) - TAPS + 1, 512 * HALF):
            p = pair[at : min(at + 512 * HALF + 2, len(pair))]
            n = len(p) - 2
            z = first[p[:n]]
            z += second[p[2 : n + 2]]
            out.append(np.maximum.reduceat(z, np.arange(0, n, HALF), axis=0))
        return np.maximum(np.concatenate(out), 0)

    def logit(self, halves: np.ndarray) -> float:
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return float(np.concatenate([chunks.mean(0), chunks.max(0)]) @ self.head + self.shift[0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.halves(to_bytes(text))), -30, 30))))

    def gradients(self, b: np.ndarray, label: int) -> tuple[list[np.ndarray], float]:
        """Of the logistic loss of one document, in the order of params()."""
        n = len(b) - TAPS + 1
        z = self.taps[0][b[:n]] + self.bias
        for k in range(1, TAPS):
            z += self.taps[k][b[k : k + n]]
        count = -(-n // HALF)
        z = np.concatenate([z, np.full((count * HALF - n, FILTERS), -np.inf, np.float32)]).reshape(count, HALF, FILTERS)
        where = z.argmax(1)
        top = np.take_along_axis(z, where[:, None], 1)[:, 0]
        where = where + np.arange(count)[:, None] * HALF
        halves = np.maximum(top, 0)
        first = np.arange(max(1, count - 1))[:, None]
        second = np.minimum(first + 1, count - 1)
        columns = np.arange(FILTERS)
        source = np.where(halves[first, columns] >= halves[second, columns], first, second)
        chunks = halves[source, columns]
        best = chunks.argmax(0)
        features = np.concatenate([chunks.mean(0), chunks.max(0)])
        logit = float(features @ self.head + self.shift[0])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        slope = np.float32(p - label)
        d = np.repeat(slope * self.head[None, :FILTERS] / len(chunks), len(chunks), 0)
        d[best, columns] += slope * self.head[FILTERS:]
        d = d * (chunks > 0)
        place = where[source, columns]
        g_taps = np.empty_like(self.taps)
        for k in range(TAPS):
            g_taps[k] = np.bincount((b[place + k].astype(np.int64) * FILTERS + columns).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        loss = float(np.logaddexp(0, logit) - label * logit)
        return [g_taps, d.sum(0), slope * features, np.array([slope])], loss


def fit(texts: list[np.ndarray], labels: list[int], shown: int = 12_000, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over the documents given, in a seeded order; deterministic. Few documents are shown more often."""
    epochs = int(np.clip(shown // max(1, len(texts)), 6, 60))
    net, rng = Network(), np.random.default_rng(seed)
    mean = [np.zeros_like(p) for p in net.params()]
    var = [np.zeros_like(p) for p in net.params()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            total = [np.zeros_like(p) for p in net.params()]
            for i in ids:
                for t, g in zip(total, net.gradients(texts[i], labels[i])[0]):
                    t += g / len(ids)
            step += 1
            now = rate * (1 - 0.8 * epoch / epochs)
            for p, g, m, v in zip(net.params(), total, mean, var):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_label: int = 1000, text_bytes: int = 1 << 17) -> Network:
    """Fit on at most rows_per_label labelled documents of each label, the first in hash order among those where
    learn (an expression over the labels' id) holds, and of each on one text of at most text_bytes bytes: of several rows
    of an id the one that comes first by a hash. So at most 2 * rows_per_label * text_bytes bytes reach the driver. The classes are drawn evenly; the head's shift is then moved by
    the log-odds of the labels over all learnable rows, so that scores keep to the real share of label 1.
    """
    usable = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    share = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(rows_per_label)
        picked = own if picked is None else picked.unionByName(own)
    ids = picked.collect()  # at most 2 x rows_per_label
    if len(share) < 2:
        net = Network()
        net.head[:] = 0
        net.shift[:] = 4.0 if 0 not in share and share else -4.0 if share else 0.0
        return net
    chosen = docs.sparkSession.createDataFrame(ids, picked.schema)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = docs.where(F.octet_length(text) <= text_bytes).select(F.col(id_col).alias("_id"), text.alias("_t"))
    found = short.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
    rows = sorted(found.collect(), key=lambda r: (r["_id"], r["_y"]))
    net = fit([to_bytes(r["_t"]) for r in rows], [r["_y"] for r in rows])
    drawn = [min(share[y], rows_per_label) for y in (0, 1)]
    net.shift += np.float32(np.log(share[1] / share[0]) - np.log(drawn[1] / drawn[0]))
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with a double column score added (a column of this name is replaced), from the whole text alone.

    Null and empty texts are scored as a run of zero bytes; repeated rows each get their score; an empty table stays
    empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())
        release()
        return found

    return docs.drop("score").withColumn("score", run(F.col(text_col).cast("string")))
