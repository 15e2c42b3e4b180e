"""Language identification with error-correcting output codes over byte n-gram classifiers.

Every language has a codeword; each bit has a binary classifier that holds the log-odds of byte trigrams in the
languages whose bit is 1 against the others. Decoding weighs each bit's logistic loss by how well its classifier
separates, picks the codeword of least loss, and flags a document as ambiguous when the runner-up is near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, tidied

BUCKETS = 8192
#: Bytes as features: ASCII letters and bytes of other scripts stay, all else is a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased whole text, with a space at either end."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> 15)) * np.uint32(0x27D4EB2F)) >> np.uint32(19)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all distinct splits for up to six languages, else a random code of large distance."""
    if n <= 6:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code[:, None] != code[None]).sum(2)[np.triu_indices(n, 1)].min()
        if d > far:
            best, far = code, d
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    bit_weight: np.ndarray

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, probability-like score, ambiguous). Null, empty and letterless texts are und, 0, True."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        grams = trigrams(text)
        margin = np.clip(self.weights[grams].sum(0) / np.sqrt(len(grams)) if len(grams) < 4096 else (np.bincount(grams, minlength=BUCKETS) @ self.weights) / np.sqrt(len(grams)), -12, 12)
        loss = np.logaddexp(0, -self.code * margin) @ self.bit_weight
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.langs[first], float(p[first]), bool(p[first] - p[second] < 0.2)


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = 50_000) -> Model:
    """Fit on about train_rows of the rows where learn holds and lang is not null, chosen by a hash of the id.

    Spark counts n-grams by language in the tasks; only the sums, languages times BUCKETS, reach the driver.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull())
    n = labelled.count()
    if n > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1_000_000)) < int(1e6 * train_rows / n))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                if has_letter(t := text.as_py()):
                    own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                    own += np.bincount(trigrams(t), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = (
        labelled.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
        .mapInArrow(tidied(tally), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(int)] = rows["n"]
    if len(langs) < 2:
        return Model(langs, np.zeros((len(langs), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    code = codewords(len(langs))
    p = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * BUCKETS)
    weights, strength = [], []
    for bit in code.T:
        one, other = p[bit > 0].mean(0), p[bit < 0].mean(0)
        w = np.log(one / other)
        weights.append(w)
        strength.append(((one - other) * w).sum())
    strength = np.array(strength)
    return Model(langs, code, np.stack(weights, 1), strength / strength.mean())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous added (columns of these names are replaced).

    Predictions come from the whole text alone. Null, empty and letterless texts get und and score 0; every row,
    repeated or not, keeps its place; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.score(t.as_py()) for t in texts]
        columns = [pa.array([x[k] for x in found], f.type) for k, f in enumerate(kind)]
        release()
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    kept = docs.drop("lang_pred", "score", "ambiguous")
    return kept.withColumn("_found", run(F.col(text_col).cast("string"))).select(*kept.columns, "_found.*")
