"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's documents share one inclusion rate, target words over the source's words: the whole part is taken of
every document, the fraction by a balanced sample. The flight phase moves the fractional probabilities of three
documents at a time along the null space of two constraints, the number of documents and the number of words, so
that both totals stay as they are until one document is decided. Blocks of documents fly apart from each other and
leave at most two undecided ones each; those meet again in blocks, round after round, until two a source remain, which
are landed by the choice that keeps the words nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BLOCK = 2048


def flight(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Decide all but at most two of the units; sum(pi) and sum(pi * size) stay as they were."""
    pi, size = pi.tolist(), size.tolist()
    rng = np.random.default_rng(seed & (2**63 - 1))
    coins = iter(rng.random(len(pi) + 1).tolist())
    live: list[int] = []
    for new in range(len(pi)):
        if not 0.0 < pi[new] < 1.0:
            continue
        live.append(new)
        if len(live) < 3:
            continue
        a, b, c = live
        # the null vector of [[1, 1, 1], [sizes]]
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - pi[k]) / x if x > 0 else -pi[k] / x for k, x in zip(live, u) if x)
        down = min(pi[k] / x if x > 0 else (pi[k] - 1) / x for k, x in zip(live, u) if x)
        move = up if next(coins) * (up + down) < down else -down
        still = []
        for k, x in zip(live, u):
            pi[k] += move * x
            if pi[k] < 1e-9:
                pi[k] = 0.0
            elif pi[k] > 1 - 1e-9:
                pi[k] = 1.0
            else:
                still.append(k)
        live = still if len(still) < 3 else still[1:]
    return np.array(pi)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few units: of all choices, the one whose words come nearest to the expected words."""
    n = len(pi)
    choices = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    miss = np.abs(choices @ size - pi @ size)
    return choices[np.lexsort((np.abs(choices.sum(1) - pi.sum()), miss.round(6)))[0]].astype(float)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, units, target) from one row (source, source_size, units) a source.

    Sources in code point order, null last, get the weights in turn. The total, share times all sizes, is dealt out by
    weight; a target stops at most times its source's size, and the excess goes to the others by weight until none is
    above. That level is found in closed form: sorted by limit over weight, the stopped sources are the first k for
    which the remaining total over the remaining weight is not below their ratio.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    x = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", most * F.col("source_size"))
    by = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = share * F.sum("source_size").over(every)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("at", F.row_number().over(by)).withColumn("level", left / weight)
    under = F.col("cap") > F.col("level") * F.col("w")
    x = x.withColumn("first", F.min(F.when(under, F.struct("at", "level"))).over(every))
    free = F.col("at") >= F.col("first.at")
    target = F.when(free, F.col("first.level") * F.col("w")).otherwise(F.col("cap"))
    return x.select("source", "source_size", "units", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row for each row of docs: (id_col, source, size, source_size, target, copies, taken, tag).

    size is the number of words (null: 0), copies how often the mix takes the document (0 to 2) and taken the words
    that it takes. Documents without words have no weight and are taken as often as their source's rate rounds down.
    Ties and repeated rows are units of their own; null is a source; an empty table gives no rows. Reruns agree: blocks
    and coins follow from hashes of the rows. tag is the row's hash, for callers who join back.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("tag"),
    )
    base = cut(base)
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    goals = cut(targets(per, weights, share))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    units = (
        base.join(goals, base["source"].eqNullSafe(goals["source"]))
        .drop(goals["source"])
        .withColumn("whole", F.floor(rate + 1e-12).cast("long"))
        .withColumn("pi", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.col("whole"))).otherwise(F.lit(0.0)))
    )
    fields = "id, source, size, source_size, target, tag, whole, pi, units".split(", ")
    kinds = dict(units.dtypes)
    schema = ", ".join(f"{f} {kinds[f]}" for f in fields) + ", decided boolean"

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tag", "id"], kind="stable").sort_values("tag", kind="stable").reset_index(drop=True)
        pdf["pi"] = flight(pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float), int(key[1]) * 1_000_003 + int(pdf["tag"].iloc[0]))
        pdf["decided"] = ~pdf["pi"].between(0, 1, inclusive="neither")
        return pdf[[*fields, "decided"]]

    done, open_, rounds = None, units.select(fields), 0
    while True:
        # each round leaves two of a block, so counts of open units follow from the counts of units alone
        blocks = F.ceil(F.col("units") / BLOCK)
        spread = F.pmod(F.xxhash64("tag", "id", F.lit(rounds)), F.greatest(blocks, F.lit(1))).cast("int")
        flown = cut(open_.withColumn("block", spread).groupBy("source", "block").applyInPandas(fly, schema))
        done = flown.where("decided") if done is None else done.unionByName(flown.where("decided"))
        open_ = flown.where("not decided").withColumn("units", 2 * blocks).select(fields)
        rounds += 1
        widest = flown.agg(F.max("units")).first()[0]
        if widest is None or widest <= BLOCK:
            break

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tag", "id"], kind="stable")
        pdf["pi"] = land(pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float))
        return pdf[[*fields, "decided"]]

    last = open_.withColumn("decided", F.lit(True)).groupBy("source").applyInPandas(finish, schema)
    copies = F.col("whole") + F.round("pi").cast("long")
    return done.unionByName(last).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "tag"
    )
