"""SimHash near-duplicates found with vantage-point trees over fingerprints.

A pair within ``radius`` of 64 bits has, among ``trees`` bands of bits, a band where it differs in at most
``radius // trees`` bits, the allowance. Each band has a vantage-point tree: a node holds a vantage fingerprint and a
radius mu, and splits fingerprints into those whose band distance to the vantage point is at most mu and the rest. Every
fingerprint is at home in one leaf (a shard) and also queries each shard that the triangle bound leaves open, that is,
when its distance lies within the allowance of mu: none, where there are more trees than the radius. Inside a shard the
whole 64 bits are compared, so pairs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, components, cut, join_counted, tidied

SEED = 42


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of each of a text's word shingles, in order.

    A-Z is lower-cased; words are runs of non-white-space; a text with fewer words has them all as its one shingle;
    a text without words (or null) has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; 0 of none."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text's word shingles; a text without words (or null) has fingerprint 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) of every row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                fps = np.array([fingerprint(t.as_py(), width) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(tidied(run), f"id {kind}, fp long")


@dataclass
class Forest:
    """One vantage-point tree a band; nodes are numbered as in a heap, 1 is the root."""

    masks: np.ndarray
    allowance: int
    levels: int
    vantage: np.ndarray
    mu: np.ndarray


def fit_forest(sample: np.ndarray, n: int, allowance: int, trees: int, shard_rows: int, deals: int = 1, even: bool = False) -> Forest:
    """Vantage points and median radii from a sample; as many levels as bring n fingerprints to shard_rows a leaf, or as
    a band has bits, beyond which a tree parts little more. A second deal has bands of bits far apart, others
    have bands of bits at random. even: of all radii
    the one that parts a node most evenly, as ties with the median may leave all on one side."""
    edges = np.linspace(0, 64, trees + 1).astype(int)
    bands = [range(a, b) for a, b in zip(edges, edges[1:])]
    bands += [range(t, 64, trees) for t in range(trees)] * (deals > 1)
    for deal in range(2, deals):
        bands += np.array_split(np.random.default_rng(deal).permutation(64), trees)
    masks, trees = np.array([sum(1 << int(k) for k in band) for band in bands], np.uint64), len(bands)
    levels = int(np.clip(np.ceil(np.log2(max(n, 1) / shard_rows)), 0, np.diff(edges).max()))
    vantage, mu = np.zeros((trees, 1 << levels), np.uint64), np.zeros((trees, 1 << levels), np.uint8)
    for t in range(trees):
        members = {1: sample}
        for node in range(1, 1 << levels):
            own = members.pop(node, sample[:0])
            basis = own if len(own) >= 16 else sample[:4096]
            v = basis[(node * 7919) % len(basis)]
            d = np.bitwise_count((basis ^ v) & masks[t])
            inner = np.cumsum(np.bincount(d)) if even else None
            vantage[t, node], mu[t, node] = v, np.abs(2 * inner - len(d)).argmin() if even else int(np.median(d))
            if len(own):
                inside = np.bitwise_count((own ^ v) & masks[t]) <= mu[t, node]
                members[2 * node], members[2 * node + 1] = own[inside], own[~inside]
    return Forest(masks, allowance, levels, vantage, mu)


def route(fps: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): the shard that each fingerprint lives in and those that it must query."""
    rows, shards, homes = [], [], []
    for t, mask in enumerate(forest.masks):
        row = np.arange(len(fps))
        node, home = np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(forest.levels):
            x = fps[row]
            d = np.bitwise_count((x ^ forest.vantage[t, node]) & mask).astype(np.int64)
            mu = forest.mu[t, node].astype(np.int64)
            outside = d > mu
            gap = np.where(outside, d - mu, mu + 1 - d)
            near = gap <= forest.allowance
            row = np.concatenate([row, row[near]])
            node = np.concatenate([2 * node + outside, 2 * node[near] + ~outside[near]])
            home = np.concatenate([home, np.zeros(int(near.sum()), bool)])
        rows.append(row)
        shards.append(node + (t << (forest.levels + 1)))
        homes.append(home)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def link_shard(fps: np.ndarray, home: np.ndarray, radius: int, cells: int = 1 << 22) -> np.ndarray:
    """Root (smallest index linked to, over any path of verified links) of each of a shard's fingerprints.

    Home fingerprints are compared with all others in blocks of so many cells, but for those that already belong to the
    largest group: two members of one group need no comparison, and the others are compared with all of it.
    """
    root, n = np.arange(len(fps)), max(1, len(fps))
    block = max(1, cells // n)

    def union(i: int, linked: np.ndarray) -> None:
        groups = np.unique(root[linked])
        if len(groups) > 1 or groups[0] != root[i]:
            groups = np.union1d(groups, root[i])
            root[np.isin(root, groups)] = groups[0]

    done = ~home
    while True:
        sizes = np.bincount(root, minlength=len(fps))
        largest = int(sizes.argmax()) if sizes.max() > 32 else -1
        todo = np.flatnonzero(~done & (root != largest))[:block]
        if not len(todo):
            break
        near = np.bitwise_count(fps[todo, None] ^ fps[None, :]) <= radius
        for k in np.flatnonzero((near & (root[todo, None] != root[None, :])).any(1)):
            union(todo[k], np.flatnonzero(near[k]))
        done[todo] = True
    rest = np.flatnonzero(~done)
    if len(rest):
        for i in np.flatnonzero(~home & (root != largest)):
            if root[i] != root[rest[0]] and (np.bitwise_count(fps[rest] ^ fps[i]) <= radius).any():
                union(i, rest[:1])
    return root


def nearest_edges(distance, n: int, most: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A shortest spanning forest of n items that are at most so far apart: every group picks its nearest outside item,
    round after round, so that any two that are linked are linked by steps no longer than theirs.

    distance(rows) gives the distances of some rows to all items as unsigned bytes, 255 where no step is allowed.
    """
    root, todo, ends, alone = np.arange(n), np.arange(n), [], np.zeros(n, bool)
    block = max(1, cells // max(1, n))
    while len(todo) and n > 1:
        far, other = np.full(n, 255, np.uint8), np.zeros(n, np.int64)
        for at in range(0, len(todo), block):
            own = todo[at : at + block]
            d = distance(own)
            d[root[own, None] == root[None, :]] = 255
            other[own] = d.argmin(1)
            far[own] = d[np.arange(len(own)), other[own]]
        near = todo[far[todo] <= most]
        alone[todo] = ~np.isin(root[todo], root[near])
        # of each group the shortest step out, ties by place
        first = near[np.lexsort((near, far[near], root[near]))]
        first = first[np.unique(root[first], return_index=True)[1]]
        for i in first[np.argsort(far[first], kind="stable")]:
            a, b = sorted((root[i], root[other[i]]))
            if a != b:
                ends.append((i, other[i]))
                root[root == b] = a
        held = np.bincount(root, minlength=n)
        # the largest group needs no look of its own: the others look for steps to it
        todo = np.flatnonzero(~alone & ((root != held.argmax()) | (held.max() <= 32)))
    a, b = np.array(ends, np.int64).reshape(-1, 2).T
    return a, b


def shards(fps: DataFrame, allowance: int, trees: int, deals: int = 1, shard_rows: int = 512, sample_rows: int = 4096, task_rows: int = 100_000, even: bool = False) -> DataFrame:
    """Rows of fps (a long fingerprint first, then other long columns) with each shard that they live in or query:
    columns shard, p and q name a task, home tells whether the row lives there.

    The trees are fitted on at most sample_rows fingerprints (the first in hash order); every fingerprint is indexed.
    Shards of more than task_rows are cut into blocks, and each pair p, q of blocks is a task of its own; only the sizes
    of such shards reach the driver.
    """
    name, names = fps.columns[0], fps.columns
    n = fps.count()
    top = fps.select(name).orderBy(F.xxhash64(name), name).limit(sample_rows).collect()
    forest = fit_forest(np.array([r[0] for r in top], np.int64).view(np.uint64), n, allowance, trees, shard_rows, deals, even)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(own), 20_000):
                shard, rows = np.unique(route(own[at : at + 20_000], forest)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(rows)], ["shard", "rows"])

    sizes = fps.select(name).mapInArrow(tally, "shard long, rows long").groupBy("shard").agg(F.sum("rows").alias("rows"))
    large = {r["shard"]: -(-2 * r["rows"] // task_rows) for r in sizes.where(F.col("rows") > task_rows).collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                own = np.asarray(part.column(0)).view(np.uint64)
                row, shard, home = route(own, forest)
                blocks = np.array([large.get(s, 1) for s in shard.tolist()], np.int64)
                # a row of block b is in the pairs of b with every block
                at = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                b = (own[row[at]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % blocks[at]
                kept = part.take(pa.array(row[at]))
                tasks = (shard[at], np.minimum(b, other), np.maximum(b, other), home[at])
                yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, tasks)], [*names, "shard", "p", "q", "home"])

    fields = ", ".join(f"{c} long" for c in names)
    return fps.mapInArrow(tidied(spread), f"{fields}, shard long, p long, q long, home boolean")


def links(fps: DataFrame, radius: int = 4, trees: int | None = None, **sizes: int) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which a chain of pairs within radius connects.

    fps has one long column of distinct fingerprints. By default there is one tree more than the radius: some band is
    then equal in any pair within the radius, so that a fingerprint has one shard a tree at every size; fewer trees
    have wider bands and let it visit further shards. A shard returns a star for each of its groups instead of all
    pairs, so that a large group of near copies stays linear.
    """
    trees = trees or radius + 1

    def shard_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        own = pdf["fp"].to_numpy()
        root = link_shard(own.view(np.uint64), pdf["home"].to_numpy(), radius)
        linked = root != np.arange(len(own))
        return pd.DataFrame({"a": own[linked], "b": own[root[linked]]})

    dealt = shards(fps.toDF("fp"), radius // trees, trees, **sizes)
    return dealt.groupBy("shard", "p", "q").applyInPandas(shard_edges, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, trees: int | None = None
) -> DataFrame:
    """One row for each row of docs: (id_col, fingerprint, component_id).

    component_id is the smallest id that a chain of fingerprints within radius bits reaches. Null and empty texts
    share fingerprint zero and so form one group, linked like any other; a null id has a row and is never a
    component's id unless all its ids are null; repeated rows each have a row; an empty table gives none; further
    columns of docs are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows")))
    if distinct.isEmpty():
        return prints.select(F.col("id").alias(id_col), F.lit("").alias("fingerprint"), F.col("id").alias("component_id"))
    roots = cut(components(links(distinct.select("fp"), radius, trees)).withColumnRenamed("node", "fp"))
    lows = cut(join_counted(distinct, roots, "fp").groupBy("root").agg(F.min("low").alias("component")))
    linked = join_counted(roots, lows, "root").select("fp", "component")
    alone = join_counted(distinct.where("rows > 1"), roots, "fp", "left_anti").select("fp", F.col("low").alias("component"))
    known = cut(linked.unionByName(alone))
    return join_counted(prints, known, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
    )
