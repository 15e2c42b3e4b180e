"""Groups of texts whose sets of word shingles have an exact Jaccard similarity of 4/5 or more, found by SimHash.

Vantage-point trees over fingerprints find neighbours. The bits are dealt to bands several times, in runs, in strides and
at random, and a set has one shard a tree; a pair meets if it agrees in any band. Bands get wider as sets get more, so that
a shard holds about as many sets at any size, and trees more, so that as many pairs meet. A second fingerprint, from the
same shingles by other bits, makes distances within a shard surer. Every shard returns a shortest spanning forest, so that a
large group of near copies stays linear, and each of its steps is verified on both texts' whole sets.

What the trees miss is found by steps: a step is a shingle and the next of its set in order of hash, the last followed
by the first. What two sets a and b share, c shingles, makes a circle of c gaps, and each of the |a| + |b| - 2c others
opens one gap at most, so that they share 3c - |a| - |b| steps: three fifths of either's, if their similarity is 4/5 or
more. So the first two fifths of each set's steps, and one more, in any common order share a step. Texts that have a
shingle in common by chance, or a line, hardly ever share a step, so that what is looked at follows the near copies and
not the square of the texts. Steps with a rare shingle come first, as a sample has them; the order changes the work, not
the result. Only pairs of different groups are looked at there, and of those only the ones whose parity bitmaps differ in
no more bits than such sets can. Each set's nearest is verified first, then all pairs of groups that are still apart. So
every link is exact, and no two similar texts stay in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_bytes, components, cut, join_counted, tidied

#: Differing bits of both fingerprints, 128 in all, up to which neighbours are verified; the most trees a deal of the first.
RADIUS, TREES = 31, 8

#: Sets of a shard, about, that trees have as many levels and bands as many bits for; fingerprints they are fitted on, at most.
SHARD_ROWS, FITTED_ROWS = 1024, 32_768

#: Texts that the order of shingles is drawn from, about; how often a shingle comes there to be put last; how many are.
SAMPLE_TEXTS, COMMON, MOST_COMMON = 10_000, 3, 100_000

#: Steps are counted in rounds, by their remainder, so that tasks hold as small a part of them at a time, and those that
#: are shared stay few enough to be broadcast: one round for so many texts, but no fewer and no more than these.
ROUND_TEXTS, ROUNDS, MOST_ROUNDS = 125_000, 4, 32

#: Bytes that words are hashed together in, and longest words that are; texts that are read at once, at most.
BLOCK, LONGEST, READ_TEXTS = 1 << 18, 64, 256

#: Sets that share a step of their prefixes up to which all pairs are joined; beyond it bitmaps of WORDS x 64 bits are
#: compared, in pairs of blocks where there are more than TASK_ROWS.
BUCKET, WORDS, TASK_ROWS = 16, 16, 20_000


def alike(own: int | np.ndarray, other: int | np.ndarray, both: int | np.ndarray) -> bool | np.ndarray:
    """Whether both / (own + other - both) >= 4/5, in whole numbers."""
    return 9 * both >= 4 * (own + other)


def _other_bits(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits mixed anew."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Factors of a byte at each place of a block and their inverses; a random number for each byte, the same for A-Z as for
#: a-z; white space; a byte's bits, each as a byte.
ODD = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.full(BLOCK + LONGEST, ODD, np.uint64))
INVERSES = np.cumprod(np.full(BLOCK + LONGEST, pow(ODD, -1, 1 << 64), np.uint64))
BYTES = _other_bits(np.arange(1, 257, dtype=np.uint64))
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end], lower-cased: a polynomial of their bytes modulo 2**64, XXH64 of long ones."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        origin = start[at]
        to = int(np.searchsorted(start, origin + BLOCK))
        values = BYTES[data[origin : start[to - 1] + LONGEST]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * POWERS[: len(values)])))
        a, b = start[at:to] - origin, np.minimum(end[at:to] - origin, len(values))
        out[at:to] = (sums[b] - sums[a]) * INVERSES[a]
        at = to
    for k in np.flatnonzero(end - start > LONGEST):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes().lower())
    return _other_bits(out)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted hashes of each text's set of word shingles, one set after the other, and where each ends.

    Words and shingles are those of ``simhash.shingle_hashes``, the hashes are others, made for all texts at once.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space, edge = SPACE[data], np.zeros(len(data) + 1, bool)
    edge[edges] = True  # parts words as white space does
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    first = np.searchsorted(start, edges)
    words = np.diff(first)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.concatenate((_word_hashes(data, start, end), np.zeros(width, np.uint64)))
    factors = _other_bits(np.arange(1000, 1000 + width, dtype=np.uint64)) | np.uint64(1)
    total = sum(h[k : k + len(start)] * factors[k] for k in range(width)) + np.uint64(width)
    whole = np.arange(len(start)) + width <= np.repeat(first[1:], words)
    for few in range(1, width):
        at = first[:-1][words == few]
        total[at] = sum((h[at + k] * factors[k] for k in range(few)), np.uint64(few))
        whole[at] = True
    found = _other_bits(total[whole])
    ends = np.cumsum(np.where(words < width, np.minimum(words, 1), words - width + 1))
    new = np.ones(len(found), bool)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        found[a:b].sort()
    new[1:] = found[1:] != found[:-1]
    new[ends[:-1][ends[:-1] < len(found)]] = True
    new[0] = True
    return found[new], np.concatenate(([0], np.cumsum(new)))[ends]


def _majorities(u: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``simhash.majority`` of each set."""
    size = np.diff(ends, prepend=0)
    parts = -(-size // 255)  # sums of so many bits fit a byte
    last = np.cumsum(parts)
    at = np.repeat(ends - size, parts) + 255 * (np.arange(parts.sum()) - np.repeat(last - parts, parts))
    ones = np.zeros((len(ends), 64), np.int64)
    owner = np.repeat(np.arange(len(ends)), parts)
    for k in range(0, len(at), 512):
        own, a = at[k : k + 512], at[k]
        b = at[k + 512] if k + 512 < len(at) else len(u)
        sums = np.add.reduceat(LANES[u[a:b].view(np.uint8).reshape(-1, 8)], own - a, axis=0)
        own = owner[k : k + 512]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[new]] += np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), new, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Hashes of the most common shingles of a sample of rows' texts (by hash of the text), the rarest first."""
    every = max(1, rows.count() // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(0), width)[0].view(np.int64))], ["token"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(tidied(run), "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    return np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)


def _prefixes(u: np.ndarray, ends: np.ndarray, known: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """``prefix`` of each set."""
    late, following = np.zeros(len(u), np.uint64), np.roll(u, -1)
    if len(known):
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> np.uint64(44)] = True
        may = np.flatnonzero(maybe[u >> np.uint64(44)])
        at = np.minimum(np.searchsorted(known, u[may]), len(known) - 1)
        late[may] = np.where(known[at] == u[may], place[at] + 1, 0)
    later = np.roll(late, -1)
    start = np.concatenate(([0], ends[:-1]))
    some = ends > start
    following[ends[some] - 1], later[ends[some] - 1] = u[start[some]], late[start[some]]
    # steps that agree in what is left of their hash count as one, which parts no pair that shares a step
    steps = np.minimum(late, later) << np.uint64(47) | _other_bits(_other_bits(u) ^ following) >> np.uint64(17)
    out = []
    for a, b in zip(start.tolist(), ends.tolist()):
        most = b - a - (3 * (b - a) + 4) // 5 + 1 if b > a else 0
        out.append(np.partition(steps[a:b], most - 1)[:most] if most < b - a else steps[a:b])
    return out


def prefix(u: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of the first of a set's steps (u: its shingles' sorted hashes), of which a set of similarity 4/5 or more
    shares one in its own prefix: in order of hash, those of two shingles of known (sorted) last and by the smaller place."""
    return _prefixes(u, np.array([len(u)]), known, place)[0]


def _parities(u: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``parities`` of each set, a row each."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    bit = (u % np.uint64(64 * WORDS)).astype(np.int64) + 64 * WORDS * owner
    odd = np.bincount(bit, minlength=64 * WORDS * len(ends)) & 1
    return np.packbits(odd.astype(bool).reshape(-1, 64 * WORDS), axis=1, bitorder="little")


def parities(u: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each bit: two sets differ in no fewer hashes than bits."""
    return _parities(u, np.array([len(u)])).tobytes()


def near_pairs(size: np.ndarray, root: np.ndarray, bits: np.ndarray, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits that differ) of all pairs of sets of different roots that sizes and bitmaps leave possible, in blocks."""
    groups, group, held = np.unique(root, return_inverse=True, return_counts=True)
    todo = np.flatnonzero(group != held.argmax())  # pairs within the largest group need no comparison
    block = max(1, cells // max(1, len(size)))
    for at in range(0, len(todo), block):
        own = todo[at : at + block]
        a, b = size[own, None], size[None, :]
        i, j = np.nonzero((5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (group[own, None] != group[None, :]))
        i = own[i]
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int32)
        near = 9 * d <= size[i] + size[j]
        yield i[near], j[near], d[near]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first so many columns; bitmaps (binary) have WORDS numbers a row."""

    def array(c: pa.Array) -> np.ndarray:
        if pa.types.is_binary(c.type):
            return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, WORDS)
        return np.asarray(c)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        now = [array(c) for c in batch.columns]
        if held and any(x[0] != y[0] for x, y in zip(held[0][:keys], now)):
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:keys]], axis=0)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            held.append([x[a:b] for x in now])
            if b < len(batch):
                yield [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]
                held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def by_run(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """The columns that run returns for the columns of each group of rows, which are in order of set; groups that are
    small and many pass in batches, not one by one."""
    names = schema.split()[::2]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for columns in runs(batches, len(keys)):
            for part in run(*columns[len(keys) :]):
                out.append(part)
                n += len(part[0])
            if n > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                out, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    dealt = rows.select(*keys, *(c for c in rows.columns if c not in keys)).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "set").mapInArrow(tidied(every), schema)


def dealt_out(fps: DataFrame, n: int) -> DataFrame:
    """n rows in shards of about as many at any n: bands have a bit for each halving, and the wider they are, the more
    trees there are, so that of pairs that differ in 15 % of their bits (a similarity of 0.8) 99 % agree in a band."""
    levels = max(8, int(np.ceil(np.log2(max(1, n / SHARD_ROWS)))))
    trees = max(1, min(TREES, 64 // levels))
    deals = int(np.ceil(np.log(0.01) / np.log(1 - 0.85**levels) / trees))
    return simhash.shards(fps, 0, trees, deals=max(2, deals), shard_rows=SHARD_ROWS, sample_rows=FITTED_ROWS, even=True)


def similar_texts(rows: DataFrame, width: int = 5, radius: int = RADIUS) -> DataFrame:
    """(tag, component) of each tag of rows (tag long, text string), a tag being a hash that tells texts apart.

    Tags are of one component if and only if a chain of pairs of similarity 4/5 or more connects them; texts without
    words, null among them, count as equal, and so do texts of equal sets. component is a number without meaning.
    """
    last = common_shingles(rows, width)
    place = np.argsort(last, kind="stable")
    known = last[place]

    n = rows.count()
    rounds = max(ROUNDS, min(MOST_ROUNDS, -(-n // ROUND_TEXTS)))
    lists = [f"prefix{k}" for k in range(rounds)]
    names = ["tag", "set", "fp", "fp2", "size", "bits", *lists]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (part for whole in batches for some in by_bytes(whole, 1 << 20) for part in (some.slice(at, READ_TEXTS) for at in range(0, len(some), READ_TEXTS)))
        for batch in slices:
            u, ends = shingle_sets(batch.column(1), width)
            size = np.diff(ends, prepend=0)
            digests = [xxhash.xxh64_intdigest(u[a:b].tobytes()) for a, b in zip((ends - size).tolist(), ends.tolist())]
            columns = (np.array(digests, np.uint64), _majorities(u, ends), _majorities(_other_bits(u), ends), size.astype(np.uint64))
            arrays = [batch.column(0), *(pa.array(c.view(np.int64)) for c in columns), pa.array([x.tobytes() for x in _parities(u, ends)], pa.binary())]
            first = _prefixes(u, ends, known, place)
            token, owner = np.concatenate(first), np.repeat(np.arange(len(first)), [len(x) for x in first])
            own = (token % np.uint64(rounds)).astype(np.int64)
            for k in range(rounds):
                counts = np.bincount(owner[own == k], minlength=len(first))
                edges = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                arrays.append(pa.ListArray.from_arrays(edges, pa.array(token[own == k].view(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "tag long, set long, fp long, fp2 long, size long, bits binary" + "".join(f", {c} array<long>" for c in lists)
    read_ = cut(rows.select("tag", "text").mapInArrow(tidied(read), schema))
    # fingerprints are of the sets themselves, so that equal sets agree in all columns
    sets = cut(read_.groupBy("set", "fp", "fp2", "size").agg(F.min("tag").alias("tag")))
    if sets.isEmpty():
        return read_.select("tag", F.col("set").alias("component"))

    def neighbours(name: np.ndarray, fp: np.ndarray, fp2: np.ndarray, size: np.ndarray) -> Iterator[list[np.ndarray]]:
        one, two = fp.view(np.uint64), fp2.view(np.uint64)
        block, some = max(1, (1 << 17) // len(one)), []
        for at in range(0, len(one), block):
            d = np.bitwise_count(one[at : at + block, None] ^ one) + np.bitwise_count(two[at : at + block, None] ^ two)
            some.append(np.count_nonzero(d <= radius, axis=1) > 1)
        # most sets have no neighbour but themselves
        at = np.flatnonzero(np.concatenate(some))
        name, one, two, size = name[at], one[at], two[at], size[at]

        def distance(own: np.ndarray) -> np.ndarray:
            d = np.bitwise_count(one[own, None] ^ one[None, :]) + np.bitwise_count(two[own, None] ^ two[None, :])
            d[5 * np.minimum(size[own, None], size) < 4 * np.maximum(size[own, None], size)] = 255
            return d

        if len(at) > 1:
            a, b = simhash.nearest_edges(distance, len(at), radius)
            yield [np.minimum(name[a], name[b]), np.maximum(name[a], name[b])]

    dealt = dealt_out(sets.select("fp", "fp2", "set", "size"), sets.count())
    pairs = cut(by_run(dealt.select("shard", "p", "q", "set", "fp", "fp2", "size"), ["shard", "p", "q"], neighbours, "a long, b long").distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1 << 20)):
            (u, p), (v, q) = (shingle_sets(batch.column(c), width) for c in (2, 3))
            good = []
            for k in range(len(batch)):
                x, y = u[p[k - 1] if k else 0 : p[k]], v[q[k - 1] if k else 0 : q[k]]
                good.append(bool(alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) of sets that are similar."""
        used = cut(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct())
        named = cut(join_counted(sets, used, "set").select("set", "tag"))
        texts = cut(join_counted(rows.select("tag", "text"), named, "tag").dropDuplicates(["set"]).select("set", "text"))
        one, two = texts.select(F.col("set").alias("a"), F.col("text").alias("x")), texts.select(F.col("set").alias("b"), F.col("text").alias("y"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y")
        return cut(both.mapInArrow(tidied(check), "a long, b long"))

    roots = cut(components(verified(pairs)).withColumnRenamed("node", "set"))

    # what the trees missed: sets of different groups that share a step of their prefixes
    hits = tried = None
    for prefixes in lists:
        postings = join_counted(read_.select("set", "size", prefixes), roots, "set", "left").select("set", "size", F.coalesce("root", "set").alias("root"), F.explode(prefixes).alias("token"))
        shared = cut(postings.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token"))
        part = cut(join_counted(postings.drop("root"), shared, "token").distinct())
        hits = part if hits is None else hits.unionByName(part)
    for step in (_nearest_pairs, _open_pairs):
        named = join_counted(hits, roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        mixed = cut(named.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token", "n"))
        buckets = cut(join_counted(named, mixed, "token"))
        found = cut(step(buckets, read_).distinct())
        if tried is not None:
            found = cut(found.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        if not found.isEmpty():
            linked = verified(_possible(found, read_))
            roots = cut(components(roots.toDF("a", "b").unionByName(linked)).withColumnRenamed("node", "set"))
        tried = found
    return join_counted(read_.select("tag", "set").distinct(), roots, "set", "left").select("tag", F.coalesce("root", "set").alias("component"))


def _possible(pairs: DataFrame, read_: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of sets that sizes and bitmaps leave possible, so that no texts move for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (np.asarray(batch.column(c)) for c in ("m", "n"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WORDS) for c in ("x", "y"))
            d = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            at = pa.array(np.flatnonzero((9 * d <= m + n) & (5 * np.minimum(m, n) >= 4 * np.maximum(m, n))))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b")], ["a", "b"])

    used = cut(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct())
    bits = cut(join_counted(read_.select("set", "size", "bits"), used, "set").dropDuplicates(["set"]))
    both = pairs.join(bits.toDF("a", "m", "x").hint("merge"), "a").join(bits.toDF("b", "n", "y").hint("merge"), "b")
    return cut(both.mapInArrow(tidied(run), "a long, b long"))


def _nearest_pairs(buckets: DataFrame, read_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups: all of small buckets, and each set's nearest of large ones."""
    x = buckets.where(F.col("n") <= BUCKET).select("token", "set", "size", "root")
    y = x.select("token", *(F.col(c).alias(f"{c}2") for c in ("set", "size", "root")))
    fits = "set < set2 AND root != root2 AND 5 * least(size, size2) >= 4 * greatest(size, size2)"
    small = x.join(y.hint("merge"), "token").where(fits).select(F.col("set").alias("a"), F.col("set2").alias("b"))
    near = _compared(buckets, read_, True).groupBy("own").agg(F.min(F.struct("d", "other")).alias("x")).select("own", "x.other")
    return small.unionByName(near.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))


def _open_pairs(buckets: DataFrame, read_: DataFrame) -> DataFrame:
    """All pairs (a, b) of different groups of large buckets; those of small ones have been verified."""
    return _compared(buckets, read_, False).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _compared(buckets: DataFrame, read_: DataFrame, nearest: bool) -> DataFrame:
    """(own, other, d) of the pairs that ``near_pairs`` leaves of large buckets, or of each own's nearest in a task; d is
    the share of hashes that differ at least."""

    def compare(name: np.ndarray, size: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[list[np.ndarray]]:
        for i, j, d in near_pairs(size, root, bits):
            own, other, share = name[i], name[j], d / (size[i] + size[j])
            if nearest:
                at = np.lexsort((other, share, i))
                at = at[np.unique(i[at], return_index=True)[1]]
                own, other, share = own[at], other[at], share[at]
            yield [own, other, share]

    large = cut(buckets.where(F.col("n") > BUCKET))
    bits = join_counted(read_.select("set", "bits"), cut(large.select("set").distinct()), "set").dropDuplicates(["set"])
    # a row of block b is in the pairs of b with every block
    blocks = F.when(F.col("n") > TASK_ROWS, F.ceil(2 * F.col("n") / TASK_ROWS)).otherwise(1).cast("long")
    dealt = large.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("set"), "blocks")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = dealt.select("token", F.least("b", "k").alias("p"), F.greatest("b", "k").alias("q"), "set", "size", "root")
    keyed = tasks.join(bits.hint("merge"), "set").select("token", "p", "q", "set", "size", "root", "bits")
    return by_run(keyed, ["token", "p", "q"], compare, "own long, other long, d double")
