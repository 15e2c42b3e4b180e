"""The pipeline's near-duplicates against the exact Jaccard similarity of all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries, simhash, similar
from test_llm import union_find


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def roots(texts):
    sets = [shingles(t) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return union_find(len(sets), close)


def edited():
    """Texts of 10 to 400 words and copies with changes at one end or anywhere, similar to 0.6 to 1."""
    rng, out = random.Random(11), []
    for n in (10, 20, 40, 60, 120, 400):
        for _ in range(8):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            out.append(base)
            for share in (0.03, 0.08, 0.12, 0.2, 0.3):
                out.append(base[: n - int(n * share)] + [f"x{rng.randrange(10**6)}" for _ in range(int(n * share / 3))])
            out.append([w if rng.random() > 0.02 else "changed" for w in base])
    one = [f"h{k}" for k in range(100)]
    out += [one[:k] + [f"y{k}"] + one[k + 1 :] for k in range(100)]  # a large group
    return [" ".join(w) for w in out] + ["", " ", "one", "ONE", "two words"]


def hold(got, want):
    """Every group found lies within an exact one, and few texts that have a near-duplicate are missed."""
    assert len(set(zip(got, want))) == len(set(got))
    assert len(want) - len(set(got)) >= 0.9 * (len(want) - len(set(want)))


def test_near_dedup_against_all_pairs(spark):
    import corpus_pipeline as C

    texts = edited()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["tag"]: r["component"] for r in similar.similar_texts(docs.withColumnRenamed("doc_id", "tag")).collect()}
    got = [found[k] for k in range(len(texts))]
    hold(got, roots(texts))
    first = sorted({c: k for k, c in reversed(list(enumerate(got)))}.values())
    assert sorted(r["doc_id"] for r in C.near_dedup(spark, docs, "").collect()) == first
    assert C.near_dedup(spark, docs.limit(0), "").count() == 0


def test_similar_texts_of_the_corpus(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("tag"), "text").orderBy("tag")
    texts = rows.collect()
    got = {r["tag"]: r["component"] for r in similar.similar_texts(rows).collect()}
    hold([got[r["tag"]] for r in texts], roots([r["text"] for r in texts]))


def test_nearest_edges_span_what_pairs_connect():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 2**20, 300, dtype=np.uint64))
    d = np.bitwise_count(fps[:, None] ^ fps[None])
    for most in (1, 2, 3):
        a, b = simhash.nearest_edges(lambda own: d[own].copy(), len(fps), most, cells=1000)
        assert (d[a, b] <= most).all()
        close = np.argwhere(np.triu(d <= most, 1))
        assert union_find(len(fps), zip(a, b)) == union_find(len(fps), close)
        assert len(a) == len(fps) - len(set(union_find(len(fps), close)))


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(8)]
    ids = [None, None, 1, 1, 2, 3, 3, None]
    rows = [(i, t, "en", s, len(t)) for (i, t), s in zip(zip(ids, texts), ["s", "t", None, "s", "t", "s", "s", None])]
    rows += [(1, texts[4] + " end", "en", "s", 0), (3, texts[6], "en", "s", len(texts[6])), (None, texts[6], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # row 8 is a near copy of 2 under the smaller id 1: it stays and 2 goes, the other text under id 1 stays too
    want = [rows[k] for k in (0, 1, 2, 3, 5, 6, 7, 8)]
    assert Counter(map(tuple, C.near_dedup(spark, docs, "").collect())) == Counter(want)
    more = docs.unionByName(docs.where("doc_id = 1").withColumn("lang", F.lit("de")))
    mixed = mixing.mix(more).groupBy("tag", "source").agg(F.sum("copies").alias("n")).where("n > 0")
    got = C.mixture(spark, more, "").groupBy(F.xxhash64("doc_id", "text").alias("tag"), "source").count()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, mixed.collect())) and got.where("source IS NULL").count() > 0


def many_near():
    """A base and 150 copies with edits at random places, similar to 0.6 to 0.9 among themselves, of shuffled sizes; and
    short texts that end in a common line."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    out = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(150), k % 5 + 1):
            words[at] = f"z{rng.randrange(10**6)}"
        out.append(words + [f"t{k}"] * (k % 7))
    out += [[f"s{k // 2}", f"u{k // 3}"] + [f"c{i}" for i in range(k % 9 + 3)] for k in range(120)]
    return [" ".join(w) for w in out]


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    texts = edited() + many_near()
    want = roots(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "tag long, text string")

    def hold_all(radius):
        got = {r["tag"]: r["component"] for r in similar.similar_texts(rows, radius=radius).collect()}
        got = [got[k] for k in range(len(texts))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))

    hold_all(similar.RADIUS)
    # radius 0: the trees find next to nothing, and the prefixes, with large buckets in several blocks, have to find it all
    for name, value in (("BUCKET", 4), ("TASK_ROWS", 60), ("COMMON", 10**6)):
        monkeypatch.setattr(similar, name, value)
    hold_all(0)


def test_prefixes_and_bitmaps_leave_no_similar_pair_out():
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(0, 400, 50).astype(np.uint64))
    place = rng.permutation(len(known))
    for _ in range(500):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 400, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 400, n // 12).astype(np.uint64)]))
        if len(y) and similar.alike(len(x), len(y), len(np.intersect1d(x, y))):
            assert len(np.intersect1d(similar.prefix(x, known, place), similar.prefix(y, known, place)))
            bits = np.frombuffer(similar.parities(x) + similar.parities(y), np.uint64).reshape(2, -1)
            assert sum(len(i) for i, _, _ in similar.near_pairs(np.array([len(x), len(y)]), np.array([1, 2]), bits))


def test_texts_that_share_a_shingle_by_chance_share_no_step():
    """Steps of pairs of similarity 4/5 or more are shared, those of texts with a line in common are not."""
    rng = np.random.default_rng(6)
    none = np.empty(0, np.uint64)
    line = rng.integers(0, 2**64, 8, dtype=np.uint64)
    sets = [np.unique(np.concatenate([line, rng.integers(0, 2**64, 200, dtype=np.uint64)])) for _ in range(60)]
    tokens = Counter(t for u in sets for t in similar.prefix(u, none, none).tolist())
    assert sum(n * (n - 1) // 2 for n in tokens.values()) < 60
    for n in (1, 2, 5, 9, 50, 400):
        for _ in range(50):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            # as many changes as similarity 4/5 allows: of one kind, or of both
            gone, new = int(rng.integers(0, len(x) // 9 + 1)), 0
            while similar.alike(len(x), len(x) - gone + new + 1, len(x) - gone):
                new += 1
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
            known = np.sort(rng.choice(x, len(x) // 2, replace=False))
            place = rng.permutation(len(known))
            assert len(np.intersect1d(similar.prefix(x, known, place), similar.prefix(y, known, place)))


def test_only_pairs_that_bitmaps_leave_possible_are_verified(spark):
    rng = np.random.default_rng(7)
    one = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
    sets = [one, one[:90], one[:60], np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))]
    rows = [(k, len(u), bytearray(similar.parities(u))) for k, u in enumerate(sets)]
    read_ = spark.createDataFrame(rows + rows[:1], "set long, size long, bits binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3)], "a long, b long")
    assert [tuple(r) for r in similar._possible(pairs, read_).collect()] == [(0, 1)]
    assert similar._possible(pairs.limit(0), read_).count() == 0


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_shards_hold_as_many_sets_at_any_size(spark, n):
    """Bands of eight bits left shards of n / 256 sets, whose compares grew with the square of the corpus."""
    fps = spark.range(n).select(F.xxhash64("id").alias("fp"), "id")
    held = np.array([r["count"] for r in similar.dealt_out(fps, n).groupBy("shard").count().collect()])
    # of the shard that a row lies in
    assert (held**2).sum() / held.sum() <= 2 * similar.SHARD_ROWS


def test_wide_bands_and_many_rounds_leave_no_similar_pair_out(spark, monkeypatch):
    texts = edited() + many_near()
    for name, value in (("SHARD_ROWS", 1), ("ROUND_TEXTS", 40), ("BUCKET", 4), ("TASK_ROWS", 60)):
        monkeypatch.setattr(similar, name, value)
    want = roots(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "tag long, text string")
    got = {r["tag"]: r["component"] for r in similar.similar_texts(rows).collect()}
    got = [got[k] for k in range(len(texts))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_shingle_sets_are_those_of_words():
    rng = random.Random(3)
    odd = [None, "", "  ", "a", "A", " a\tb\n", "a b c d e", "a b c d e f", "X" * 64 + " " + "x" * 65, "Y" * 300_000 + " b c", "é È", "a\xa0b", "\x0b\x0c\x1ca"]
    odd += [" ".join(rng.choice(["a", "b", "A", "cc", "D"]) for _ in range(rng.randrange(30))) for _ in range(300)] + [None]
    for width in (1, 4, 5):
        for texts in (pa.array(odd), pa.array(["z", None, *odd], pa.large_string()).slice(2), pa.array([None, ""]), pa.array([], pa.string())):
            u, ends = similar.shingle_sets(texts, width)
            assert len(ends) == len(texts)
            there, back = {}, {}
            for text, a, b in zip(texts.to_pylist(), [0, *ends.tolist()], ends.tolist()):
                words = (text or "").encode().lower().split()
                want = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)] * bool(words))
                got = tuple(u[a:b].tolist())
                assert len(got) == len(want) and list(got) == sorted(set(got))
                assert there.setdefault(want, got) == got and back.setdefault(got, want) == want
            for find, one in ((similar._majorities, simhash.majority), (lambda u, ends: [x.tobytes() for x in similar._parities(u, ends)], similar.parities)):
                assert list(find(u, ends)) == [one(u[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
    many = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    ends = np.array([0, 150_000, 150_000, 150_255, 150_511, 200_000])
    assert similar._majorities(many, ends).tolist() == [simhash.majority(many[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]


def test_runs_go_on_over_batches():
    key = np.repeat([5, 3, 9, 1], [4, 1, 6, 2])
    whole = pa.record_batch([pa.array(key), pa.array(np.arange(13)), pa.array([bytes([k]) * 8 * similar.WORDS for k in range(13)])], ["key", "n", "bits"])
    for step in (1, 2, 3, 5, 13):
        found = list(similar.runs((whole.slice(at, step) for at in range(-step, 13, step) if at >= 0), 1))
        assert [x[0].tolist() for x in found] == [[5] * 4, [3], [9] * 6, [1] * 2]
        assert np.concatenate([x[1] for x in found]).tolist() == list(range(13))
        assert [len(x[2]) for x in found] == [4, 1, 6, 2] and found[0][2].shape[1] == similar.WORDS
    assert not list(similar.runs(iter([whole.slice(0, 0)]), 1))


def test_nearest_edges_reach_a_group_that_did_not_look():
    """Chains of 40 and 70 places, joined late by one longer step each: the largest group changes on the way."""
    at = np.concatenate([start + step * np.arange(n) for start, step, n in ((0, 1, 40), (42, 1, 70), (115, 1, 36), (155, 2, 35), (400, 1, 50))])
    d = np.minimum(np.abs(at[:, None] - at[None]), 255).astype(np.uint8)
    for most in (1, 2, 3, 5, 6):
        a, b = simhash.nearest_edges(lambda own: d[own].copy(), len(at), most, cells=2000)
        close = np.argwhere(np.triu(d <= most, 1))
        assert (d[a, b] <= most).all() and len(a) == len(at) - len(set(union_find(len(at), close)))
        assert union_find(len(at), zip(a, b)) == union_find(len(at), close)
