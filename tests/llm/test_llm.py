"""The training-data operators against brute force, the reference tokenizers, exact round trips and held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, digest, langid, licenses, mixing, quality, queries, simhash, tokencount, vectors
from tidemark.llm.common import components

SMALL = "/root/testdata/sf0.001"
BYTES, WORDS = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "the same words again and again", "en", "s", 30), (1, "the same words again and again", "en", "s", 30), (2, None, None, None, None), (3, "", "en", None, 0),
    (None, "no id at all here", "de", "t", 17), (4, "x " * 60_000, "fr", "t", 120_000), (5, " \t\n ", "fr", "s", 4), (6, "the same words again and again", None, "s", 30), (7, "été 漢字 😀 \\### </turn> <|endoftext|>", "fr", "u", 40),
]


def odd(spark):
    """Nulls anywhere, repeated rows, ties, an empty, a blank and a long text, and columns whose names operators use."""
    clash = ["size", "copies", "tag", "score", "lang_pred", "ids", "fp", "run", "follows", "w", "p", "k"]
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("other") for c in clash})


def pandas(df):
    return df.toPandas()


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500 + k) for k in range(1, 60)]
    want = union_find(600, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == want[x] for x in range(600))


def test_fingerprint_by_the_letter():
    for text in ["", "  ", "One", "a b c", "A b\tC d e", " ".join(f"w{k % 50}" for k in range(700))]:
        words = text.lower().split()
        grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize(("radius", "trees"), [(4, 4), (4, 5), (7, 4), (7, 8)])
def test_shards_lose_no_pair(radius, trees):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * 2 + rng.integers(0, 2, 400, dtype=np.uint64)
    near = base[rng.integers(0, 400, 600)]
    for _ in range(radius):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    forest = simhash.fit_forest(fps[:256], 5000, radius // trees, trees, 16)
    row, shard, home = simhash.route(fps, forest)
    assert home.sum() == trees * len(fps) and (trees <= radius or home.all())
    seen, links = set(), set()
    for s in np.unique(shard):
        own = np.sort(row[shard == s])
        where = {r: bool(home[(shard == s) & (row == r)].any()) for r in own}
        root = simhash.link_shard(fps[own], np.array([where[r] for r in own]), radius, cells=2000)
        links |= {(own[k], own[root[k]]) for k in range(len(own)) if root[k] != k}
        seen |= {(a, b) for a in own if where[a] for b in own}
    close = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius) if j > i]
    assert close and all((i, j) in seen or (j, i) in seen for i, j in close)
    assert union_find(len(fps), links) == union_find(len(fps), close)


def test_op1_against_all_pairs(spark):
    got = pandas(queries.op1_simhash(spark, SMALL)).sort_values("doc_id")
    fps = np.array([int(x, 16) for x in got["fingerprint"]], np.uint64)
    links = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)]
    ids = got["doc_id"].tolist()
    assert got["component_id"].tolist() == [ids[r] for r in union_find(len(fps), links)]


def test_large_shards_are_cut_into_pairs_of_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    close = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4) if j > i]
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    at = {int(x): k for k, x in enumerate(fps)}
    for rows in (20, 100_000):
        got = [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, task_rows=rows).collect()]
        assert union_find(len(fps), got) == union_find(len(fps), close)


def test_components_of_a_hub_without_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    links = [(0, k) for k in range(1, 100_000)] + [(200_000, 99_999), (300_000, 300_001)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert got.groupBy("root").count().orderBy("root").collect() == [(0, 100_001), (300_000, 2)]


def test_simhash_of_odd_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(odd(spark)).collect()]
    assert len(got) == len(ODD)
    zero = "0" * 16
    assert sorted((i, c) for i, f, c in got if f == zero) == [(2, 2), (3, 2), (5, 2)]
    assert [c for i, f, c in got if i in (1, 6)] == [1, 1, 1]
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_token_spans_and_rules(spark):
    text = "Hé. Wörld 漢字😀! Yes"
    ids, first, after = tokencount.token_spans(text, vocabulary(BYTES), PATTERN)
    coder, sizes = tokencount.encoding(vocabulary(BYTES), PATTERN)
    assert coder.decode(ids.tolist()) == text and first[0] == 0 and after[-1] == len(text)
    starts, ends = np.array([0, 5]), np.array([5, 9])
    f, a = np.array([0, 3, 8]), np.array([3, 8, 12])
    assert tokencount.allocate(f, a, starts, ends, "first")[0].tolist() == [2, 1]
    assert tokencount.allocate(f, a, starts, ends, "most")[0].tolist() == [1, 2]
    assert tokencount.allocate(f, a, starts, ends, "split")[0].tolist() == pytest.approx([1.4, 1.6])


def test_token_counts_by_brute_force(spark):
    coder, sizes = tokencount.encoding(vocabulary(BYTES), PATTERN)
    for r in queries.op2_tokencount(spark, SMALL).join(queries.table(spark, SMALL, "documents"), "doc_id").collect():
        ids = coder.encode_ordinary(r["text"])
        owner = [k for k, s in enumerate(r["sections"]) for _ in range(s["start"], s["end"])]
        assert len(owner) == len(r["text"]) and r["n_tokens"] == len(ids)
        at, raw, want = 0, r["text"].encode(), Counter()
        for t in ids:
            a, b = len(raw[:at].decode(errors="ignore")), len(raw[: at + sizes[t]].decode(errors="ignore"))
            b = max(b, a + 1)
            votes = Counter(owner[a:b])
            want[min(votes, key=lambda k: (-votes[k], k))] += 1
            at += sizes[t]
        assert [s["tokens"] for s in r["sections"]] == [want[k] for k in range(len(r["sections"]))]


def test_token_counts_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in tokencount.attribute(odd(spark), vocabulary(BYTES), PATTERN, "split").collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[2]["sections"] == []
    assert all(sum(s["tokens"] for s in r["sections"]) + r["outside_tokens"] == pytest.approx(r["n_tokens"]) for r in got.values())
    own = spark.createDataFrame([(1, "abcdef ghi", [(0, 3), (3, 3), (5, 8)])], "doc_id int, text string, fields array<struct<start:int,end:int>>")
    r = tokencount.attribute(own, vocabulary(BYTES), PATTERN, "most", sections_col="fields").first()
    assert sum(s["tokens"] for s in r["sections"]) + r["outside_tokens"] == r["n_tokens"]
    assert tokencount.attribute(odd(spark).limit(0), vocabulary(BYTES), PATTERN).count() == 0


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 12):
        code = langid.codewords(n)
        d = (code[:, None] != code[None]).sum(2)[np.triu_indices(n, 1)]
        assert len(code) == n and d.min() >= code.shape[1] // 4 and d.min() > 0


def test_language_of_held_out_and_odd_rows(spark):
    got = pandas(queries.op3_langid(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id"))
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    own = got[got["held_out"]]
    assert (own["lang_pred"] == own["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = langid.train(odd(spark), F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(odd(spark), model).collect()}
    assert [found[k]["lang_pred"] for k in (2, 3, 5)] == ["und"] * 3 and found[1]["lang_pred"] != "und"
    assert langid.identify(odd(spark).limit(0), model).count() == 0
    assert langid.train(odd(spark).limit(0), F.lit(True)).score("words") == ("und", 0.0, True)


def test_bpe_equals_the_library_and_merges(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(WORDS))
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(4)
    parts = ["a", "th", "in", "'s", "'LL", "1", "é", "é", "İ", "ΣΑΣ", "漢字", "😀", "!?", "\x1c", "\x85", "\xa0", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|", "ing", "</w>", "\x00", "....", "aaaa"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)), *("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 80))) for _ in range(1500)), "ab" * 20_000]
    texts += [r["text"] for r in queries.table(spark, SMALL, "documents").collect()]
    mine = bpe.WordBpe(vocabulary(WORDS)).encode_batch([*texts, None])
    assert len(mine[-1]) == 0
    strings = bpe.load_strings(vocabulary(WORDS))
    for text, ids, want in zip(texts, mine, lib.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids
        assert bpe.decode_ids(ids, strings) == lib.decode(want.ids, skip_special_tokens=False)


def test_op4_digests(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(WORDS))
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SMALL, "documents").collect()}
    for r in queries.op4_bpe(spark, SMALL).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    tokens = bpe.encode(odd(spark), vocabulary(WORDS))
    assert tokens.count() == len(ODD) and bpe.decode(tokens, vocabulary(WORDS)).where("decoded = ''").count() == 3
    both = bpe.round_trip(odd(spark), vocabulary(WORDS), keep_ids=True)
    apart = bpe.digests(tokens.drop("text"), vocabulary(WORDS))
    assert sorted(map(repr, both.select(apart.columns).collect())) == sorted(map(repr, apart.collect()))
    assert both.where("n_tokens != size(ids)").count() == 0 and bpe.round_trip(odd(spark).limit(0), vocabulary(WORDS)).count() == 0


def test_licenses_equal_the_sql(spark):
    from oracle import compare

    assert compare(spark, "op5", queries.op5_licenses, licenses.oracle_sql(), SMALL) == ""


def test_licenses_in_every_place_and_odd_rows(spark):
    rng = random.Random(5)
    rows = []
    for name, text in licenses.TEMPLATES.items():
        for before in (0, 1, 3, 7, 50):
            rows.append((len(rows), " ".join(rng.choice(["the", "of", "und", "la"]) + str(rng.randrange(99)) for _ in range(before)) + "\n" + text.upper() + " tail words", name))
    found = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string, name string")).collect():
        found[r["doc_id"]].add(r["license"])
    assert all(name in found[i] for i, _, name in rows)
    twice = spark.createDataFrame([(1, rows[0][1], None), (1, rows[0][1], "x"), (None, rows[5][1], None)], "doc_id int, text string, license string")
    assert Counter(r["doc_id"] for r in licenses.scan(twice).where(F.col("license").isin(rows[0][2], rows[5][2])).collect()) == {1: 2, None: 1}
    assert licenses.scan(odd(spark)).count() == 0 and licenses.scan(odd(spark).limit(0)).count() == 0


def test_short_notices_are_never_missed(spark):
    """The shortest notice, of three shingles, among 3,000 sets of random neighbours; and changed texts by containment."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(k, " ".join(word() for _ in range(rng.randrange(20))) + " Released under the MIT License. " + " ".join(word() for _ in range(rng.randrange(20)))) for k in range(3000)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).where("license = 'MIT notice'")
    assert found.count() == 3000
    whole, changed = licenses.words_of(licenses.TEMPLATES["MIT whole text"]), []
    for k in range(300):
        w = whole.copy()
        for at in rng.sample(range(len(w)), 5):
            w[at] = word()
        changed.append((k, " ".join(w)))
    got = {r["doc_id"] for r in licenses.scan(spark.createDataFrame(changed, "doc_id int, text string")).where("license = 'MIT whole text'").collect()}
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert got == {k for k, t in changed if len(five(whole) & five(t.split())) >= 0.8 * len(five(whole))}


def test_quality_of_held_out_rows(spark):
    got = pandas(queries.op6_quality(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id"))
    own = got[got["held_out"]]
    good, bad = own[own["quality"] == 1]["score"].to_numpy(), own[own["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((own["score"] >= 0.3).astype(int) == own["predicted"]).all()


def test_network_gradients_and_odd_rows(spark):
    net = quality.Network(3)
    b = quality.to_bytes("some bytes to look at, " * 40)
    g, loss = net.gradients(b, 1)
    for k, place in ((2, 3), (0, (1, b[1], 2)), (1, 4)):
        p = net.params()[k]
        old = p[place]
        p[place] = old + 1e-2
        up = net.gradients(b, 1)[1]
        p[place] = old - 1e-2
        down = net.gradients(b, 1)[1]
        p[place] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][place]), abs=2e-3)
    assert quality.Network(3).score("x" * 1000) == pytest.approx(1 / (1 + np.exp(-quality.Network(3).logit(quality.Network(3).halves(quality.to_bytes("x" * 1000))))))
    assert quality.score(odd(spark), net).where("score BETWEEN 0 AND 1").count() == len(ODD)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    big = centres[0] + 0.02 * rng.normal(size=(150, 16))
    near = centres[rng.integers(0, 30, 200)] + 0.05 * rng.normal(size=(200, 16))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(np.concatenate([big, near, near[:20]]))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, rows[0][1], None), (n + 4, [1.0, None] * 8, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [], 1), (n + 7, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    m = np.array([v for _, v, _ in rows[:n]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in rows[:n]])
    close = (m @ m.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(close, False)
    root = union_find(n, zip(*np.nonzero(close)))
    assert [got[k]["n_links"] for k in range(n)] == close.sum(1).tolist()
    assert [got[k]["component_id"] for k in range(n)] == root
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(n, len(rows)))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def links_by_brute_force(rows, cosine=0.98):
    """(id, links, component) of (id, vector, label) rows of usable vectors."""
    m = np.array([v for _, v, _ in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in rows])
    close = (m @ m.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(close, False)
    root = union_find(len(rows), zip(*np.nonzero(close)))
    low = {}
    for (i, _, _), r in zip(rows, root):
        low[r] = min(i, low.get(r, i))
    return Counter((i, int(n), low[r]) for (i, _, _), n, r in zip(rows, close.sum(1), root))


def test_vectors_of_repeated_ids_keep_their_links(spark):
    v, w = [1.0, 0.0, 0.001], [1.0, 0.002, 0.0]
    rows = [(1, v, 0), (1, w, 0), (2, v, 0), (3, [0.0, 1.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == links_by_brute_force(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op7_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.table(spark, sf, "embeddings").collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op7_vectors(spark, sf).collect())
    assert got == links_by_brute_force(rows)


@pytest.mark.parametrize("centre", [0.0, 1.0, 6.0])
def test_recall_of_lone_pairs_in_a_concentrated_label(spark, centre):
    """Vectors whose mean cosine is about 0, 0.5 and 0.97, with lone pairs at 0.98 to 0.99 among them."""
    rng = np.random.default_rng(10)
    n, dim = 3000, 32
    base = rng.normal(size=(n, dim)) / np.sqrt(dim)
    base[:, 0] += centre
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:300] + 0.15 * rng.normal(size=(300, dim)) / np.sqrt(dim)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, got = links_by_brute_force(rows), Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect())
    linked = Counter({k: n for k, n in want.items() if k[1]})
    assert linked and sum((linked & got).values()) >= 0.95 * sum(linked.values())
    assert sum(n * k[1] for k, n in got.items()) <= sum(n * k[1] for k, n in want.items())


def test_chat_round_trip(spark):
    control = ["### ", "</turn>", "\\", "\n", "### assistant: ", ":", "x", "\\###", "é😀", ""]
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            shared = t < 2 and c % 3
            rows.append((c, t, "same" if shared else rng.choice(["user", "assistant", None, "odd: role\\"]), f"common {t}" if shared else rng.choice([None, "".join(rng.choice(control) for _ in range(8))])))
    rows += [(99, 0, "assistant", "a"), (99, 0, "assistant", "a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    nodes, members = chat.pack(df, vocabulary(BYTES), PATTERN)
    nodes = nodes.cache()
    want = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.read_back(nodes, members, vocabulary(BYTES), PATTERN).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
        assert got[c]["formatted_chars"] == sum(len(chat.format_turn(r, x)) for r, x in turns)
    prefixes = {tuple(turns[: k + 1]) for turns in want.values() for k in range(len(turns))}
    stream = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(stream) == len(prefixes)
    by, stack, end = {r["node"]: r for r in stream}, [], 0
    for r in stream:
        assert r["start"] == end and len(stack[: r["depth"]]) == r["depth"]
        stack = stack[: r["depth"]]
        assert r["parent"] == (stack[-1] if stack else None)  # depth first
        seen, k = set(), r["node"]
        while k is not None:
            seen |= set(range(by[k]["start"], by[k]["start"] + by[k]["n_tokens"]))
            k = by[k]["parent"]
        assert seen == {x for i in r["attends"] for x in range(i["start"], i["end"])}
        assert r["position"] == len(seen) - r["n_tokens"]
        stack.append(r["node"])
        end += r["n_tokens"]
    assert chat.pack(df.limit(0), vocabulary(BYTES), PATTERN)[0].count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 500, 300).astype(float)
    pi = np.full(300, 0.37)
    out = mixing.flight(pi, size, 9)
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert set(np.unique(mixing.land(out[(out > 0) & (out < 1)], size[(out > 0) & (out < 1)]))) <= {0.0, 1.0}


def test_mixture_targets_and_totals(spark):
    first, again = (pandas(queries.op9_mixing(spark, "/root/testdata/sf0.01")).sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert first.equals(again)
    docs = pandas(queries.table(spark, "/root/testdata/sf0.01", "documents")).sort_values("doc_id")
    assert first["size"].tolist() == [len(x.encode().split()) for x in docs["text"]]
    first["source"] = docs["source"].tolist()
    per = first.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), widest=("size", "max")).sort_index()
    cap, weight, total = 2.0 * per["size"].to_numpy(), np.array([(3, 1, 2)[k % 3] for k in range(len(per))], float), 1.5 * per["size"].sum()
    free, want = np.ones(len(per), bool), None
    while want is None or (free & (want > cap)).any():
        free &= True if want is None else ~(want > cap)
        want = np.where(free, (total - cap[~free].sum()) * weight / weight[free].sum(), cap)
    assert per["target"].to_numpy() == pytest.approx(want)
    assert ((per["taken"] - per["target"]).abs() <= 2 * per["widest"]).all()
    assert (first["taken"] <= 2 * first["size"]).all()
    got = [tuple(r) for r in mixing.mix(odd(spark)).select("doc_id", "size", "taken").collect()]
    assert len(got) == len(ODD) and all(t <= 2 * s for _, s, t in got)
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def naive_digest(text, pairs):
    """The features of a text in order, window by window, and its Bloom filters as sets of bits."""
    raw, w = text.encode(), digest.WINDOW
    n = len(raw) - w + 1
    rank = [(sum(pairs[raw[k + j] << 8 | raw[k + j + 1]] for j in range(w - 1)), -k) for k in range(n)]
    found = []
    for k in range(n):
        if rank[k] == max(rank[max(0, k - digest.REACH) : k + digest.REACH + 1]) and raw[k : k + w] not in found:
            found.append(raw[k : k + w])
    if n < 1 and raw:
        found = [raw]
    chain = []
    for k, own in enumerate(found):
        if k % digest.FEATURES == 0:
            chain.append(set())
        mask = 2**64 - 1
        if n < 1:
            h = xxhash.xxh64_intdigest(own)
        else:
            h = int.from_bytes(own, "little") + 0x632BE59BD9B4E019 & mask
            h = (h ^ h >> 31) * 0x9FB21C651E98DF25 & mask
            h ^= h >> 29
        chain[-1] |= {h >> 11 * j & digest.BITS - 1 for j in range(digest.HASHES)}
    return chain


def naive_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            chance, full = len(x) * len(y) / digest.BITS, min(len(x), len(y))
            low = chance + digest.CUT * (full - chance)
            best = max(best, min(1.0, max(0.0, (len(x & y) - low) / (full - low))))
        total += best * len(x)
    return total / sum(map(len, a))


def test_op10_by_brute_force(spark):
    docs = pandas(queries.table(spark, SMALL, "documents")).sort_values("doc_id", ascending=False)
    got = pandas(queries.op10_fingerprints(spark, SMALL)).set_index("doc_id").loc[docs["doc_id"]]
    texts = docs["text"].tolist()
    counts = Counter(p for t in texts for p in zip(t.encode(), t.encode()[1:]))
    sums = Counter()
    for (a, _), n in counts.items():
        sums[a] += n
    pairs = [min(4096, round(-16 * np.log2((counts[a, b] + 0.5) / (sums[a] + 128)))) for a in range(256) for b in range(256)]
    assert pairs == digest.surprisal(queries.table(spark, SMALL, "documents")).tolist()
    for k, (text, after) in enumerate(zip(texts, [*texts[1:], texts[0]])):
        mixed = digest.edited_text(text, after)
        third = len(text) // 3
        assert mixed == text[: len(text) - third] + after[:third]
        r = got.iloc[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(mixed.encode()).hexdigest()
        if len(text) > 6000 or len(after) > 6000:
            continue  # windows one by one take long
        own, other, following = (naive_digest(t, pairs) for t in (text, mixed, after))
        for name, chain in (("fingerprint", own), ("edited_fingerprint", other)):
            assert [set(np.flatnonzero(x)) for x in digest.from_text(r[name])[0]] == chain
        assert r["near_edited"] == pytest.approx(naive_likeness(own, other), abs=1e-5) and r["near_next"] == pytest.approx(naive_likeness(own, following), abs=1e-5)
    long = got[got["n_chars"] > 200]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.97
    same = got.assign(text=texts).groupby("text")["fingerprint"].nunique()
    assert (same == 1).all()


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    docs = odd(spark)
    bits = digest.surprisal(docs)
    key = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    for length in (1000, 1):
        monkeypatch.setattr(digest, "LENGTH", length)
        got = digest.neighbour_likeness(docs, bits).collect()
        assert len(got) == len(ODD)
        order = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0), key(x[1])))
        want = Counter((i, hashlib.sha256(digest.edited_text(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
        assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}) == 1
    assert digest.neighbour_likeness(docs.limit(0), bits).count() == 0
    alone = digest.neighbour_likeness(docs.where("doc_id = 6"), bits).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == pytest.approx(1.0)


def test_turns_of_equal_number_and_a_shared_start(spark):
    """Texts tied in turn and role are all kept, in one order for all conversations and reruns; a start that many
    conversations share is one node."""
    rows = [(c, t, "user", x) for c in range(40) for t, x in ((0, "start"), (1, "b"), (1, "a"), (2, f"own {c}"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for part in (df, df.orderBy(F.col("text").desc()).repartition(3)):
        nodes, members = chat.pack(part, vocabulary(BYTES), PATTERN)
        assert nodes.count() == 3 + 40 and nodes.agg(F.max("conversations")).first()[0] == 40
        got = chat.read_back(nodes, members, vocabulary(BYTES), PATTERN).collect()
        found.append({r["conv_id"]: [t["text"] for t in r["turns"]] for r in got})
    assert found[0] == found[1]
    assert all(x[0] == "start" and sorted(x[1:3]) == ["a", "b"] and x[3:] == [f"own {c}"] for c, x in found[0].items())


def test_op8_digests_and_the_hostile_conversation(spark):
    """Every registered column from the raw rows, conversation -7 of control strings included."""
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in queries.table(spark, SMALL, "conversations").collect()]
    rows += [(-7, 0, "user", queries.HOSTILE), (-7, 1, "assistant", queries.HOSTILE)]
    assert queries.HOSTILE == "\\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows):
        turns[c].append((role, text))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op8_chat(spark, SMALL).collect()
    assert len(got) == len(turns)
    for r in got:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == sum(len(chat.format_turn(role, t)) for role, t in own)


def test_op3_model_and_scores_by_brute_force(spark):
    """Counts, weights and decoding, one n-gram and one bit at a time."""
    rows = pandas(queries.table(spark, SMALL, "documents"))
    model = langid.train(queries.table(spark, SMALL, "documents"), queries.fold(4) != 2)

    def grams(text):
        raw = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        for a, b, c in zip(b" " + raw, raw + b" ", raw[1:] + b"  "):
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            yield ((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 19

    def trigrams(text):
        return list(grams(text))[: len(text.lower().encode())]

    counts = defaultdict(Counter)
    for i, text, lang in zip(rows["doc_id"], rows["text"], rows["lang"]):
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang and any(map(str.isalpha, text)):
            counts[lang].update(trigrams(text))
    langs = sorted(counts)
    assert model.langs == langs
    share = {x: {g: (counts[x][g] + 0.05) / (sum(counts[x].values()) + 0.05 * langid.BUCKETS) for g in range(langid.BUCKETS)} for x in langs}
    weights, strengths = [], []
    for bit in range(model.code.shape[1]):
        one, other = ([x for x, c in zip(langs, model.code[:, bit]) if (c > 0) == side] for side in (True, False))
        mean = lambda own, g: sum(share[x][g] for x in own) / len(own)
        w = [np.log(mean(one, g) / mean(other, g)) for g in range(langid.BUCKETS)]
        weights.append(w)
        strengths.append(sum((mean(one, g) - mean(other, g)) * w[g] for g in range(langid.BUCKETS)))
    assert model.weights == pytest.approx(np.array(weights).T)
    strengths = np.array(strengths) / np.mean(strengths)
    for text in [*rows["text"][:40], "x", "é"]:
        own = trigrams(text)
        losses = [sum(s * np.log1p(np.exp(-c * np.clip(sum(w[g] for g in own) / np.sqrt(len(own)), -12, 12))) for c, w, s in zip(code, weights, strengths)) for code in model.code]
        p = np.exp(min(losses) - np.array(losses))
        lang, score, _ = model.score(text)
        assert lang == langs[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), rel=1e-5)


def test_network_equals_a_plain_convolution():
    net = quality.Network(4)
    for text in ("", "ab", "some words " * 9, "é漢" * 400, "x" * 130_000 + "end"):
        b = np.concatenate([quality.to_bytes(text)])
        n = len(b) - quality.TAPS + 1
        z = np.maximum(sum(net.taps[k][b[k : k + n]].astype(np.float64) for k in range(quality.TAPS)) + net.bias, 0)
        starts = range(0, max(1, -(-n // quality.HALF) - 1) * quality.HALF, quality.HALF)
        chunks = np.array([z[a : a + 2 * quality.HALF].max(0) for a in starts])
        logit = np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.head + net.shift[0]
        assert net.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


def test_quality_of_odd_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (7, None), (6, 5), (None, 1), (99, 0)], "doc_id long, quality int").withColumn("text", F.lit("other"))
    net = quality.train(odd(spark), labels, F.lit(True))
    assert quality.score(odd(spark), net).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.score(odd(spark).limit(0), net).count() == 0
    one = quality.train(odd(spark), labels.where("quality = 1"), F.lit(True))
    none = quality.train(odd(spark), labels.limit(0), F.lit(True))
    assert one.score("x") > 0.9 and none.score("x") == 0.5


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    last = docs
    for name, stage in C.STAGES[:-1]:
        own = stage(spark, last, sf).cache()
        assert own.columns == docs.columns and own.join(last, "doc_id", "left_anti").count() == 0, name
        last = own
    kept = last.count()
    tokens = C.STAGES[-1][1](spark, last, sf)
    assert tokens.count() == kept and tokens.where("n_tokens != size(ids)").count() == 0


def test_passes_run_where_they_are_cheaper(spark):
    """The registered table's labels, at every size, and labels of millions go through passes; only labels so dense that
    keys hardly part their vectors are compared whole, and no label's passes cost more than four times that."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        own = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("label IS NOT NULL AND embedding IS NOT NULL").toPandas()
        for _, rows in own.groupby("label"):
            m = np.stack(rows["embedding"].to_numpy()).astype(float)
            mean = (m / np.linalg.norm(m, axis=1, keepdims=True)).mean(0)
            assert vectors.passes_needed(len(m), 1 - mean @ mean, 0.98, 32, 0.01) > 0
    for n in (10, 1_000, 10**5, 10**7, 10**9):
        for spread in (1.0, 0.5, 0.03, 0.001):
            passes = vectors.passes_needed(n, spread, 0.98, 32, 0.01)
            whole = n / 2 + -(-n // vectors.BLOCK) * vectors.COPY
            assert passes * (32 + vectors.COPY) <= vectors.FAVOUR * whole
            assert passes or spread < 0.1 and n > 100


def test_training_rows_and_bytes_are_bounded(spark, monkeypatch):
    """An id on 3,000 rows gives one text, the same whatever the order of rows; long texts give none."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append(sorted((bytes(t), y) for t, y in zip(texts, labels))) or quality.Network())
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "short"), (3, "long " * 1000), (3, "fits"), (4, "long " * 1000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (1, 1)], "doc_id long, quality int")
    for own in (docs, docs.orderBy(F.desc("text"))):
        quality.train(own, labels, F.lit(True), rows_per_label=10, text_bytes=100)
    assert seen[0] == seen[1] and len(seen[0]) == 3 and [y for _, y in seen[0]].count(1) == 1


def test_special_tokens_of_any_spelling(tmp_path):
    """A vocabulary whose special tokens lack angle brackets still finds them in texts."""
    import json

    spec = json.loads(open(vocabulary(WORDS), encoding="utf-8").read())
    for token in spec["added_tokens"]:
        spec["model"]["vocab"].pop(token["content"], None)
        token["content"] = token["content"].replace("<|", "[[").replace("|>", "]]")
        spec["model"]["vocab"][token["content"]] = token["id"]
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    tokenizer = bpe.WordBpe(str(path))
    ids = tokenizer.encode_batch(["a [[endoftext]] b", "no special", "[[startoftext]]"])
    assert [49407 in x or 49406 in x for x in ids] == [True, False, True] and len(ids[2]) == 1
