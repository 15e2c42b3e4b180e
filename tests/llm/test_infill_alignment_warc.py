"""Fill-in-middle cuts, cross-tokenizer alignment and WARC bundles against brute force, SQL and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from oracle import compare
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from test_llm import DOCS, ODD, SMALL, odd

from tidemark.llm import alignment, infill, queries, warc

A, B = vocabulary(queries.BYTE_VOCABULARY), vocabulary(queries.PIECES)
ODDER = [*ODD, (8, "a <P> mark", "en", "s", 10), (9, "<<S", None, None, 3), (10, "x" * 50_000 + "\n\t  y" + "é" * 3_000, "en", "s", 1), (11, "\x1c lone▁piece", "en", "s", 1), (12, " leading  and \x00 trailing ", "en", "s", 1)]


def test_index_gives_every_offset(spark):
    rng = random.Random(4)
    texts = ["", "a", "!", "ab cd", "x" * 500 + " " * 500 + "ab " * 900, "".join(rng.choice("aZ é\n<9") for _ in range(3_000)), " ".join("w" * rng.choice([1, 3, 400]) for _ in range(800))]
    for error in (0, 7, infill.ERROR):
        for text in texts:
            want = [0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text))]
            offsets = infill.boundaries(text)
            assert offsets.tolist() == want
            segments, left = infill.fit(offsets, error)
            assert np.abs(left).max() <= error + 1 and segments[0][0] == 0
            assert len(segments) < max(3, len(want) / 2) or error < infill.ERROR
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = infill.boundary_index(docs).withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("boundaries.units"))))
    got = ranks.select("doc_id", "rank", infill.offset_at(F.col("boundaries"), F.col("rank")).alias("at")).collect()
    want = [[0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t))] for t in texts]
    assert len(got) == sum(map(len, want)) and all(want[r.doc_id][r["rank"]] == r.at for r in got)


def filled(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, i), (i, j), (j, None)))
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_infill_of_odd_rows_by_brute_force(spark):
    """Nulls anywhere, no text, marks and halves of marks, very long runs, repeated rows; names that clash."""
    docs = spark.createDataFrame(ODDER, DOCS).withColumns({"form": F.lit("x"), "output": F.lit("y"), "boundaries": F.lit("z")})
    cut = infill.transform(docs)
    assert set(docs.columns) <= set(cut.columns) and cut.where("boundaries = 'z'").count() == len(ODDER)
    got = Counter((r.doc_id, r.units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in cut.collect())
    assert got == Counter((i, *filled(i, t or "")) for i, t, *_ in ODDER)
    assert cut.where(infill.restore(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert infill.transform(docs.limit(0)).count() == 0
    other = {r.doc_id: r.prefix_chars for r in infill.transform(docs, epoch=2).collect()}
    assert any(other[r.doc_id] != r.prefix_chars for r in cut.collect())


def test_marks_at_the_cuts(spark):
    """Parts that end or begin with parts of marks are still told apart."""
    bits = ["<", "P>", "S>", "M>", "<P", "<S", "<M", ">", "a", "<<"]
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(2_000)], "doc_id long, text string")
    cut = infill.transform(docs)
    assert cut.where("form <> 'plain'").count() > 300
    assert cut.where(infill.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert Counter(tuple(r) for r in cut.select("doc_id", "units", "form", "prefix_chars", "middle_chars", "output").collect()) == Counter((r.doc_id, *filled(r.doc_id, r.text)) for r in docs.collect())


@pytest.mark.parametrize("name", ["op11_infill", "op13_warc"])
def test_same_rows_as_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SMALL) == ""


def plain_alignment(text):
    """(ids of A, ids of B, groups, links), from the libraries on the whole text and plain loops."""
    coders = alignment.load(A), alignment.load(B)
    a, b = ([] if not text else c.encode([text])[0] for c in coders)
    raw = (" " + (text or "")).encode()
    if any(b"".join(c.bytes[i] for i in x) != raw for c, x in zip(coders, (a, b))):
        return [], [], [], []
    spans = []
    for c, x in zip(coders, (a, b)):
        at, own = 0, []
        for i in x:
            own.append((at, at + len(c.bytes[i])))
            at = own[-1][1]
        spans.append(own)
    groups, ga, gb, j = [], [], [], 0
    ends_b = {e: k for k, (_, e) in enumerate(spans[1])}
    for k, (_, e) in enumerate(spans[0]):
        ga.append(a[k])
        if e in ends_b:
            gb = b[j : ends_b[e] + 1]
            groups.append((ga, gb))
            ga, j = [], ends_b[e] + 1
    links, low = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][low][1] <= s:
            low += 1
        k = low
        while k < len(b) and spans[1][k][0] < e:
            links.append((i, k))
            k += 1
    return a, b, groups, links


def as_text(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def counted(rows):
    """Rows of op12 by brute force: (doc_id, text) with digests and counts over all of them."""
    all_rows = [(i, *plain_alignment(t)) for i, t in rows]
    counts = Counter((a[i], b[j]) for _, a, b, _, links in all_rows for i, j in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, a, b, groups, links in all_rows:
        own = [counts[a[x], b[y]] for x, y in links]
        digest = hashlib.sha256(as_text(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), digest, sum(n == top[b[y]] for n, (_, y) in zip(own, links)), sum(own)))
    return Counter(out)


def fuzz(n, seed):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t ", "the", "The", "ing", "'s", "don't", "漢字", "é", "é", "😀", "x" * 30, "3", "1 000", "_", "<s>", "<|endoftext|>", "<0x41>", ".", "...", " ", " ", "\x1c", "ß", "ﬁ", "Ⅷ", "़"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_alignment_by_brute_force(spark):
    """Whole texts by the libraries: pieces, groups and links of fuzzed and odd texts, with few kept pieces and many."""
    texts = [*fuzz(1_500, 6), *(t for _, t, *_ in ODDER)]
    aligner = alignment.Aligner(A, B, list(alignment.NEW))
    for at in range(0, len(texts), 100):
        for text, row in zip(texts[at : at + 100], aligner.align(texts[at : at + 100])):
            a, b, groups, links = plain_alignment(text)
            assert (row["a_ids"].tolist(), row["b_ids"].tolist()) == (a, b), repr(text)
            assert row["groups"] == as_text(groups) and (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (len(a), len(b), len(groups), len(links))
            assert list(zip(row["link_a"].tolist(), row["link_b"].tolist())) == links
            assert row["a_stops"].tolist() == np.cumsum([len(x) for x, _ in groups]).astype(int).tolist() and row["b_stops"].tolist() == np.cumsum([len(y) for _, y in groups]).astype(int).tolist()
            assert dict(zip(row["pairs"].tolist(), row["pair_links"].tolist())) == Counter(a[i] << 32 | b[j] for i, j in links)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("frequent", [0, 40, alignment.FREQUENT])
def test_link_counts_of_odd_rows(spark, frequent, monkeypatch):
    """The same counts whether pairs are read back by broadcast, by a shuffle, or some by each."""
    monkeypatch.setattr(alignment, "KEPT_PIECES", 3)
    docs = odd(spark).select("*", F.lit(1).alias("n_a"), F.lit(1).alias("pairs"), F.lit(1).alias("_row"))
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(fuzz(60, 7))], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = alignment.link_counts(both, A, B, frequent=frequent)
    assert Counter(tuple(r) for r in got.select(NAMES).collect()) == counted([(r.doc_id, r.text) for r in both.collect()])
    assert alignment.link_counts(docs.limit(0), A, B, frequent=frequent).count() == 0


def test_frequent_pairs_are_bounded(spark):
    counts = spark.range(1, 1001).select(F.col("id").alias("pair"), (F.lit(1000) / F.col("id")).cast("long").alias("links"))
    for most in (0, 1, 10, 500, 5000):
        least = alignment.frequent_from(counts, most)
        assert counts.where(F.col("links") >= least).count() <= most


def test_op12_by_brute_force(spark):
    got = Counter(tuple(r) for r in queries.op12_alignment(spark, SMALL).select(NAMES).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == counted([(r.doc_id, r.text) for r in docs])


PAGES = [
    (5, "http://a.example/1", "<p>same</p>"), (3, "http://a.example/2", "<p>same</p>"), (3, "http://a.example/2", "<p>same</p>"), (None, "http://a.example/3", "<p>same</p>"), (None, None, None),
    (7, " odd\r\nWARC-Type: x é ", ""), (8, "http://é.example/%41?q=漢", "WARC/1.1\r\n\r\n\r\n\r\n"), (9, "", "é" * 40_000), (9, "u", "other text of the same id"), (10, "u", "\r\n"),
]


def frame_by_frame(folder, name):
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        raw = f.read()
    return raw, warc.seek_table(system, f"{path}/{name}")


@pytest.mark.parametrize(("frame_bytes", "bundle_bytes"), [(1, 1), (700, 2_000), (warc.FRAME_BYTES, warc.BUNDLE_BYTES)])
def test_warc_round_trip_of_odd_pages(spark, frame_bytes, bundle_bytes):
    """Nulls, repeated rows and ids, texts that look like records, urls that no header line holds; clashing columns."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "key": F.lit("k"), "row": F.lit(2), "record_id": F.lit("r")})
    folder, catalog = warc.write(pages, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    read = warc.read(folder, catalog)
    rows = {r.record_id: r for r in read.collect()}
    assert len(rows) == len(PAGES) and Counter((r.page_id, r.url) for r in rows.values()) == Counter((i, u) for i, u, _ in PAGES)
    whole = lambda r: bytes((r if r.record_type == "response" else rows[r.refers_to_record]).payload).decode()
    assert Counter((r.page_id, r.url, whole(r)) for r in rows.values()) == Counter((i, u, t or "") for i, u, t in PAGES)
    assert Counter(whole(r) for r in rows.values() if r.record_type == "response") == Counter({t or "" for _, _, t in PAGES})
    found = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(read).collect())
    first = {t or "": min((i for i, _, u in PAGES if (u or "") == (t or "")), key=lambda i: (i is None, i)) for _, _, t in PAGES}
    want, given = Counter(), set()
    for i, _, t in sorted(PAGES, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (t or "").encode()
        revisit = t in given or (t or "") in given
        given.add(t or "")
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[t or ""] if revisit else None] += 1
    assert found == want
    # the catalog leads to each record, within its own frame
    entries = catalog.collect()
    assert {r.record_id for r in entries} == rows.keys()
    for name in {r.bundle for r in entries}:
        raw, table = frame_by_frame(folder, name)
        parts = [zstandard.ZstdDecompressor().decompress(raw[s : s + c]) for s, c, _ in table]
        assert [len(p) for p in parts] == [d for _, _, d in table]
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(parts)
        for r in (r for r in entries if r.bundle == name):
            record = parts[r.frame][r.start : r.start + r.length]
            assert record.startswith(b"WARC/1.1\r\n") and f"<{r.record_id}>".encode() in record and record.endswith(b"\r\n\r\n")
            assert (r.frame_start, r.frame_bytes) == table[r.frame][:2]
    wanted = [*list(rows)[:3], list(rows)[0], None, "urn:uuid:none"]
    some = warc.lookup(folder, catalog, spark.createDataFrame([(w,) for w in wanted], "record_id string")).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(rows[w]) for w in list(rows)[:3])
    if frame_bytes == 1:
        assert len({(r.bundle, r.frame) for r in entries}) == len(PAGES)


def test_warc_sizes_and_empty_tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = Counter(r.record_type for r in warc.resolved(warc.read(*warc.write(pages, min_bytes=12))).collect())
    assert kinds == {"response": len(PAGES)}
    folder, catalog = warc.write(pages.limit(0))
    assert catalog.count() == 0 and warc.resolved(warc.read(folder, catalog)).count() == 0


def test_bundles_of_lost_tasks_are_not_read(spark):
    """What is in the folder but in no catalog stays unread; a damaged payload is an error."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder, catalog = warc.write(pages)
    warc.write(pages, folder=folder)
    assert warc.read(folder, catalog).count() == len(PAGES)
    record = warc.encode_record("urn:uuid:1", 1, "u", b"payload", None, "2000-01-01T00:00:00Z").replace(b"payload\r\n", b"paylord\r\n")
    (_, _, headers, block), = warc.decode_records(record)
    with pytest.raises(ValueError):
        warc._record(headers, block)
