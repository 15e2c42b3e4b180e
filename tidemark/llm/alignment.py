"""Tokens of one text under two tokenizers, aligned at the byte offsets where tokens of both end.

Cumulative ends of tokens are put into one dictionary a tokenizer, from end to index. The keys that both hold, sorted,
cut the two lists of ids into groups; within a group every pair of tokens whose bytes overlap is a link. Texts are taken
in pieces that no token of either tokenizer crosses, so that groups never do, and a task aligns a piece that it has
seen only once. Counts of id pairs are summed over the corpus. Reading them back, the most frequent pairs, a table of stated size, are broadcast;
rows of all other pairs, none of which is frequent, are shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import by_bytes, cut, tidied

#: Frequent pairs that are broadcast, at most: 500,000 rows of four numbers.
FREQUENT = 500_000
#: Bytes of texts that are aligned at once; pieces that a task keeps, twice, and the code points of the longest of them.
AT_ONCE, KEPT_PIECES, KEPT_LENGTH = 1 << 20, 150_000, 48
#: A space that starts a piece: the one between something else and a letter, a digit or an underscore. Byte-level
#: patterns never put it behind anything, and no token of pieces has a space behind other characters (checked).
CUT = re.compile(r"(?<=[^ ]) (?=\w)")
_loaded: dict[str, object] = {}


class ByteLevel:
    """A tokenizer file of byte-level pieces; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.coder.no_truncation()
        self.coder.no_padding()
        self.cut = CUT
        to_byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = {x["id"]: x["content"].encode("utf-8") for x in spec["added_tokens"]}
        own |= {i: b"".join(map(to_byte.__getitem__, s)) for s, i in spec["model"]["vocab"].items() if all(c in to_byte for c in s)}
        self.bytes = [own.get(i, b"") for i in range(1 + max(own))]
        self.sizes = [len(x) for x in self.bytes]
        self.size_of = np.array(self.sizes, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A SentencePiece model, which puts a space before the text itself; <0xHH> is a byte, U+2581 a space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        strings = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.cut = None if any(re.search("[^▁]▁", s) for s in strings) else CUT
        self.bytes = [bytes([int(s[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode("utf-8") for s in strings]
        self.sizes = [len(x) for x in self.bytes]
        self.size_of = np.array(self.sizes, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def load(path: str) -> ByteLevel | Pieces:
    """A tokenizer by its file's kind, once a Python process."""
    if path not in _loaded:
        _loaded[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _loaded[path]


def common_stops(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of a, tokens of b) up to the end of each group, from the ends that both dictionaries hold."""
    index_a, index_b = (dict(zip(e.tolist(), range(1, len(e) + 1))) for e in (ends_a, ends_b))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (index_a, index_b))


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, place in b) of every link, in order.

    In a group with one token on a side all pairs overlap. In any other, a link is what lies between an end of either
    side and the end before it, so each such end gives one.
    """
    n_a, n_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    single = (n_a == 1) | (n_b == 1)
    width = np.maximum(n_a, n_b)[single]
    step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    link_a, link_b = (np.repeat((stop - n)[single], width) + np.where(np.repeat(n[single] > 1, width), step, 0) for stop, n in ((stops_a, n_a), (stops_b, n_b)))
    if not single.all():
        rest_a, rest_b = (e[np.repeat(~single, n)] for e, n in ((ends_a, n_a), (ends_b, n_b)))
        ends = np.union1d(rest_a, rest_b)
        link_a, link_b = np.append(link_a, np.searchsorted(ends_a, ends)), np.append(link_b, np.searchsorted(ends_b, ends))
        order = np.lexsort((link_b, link_a))
        link_a, link_b = link_a[order], link_b[order]
    return link_a, link_b


_INTS, _LONGS = ("array<int>", pa.list_(pa.int32())), ("array<bigint>", pa.list_(pa.int64()))
_COUNT = ("bigint", pa.int64())
NEW = {
    "n_a": _COUNT, "n_b": _COUNT, "n_groups": _COUNT, "n_links": _COUNT, "groups": ("string", pa.string()), "pairs": _LONGS, "pair_links": _INTS,
    "a_ids": _INTS, "b_ids": _INTS, "a_stops": _INTS, "b_stops": _INTS, "link_a": _INTS, "link_b": _INTS,
}
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Arrays of places, and the count that those of a later piece are moved on by.
_MOVED = {"a_stops": "n_a", "b_stops": "n_b", "link_a": "n_a", "link_b": "n_b"}


class Aligner:
    """Aligns whole texts; what it found for short pieces is kept for later texts."""

    def __init__(self, path_a: str, path_b: str, wanted: list[str]):
        self.a, self.b = load(path_a), load(path_b)
        self.wanted = [*_COUNTS, *(w for w in wanted if w not in _COUNTS and w != "pair_links")]
        self.cut = CUT if self.a.cut and self.b.cut else None
        self.kept: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        # a token as text with the mark that follows it
        self.written = [f"{i}{mark}" for c, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(c.bytes))] if "groups" in wanted else []

    def pieces(self, text: str | None) -> list[str]:
        """A text without the space before each piece; the first one's is what both tokenizers put before a text."""
        return [] if not text else self.cut.split(text) if self.cut else [text]

    def _texts(self, a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> list[str]:
        """All tokens as text, in order of groups, a's before b's."""
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        code_a, code_b = a.copy(), b + 2 * size_a
        code_a[stops_a - 1] += size_a
        code_b[stops_b - 1] += size_b
        group_a, group_b = (np.repeat(np.arange(len(s)), np.diff(s, prepend=0)) for s in (stops_a, stops_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, stops_b)[group_a]] = code_a
        codes[np.arange(len(b)) + stops_a[group_b]] = code_b
        return list(map(self.written.__getitem__, codes.tolist()))

    def _learn(self, pieces: list[str]) -> dict[str, tuple | None]:
        """What is wanted of each piece, or None where a tokenizer's bytes differ from it; all are aligned at once, as
        the ends of pieces are ends of groups."""
        raw = [b" " + p.encode("utf-8") for p in pieces]
        ids = [c.encode(pieces) for c in (self.a, self.b)]
        good = [True] * len(pieces)
        for c, own in zip((self.a, self.b), ids):
            if any(b"".join(map(c.bytes.__getitem__, chain.from_iterable(own[k : k + 64]))) != b"".join(raw[k : k + 64]) for k in range(0, len(own), 64)) or [sum(map(c.sizes.__getitem__, x)) for x in own] != list(map(len, raw)):
                good = [g and b"".join(map(c.bytes.__getitem__, x)) == r for g, x, r in zip(good, own, raw)]
        found: dict[str, tuple | None] = dict.fromkeys(pieces)
        own_a, own_b = ([x for x, g in zip(own, good) if g] for own in ids)
        if not own_a:
            return found
        n_a, n_b = (np.fromiter(map(len, own), np.int64, len(own)) for own in (own_a, own_b))
        a, b = (np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in ((own_a, n_a), (own_b, n_b)))
        ends_a, ends_b = np.cumsum(self.a.size_of[a]), np.cumsum(self.b.size_of[b])
        stops_a, stops_b = common_stops(ends_a, ends_b)
        link_a, link_b = links_of(ends_a, ends_b, stops_a, stops_b)
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        to_group, to_link = np.searchsorted(stops_a, to_a, "right"), np.searchsorted(link_a, to_a)
        columns: list[Iterator] = [iter(n_a.tolist()), iter(n_b.tolist()), iter(np.diff(to_group, prepend=0).tolist()), iter(np.diff(to_link, prepend=0).tolist())]

        def cut_up(values: np.ndarray, to: np.ndarray, start: np.ndarray | None = None) -> Iterator[np.ndarray]:
            first = [0] * len(to) if start is None else start.tolist()
            return (values[i:j] - s for i, j, s in zip([0, *to.tolist()], to.tolist(), first))

        for name in self.wanted[4:]:
            if name == "groups":
                texts, to = self._texts(a, b, stops_a, stops_b), (to_a + to_b).tolist()
                columns.append("".join(texts[i:j])[:-1] for i, j in zip([0, *to], to))
            elif name == "pairs":
                pairs, to = (a[link_a] << 32 | b[link_b]).tobytes(), (to_link * 8).tolist()
                columns.append(pairs[i:j] for i, j in zip([0, *to], to))
            else:
                columns.append({"a_ids": lambda: cut_up(a, to_a), "b_ids": lambda: cut_up(b, to_b), "a_stops": lambda: cut_up(stops_a, to_group, to_a - n_a), "b_stops": lambda: cut_up(stops_b, to_group, to_b - n_b), "link_a": lambda: cut_up(link_a, to_link, to_a - n_a), "link_b": lambda: cut_up(link_b, to_link, to_b - n_b)}[name]())
        found.update(zip((p for p, g in zip(pieces, good) if g), zip(*columns)))
        return found

    def align(self, texts: list[str | None]) -> list[dict]:
        """A row of the wanted columns for each text."""
        split = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:  # the last generation stays at hand while a new one fills
            self.older, self.kept = self.kept, {}
        needed = set(chain.from_iterable(split)) - self.kept.keys()
        again = needed & self.older.keys()
        self.kept.update({p: self.older[p] for p in again})
        found = self._learn(list(needed - again)) if len(needed) > len(again) else {}
        long = {p: x for p, x in found.items() if len(p) > KEPT_LENGTH}
        self.kept.update({p: x for p, x in found.items() if p not in long} if long else found)
        known = self.kept | long if long else self.kept
        return [self._joined(list(map(known.__getitem__, own))) for own in split]

    def _joined(self, parts: list[tuple | None]) -> dict:
        if None in parts:
            parts = []
        columns = list(zip(*parts)) or [()] * len(self.wanted)
        row: dict[str, object] = {name: sum(own) for name, own in zip(_COUNTS, columns)}
        for name, own in zip(self.wanted[4:], columns[4:]):
            if name == "groups":
                row[name] = ";".join(own)
            elif name == "pairs":
                row[name], row["pair_links"] = np.unique(np.frombuffer(b"".join(own), np.int64), return_counts=True)
            else:
                flat = np.concatenate(own) if own else np.empty(0, np.int64)
                if name in _MOVED:
                    sizes = np.array(columns[_COUNTS.index(_MOVED[name])], np.int64)
                    flat = flat + np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in own]) if own else flat
                row[name] = flat
        return row


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", returned: list[str] | None = None) -> DataFrame:
    """docs with the alignment of every whole text (columns of these names are replaced), or with a choice of its columns.

    a_ids, b_ids; a_stops and b_stops, how many tokens of each lie up to the end of every group; link_a and link_b, the
    places of both tokens of every link; groups, their ids as text (`a1,a2|b1;a3|b2,b3`); n_a, n_b, n_groups, n_links;
    pairs and pair_links, the text's distinct linked pairs (a * 2**32 + b) and the links of each.
    Texts that are null, empty, or not given back byte for byte (after one space) by both tokenizers have no tokens: empty
    arrays, an empty text and zeros. Repeated rows are aligned each; an empty table stays empty.
    """
    names_out = list(returned or NEW)
    kept = docs.drop(*NEW)
    at, names = kept.columns.index(text_col), [*kept.columns, *names_out]
    wanted = ["pairs" if k == "pair_links" and "pairs" not in names_out else k for k in names_out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, wanted)
        for batch in batches:
            for part in by_bytes(batch, AT_ONCE):
                rows = aligner.align(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[k] for r in rows], NEW[k][1]) for k in names_out)], names)

    schema = kept.schema.simpleString()[len("struct<") : -1]
    return kept.mapInArrow(tidied(run), ",".join([schema, *(f"{k}:{NEW[k][0]}" for k in names_out)]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): links of every id pair over all rows of align's pairs and pair_links, and whether no pair of
    the same b has more. A b has at most as many rows as a's vocabulary has ids."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pair_links").alias("links"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return rows.withColumn("best", F.col("links") == F.max("links").over(of_b))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least number of links, a power of two, that at most so many pairs have: only sizes by power are counted."""
    sizes = counts.groupBy(F.floor(F.log2("links")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, power = 0, 62
    for row in sorted(sizes, key=lambda r: -r["power"]):  # 63 rows at most
        if (total := total + row["n"]) > most:
            break
        power = row["power"]
    return 1 << power


def link_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """docs, text_col replaced by n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair has the most links
    of its b over all docs, ties included) and count_sum (the links of its pair over all docs, summed over links).

    Without tokens they are 0 and ''. Rows are told apart by a number they get when the alignment is written, so ids may
    be null or repeated. An empty table stays empty.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    x = align(docs.drop(*new, "_row"), path_a, path_b, text_col, ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    x = cut(x.withColumn("groups_sha256", digest).drop(text_col, "groups").withColumn("_row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(x))
    least = frequent_from(counts, frequent)
    often, seldom = F.broadcast(counts.where(F.col("links") >= least)), counts.where(F.col("links") < least)
    rows = x.select("_row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("own"))
    found = rows.join(often, "pair").unionByName(rows.join(often, "pair", "left_anti").join(seldom.hint("merge"), "pair"))
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("own")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("own") * F.col("links")).cast("long").alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return x.drop("pairs", "pair_links").join(sums.hint("merge"), "_row", "left").withColumns(zero).drop("_row")
