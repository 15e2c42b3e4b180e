"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' byte lengths give their spans of characters, and a merge of those
spans with the sections' spans (both in order, so a binary search per boundary) says which sections a token touches. A
token that crosses a boundary is allocated by rule:

- ``first``: to the section of its first character that lies in any section;
- ``most``: to the section with most of its characters, the earlier one if equal;
- ``split``: to each section by its share of the token's characters in sections.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What ends a sentence: marks with white space after them, or line breaks.
BREAK = re.compile(r"[.!?]+\s+|\n+")
RULES = ("first", "most", "split")
_encodings: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of byte ranks, and the bytes in each token; kept for a worker's later tasks."""
    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first character, character after the last) of each token; a token inside a character spans all of it."""
    coder, sizes = encoding(path, pattern)
    ids = np.asarray(coder.encode_ordinary(text), np.int64)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(sizes[ids])
    if len(raw) == len(text):
        return ids, ends - sizes[ids], ends
    letter = np.cumsum((raw & 0xC0) != 0x80) - 1
    return ids, letter[ends - sizes[ids]], letter[ends - 1] + 1


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a text's sentences, each with the white space after it; a line break ends one as well."""
    ends = [m.end() for m in BREAK.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    at = np.array([0, *ends], np.int64)
    return at[:-1], at[1:]


def allocate(first: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """(tokens of each section, tokens that cross sections, tokens in none); sections are ordered and don't overlap."""
    got = np.zeros(len(starts))
    if not len(starts):
        return got, 0, len(first)
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, after, "left") - 1
    inside, crossing = low == high, np.flatnonzero(low < high)
    got += np.bincount(low[inside], minlength=len(starts))
    for k in crossing:
        i, j = low[k], high[k] + 1
        shared = np.minimum(ends[i:j], after[k]) - np.maximum(starts[i:j], first[k])
        if rule == "split":
            got[i:j] += shared / shared.sum()
        else:
            got[i if rule == "first" else i + int(shared.argmax())] += 1
    return got, len(crossing), int((low > high).sum())


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "most", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """docs with n_tokens, crossing_tokens, outside_tokens and sections added (columns of these names are replaced).

    sections is an array of structs (start, end, tokens) in characters: the given ones of sections_col (an array of
    structs start, end, in order, not overlapping, empty ones allowed) or else the text's sentences. Over sections and
    outside_tokens the counts add up to n_tokens. Null and empty texts have no tokens and no sections; repeated rows are
    counted each; an empty table stays empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    new = ["n_tokens", "crossing_tokens", "outside_tokens", "sections"]
    kept = docs.drop(*(x for x in new if x != sections_col))
    at = kept.columns.index(text_col)
    given = kept.columns.index(sections_col) if sections_col else -1
    keep = [k for k, name in enumerate(kept.columns) if name not in new]
    names = [*(kept.columns[k] for k in keep), *new]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                counts, parts, sizes = [], [], [0]
                for row in range(len(part)):
                    text = part.column(at)[row].as_py() or ""
                    _, first, after = token_spans(text, path, pattern)
                    if given < 0:
                        starts, ends = sentences(text)
                    else:
                        own = [(x["start"], x["end"]) for x in part.column(given)[row].as_py() or [] if x["start"] < x["end"]]
                        starts, ends = np.array([a for a, _ in own], np.int64), np.array([b for _, b in own], np.int64)
                    got, crossing, outside = allocate(first, after, starts, ends, rule)
                    counts.append((len(first), crossing, outside))
                    parts.append((starts, ends, got))
                    sizes.append(sizes[-1] + len(starts))
                table = np.array(counts, np.int64).reshape(-1, 3)
                flat = [np.concatenate([p[k] for p in parts]) for k in range(3)]
                structs = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float64())], fields=list(span))
                sections = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(table[:, k]) for k in range(3)), sections], names)

    fields = kept.select(*(kept.columns[k] for k in keep)).schema.simpleString()[len("struct<") : -1]
    added = "n_tokens:bigint,crossing_tokens:bigint,outside_tokens:bigint,sections:array<struct<start:bigint,end:bigint,tokens:double>>"
    return kept.mapInArrow(run, f"{fields},{added}")


def per_section(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each section: (id_col, section, start, end, tokens)."""
    return counted.select(id_col, F.posexplode("sections").alias("section", "x")).select(id_col, "section", "x.start", "x.end", "x.tokens")
