"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique, and a token may follow another exactly if the
pair, merged on its own, stays that pair. So each prefix needs one token only: of the vocabulary's tokens that end
there (the suffix links of an automaton over the vocabulary list them, longest first) the one that is compatible with
the last token of the prefix before it. Following those back from the end of the word gives its ids. All words of a
batch advance together, one byte at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidied

END = "</w>"
NEVER = np.int64(1 << 40)
#: Distinct pieces of text whose ids a task keeps, twice: those of now and those of the time before.
KEPT_PIECES = 200_000
_SLOTS = 1 << 18


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from 256 upwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file with word-end merges: its words are split by a pattern, lower-cased, and merged bytewise."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = len(token_strings(spec))
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(patterns[0].replace(r"\s", r"\p{White_Space}"))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._merge_tables(vocab, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges])
        self._automaton(vocab)
        self._pair_key = np.full(_SLOTS, -1, np.int64)
        self._pair_fits = np.zeros(_SLOTS, bool)

    def _merge_tables(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = self.size
        rank = np.full(n + 1, -1, np.int64)
        left, right = {i: [i] for i in range(n)}, {i: [i] for i in range(n)}
        keys = np.empty(len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            i, a, b = vocab[a + b], vocab[a], vocab[b]
            keys[k], rank[i] = a * n + b, k
            left[i], right[i] = [*left[a], i], [*right[b], i]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], order.astype(np.int64)
        rank[n] = NEVER  # beyond the top of a spine
        self.rank = rank
        self.left = np.full((n, 1 + max(map(len, left.values()))), n, np.int64)
        self.right = np.full((n, 1 + max(map(len, right.values()))), n, np.int64)
        for i in range(n):
            self.left[i, : len(left[i])] = left[i]
            self.right[i, : len(right[i])] = right[i]

    def _automaton(self, vocab: dict[str, int]) -> None:
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.base = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.base_end = np.array([vocab[c + END] for c in byte_letters()], np.int64)
        trie: list[dict[int, int]] = [{}]
        plain, ends = {}, {}
        self.length = np.ones(self.size, np.int64)
        for s, i in vocab.items():
            body, own = (s[: -len(END)], ends) if s.endswith(END) and s != END else (s, plain)
            if s in self.special or not all(c in to_byte for c in body):
                continue
            node = 0
            for c in body:
                b = to_byte[c]
                if b not in trie[node]:
                    trie[node][b] = len(trie)
                    trie.append({})
                node = trie[node][b]
            own[node], self.length[i] = i, len(body)
        used = sorted({b for t in trie[1:] for b in t} | {b for b, k in trie[0].items() if trie[k]})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        step = np.zeros((len(trie), len(used) + 1), np.int32)
        fail = np.zeros(len(trie), np.int64)
        self.longest, self.longest_end = np.full(len(trie), -1, np.int64), np.full(len(trie), -1, np.int64)
        self.shorter, self.shorter_end = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        level = [0]
        while level:
            below = []
            for node in level:
                f = fail[node]
                self.longest[node] = plain.get(node, self.longest[f] if node else -1)
                self.longest_end[node] = ends.get(node, self.longest_end[f] if node else -1)
                if node in plain and node:
                    self.shorter[plain[node]] = self.longest[f]
                if node in ends and node:
                    self.shorter_end[ends[node]] = self.longest_end[f]
                step[node] = step[f]
                for b, child in trie[node].items():
                    if self.kind[b]:
                        fail[child] = step[f, self.kind[b]] if node else 0
                        step[node, self.kind[b]] = child
                    below.append(child)
            level = below
        self.step = step

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], NEVER)

    def pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b next to each other stay as they are.

        They do unless, while a's last part and b's first part grow by their own merges in order of rank, two parts
        meet whose merge comes before the next of those (of equal merges the left one comes first).
        """
        stays = np.ones(len(a), bool)
        on = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(on):
            x, y = a[on], b[on]
            m = self.merge_rank(self.right[x, i], self.left[y, j])
            up_x, up_y = self.rank[self.right[x, i + 1]], self.rank[self.left[y, j + 1]]
            broken = (m < up_x) & (m <= up_y) & (m < NEVER)
            stays[on[broken]] = False
            go = ~broken & ~((up_x == NEVER) & (up_y == NEVER))
            first = up_x <= up_y
            on, i, j = on[go], (i + first)[go], (j + ~first)[go]
        return stays

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """pairs_stay, remembered."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 13) & (_SLOTS - 1)
        new = np.flatnonzero(self._pair_key[slot] != key)
        out = self._pair_fits[slot]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = self.pairs_stay(keys // self.size, keys % self.size)
            out[new] = found[back]
            at = (keys * 0x9E3779B1 >> 13) & (_SLOTS - 1)
            self._pair_key[at], self._pair_fits[at] = keys, found
            lost = self._pair_key[at] != keys  # two new pairs in one slot: the last one's answer must be its own
            self._pair_key[at[lost]] = -1
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), in order, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(by_length):
            stop, most = at, len(words[by_length[at]])
            while stop < len(by_length) and len(words[by_length[stop]]) <= most + most // 4 + 1 and (stop - at + 1) * len(words[by_length[stop]]) <= 1 << 20 or stop == at:
                stop += 1
            ids = by_length[at:stop]
            for k, found in zip(ids, self._prefixes([words[k] for k in ids])):
                out[k] = found
            at = stop
        return out

    def _prefixes(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        n, longest = len(words), int(size.max())
        text = np.zeros((n, longest), np.uint8)
        text[np.arange(longest)[None] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full((n, longest + 1), -1, np.int64)
        state = np.zeros(n, np.int64)
        for i in range(1, longest + 1):
            rows = np.flatnonzero(size >= i)
            byte = text[rows, i - 1]
            state[rows] = now = self.step[state[rows], self.kind[byte]]
            ending = size[rows] == i
            token = np.where(ending, self.longest_end[now], self.longest[now])
            token = np.where(token < 0, np.where(ending, self.base_end[byte], self.base[byte]), token)
            while len(rows):
                before = i - self.length[token]
                good = before == 0
                ask = np.flatnonzero(~good)
                good[ask] = self.fits(last[rows[ask], before[ask]], token[ask])
                last[rows[good], i] = token[good]
                rows, ending, token, byte = rows[~good], ending[~good], token[~good], byte[~good]
                token = np.where(ending, self.shorter_end[token], self.shorter[token])
                token = np.where(token < 0, np.where(ending, self.base_end[byte], self.base[byte]), token)
        place, row, steps = size.copy(), np.arange(n), []
        while len(row):
            token = last[row, place[row]]
            steps.append((row, token))
            place[row] -= self.length[token]
            row = row[place[row] > 0]
        rows, tokens = np.concatenate([r for r, _ in steps[::-1]]), np.concatenate([t for _, t in steps[::-1]])
        order = np.argsort(rows, kind="stable")
        flat = tokens[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(rows, minlength=n)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _plain(self, text: str) -> list[str]:
        """A normalised text without special tokens, cut at white space."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if regex.search(r"[\x1c-\x1f]", text):  # white space to Python, not to the tokenizer
            return [p for p in regex.split(r"\p{White_Space}+", text) if p]
        return text.split()

    def _learn(self, pieces: set[str]) -> None:
        several, words = {}, set()
        for p in pieces:
            if p.isalpha():
                words.add(p)
            else:
                several[p] = own = [p[:-1], p[-1]] if p[-1] in ".," and p[:-1].isalpha() else self.words.findall(p)
                words.update(own)
        unknown = list(words - self.pieces.keys())
        ids = dict(zip(unknown, self.encode_words([w.encode("utf-8") for w in unknown])))
        ids |= {w: self.pieces[w] for w in words if w not in ids}
        for p, own in several.items():
            self.pieces[p] = b"".join([ids[w] for w in own])
        for p in pieces - several.keys():
            self.pieces[p] = ids[p]

    def forget(self) -> None:
        """Drop the pieces kept so far: an idle worker should hold little."""
        self.pieces, self.older = {}, {}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; strings of special tokens in a text become those tokens; null counts as empty."""
        parts: list[list] = []
        for text in texts:
            own, at = [], 0
            text = text or ""
            if any(x in text for x in self.special):
                for m in self.specials.finditer(text):
                    own += [self._plain(text[at : m.start()]), self.special[m[0]]]
                    at = m.end()
            parts.append([*own, self._plain(text[at:])])
        needed = set().union(*(x for own in parts for x in own if not isinstance(x, int)))
        if len(self.pieces) > KEPT_PIECES:  # the last generation stays at hand while a new one fills
            self.older, self.pieces = self.pieces, {}
        unknown = needed - self.pieces.keys()
        again = unknown & self.older.keys()
        self.pieces.update({p: self.older[p] for p in again})
        self._learn(unknown - again)
        get = self.pieces.__getitem__
        return [
            np.frombuffer(b"".join(np.array([x], "<u4").tobytes() if isinstance(x, int) else b"".join(map(get, x)) for x in own), "<u4")
            for own in parts
        ]


def token_strings(spec: dict) -> list[str]:
    """Each id's string, special tokens included."""
    own = [*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]
    strings = [""] * (1 + max(i for _, i in own))
    for s, i in own:
        strings[i] = s
    return strings


def decode_ids(ids: np.ndarray, strings: list[str]) -> str:
    """The tokens' strings with a space between them (the file names no decoder); special tokens stay."""
    return " ".join(map(strings.__getitem__, ids.tolist()))


_loaded: dict[str, WordBpe] = {}
_strings: dict[str, list[str]] = {}


def load(path: str) -> WordBpe:
    """One tokenizer a Python process; later tasks on the worker find its tables and pieces warm."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def load_strings(path: str) -> list[str]:
    """What decoding needs, without the tables for encoding."""
    if path not in _strings:
        with open(path, encoding="utf-8") as f:
            _strings[path] = token_strings(json.load(f))
    return _strings[path]


def _groups(column: pa.Array, rows: int = 256, size: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Runs of a column's values, with their start: at most so many rows, and about so many characters."""
    at, own, held = 0, [], 0
    for k, x in enumerate(column):
        own.append(x.as_py())
        held += len(own[-1] or "")
        if len(own) >= rows or held >= size:
            yield at, own
            at, own, held = k + 1, [], 0
    if own:
        yield at, own


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of every whole text added as array<int> (a column of this name is replaced).

    Null and empty texts get an empty array; repeated rows are encoded each; an empty table stays empty.
    """
    kept = docs.drop(ids_col)
    at, names = kept.columns.index(text_col), [*kept.columns, ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, texts in _groups(batch.column(at)):
                ids = bpe.encode_batch(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, column], names)
        bpe.forget()

    schema = kept.schema.simpleString()[len("struct<") : -1]
    return kept.mapInArrow(tidied(run), f"{schema},{ids_col}:array<int>")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the text of every array of ids added (a column of this name is replaced); null counts as empty."""
    kept = tokens.drop(out_col)
    at, names = kept.columns.index(ids_col), [*kept.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load_strings(path)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [decode_ids(np.asarray(x.values), strings) if x.is_valid else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    schema = kept.schema.simpleString()[len("struct<") : -1]
    return kept.mapInArrow(tidied(run), f"{schema},{out_col}:string")


def _digested(ids: list[np.ndarray], strings: list[str]) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of arrays of ids."""
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(decode_ids(x, strings).encode()).hexdigest() for x in ids], pa.string()),
    ]


DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def digests(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with ids_col replaced by n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of their decoded text in UTF-8), so that a round trip can be checked without keeping the texts."""
    kept = tokens.drop(*DIGESTS)
    at = kept.columns.index(ids_col)
    others = [k for k in range(len(kept.columns)) if k != at]
    names = [*(kept.columns[k] for k in others), *DIGESTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load_strings(path)
        for batch in batches:
            ids = [np.asarray(x.values).astype("<u4") if x.is_valid else np.empty(0, "<u4") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), *_digested(ids, strings)], names)

    schema = kept.drop(ids_col).schema.simpleString()[len("struct<") : -1]
    return kept.mapInArrow(tidied(run), ",".join([schema, *(f"{c}:{t}" for c, t in DIGESTS.items())]))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with text_col replaced by the digests of its ids and of what they decode to (and by ids, if kept).

    The same rows as digests(encode(docs)), from one Python worker a task instead of two.
    """
    new = {"ids": "array<int>"} | DIGESTS if keep_ids else DIGESTS
    kept = docs.drop(*new)
    at = kept.columns.index(text_col)
    others = [k for k in range(len(kept.columns)) if k != at]
    names = [*(kept.columns[k] for k in others), *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, strings = load(path), load_strings(path)
        for batch in batches:
            for start, texts in _groups(batch.column(at)):
                ids, part = bpe.encode_batch(texts), batch.slice(start, len(texts))
                columns = _digested(ids, strings)
                if keep_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.insert(0, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), *columns], names)
        bpe.forget()

    schema = kept.drop(text_col).schema.simpleString()[len("struct<") : -1]
    return kept.mapInArrow(tidied(run), ",".join([schema, *(f"{c}:{t}" for c, t in new.items())]))
