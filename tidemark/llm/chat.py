"""Chat formatting over a prefix tree of conversations.

Conversations that start with the same turns share those turns' nodes. Every node's tokens are emitted once, in
depth-first order, into one packed stream; a node has the position of its first token within its conversations and the
intervals of the stream that its tokens may attend to: its ancestors' and its own. A turn is written as
``### role: text</turn>`` and a line break; control strings inside roles and texts carry a backslash, and so do
backslashes, so that reading back is exact. Assistant texts are under the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running
from .tokencount import encoding

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_MARK = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n")
_ROLE = re.compile(r"\\(?:\\|###|</turn>|:)|: ")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{CLOSE}\n"


def _until(pattern: re.Pattern, text: str, at: int, stop: str) -> tuple[int, int]:
    """Where the next unescaped stop begins and ends."""
    while m := pattern.search(text, at):
        if m[0] == stop:
            return m.start(), m.end()
        at = m.end()
    raise ValueError("the formatted text breaks off")


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first and last+1 character of the escaped text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a turn doesn't start where one should")
        a, b = _until(_ROLE, text, at + len(OPEN), ": ")
        c, d = _until(_MARK, text, b, CLOSE + "\n")
        turns.append((unescape(text[at + len(OPEN) : a]), unescape(text[b:c]), b, c))
        at = d
    return turns


def pack(conversations: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of all conversations.

    nodes: node, parent, depth, start (its place in the packed stream), n_tokens, tokens, position, attends (array of
    intervals of the stream, its own last), loss_start and loss_end (characters of its segment under the loss mask, or
    null), conversations (how many share it). members: conv_id, step, node.

    Turns follow by turn, then role (null as empty, first), then a hash of role and text; null roles and texts count as
    empty; repeated rows are repeated turns; rows without a conversation id are left out; further columns are ignored; an
    empty table gives empty results. A conversation, like a document, is handled as one row; shared nodes may have any
    number of them.

    Texts are shuffled once, by conversation. The tree is laid out from hashes of the turns alone; only the first
    conversation of a node, which owns it, tokenizes its text. The nodes are written before they are returned.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")
    )
    rows = rows.withColumns({f"h{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)})
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "h2")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def numbered(x: DataFrame) -> DataFrame:
        x = x.withColumn("step", F.row_number().over(by) - 1)
        halves = [F.lower(F.lpad(F.hex(F.bit_xor(F.xxhash64("step", h)).over(so_far)), 16, "0")) for h in ("h1", "h2")]
        return x.withColumn("node", F.concat(*halves)).withColumn("parent", F.lag("node").over(by))

    steps = cut(numbered(rows.drop("text")).select("conv_id", "step", "node"))
    paths = steps.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("step", "node"))).getField("node"), "/").alias("path"), F.lit(1).cast("long").alias("one"))
    ranks = running(paths, ["path", "conv_id"], "one", "rank").select("conv_id", "rank")
    members = cut(steps.join(ranks, "conv_id").select("conv_id", "rank", "step", "node"))
    first = F.min(F.struct("rank", "conv_id", "step"))
    owners = cut(members.groupBy("node").agg(first.alias("o"), F.count(F.lit(1)).alias("conversations")).select("node", "o.conv_id", F.col("o.step").alias("depth"), F.col("o.rank").alias("owner"), "conversations"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoding(path, pattern)
        names = ["node", "parent", "tokens", "n_tokens", "loss_start", "loss_end"]
        for batch in batches:
            ids, starts, ends = [], [], []
            for role, text in zip(batch.column(2), batch.column(3)):
                segment = format_turn(role.as_py(), text.as_py())
                ids.append(coder.encode_ordinary(segment))
                _, _, a, b = read_turns(segment)[0]
                masked = role.as_py() == loss_role
                starts.append(a if masked else None)
                ends.append(b if masked else None)
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names)

    # an owner's own nodes are the end of its path
    since = owners.groupBy("conv_id").agg(F.min("depth").alias("since"))
    own_texts = numbered(rows).join(since, "conv_id").where("step >= since").select("node", "parent", "role", "text")
    encoded = cut(own_texts.mapInArrow(tokenize, "node string, parent string, tokens array<int>, n_tokens long, loss_start long, loss_end long"))
    sizes = owners.select("node", F.col("depth").cast("long"), "owner", "conversations").join(encoded.select("node", "n_tokens"), "node")
    placed = cut(running(sizes, ["owner", "depth"], "n_tokens", "start"))

    # an owner's own nodes follow each other in the stream; what they attend to before is the same for all of them
    steps_placed = members.join(placed.select("node", "owner", "start", "n_tokens"), "node")
    before = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    along = steps_placed.withColumn("position", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    leaders = along.where(F.col("owner") == F.col("rank")).select("node", "position")
    runs = steps_placed.groupBy("rank", "owner").agg(F.min("step").alias("step"), F.min("start").alias("start"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    intervals = runs.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("step", "start", "end"))).alias("runs")).withColumnRenamed("rank", "owner")
    past = F.transform(F.filter("runs", lambda r: r["step"] < F.element_at("runs", -1)["step"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    own = F.array(F.struct(F.element_at("runs", -1)["start"].alias("start"), (F.col("start") + F.col("n_tokens")).alias("end")))
    laid = placed.join(intervals, "owner").withColumn("attends", F.concat(past, own)).drop("runs", "owner")
    nodes = encoded.drop("n_tokens").join(laid, "node").join(leaders, "node")
    kept = ["node", "parent", "depth", "start", "n_tokens", "tokens", "position", "attends", "loss_start", "loss_end", "conversations"]
    return cut(nodes.select(kept)), members.select("conv_id", "step", "node")


def read_back(nodes: DataFrame, members: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every conversation read from the packed tokens: (conv_id, n_turns, turns, loss_text, formatted_chars).

    turns is an array of structs (role, text); loss_text all text under the loss mask, unescaped, in order.
    """

    @F.arrow_udf("string")
    def decode(tokens: pa.Array) -> pa.Array:
        coder, _ = encoding(path, pattern)
        return pa.array([coder.decode(ids.as_py()) for ids in tokens], pa.string())

    # each node is decoded once, before its text goes to all of its conversations
    own = members.join(nodes.select("node", decode("tokens").alias("text"), "loss_start", "loss_end"), "node")
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("step", "text", "loss_start", "loss_end"))).alias("steps"))
    kind = members.schema["conv_id"].dataType.simpleString()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                turns, masked, sizes = [], [], []
                part = batch.slice(at, 512)
                for steps in part.column(1):
                    segments = [(s["text"], s["loss_start"], s["loss_end"]) for s in steps.as_py()]
                    text = "".join(s for s, _, _ in segments)
                    turns.append([{"role": r, "text": t} for r, t, _, _ in read_turns(text)])
                    masked.append("".join(unescape(s[a:b]) for s, a, b in segments if a is not None))
                    sizes.append(len(text))
                new = [pa.array(map(len, turns), pa.int64()), pa.array(turns, turn), pa.array(masked, pa.string()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], ["conv_id", "n_turns", "turns", "loss_text", "formatted_chars"])

    return whole.mapInArrow(parse, f"conv_id {kind}, n_turns long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
