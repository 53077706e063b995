"""Chat formatting: reply trees to root-to-leaf paths, the best of them written as one conversation each."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import arrow_map, checkpoint, stored

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer models of various kinds; none of them comes through unescaped from a role or a text.
CONTROLS = (BEGIN, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
#: A control string with any number of marks behind its first letter; escaping adds a mark, undoing takes one.
_MARKED = re.compile("|".join(f"{re.escape(c[0])}!*{re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(re.escape(BEGIN) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0] + "!" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "!" else m[0], text)


def escape_role(role: str) -> str:
    """A role is one line: a line feed is written as backslash n, a backslash doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans (code points) that count for the loss: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, f"{END}\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def tree_key():
    """Trees go by their conv_id as a string; those without one are one tree, which no id can be taken for."""
    return F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("none"))


def reply_trees(conversations: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score) of a table of turns: each turn answers the turn before it.

    Turns of one conversation are ordered by turn (null first), then role and text, so repeated rows and ties stay, in a
    defined order. Null roles and texts are empty. The turns are
    numbered in one exchange and written once to the shared folder, so the joins over the tree read its narrow columns only. The score of a node is the length of its text.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return stored(numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score")))


def best_paths(trees: DataFrame, paths: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, node, depth): the nodes of the best root-to-leaf paths of each tree.

    `trees` has conv_id, node (unique in its tree), parent (null or unknown: a root) and score. Paths are enumerated by
    self-joins that double their length: after k joins each node knows the score and the place 2^k replies up, so a
    thread of n replies takes log n joins. Branches are ranked by mean score, then by the smaller leaf. Nodes in a cycle
    have no root and are left out; null conv_ids are one tree.
    """
    key = tree_key()
    nodes = trees.select(key.alias("tree"), "conv_id", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("up"))
    jumps = nodes.select("tree", "node", F.col("parent").alias("up"), "score").join(known, ["tree", "up"], "left_semi").select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), "score")
    rootless = nodes.select("tree", "node", "score").join(jumps.select("tree", "node"), ["tree", "node"], "left_anti")
    # of each node: how far up it has looked, where it stands there, and the sum of scores below that place
    reach = checkpoint(jumps.select("tree", "node", "up", "steps", F.col("score").alias("total")).union(rootless.select("tree", "node", F.lit(None).cast("long"), F.lit(1).cast("long"), F.col("score"))))
    levels, n = [reach], trees.count()
    while (1 << len(levels)) <= 2 * n and levels[-1].where("up is not null").limit(1).count():
        last = levels[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        done = last.where("up is null")
        longer = last.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"))
        levels.append(checkpoint(longer.union(done.select("tree", "node", "up", "steps", "total"))))
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = levels[-1].where("up is null").join(parents, ["tree", "node"], "left_anti")
    ranked = leaves.select("tree", "node", "steps", F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), "node")).alias("rank")).where(F.col("rank") <= paths)
    # members: from each chosen leaf, all places 1, 2, 4, ... further up than those already found
    found = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("depth"), F.col("steps").alias("length"))
    for k, level in enumerate(levels[:-1] if len(levels) > 1 else []):
        full = level.where(F.col("steps") == (1 << k)).where("up is not null").select("tree", "node", F.col("up").alias("next"))
        found = checkpoint(found.union(found.join(full, ["tree", "node"]).select("tree", "leaf", "rank", F.col("next").alias("node"), F.col("depth") + (1 << k), "length")))
    ids = nodes.select("tree", "conv_id").distinct()
    return found.join(ids, "tree").select("conv_id", "leaf", "rank", "node", (F.col("length") - 1 - F.col("depth")).alias("depth"))


def _format(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, masks = [], []
    for turns in batch.column(2).to_pylist():
        text, spans = format_turns([(t["role"], t["text"]) for t in turns])
        texts.append(text)
        masks.append([{"start": a, "end": b} for a, b in spans])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(masks, spans)], names=["conv_id", "leaf", "formatted", "loss_spans"])


def format_conversations(trees: DataFrame, paths: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, loss_spans): one row per chosen path. A conversation is one string, so its turns meet."""
    chosen = best_paths(trees, paths)
    key = tree_key()
    texts = trees.select(key.alias("tree"), "node", "role", "text")
    turns = chosen.withColumn("tree", key).join(texts, ["tree", "node"]).groupBy("tree", "conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return arrow_map(turns.select("conv_id", "leaf", "turns"), _format, f"conv_id {dict(trees.dtypes)['conv_id']}, leaf long, formatted string, loss_spans array<struct<start: long, end: long>>")


def _read_back(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[tuple] = []
    for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        turns = parse_turns(text)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
    names, kinds = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", *names])


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: turns, their digest, the text under the loss mask."""
    narrow = formatted.select("conv_id", "formatted", "loss_spans")
    return arrow_map(narrow, _read_back, f"conv_id {dict(narrow.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
