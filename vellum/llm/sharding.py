"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import arrow_map, checkpoint, fresh

SHARDS, ROW_BYTES = 24, 8
#: Probes between the ends of each open splitter and round; share of a shard's bytes by which a splitter may miss.
PROBES, TOLERANCE = 64, 0.001
#: The same share for the splitters of ranges inside a shard, which only deal out work; more probes for each splitter that a
#: span holds; most probes of a round (16 bytes each, to every task; one row of counts each, to the driver); rows that a task
#: adds up at once.
RANGE_TOLERANCE, PROBES_OF_EACH, MOST_PROBES, ROWS_AT_ONCE = 0.25, 4, 1_000_000, 100_000
#: A group of equal texts of at most this share of a shard's bytes lies in one shard; a larger one is parted where bytes are even.
GROUP_SHARE = 0.05
#: Bytes that one task sorts: a shard of more is sorted in several ranges, whose exact row counts give the slots.
RANGE_BYTES = 512 << 20
TOP = 1 << 128


def _key_columns(text: Column, row_id: Column) -> tuple[Column, Column]:
    """The sort key is the text's hash, then the id's: equal texts lie together, yet may be parted."""
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("null")))


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys of 16 bytes in the order of unsigned numbers."""
    pair = np.empty((len(high), 2), dtype=">u8")
    pair[:, 0], pair[:, 1] = high.astype(np.int64).view(np.uint64), low.astype(np.int64).view(np.uint64)
    return pair.view("S16").ravel()


def _bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def histogram(keyed: DataFrame, boundaries: list[int]) -> pd.DataFrame:
    """bin, bytes, rows, low, high of the rows (high_key, low_key, size): bin i holds the keys below boundary i and no earlier one.

    Each task adds up its own rows; what comes to the driver is one row for each bin, whatever the input.
    """
    edges = _bytes(boundaries)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _packed(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        order = np.argsort(keys, kind="stable")
        keys, sizes = keys[order], batch.column(2).to_numpy()[order]
        bins = np.searchsorted(edges, keys, side="right")
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else np.array([], dtype=int)
        last = np.r_[first[1:], len(bins)] - 1 if len(first) else first
        sums = np.add.reduceat(sizes, first) if len(first) else np.array([], dtype=np.int64)
        fixed = lambda a: pa.array([x.ljust(16, b"\0") for x in a.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bins[first], pa.int32()), pa.array(sums, pa.int64()), pa.array(last - first + 1, pa.int64()), fixed(keys[first]), fixed(keys[last])], names=["bin", "bytes", "rows", "low", "high"])

    parts = arrow_map(keyed, step, "bin int, bytes long, rows long, low binary, high binary", ROWS_AT_ONCE)
    return parts.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("bin").reset_index(drop=True)


def splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE, ranges: int = 1) -> list[int]:
    """parts - 1 keys that part the bytes evenly: each misses its target by `tolerance` of a part at most, or by one key's rows.

    Only every `ranges`-th of them ends a shard; the tolerance is a share of a shard's bytes, and the others may miss by
    RANGE_TOLERANCE of a range. Every round counts the exact bytes below all probes in one pass over the keys. A splitter
    goes on between the least and the greatest key of the bin that holds its target, so that empty stretches and a much
    repeated text cost no rounds.
    """
    begin = histogram(keyed, [])
    if begin.empty:
        return [TOP - 1] * (parts - 1)
    total, whole = int(begin["bytes"][0]), (int.from_bytes(begin["low"][0], "big"), int.from_bytes(begin["high"][0], "big") + 1)
    miss = {True: tolerance * ranges * total / parts, False: RANGE_TOLERANCE * total / parts}
    spans, done = dict.fromkeys(range(1, parts), whole), {}
    while spans:
        held = Counter(spans.values())
        most = {span: max(3, min(PROBES + PROBES_OF_EACH * n, MOST_PROBES // len(held))) for span, n in held.items()}
        probes = sorted({low + (high - low) * j // (most[low, high] + 1) for low, high in held for j in range(1, most[low, high] + 1)} | {x for s in held for x in s if x < TOP})
        counted = histogram(keyed, probes)
        sizes = np.zeros(len(probes) + 1, dtype=np.int64)
        sizes[counted["bin"].to_numpy()] = counted["bytes"].to_numpy()
        below, place = np.cumsum(sizes[:-1]), dict(zip(counted["bin"].tolist(), range(len(counted)), strict=True))
        lows, highs = counted["low"].tolist(), counted["high"].tolist()
        for i in list(spans):
            target = total * i / parts
            at = int(np.searchsorted(below, target, side="left"))  # the bin with the target in it, and the probe that ends it
            near = min((p for p in (at - 1, at) if 0 <= p < len(probes)), key=lambda p: abs(below[p] - target))
            row = place.get(at)
            if abs(below[near] - target) <= miss[i % ranges == 0] or row is None:
                done[i] = probes[near]
            elif lows[row] == highs[row]:  # one key: the nearer of its sides
                before, key = int(below[at - 1]) if at else 0, int.from_bytes(lows[row], "big")
                done[i] = key if target - before <= before + int(sizes[at]) - target else min(key + 1, TOP - 1)
            else:
                spans[i] = (int.from_bytes(lows[row], "big"), int.from_bytes(highs[row], "big") + 1)
            if i in done:
                del spans[i]
    return sorted(done.values())


def whole_groups(keyed: DataFrame, edges: list[int], parts: int, ranges: int = 1) -> list[int]:
    """`edges` with each that ends a shard moved to the nearer end of the group of equal texts that it parts.

    Only groups of up to GROUP_SHARE of a shard are kept whole, so a shard's bytes change by half of that at most at either
    end. One pass counts the bytes on both sides.
    """
    ends = list(range(ranges - 1, len(edges), ranges))
    around = {i: ((edges[i] >> 64) << 64, min(((edges[i] >> 64) + 1) << 64, TOP - 1)) for i in ends}
    probes = sorted({x for i in ends for x in (*around[i], edges[i])} - {0})
    counted = histogram(keyed, probes)
    sizes = np.zeros(len(probes) + 1, dtype=np.int64)
    sizes[counted["bin"].to_numpy()] = counted["bytes"].to_numpy()
    below = {0: 0} | dict(zip(probes, np.cumsum(sizes[:-1]).tolist(), strict=True))
    moved, most = list(edges), GROUP_SHARE * int(sizes.sum()) * ranges / parts
    for i in ends:
        low, high = around[i]
        before, behind = below[edges[i]] - below[low], below[high] - below[edges[i]]
        if before and behind and before + behind <= most:
            moved[i] = low if before < behind else high
    for i in ends:  # ranges inside a shard stay inside it
        for k in range(i - ranges + 1, i):
            moved[k] = min(max(moved[k], moved[i - ranges] if i >= ranges else 0), moved[i])
    last = ends[-1] if ends else -1
    return [*moved[: last + 1], *(max(x, moved[last]) if ends else x for x in moved[last + 1 :])]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` (default: all of `docs`), then size, text_crc32, law, shard, slot and grown_shard.

    The law is `bytes`: every shard has near the same sum of sizes (bytes of the text plus 8). Rows go in the order of
    (hash of text, hash of id), and equal texts share a shard unless there are more than GROUP_SHARE of its bytes of them. The
    rows are exchanged once. Rows equal in text and id share a shard. Null texts are empty, null ids are rows like any other. A column whose name clashes
    with one of the added keeps its name, and the added one gets a longer name. An empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    high, low, size, part, order = fresh(docs, "high_key", "low_key", "size_", "part", "order")
    keyed = docs.withColumns(dict(zip((high, low), _key_columns(F.col(text_column), F.col(id_column)), strict=True))).withColumn(size, (F.coalesce(F.octet_length(text_column), F.lit(0)) + ROW_BYTES).cast("long"))
    keys = checkpoint(keyed.select(high, low, size))
    total = keys.agg(F.sum(size)).first()[0] or 0
    ranges = max(1, -(-total // (shards * RANGE_BYTES)))
    edges = whole_groups(keys, splitters(keys, shards * ranges, ranges=ranges), shards * ranges, ranges)
    rows = dict(histogram(keys, edges)[["bin", "rows"]].itertuples(index=False))
    starts = [0] * (shards * ranges)
    for p in range(1, len(starts)):
        starts[p] = starts[p - 1] + int(rows.get(p - 1, 0)) if p % ranges else 0
    packed, firsts = _bytes(edges), np.array(starts, dtype=np.int64)

    @F.pandas_udf("part int, first long")
    def place(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(packed, _packed(a.to_numpy(), b.to_numpy()), side="right").astype(np.int32)
        return pd.DataFrame({"part": at, "first": firsts[at]})

    unsigned = [F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long")) for c in (high, low)]
    crc, begin, spot = fresh(docs, "crc", "begin", "spot")
    placed = keyed.withColumn(spot, place(high, low)).withColumns({part: F.col(spot)["part"], begin: F.col(spot)["first"]}).withColumn(crc, F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")))
    placed = placed.select(*carry, high, low, size, crc, part, begin).repartitionById(shards * ranges, F.col(part))
    slot = F.col(begin) + F.row_number().over(Window.partitionBy(part).orderBy(*unsigned)) - 1
    added = dict(zip(("size", "text_crc32", "law", "shard", "slot", "grown_shard"), fresh(placed.select(*carry), "size", "text_crc32", "law", "shard", "slot", "grown_shard"), strict=True))
    return placed.select(
        *carry, F.col(size).alias(added["size"]), F.col(crc).alias(added["text_crc32"]), F.lit("bytes").alias(added["law"]), F.floor(F.col(part) / ranges).cast("int").alias(added["shard"]),
        slot.cast("long").alias(added["slot"]), F.lit(None).cast("int").alias(added["grown_shard"]),
    )
