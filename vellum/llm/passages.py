"""Passages that repeat across documents, by level-wise doubling of windows of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm.common import arrow_map, bucketed, fresh, stored

#: Words of a window, and of the windows of the first level; the one is the other doubled one or more times.
WINDOW, FIRST = 50, 25
#: Words whose hashes a task remembers, and windows that are searched for their anchors at once.
REMEMBERED, BLOCK = 1 << 19, 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


class _Hashes(dict):
    """XXH64 of words; a word is hashed when it is met first."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six white characters of ASCII."""
    return text.split() if text else []


def word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of `length` words, from the hashes of the windows of half as many words."""
    if length == 1:
        return words
    half = length // 2
    halves = window_hashes(words, half)
    both = _mixed(halves[:-half], halves[half:]) if len(halves) > half else halves[:0]
    return _mixed(both[:-1], words[2 * half :]) if length % 2 and len(both) else both


def anchors(hashes: np.ndarray, many: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `many` windows that starts at a place in `valid`: the one with the least hash, the first of equal ones.

    Which it is follows from the run's words alone. Returns the places of the anchors found, and the first and the last start
    of the runs that each is the anchor of.
    """
    found = [np.empty(0, np.int64)]
    for at in range(0, len(hashes) - many + 1, BLOCK):
        part = hashes[at : at + BLOCK + many - 1]
        least, width = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while width < many:
            step = min(width, many - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        found.append((least & _PLACE).astype(np.int64) + at)
    anchor = np.concatenate(found)
    anchor = anchor[valid]
    if not len(anchor):
        return anchor, anchor, anchor
    begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    ends = np.r_[begins[1:], len(anchor)] - 1
    return anchor[begins], valid[begins], valid[ends]


def _texts(batch: pa.RecordBatch, name: str, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts of a batch, one after the other, and where each text begins (and the last ends)."""
    split = [split_words(t) for t in batch.column(name).cast(pa.binary()).to_pylist()]
    bounds = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
    return np.concatenate([np.empty(0, np.uint64), *(word_hashes(w, known) for w in split)]), bounds


def first_level(texts: DataFrame, length: int) -> DataFrame:
    """(hash, row, rank, first, last) of `texts` (row, rank, text): the anchors of all windows of twice `length`.

    Each window of 2 * length words holds a window of `length` words whose hash is the least, so equal windows hold equal
    anchors: if an anchor is in no other document, no window around it is either. first and last are the starts of the
    windows that an anchor stands for.
    """
    known = _Hashes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = _texts(batch, "text", known)
        hashes = window_hashes(words, length)
        starts = np.maximum(np.diff(bounds) - 2 * length + 1, 0)  # windows of each text
        owner = np.repeat(np.arange(len(starts)), starts)
        valid = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + bounds[owner]
        place, first, last = anchors(hashes, length + 1, valid)
        of = np.searchsorted(bounds, first, side="right") - 1
        columns = [pa.array(hashes[place].view(np.int64)), batch.column("row").take(pa.array(of)), batch.column("rank").take(pa.array(of))]
        columns += [pa.array((x - bounds[of]).astype(np.int32)) for x in (first, last)]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "row", "rank", "first", "last"])

    return arrow_map(texts.select("row", "rank", "text"), step, "hash long, row long, rank long, first int, last int")


def next_level(texts: DataFrame, runs: DataFrame, length: int, halves: bool) -> DataFrame:
    """(hash, row, rank, first, last = first) of the windows of `length` words at the places that `runs` (row, first, last) names.

    With `halves` these are the places of repeated windows of half the length, and a window counts if both its halves do.
    """
    known, half = _Hashes(), length // 2

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = _texts(batch, "text", known)
        runs = batch.column("runs")
        begin, end = (runs.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        owner = np.repeat(np.arange(len(bounds) - 1), runs.value_lengths().to_numpy(zero_copy_only=False))
        counts = end - begin + 1
        of = np.repeat(owner, counts)
        start = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin + bounds[owner], counts)
        start, kept = np.unique(start, return_index=True)
        of = of[kept]
        if halves:
            both = np.isin(start + half, start, assume_unique=True)
            start, of = start[both], of[both]
            inside = start + length <= bounds[of + 1]
            start, of = start[inside], of[inside]
        hashes = window_hashes(words, length)[start] if len(start) else np.empty(0, np.uint64)
        place = pa.array((start - bounds[of]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("row").take(pa.array(of)), batch.column("rank").take(pa.array(of)), place, place], names=["hash", "row", "rank", "first", "last"])

    lists = runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return arrow_map(texts.select("row", "rank", "text").join(lists, "row"), step, "hash long, row long, rank long, first int, last int")


def repeated(windows: DataFrame) -> DataFrame:
    """The windows whose hash is found in two documents or more, with `least`, the smallest rank among these.

    Ranks are aggregated before any row moves, so a passage that a third of all documents share is one row on one side of the
    join. The repeated hashes are written down first: adaptive execution splits the other side of a join only if no
    aggregation stands between the exchange and the join.
    """
    common = windows.groupBy("hash").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").select("hash", "least")
    return windows.join(stored(common), "hash")


def later_copies(texts: DataFrame) -> DataFrame:
    """(row) of the texts (row, rank, text) that are equal to one of a smaller rank: all their windows start there too.

    Of equal texts only those of the smallest rank need be looked at, as no window starts earlier in another. Only digests of
    128 bits move, aggregated first.
    """
    keyed = stored(texts.select("row", "rank", F.unhex(F.md5("text")).alias("digest")).where("digest is not null"))
    first = keyed.groupBy("digest").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").select("digest", "least")
    return stored(keyed.join(stored(first), "digest").where("rank > least").select("row"))


def repeated_windows(texts: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(row, start) of the windows of `window` words of `texts` (row, rank, text) that also start in a text of a smaller rank.

    Level-wise doubling: windows of `first` words that repeat are extended to twice that length, those that still repeat
    again, until none is left or `window` is reached. The first level looks at anchors alone, which misses nothing. Texts of
    equal rank don't repeat each other. Windows are compared by hashes of 64 bits.
    """
    length = 2 * first
    while length < window:
        length *= 2
    if first < 1 or length != window:
        raise ValueError("the window must be the first length, doubled one or more times")
    runs, length = stored(repeated(stored(first_level(texts, first))).select("row", "first", "last")), 2 * first
    while length < window and not runs.isEmpty():
        runs = stored(repeated(stored(next_level(texts, runs, length, length > 2 * first))).select("row", "first", "last"))
        length *= 2
    if runs.isEmpty():
        return runs.select("row", F.col("first").alias("start"))
    return repeated(stored(next_level(texts, runs, window, window > 2 * first))).where("rank > least").select("row", F.col("first").alias("start"))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """All columns of `docs`, then n_words, n_removed, removed (array of start, end: words, end exclusive) and kept_text.

    A word goes if a window of `window` words around it also starts in a document with a smaller id, judged on the input;
    kept words are joined by one space. Null and empty texts have no words. A null id is greater than every other; rows of
    equal ids, repeated ones too, take nothing from each other. Texts of fewer words than a window stay whole. Ids are whole
    numbers. A column whose name clashes with one of the added keeps its name, and the added one gets a longer name. An empty
    table gives an empty result. Texts are shuffled once, into a bucketed table in the shared folder, which every level reads.
    """
    row, rank, starts, whole = fresh(docs, "row", "rank", "starts", "whole")
    n_words, n_removed, removed, kept = fresh(docs, "n_words", "n_removed", "removed", "kept_text")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(rank, F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)))
    table = bucketed(numbered, row)
    texts = table.select(F.col(row).alias("row"), F.col(rank).alias("rank"), F.col(text_column).alias("text"))
    copies = later_copies(texts)
    found = repeated_windows(texts.join(copies, "row", "left_anti"), window, first).groupBy(F.col("row").alias(row)).agg(F.collect_list("start").alias(starts))
    copies = copies.select(F.col("row").alias(row), F.lit(True).alias(whole))
    carried = docs.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, places, copy in zip(batch.column(text_column).cast(pa.binary()).to_pylist(), batch.column(starts).to_pylist(), batch.column(whole).to_pylist(), strict=True):
            words = split_words(text)
            spans = [(0, len(words))] if copy and len(words) >= window else _spans(places or [], window)
            parts = [words[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(words)], strict=True)]
            out.append((len(words), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b" ".join(w for p in parts for w in p)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
        added = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        added[3] = added[3].cast(pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *added], names=[*carried, n_words, n_removed, removed, kept])

    joined = table.join(found, row, "left").join(copies, row, "left").select(*carried, starts, whole)
    more = StructType.fromDDL(f"`{n_words}` long, `{n_removed}` long, `{removed}` array<struct<start: int, end: int>>, `{kept}` string")
    return arrow_map(joined, step, StructType([*docs.schema.fields, *more.fields]))


def _spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """The words that windows at `starts` cover, as disjoint spans in order."""
    if not starts:
        return []
    at = np.unique(np.array(starts, np.int64))
    gaps = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.r_[0, gaps + 1]].tolist(), (at[np.r_[gaps, len(at) - 1]] + window).tolist(), strict=True))
