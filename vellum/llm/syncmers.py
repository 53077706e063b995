"""Document fingerprints of closed syncmers."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, pieces, strings

#: Letters of a k-mer and of its inner substrings (two of K - S + 1 k-mers are chosen, and no gap is longer than K - S);
#: bytes of an anchor's hash; letters hashed at once.
K, S, HASH_BYTES, BLOCK = 24, 9, 6, 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text of one sorted range of documents, and most ranges: beyond that ranges grow.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grams(letters: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n letters, put together from runs of powers of two."""
    have, power, done, run, width = None, BASE, 0, letters + np.uint64(1), 1
    while True:
        if n & width:
            if have is None:
                have, done = run, width
            else:
                m = len(letters) - done - width + 1
                have, done = have[:m] * power + run[done : done + m], done + width
        if done == n:
            return have
        m = len(run) - width
        run, power, width = run[:m] * power + run[width:], np.uint64(int(power) ** 2 % (1 << 64)), 2 * width


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers: k-mers whose least inner s-mer is the first or the last one.

    Whether a k-mer is chosen depends on its own letters alone. A text with none has itself as its only anchor.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    hashes, places = [], []
    for at in range(0, max(1, len(codes) - k + 1), BLOCK):
        letters = codes[at : at + BLOCK + k - 1].astype(np.uint64)
        if len(letters) < k:
            break
        inner = _mixed(_grams(letters, s))
        count, width, least = len(letters) - k + 1, 1, inner
        while 2 * width <= k - s + 1:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:count], least[k - s + 1 - width : k - s + 1 - width + count])
        chosen = np.flatnonzero((least == inner[:count]) | (least == inner[k - s : k - s + count]))
        hashes.append(_mixed(_grams(letters, k)[chosen]) >> np.uint64(64 - 8 * HASH_BYTES))
        places.append(chosen + at)
    found = np.concatenate(hashes) if hashes else np.array([], dtype=np.uint64)
    if not len(found) and len(codes):
        whole = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:HASH_BYTES], "big")
        return np.array([whole], dtype=np.uint64), np.array([0])
    return found, np.concatenate(places) if places else np.array([], dtype=np.int64)


def encoded(hashes: np.ndarray, places: np.ndarray) -> str:
    """The fingerprint: base64 of all anchors in the order of their places, a byte for the step from the place before (a step
    of 255 or more takes further bytes of 255) and the bytes of the hash."""
    steps = np.diff(places, prepend=0)
    if len(steps) and steps.max() >= 255:  # only where hashes of inner substrings are equal without end
        raw = b"".join(b"\xff" * (int(d) // 255) + bytes([int(d) % 255]) + int(h).to_bytes(HASH_BYTES, "little") for d, h in zip(steps, hashes, strict=True))
        return base64.b64encode(raw).decode()
    rows = np.empty((len(hashes), 1 + HASH_BYTES), dtype=np.uint8)
    rows[:, 0], rows[:, 1:] = steps, hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    return base64.b64encode(rows.tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw, at, place, hashes, places = base64.b64decode(fingerprint), 0, 0, [], []
    while at < len(raw):
        while raw[at] == 255:
            place, at = place + 255, at + 1
        place += raw[at]
        hashes.append(int.from_bytes(raw[at + 1 : at + 1 + HASH_BYTES], "little"))
        places.append(place)
        at += 1 + HASH_BYTES
    return np.array(hashes, dtype=np.uint64), np.array(places, dtype=np.int64)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Distinct keys: equal hashes are told apart by how often they came before."""
    order = np.argsort(hashes, kind="stable")
    ordered, index = hashes[order], np.arange(len(hashes))
    begin = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], index, 0)) if len(hashes) else index
    number = np.empty(len(hashes), dtype=np.uint64)
    number[order] = (index - begin).astype(np.uint64)
    return _mixed(hashes ^ _mixed(number + np.uint64(1)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of both texts (hashes in the order of their places) that match: 1 for equal ones, 0 for nothing in common.

    The n-th anchor of a hash in one text is held against the n-th of it in the other, and of such pairs the longest chain
    counts that has the same order in both, whatever the shifts between: a letter put in costs only the anchors around it.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True, return_indices=True)
    there = j[np.argsort(i)]
    if len(there) < 2 or (there[1:] > there[:-1]).all():
        chain = len(there)
    else:
        ends: list[int] = []  # of chains of each length, the least last place
        for x in there.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        chain = len(ends)
    return chain / (len(a) + len(b) - chain)


def document_anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, anchors (array of hash, place): all closed syncmers of each whole text, for positional matching.

    Null and empty texts have none; null ids and repeated rows are kept; an empty table gives an empty result.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"hash": h, "place": p} for h, p in zip(*(x.tolist() for x in anchors(t)), strict=True)] for t in strings(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())])))], names=["doc_id", "anchors"])

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(narrow, step, f"doc_id {dict(narrow.dtypes)['doc_id']}, anchors array<struct<hash: long, place: long>>")


def with_next_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (bucket, extra, doc_id, text) dealt so that each sorted bucket holds a run of documents by descending id and then,
    as `extra`, the first document of the run behind it (behind the last run: the first of all).

    Ties of ids are ordered by a hash of the text; null ids come last. The texts are exchanged once. Bounds of the buckets
    are quantiles of the ids; they and one row for each bucket are all that comes to the driver.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(min(MOST_RANGES, max(1, total // RANGE_BYTES + 1)))
    steps = [i / count for i in range(1, count)]
    bounds = sorted(set((rows.agg(F.percentile_approx("doc_id", steps, 10 * count + 1000)).first()[0] if steps else None) or []))
    edges = np.array(bounds, dtype=np.int64)

    ids = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))  # without an id: behind all others

    def number(ids: pd.Series) -> np.ndarray:
        """Bucket 0 has the greatest ids."""
        return len(edges) - np.searchsorted(edges, ids.to_numpy(), side="right")

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(number(ids).astype(np.int32))

    first = rows.groupBy(bucket(ids).alias("bucket")).agg(F.max(F.struct(ids.alias("id"), "tie")).alias("top")).collect()
    first = sorted((r["bucket"], r["top"]["id"], r["top"]["tie"]) for r in first)
    before = {(d, tie): first[i - 1][0] for i, (_, d, tie) in enumerate(first)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, ties: pd.Series) -> pd.Series:
        extra = [before.get(key) for key in zip(ids.tolist(), ties.tolist(), strict=True)]
        return pd.Series([[b] if e is None else [b, -1 - e] for b, e in zip(number(ids).tolist(), extra, strict=True)])

    dealt = rows.withColumn("at", F.explode(places(ids, "tie"))).select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("bucket"), (F.col("at") < 0).alias("extra"), "doc_id", "text", "tie")
    return dealt.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).select("bucket", "extra", "doc_id", "text")


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of `docs`.

    The edited text has its last third (rounded down) replaced by the first as many letters of the next document by
    descending id. Fingerprints hold all anchors of the whole text with their places, about one in eight letters. Null texts
    are empty: they have an empty fingerprint, like only other empty ones; texts too short for an anchor are one themselves.
    A single document is its own next one. Equal texts have equal fingerprints; repeated rows and null ids are kept; other
    columns are ignored; an empty table gives an empty result.
    """

    def edit(text: str, following: str) -> str:
        part = len(text) // 3
        return text[: len(text) - part] + following[:part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out = None, []
        for batch in pieces(batches):
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = None if extra else anchors(text)
                if waiting is not None and waiting[0] == bucket:
                    out.append(row(*waiting[1:], text, anchors(text) if mine is None else mine))
                    waiting = None
                if not extra:
                    waiting = (bucket, doc_id, text, mine)
            yield made(out)
            out = []

    def row(doc_id: int, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
        changed = edit(text, following)
        other = anchors(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(*mine), encoded(*other), likeness(mine[0], other[0]), likeness(mine[0], theirs[0])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next_text(docs, id_column, text_column).mapInArrow(run, schema)
