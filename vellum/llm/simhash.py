"""SimHash fingerprints and near copies found with Golay-code keys.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in two bits at most, some segment is equal
(pigeonhole), and the segments can be walked round so that the one after it differs in one bit at most. That next segment,
padded to the 23 bits of the perfect binary Golay code, is decoded: it and all its one-bit neighbours lie in the spheres of
one or six codewords, so each fingerprint has one or a few codeword indices, and two segments that differ in at most one bit
share one of them. (table, equal segment, codeword index) is the key of a join; joined pairs are verified with all 64 bits.

Two bits are exact copies and little more: at a Jaccard similarity of 0.8 fingerprints differ in about ten bits, and keys for
so many tell nothing apart. For looser copies (drop_similar_copies) the fingerprints of parts are added: the set of shingles is
dealt by hash, so that similar texts deal alike, and a part that holds none of the differing shingles has the same fingerprint
in both. The codeword indices of its three segments are its key. All texts that share a key or whose own fingerprints are linked
are held against each other by their whole sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, checkpoint, fresh, row_key, strings
from vellum.llm.graph import connected_components
from vellum.llm.similar import SIMILARITY, WORDS, drop_similar

#: Fixed values of the perfect binary Golay code: length, message bits, generator polynomial.
GOLAY_LENGTH, GOLAY_MESSAGE, GOLAY_POLYNOMIAL = 23, 12, 0xC75
#: (lowest bit, width) of the segments, and the (equal, decoded) segments of each table.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TABLES = ((0, 1), (1, 2), (2, 0))
#: Differing bits up to which fingerprints are linked.
RADIUS = 2
#: A key with more candidate pairs than this is not paired: its members are linked through shared midpoints instead.
PAIRS_OF_A_KEY = 256
HASHES_AT_ONCE = 8192
#: Parts of a set, and the shingles that a part must hold to have a key: smaller ones meet wherever a phrase is shared. So many
#: it holds on average in a set of 2 ** level shingles, and up to twice as many below the next level.
PARTS, PART_SHINGLES = 48, 3
_DEAL = np.random.default_rng(7).integers(0, 1 << 31, PARTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles; fewer words make one shingle, no word gives 0."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest, total = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, HASHES_AT_ONCE):
        part = tokens[at : at + HASHES_AT_ONCE + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False) if len(tokens) >= words else [part]
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.array([fingerprint(t) for t in strings(batch.column(1))], dtype=np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["row_key", "fp"])


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and of the high part of a word, and the error that each syndrome stands for."""
    redundant = GOLAY_LENGTH - GOLAY_MESSAGE

    def syndrome(word: int) -> int:
        for bit in range(GOLAY_LENGTH - 1, redundant - 1, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - redundant)
        return word

    low = np.array([syndrome(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], dtype=np.int64)
    errors = np.zeros(1 << redundant, dtype=np.int64)
    bits = [1 << i for i in range(GOLAY_LENGTH)] + [0]
    for a in bits:
        for b in bits:
            for c in bits:
                errors[syndrome(a | b | c)] = a | b | c
    return low, high, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The message of the codeword whose sphere of radius 3 holds each 23-bit word."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> (GOLAY_LENGTH - GOLAY_MESSAGE)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fingerprint: (its place, key, 1 if the key is that of the fingerprint itself and not of a neighbour)."""
    values, places, keys, own = fingerprints.view(np.uint64), [], [], []
    cut = [((values >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for number, (equal, decoded) in enumerate(TABLES):
        flips = np.array([0] + [1 << i for i in range(SEGMENTS[decoded][1])], dtype=np.int64)
        index = golay_index(cut[decoded][:, None] ^ flips[None, :])
        home = index[:, 0]
        index = np.sort(index, axis=1)
        new = np.ones(index.shape, dtype=bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(new)
        picked = index[row, column]
        places.append(row)
        keys.append((np.int64(number) << 34) | (cut[equal][row] << 12) | picked)
        own.append(picked == home[row])
    return np.concatenate(places), np.concatenate(keys), np.concatenate(own).astype(np.int32)


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place, key, own = golay_keys(values)
    return pa.RecordBatch.from_arrays([pa.array(values[place]), pa.array(key), pa.array(own)], names=["fp", "key", "own"])


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct values `fp` with at most two differing bits.

    Keys with few candidate pairs are joined and each pair is verified. The members of a crowded key are linked through
    midpoints: two values differ in two bits at most exactly if some value is within one bit of both, and at most 65 values
    share a midpoint, so no key ever makes pairs by the square of its members.
    """
    keyed = arrow_map(fingerprints.select("fp"), _keys, "fp long, key long, own int")
    pairs = F.col("own") * (F.col("members") - 1)
    sizes = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("own").alias("own")).where("own > 0 and members > 1").select("key", (pairs > PAIRS_OF_A_KEY).alias("crowded")))
    live = checkpoint(keyed.join(sizes, "key"))
    few = live.where("not crowded")
    left, right = few.where("own = 1").select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = left.join(right, "key").where(F.col("a") != F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    stars = live.where("crowded").select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centres = stars.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return near.union(stars.join(centres, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def _classes(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row_key, fp, doc_id, root): root is the least fingerprint of the component."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    prints = arrow_map(narrow.select(F.struct("doc_id", "row_key").alias("row_key"), "text"), _fingerprints, f"row_key struct<doc_id: {dict(narrow.dtypes)['doc_id']}, row_key: string>, fp long")
    prints = checkpoint(prints.select("row_key.doc_id", "row_key.row_key", "fp"))
    distinct = prints.select("fp").distinct()
    roots = connected_components(fingerprint_links(distinct))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component).

    Null texts count as empty; all texts without a word have fingerprint zero and are linked like any other. A null doc_id
    keeps its row; component_id is null only if the whole component has no doc_id. Repeated rows stay repeated. Other
    columns are ignored, whatever they are called; an empty table gives an empty result.
    """
    found = _classes(docs, id_column, text_column)
    ids = found.groupBy("root", "fp").agg(F.min("doc_id").alias("low")).groupBy("root").agg(F.min("low").alias("component_id"))
    return found.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of `docs`, one row of each component: that with the least doc_id (null ids last, then the least text hash).

    Of repeated rows one stays. The texts are shuffled once, by a key of id and text.
    """
    (key,) = fresh(docs, "row_key")
    found = _classes(docs, id_column, text_column)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias(key))
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*(keyed[c] for c in docs.columns))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of consecutive runs of hashes, of these sizes (none is 0): bits set in over half of a run."""
    counts = np.zeros((len(sizes), 64), dtype=np.int64)
    run = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(run[at : at + HASHES_AT_ONCE], prepend=-1))
        counts[run[at + first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def part_keys(found: np.ndarray) -> np.ndarray:
    """Keys of the parts of a set of shingles: level, part and the codeword indices of the three segments of its fingerprint.

    A part is a sample of the set by hash at a rate that the level fixes. The level is that of the size; a set that may have
    a partner of the next level (at SIMILARITY or more) has the keys of both. Levels under 2 have one part, the whole set.
    """
    level = len(found).bit_length() - 1
    whole = level < 2
    mixed = (found >> np.uint64(32)).astype(np.uint32)
    limit = (1 << 32) if whole else (PART_SHINGLES << 32) >> level
    parts, rows, values = [], [], []
    for at in range(0, len(found), HASHES_AT_ONCE):
        dealt = mixed[None, at : at + HASHES_AT_ONCE] * _DEAL[: 1 if whole else PARTS, None]
        part, row = np.nonzero(dealt < limit)
        parts.append(part)
        rows.append(row + at)
        values.append(dealt[part, row])
    part, row, value = np.concatenate(parts), np.concatenate(rows), np.concatenate(values)
    order = np.argsort(part, kind="stable")
    part, hashes, value = part[order], found[row[order]], value[order]
    keys = [_keys_of_parts(level, part, hashes)]
    if len(found) >= SIMILARITY * (2 << level) - 1e-6 and not whole:
        keys.append(_keys_of_parts(level + 1, *(x[value < limit >> 1] for x in (part, hashes))))
    return np.concatenate(keys)


def _keys_of_parts(level: int, part: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    numbers, sizes = np.unique(part, return_counts=True)
    enough = (sizes >= PART_SHINGLES) | (level < 2)
    prints = majority(hashes[np.repeat(enough, sizes)], sizes[enough])
    keys = np.int64(level << 6) | numbers[enough].astype(np.int64)
    for at, width in SEGMENTS:
        keys = keys << np.int64(GOLAY_MESSAGE) | golay_index(((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
    return keys


def set_keys(found: np.ndarray) -> list[int]:
    """Of a set of shingles: its own fingerprint, then the keys of its parts; an empty one has none."""
    return [int(majority(found, np.array([len(found)])).view(np.int64)[0]), *part_keys(found).tolist()] if len(found) else []


def linked_sets(prints: DataFrame) -> DataFrame:
    """The set_id of the rows (set_id, keys of set_keys) whose own fingerprint differs from another one in two bits at most."""
    own = checkpoint(prints.where(F.size("keys") > 0).select("set_id", F.col("keys")[0].alias("fp")))
    linked = fingerprint_links(own.select("fp").distinct()).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return own.join(linked, "fp", "left_semi").select("set_id")


def drop_similar_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """As drop_similar at SIMILARITY, with the near copies proposed by SimHash: of whole sets by their links, of parts by their keys.

    At a similarity of 0.8 no part agrees, by calculation, for one pair in 17,000 at most, and for fewer above that.
    """
    return drop_similar(docs, id_column, text_column, words, SIMILARITY, set_keys, linked_sets)
