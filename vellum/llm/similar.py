"""Near copies by exact similarity: keys of the sets of word shingles tell which to look at, the whole sets decide.

The keys are a parameter: those of SimHash fingerprints (`simhash.drop_similar_copies`) or MinHash keys. A MinHash key is the
hash of ROWS minima of the set; two sets of Jaccard j agree in each of the BANDS keys with probability j ** ROWS, so at 0.8
all keys differ for one pair in 17,000, and for fewer above that. In a large group of looser copies nearly all sets share
keys, so the sets that share any are held against each other by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, checkpoint, fresh, marked, marks, row_key, strings
from vellum.llm.graph import connected_components

#: Words of a shingle, and the Jaccard similarity of the sets of shingles from which texts are near copies.
WORDS, SIMILARITY = 5, 0.8
#: Keys of a text, minima in each, and shingles worked on at once.
BANDS, ROWS, BLOCK = 32, 6, 512
_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of all word shingles; fewer words make one shingle, no word gives none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    parts = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    return np.unique(np.fromiter((digest(b" ".join(p), 42) for p in parts), dtype="<u8"))


def minhash_keys(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles; an empty one has none."""
    if not len(found):
        return []
    values, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(values), BLOCK):
        np.minimum(least, (values[at : at + BLOCK, None] * _FACTORS).min(axis=0), out=least)
    raw = least.tobytes()
    return [_signed(xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], i)) for i in range(BANDS)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _set_id(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), 42)) if len(found) else 0


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (shingle, set_id, n, pos): of each set its rarest shingles, as many as one that is similar enough must share one of.

    Shingles are ordered by the number of sets that hold them, then by hash; pos is the place of a shingle in its set.
    Shingles of one set only come first and give no rows, so a set with many of its own meets no other set.
    """

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(flat)], names=["set_id", "n", "shingle"])

    held = arrow_map(sets, spread, "set_id long, n long, shingle long", rows=50)
    common = held.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    ordered = held.join(common, "shingle").groupBy("set_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("found"))
    own = ordered.withColumn("own", F.col("n") - F.size("found"))
    length = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1 - F.col("own")).cast("int")
    rows = own.where(length > 0).select("set_id", "n", "own", F.posexplode(F.slice("found", F.lit(1), length)).alias("at", "rare"))
    return rows.select(F.col("rare.shingle").alias("shingle"), "set_id", "n", (F.col("own") + F.col("at")).alias("pos"))


def similar_links(prints: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of proposed sets that are at least so similar.

    `prints` has rows (row_key, set_id, n, keys), `texts` rows (row_key, text); texts of one set_id have the same shingles.
    Sets that share a key with another are proposed, and those that `linked` tells of `prints`. Which of them are compared is
    told by their rarest shingles: two sets that are similar enough share one of these, and after the first they share enough
    must be left of both. Of each rare shingle the members are first compared with the one that holds it earliest. Sets in one
    component by then cannot change the components; those outside the main component of a shingle are compared with its
    members in the second round.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in strings(batch.column(1))], pa.binary())], names=["set_id", "found"])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    keyed = prints.select("set_id", F.explode("keys").alias("key"))
    shared = checkpoint(keyed.groupBy("key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a <> b").select("key"))
    live = marked(keyed, "key", marks(shared)).join(shared, "key", "left_semi").select("set_id")
    live = checkpoint((live.union(linked(prints)) if linked else live).distinct())
    chosen = checkpoint(prints.join(live, "set_id", "left_semi").groupBy("set_id").agg(F.min("row_key").alias("row_key")))
    picked = marked(texts, "row_key", marks(chosen.select("row_key"))).join(chosen, "row_key").dropDuplicates(["row_key"])  # repeated rows
    sets = checkpoint(arrow_map(picked.select("set_id", "text"), cut, "set_id long, found binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs)
        left, right = (marked(sets, "set_id", marks(pairs.select(c))).toDF(c, found) for c, found in (("a", "x"), ("b", "y")))
        return checkpoint(arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), judge, "a long, b long"))

    def may_be_similar(n: str, pos: str, other_n: str, other_pos: str):
        """Enough shingles are left of both from the first common one on."""
        left = F.least(F.col(n) - F.col(pos), F.col(other_n) - F.col(other_pos))
        return left >= F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(other_n)) - F.lit(1e-6)

    rare = checkpoint(_prefixes(sets, similarity))
    pivots = rare.groupBy("shingle").agg(F.min(F.struct(F.col("pos") / F.col("n"), "set_id", "n", "pos")).alias("p"), F.count("*").alias("members")).where("members > 1").select("shingle", F.col("p.set_id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos"))
    met = rare.join(pivots, "shingle")
    first = verified(met.where("set_id <> pivot").where(may_be_similar("n", "pos", "pivot_n", "pivot_pos")).select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b")).distinct())
    roots = connected_components(first)
    placed = checkpoint(met.select("shingle", "set_id", "n", "pos", "pivot").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    main = placed.groupBy("shingle", "root").agg(F.count("*").alias("members")).groupBy("shingle").agg(F.max(F.struct("members", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("shingle", F.col("most.root").alias("main"))
    open_ = placed.where("set_id <> pivot").join(main, "shingle")  # the pivot has been compared with all
    left = open_.where("root <> main").select("shingle", "main", F.col("set_id").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("root").alias("a_root"))
    right = open_.select("shingle", F.col("set_id").alias("b"), "n", "pos", "root")
    second = left.join(right, "shingle").where("a_root <> root and (root = main or a < b)").where(may_be_similar("a_n", "a_pos", "n", "pos"))
    return first.union(verified(second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))


def drop_similar(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    keys: Callable[[np.ndarray], Sequence[int]] = minhash_keys, linked: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The columns of `docs`, one row of each component of near copies: that with the least doc_id (null ids last, then the least text hash).

    Near copies are texts whose sets of word shingles have at least this Jaccard similarity, counted on the whole sets, of
    those that `keys` and `linked` propose. Null texts are empty, and all texts without a word are one component. Of
    repeated rows one stays. Rows that are alone in their component are not shuffled.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in strings(batch.column(1))]
        columns = [pa.array(map(_set_id, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(keys, found), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "set_id", "n", "keys"])

    (key,) = fresh(docs, "row_key")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    schema = f"row struct<doc_id: {dict(narrow.dtypes)['doc_id']}, row_key: string>, set_id long, n long, keys array<long>"
    prints = checkpoint(arrow_map(narrow.select(F.struct("doc_id", "row_key").alias("row"), "text"), step, schema).select("row.doc_id", "row.row_key", "set_id", "n", "keys"))
    rows = prints.select("doc_id", "row_key", "set_id")
    roots = connected_components(similar_links(prints, narrow.select("row_key", "text"), words, similarity, linked))
    found = checkpoint(rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    groups = checkpoint(found.groupBy("root").agg(first, F.count("*").alias("rows")))
    kept = groups.select(F.col("first.row_key").alias(key))
    several = marks(found.join(groups.where("rows > 1"), "root", "left_semi").select("row_key"))
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    alone = marked(keyed, key, several, among=False)
    others = marked(keyed, key, several).join(kept, key, "left_semi").dropDuplicates([key])
    return alone.select(*(alone[c] for c in docs.columns)).union(others.select(*(others[c] for c in docs.columns)))
