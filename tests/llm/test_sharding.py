import zlib

from pyspark.sql import functions as F

from tests.conftest import SMALL
from vellum.llm import sharding
from vellum.llm.sharding import shard_documents


def check(rows, texts, even):
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text_crc32) for r in rows) == sorted(((d is None, d or 0), zlib.crc32((t or "").encode())) for d, t in texts)
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        by.setdefault(r.shard, []).append(r)
    for got in by.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(24)]
    assert sum(sizes) == sum(len((t or "").encode()) + 8 for _, t in texts)
    if even:
        assert max(sizes) - min(sizes) <= even


def test_sizes_are_near_equal_also_with_a_third_in_one_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 40))).alias("text"))
    rows = shard_documents(docs, carry=["doc_id"]).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2 * 250)


def test_several_ranges_make_one_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 2000)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    check(shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 400)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(shard_documents(docs, carry=["doc_id"]).collect(), [(r.doc_id, r.text) for r in docs.collect()], 0)


def test_odd_rows(spark, odd):
    made = shard_documents(odd)
    assert made.columns[: len(odd.columns)] == odd.columns
    rows = made.select("doc_id", F.col("size_").alias("size"), "text_crc32", "law", F.col("shard_").alias("shard"), "slot", "grown_shard").collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 0)
    assert shard_documents(odd.limit(0)).count() == 0


def test_many_ranges_take_few_rounds_and_few_probes(spark, monkeypatch):
    keyed = spark.range(40_000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("l"), (F.col("id") % 50 + 8).alias("size"))
    seen = []
    monkeypatch.setattr(sharding, "histogram", lambda k, b, count=sharding.histogram: seen.append(len(b)) or count(k, b))
    edges = sharding.splitters(keyed, 240, ranges=10)
    assert len(seen) <= 8 and max(seen) <= 240 * (sharding.PROBES_OF_EACH + 1) + 24 * sharding.PROBES
    counted = sharding.histogram(keyed, edges)
    sizes = counted["bytes"].to_numpy()
    shards = [sizes[i : i + 10].sum() for i in range(0, 240, 10)]
    assert max(shards) - min(shards) <= 0.004 * sum(shards) / 24 + 2 * 58 and sizes.max() <= 1.6 * sizes.mean()


def test_groups_of_equal_texts_stay_whole(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat((F.col("id") % 900).cast("string"), 20).alias("text"))
    for size in (sharding.RANGE_BYTES, 3000):
        monkeypatch.setattr(sharding, "RANGE_BYTES", size)
        rows = shard_documents(docs).collect()
        check(rows, [(r.doc_id, r.text) for r in docs.collect()], 0)
        assert all(len({r.shard for r in rows if r.doc_id % 900 == k}) == 1 for k in range(0, 900, 7))
        assert len({(r.shard, r.doc_id % 900) for r in rows}) == 900
        sizes = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
        assert max(sizes) - min(sizes) <= 2 * 7 * 68  # a group of seven rows at either end
