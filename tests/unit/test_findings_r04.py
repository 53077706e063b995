"""Findings of the fourth review: each test failed before its change."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from tests.unit.test_boosting import frame, made
from tests.unit.test_catalogue import rows
from vellum.operators import boosting, by_class, features, matching, pairing, ranking, tree_dedup
from vellum.operators.boosting import Settings, boost
from vellum.plans import catalogue, summaries
from vellum.plans.catalogue import ORACLE, QUERIES


def same_as_sql(spark, folder, name, **tables):
    """A query beside its SQL on made tables, each written from a SELECT of DuckDB."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)
    return found


def test_abbreviations_in_a_row(spark, tmp_path):
    texts = ("Ends in la no. No. It goes on. p. pp. vs. No.\nX Y. Z.", "Fig. Fig. cf.", "a.p. b", "")
    same_as_sql(spark, tmp_path, "split_sentences", documents=" UNION ALL ".join(f"SELECT {k} AS doc_id, '{t}' AS text" for k, t in enumerate(texts)))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(pairing, "TASK_PAIRS", 100)
    rows = spark.range(61).selectExpr("id", "CASE WHEN id < 40 THEN 'hot' ELSE CAST(id % 3 AS STRING) END AS g", "id % 4 AS v")
    other = rows.selectExpr("g", "id AS o_id", "v AS o_v")
    one, right, on = pairing.dealt(rows, other, ["g"], ["id"])
    assert one.where("g = 'hot'").select("_block").distinct().count() > 8 and one.rdd.getNumPartitions() > 16
    want = {(a, b) for a in range(61) for b in range(61) if a < b and ((a < 40 and b < 40) or (a >= 40 and b >= 40 and a % 3 == b % 3))}
    for few in (0, 100):  # worked out for each pair, and looked up
        monkeypatch.setattr(pairing, "FEW", few)
        made = pairing.pairs_with(rows, other, ["g"], ["id"], {"s": (["v"], ["o_v"], F.col("v") * 10 + F.col("o_v"))}, ["id", "o_id"], F.col("id") < F.col("o_id"))
        got = [(r["id"], r["o_id"], r["s"]) for r in made.collect()]
        assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want and all(s == a % 4 * 10 + b % 4 for a, b, s in got)


def test_flat_trees_are_hashed_by_levels(spark, monkeypatch):
    nodes = [("p", "v", 0, None, 0, "document", "r")] + [("p", "v", k, 0, 1, "sentence", str(k)) for k in range(1, 40)]
    frame = spark.createDataFrame(nodes, "pub_id string, version string, preorder int, parent_preorder int, depth int, node_type string, full_text string")
    monkeypatch.setattr(tree_dedup, "_in_one_pass", None)  # a version's nodes are not gathered in one array
    made = {r.preorder: r.subtree_hash for r in tree_dedup.subtree_hashes(frame).collect()}
    leaf = lambda k: hashlib.sha256(f"sentence{k}".encode()).hexdigest()
    assert made == {k: leaf(k) for k in range(1, 40)} | {0: hashlib.sha256(("documentr" + "".join(map(leaf, range(1, 40)))).encode()).hexdigest()}


def test_entries_meet_their_labels_before_they_make_pairs(spark):
    none = F.array().cast("array<string>")
    shared = {n: none if n in ("normalized_authors", "author_tokens") else F.lit("x") for n in matching.SHARED}
    bibs = spark.range(4).select(F.lit("p").alias("pub_id"), F.col("id").cast("string").alias("key"), F.col("id").alias("ref_ord"), F.lit("r").alias("ref_id")).withColumns(shared)
    papers = spark.range(3).select(F.lit("p").alias("pub_id"), F.col("id").cast("string").alias("arxiv_id"), F.col("id").alias("cand_ord")).withColumns(shared)
    labels = spark.createDataFrame([("p", "0", "1", 1, 1), ("p", "0", "2", 1, 2), ("p", "1", "9", 1, 1), ("p", "7", "1", 1, 1), ("p", "2", "0", 0, 1), ("p", "3", "0", 1, 1)], "pub_id string, bib_key string, arxiv_id string, label int, ord long")
    pairs = matching.candidates(bibs, papers)
    one, other = (sorted((r.bib_key, r.candidate_arxiv_id, r.label) for r in matching.manual_pairs(labels, pairs, *sides).collect()) for sides in ((), (bibs, papers)))
    assert one == other == [("0", "0", 0), ("0", "1", 0), ("0", "2", 1), ("3", "0", 1), ("3", "1", 0), ("3", "2", 0)]


def test_features_are_counted_by_values(spark):
    """the summary of features holds a row for each pair of values, not for each pair."""
    found = {"a": (["x"], ["y"], F.col("x") / F.col("y")), "b": (["x"], ["y"], F.col("x") + F.col("y")), "c": (["u"], ["y"], F.when(F.col("u") == "n", float("nan")).otherwise(F.when(F.col("u") == "i", float("inf")).otherwise(F.col("y"))))}
    left = spark.range(90).selectExpr("id", "CAST(id % 3 AS STRING) AS g", "IF(id % 2 = 0, NULL, 1.0D) AS x", "CASE id % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'i' WHEN 2 THEN NULL ELSE 'u' END AS u")
    right = spark.range(40).selectExpr("CAST(id % 4 AS STRING) AS g", "CAST(id % 2 + 1 AS DOUBLE) AS y")
    watched = summaries.watch_feature_values(left, right, ["g"], found)
    assert watched.rows.count() < 30
    pairs = left.join(right, "g").withColumns({n: said for n, (_, _, said) in found.items()})
    value = lambda condition: sum(F.sum(F.coalesce(condition(F.col(n)).cast("int"), F.lit(0))) for n in found)
    want = pairs.agg(F.count("*").alias("samples"), value(lambda x: x.isNull() | F.isnan(x)).alias("missing"), value(lambda x: F.abs(x) == float("inf")).alias("infinite")).first().asDict()
    assert watched.values() == want and want["samples"] == 900 and want["missing"] and want["infinite"]


def test_a_ranker_by_classes_is_that_of_all_pairs(spark):
    """F5, F7, F8: negatives, validation ranks and best candidates of classes of alike entries and papers are those of all pairs."""
    part = spark.range(420).selectExpr("id AS k", "CAST(id % 4 AS STRING) AS pub_id", "concat('red ', element_at(array('ring', 'bolt', 'rings', 'nail'), CAST(pmod(xxhash64(id), 4) AS INT) + 1)) AS normalized_title", "element_at(array('A', 'AB', NULL), CAST(pmod(xxhash64(id, 1), 3) AS INT) + 1) AS a", "CAST(2000 + id % 3 * 3 AS STRING) AS normalized_year")
    part = part.withColumns({"normalized_authors": F.array("a"), "author_tokens": F.array(F.array("a")), "first_author_last": F.col("a")})
    key = F.col("k").cast("string")
    bibs = part.where("k % 8 < 4").withColumns({"key": key, "ref_id": key, "ref_ord": F.col("k")}).drop("k", "a")
    papers = part.where("k % 8 >= 4").withColumns({"arxiv_id": key, "cand_ord": F.col("k")}).drop("k", "a")
    found, names = features.of_values(), list(features.FEATURES)
    pairs = features.pair_features(matching.auto_pairs(matching.scored_candidates(bibs, papers, more=found))).cache()
    sides = by_class.sides(bibs, papers)
    assert sides.left.count() < bibs.count() / 1.5

    def at(rows, *columns):
        return sorted(map(tuple, rows.select(*columns).collect()), key=str)

    vector = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names))
    want = ranking.sample_negatives(pairs.withColumn("q", ranking.query_id(F.col("pub_id"), F.col("bib_key"))), vector, "q", "label", "candidate_arxiv_id")
    columns = ("pub_id", "bib_key", "candidate_arxiv_id", "label", *names)
    got = by_class.sampled_pairs(sides, found).join(sides.entries.withColumnRenamed("key", "bib_key"), ["pub_id", "_e"])
    assert at(got, *columns) == at(want, *columns)
    valid, s = F.col("pub_id") == "1", Settings(rate=0.3, rounds=4, patience=2, depth=3, least_weight=0.1)
    one, other = by_class.train_ranker(sides, valid, settings=s), ranking.train_ranker(pairs.where(~valid), pairs.where(valid), settings=s)
    assert one == other and one.trees
    columns = ("pub_id", "bib_key", "candidate_arxiv_id", "score", "rank")
    assert at(by_class.top_candidates(sides, one), *columns) == at(ranking.top_candidates(pairs, other.score()), *columns)


def test_levels_of_many_bins_are_added_up_by_spark(spark, monkeypatch):
    """sums by all bins come to the driver only where they are few; else the same trees come of an aggregation for each level."""
    rows, s = made(6), Settings(rate=0.3, rounds=3, depth=3, patience=3)
    one = boost(frame(spark, rows), frame(spark, made(7)), ("a", "b", "c"), ["q"], "y", "id", s)
    monkeypatch.setattr(boosting, "FEW", 0)
    assert one == boost(frame(spark, rows), frame(spark, made(7)), ("a", "b", "c"), ["q"], "y", "id", s) and one.trees


def test_csv_tables_grow_with_their_sides(spark, tmp_path, monkeypatch):
    """the files hold each entry and each paper once, and the pairs that are read again are those of the SQL."""
    place = str(tmp_path / "files")
    monkeypatch.setattr(catalogue, "new_folder", lambda _: place)
    part = "SELECT i AS p_partkey, 'red ' || (i % 7) AS p_name, 'Brand#' || (i // 200) AS p_brand, 'A B' AS p_type, CAST(1 AS INTEGER) AS p_size FROM range(240) t(i)"
    found = same_as_sql(spark, tmp_path, "csv_pairs", part=part)
    assert len(found) == 100 * 100 + 20 * 20
    assert spark.read.option("recursiveFileLookup", "true").option("header", "true").csv(place).count() == 240


def test_task_files_hold_what_is_alike_once(spark, tmp_path, monkeypatch):
    """the tasks that are read again are those of the SQL, from texts that do not hold each pair."""
    place = str(tmp_path / "files")
    monkeypatch.setattr(catalogue, "new_folder", lambda _: place)
    part = "SELECT i AS p_partkey, 'red ' || (i % 3) AS p_name, 'Brand#' || (i // 200) AS p_brand, 'A' AS p_type, CAST(1 AS INTEGER) AS p_size FROM range(240) t(i)"
    found = same_as_sql(spark, tmp_path, "task_files", part=part)
    assert len(found) == 100 * 100 + 20 * 20
    texts = [r.value for r in spark.read.text(place).collect()]
    assert len(texts) == 2 and sum(map(len, texts)) < 3 * len(found)
