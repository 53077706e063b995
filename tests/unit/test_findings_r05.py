"""Findings of the fifth review: each test failed before its change."""

from pyspark.sql import functions as F

from tests.unit.test_findings_r04 import same_as_sql
from vellum.operators import by_class, latex_tree
from vellum.operators.boosting import Booster, Tree
from vellum.plans import catalogue


def test_parts_of_other_brands_and_sizes_are_compared(spark, tmp_path):
    """F8: parts of all brands and sizes, as members of classes and pairs of their first parts."""
    part = "SELECT i AS p_partkey, 'Brand#' || i AS p_brand, CAST(i AS INTEGER) AS p_size, 'n' AS p_name, ['A B', 'B C', 'D', 'B A'][i % 4 + 1] AS p_type FROM range(12) t(i)"
    found = same_as_sql(spark, tmp_path, "word_jaccard", part=part)
    assert sorted(found[found.kind == "member"].b) == list(range(12))
    pairs = {(a, b): j for kind, a, b, j in found.itertuples(index=False) if kind == "pair"}
    assert pairs == {(0, 1): 0.333333, (0, 2): 0.0, (0, 3): 1.0, (1, 2): 0.0, (1, 3): 0.333333, (2, 3): 0.0}


def test_tex_files_are_dealt_by_their_number(spark, monkeypatch):
    """small texts in great number are not read by one task, and a text is read in one go, outside of expressions."""
    monkeypatch.setattr(latex_tree, "TASK_FILES", 10)
    text = "\\title{T}\n\\begin{document}\n\\section{S}\nOne. Two.\n\\end{document}"
    found = spark.range(300).selectExpr("CAST(id AS STRING) AS pub_id", "'v' AS version", "'m.tex' AS file_name", "'m.tex' AS main_tex").withColumn("text", F.lit(text))
    nodes = latex_tree.parse_versions(found.drop("main_tex"), found)
    assert nodes.rdd.getNumPartitions() >= 30 and nodes.where("error is null").count() == 300 * 4
    assert [(row[4], row[5], row[7]) for row in latex_tree.parse_version(["m.tex"], [text], "m.tex")] == [("document", "T", None), ("section", "S", None), ("sentence", None, "One."), ("sentence", None, "Two.")]


def test_a_text_of_tasks_does_not_grow_with_the_product(spark, tmp_path, monkeypatch):
    """a large publication has several texts, and the tasks that are read again are those of the SQL."""
    place = str(tmp_path / "files")
    monkeypatch.setattr(catalogue, "new_folder", lambda _: place)
    monkeypatch.setattr(by_class, "TEXT_SCORES", 200, raising=False)
    part = "SELECT i AS p_partkey, 'red ' || (i % 41) AS p_name, 'Brand#' || (i // 200) AS p_brand, 'A' AS p_type, CAST(1 AS INTEGER) AS p_size FROM range(240) t(i)"
    assert len(same_as_sql(spark, tmp_path, "task_files", part=part)) == 100 * 100 + 20 * 20
    texts = [r.value for r in spark.read.text(place).collect()]
    assert len(texts) > 10 and max(map(len, texts)) < 40_000


def test_scores_are_looked_up_by_bins(spark):
    """where the combinations of bins are few, no tree is applied to a pair."""
    trees = [Tree([0, -1, 1, -1, -1, -1, -1], [1, 0, 0, 0, 0, 0, 0], [0.0, 0.1 + k, 0.0, 0.0, 0.0, 0.3, -0.7 / (k + 3)], [0.0] * 7) for k in range(3)]
    model = Booster(("a", "b"), ((0.5, 1.5, 2.5), (0.5,)), trees, 2)
    rows = spark.range(8).selectExpr("CAST(id DIV 2 AS INT) AS x", "CAST(id % 2 AS INT) AS y")
    looked = model.looked_up([F.col("x"), F.col("y")])
    assert "aggregate" not in str(looked)
    assert all(r.one == r.other for r in rows.select(looked.alias("one"), model.score(F.array("x", "y")).alias("other")).collect())
