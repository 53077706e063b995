import os

import pytest
from pyspark.sql import functions as F

from vellum.sources import files, folders


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}


def test_files_get_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", f"text {i}\né" * i) for i in range(40)], "pub_id string, json string").repartition(5)
    root = str(tmp_path / "out")
    folders.write_files(rows, root, "json")
    assert tree(root) == {f"p{i}/p{i}.json": f"text {i}\né" * i for i in range(40)}
    folders.write_files(rows.where("pub_id < 'p2'").withColumn("json", F.lit("new")), root, "json")
    folders.write_files(rows.where("pub_id = 'p3'"), f"file:{root}", "json", "{key}/refs.bib")
    found = tree(root)
    assert len(found) == 41 and found["p1/p1.json"] == "new" and found["p3/refs.bib"] == "text 3\né" * 3 and found["p9/p9.json"] == "text 9\né" * 9
    folders.write_files(rows.limit(0), root, "json")
    assert tree(root) == found


@pytest.mark.parametrize("bad", [[("a", "x"), ("a", "y")], [("a", "x"), (None, "y")], [("a", "x"), ("../b", "y")], [("a", None)]])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    root = tmp_path / "out"
    with pytest.raises(Exception, match="same key|named after"):
        folders.write_files(spark.createDataFrame(bad, "pub_id string, json string"), str(root), "json")
    assert tree(root) == {}


def test_only_the_committed_attempt_counts(tmp_path):
    root = str(tmp_path)
    writer = folders.Files(root, "{key}.txt", ["key", "text"])
    lost, kept = writer.write(iter([("a", "lost"), ("b", "lost")])), writer.write(iter([("a", "kept"), ("b", "kept")]))
    writer.commit([kept, None])
    assert tree(root) == {"a.txt": "kept", "b.txt": "kept"} and lost.moves != kept.moves
    again = folders.Files(root, "{key}.txt", ["key", "text"])
    again.write(iter([("a", "half")]))
    again.abort([None])
    assert tree(root) == {"a.txt": "kept", "b.txt": "kept"} and len(os.listdir(root)) == 2


def test_listing_sees_empty_folders(spark, tmp_path):
    for path in ("0001-00001/tex/0001-00001v1", "0001-00002/tex", "0001-00003", "0001-00004/tex/other"):
        os.makedirs(tmp_path / path)
    for pub in ("0001-00001", "0001-00002", "0001-00004"):
        for name in ("metadata", "references"):
            (tmp_path / pub / f"{name}.json").write_text("{}")
    (tmp_path / "loose.txt").write_text("x")
    found = {r.pub_id: (r.has_metadata, r.has_references, r.has_tex, r.versions, r.status) for r in files.scan(folders.list_folders(spark, str(tmp_path))).collect()}
    assert found == {
        "0001-00001": (True, True, True, ["0001-00001v1"], "READY"), "0001-00002": (True, True, True, [], "NO_TEX"), "0001-00003": (False, False, False, [], "INVALID"), "0001-00004": (True, True, True, [], "NO_TEX"),
    }
    os.makedirs(tmp_path / "none" / "here")
    assert files.scan(folders.list_folders(spark, str(tmp_path / "none" / "here"))).count() == 0
    with pytest.raises(ValueError, match="no such folder"):
        folders.list_folders(spark, str(tmp_path / "missing"))
