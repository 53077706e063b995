import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vellum.llm.merkle import folded, leaf_digest, merkle_manifest, numbered, proof_digest
from vellum.llm.queries import op12_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """The root, and for each leaf its siblings from its level up."""
    paths, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        runs = [now[k : k + 3] for k in range(0, len(now), 3)]
        for leaf, place in enumerate(at):
            run = runs[place // 3]
            paths[leaf].append((place % 3, run[: place % 3] + run[place % 3 + 1 :]))
            at[leaf] = place // 3
        now = [h(*run) for run in runs]
    return now[0], paths


def brute(rows, leaf_of):
    """(row number, leaf, subroot, root, path) of rows (source, id, ...)."""
    groups: dict = {}
    for k, row in enumerate(rows):
        groups.setdefault(row[0], []).append((row[1] is not None, row[1] or 0, leaf_of(row), k))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {name: tree([x[2] for x in sorted(groups[name])]) for name in names}
    root, above = tree([done[n][0] for n in names])
    return [(x[3], x[2], done[n][0], root, path + above[g]) for g, n in enumerate(names) for x, path in zip(sorted(groups[n]), done[n][1], strict=True)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {"a": 4, "b": 1, None: 2}, {"a": 100, "é": 10, "Z": 27, "b": 28, None: 1, "": 9}])
def test_trees_agree_with_brute_force(spark, sizes):
    draw = random.Random(len(sizes))
    rows = [(s, i, draw.choice("xy") * i) for s, n in sizes.items() for i in range(n)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "source string, doc_id long, text string, k int")
    got = merkle_manifest(docs, leaf_digest([F.col("doc_id"), F.col("text")]))
    got = got.withColumn("again", folded(F.col("leaf"), F.col("path"))).withColumn("other", folded(F.sha2(F.lit("no"), 256), F.col("path"))).collect()
    want = {k: rest for k, *rest in brute(rows, lambda r: h(field(r[1]), field(r[2])))}
    assert len(got) == len(rows)
    for r in got:
        assert [r["leaf"], r["subroot"], r["root"], [(s["place"], list(s["siblings"])) for s in r["path"]]] == want[r["k"]]
        assert r["again"] == r["root"] != r["other"]


def test_odd_rows_and_clashing_names(spark, odd):
    docs = odd.withColumnRenamed("fp", "root").withColumnRenamed("kept", "PLACE").withColumnRenamed("shard", "g")
    got = merkle_manifest(docs, leaf_digest([F.col("doc_id"), F.col("text")]))
    assert got.columns == [*docs.columns, "leaf", "subroot", "root_", "path"]
    rows = [(r["source"], r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((leaf, sub, root) for _, leaf, sub, root, _ in brute(rows, lambda r: h(field(r[1]), field(r[2]))))
    assert sorted((r["leaf"], r["subroot"], r["root_"]) for r in got.collect()) == want
    assert {r[0] for r in got.select(folded(F.col("leaf"), F.col("path"))).collect()} == {want[0][2]}
    empty = merkle_manifest(docs.limit(0), leaf_digest([F.col("doc_id")]))
    assert empty.columns == got.columns
    assert empty.count() == 0


def test_numbers_are_gapless_in_hot_groups(spark):
    rows = [(i % 7 and 1, i % 50, str(i)) for i in range(3000)] + [(None, None, "x")] * 5
    got = numbered(spark.createDataFrame(rows, "g long, i long, s string"), ["g"], ["i", "s"], "place").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["place"], r["i"] is not None, r["i"], r["s"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("source", "doc_id", "lang", "n_chars", "text").collect()]

    def leaf(r, text=None):
        return h(*(field(x) for x in (r[1], r[0], r[2], r[3], r[4] if text is None else text)))

    want = {}
    for k, mine, sub, root, path in brute(rows, leaf):
        now = leaf(rows[k], rows[k][4].replace("\n", "") if zlib.crc32(str(rows[k][1]).encode()) % 2 == 0 and rows[k][4] is not None else None)
        for place, siblings in path:
            now = h(*siblings[:place], now, *siblings[place:])
        want[rows[k][1]] = (mine, sub, root, h(*(d for _, s in path for d in s)), now, now == root)
    got = {r["doc_id"]: tuple(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in op12_merkle_manifest(spark, SMALL).collect()}
    assert got == want
    assert {v[-1] for v in want.values()} == {True, False}


def test_proof_of_a_single_row(spark):
    docs = spark.createDataFrame([("s", 1)], "source string, doc_id long")
    got = merkle_manifest(docs, leaf_digest([F.col("doc_id")])).withColumn("proof", proof_digest(F.col("path"))).first()
    assert got["leaf"] == got["subroot"] == got["root"]
    assert got["proof"] == h()
