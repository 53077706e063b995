import hashlib
import random

from vellum.operators import tree_dedup

NAMES = "pub_id string, version string, preorder int, parent_preorder int, depth int, node_type string, full_text string"


def tree(draw, version, n, most, cut=0.3):
    """Rows of a random tree in preorder, up to `most` levels deep, and its hashes by recursion."""
    rows, path = [], []
    for at in range(n):
        del path[draw.randrange(1, len(path) + 1) if path and draw.random() < cut else len(path) :]
        del path[most:]
        rows.append(("p", version, at, path[-1] if path else None, len(path), draw.choice(("section", "sentence")), draw.choice("abc")))
        path.append(at)
    children: dict = {}
    for r in rows:
        children.setdefault(r[3], []).append(r[2])
    hashes: dict = {}
    for r in reversed(rows):
        hashes[r[2]] = hashlib.sha256((r[5] + r[6] + "".join(hashes[c] for c in children.get(r[2], []))).encode()).hexdigest()
    return rows, {(version, k): h for k, h in hashes.items()}


def test_deep_trees_are_hashed_in_one_pass(spark):
    draw, rows, want = random.Random(4), [], {}
    for k, (n, most, cut) in enumerate([(1, 1, 0), (2, 5, 0.3), (300, 50, 0.03), (300, 3, 0.3), (200, 200, 0.005), (1500, 2, 0.3)]):
        more, hashes = tree(draw, f"v{k}", n, most, cut)
        rows += more
        want |= hashes
    assert max(r[4] for r in rows) >= 50
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, NAMES)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("hashes", "")
    made = tree_dedup.subtree_hashes(frame)
    assert len(jobs.getJobIdsForGroup("hashes")) <= 4  # not one for each level
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.version, r.preorder): r.subtree_hash for r in made.collect()} == want
    assert made.columns == [*frame.columns, "subtree_hash"]
    assert tree_dedup.subtree_hashes(frame.limit(0)).count() == 0
