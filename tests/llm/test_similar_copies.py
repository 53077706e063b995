import random

import numpy as np

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_similar import brute_kept, brute_sets, near_rows
from vellum.llm import common, simhash
from vellum.llm.simhash import PARTS, RADIUS, drop_similar_copies, linked_sets, majority, part_keys, set_keys
from vellum.llm.similar import jaccard, shingles


def brute_majority(hashes):
    return sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes) * 2 > len(hashes))


def test_the_stage_takes_its_near_copies_from_simhash(spark, monkeypatch):
    """The links of whole fingerprints are asked for, and without fingerprints only equal sets are found."""
    asked, links = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints: asked.append(1) or links(prints))
    rows = near_rows(8)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def kept():
        return sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect())

    assert kept() == brute_kept(rows) and asked
    monkeypatch.setattr(simhash, "set_keys", lambda found: [])
    least = {}
    for d, t in rows:
        least.setdefault(frozenset(brute_sets(t)), d)
    assert kept() == sorted(least.values()) != brute_kept(rows)


def test_fingerprints_of_runs():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 3, 7, 9000, 1])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, sizes.sum(), dtype=np.uint64)
    ends = np.cumsum(sizes)
    assert [int(f) for f in majority(hashes, sizes)] == [brute_majority(hashes[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def test_parts_meet_at_the_least_similarity():
    """Also where sizes lie on two levels, and with the differences on both sides."""
    rng = random.Random(6)
    for n in [*range(1, 140), 255, 256, 257, 1000, 20_000]:
        pool = np.array([rng.getrandbits(64) for _ in range(2 * n)], dtype=np.uint64)
        for cut in (n // 5, n // 9):
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[cut:n], pool[n : n + (cut if 9 * cut <= n else 0)]]))
            assert jaccard(a, b) >= 0.8 and set(part_keys(a).tolist()) & set(part_keys(b).tolist())
        assert len(part_keys(a)) <= 2 * PARTS and len(set(part_keys(a).tolist())) == len(part_keys(a))
    others = np.array([rng.getrandbits(64) for _ in range(1000)], dtype=np.uint64)
    assert not set(part_keys(np.sort(others[:500])).tolist()) & set(part_keys(np.sort(others[500:])).tolist())
    assert set_keys(shingles(" \n")) == []


def test_linked_sets_match_brute_force(spark):
    rows = near_rows(11)
    keys = {i: set_keys(shingles(t)) for i, t in rows}
    frame = spark.createDataFrame([(i, k) for i, k in keys.items()], "set_id long, keys array<long>")
    prints = {k[0] for k in keys.values()}
    near = {p for p in prints for q in prints if p != q and ((p ^ q) & (1 << 64) - 1).bit_count() <= RADIUS}
    got = {r.set_id for r in linked_sets(frame).collect()}
    assert got == {i for i, k in keys.items() if k[0] in near} and got


def test_odd_rows_and_crowded_bitmaps(spark, odd, monkeypatch):
    """Chance hits in the bitmaps change nothing."""
    rows = near_rows(9)
    frame = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    for size in (1 << 23, 128):
        monkeypatch.setattr(common, "MARKS", size)
        kept = drop_similar_copies(odd)
        assert kept.columns == odd.columns and kept.count() == 7
        assert drop_similar_copies(odd.limit(0)).count() == 0
        assert sorted(r.doc_id for r in drop_similar_copies(frame).collect()) == brute_kept(rows)
