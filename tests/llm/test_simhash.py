import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vellum.llm.graph import connected_components
from vellum.llm.simhash import PAIRS_OF_A_KEY, drop_near_copies, fingerprint, fingerprint_links, golay_index, golay_keys, near_copies


def brute_components(values):
    low = {v: v for v in values}

    def root(v):
        while low[v] != v:
            v = low[v]
        return v

    values = list(low)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def brute_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_is_the_majority_of_shingle_bits():
    for text in ("", " \n", "One", "one TWO", "a b c", "Ünï É b c d e f", "to be or not to be " * 3000):
        assert fingerprint(text) == brute_fingerprint(text)


def test_golay_code_is_perfect_and_keys_meet():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = golay_index(words)
    assert index.min() >= 0 and index.max() < 4096
    values = np.random.default_rng(2).integers(0, 1 << 63, 300, dtype=np.int64)
    for flips in range(3):
        others = values.copy()
        for _ in range(flips):
            others ^= np.left_shift(np.int64(1), np.random.default_rng(flips).integers(0, 62, 300))
        place, key, own = golay_keys(np.concatenate([values, others]))
        for i in range(300):
            assert set(key[(place == i) & (own == 1)]) & set(key[place == i + 300])


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3)]
    centre = rng.getrandbits(64)
    values += [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, a, 3)]  # one crowded key and more
    values = sorted(set(map(signed, values)))
    assert len(values) > 2 * PAIRS_OF_A_KEY
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in connected_components(fingerprint_links(frame)).collect()}
    want = brute_components([v & (1 << 64) - 1 for v in values])
    groups = {}
    for v in values:
        groups.setdefault(want[v & (1 << 64) - 1], []).append(v)
    assert {v: got.get(v, v) for v in values} == {v: min(g) for g in groups.values() for v in g}


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    roots = brute_components(prints.values())
    low = {}
    for d, p in prints.items():
        low[roots[p]] = min(low.get(roots[p], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_copies(docs).collect()}
    assert got == {d: (f"{p:016x}", low[roots[p]]) for d, p in prints.items()}
    kept = sorted(r.doc_id for r in drop_near_copies(docs).collect())
    assert kept == sorted(low.values())


def test_odd_rows(spark, odd):
    got = near_copies(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7  # rows 3 and 4 are like the null text of row 2; the other row 2 is not
    assert near_copies(odd.limit(0)).count() == 0 and drop_near_copies(odd.limit(0)).count() == 0
