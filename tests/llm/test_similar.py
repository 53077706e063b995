import random

import corpus_pipeline
from tests.conftest import SMALL
from vellum.llm.similar import drop_similar, jaccard, minhash_keys, shingles


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The least id of each component of pairs with Jaccard similarity 0.8 or more, by all pairs."""
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def near_rows(seed=5):
    """Texts of 20 to 200 words, each with copies that have one word changed, added or cut for each 40, and looser ones."""
    rng, rows = random.Random(seed), []
    for group in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))]
        rows.append(" ".join(words))
        for edits in (0, max(1, len(words) // 80), max(1, len(words) // 40), len(words) // 12):
            other = list(words)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice(([f"x{group}"], [other[at], "y"], []))
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_kept_documents_match_brute_force(spark):
    rows = near_rows()
    want = brute_kept(rows)
    assert 40 < len(want) < 140
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(frame).collect()) == want
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()) == want
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_a_second_round_finds_what_the_least_member_does_not(spark):
    """A chain of texts, each like the next one only: no member of a key is like all others."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    rows += [(100 + i, " ".join(f"{'z' if j % 60 == i else 'v'}{j}" for j in range(180))) for i in range(60)]
    assert sorted(r.doc_id for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_kept(rows)


def test_keys_meet_at_the_least_similarity():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(10, 300)
        words = [f"k{rng.randrange(10**6)}" for _ in range(n + 4)]
        a, b = shingles(" ".join(words)), shingles(" ".join(words[: -(n // 5) or None]))
        if jaccard(a, b) >= 0.8:
            assert set(minhash_keys(a)) & set(minhash_keys(b))
    assert minhash_keys(shingles(" \n")) == [] and jaccard(shingles(""), shingles(" ")) == 1.0


def test_odd_rows(spark, odd):
    kept = drop_similar(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert drop_similar(odd.limit(0)).count() == 0


def test_a_large_group_of_looser_copies(spark):
    """Copies with up to a dozen changed words each: many share keys with all others and are near to few or none."""
    rng, words = random.Random(9), [f"g{i}" for i in range(150)]
    rows = []
    for i in range(250):
        other = list(words)
        for at in rng.sample(range(150), rng.randint(0, 12)):
            other[at] = f"own{i}x{at}"
        rows.append((i, " ".join(other)))
    want = brute_kept(rows)
    assert 20 < len(want) < 240
    assert sorted(r.doc_id for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
