import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from vellum.llm import syncmers
from vellum.llm.syncmers import BASE, HASH_BYTES, K, S, anchors, compare_with_edits, decoded, document_anchors, encoded, likeness


def mixed(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
    return h ^ h >> 33


def brute_anchors(text):
    def gram(t):
        total = 0
        for c in t:
            total = (total * int(BASE) + ord(c) + 1) % 2**64
        return mixed(total)

    found = []
    for i in range(len(text) - K + 1):
        inner = [gram(text[i + j : i + j + S]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((gram(text[i : i + K]) >> 64 - 8 * HASH_BYTES, i))
    return found


def test_anchors_match_brute_force(monkeypatch):
    rng = random.Random(8)
    for n in (0, 1, K - 1, K, K + 1, 60, 400):
        text = "".join(rng.choice("abcdé\U0001f600 ") for _ in range(n))
        want = brute_anchors(text)
        if not want and text:
            want = [(int.from_bytes(hashlib.sha256(text.encode()).digest()[:HASH_BYTES], "big"), 0)]
        for block in (1 << 18, 50):
            monkeypatch.setattr(syncmers, "BLOCK", block)
            hashes, places = anchors(text)
            assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == want


def test_anchors_are_free_of_context():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    here = {(h, p) for h, p in zip(*(x.tolist() for x in anchors(text)), strict=True)}
    moved = {(h, p - 7) for h, p in zip(*(x.tolist() for x in anchors("1234567" + text[:2000])), strict=True) if p >= 7}
    assert {(h, p) for h, p in here if p + K <= 2000} == moved


def brute_likeness(a, b):
    """By the definition: numbered anchors as pairs, the longest common subsequence by the textbook table."""

    def numbered(text):
        seen, found = {}, []
        for h in anchors(text)[0].tolist():
            found.append((h, seen.setdefault(h, 0)))
            seen[h] += 1
        return found

    x, y = numbered(a), numbered(b)
    if not x or not y:
        return float(len(x) == len(y))
    row = [0] * (len(y) + 1)
    for p in x:
        before, row = row, [0]
        for q, left, up in zip(y, before, before[1:], strict=False):
            row.append(left + 1 if p == q else max(up, row[-1]))
    return row[-1] / (len(x) + len(y) - row[-1])


def test_likeness_matches_brute_force():
    rng = random.Random(10)
    make = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passage, a, b = make(300), make(3000), make(3000)
    turned = a[1500:] + a[:1500]
    pairs = [(a, a), (a, b), (a, a[:2000] + b[:1000]), (a, a[:700] + "x" + a[700:]), (a, turned), (a[:900] + passage + a[900:], passage + b), ("", ""), ("", a), ("short", "short"), ("short", "other"), ("ab" * 900, "ab" * 700), (passage * 5, passage * 3 + b)]
    for x, y in pairs:
        got = likeness(anchors(x)[0], anchors(y)[0])
        assert got == pytest.approx(brute_likeness(x, y))
    assert likeness(anchors(a)[0], anchors(a[:700] + "x" + a[700:])[0]) > 0.95  # a letter put in costs little
    assert likeness(anchors(a)[0], anchors(b)[0]) == 0 and likeness(anchors(a + passage)[0], anchors(b + passage)[0]) > 0.03


def test_fingerprints_hold_all_anchors():
    rng = random.Random(12)
    for text in ("", "x", "".join(rng.choice("abcdefgh ") for _ in range(50_000)), "a" * 5000, "b" * 400 + "".join(rng.choice("xyz") for _ in range(100))):
        hashes, places = anchors(text)
        back = decoded(encoded(hashes, places))
        assert np.array_equal(back[0], hashes) and np.array_equal(back[1], places)
    apart = np.array([5, 7], dtype=np.uint64), np.array([600, 2000])
    assert [x.tolist() for x in decoded(encoded(*apart))] == [[5, 7], [600, 2000]]


def check(rows, docs):
    order = sorted(((r.doc_id, r.text or "") for r in docs), key=lambda r: -r[0])
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(order)
    for (d, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        part = len(text) // 3
        edited = text[: len(text) - part] + following[:part]
        assert (by[d].n_chars, by[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (by[d].fingerprint, by[d].edited_fingerprint) == (encoded(*anchors(text)), encoded(*anchors(edited)))
        assert by[d].near_edited == pytest.approx(brute_likeness(text, edited) if part < 3000 else by[d].near_edited) and by[d].near_next == pytest.approx(brute_likeness(text, following) if part < 3000 else by[d].near_next)


@pytest.mark.parametrize("size", [1 << 30, 20_000])
def test_documents_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", size)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = compare_with_edits(docs).collect()
    check(rows, docs.collect())
    assert np.median([r.near_edited for r in rows]) > 0.35 and np.median([r.near_next for r in rows]) < 0.05


def test_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 20_000)
    rows = compare_with_edits(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id == 3} == {""}
    assert compare_with_edits(odd.limit(0)).count() == 0
    one = compare_with_edits(odd.where("doc_id = 7")).first()
    assert one.near_next == 1
    assert document_anchors(odd).count() == odd.count()
