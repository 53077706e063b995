import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from vellum.llm import passages
from vellum.llm.passages import drop_repeats
from vellum.llm.queries import op11_level_doubling


def brute(rows, window):
    """(words, words removed, words kept) of each (id, text), by dictionaries of windows."""
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, float] = {}
    for i, w in split:
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            least[key] = min(least.get(key, float("inf")), i)
    out = []
    for i, w in split:
        gone = {at + k for at in range(len(w) - window + 1) if least[tuple(w[at : at + window])] < i for k in range(window)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


def expected(rows, window):
    return sorted(((i, *b) for (i, _), b in zip(rows, brute(rows, window), strict=True)), key=str)


@pytest.mark.parametrize(("window", "first"), [(8, 4), (8, 2), (8, 1), (12, 3), (6, 3)])
def test_all_levels_agree_with_brute_force(spark, window, first):
    draw = random.Random(window * 31 + first)
    passage = [draw.choice("abcdefgh") for _ in range(40)]
    rows = []
    for i in range(60):
        words = [draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            a = draw.randrange(30)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + draw.randrange(30)]
        rows.append((draw.randrange(50), " ".join(words)))
    rows += [(70, "r " * 30), (71, "r " * 25), (72, "r\n" * 7)]
    assert found(drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, first=first)) == expected(rows, window)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    wide = odd.withColumnRenamed("fp", "rank").withColumnRenamed("size", "n_words").withColumnRenamed("score", "ROW")
    done = drop_repeats(wide)
    assert done.columns[: len(wide.columns)] == wide.columns
    assert {r["n_words"] for r in done.select("n_words").collect()} == {"z"}
    got = sorted(((r["doc_id"], r["n_words_"], r["n_removed"], r["kept_text"]) for r in done.collect()), key=str)
    assert got == expected(rows, 50)


def test_copies_ties_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (5, text), (5, text + " more"), (None, text), (9, " ".join(text.split()[:49])), (1, ""), (2, None)]
    got = found(drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected(rows, 50)
    assert [(r[0], r[2]) for r in got if r[1] == 60] == [(3, 0), (3, 0), (5, 60), (None, 60)]
    empty = drop_repeats(spark.createDataFrame([], "doc_id long, text string, row string"))
    assert empty.columns == ["doc_id", "text", "row", "n_words", "n_removed", "removed", "kept_text"]
    assert empty.count() == 0


def test_spans_are_those_of_the_words_that_go(spark):
    shared = [f"s{i}" for i in range(50)]
    rows = [(1, " ".join(shared)), (2, " ".join(["a", *shared, "b", *shared, "c"]))]
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 51), (52, 102)]}


def test_anchors_stand_for_every_window_once(monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 64)
    draw = np.random.default_rng(3)
    hashes = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
    hashes[200:400] = 7
    valid = np.setdiff1d(np.arange(1000 - 25), np.arange(500, 530))
    place, first, last = passages.anchors(hashes, 26, valid)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert set(valid) <= set(starts.tolist())
    for p, a, b in zip(place, first, last, strict=True):
        assert b <= p <= a + 25


def test_lengths_that_doubling_does_not_reach(spark):
    with pytest.raises(ValueError, match="doubled"):
        drop_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=50, first=20)


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in expected(rows, 50))
    assert sorted(tuple(r) for r in op11_level_doubling(spark, SMALL).collect()) == want
    assert any(r[2] for r in want)
