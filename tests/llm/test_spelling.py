import random
import re
import zlib
from collections import Counter

import pytest

from tests.conftest import SMALL
from vellum.llm.queries import op13_symmetric_delete
from vellum.llm.spelling import count_words, group_variants, spelling_variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=5):
    form, out = {}, []
    by_length: dict[int, list[str]] = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    stats = {}
    for w, n in counts.items():
        close = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, ()) if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        stats[w] = len(close)
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, stats[w], counts.get(form[w])))
    return sorted(out)


def words_of(rows, misspelt=199):
    found: Counter[str] = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            number = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspelt and number % misspelt == 0:
                run = run[: number % len(run)] + run[number % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return found


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants_agree_with_brute_force(spark):
    draw = random.Random(5)
    counts = {}
    for _ in range(400):
        w = "".join(draw.choice("abé") for _ in range(draw.randrange(4, 9)))
        counts[w] = draw.choice((5, 6, 25, 30, 125, 150, 700, 5000))
    got = found(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert any(r[2] not in (r[0], r[1]) for r in got)


def test_long_chains_and_ties(spark):
    counts = {"aaaaaa" + "b" * k: 5**k for k in range(12)} | {"zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25, "zzzzzÿ": 25, "yyyyyy": 5, "yyyyyx": 24}
    got = found(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert next(r[2] for r in got if r[0] == "aaaaaa") == "aaaaaa" + "b" * 11
    assert next(r[1] for r in got if r[0] == "zzzzzz") == "zzzzzx"


def test_words_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(4, "ÀÉÿ×÷abc ABCdéf"), (4, "Xyz" * 50_000)]
    docs = odd.select("doc_id", "text", "kept").union(spark.createDataFrame([(*r, "w") for r in rows[-2:]], "doc_id long, text string, kept string"))
    for misspelt in (0, 1, 3):
        assert dict(count_words(docs.withColumnRenamed("kept", "n"), misspelt=misspelt).collect()) == words_of(rows, misspelt)


def test_empty_table_and_null_words(spark):
    empty = group_variants(spark.createDataFrame([], "doc_id long, text string, word string"))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert empty.count() == 0
    assert found(spelling_variants(spark.createDataFrame([(None, 5), ("", 9), ("a", 1)], "word string, n long"))) == [("", None, "", 9, 1, None), ("a", "", "", 1, 1, 9)]
    with pytest.raises(ValueError, match="ring"):
        spelling_variants(empty.select("word", "n"), times=1)


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute({w: n for w, n in words_of(rows).items() if n >= 5})
    assert found(op13_symmetric_delete(spark, SMALL)) == want
    assert any(r[1] for r in want)
