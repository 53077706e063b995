import hashlib
import itertools
import random
import re

import pytest

from tests.conftest import SMALL
from vellum.llm.pii import KINDS, SpanClassifier, apart, find_personal_data, fit, running
from vellum.llm.queries import op3_weak_supervision

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    spans = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


HARD = [
    None, "", "a@b.c_d@e.f x@y", "a@b.c.d@e.f..g@h.i", "@a.b c@@d.e f@g. h@i.j-", "1.2.3.4.5.6.7.8 256.1.1.1 1..2.3.4.5 0001.0.0.255 1.2.3.2555 00000000000000000000000000000000000000000001.1.1.1",
    "4381893557741609 4381893557741609", "4381893557741609", "4381-8935 5774 1609.", "x4381893557741609x 0000 0000 0000 00", "+1 (663) 555-6869 4465758382889437", "+1 (663) 555-6869, +49 30 123456789. +1-( (2", "++12345678901 +123456789",
    "é\U0001f600a@b.cc \U0001f600 1.2.3.4 ü+4912345678901", "1" * 3000, "a" * 20000 + "@b.c", "1 " * 5000, "+1 " + "2 " * 3000, "a.b@" * 2000,
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(11)
    texts = HARD + ["".join(rng.choice(["1", "23", "4", ".", "@", "a", "b-", " ", "+", "(", ")", "-", "_", "é", "\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base_spans] for r in find_personal_data(frame).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text and text[:200]


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op3_weak_supervision(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_the_method_adds_spans_that_run_together_and_leaves_others(spark):
    rng = random.Random(3)

    def card():
        d = [4] + [rng.randrange(10) for _ in range(14)]
        check = -sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10
        return "".join(map(str, [*d, check]))

    rows = [(i, f"pay by card {card()} or mail x{i}@mail.example.com, call +1 (663) 555-6{i:03d} now") for i in range(200)]
    rows += [(1000 + i, f"order {rng.randrange(10**15, 10**16 - 1) // 7 * 7} build {rng.randrange(10**15)}00") for i in range(60)]
    twice, wrong = f"{card()} {card()}", "the order 9999999999999999999"
    rows += [(5000, f"the +1 (663) 555-6869 {twice} end"), (5001, wrong), (5002, "jane (at) example (dot) com, 663-555-6869")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[5000].base_spans and [(KINDS[s.k], s.s, s.e) for s in got[5000].spans] == [("phone", 4, 21), ("card", 22, 38), ("card", 39, 55)]
    assert not got[5001].spans
    assert all(set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans)) for r in got.values())


def test_odd_rows(spark, odd):
    assert find_personal_data(odd).count() == odd.count()
    assert find_personal_data(odd.limit(0)).count() == 0
    assert fit(odd.limit(0)).weights == pytest.approx((0.0,) * 12)


LONG = 200_000


@pytest.mark.parametrize("unit", ["a(at)b" + ".c" * (LONG // 2), "a@b.co ", "1 ", "1.2.3.4 ", "+1 555 123 4567 ", "call (555) 123-4567 now ", "ab:"])
def test_very_long_texts_end_and_keep_their_places(spark, unit):
    text = unit * (LONG // len(unit))
    model = SpanClassifier((1.0,) * 12)
    (row,) = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), classifier=model).collect()
    assert [tuple(s) for s in row.base_spans] == brute(text)
    ends = [s.e for s in row.spans]
    assert all(a <= b.s for a, b in zip(ends, row.spans[1:], strict=False)) and set(map(tuple, row.base_spans)) <= set(map(tuple, row.spans))


def test_running_sums_and_spans_apart(spark):
    rng = random.Random(5)
    values = [[], [3], list(range(1300)), [rng.randrange(100) for _ in range(513)]]
    frame = spark.createDataFrame([(v,) for v in values], "v array<int>")
    assert sorted(r.v for r in running(frame, ["v"], "{a} + {x}").collect()) == sorted(list(itertools.accumulate(v)) for v in values)
    spans = lambda n, gap: [(s, s + rng.randrange(1, gap)) for s in range(0, n * gap, gap)]
    cases = [(spans(rng.randrange(9), 7), sorted((s := rng.randrange(60), s + rng.randrange(1, 20)) for _ in range(rng.randrange(5)))) for _ in range(100)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i long, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    got = {r.i: [tuple(x) for x in r.a] for r in apart(frame, "a", "b").collect()}
    assert got == {i: [x for x in a if not any(x[0] < e and s < x[1] for s, e in b)] for i, (a, b) in enumerate(cases)}
