import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vellum.llm import quality_rules
from vellum.llm.queries import oracle_sql
from vellum.llm.quality_rules import keep_good_documents, rate_documents


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def normal(line):
    return " ".join(re.findall("[^\x20\x09-\x0d]+", line.lower()))


def test_base_rules_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    hard = ["", " \n", "a b c d e a b c d e", "a b c d e f " * 3, "x " * 40, "a\tb\x0bc\x0cd\re\nf g h i j k", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6", "é ü  x # <b> || \n \n same\nsame\nsame ", None]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(10_000 + i, t, "s") for i, t in enumerate(hard)], "doc_id long, text string, source string"))
    texts |= {10_000 + i: t for i, t in enumerate(hard)}
    rows = rate_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_frequent_lines_match_brute_force(spark, monkeypatch):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = []
    for i in range(200):
        host = f"h{i % 2}"
        text = own(i)
        if i % 4 == 0:  # half of host h0
            text += "\nAll  RIGHTS reserved\tby us "
        if i % 40 == 1:  # few of h1
            text += "\nseen too seldom to be removed"
        rows.append((i, text, host))
    rows += [(1000 + i, "all rights reserved by us\nall rights reserved BY US\nfour more words here", "h0") for i in range(3)]
    rows += [(2000 + i, "one text that is copied a very great number of times\nwith a second line", "h0") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (quality_rules.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", most)
        got = {r.doc_id: r for r in rate_documents(frame).collect()}
        lines, documents = defaultdict(set), defaultdict(set)
        for d, text, host in rows:
            for line in map(normal, text.split("\n")):
                lines[host, line].add(text)
            documents[host].add(text)
        gone = {k for k, v in lines.items() if len(v) >= 20 and len(v) >= 0.02 * len(documents[k[0]])}
        assert gone == {("h0", "all rights reserved by us")}
        for d, text, host in rows:
            found = [x for x in map(normal, text.split("\n")) if x]
            left = sum(len(x.split()) for x in found if (host, x) not in gone)
            n = base(text)
            assert (got[d].removed_lines, got[d].left_words) == (sum((host, x) in gone for x in found), left)
            assert got[d].kept == (not n[5] and left >= 10 and left >= 0.2 * n[0])
        assert all(got[2000 + i].kept for i in range(90)) and not any(got[1000 + i].kept for i in range(3))
    kept = {r.doc_id: r.text for r in keep_good_documents(frame).collect()}
    assert kept[0] == own(0) and kept[1] == own(1) + "\nseen too seldom to be removed"


def test_every_shared_line_counts(spark):
    """Whatever the hashes of the lines are, a footer of three lines under one line of its own is found on each host."""
    rows = [(100 * h + i, f"w{h}x{i} " * 15 + "".join(f"\nfooter {h} {k}" for k in range(3)), f"h{h}") for h in range(12) for i in range(25)]
    found = rate_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.removed_lines, r.left_words) for r in found} == {(3, 15)}


def test_sql_gives_the_same(spark, odd):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").union(odd.select("doc_id", F.regexp_replace("text", "\u0000", ""), "source"))
    footers = [(10_000 + i, f"own words of {i} " * (i % 7) + "\nAll  rights\treserved\nby us", "s") for i in range(60)]
    docs = docs.union(spark.createDataFrame(footers, docs.schema))
    near = [(20_000 + i, "\n".join(f"line {k} of near copies with some words" + (f" changed {i}" if k == i % 9 else "") for k in range(9)), "s") for i in range(50)]
    docs = docs.union(spark.createDataFrame(near, docs.schema))
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = con.execute(oracle_sql()["op2_quality_rules"])
    names = [c[0] for c in want.description]
    want, got = map(repr, sorted(want.fetchall(), key=repr)), map(repr, sorted((tuple(r) for r in rate_documents(docs).select(*names).collect()), key=repr))
    assert list(got) == list(want)


def test_odd_rows(spark, odd):
    rows = rate_documents(odd).collect()
    assert len(rows) == odd.count() and {r.n_words for r in rows if r.doc_id in (3, 4)} == {0}
    kept = keep_good_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert rate_documents(odd.limit(0)).count() == 0 and keep_good_documents(odd.limit(0)).count() == 0
    assert keep_good_documents(odd.withColumn("hashes", F.lit(1))).count() == kept.count()
