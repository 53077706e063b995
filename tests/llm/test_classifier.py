import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import classifier
from vellum.llm.classifier import classify_documents, fit_evidence, keep_classified, path_posteriors

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.where(held).collect()}
    got = {r.doc_id: r.kept for r in classify_documents(docs, labels.where(~held)).collect()}
    assert len(got) == docs.count()
    good, bad = [d for d in truth if truth[d]], [d for d in truth if not truth[d]]
    assert np.mean([got[d] for d in good]) > 0.95 and np.mean([not got[d] for d in bad]) > 0.75


def test_posteriors_match_the_formulas(spark):
    rng, rows = random.Random(3), []
    for host, rate, n in (("good", 0.95, 300), ("bad", 0.2, 300), ("tiny", 0.0, 1)):
        rows += [(host, f"p{i % 3}", 4.0 if rng.random() < rate else -4.0) for i in range(n)]
    got = {(r.host, r.path): r.good for r in path_posteriors(spark.createDataFrame(rows, "host string, path string, logit double"), "host", "path", "logit", 0.5).collect()}
    p = lambda x: 1 / (1 + math.exp(-x))
    totals = {}
    for host, path, x in rows:
        for key in (host, (host, path), None):
            n, s = totals.get(key, (0, 0.0))
            totals[key] = n + 1, s + p(x)
    mean = (totals[None][1] + 0.5) / (totals[None][0] + 1)

    def strength(cells):
        n = sum(c[0] for c in cells)
        noise = [c[2] * (1 - c[2]) for c in cells]
        between = (sum(c[0] * (c[1] / c[0] - c[2]) ** 2 for c in cells) - sum(noise)) / n
        return min(1e6, max(1.0, sum(noise) / len(cells) / between - 1)) if between > 0 else 1e6

    hosts = ("good", "bad", "tiny")
    k = strength([(*totals[h], mean) for h in hosts])
    host_good = {h: (totals[h][1] + k * mean) / (totals[h][0] + k) for h in hosts}
    k = strength([(*totals[key], host_good[key[0]]) for key in got])
    assert got == pytest.approx({key: (totals[key][1] + k * host_good[key[0]]) / (totals[key][0] + k) for key in got})
    assert got["good", "p0"] > 0.85 and got["bad", "p0"] < 0.35 and 0.1 < got["tiny", "p0"] < 0.75  # a sparse host stays near the rest


def test_odd_rows_and_no_labels(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1), (7, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = classify_documents(odd, some).collect()
        assert len(rows) == odd.count() and all(0 <= r.posterior <= 1 for r in rows)
    assert all(r.kept and r.posterior == 0.5 for r in rows)
    kept = keep_classified(odd, labels)
    assert kept.columns == odd.columns and keep_classified(odd, labels.limit(0)).count() == odd.count()
    assert classify_documents(odd.limit(0), labels).count() == 0
    monkeypatch.setattr(classifier, "BROADCAST_PATHS", 0)
    assert keep_classified(odd, labels).count() == kept.count()


def test_labels_are_bounded_and_evidence_is_the_same_on_every_run(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    a, b = (fit_evidence(docs, labels, most=200) for _ in range(2))
    assert a.words == b.words and a.weights == pytest.approx(b.weights)
