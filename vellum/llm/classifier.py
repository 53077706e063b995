"""Quality classifier: evidence of a document's text, combined with what its host and path are like.

The evidence is a logistic regression on measures of the text and on words that stand in bad documents more often than
chance has it (words of good ones are those of the language, and say little). Hosts and
paths (the section of a host) get posteriors by hierarchical empirical Bayes: a path's share of good documents is shrunk
toward its host's, a host's toward the global one, the more so the fewer documents there are. A document is kept if the
odds of its evidence, moved from the global prior to its path's posterior, are in favour of good.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, checkpoint, fresh, stored, strings

#: Labelled rows that are learnt from at most (those with the least hash of their id), and words that are evidence.
LABELLED_ROWS, EVIDENCE_WORDS = 16_000, 256
#: Labelled documents that a word of evidence is in, and ridge of the regression.
LEAST_DOCUMENTS, RIDGE = 8, 1.0
#: Path posteriors (about 60 bytes each) up to which they are broadcast; more are joined by host and path.
BROADCAST_PATHS = 100_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`"
MEASURES = 11


def words_of(text: str) -> list[str]:
    return [w.strip(PUNCTUATION) for w in text.lower().split()]


def units_of(words: list[str]) -> set[str]:
    """What may be evidence: the distinct words, and the stems of 5 and 7 letters of longer ones, marked by a tilde."""
    distinct = set(words) - {""}
    return distinct | {w[:5] + "~" for w in distinct if len(w) > 5} | {w[:7] + "~" for w in distinct if len(w) > 7}


def upper_case(text: str) -> int:
    """The upper-case letters of the whole text; those of ASCII are counted as bytes, as that costs less."""
    ascii_only, rest = (text, "") if text.isascii() else (text.encode("ascii", "ignore").decode(), _ASCII.sub("", text))
    return len(ascii_only) - len(ascii_only.encode().translate(None, _UPPER)) + sum(map(str.isupper, rest))


def measures(text: str, words: list[str]) -> list[float]:
    """Numbers between about -3 and 3 that tell prose from junk."""
    n, chars = len(words), max(1, len(text))
    bare = text.translate(_NO_SYMBOLS)
    lines = text.split("\n")
    counted = Counter(words)
    n1 = max(1, n)
    return [
        math.log1p(n) / 3, math.log1p(chars / n1) - 2, 20 * (chars - len(bare)) / chars, 5 * upper_case(text) / chars,
        10 * text.count("!") / n1, 3 * (1 - len(set(lines)) / len(lines)), 2 * len(counted) / n1, 5 * (max(counted.values()) if counted else 0) / n1,
        10 * sum(map(text.count, "0123456789")) / chars, 5 * counted.get("", 0) / n1, 1.0,
    ]


_ASCII, _UPPER = re.compile(r"[\x00-\x7f]+"), string.ascii_uppercase.encode()
_NO_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


@dataclass(frozen=True)
class Evidence:
    """A fitted classifier of texts: small, and the same on every executor."""

    words: dict[str, int]
    weights: tuple[float, ...]
    prior: float

    def features(self, text: str) -> tuple[list[float], list[int]]:
        words = words_of(text)
        return measures(text, words), sorted({self.words[w] for w in units_of(words) & self.words.keys()})

    def logit(self, text: str) -> float:
        dense, hits = self.features(text)
        return sum(a * b for a, b in zip(dense, self.weights, strict=False)) + sum(self.weights[MEASURES + h] for h in hits)


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, most: int) -> DataFrame:
    """(text, good) of at most `most` labelled documents. A document with several labels is good if all of them say so."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    said = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return narrow.join(F.broadcast(chosen), "doc_id").select("text", "good")  # `most` rows of 12 bytes


def fit_evidence(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = LABELLED_ROWS, n_words: int = EVIDENCE_WORDS) -> Evidence:
    """Words are counted over the labelled documents in a grouped aggregation; the regression is solved on the driver.

    The driver gets `n_words` words and, for each of at most `most` rows, its measures and the numbers of its words.
    Without labels of both kinds the evidence is nothing and every document is as good as the prior, one half.
    """
    sample = checkpoint(labelled(docs, labels, id_column, text_column, most))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, bad = Counter(), Counter()
        for text, y in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            (good if y else bad).update(units_of(words_of(text)))
        found = sorted(good.keys() | bad.keys())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([good[w] for w in found], pa.int64()), pa.array([bad[w] for w in found], pa.int64())], names=["word", "good", "bad"])

    sizes = {r["good"]: r["count"] for r in sample.groupBy("good").count().collect()}
    n_good, n_bad = sizes.get(1, 0), sizes.get(0, 0)
    if not n_good or not n_bad:
        return Evidence({}, (0.0,) * MEASURES, 0.5)
    counts = arrow_map(sample, count, "word string, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    both = F.col("good") + F.col("bad")
    expected = both * (n_bad / (n_good + n_bad))
    signal = (F.col("bad") - expected) / F.sqrt(expected * (n_good / (n_good + n_bad)) + 1)
    top = counts.where(both >= LEAST_DOCUMENTS).select("word", signal.alias("signal")).where("signal >= 4").orderBy(F.desc("signal"), "word").limit(n_words)
    words = {r["word"]: i for i, r in enumerate(top.collect())}
    empty = Evidence(words, (), 0.5)

    def vector(batch: pa.RecordBatch) -> pa.RecordBatch:
        dense, hits = zip(*map(empty.features, strings(batch.column(0))), strict=True) if batch.num_rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(dense, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["dense", "hits", "good"])

    rows = arrow_map(sample, vector, "dense array<double>, hits array<int>, good int").collect()
    x, y = np.zeros((len(rows), MEASURES + len(words))), np.array([r["good"] for r in rows], dtype=float)
    for i, r in enumerate(rows):
        x[i, :MEASURES] = r["dense"]
        x[i, [MEASURES + h for h in r["hits"]]] = 1
    return Evidence(words, tuple(_logistic(x, y).tolist()), float((y.sum() + 1) / (len(y) + 2)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - RIDGE * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + RIDGE * np.eye(len(w)), gradient)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit_column(evidence: Evidence, text: Column) -> Column:
    """The logit of a text. It is never null, but Spark would infer a null check below the join and score each text once
    more for it; columns that count as not deterministic are not moved."""

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series([evidence.logit(t) for t in texts], dtype="float64")

    return logit.asNondeterministic()(F.coalesce(text, F.lit("")))


def path_posteriors(scored: DataFrame, host: str, path: str, logit: str, prior: float) -> DataFrame:
    """(host, path, good): the posterior share of good documents in each path of each host.

    Shares are sums of the documents' probabilities. How strongly a level is shrunk follows from the spread of shares about
    the level above, by the method of moments: less spread than chance alone would give, and all are pulled together.
    """
    good = 1 / (1 + F.exp(-F.col(logit)))
    paths = checkpoint(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(good).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = (total[1] + prior) / (total[0] + 1) if total[0] else prior
    strength = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(mean).alias("m")))
    hosts = hosts.select("host", ((F.col("host_s") + strength * mean) / (F.col("host_n") + strength)).alias("host_good"))
    joined = checkpoint(paths.join(hosts, "host"))
    strength = _strength(joined.select("n", "s", F.col("host_good").alias("m")))
    return joined.select("host", "path", ((F.col("s") + strength * F.col("host_good")) / (F.col("n") + strength)).alias("good"))


def _strength(shares: DataFrame) -> float:
    """The documents that the level above counts for: from rows (n, s, m) of counts, sums and the share one level up."""
    noise = F.col("m") * (1 - F.col("m"))
    spread = F.pow(F.col("s") / F.col("n") - F.col("m"), 2)
    k, n, observed, noises = shares.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * spread), F.sum(noise)).first()
    if not k or not noises:
        return 1e6
    between = (observed - noises) / n
    return float(min(1e6, max(1.0, noises / k / between - 1))) if between > 0 else 1e6


def _judged(docs: DataFrame, evidence: Evidence, text_column: str, host_column: str, path_column: str, id_column: str | None) -> tuple[DataFrame, dict[str, str]]:
    names = ["logit", "host", "path", "good", "posterior"]
    n = dict(zip(names, fresh(docs, *names), strict=True))
    rows = docs.withColumns({n["logit"]: logit_column(evidence, F.col(text_column)), n["host"]: F.coalesce(F.col(host_column).cast("string"), F.lit("")), n["path"]: F.coalesce(F.col(path_column).cast("string"), F.lit(""))})
    narrow = [n["logit"], n["host"], n["path"]]
    if id_column is not None:
        rows = rows.select(F.col(id_column).alias("doc_id"), *narrow)
    rows = stored(rows)  # each text is scored once: the posteriors are made of the logits written here
    posteriors = checkpoint(path_posteriors(rows.select(*narrow), n["host"], n["path"], n["logit"], evidence.prior))
    few = posteriors.count() <= BROADCAST_PATHS
    posteriors = posteriors.select(F.col("host").alias(n["host"]), F.col("path").alias(n["path"]), F.col("good").alias(n["good"]))
    joined = rows.join(F.broadcast(posteriors) if few else posteriors, [n["host"], n["path"]])
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(n["good"])))
    odds = F.col(n["logit"]) + F.log(share / (1 - share)) - math.log(evidence.prior / (1 - evidence.prior))
    return joined.withColumn(n["posterior"], 1 / (1 + F.exp(-odds))), n


def classify_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", path_column: str = "lang") -> DataFrame:
    """doc_id, evidence (logit), path_good (posterior of its path), posterior, kept: one row per row of `docs`.

    The tables have no addresses: the source stands for the host, the language for the path. Good means of quality and not
    toxic. Null texts are empty, null hosts and paths are one host and path, null ids are kept, repeated rows count as often
    as they come; other columns are ignored; without labels everything has a posterior of one half and is kept.
    """
    rows, n = _judged(docs, fit_evidence(docs, labels, id_column, text_column), text_column, host_column, path_column, id_column)
    return rows.select("doc_id", F.col(n["logit"]).alias("evidence"), F.col(n["good"]).alias("path_good"), F.col(n["posterior"]).alias("posterior"), (F.col(n["posterior"]) >= 0.5 - 1e-9).alias("kept"))


def keep_classified(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", path_column: str = "lang") -> DataFrame:
    """The rows of `docs` that classify_documents keeps, with its columns.

    Rows are written once to the shared folder with their logits. Nulls, ties, repeated rows and missing labels are treated as
    classify_documents does; columns of any name are kept; an empty table gives an empty one.
    """
    rows, n = _judged(docs, fit_evidence(docs, labels, id_column, text_column), text_column, host_column, path_column, None)
    return rows.where(F.col(n["posterior"]) >= 0.5 - 1e-9).select(*docs.columns)
