"""Summaries that come with a result: counted by the pass that makes it, not by a pass of their own."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.operators.features import FEATURES, KEYS
from vellum.operators.pairing import tallied

ROWS = "summary string, name string, value double"


def count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


@dataclass
class Watched:
    """Rows, and what is counted while they are first written or read."""

    rows: DataFrame
    seen: Observation

    def values(self) -> dict[str, float]:
        """Waits for the first action on `rows`."""
        return self.seen.get


def watch(rows: DataFrame, /, **metrics: Column) -> Watched:
    seen = Observation()
    return Watched(rows.observe(seen, *(m.alias(n) for n, m in metrics.items())), seen)


def watch_references(raw: DataFrame) -> Watched:
    """Deduplicated references, of which `kept` tells those that stay."""
    return watch(raw, raw=F.count("*"), kept=count(F.col("kept")))


def watch_bibliographies(bibtex: DataFrame) -> Watched:
    """One row for each publication that has references, and so for each file."""
    return watch(bibtex, publications=F.count("*"))


def watch_features(rows: DataFrame) -> Watched:
    """Samples, missing and infinite values of all feature columns."""
    numbers = [F.col(f).cast("double") for f in FEATURES if f in rows.columns]
    missing = sum((count(x.isNull() | F.isnan(x)) for x in numbers), F.lit(0))
    infinite = sum((count(F.abs(x) == float("inf")) for x in numbers), F.lit(0))
    return watch(rows, samples=F.count("*"), missing=missing, infinite=infinite)


def watch_feature_values(left: DataFrame, right: DataFrame, keys: list[str], found: dict[str, tuple[list[str], list[str], Column]]) -> Watched:
    """The same of all pairs within groups, of which `found` (as in `pairing.pairs_with`) has the features.

    The rows are (feature, value, pairs): a feature is worked out once for the values that it depends on, with the number of
    pairs that have them.
    """
    alike: dict[tuple[tuple[str, ...], tuple[str, ...]], dict[str, Column]] = {}
    for name, (ls, rs, said) in found.items():
        alike.setdefault((tuple(ls), tuple(rs)), {})[name] = said
    one = lambda sides, said: tallied(left, right, keys, *map(list, sides)).select("pairs", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), x.cast("double").alias("value")) for n, x in said.items()))).alias("f")).select("f.*", "pairs")
    rows = reduce(DataFrame.unionByName, (one(*x) for x in alike.items()))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("pairs"))), F.lit(0))
    value = F.col("value")
    return watch(rows, samples=of(F.col("feature") == next(iter(found))), missing=of(value.isNull() | F.isnan(value)), infinite=of(F.abs(value) == float("inf")))


def watch_labels(rows: DataFrame) -> Watched:
    return watch(rows, rows=F.count("*"), positives=count(F.col("label") == 1), negatives=count(F.col("label") == 0))


def table(spark: SparkSession, references: Watched, bibliographies: Watched, features: Watched, labels: dict[str, Watched], names: tuple[str, ...] | None = None) -> DataFrame:
    """(summary, name, value): extraction and its rate, features, and the balance of each part. Rates of nothing are 0.

    The features are `names`, or else the columns of their rows that are no keys.
    """
    refs, feats = references.values(), features.values()
    rows = [("references", "raw", refs["raw"]), ("references", "rate", refs["kept"] / max(1, refs["raw"])), ("references", "publications", bibliographies.values()["publications"])]
    rows += [("features", n, feats[n]) for n in ("samples", "missing", "infinite")]
    rows.append(("features", "features", len([c for c in features.rows.columns if c not in KEYS] if names is None else names)))
    for part, watched in labels.items():
        found = watched.values()
        rows += [(part, n, found[n]) for n in ("rows", "positives", "negatives")] + [(part, "ratio", found["negatives"] / max(1, found["positives"]))]
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], ROWS)
