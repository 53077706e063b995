"""The three ways through the engine, each a function from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import features, latex_tree, matching, ranking, references, resolve, tree_dedup
from vellum.operators.boosting import Booster
from vellum.session import cut
from vellum.sources import bibtex, files
from vellum.sources.cache import through_cache
from vellum.sources.folders import list_folders, write_files


@dataclass
class Documents:
    scan: DataFrame
    resolved: DataFrame
    nodes: DataFrame
    errors: DataFrame
    kept: DataFrame
    publications: DataFrame


def documents(spark: SparkSession, root: str, level_aware: bool = False, fixed_headings: bool = False, cache: str | None = None) -> Documents:
    """Folders of LaTeX versions to one JSON per publication; what re-appears in later versions is told apart by content.

    With a folder as `cache` only versions whose files have changed since an earlier run are parsed. A root that isn't there
    is a ValueError.
    """
    scanned = cut(files.scan(list_folders(spark, root)))
    found = files.read_files(spark, root)
    ready = files.sources(found).join(scanned.where("status = 'READY'").select("pub_id"), "pub_id", "left_semi")
    resolved = resolve.resolve_versions(ready)
    parse = lambda rows: latex_tree.parse_versions(rows, resolved, level_aware, fixed_headings)
    parsed = cut(parse(ready) if cache is None else through_cache(ready, cache, parse, f"{level_aware} {fixed_headings}"))
    kept = tree_dedup.deduplicate(tree_dedup.subtree_hashes(tree_dedup.normalize_nodes(parsed)))
    return Documents(scanned, resolved, parsed.where("error is null"), parsed.where("error is not null").select("pub_id", "version", "error"), kept, tree_dedup.publication_json(kept))


@dataclass
class Pairs:
    references: DataFrame
    bibtex: DataFrame
    bibs: DataFrame
    papers: DataFrame
    scored: DataFrame
    tasks: DataFrame
    labelled: DataFrame


def labelled_pairs(spark: SparkSession, root: str, labels: DataFrame | None = None) -> Pairs:
    """Bibliographies against known papers: references of the last version, scores of all pairs, labels by hand and by score."""
    found = files.read_files(spark, root)
    kept = references.deduplicate(bibtex.extract_references(files.sources(found))).where("kept")
    kept = references.with_semantic_ids(kept, ["pub_id", "version", "ref_ord"])
    bibs = references.clean_references(references.last_versions(kept))
    papers = references.clean_arxiv(files.arxiv_references(found))
    scored = cut(matching.with_score(matching.candidates(bibs, papers)))
    empty = spark.createDataFrame([], "pub_id string, bib_key string, arxiv_id string, label int, ord long")
    labels = empty if labels is None else labels
    by_hand = labels.select("pub_id").distinct()
    manual = matching.manual_pairs(labels, scored)
    chosen = matching.auto_publications(scored, by_hand)
    population = scored.select("pub_id").distinct().join(by_hand, "pub_id", "left_anti").count()
    auto = matching.auto_pairs(scored.join(matching.sampled(chosen, population), "pub_id", "left_semi"))
    return Pairs(kept, references.export_bibtex(kept), bibs, papers, scored, matching.label_tasks(scored), matching.label_union(manual, auto))


@dataclass
class Ranking:
    features: DataFrame
    parts: DataFrame
    ranker: Booster
    predictions: DataFrame
    truth: DataFrame
    mrr: dict[str, float]
    overfitting: str
    output: DataFrame


def ranked(pairs: DataFrame) -> Ranking:
    """Labelled pairs to features, a ranker, its best five candidates per entry and its reciprocal ranks."""
    rows = cut(features.pair_features(pairs))
    parts = ranking.split(rows)
    by = {p: rows.join(parts.where(F.col("partition") == p).select("pub_id"), "pub_id", "left_semi") for p in ("train", "valid", "test")}
    valid = by["valid"] if by["valid"].limit(1).count() else None
    ranker = ranking.train_ranker(by["train"], valid)
    predictions, truth = ranking.top_candidates(rows, ranker.score()), ranking.ground_truth(rows)
    mrr = {p: ranking.mean_reciprocal_rank(predictions, ranking.ground_truth(part)).first()["mrr"] for p, part in by.items()}
    gap = abs(mrr["train"] - mrr["test"])
    return Ranking(rows, parts, ranker, predictions, truth, mrr, "none" if gap < 0.05 else "slight" if gap < 0.10 else "significant", ranking.prediction_json(predictions, truth, parts))


def export(spark: SparkSession, root: str, out: str, made: Documents | None = None, pairs: Pairs | None = None, ranking: Ranking | None = None) -> None:
    """A folder <out>/<pub>/ with what is given: <pub>.json, metadata.json and references.json as they are, refs.bib, pred.json."""
    if made is not None:
        write_files(made.publications, out, "json")
        side, _ = files.side_files(files.read_files(spark, root))
        write_files(side.select(F.concat_ws("/", "pub_id", "path").alias("place"), "text"), out, "text", "{key}", "place")
    if pairs is not None:
        write_files(pairs.bibtex, out, "bibtex", "{key}/refs.bib")
    if ranking is not None:
        write_files(ranking.output, out, "json", "{key}/pred.json")
