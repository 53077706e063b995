"""Bibliography entries against known papers of the same publication: candidates, scores, best matches, labelled pairs.

`bibs` has pub_id, key, normalized_title, normalized_authors, author_tokens, normalized_year, first_author_last, ref_id and
ref_ord; `papers` pub_id, arxiv_id, cand_ord and the same normalised columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import similarity as S
from vellum.operators.features import FEATURES
from vellum.operators.ordering import draw, least
from vellum.operators.pairing import pairs_with
from vellum.session import cut

SHARED = ("normalized_title", "normalized_authors", "author_tokens", "normalized_year", "first_author_last")
#: Selection of papers to label by hand, of papers to label by score, and the share that is sampled.
MANUAL = {"least_pool": 20, "least_matches": 20, "threshold": 0.7, "first_rank": 2, "last_rank": 6}
AUTO_THRESHOLD, AUTO_SHARE, SEED = 0.8, 0.10, 42


def named_papers(papers: DataFrame) -> DataFrame:
    """Papers with their columns named as in pairs."""
    return papers.select("pub_id", "arxiv_id", "cand_ord", *(F.col(c).alias(f"c_{c}") for c in SHARED))


def candidates(bibs: DataFrame, papers: DataFrame, blocked: bool = False) -> DataFrame:
    """Every entry with every known paper of its own publication: an equi-join. Blocked: first authors within 3 edits."""
    found = {}
    if blocked:
        a, b = F.col("first_author_last"), F.col("c_first_author_last")
        found["_near"] = (["first_author_last"], ["c_first_author_last"], S.empty(a) | S.empty(b) | (F.levenshtein(a, b, 3) >= 0))
    pairs = _paired(bibs, papers, found)
    return pairs.where("_near").drop("_near") if blocked else pairs


def _paired(bibs: DataFrame, papers: DataFrame, found: dict[str, tuple[list[str], list[str], Column]], more: tuple[str, ...] = ()) -> DataFrame:
    left, right = bibs.select("pub_id", "key", "ref_ord", "ref_id", *SHARED, *more), named_papers(papers)
    return pairs_with(left, right, ["pub_id"], ["key"], found, [*left.columns, *(c for c in right.columns if c != "pub_id")])


def score_parts(weights: dict[str, float] | None = None, fuzzy: bool = True) -> tuple[dict[str, tuple[list[str], list[str], Column]], Column]:
    """The parts of the score by the columns that they depend on, as in `pairs_with`, and the score of the parts."""
    c = F.col
    title, author, year = S.match_parts(c("normalized_title"), c("c_normalized_title"), c("normalized_authors"), c("c_normalized_authors"), c("normalized_year"), c("c_normalized_year"), fuzzy)
    one = lambda column, said: ([column], [f"c_{column}"], said)
    found = {"_title": one("normalized_title", title), "_author": one("normalized_authors", author), "_year": one("normalized_year", year)}
    return found, S.match_total(c("_title"), c("_author"), c("_year"), weights)


def scored_candidates(bibs: DataFrame, papers: DataFrame, weights: dict[str, float] | None = None, fuzzy: bool = True, more: dict[str, tuple[list[str], list[str], Column]] | None = None) -> DataFrame:
    """`with_score` of `candidates`, and the columns of `more` (as in `pairs_with`): worked out by distinct values if these are few."""
    found, score = score_parts(weights, fuzzy)
    pairs = _paired(bibs, papers, found | (more or {}))
    return pairs.withColumn("score", score).drop(*found)


def _of_entry(pairs: DataFrame) -> list[str]:
    """What tells entries apart; with the block that holds an entry's pairs, windows need no exchange."""
    return ["pub_id", *(c for c in pairs.columns if c == "_block"), "key"]


def with_score(pairs: DataFrame, weights: dict[str, float] | None = None, fuzzy: bool = True) -> DataFrame:
    c = F.col
    score = S.match_score(c("normalized_title"), c("c_normalized_title"), c("normalized_authors"), c("c_normalized_authors"), c("normalized_year"), c("c_normalized_year"), weights, fuzzy)
    return pairs.withColumn("score", score)


def best_matches(scored: DataFrame, threshold: float = 0.6, keys: tuple[str, ...] = ("pub_id", "key")) -> DataFrame:
    """(keys, arxiv_id, score, title, author, year) of each entry's best paper; the first of equals; above 0 and the threshold."""
    c = F.col
    parts = F.struct(S.edit_similarity(c("normalized_title"), c("c_normalized_title")).alias("title"), S.author_overlap(c("normalized_authors"), c("c_normalized_authors")).alias("author"), S.year_score(c("normalized_year"), c("c_normalized_year")).alias("year"))
    best = scored.where((c("score") > 0) & (c("score") >= threshold)).groupBy(*keys).agg(F.max_by(F.struct("arxiv_id", "score", *SHARED, *(f"c_{s}" for s in SHARED)), F.struct("score", (-c("cand_ord")).alias("o"))).alias("b"))
    return best.select(*keys, "b.*").select(*keys, F.nullif("arxiv_id", F.lit("")).alias("arxiv_id"), "score", parts.alias("p")).select(*keys, "arxiv_id", "score", "p.*")


def manual_papers(bibs: DataFrame, papers: DataFrame, scored: DataFrame, **settings: float) -> DataFrame:
    """Publications with large pools and many good matches: those of ranks 2 to 6 by the number of matches."""
    s = MANUAL | settings
    pools = bibs.groupBy("pub_id").agg(F.count("*").alias("bibs")).join(papers.groupBy("pub_id").agg(F.count("*").alias("papers")), "pub_id").where((F.col("bibs") >= s["least_pool"]) & (F.col("papers") >= s["least_pool"]))
    matches = scored.where(F.col("score") >= s["threshold"]).groupBy("pub_id").agg(F.count_distinct("key").alias("matches")).where(F.col("matches") >= s["least_matches"])
    top = pools.join(matches, "pub_id").orderBy(F.desc("matches"), "pub_id").limit(s["last_rank"])
    few = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("matches")).alias("less"), "pub_id", "bibs", "papers", "matches"))).alias("all"))
    ranked = few.select(F.posexplode("all").alias("at", "p")).select("p.pub_id", "p.bibs", "p.papers", "p.matches", (F.col("at") + 1).alias("rank"))
    return ranked.where(F.col("rank") >= s["first_rank"])


def label_tasks(scored: DataFrame) -> DataFrame:
    """All pairs for people to label, an entry's best first."""
    order = Window.partitionBy(*_of_entry(scored)).orderBy(F.desc(F.round("score", 4)), "cand_ord")
    names = lambda c: F.array_join(c, ", ")
    return scored.select(
        "pub_id", F.lit("").alias("label"), F.round("score", 4).alias("score"), F.col("key").alias("bib_key"), F.col("normalized_title").alias("bib_title"), names("normalized_authors").alias("bib_author"), F.col("normalized_year").alias("bib_year"),
        "arxiv_id", F.col("c_normalized_title").alias("arxiv_title"), names("c_normalized_authors").alias("arxiv_author"), F.col("c_normalized_year").alias("arxiv_year"), F.row_number().over(order).alias("rank"),
    )


def labelled(pairs: DataFrame, label: Column, source: str, positive: str, negative: str) -> DataFrame:
    return pairs.select(
        "pub_id", F.col("key").alias("bib_key"), F.col("ref_id").alias("bib_ref_id"), F.col("normalized_title").alias("bib_title_clean"), F.col("normalized_authors").alias("bib_authors_clean"), F.col("author_tokens").alias("bib_author_tokens"),
        F.col("normalized_year").alias("bib_year"), F.col("arxiv_id").alias("candidate_arxiv_id"), F.col("c_normalized_title").alias("candidate_title_clean"), F.col("c_normalized_authors").alias("candidate_authors_clean"),
        F.col("c_author_tokens").alias("candidate_author_tokens"), F.col("c_normalized_year").alias("candidate_year"), F.lit(source).alias("source"), F.when(label, positive).otherwise(negative).alias("pair_type"), label.cast("int").alias("label"), "cand_ord", *(f for f in FEATURES if f in pairs.columns),
    )


def manual_pairs(labels: DataFrame, pairs: DataFrame, bibs: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    """Pairs of the entries that people found a paper for: the last label 1 of an entry counts, all other papers are negatives.

    `labels` has pub_id, bib_key, arxiv_id, label and ord. Labels whose entry or paper isn't there are left out. Where `pairs`
    are all pairs of `bibs` and `papers`, giving these lets the entries be joined with their labels before they make pairs.
    """
    said = labels.where("label = 1")
    if bibs is None or papers is None:
        said = said.join(pairs.select("pub_id", F.col("key").alias("bib_key"), "arxiv_id").distinct(), ["pub_id", "bib_key", "arxiv_id"], "left_semi")
        true = said.groupBy("pub_id", F.col("bib_key").alias("key")).agg(F.max_by("arxiv_id", "ord").alias("true_id"))
        return labelled(pairs.join(true, ["pub_id", "key"]), F.col("arxiv_id") == F.col("true_id"), "manual", "manual_verified", "manual_negative")
    there = papers.select("pub_id", "arxiv_id").distinct()
    true = said.join(there, ["pub_id", "arxiv_id"], "left_semi").groupBy("pub_id", F.col("bib_key").alias("key")).agg(F.max_by("arxiv_id", "ord").alias("true_id"))
    known = bibs.join(true, ["pub_id", "key"])
    return labelled(_paired(known, papers, {}, ("true_id",)), F.col("arxiv_id") == F.col("true_id"), "manual", "manual_verified", "manual_negative")


def auto_publications(scored: DataFrame, manual: DataFrame, threshold: float = AUTO_THRESHOLD) -> DataFrame:
    """Publications that nobody labelled and that have a match of at least the threshold."""
    return scored.where(F.col("score") >= threshold).select("pub_id").distinct().join(manual.select("pub_id"), "pub_id", "left_anti")


def sampled(publications: DataFrame, population: int, share: float = AUTO_SHARE, seed: int = SEED) -> DataFrame:
    """ceil(share * population) publications, those of the least draws: the same ones on every run. Ids are distinct."""
    return least(cut(publications), -int(-share * population // 1), draw(F.col("pub_id"), seed), F.col("pub_id"))


def auto_pairs(scored: DataFrame) -> DataFrame:
    """All pairs; each entry's best paper, the first of equals and even at score 0, is its positive one."""
    best = F.row_number().over(Window.partitionBy(*_of_entry(scored)).orderBy(F.desc("score"), "cand_ord")) == 1
    return labelled(scored.withColumn("best", best), F.col("best"), "automatic", "positive_auto", "negative_auto")


def label_union(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """Manual pairs, then automatic ones, with `ord` for that order."""
    return manual.withColumn("ord", F.lit(0)).unionByName(auto.withColumn("ord", F.lit(1)))
