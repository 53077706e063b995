"""References: one of each per version, semantic ids, cleaned fields, BibTeX out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.operators.ordering import numbered


def field(name: str, fields: str = "fields") -> Column:
    """The value of a field in an array of (name, value); null if there is none."""
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def keyed(refs: DataFrame) -> DataFrame:
    return refs.withColumns({"dedup_key": T.dedup_key(field("title"), field("author"), field("year")), "quality": T.reference_quality(field("doi"), field("year"), field("author"), field("title"))})


def deduplicate(refs: DataFrame, keys: tuple[str, ...] = ("pub_id", "version"), order: str = "ref_ord") -> DataFrame:
    """The best reference of each key (most fields that matter, then the first), with kept_key: the key it goes by.

    Keys of fewer than five letters are dropped; those of five are all kept, as they say next to nothing.
    """
    group = Window.partitionBy(*keys, "dedup_key").orderBy(F.desc("quality"), order)
    rows = keyed(refs).where(F.length("dedup_key") >= 5).withColumn("n", F.row_number().over(group)).withColumn("kept_key", F.when(F.length("dedup_key") == 5, F.col("key")).otherwise(F.first("key").over(group)))
    return rows.withColumn("kept", (F.col("n") == 1) | (F.length("dedup_key") == 5)).drop("n")


def key_mapping(deduplicated: DataFrame, keys: tuple[str, ...] = ("pub_id", "version")) -> DataFrame:
    """original key to kept key; of a key that occurs again the last one counts."""
    return deduplicated.groupBy(*keys, "key").agg(F.max_by("kept_key", F.struct(-F.col("quality"), "ref_ord")).alias("kept_key"))


def with_semantic_ids(refs: DataFrame, order: list[str], base: Column | None = None) -> DataFrame:
    """ref_id: Lastname_year_Words, the second and later of a base with a suffix, numbered over all publications in `order`.

    The base of references that say nothing can be a large part of all; its rows are numbered in many tasks.
    """
    rows = refs.withColumn("base_id", base if base is not None else T.semantic_base(field("author"), field("year"), field("title")))
    return numbered(rows, ["base_id"], order, "_number").withColumn("ref_id", F.concat("base_id", T.semantic_suffix(F.col("_number")))).drop("_number")


def last_versions(refs: DataFrame, pub: str = "pub_id", version: str = "version") -> DataFrame:
    """The references of each publication's last version, in lexicographic order."""
    return refs.withColumn("n", F.dense_rank().over(Window.partitionBy(pub).orderBy(F.desc(version)))).where("n = 1").drop("n")


def export_bibtex(refs: DataFrame) -> DataFrame:
    """(pub_id, bibtex): refs.bib of each publication, its last version's entries by quality and order."""
    entries = last_versions(refs).withColumn("entry", T.bibtex(F.col("type"), F.col("key"), F.col("fields")))
    return entries.groupBy("pub_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("quality")).alias("q"), "ref_ord", "entry"))), lambda x: x["entry"]), "").alias("bibtex"))


def clean_references(refs: DataFrame) -> DataFrame:
    """Normalised title, authors and year of bibliography entries."""
    return cleaned(refs.withColumns({"raw_author": field("author"), "raw_title": field("title"), "raw_year": field("year"), "raw_journal": field("journal"), "raw_booktitle": field("booktitle")}), T.year_of(F.col("raw_year")))


def clean_arxiv(refs: DataFrame) -> DataFrame:
    """The same of known papers, whose authors are an array and whose year is that of submission."""
    rows = refs.withColumn("raw_author", F.array_join("authors", " and ")).withColumnRenamed("paper_title", "raw_title")
    return cleaned(rows, F.when(F.length("submission_date") >= 4, F.left("submission_date", F.lit(4))))


def cleaned(rows: DataFrame, year: Column) -> DataFrame:
    parts = T.author_parts(F.coalesce(F.col("raw_author"), F.lit("")))
    rows = rows.withColumn("author_parts", parts).withColumns({
        "normalized_title": T.normalized(F.coalesce(F.col("raw_title"), F.lit(""))), "normalized_year": year,
        "normalized_authors": F.filter(F.transform("author_parts", lambda a: a["short"]), lambda s: s != ""), "author_tokens": F.transform("author_parts", lambda a: a["tokens"]),
    })
    return rows.withColumn("first_author_last", T.first_author_last(F.col("normalized_authors"))).drop("author_parts")


def extraction_rate(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(raw, kept, rate); the rate of nothing is null."""
    both = raw.select(F.lit(1).alias("raw"), F.lit(0).alias("kept")).union(kept.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept")).withColumn("rate", F.try_divide("kept", "raw"))
