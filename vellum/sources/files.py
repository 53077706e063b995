"""Publication folders, JSON side files, labels and CSV as DataFrames, all through Spark's readers.

<root>/<pub_id>/{metadata.json, references.json, tex/<pub_id>v<N>/**}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARXIV = "map<string, struct<paper_title: string, authors: array<string>, submission_date: string>>"
TASKS = "label string, score double, bib_key string, bib_title string, bib_author string, bib_year string, arxiv_id string, arxiv_title string, arxiv_author string, arxiv_year string"
LABELLED = (
    "pub_id string, bib_key string, bib_ref_id string, bib_title_clean string, bib_authors_clean string, bib_author_tokens string, bib_year string, candidate_arxiv_id string,"
    " candidate_title_clean string, candidate_authors_clean string, candidate_author_tokens string, candidate_year string, source string, pair_type string, label int"
)

#: The two tables that `by_class.csv_sides` makes of labelled pairs.
ENTRIES = "pub_id string, bib_key string, bib_ref_id string, bib_title_clean string, bib_authors_clean string, bib_author_tokens string, bib_year string, positive_id string"
PAPERS = "pub_id string, candidate_arxiv_id string, candidate_title_clean string, candidate_authors_clean string, candidate_author_tokens string, candidate_year string"


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(pub_id, path: inside the publication, size, content): every file below the publication folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    inner = F.substring_index(F.col("path"), base, -1)
    return found.select(F.substring_index(inner, "/", 1).alias("pub_id"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"), F.col("length").alias("size"), "content").where("path <> pub_id")


def version_of(path: Column, pub_id: Column) -> Column:
    """The version folder below tex/ that is named <pub_id>v<number>; else null."""
    folder = F.regexp_extract(path, "^tex/([^/]+)/", 1)
    return F.when(F.startswith(folder, pub_id) & F.substr(folder, F.length(pub_id) + 1).rlike(r"^v\d+$"), folder)


def scan(files: DataFrame) -> DataFrame:
    """One record per publication: which side files there are, its versions in lexicographic order, its status.

    Empty folders are no files and so not seen: a publication without any file has no record.
    """
    record = files.groupBy("pub_id").agg(
        F.bool_or(F.col("path") == "metadata.json").alias("has_metadata"), F.bool_or(F.col("path") == "references.json").alias("has_references"), F.bool_or(F.startswith("path", F.lit("tex/"))).alias("has_tex"),
        F.array_sort(F.collect_set(version_of(F.col("path"), F.col("pub_id")))).alias("versions"),
    )
    return record.withColumn("status", scan_status(F.col("has_metadata"), F.col("has_references"), F.col("has_tex"), F.size("versions")))


def scan_status(has_metadata: Column, has_references: Column, has_tex: Column, versions: Column) -> Column:
    return F.when(~has_metadata | ~has_references, "INVALID").when(~has_tex | (versions == 0), "NO_TEX").otherwise("READY")


def sources(files: DataFrame) -> DataFrame:
    """(pub_id, version, file_name: inside the version, size, text) of the version folders' .tex, .bib and .bbl files."""
    found = files.withColumn("version", version_of(F.col("path"), F.col("pub_id"))).where("version is not null").withColumn("file_name", F.regexp_replace("path", "^tex/[^/]+/", ""))
    return found.where(F.col("file_name").rlike(r"\.(tex|bib|bbl)$")).select("pub_id", "version", "file_name", "size", text_of(F.col("content")).alias("text"))


def bib_files(found: DataFrame) -> DataFrame:
    """(pub_id, version, bib_files): those at the top of the version folder that aren't hidden, sorted."""
    top = found.where(F.col("file_name").rlike(r"^[^./][^/]*\.bib$"))
    return top.groupBy("pub_id", "version").agg(F.array_sort(F.collect_list("file_name")).alias("bib_files"))


def arxiv_references(files: DataFrame) -> DataFrame:
    """(pub_id, cand_ord, arxiv_id, paper_title, authors, submission_date): what references.json lists; broken files list nothing."""
    parsed = files.where("path = 'references.json'").select("pub_id", F.from_json(text_of(F.col("content")), ARXIV).alias("found"))
    rows = parsed.select("pub_id", F.posexplode(F.map_entries("found")).alias("cand_ord", "e"))
    return rows.select("pub_id", "cand_ord", F.col("e.key").alias("arxiv_id"), "e.value.paper_title", "e.value.authors", "e.value.submission_date")


def side_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pub_id, path, text) of the JSON files as they are, and (pub_id, path) of those that are missing."""
    have = files.where(F.col("path").isin("metadata.json", "references.json")).select("pub_id", "path", text_of(F.col("content")).alias("text"))
    wanted = files.select("pub_id").distinct().select("pub_id", F.explode(F.array(F.lit("metadata.json"), F.lit("references.json"))).alias("path"))
    return have, wanted.join(have, ["pub_id", "path"], "left_anti")


def manual_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label tasks that people have filled in, one JSON array per publication; the label is null where none was given."""
    read = spark.read.schema(TASKS).option("multiLine", "true").json(f"{folder.rstrip('/')}/*.json")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return read.withColumn("pub_id", stem).withColumn("label", F.col("label").try_cast("int"))


def read_pairs(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """A CSV of labelled pairs. The schema is stated, so an id such as 2301.00010 stays a string."""
    return spark.read.schema(schema).option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)


def listed(text: Column) -> Column:
    """An array that a CSV holds as text: a list in brackets of quoted strings or numbers, or else parts between commas.

    Strings may be in either kind of quotes, so each may hold the other kind, and both kinds after a backslash.
    """
    single, double, number = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"[-+]?[0-9]++(?:[.][0-9]*+)?"
    value = f"(?:{single}|{double}|{number})"
    inner = lambda v: F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(['\"\\])", "$1")
    values = F.transform(F.regexp_extract_all(text, F.lit(value), F.lit(0)), lambda v: F.when(v.rlike("^['\"]"), inner(v)).otherwise(v))
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(text.rlike(rf"(?s)^\s*\[\s*(?:{value}\s*(?:,\s*{value}\s*)*+,?\s*)?\]\s*$"), values).otherwise(parts)
