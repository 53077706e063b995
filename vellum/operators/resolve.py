"""Which file of a version is the main one, and which files it pulls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.tex import include_order
from vellum.functions.text import file_contains_line, includes
from vellum.sources.files import bib_files


def main_tier(text: Column) -> Column:
    """1 with \\documentclass, 2 with \\begin{document}, 3 with harvmac, else 4 (of which the largest file counts)."""
    return F.when(file_contains_line(text, "\\documentclass"), 1).when(file_contains_line(text, "\\begin{document}"), 2).when(file_contains_line(text, "harvmac"), 3).otherwise(4)


def main_files(files: DataFrame, keys: list[str], name: str, text: Column, size: Column) -> DataFrame:
    """(keys, name) of the main file; ties by name."""
    ranked = files.select(*keys, name, main_tier(text).alias("tier"), size.alias("size"))
    best = Window.partitionBy(*keys).orderBy("tier", F.when(F.col("tier") == 4, -F.col("size")), name)
    return ranked.withColumn("n", F.row_number().over(best)).where("n = 1").select(*keys, F.col(name).alias("main_tex"), "tier")


def resolve_versions(sources: DataFrame) -> DataFrame:
    """(pub_id, version, status, main_tex, used_tex_files, bib_files); NO_TEX_FILES if no .tex lies at the top.

    Texts are read where they lie; only the names that they include meet, in one row per version.
    """
    top = sources.where(F.col("file_name").rlike(r"^[^./][^/]*\.tex$"))
    main = main_files(top, ["pub_id", "version"], "file_name", F.col("text"), F.col("size"))
    tex = sources.where(F.col("file_name").endswith(".tex")).select("pub_id", "version", "file_name", includes(F.coalesce("text", F.lit(""))).alias("includes")).join(main, ["pub_id", "version"])
    files = tex.groupBy("pub_id", "version", "main_tex").agg(F.collect_list(F.struct(F.col("file_name").alias("name"), "includes")).alias("files"))
    found = files.select("pub_id", "version", F.lit("RESOLVED").alias("status"), "main_tex", include_order(F.col("files"), F.col("main_tex")).alias("used_tex_files"))
    versions = sources.select("pub_id", "version").distinct().join(found, ["pub_id", "version"], "left").join(bib_files(sources), ["pub_id", "version"], "left")
    none = F.array().cast("array<string>")
    return versions.select("pub_id", "version", F.coalesce("status", F.lit("NO_TEX_FILES")).alias("status"), "main_tex", F.coalesce("used_tex_files", none).alias("used_tex_files"), F.coalesce("bib_files", none).alias("bib_files"))
