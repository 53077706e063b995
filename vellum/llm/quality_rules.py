"""Quality rules: measures within a text, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint, fresh, stored

#: White space between words, as a list of letters and as a pattern.
SPACES, SPACE = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a repeated window, fewest words of a text, most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A line is removed if it stands in so many distinct documents of its host, however many documents the host has.
LINE_DOCUMENTS = 20
#: A document is depleted if fewer than LEAST_WORDS words or less than this share of its words remain.
LEAST_LEFT = 0.2
#: Removable lines (16 bytes each) up to which they are broadcast, and those of one host, as each of its documents is compared
#: with them all; more are joined by host and hash.
BROADCAST_LINES, HOST_LINES = 200_000, 5_000


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more: equal windows are found as neighbours after a sort."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def sought(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(placed, lambda s: F.flatten(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(F.array_distinct(twins)), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows(words), sought)).cast("long")


def lines_of(text: Column) -> Column:
    """The normalised lines: lower case, single spaces, none at the ends. The text is normalised whole, as that costs less."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), "\n", -1), lambda x: F.trim(x))


def line_words(line: Column) -> Column:
    return F.when(line == "", F.lit(0)).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("long")


def _lines(text: Column) -> Column:
    """The normalised lines that hold a word, as (h, words)."""
    return F.transform(F.filter(lines_of(text), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), line_words(x).alias("words")))


def _depleted(left: Column, words: Column) -> Column:
    return (left < LEAST_WORDS) | (left < words * LEAST_LEFT)


def _with_found(rows: DataFrame, lines: DataFrame, found: str) -> DataFrame:
    """`rows` (host, document, lines) with an array `found` of those hashes of their lines that `lines` (host, h) has.

    Short lists go to every task; beyond BROADCAST_LINES and HOST_LINES, which bound them, rows are joined line by line.
    """
    total, most = lines.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    if (total or 0) <= BROADCAST_LINES and (most or 0) <= HOST_LINES:
        listed = rows.join(F.broadcast(lines.groupBy("host").agg(F.collect_set("h").alias(found))), "host", "left")
        return listed.withColumn(found, F.array_intersect(F.transform("lines", lambda x: x["h"]), F.coalesce(found, F.array().cast("array<bigint>"))))
    each = rows.select("host", "document", F.explode("lines.h").alias("h")).distinct().join(lines, ["host", "h"])
    return rows.join(each.groupBy("host", "document").agg(F.collect_set("h").alias(found)), ["host", "document"], "left").withColumn(found, F.coalesce(found, F.array().cast("array<bigint>")))


def frequent_lines(docs: DataFrame, text_column: str = "text", host_column: str = "source", least_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """(host, h): the hashes of the normalised lines of each host that at least `least_documents` of its distinct documents hold.

    Copies count once. Documents whose normalised lines are the same are one. So are documents that their frequent lines
    would deplete and that share the longest of these (the first of equals): a group of near copies has all its lines from
    itself, and counting each of them would remove the whole group. A line that other documents hold too goes all the same.
    Lines are hashed once and written to the shared folder; texts are not read again for the second count.
    """
    text, host = F.coalesce(F.col(text_column), F.lit("")), F.coalesce(F.col(host_column).cast("string"), F.lit(""))
    hashed = docs.select(host.alias("host"), F.explode(F.array(_lines(text))).alias("lines")).where(F.size("lines") > 0)
    hashed = stored(hashed.select("host", F.xxhash64("lines.h").alias("document"), "lines"))
    held = hashed.select("host", "document", F.explode(F.array_distinct("lines.h")).alias("h"))
    often = checkpoint(held.groupBy("host", "h").agg(F.count_distinct("document").alias("n")).where(F.col("n") >= least_documents).select("host", "h"))
    rows = _with_found(hashed, often, "often").where(F.size("often") > 0)
    words = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + x["words"])
    frequent = F.filter("lines", lambda x: F.array_contains(F.col("often"), x["h"]))
    rows = rows.select("host", "document", "often", words(F.col("lines")).alias("words"), F.explode(F.array(frequent)).alias("frequent"))
    longest = F.array_max(F.transform("frequent", lambda x, i: F.struct(x["words"].alias("words"), (-i).alias("place"), x["h"].alias("h"))))["h"]
    copy = _depleted(F.col("words") - words(F.col("frequent")), F.col("words"))
    each = rows.select("host", copy.alias("copy"), F.when(copy, longest).otherwise(F.col("document")).alias("id"), F.explode("often").alias("h"))
    return each.groupBy("host", "h").agg(F.count_distinct("copy", "id").alias("n")).where(F.col("n") >= least_documents).select("host", "h")


def _of_words(text: Column) -> Column:
    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))


def _of_lines(text: Column, bad: Column) -> Column:
    raw = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(lines: Column, gone: Column) -> Column:
        left = F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + F.when((F.size(gone) > 0) & F.array_contains(gone, x["h"]), F.lit(0)).otherwise(x["words"]))
        removed = F.when(F.size(gone) == 0, F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: F.array_contains(gone, x["h"])))).cast("long")
        return F.struct(let(raw, lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("long").alias("n_dup_lines"), removed.alias("removed_lines"), left.alias("left_words"), gone.alias("gone"))

    lines = F.transform(lines_of(text), lambda x: F.struct(F.xxhash64(x).alias("h"), line_words(x).alias("words")))
    known = F.coalesce(bad, F.array().cast("array<bigint>"))
    return let(lines, lambda found: let(F.array_intersect(F.transform(found, lambda x: x["h"]), known), lambda gone: measured(found, gone)))


def _judged(docs: DataFrame, text_column: str, host_column: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with what the rules find, under names that clash with none; those names.

    The measures come out of an explode of one element: Spark moves no filter and no later column into it, so each text is
    measured once.
    """
    names = ["found", "base_failed", "kept", "left_text", "host", "hashes", "text_hash"]
    n = dict(zip(names, fresh(docs, *names), strict=True))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.withColumn(n["host"], F.coalesce(F.col(host_column).cast("string"), F.lit("")))
    bad = checkpoint(frequent_lines(docs, text_column, host_column))
    total, most = bad.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    if (total or 0) <= BROADCAST_LINES and (most or 0) <= HOST_LINES:
        bad = bad.groupBy(F.col("host").alias(n["host"])).agg(F.collect_set("h").alias(n["hashes"]))
        rows = rows.join(F.broadcast(bad), n["host"], "left")
    else:  # the lines of each distinct text that are removed, joined to the texts by their hash
        rows = rows.withColumn(n["text_hash"], F.xxhash64(text))
        each = rows.select(F.col(n["host"]).alias("host"), F.col(n["text_hash"]).alias("t"), F.explode(F.array_distinct(_lines(text)["h"])).alias("h"))
        gone = each.join(bad, ["host", "h"]).groupBy(F.col("host").alias(n["host"]), F.col("t").alias(n["text_hash"])).agg(F.collect_set("h").alias(n["hashes"]))
        rows = rows.join(checkpoint(gone), [n["host"], n["text_hash"]], "left")
    measured = F.struct(_of_words(text).alias("words"), _of_lines(text, F.col(n["hashes"])).alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    rows = rows.select("*", F.explode(F.array(measured)).alias(n["found"]))
    words, left = F.col(n["found"])["words"]["n_words"], F.col(n["found"])["lines"]["left_words"]
    rows = rows.withColumn(n["base_failed"], (words < LEAST_WORDS) | (F.col(n["found"])["words"]["n_repeat_words"] * 100 > words * MOST_REPEATED))
    return rows.withColumn(n["kept"], ~F.col(n["base_failed"]) & ~_depleted(left, words)), n


def rate_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines, left_words, kept.

    A text fails the base rules if it has fewer than 10 words or over a fifth of them stand in five-word windows that it
    repeats. Lines that reach the limit of `frequent_lines` are then taken away, and a document of which too little is left is
    rejected as depleted. Null texts count as empty and fail; null hosts are one host; repeated rows get one row each and
    count once for their lines; null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    rows, n = _judged(docs, text_column, host_column)
    w, x = F.col(n["found"])["words"], F.col(n["found"])["lines"]
    return rows.select(
        F.col(id_column).alias("doc_id"), w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), F.col(n["found"])["n_symbols"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        F.col(n["base_failed"]).alias("base_failed"), x["removed_lines"].alias("removed_lines"), x["left_words"].alias("left_words"), F.col(n["kept"]).alias("kept"),
    )


def keep_good_documents(docs: DataFrame, text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The columns of `docs`: rows that are kept, their texts without the removed lines, n_chars (if there is one) of those.

    Null, empty and very long texts, ties, repeated rows and empty tables are treated as rate_documents does: null and empty
    texts fail, repeated rows stay repeated; columns of any name are kept.
    """
    rows, n = _judged(docs, text_column, host_column)
    gone = F.col(n["found"])["lines"]["gone"]
    hashes = F.transform(lines_of(F.col(text_column)), lambda x: F.xxhash64(x))
    lines = let(hashes, lambda h: F.filter(F.split(F.col(text_column), "\n", -1), lambda _, i: ~F.array_contains(gone, F.get(h, i))))
    cleaned = F.when(F.size(gone) > 0, F.array_join(lines, "\n")).otherwise(F.col(text_column))
    kept = rows.where(F.col(n["kept"])).withColumn(n["left_text"], cleaned)
    changed = {text_column: F.col(n["left_text"]), "n_chars": F.length(n["left_text"]).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
