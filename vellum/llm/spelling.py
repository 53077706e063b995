"""Spelling variants by symmetric deletion: words that share a word or a single deletion are joined and verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, checkpoint, stored

#: Code points and occurrences of a word at least; times that a form is more frequent than its variant at least; of so many runs about one is misspelt.
LETTERS, OCCURRENCES, TIMES, MISSPELT = 6, 5, 5, 199
#: Distinct results that a task counts before it passes them on.
COUNTED_AT_ONCE = 200_000
RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, counted over all documents.

    A run of which `misspelt` divides the CRC-32 of `<id>:<run>` loses the code point at that number modulo its length (0: no
    run does). Results of fewer than `letters` code points don't count. Null and empty texts have none; the id of a null id
    is empty; repeated rows count each. Each task adds up its own, so the shuffle has a word once for each task.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        out: list[tuple[str, int]] = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if row is None else row}:".encode())
            for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "surrogatepass"))).items() if text else ():
                if misspelt and (h := zlib.crc32(run.encode(), start)) % misspelt == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= letters:
                    found[run] += n
            if len(found) > COUNTED_AT_ONCE:
                out += found.items()
                found = Counter()
        out += found.items()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["word", "n"])

    return arrow_map(docs.select(id_column, text_column), step, "word string, n long", rows=1 << 16).groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of `words` (word, n), all distinct: both ways, each pair at distance exactly one once.

    Every word emits itself and its distinct single deletions. Words one insertion apart share the shorter, words one
    replacement apart what is left without the replaced code point; other pairs that share a key are two apart and fail the
    exact check. A key is shared by as many words as one insertion can make of it, a bound that no table raises.
    """
    at = F.sequence(F.lit(1), F.length("word"))
    less = F.transform(at, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    keys = words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("key"))
    other = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = keys.select("key", "word").join(other, "key").where("word <> near and abs(length(word) - length(near)) <= 1")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): from a word follow forms to the last; the word itself if it has none.

    Each round joins every root with that root's root, so chains of any length take as many rounds as their logarithm. A form
    is more frequent than its word, so there are no rings.
    """
    known = checkpoint(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(known.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        known = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return known


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n), all distinct.

    A word's form is its near word (one code point inserted, deleted or replaced) of the largest n, of equal ones the first in
    code-point order, if that n is at least `times` the word's; else null, as is form_n. n_near counts near words. An empty
    table gives an empty result; null words are left out.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its variant, or forms could run in a ring")
    words = stored(words.where("word is not null"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    frequent = F.col("form_n") >= times * F.col("n")
    formed = stored(found.select("word", F.when(frequent, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("form_n")).alias("form_n")))
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, misspelt: int = 0) -> DataFrame:
    """The words of whole texts that occur often enough, with their forms and roots. Extra columns are left aside."""
    return spelling_variants(count_words(docs, id_column, text_column, letters, misspelt).where(F.col("n") >= occurrences), times)
