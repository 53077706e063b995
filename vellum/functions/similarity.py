"""Similarities of titles, authors and years, as built-in expressions; only the Ratcliff-Obershelp ratio runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Shares of title, authors and year in a match score.
WEIGHTS = {"title": 0.40, "author": 0.35, "year": 0.25}


#: Pairs of strings whose ratio a worker remembers.
REMEMBERED = 1 << 15


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def empty(column: Column) -> Column:
    return column.isNull() | (column == "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    return F.when(empty(a) | empty(b), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_jaccard(a: Column, b: Column) -> Column:
    return F.when(empty(a) | empty(b), 0.0).otherwise(jaccard(words(a), words(b)))


def year_score(a: Column, b: Column) -> Column:
    """1 for the same year, 0.5 for neighbours, else 0; 0 for what is no year."""
    apart = F.abs(a.try_cast("int") - b.try_cast("int"))
    return F.when(apart == 0, 1.0).when(apart == 1, 0.5).otherwise(0.0)


@lru_cache(REMEMBERED)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; 0 if either is empty. Null pairs cost nothing, and names and titles that come again are not compared again."""
    return pd.Series([_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


#: Letters of a block: so many bits of a long take part, and a sum of two blocks and a carry is still one.
BLOCK = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def with_masks(text: Column) -> Column:
    """(text, size, masks): of each letter the places where it stands in the text, as bits, in blocks of BLOCK places."""

    def masks(found: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        bit = lambda letter, b: lambda sum_, at: F.when(F.get(found, b * BLOCK + at) == letter, sum_.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))).otherwise(sum_)
        places = lambda b: F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.size(found) - b * BLOCK) - 1)
        one = lambda letter: F.transform(blocks, lambda b: F.aggregate(places(b), F.lit(0).cast("long"), bit(letter, b)))
        distinct = F.array_distinct(found)
        return F.when(F.size(found) > 0, F.map_from_arrays(distinct, F.transform(distinct, one)))

    return F.struct(text.alias("text"), F.length(text).alias("size"), masks(letters(text)).alias("masks"))


def longest_common(masked: Column, other: Column) -> Column:
    """Length of the longest common subsequence of a text with masks and another text, neither of them empty.

    Bit-parallel: a row of the textbook table is one long, or several with a carry between them. A zero bit is a place
    where the row's value rises.
    """
    size, masks = masked["size"], masked["masks"]
    none = F.lit(0).cast("long")
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    full = ones(F.least(size, F.lit(BLOCK)))

    def row(v: Column, letter: Column) -> Column:
        return let(v.bitwiseAND(F.coalesce(F.get(F.try_element_at(masks, letter), F.lit(0)), none)), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(full))

    def long_row(v: Column, letter: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            mine = F.get(v, b)
            u = mine.bitwiseAND(F.coalesce(F.get(F.try_element_at(masks, letter), b), none))
            total = mine + u + state["carry"]
            return F.struct(F.call_function("shiftright", total, F.lit(BLOCK)).alias("carry"), F.concat(state["out"], F.array(total.bitwiseAND(F.lit((1 << BLOCK) - 1)).bitwiseOR(mine - u))).alias("out"))

        start = F.struct(none.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), start, block)["out"]

    short = F.bit_count(F.aggregate(letters(other), full, row))
    blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    rows = F.aggregate(letters(other), F.transform(blocks, lambda b: F.lit((1 << BLOCK) - 1)), long_row)
    counts = F.zip_with(rows, blocks, lambda v, b: F.bit_count(v.bitwiseAND(ones(F.least(F.lit(BLOCK), size - b * BLOCK)))))
    return size - F.when(size <= BLOCK, short).otherwise(F.aggregate(counts, F.lit(0), lambda s, n: s + n))


def _indel(masked: Column, other: Column) -> Column:
    both = masked["size"] + F.length(other)
    return F.when(masked["text"] == other, 1.0).when((masked["size"] == 0) | (other == ""), 0.0).otherwise(2 * longest_common(masked, other) / both)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / sum of lengths; nulls are empty, two empty strings are equal."""
    return let(with_masks(F.coalesce(a, F.lit(""))), lambda x: _indel(x, F.coalesce(b, F.lit(""))))


def _greedy(left: Column, right: Column, ratio: Callable[[Column, Column], Column], least: Column) -> Column:
    """The ratios that the left strings reach, each with the likest right one that no earlier one has taken, the first of equals.

    Taken is a right string whose ratio is above `least`; left strings without one reach nothing.
    """

    def take(state: Column, x: Column) -> Column:
        open_ = F.transform(right, lambda y, k: F.when(F.array_contains(state["used"], k), -1.0).otherwise(ratio(x, y)))
        chosen = let(open_, lambda r: F.struct(F.array_max(r).alias("best"), (F.array_position(r, F.array_max(r)) - 1).cast("int").alias("at")))
        return let(chosen, lambda c: F.when(c["best"] > least, F.struct(F.array_append(state["used"], c["at"]).alias("used"), F.array_append(state["reached"], c["best"]).alias("reached"))).otherwise(state))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("reached"))
    return F.aggregate(F.transform(left, with_masks), start, take)["reached"]


def soft_jaccard(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Words of the left title each take the likest unused right word; those above the threshold count as shared.

    Words that are too far apart by edit distance, which is never above the distance by insertions and deletions, are not
    compared further.
    """
    tokens = lambda t: F.filter(F.split(F.trim(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != "")

    def ratio(x: Column, y: Column) -> Column:
        most = F.floor((1 - threshold) * (x["size"] + F.length(y)) + 1e-9).cast("int")
        far = F.call_function("levenshtein", x["text"], y, most) < 0
        return F.when(x["text"] == y, 1.0).when(far, 0.0).otherwise(_indel(x, y))

    def shared(left: Column, right: Column) -> Column:
        n = F.size(_greedy(left, right, ratio, F.lit(threshold)))
        return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(n / (F.size(left) + F.size(right) - n))

    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda t: shared(t["a"], t["b"]))


def author_ratio(a: Column, b: Column) -> Column:
    """Each left author (names joined) takes the likest unused right one; the mean ratio over the left authors."""
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda n: F.array_join(n, " "))

    def mean(left: Column, right: Column) -> Column:
        total = F.aggregate(_greedy(left, right, _indel, F.lit(-0.5)), F.lit(0.0), lambda s, r: s + r)
        return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(total / F.size(left))

    return let(F.struct(names(a).alias("a"), names(b).alias("b")), lambda t: mean(t["a"], t["b"]))


def author_overlap(a: Column, b: Column, fuzzy: bool = True) -> Column:
    """First authors: equal 0.5, equal last word 0.3, alike 0.25; plus half the Jaccard of all last words; 1 at most.

    Only pairs that neither equality decides go to the string kernel; the others pass it nulls.
    """
    last = lambda n: F.element_at(F.split(n, r"\s+"), -1)
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    settled = (x == y) | (last(x) == last(y))
    alike = sequence_ratio(F.when(~settled, x), F.when(~settled, y)) > 0.8 if fuzzy else F.lit(False)
    first = F.when(x == y, 0.5).when(last(x) == last(y), 0.3).when(alike, 0.25).otherwise(0.0)
    lasts = lambda names: F.array_distinct(F.transform(names, last))
    none = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(none, 0.0).otherwise(F.least(F.lit(1.0), first + 0.5 * jaccard(lasts(a), lasts(b))))


def match_score(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column, weights: dict[str, float] | None = None, fuzzy: bool = True) -> Column:
    """Weighted sum of title, author and year scores; the title's is the best of three similarities."""
    return match_total(*match_parts(title_a, title_b, authors_a, authors_b, year_a, year_b, fuzzy), weights)


def match_parts(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column, fuzzy: bool = True) -> tuple[Column, Column, Column]:
    kinds = [edit_similarity(title_a, title_b), word_jaccard(title_a, title_b)] + ([F.coalesce(sequence_ratio(title_a, title_b), F.lit(0.0))] if fuzzy else [])
    return F.greatest(*kinds), author_overlap(authors_a, authors_b, fuzzy), year_score(year_a, year_b)


def match_total(title: Column, author: Column, year: Column, weights: dict[str, float] | None = None) -> Column:
    w = WEIGHTS | (weights or {})
    return title * w["title"] + author * w["author"] + year * w["year"]


def similarity_components(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column) -> Column:
    """(title, author, year, total) with shares of 0.5, 0.3 and 0.2."""
    title, author, year = similarity_parts(title_a, title_b, authors_a, authors_b, year_a, year_b)
    return F.struct(title.alias("title"), author.alias("author"), year.alias("year"), similarity_total(title, author, year).alias("total"))


def similarity_parts(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column) -> tuple[Column, Column, Column]:
    return sequence_ratio(title_a, title_b), jaccard(F.array_distinct(authors_a), F.array_distinct(authors_b)), year_score(year_a, year_b)


def similarity_total(title: Column, author: Column, year: Column) -> Column:
    return title * 0.5 + author * 0.3 + year * 0.2


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
