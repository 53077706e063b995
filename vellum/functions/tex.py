"""LaTeX rules on whole texts as Columns: groups in braces, titles, macros, styles, headings over several lines, includes.

A group is found by a pattern that follows braces DEPTH levels down, or, where only its end is wanted, by counting braces
without a limit. Groups nested deeper than DEPTH are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.rules import DECLARATIONS, DEFINERS, DEPTHS, TITLES, WRAPPERS, replaced
from vellum.functions.similarity import let
from vellum.functions.text import strip_comments

DEPTH = 40
#: Stands behind what a style command was taken from, so that it doesn't grow together with what follows.
SEAM = "￾"
MACROS = "array<struct<name: string, body: string>>"


def _inside(depth: int) -> str:
    found = r"(?:[^{}\\]++|\\[\s\S])*+"
    for _ in range(depth):
        found = r"(?:[^{}\\]++|\\[\s\S]|\{" + found + r"\})*+"
    return found


INSIDE = _inside(DEPTH)


def _command(names: frozenset[str] | tuple[str, ...]) -> str:
    return r"\\(?:" + "|".join(sorted(names)) + r")(?![A-Za-z@])"


#: A definer, and behind it, not consumed: the macro's name, and its body if it takes no argument.
BRACED_MACRO = _command(DEFINERS[0]) + r"(?=\s*\{(\\[A-Za-z@]+)\}\s*(?:\[0\]\s*)?\{(" + INSIDE + r")\})"
PLAIN_MACRO = _command(DEFINERS[1]) + r"(?=\s*(\\[A-Za-z@]+)\s*\{(" + INSIDE + r")\})"
STYLE = _command(DECLARATIONS) + r"[ \t]*|" + _command(WRAPPERS) + r"[ \t]*\{(" + INSIDE + r")\}"
HEADING = r"\\(?:" + "|".join(sorted(DEPTHS, key=len, reverse=True)) + r")\*?\s*\{" + INSIDE + r"\}"
SETS_UP = r"^\s*\\(?:" + "|".join(sorted(DEFINERS[0] | DEFINERS[1])) + r")(?![A-Za-z0-9_])|^\\if.*\\fi|^\\(?:" + "|".join(TITLES) + ")"


def closing(text: Column) -> Column:
    """Where the brace that a text begins with closes, from 0; null if it doesn't, or if there is none. A backslash hides a letter."""
    tokens = F.regexp_extract_all(text, F.lit(r"\\[\s\S]|[{}]|[^{}\\]++|\\"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        ends = F.when((token == "}") & (depth == 0), s["at"])
        return F.when(s["end"].isNotNull(), s).otherwise(F.struct(depth.alias("depth"), (s["at"] + F.length(token)).alias("at"), ends.alias("end")))

    return F.when(F.startswith(text, F.lit("{")), F.aggregate(tokens, start, step)["end"])


def find_title(text: Column) -> Column:
    """The argument of the first title command that has one, on one line, without conditionals and spacing; null if it is empty."""
    rest = F.regexp_extract(strip_comments(text), r"(?s)" + _command(TITLES) + r"\s*(?:\[[^\]]*\]\s*)?(\{.*)$", 1)
    title = let(rest, lambda r: F.substring(r, F.lit(2), closing(r) - 1))
    plain = F.replace(F.replace(title, F.lit("\\\\"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.nullif(F.btrim(replaced(plain, (r"\s{2,}", " "), (r"\\(?:if|fi|vspace)[A-Za-z]*\{*[\w\-.]*\}*", "")), F.lit(" \t\n\r\x0b\x0c")), F.lit(""))


def macros_of(text: Column) -> Column:
    """Macros without arguments and their bodies: those by \\newcommand and its kin, then those by \\def and its."""

    def found(clean: Column, pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(clean, F.lit(pattern), F.lit(2)).alias("body"))
        return F.filter(F.transform(both, lambda m: F.struct(m["name"].alias("name"), F.btrim(m["body"], F.lit(" \t\n\r\x0b\x0c")).alias("body"))), lambda m: m["body"] != "")

    return let(strip_comments(text), lambda clean: F.concat(found(clean, BRACED_MACRO), found(clean, PLAIN_MACRO)))


def _fixpoint(start: Column, passes: int, change: Callable[[Column], Column]) -> Column:
    """`change` again and again, until nothing changes or so many passes are done."""

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(change(s["text"]), lambda now: F.struct(now.alias("text"), (now == s["text"]).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(start.alias("text"), F.lit(False).alias("done")), step)["text"]


def expand(text: Column, macros: Column, passes: int = 10) -> Column:
    """Macros replaced by their bodies, longest names first, in several passes."""
    order = F.transform(F.array_sort(F.transform(macros, lambda m, i: F.struct((-F.length(m["name"])).alias("n"), i.alias("i"), m.alias("m")))), lambda x: x["m"])

    def one(t: Column, m: Column) -> Column:
        by = F.replace(F.replace(m["body"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when(F.contains(t, m["name"]), F.regexp_replace(t, F.concat(F.lit("\\"), m["name"], F.lit("(?![A-Za-z@])")), by)).otherwise(t)

    return let(order, lambda ms: _fixpoint(text, passes, lambda t: F.aggregate(ms, t, one)))


def macro_map(found: Column) -> Column:
    """Of all macros found, in their order, each name once with its last body, the bodies expanded by each other."""
    def last(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda m: m["name"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(all_, lambda m: m["name"] == n), -1)["body"].alias("body")))

    return let(let(found, last), lambda ms: F.transform(ms, lambda m: F.struct(m["name"].alias("name"), expand(m["body"], ms, 5).alias("body"))))


def remove_styles(text: Column) -> Column:
    """Style declarations dropped, style commands replaced by their argument, inside each other too."""
    return F.replace(_fixpoint(text, DEPTH, lambda t: F.regexp_replace(t, STYLE, f"$1{SEAM}")), F.lit(SEAM), F.lit(""))


def reflow_headings(text: Column) -> Column:
    """Headings over several lines joined into one."""
    heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)), lambda h: F.regexp_replace(h, r"\s*\n\s*", " "))
    parts = F.split(text, HEADING, -1)
    return let(heads, lambda hs: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(hs, i), F.lit("")))), ""))


def prepared(text: Column, macros: Column, fixed_headings: bool = False) -> Column:
    """A text without comments, definitions and titles (empty lines in their place), macros expanded, styles unwrapped.

    As in the original rules headings over several lines stay so unless `fixed_headings`.
    """
    lines = F.split(strip_comments(F.regexp_replace(text, r"\\noindent\b", "")), "\n", -1)
    body = F.array_join(F.transform(lines, lambda line: F.when(line.rlike(SETS_UP), "").otherwise(line)), "\n")
    plain = remove_styles(expand(body, macros, 2))
    return let(plain, reflow_headings) if fixed_headings else plain


def include_order(files: Column, main: Column) -> Column:
    """The files that `main` pulls in, depth first, each once; a name that isn't there is tried without its folders.

    `files` is an array of (name, includes). Each step takes the last of the names to do; there are as many as includes.
    """
    known = F.map_from_arrays(F.transform(files, lambda f: f["name"]), F.transform(files, lambda f: f["includes"]))
    most = F.aggregate(files, F.lit(1), lambda n, f: n + F.size(f["includes"]))

    def walk(map_: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            left = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)

            def named(name: Column) -> Column:
                there = F.when(F.array_contains(F.map_keys(map_), name), name).otherwise(F.element_at(F.split(name, "/"), -1))
                return let(there, visited)

            def visited(name: Column) -> Column:
                skip = F.array_contains(s["order"], name) | ~F.array_contains(F.map_keys(map_), name)
                more = F.reverse(F.coalesce(F.try_element_at(map_, name), F.array().cast("array<string>")))
                return F.when(skip, F.struct(left.alias("todo"), s["order"].alias("order"))).otherwise(F.struct(F.concat(left, more).alias("todo"), F.array_append(s["order"], name).alias("order")))

            return F.when(F.size(s["todo"]) == 0, s).otherwise(let(F.regexp_replace(F.element_at(s["todo"], -1), r"^\./", ""), named))

        start = F.struct(F.array(main).alias("todo"), F.array().cast("array<string>").alias("order"))
        return F.aggregate(F.sequence(F.lit(1), most), start, step)["order"]

    return let(known, walk)
