"""The line machine of LaTeX texts as folds over arrays: lines of a file to events, events of a version to nodes.

A fold keeps a few fields from line to line. What it gives is gathered in pieces of PIECE, so a long text isn't copied anew at
each line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.rules import DEPTHS, INCLUDE, LEVELS
from vellum.functions.similarity import let
from vellum.functions.tex import INSIDE
from vellum.functions.text import sentences, tex_name

EVENT = "struct<kind: string, level: string, title: string, content: string, lines: array<string>>"
NODE = "struct<inner: boolean, node_type: string, title: string, content: string>"
MATH = "equation|align|gather|eqnarray"
LISTS, BLOCKS = ("itemize", "enumerate"), r"\\begin\{(itemize|enumerate|lstlisting|listing)\}"
FLUSH_LINES, PIECE, BRACKETS = 50, 256, 10
#: Headings that get an empty sentence; more levels than any tree has.
PADDED, MOST_LEVELS = ("part", "chapter", "subsection", "subsubsection"), 12
SPACES = " \t\n\r\x0b\x0c"


def _brackets(depth: int) -> str:
    found = r"(?:[^\[\]\\]++|\\.)*+"
    for _ in range(depth):
        found = r"(?:[^\[\]\\]++|\\.|\[" + found + r"\])*+"
    return found


HEADING = r"^\\(" + "|".join(sorted(DEPTHS, key=len, reverse=True)) + r")\*{0,2}\s*(?:\[" + _brackets(BRACKETS) + r"\]\s*)?\{(" + INSIDE + r")\}(.*)$"


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def event(kind: str, level: Column | None = None, title: Column | None = None, content: Column | None = None, lines: Column | None = None) -> Column:
    fields = (F.lit(kind).alias("kind"), (none() if level is None else level).alias("level"), (none() if title is None else title).alias("title"), (none() if content is None else content).alias("content"), (none("array<string>") if lines is None else lines).alias("lines"))
    return F.struct(*fields).cast(EVENT)


def fold(items: Column, start: dict[str, Column], kind: str, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """What `step` gives of each item, an array of `kind`, all of it in one array; `finish` gives more at the end.

    `step` takes the fields of `start` as they are and an item, and returns a struct of the same fields and `emit`.
    """

    def both(s: Column, x: Column) -> Column:
        def gathered(r: Column, now: Column) -> Column:
            full = F.size(now) >= PIECE
            return F.struct(*(r[f].alias(f) for f in start), F.when(full, empty(kind)).otherwise(now).alias("now"), F.when(full, F.array_append(s["out"], now)).otherwise(s["out"]).alias("out"))

        return let(step(s, x), lambda r: let(F.concat(s["now"], r["emit"]), lambda now: gathered(r, now)))

    zero = F.struct(*(v.alias(f) for f, v in start.items()), empty(kind).alias("now"), empty(f"array<{kind}>").alias("out"))
    end = lambda s: F.flatten(F.array_append(s["out"], F.concat(s["now"], finish(s)) if finish else s["now"]))
    return F.aggregate(items, zero, both, end)


def lines_of(text: Column) -> Column:
    """The lines of a text; a line feed at its end begins none."""
    return let(F.split(text, "\n", -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def _count(line: Column, mark: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)


def _behind(line: Column, mark: Column) -> Column:
    """What stands behind the first place of a mark; null if there is none."""
    at = F.call_function("locate", mark, line)
    return F.when(at > 0, F.substring(line, at + F.length(mark), F.length(line)))


def _closed(kind: Column, line: Column) -> Column:
    """What stands behind the end of display math of a kind, if it ends in a line; else null."""
    dollars = _count(line, "$$")
    ends = (dollars > 0) & ((dollars.cast("int") % 2 == 1) | F.endswith(F.rtrim(line), F.lit("$$")))
    return (
        F.when(kind == "$$", F.when(ends, F.substring_index(line, "$$", -1)))
        .when(kind == "\\[", F.when(F.contains(line, F.lit("\\]")), F.substring_index(line, "\\]", -1)))
        .otherwise(_behind(line, F.concat(F.lit("\\end{"), kind, F.lit("}"))))
    )


def _math_begins(line: Column) -> Column:
    env = F.regexp_extract(line, rf"\\begin\{{((?:{MATH})\*?)\}}", 1)
    return F.when(F.contains(line, F.lit("$$")), "$$").when(F.startswith(line, F.lit("\\[")), "\\[").when(env != "", env)


def _twice(line: Column) -> tuple[Column, Column]:
    """Of a line with two pairs of dollar signs: the math between the first two, and what follows."""
    parts = F.split(line, r"\$\$", 3)
    return F.concat(F.lit("$$"), F.get(parts, F.lit(1)), F.lit("$$")), strip(F.get(parts, F.lit(2)))


def file_events(text: Column, is_main: Column) -> Column:
    """The events of a text made ready: headings, includes, text of up to FLUSH_LINES lines, blocks, math, figures and tables.

    What is tried first decides. Of the main file only what stands inside its document counts. Blocks, math and areas share
    one buffer, as by the original rule, so what stands in a figure before a list in it is lost, and so is what never ends.
    """
    start = {"inside": ~is_main, "over": F.lit(False), "env": none(), "math": none(), "area": none(), "text": empty("string"), "block": empty("string")}

    def step(s: Column, line: Column) -> Column:
        def to(emit: list[Column], flush: bool = False, **changes: Column) -> Column:
            fields = {f: s[f] for f in start} | changes
            if flush:
                fields["text"] = empty("string")
            out = F.array(*emit) if emit else empty(EVENT)
            if flush:
                out = F.concat(F.when(F.size(s["text"]) > 0, F.array(event("text", lines=s["text"]))).otherwise(empty(EVENT)), out)
            return F.struct(*(v.alias(f) for f, v in fields.items()), out.alias("emit"))

        names = F.regexp_extract_all(line, F.lit(INCLUDE), F.lit(1))
        block = F.regexp_extract(line, BLOCKS, 1)
        begins = _math_begins(line)
        area = F.regexp_extract(line, r"\\begin\{(figure|table)\*?\}", 1)
        more = F.array_append(s["block"], line)
        ends = lambda env: F.contains(line, F.concat(F.lit("\\end{"), env, F.lit("}")))
        joined = F.array_join(more, "\n")
        dollars, rest = _twice(line)
        leaf = lambda env: F.when(env.isin(*LISTS), env).otherwise("listing")
        spoken = F.when(F.size(s["text"]) == FLUSH_LINES - 1, to([event("text", lines=F.array_append(s["text"], line))], text=empty("string"))).otherwise(to([], text=F.array_append(s["text"], line)))
        plain = s["inside"] & s["env"].isNull() & s["math"].isNull() & s["area"].isNull() & ~line.rlike(r"[\\\\$]")
        in_area = lambda kind, lines: let(F.struct(kind.alias("kind"), F.array_append(lines, line).alias("lines")), lambda a: _area(to, line, a["kind"], a["lines"]))

        return (
            F.when(s["over"], to([])).when(line == "", to([], flush=True)).when(plain, spoken)
            .when(~s["inside"], to([], inside=F.contains(line, F.lit("\\begin{document}"))))
            .when(is_main & F.contains(line, F.lit("\\end{document}")), to([], over=F.lit(True)))
            .when(line.rlike(HEADING), to([event("heading", F.regexp_extract(line, HEADING, 1), F.regexp_extract(line, HEADING, 2), strip(F.regexp_extract(line, HEADING, 3)))], flush=True))
            .when(F.size(names) > 0, to([event("include", lines=F.transform(names, tex_name))], flush=True))
            .when(s["env"].isNotNull(), F.when(ends(s["env"]), to([event("block", s["env"], lines=more)], env=none(), block=empty("string"))).otherwise(to([], block=more)))
            .when(block != "", F.when(ends(block), to([event("leaf", leaf(block), content=line)], flush=True)).otherwise(to([], flush=True, env=block, block=F.array(line))))
            .when(s["math"].isNotNull(), let(_closed(s["math"], line), lambda r: F.when(r.isNotNull(), to([event("math", title=strip(r), content=joined)], math=none(), block=empty("string"))).otherwise(to([], block=more))))
            .when(_count(line, "$$") >= 2, to([event("math", title=rest, content=dollars)], flush=True))
            .when(begins.isNotNull(), let(F.when(begins != "$$", _closed(begins, line)), lambda r: F.when(r.isNotNull(), to([event("math", title=strip(r), content=line)], flush=True)).otherwise(to([], flush=True, math=begins, block=F.array(line)))))
            .when(s["area"].isNotNull(), in_area(s["area"], s["block"])).when(area != "", let(F.lit(0), lambda _: _area(lambda emit, **kw: to(emit, flush=True, **kw), line, area, F.array(line))))
            .otherwise(spoken)
        )

    last = lambda s: F.when(F.size(s["text"]) > 0, F.array(event("text", lines=s["text"]))).otherwise(empty(EVENT))
    return fold(F.transform(lines_of(text), strip), start, EVENT, step, last)


def _area(to: Callable, line: Column, kind: Column, lines: Column) -> Column:
    ends = F.contains(line, F.concat(F.lit("\\end{"), kind, F.lit("}"))) | F.contains(line, F.concat(F.lit("\\end{"), kind, F.lit("*}")))
    return F.when(ends, to([event("leaf", kind, content=F.array_join(lines, "\n"))], area=none(), block=empty("string"))).otherwise(to([], area=kind, block=lines))


def version_events(files: Column, main: Column) -> Column:
    """The events of a version's files in reading order: each include in its place, files that none reaches behind them.

    `files` is an array of (name, events). A file within itself is left out, one named twice comes twice. A name that isn't
    there is tried without its folders.
    """
    return let(files, lambda found: _reading_order(found, main))


def _reading_order(files: Column, main: Column) -> Column:
    names = F.transform(files, lambda f: f["name"])
    known = F.map_from_arrays(names, F.transform(files, lambda f: f["events"]))
    item = f"struct<file: string, chain: array<string>, event: {EVENT}>"

    def walk(map_: Column) -> Column:
        def entered(name: Column, chain: Column) -> Column:
            own = F.concat(F.array(event("enter", content=name)), F.coalesce(F.try_element_at(map_, name), empty(EVENT)))
            return F.transform(own, lambda e: F.struct(name.alias("file"), chain.alias("chain"), e.alias("event")).cast(item))

        def found(name: Column) -> Column:
            base = F.when(F.contains(name, F.lit("\\")), F.substring_index(name, "\\", -1)).otherwise(F.substring_index(name, "/", -1))
            there = lambda n: F.array_contains(F.map_keys(map_), n)
            return F.when(there(name), name).when(there(base), base)

        def opened(i: Column) -> Column:
            chain = F.array_append(i["chain"], i["file"])
            inner = F.filter(F.transform(i["event"]["lines"], found), lambda n: n.isNotNull() & ~F.array_contains(chain, n))
            return F.when(i["event"]["kind"] == "include", F.flatten(F.transform(inner, lambda n: entered(n, chain)))).otherwise(F.array(i))

        def expanded(name: Column) -> Column:
            def deeper(items: Column, _: Column) -> Column:
                return F.when(F.exists(items, lambda i: i["event"]["kind"] == "include"), F.flatten(F.transform(items, opened))).otherwise(items)

            return F.aggregate(F.sequence(F.lit(0), F.size(files)), entered(name, empty("string")), deeper)

        def rest(items: Column, name: Column) -> Column:
            return F.when(F.exists(items, lambda i: i["file"] == name), items).otherwise(F.concat(items, expanded(name)))

        return F.transform(F.aggregate(names, expanded(main), rest), lambda i: i["event"])

    return F.filter(let(known, walk), lambda e: e["kind"] != "enter")


def _node(kind: Column, content: Column | None = None, title: Column | None = None, inner: bool = False) -> Column:
    return F.struct(F.lit(inner).alias("inner"), kind.alias("node_type"), (none() if title is None else title).alias("title"), (none() if content is None else content).alias("content")).cast(NODE)


def _said(text: Column, inner: bool = False) -> Column:
    return F.when(text == "", empty(NODE)).otherwise(F.transform(sentences(text), lambda t: _node(F.lit("sentence"), t, inner=inner)))


def list_items(env: Column, lines: Column) -> Column:
    """The nodes inside a list: items are no nodes, their lines are read as one text, in which math is told apart; null without items."""
    parts = F.split(F.array_join(lines, "\n"), r"\\item", -1)
    end = lambda x: _before(x, F.concat(F.lit("\\end{"), env, F.lit("}")))
    cut = let(F.slice(parts, F.lit(2), F.size(parts)), lambda items: F.transform(items, lambda x, i: F.when(i == F.size(items) - 1, end(x)).otherwise(x)))
    start = {"text": empty("string"), "math": none(), "held": empty("string")}
    spoken = lambda s: _said(strip(F.array_join(s["text"], " ")), inner=True)

    def step(s: Column, line: Column) -> Column:
        def to(emit: Column, **changes: Column) -> Column:
            return F.struct(*((changes[f] if f in changes else s[f]).alias(f) for f in start), emit.alias("emit"))

        def math(content: Column, rest: Column) -> Column:
            return F.concat(F.array(_node(F.lit("math"), content, inner=True)), _said(strip(rest), inner=True))

        nothing, blank = empty(NODE), empty("string")
        held = F.array_append(s["held"], line)
        begins = _math_begins(line)
        dollars, rest = _twice(line)
        opened = let(F.when(begins != "$$", _closed(begins, line)), lambda r: F.when(r.isNotNull(), to(F.concat(spoken(s), math(line, r)), text=blank)).otherwise(to(spoken(s), text=blank, math=begins, held=F.array(line))))
        return (
            F.when(s["math"].isNotNull(), let(_closed(s["math"], line), lambda r: F.when(r.isNotNull(), to(math(F.array_join(held, "\n"), r), math=none(), held=blank)).otherwise(to(nothing, held=held))))
            .when(_count(line, "$$") >= 2, to(F.concat(spoken(s), math(dollars, rest)), text=blank)).when(begins.isNotNull(), opened).otherwise(to(nothing, text=F.array_append(s["text"], line)))
        )

    return F.when(F.size(parts) > 1, fold(F.transform(F.flatten(F.transform(cut, lines_of)), strip), start, NODE, step, spoken))


def _before(text: Column, mark: Column) -> Column:
    at = F.call_function("locate", mark, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def event_nodes(e: Column) -> Column:
    """The nodes of an event, in order; those that are `inner` lie below its first. Null for a list without items."""
    listed = F.concat(F.array(_node(e["level"])), list_items(e["level"], e["lines"]))
    block = F.when(e["level"].isin(*LISTS), listed).otherwise(F.array(_node(F.lit("listing"), F.array_join(e["lines"], "\n"))))
    return (
        F.when(e["kind"] == "heading", F.concat(F.array(_node(e["level"], title=e["title"])), _said(e["content"], inner=True)))
        .when(e["kind"] == "text", _said(F.array_join(e["lines"], " "))).when(e["kind"] == "math", F.concat(F.array(_node(F.lit("math"), e["content"])), _said(e["title"])))
        .when(e["kind"] == "block", block).otherwise(F.array(_node(e["level"], e["content"])))
    )


def tree_rows(events: Column, title: Column, level_aware: bool = False, ends: bool = True) -> Column:
    """The nodes of a version's events with their places: preorder, parent_preorder, depth, subtree_end. Null if a list has no items.

    By the original rule a heading cuts the stack of open ones to a length that its level fixes; `level_aware` closes those
    that are not above it. New nodes always lie below the last open heading, so they come in preorder. Headings without
    content get an empty sentence; by the original rule not sections, appendices and paragraphs. Without `ends` subtree_end
    is null.
    """
    row = "struct<preorder: int, parent_preorder: int, depth: int, node_type: string, title: string, content: string>"
    open_ = "struct<level: int, at: int>"
    rank = lambda level, of: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), level)
    start = {"count": F.lit(1), "pending": F.lit(False), "stack": F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("at")).cast(open_))}
    made = F.transform(events, lambda e: F.struct(e["kind"].alias("kind"), e["level"].alias("level"), event_nodes(e).alias("nodes")))

    def at(preorder: Column, parent: Column, depth: Column, n: Column) -> Column:
        fields = {"preorder": preorder, "parent_preorder": parent, "depth": depth, "node_type": n["node_type"], "title": n["title"], "content": n["content"]}
        return F.struct(*(v.alias(f) for f, v in fields.items())).cast(row)

    def pad(s: Column) -> Column:
        return F.array(at(s["count"], F.element_at(s["stack"], -1)["at"], F.size(s["stack"]), _node(F.lit("sentence"), F.lit(""))))

    def step(s: Column, e: Column) -> Column:
        def placed(base: Column, stack: Column) -> Column:
            parent, depth = F.element_at(stack, -1)["at"], F.size(stack)
            return F.transform(e["nodes"], lambda n, i: at(base + i, F.when(n["inner"], base).otherwise(parent), depth + n["inner"].cast("int"), n))

        def headed(stack: Column) -> Column:
            padded = s["pending"] & (F.element_at(s["stack"], -1)["at"] != F.element_at(stack, -1)["at"])
            base = s["count"] + padded.cast("int")
            mine = F.array_append(stack, F.struct(rank(e["level"], LEVELS).alias("level"), base.alias("at")).cast(open_))
            bare = (F.size(e["nodes"]) == 1) & e["level"].isin(*PADDED)
            return F.struct((base + F.size(e["nodes"])).alias("count"), bare.alias("pending"), mine.alias("stack"), F.concat(F.when(padded, pad(s)).otherwise(empty(row)), placed(base, stack)).alias("emit"))

        above = F.filter(s["stack"], lambda o: o["level"] < rank(e["level"], LEVELS)) if level_aware else F.slice(s["stack"], F.lit(1), rank(e["level"], DEPTHS))
        plain = F.struct((s["count"] + F.size(e["nodes"])).alias("count"), (s["pending"] & (F.size(e["nodes"]) == 0)).alias("pending"), s["stack"].alias("stack"), placed(s["count"], s["stack"]).alias("emit"))
        return F.when(e["kind"] == "heading", let(above, headed)).otherwise(plain)

    def with_ends(rows: Column) -> Column:
        """Each with the place behind the last node below it, from the last one up."""
        whole = f"struct<subtree_end: int, node: {row}>"

        def back(s: Column, r: Column) -> Column:
            nexts = F.transform(s["nexts"], lambda v, d: F.when(d >= r["depth"], r["preorder"]).otherwise(v))
            return F.struct(nexts.alias("nexts"), F.array(F.struct(F.get(s["nexts"], r["depth"]).alias("subtree_end"), r.alias("node")).cast(whole)).alias("emit"))

        if not ends:
            return F.transform(rows, lambda r: F.struct(none("int").alias("subtree_end"), r.alias("node")).cast(whole))
        return F.reverse(fold(F.reverse(rows), {"nexts": F.array_repeat(F.size(rows), MOST_LEVELS)}, whole, back))

    root = at(F.lit(0), none("int"), F.lit(0), _node(F.lit("document"), title=title))
    last = lambda s: F.when(s["pending"], pad(s)).otherwise(empty(row))
    whole = lambda m: F.when(~F.exists(m, lambda e: e["nodes"].isNull()), let(F.concat(F.array(root), fold(m, start, row, step, last)), with_ends))
    return let(made, whole)
