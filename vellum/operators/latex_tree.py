"""Document trees of LaTeX and harvmac sources: one version's files in, a table of nodes out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.functions import latex
from vellum.functions import tex as tex_rules
from vellum.functions.rules import HARVMAC_SENTENCE, HARVMAC_TEXT, HARVMAC_TITLE, NO_ABSTRACT, applied
from vellum.operators.latex_nodes import Node, node_rows, pad_headings
from vellum.operators.latex_parser import LatexParser

ROWS = "pub_id string, version string, preorder int, parent_preorder int, depth int, subtree_end int, node_type string, title string, label string, content string, error string"
#: Rows of a batch that is handed back, about, and files that a task reads, about.
BATCH, TASK_FILES = 4096, 4096


def _group(text: str, at: int) -> tuple[str, int]:
    """The brace group that begins at or behind `at` (white space aside), and where it ends; nothing if there is none."""
    while text[at : at + 1].isspace():
        at += 1
    end = latex.balanced(text, at)
    return ("", at) if end is None else (text[at + 1 : end], end + 1)


def _prose(text: str) -> str:
    return applied(text, HARVMAC_TEXT).strip()


def parse_harvmac(tex: str) -> Node:
    """\\Title, \\newsec, \\appendix, \\subsec; equations by $$ and \\eqn, figures by \\ifig and \\iifig. No comments in `tex`."""
    tex = re.sub(r"\\lref\s*\\\w+\s*(?:\{[^{}]*\})?", "", tex)
    head = re.search(r"\\Title\s*(?=\{)", tex)
    if not head:
        raise ValueError("no Title")
    _, at = _group(tex, head.end())
    title, at = _group(tex, at)
    root = Node("document", title=applied(_prose(title), HARVMAC_TITLE).strip())
    body = re.split(r"\\bye\b", tex[at:])[0]
    marks = list(re.finditer(r"\\(newsec|appendix)(?![A-Za-z])", body))
    before = body[: marks[0].start()] if marks else body
    if opening := _prose(re.sub(r"\\Date\s*\{[^}]*\}", "", before)):
        abstract = root.add("section", title="Abstract")
        for s in latex.sentences(opening):
            if not any(mark in s for mark in NO_ABSTRACT) and ("{" in s) == ("}" in s):
                abstract.add("sentence", content=re.sub(r"\s{2,}", " ", s).replace("\n", " "))
    for mark, nxt in zip(marks, [*marks, None][1:], strict=True):
        name, at = _group(body, mark.end())
        if mark[1] == "appendix":
            name, at = _group(body, at)
        _harvmac_section(root.add("section", title=_prose(name)), body[at : nxt.start() if nxt else len(body)])
    pad_headings(root)
    return root


def _harvmac_section(section: Node, text: str) -> None:
    marks = list(re.finditer(r"\\subsec(?![A-Za-z])", text))
    _harvmac_content(section, text[: marks[0].start()] if marks else text)
    for mark, nxt in zip(marks, [*marks, None][1:], strict=True):
        name, at = _group(text, mark.end())
        _harvmac_content(section.add("subsection", title=_prose(name)), text[at : nxt.start() if nxt else len(text)])


def _harvmac_content(parent: Node, text: str) -> None:
    at = 0
    while m := re.compile(r"\$\$|\\eqn(?![A-Za-z])|\\i?ifig(?![A-Za-z])").search(text, at):
        _harvmac_sentences(parent, text[at : m.start()])
        if m[0] == "$$":
            end = text.find("$$", m.end())
            end = len(text) if end < 0 else end
            parent.add("math", content=f"$${text[m.end() : end]}$$")
            at = min(len(text), end + 2)
            continue
        label = re.compile(r"\s*\\?([A-Za-z0-9]*)").match(text, m.end())
        first, at = _group(text, label.end())
        if m[0] == "\\eqn":
            parent.add("math", label=label[1] or None, content=first.strip())
            continue
        second, at = _group(text, at)
        third = ""
        if m[0] == "\\iifig":
            third, at = _group(text, at)
        name = re.search(r"[\w./-]+\.(?:eps|ps|pdf|png|jpg)", " ".join((second, third)))
        parent.add("figure", label=label[1] or None, title=_prose(first), content=name[0] if name else _prose(f"{second} {third}"))
    _harvmac_sentences(parent, text[at:])


def _harvmac_sentences(parent: Node, text: str) -> None:
    for s in latex.sentences(_prose(text)):
        if s := applied(s, HARVMAC_SENTENCE).strip():
            parent.add("sentence", content=s)


def ready_versions(sources: DataFrame, resolved: DataFrame, fixed_headings: bool = False) -> DataFrame:
    """(pub_id, version, main_tex, harvmac, title, files): one row per version with all that the parser of lines reads.

    files is an array of (name, text), the main file first and then by name; comments, definitions and styles are gone and
    macros expanded. The macros are those of all files, later ones winning. harvmac is the main text without comments if
    harvmac is named in its first 1,024 letters, else null; then neither title nor texts are made ready.
    """
    c = F.col
    rows = _files_of(sources, resolved)
    main = F.get("all", F.lit(0))
    plain = F.contains(F.left(main["text"], F.lit(1024)), F.lit("harvmac"))
    rows = rows.withColumn("harvmac", F.when(plain, tex_rules.strip_comments(main["text"])))
    rows = rows.withColumn("macros", F.when(plain, F.array().cast(tex_rules.MACROS)).otherwise(tex_rules.macro_map(F.flatten(F.transform("all", lambda f: tex_rules.macros_of(f["text"]))))))
    rows = rows.select("*", F.explode(F.array(F.struct("macros"))).alias("m"))  # so that the macros are worked out once
    title = tex_rules.remove_styles(tex_rules.expand(tex_rules.find_title(main["text"]), c("m.macros")))
    texts = F.transform("all", lambda f: F.struct(f["name"].alias("name"), tex_rules.prepared(f["text"], c("m.macros"), fixed_headings).alias("text")))
    return rows.select("pub_id", "version", "main_tex", "harvmac", F.when(~plain, title).alias("title"), F.when(~plain, texts).alias("files"))


def _files_of(sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """(pub_id, version, main_tex, all): one row per version with its TeX files, the main one first and then by name."""
    c = F.col
    tex = sources.where(c("file_name").endswith(".tex")).join(resolved.where("main_tex is not null").select("pub_id", "version", "main_tex"), ["pub_id", "version"])
    one = F.struct((c("file_name") != c("main_tex")).alias("other"), c("file_name").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return tex.groupBy("pub_id", "version", "main_tex").agg(F.sort_array(F.collect_list(one)).alias("all"))


def parse_version(names: list[str], texts: list[str], main: str, level_aware: bool = False, fixed_headings: bool = False) -> list[tuple]:
    """`node_rows` of a version's files, the main one first. The macros are those of all files, later ones winning."""
    if "harvmac" in texts[0][:1024]:
        return node_rows(parse_harvmac(latex.strip_comments(texts[0])))
    clean = [latex.strip_comments(t) for t in texts]
    macros, title = latex.macro_map(clean), latex.find_title(clean[0])
    ready = {n: latex.prepared(t, macros, fixed_headings) for n, t in zip(names, texts, strict=True)}
    return node_rows(LatexParser(ready, main, title and latex.remove_styles(latex.expand(title, macros)), level_aware).parse())


def parse_versions(sources: DataFrame, resolved: DataFrame, level_aware: bool = False, fixed_headings: bool = False) -> DataFrame:
    """The nodes of every version. `sources` has (pub_id, version, file_name, text), `resolved` (pub_id, version, main_tex).

    The files of one version meet in one row (they are one document). A version that cannot be parsed gives one row with its
    error instead of nodes, so it is lost alone. The number of tasks follows from the number of files, as adaptive execution
    would go by their bytes, which are few.
    """

    def parsed(names: list[str], texts: list[str], main: str) -> list[tuple]:
        try:
            return [(*row, None) for row in parse_version(names, texts, main, level_aware, fixed_headings)]
        except Exception as e:  # noqa: BLE001  one version's trouble isn't the job's
            return [(*[None] * 8, f"{type(e).__name__}: {e}"[:500])]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = to_arrow_schema(types), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out), schema)], schema=schema)
        for found in batches:
            for at in range(found.num_rows):
                pub, version, main, names, texts = (column[at].as_py() for column in found.columns)
                out += [(pub, version, *row) for row in parsed(names, texts, main)]
                if len(out) >= BATCH:
                    yield batch()
                    out = []
        if out:
            yield batch()

    types = StructType.fromDDL(ROWS)
    files = _files_of(sources, resolved).select("pub_id", "version", "main_tex", F.transform("all", lambda f: f["name"]).alias("names"), F.transform("all", lambda f: f["text"]).alias("texts"))
    tasks = sources.count() // TASK_FILES + sources.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "pub_id", "version").mapInArrow(parse, types)
