import random

import pytest
from pyspark.sql import functions as F

from tests.unit import plain_latex
from tests.unit.plain_parser import LatexParser

from vellum.functions import latex
from vellum.functions import similarity as S
from vellum.functions import tex as X
from vellum.functions import text as T
from vellum.operators import latex_tree
from vellum.operators.latex_tree import node_rows
from vellum.sources import files
from vellum.sources.bibtex import item_fields, parse_entries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_rules(spark):
    assert one(spark, T.sentences(F.lit("See Fig. 2 now. Then e.g. this! Ok? A"))) == ["See Fig. 2 now.", "Then e.g. this!", "Ok?"] == latex.sentences("See Fig. 2 now. Then e.g. this! Ok? A")
    assert one(spark, T.sentences(F.lit("By J. Smith now."))) == ["By J.", "Smith now."]
    for tex, want in (("a % b\n", "a \n"), ("% x\n", ""), ("50\\% of\n", "50\\% of\n\n"), ("a\\\\% c\n", "a\\\n")):
        assert one(spark, T.strip_comments(F.lit(tex))) == want == plain_latex.strip_comments(tex)
    assert one(spark, T.includes(F.lit("\\input{a} \\include b.tex % \\input{c}\n\\includegraphics{d}"))) == ["a.tex", "b.tex"]
    assert one(spark, T.clean_formatting(F.lit("\\centering a~b\\\\ [ht] \\citep{x} c\\label{l}"))) == "a b c\\label{l}"
    assert one(spark, T.year_of(F.lit("x1999 in 2004, 2005"))) == "2004" and one(spark, T.year_of(F.lit("none"))) is None
    assert one(spark, T.short_names(F.lit("Smith, John and Ludwig van der Berg and Plato and {Knuth}, D. E."))) == ["smith j", "van der berg l", "p", "knuth d"]
    assert one(spark, T.first_author_last(F.array(F.lit("van der berg j")))) == "van"
    assert one(spark, T.normalized(F.lit("The \\emph{Deep} studies of {Neural} Networks: é"))) == "deep study neural network"
    assert one(spark, T.normalized(F.lit("Analyses of matrices by women, wives and mice: indices, classes, theories"))) == "analysis matrix woman wife mouse index class theory"
    assert one(spark, T.semantic_base(F.lit("Agrawal, P."), F.lit("2017"), F.lit("Make dark matter"))) == "Agrawal_2017_MakeDark"
    assert [one(spark, T.semantic_suffix(F.lit(n))) for n in (0, 1, 25, 26, 27)] == ["", "_a", "_y", "_123", "_124"]
    assert one(spark, T.reference_quality(F.lit("d"), F.lit("2001"), F.lit("a"), F.lit("t"))) == 10
    assert one(spark, T.dedup_key(F.lit("A Été"), F.lit("X, Y and Z"), F.lit("1999"))) == "aété_x_1999"


def test_similarities(spark):
    names = lambda *n: F.array(*map(F.lit, n))
    assert one(spark, S.author_overlap(names("smith john", "doe jane"), names("smith john", "brown bob"))) == pytest.approx(2 / 3)
    score = S.match_score(F.lit("deep learning neural networks"), F.lit("deep learning for neural networks"), names("smith john", "doe jane"), names("smith john", "brown bob"), F.lit("2020"), F.lit("2020"))
    assert one(spark, score) == pytest.approx(0.8575, abs=1e-4)
    assert [one(spark, S.year_score(F.lit(a), F.lit(b))) for a, b in (("2023", "2023"), ("2023", "2024"), ("2023", "2025"), (None, "2023"), ("x", "2023"))] == [1.0, 0.5, 0.0, 0.0, 0.0]


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def plain_greedy(left, right, least):
    used, reached = set(), []
    for x in left:
        best, at = least, None
        for i, y in enumerate(right):
            if i not in used and plain_ratio(x, y) > best:
                best, at = plain_ratio(x, y), i
        if at is not None:
            used.add(at)
            reached.append(best)
    return reached


def test_indel_ratio_matches_a_plain_longest_common_subsequence(spark):
    draw = random.Random(7)
    word = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    rows = [(word(draw.randrange(12), "abc"), word(draw.randrange(12), "abcé😀")) for _ in range(60)]
    rows += [(word(n, "abcd"), word(m, "abcd")) for n in (59, 60, 61, 119, 120, 121, 200) for m in (1, 60, 150)] + [("", ""), ("", "a"), ("a" * 130, "a" * 129), (None, "a"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(plain_ratio(r.a or "", r.b or "")), r


def test_greedy_scores_match_a_plain_assignment(spark):
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcdefgh"[:n]) for _ in range(draw.randrange(1, 9)))
    rows = []
    for _ in range(80):
        words = [word(3) + draw.choice(("", "tion", "ology")) for _ in range(6)]
        left, right = draw.choices(words, k=draw.randrange(5)), draw.choices([*words, *(w + "s" for w in words)], k=draw.randrange(5))
        rows.append((" ".join(left), "  ".join(right), [[w, "x"] for w in left], [[w] for w in right]))
    rows += [(None, "a", None, [["a"]]), ("", "", [], []), ("a b c", "a b d", [["a", "b"]], [["a", "b"], ["c"]]), ("q" * 70 + " b", "q" * 69 + " b", [["q" * 70]], [["q" * 69], []])]
    frame = spark.createDataFrame(rows, "a string, b string, x array<array<string>>, y array<array<string>>")
    plan = frame.select(S.soft_jaccard(F.col("a"), F.col("b")).alias("t"), S.author_ratio(F.col("x"), F.col("y")).alias("n"))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
    for r in frame.select("*", S.soft_jaccard(F.col("a"), F.col("b")).alias("t"), S.author_ratio(F.col("x"), F.col("y")).alias("n")).collect():
        left, right = (r.a or "").split(), (r.b or "").split()
        n = len(plain_greedy(left, right, 0.8))
        assert r.t == pytest.approx(n / (len(left) + len(right) - n) if left and right else 0.0), r
        mine, theirs = ([" ".join(t) for t in side or []] for side in (r.x, r.y))
        assert r.n == pytest.approx(sum(plain_greedy(mine, theirs, -1)) / len(mine) if mine and theirs else 0.0), r


def test_latex_rules(spark):
    assert [one(spark, X.closing(F.lit(t))) for t in ("{a{b}\\}}", "{a", "a", "")] == [7, None, None, None]
    assert one(spark, X.find_title(F.lit("\\title[s]{A {b}\\\\ c}"))) == "A {b} c" and one(spark, X.find_title(F.lit("\\titlefoo{x}"))) is None
    macros = X.macro_map(X.macros_of(F.lit("\\newcommand{\\a}{X\\b}\\def\\b{Y}\\newcommand{\\c}[1]{no}")))
    assert [tuple(m) for m in one(spark, macros)] == [("\\a", "XY"), ("\\b", "Y")] and one(spark, X.expand(F.lit("\\a \\ab \\b"), macros)) == "XY \\ab Y"
    assert one(spark, X.remove_styles(F.lit("\\textbf{a \\emph{b}} \\bfseries c \\other{d}"))) == "a b c \\other{d}"
    assert one(spark, X.reflow_headings(F.lit("\\section{a\nb} \\paragraph{open"))) == "\\section{a b} \\paragraph{open"
    files_ = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, i)).cast("array<string>").alias("includes")) for n, i in (("m.tex", ["a.tex", "x/b.tex", "none.tex", "./c.tex"]), ("a.tex", ["m.tex", "c.tex"]), ("b.tex", []), ("c.tex", ["b.tex"]))))
    assert one(spark, X.include_order(files_, F.lit("m.tex"))) == ["m.tex", "a.tex", "c.tex", "b.tex"]


def test_latex_rules_match_plain_ones(spark):
    draw = random.Random(11)
    pieces = ["\\textbf", "\\emph", "\\bfseries", "\\mathrm", "{", "}", "{", "}", " ", "a", "b c", "\\{", "\\\\", "\n", "% x", "\\%", "\\newcommand", "{\\foo}", "\\def", "\\foo", "\\ba", "\\gdef\\ba", "[0]", "[1]", "\\title", "[s]", "\\section", "\\section*{", "\\noindent", "\\if", "\\fi", "$1"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(400)]
    texts += ["\\def\\ba{x{\\def\\foo{y$1\\\\z}}}\\title {\\foo}", "\\textbf{" * 20 + "x" + "}" * 20, "\\te\\emph{xtbf}{x}", "\\emph{\\textbf}{x}", "\\emph{\\bfseries} \\foo"]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.closing(c).alias("closing"), X.find_title(c).alias("title"), X.macros_of(c).alias("macros"), X.macro_map(X.macros_of(c)).alias("map"), X.remove_styles(c).alias("styles"), X.reflow_headings(c).alias("reflowed"),
        X.expand(c, X.macro_map(X.macros_of(c))).alias("expanded"), X.prepared(c, X.macro_map(X.macros_of(c)), True).alias("prepared"),
    )
    for r in rows.collect():
        macros = plain_latex.zero_argument_macros(r.t)
        assert {m.name: m.body for m in r.macros} == macros, r.t
        assert r.closing == plain_latex.balanced(r.t, 0) and r.title == plain_latex.find_title(r.t), r.t
        assert {m.name: m.body for m in r.map} == plain_latex.macro_map([r.t]), r.t
        assert r.styles == plain_latex.remove_styles(r.t) and r.reflowed == plain_latex.reflow_headings(r.t, True), r.t
        assert r.expanded == plain_latex.expand(r.t, plain_latex.macro_map([r.t])), r.t
        assert r.prepared.splitlines() == plain_latex.prepared_lines(r.t, plain_latex.macro_map([r.t]), True), r.t


def test_include_orders_match_plain_ones(spark):
    draw, rows = random.Random(12), []
    for k in range(60):
        names = [f"f{i}.tex" for i in range(draw.randrange(1, 7))]
        rows.append((k, [(n, [draw.choice([*names, "x/" + names[0], "./" + names[-1], "none.tex"]) for _ in range(draw.randrange(4))]) for n in names]))
    frame = spark.createDataFrame(rows, "k int, files array<struct<name: string, includes: array<string>>>")
    for r in frame.select("files", X.include_order(F.col("files"), F.lit("f0.tex")).alias("order")).collect():
        order, todo, known = [], ["f0.tex"], {f.name: f.includes for f in r.files}
        while todo:
            name = todo.pop().removeprefix("./")
            name = name if name in known else name.rsplit("/", 1)[-1]
            if name in known and name not in order:
                order.append(name)
                todo += reversed(known[name])
        assert r.order == order


def _parsed(spark, versions, **settings):
    """The rows of versions ({file: text}, main), and what the plain machine makes of the same texts made ready."""
    sources = spark.createDataFrame([("p", f"v{k:03d}", n, t) for k, (texts, _) in enumerate(versions) for n, t in texts.items()], "pub_id string, version string, file_name string, text string")
    mains = spark.createDataFrame([("p", f"v{k:03d}", m) for k, (_, m) in enumerate(versions)], "pub_id string, version string, main_tex string")
    got, want = {}, {}
    for r in latex_tree.parse_versions(sources, mains, **settings).collect():
        got.setdefault(r.version, []).append(tuple(r)[2:-1] if r.error is None else "error")
    for r in latex_tree.ready_versions(sources, mains, settings.get("fixed_headings", False)).collect():
        try:
            want[r.version] = node_rows(LatexParser({f.name: f.text for f in r.files}, r.main_tex, r.title, settings.get("level_aware", False)).parse())
        except ValueError:
            want[r.version] = ["error"]
    return got, want


def test_headings_by_length_and_by_level(spark):
    tex = "\\begin{document}\n" + "\n".join(f"\\section{{S{i}}}" for i in range(6)) + "\n\\end{document}"
    parents = lambda rows: [rows[r[1]][5] for r in rows if r[4] == "section"]
    for aware, want in ((False, [None, "S0", "S1", "S1", "S1", "S1"]), (True, [None] * 6)):
        got, plain = _parsed(spark, [({"m.tex": tex}, "m.tex")], level_aware=aware)
        assert got == plain and parents(got["v000"]) == want


@pytest.mark.parametrize("level_aware", [False, True])
def test_folds_over_lines_match_a_plain_machine(spark, level_aware):
    draw = random.Random(21 + level_aware)
    lines = [
        "", "", "Words here. More of it", "a", "See Fig. 2 now.", "\\section{One} Trailing. Text.", "\\subsection*[x[y]]{Two {b}}", "\\paragraph{P}", "\\part{X}", "\\chapter{C}", "\\subsubsection{T}", "\\appendix{A}", "\\section{open", "\\input{a}", "\\include{x/b.tex} tail",
        "\\input{c}\\input{none}", "\\begin{itemize}", "\\item one. two", "\\item $$x$$ behind", "more $$", "\\end{itemize}", "\\end{itemize} after", "\\begin{enumerate} \\item x \\end{enumerate}", "\\begin{enumerate}", "\\end{enumerate}", "\\begin{lstlisting}", "\\end{lstlisting}", "$$", "a $$ b",
        "$$a=b$$ rest. Of it.", "$$a$$ and $$b$$", "\\[", "\\] end. Here", "\\[ x \\] y.", "in \\[ z", "\\begin{equation} q", "\\end{equation} r.", "\\begin{align*}", "\\end{align*}", "\\begin{gather}x\\end{gather}", "\\begin{figure}[h]", "\\end{figure}", "\\begin{table*}x\\end{table*}", "\\begin{table}", "\\end{table}", "\\end{document}",
    ]
    text = lambda n: "\n".join(draw.choice(lines) for _ in range(draw.randrange(n)))
    versions = [({"m.tex": "\\title{On it}\n\\begin{document}\n" + text(60), "a.tex": text(12), "b.tex": text(8), "c.tex": text(8), "d.tex": text(5)}, "m.tex") for _ in range(150)]
    versions += [({"m.tex": "\\begin{document}\n" + "\n".join(f"Line {i}." for i in range(n)), "z.tex": "\\subsection{Last}"}, "m.tex") for n in (49, 50, 51, 120, 700)] + [({"m.tex": ""}, "m.tex"), ({"m.tex": "\\begin{document}"}, "m.tex")]
    got, want = _parsed(spark, versions, level_aware=level_aware)
    assert got.keys() == want.keys()
    for v in want:
        assert got[v] == want[v], (v, versions[int(v[1:])][0])
    assert sum(w != ["error"] for w in want.values()) > 60 and any(w == ["error"] for w in want.values())


def test_bibliography_entries():
    found = parse_entries('@article{k,\n Title = {A {b}\n c}, year=1999, note = "x, y", type = {T}, z = raw}\n@book{nocomma}\n@misc{m, year={2001}}')
    assert [(e["type"], e["key"]) for e in found] == [("T", "k"), ("misc", "m")]
    assert {f["name"]: f["value"] for f in found[0]["fields"]} == {"title": "A {b} c", "year": "1999", "note": "x, y", "z": "raw"}
    item = item_fields("J. Smith, \\textit{Deep nets}, Nature 12 (2019), pp. 10-20.")
    assert (item["author"], item["title"], item["year"], item["pages"], item["type"]) == ("J. Smith", "Deep nets", "2019", "10--20", "article")
    plain = item_fields("P. Agrawal, Dark matter, Springer 2017")
    assert (plain["author"], plain["title"], plain["publisher"], plain["type"]) == ("P. Agrawal", "Dark matter", "Springer", "misc")


def test_manual_labels_are_read_by_their_files(spark, tmp_path):
    (tmp_path / "0001-00001.json").write_text('[{"label": 1, "score": 0.5, "bib_key": "k", "arxiv_id": "2301.1"}, {"label": "", "bib_key": "k", "arxiv_id": "2301.2"}]')
    (tmp_path / "0001-00002.json").write_text('[{"label": "0", "bib_key": "j", "arxiv_id": "2301.3"}]')
    got = {(r.pub_id, r.bib_key, r.arxiv_id, r.label) for r in files.manual_labels(spark, str(tmp_path)).collect()}
    assert got == {("0001-00001", "k", "2301.1", 1), ("0001-00001", "k", "2301.2", None), ("0001-00002", "j", "2301.3", 0)}


def test_harvmac_dates_and_blocks():
    tex = "\\input harvmac\n\\Title{X}{\\vbox{\\centerline{On it}}}\nFirst words.\n\\Date{1/99}\n\\newsec{One}\nText here. \\eqn\\ea{x=1} More text.\n\\ifig\\fa{A caption.}{\\epsfbox{plot.eps}}\n\\appendix{A}{Extra}\nLast words.\n\\bye gone."
    rows = [(n.node_type, n.title, n.label, n.content) for *_, n in _walk(latex_tree.parse_harvmac(tex))]
    assert rows[0][:2] == ("document", "On it") and not any("1/99" in (r[3] or "") or "gone" in (r[3] or "") for r in rows)
    assert ("sentence", None, None, "First words.") in rows and ("math", None, "ea", "x=1") in rows and ("figure", "A caption.", "fa", "plot.eps") in rows
    assert [r[1] for r in rows if r[0] == "section"] == ["Abstract", "One", "Extra"]


def _walk(node):
    yield (node,)
    for child in node.children:
        yield from _walk(child)
