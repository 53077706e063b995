import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import ranking
from vellum.operators.boosting import Booster
from vellum.plans.pipelines import documents, export, labelled_pairs, ranked
from vellum.sources import files, sinks

V1 = r"""\documentclass{article}
\title{A \textbf{Great} Title}
\newcommand{\foo}{FOO}
\begin{document}
See Fig. 2 about \foo. It is new. % gone
\section{One} Trailing text.
\begin{itemize}
\item first thing. second thing
\end{itemize}
\input{parts/inner}
\begin{figure}
\includegraphics{x.png} \label{f}
\end{figure}
\section{Two}
Last words here.
\end{document}
"""
BIB = "".join(f"@article{{k{i},\n  title = {{{t}}},\n  author = {{{a}}},\n  year = {y}\n}}\n\n" for i, (t, a, y) in enumerate([
    ("Deep learning of neural networks", "Smith, John and Doe, Jane", 2019), ("Quantum gravity and black holes", "Alice Brown", 2018), ("Deep learning of neural networks", "Smith, John", 2019),
    ("Dark matter in galaxies", "Agrawal, P.", 2017), ("Graph theory today", "von Neumann, J.", 2001), ("Make dark matter", "Agrawal, P.", 2017),
]))


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    known = {f"1901.0000{i}": {"paper_title": t, "authors": a, "submission_date": d} for i, (t, a, d) in enumerate([("Deep learning of neural networks", ["John Smith", "Jane Doe"], "2019-01-02"), ("Dark matter in galaxies", ["P. Agrawal"], "2017-05-05"), ("Other things", ["X. Y. Zed"], "1999-01-01")])}
    for pub in ("0001-00001", "0001-00002", "0001-00003"):
        write(root, f"{pub}/metadata.json", "{}")
        write(root, f"{pub}/references.json", json.dumps(known))
    for v, text in (("v1", V1), ("v2", V1.replace("It is new.", "It is newer."))):
        write(root, f"0001-00001/tex/0001-00001{v}/main.tex", text)
        write(root, f"0001-00001/tex/0001-00001{v}/inner.tex", "Inner text. More of it.\n\\subsection{Empty}\n")
        write(root, f"0001-00001/tex/0001-00001{v}/refs.bib", BIB)
    write(root, "0001-00002/tex/0001-00002v1/a.tex", "\\documentclass{x}\n\\begin{document}\n\\begin{itemize}\nno items\n\\end{itemize}\n\\end{document}")
    write(root, "0001-00002/tex/0001-00002v1/b.bbl", "\\bibitem[A]{one} J. Smith, \\textit{Deep learning of neural networks}, Nature 2019, pp. 10-20\n\\bibitem{two} P. Agrawal, Dark matter, Springer 2017\n\\end{thebibliography}")
    harvmac = "\\input harvmac\n\\Title{x}{\\centerline{My Title}}\nSome abstract.\n\\newsec{Intro}\nText one. $$a=b$$ And two.\n\\bye"
    for v in ("v1", "v2"):
        write(root, f"0001-00003/tex/0001-00003{v}/p.tex", harvmac)
    write(root, "0002-00001/metadata.json", "{}")
    for name in ("metadata", "references"):
        write(root, f"0002-00002/{name}.json", "{}")
    return str(root)


def test_folders_to_publications(spark, corpus, tmp_path):
    made = documents(spark, corpus)
    assert {r.pub_id: (r.status, r.versions) for r in made.scan.collect()} == {
        "0001-00001": ("READY", ["0001-00001v1", "0001-00001v2"]), "0001-00002": ("READY", ["0001-00002v1"]), "0001-00003": ("READY", ["0001-00003v1", "0001-00003v2"]), "0002-00001": ("INVALID", []), "0002-00002": ("NO_TEX", []),
    }
    main = {(r.version): (r.main_tex, r.used_tex_files, r.status, r.bib_files) for r in made.resolved.collect()}
    assert main["0001-00001v1"] == ("main.tex", ["main.tex", "inner.tex"], "RESOLVED", ["refs.bib"])
    assert [r.version for r in made.errors.collect()] == ["0001-00002v1"]
    pubs = {r.pub_id: json.loads(r.json) for r in made.publications.collect()}
    first = pubs["0001-00001"]
    elements, trees = first["elements"], first["hierarchy"]
    assert elements["0001-00001v1_000000"] == "A Great Title" and trees["0001-00001v1"]["0001-00001v1_000000"] is None
    texts = [e if isinstance(e, str) else e.get("content") for e in elements.values()]
    assert texts.count("It is new.") == 1 and texts.count("It is newer.") == 1 and texts.count("See Fig. 2 about FOO.") == 1 and texts.count("Last words here.") == 1
    assert set(trees["0001-00001v2"]) == {i for i in elements if i.startswith("0001-00001v2")} and len(trees["0001-00001v2"]) < len(trees["0001-00001v1"])
    # a version whose root is the same keeps its own ids
    assert len(pubs["0001-00003"]["hierarchy"]["0001-00003v2"]) == len(pubs["0001-00003"]["hierarchy"]["0001-00003v1"]) == 7
    sinks.write_texts(made.publications, str(tmp_path / "out"), "json")
    assert spark.read.text(str(tmp_path / "out")).count() == len(pubs)
    export(spark, corpus, str(tmp_path / "files"), made, labelled_pairs(spark, corpus))
    assert {str(p.relative_to(tmp_path / "files")) for p in (tmp_path / "files").rglob("*") if p.is_file()} == {
        "0001-00001/0001-00001.json", "0001-00003/0001-00003.json", "0001-00001/refs.bib", "0001-00002/refs.bib", "0002-00001/metadata.json",
        *(f"{p}/{n}.json" for p in ("0001-00001", "0001-00002", "0001-00003", "0002-00002") for n in ("metadata", "references")),
    }
    assert json.loads((tmp_path / "files/0001-00001/0001-00001.json").read_text()) == first and (tmp_path / "files/0001-00001/refs.bib").read_text().startswith("@article{k0,")


def test_only_changed_versions_are_parsed(spark, tmp_path):
    from vellum.sources.cache import through_cache

    seen = []

    def work(rows):
        seen.append(sorted((r.pub_id, r.version) for r in rows.select("pub_id", "version").distinct().collect()))
        return rows.groupBy("pub_id", "version").agg(F.sum(F.length("text")).alias("size"))

    rows = [("p", "v1", "a.tex", "x"), ("p", "v1", "b.tex", "yy"), ("p", "v2", "a.tex", "x"), ("q", "v1", "a.tex", None)]
    names, place = "pub_id string, version string, file_name string, text string", str(tmp_path / "cache")
    run = lambda rows, settings="": sorted(tuple(r) for r in through_cache(spark.createDataFrame(rows, names), place, work, settings).collect())
    assert run(rows[:0]) == [] and run(rows) == [("p", "v1", 3), ("p", "v2", 1), ("q", "v1", None)]
    assert run(rows[::-1]) == [("p", "v1", 3), ("p", "v2", 1), ("q", "v1", None)]
    changed = [*rows[:1], ("p", "v1", "b.tex", "yyyy"), *rows[2:3], ("r", "v1", "a.tex", "z")]
    assert run(changed) == [("p", "v1", 5), ("p", "v2", 1), ("r", "v1", 1)]
    assert run(rows) == [("p", "v1", 3), ("p", "v2", 1), ("q", "v1", None)]
    assert [s for s in seen if s] == [[("p", "v1"), ("p", "v2"), ("q", "v1")], [("p", "v1"), ("r", "v1")]]
    run(rows[:1], "other settings")
    assert seen[-1] == [("p", "v1")]


def test_cached_publications_are_the_same(spark, corpus, tmp_path):
    plain, place = documents(spark, corpus).publications.collect(), str(tmp_path / "cache")
    for _ in range(2):
        assert sorted(documents(spark, corpus, cache=place).publications.collect()) == sorted(plain)
    with pytest.raises(ValueError, match="no such folder"):
        documents(spark, corpus + "/missing")


def test_bibliographies_to_pairs(spark, corpus, tmp_path):
    made = labelled_pairs(spark, corpus)
    ids = {(r.version, r.key): r.ref_id for r in made.references.collect()}
    assert ids["0001-00001v1", "k0"] == "Smith_2019_DeepLearning" and ids["0001-00001v2", "k0"] == "Smith_2019_DeepLearning_a" and ("0001-00001v1", "k2") not in ids
    assert ids["0001-00001v1", "k5"] == "Agrawal_2017_MakeDark"
    text = {r.pub_id: r.bibtex for r in made.bibtex.collect()}["0001-00001"]
    assert text.startswith("@article{k0,\n  author={Smith, John and Doe, Jane},\n  title={Deep learning of neural networks},\n  year={2019},\n}\n\n")
    scores = {(r.pub_id, r.key, r.arxiv_id): r.score for r in made.scored.collect()}
    assert scores["0001-00001", "k0", "1901.00000"] == 1.0 and scores["0001-00001", "k0", "1901.00002"] < 0.5
    tasks = made.tasks.where("pub_id = '0001-00001' and bib_key = 'k3' and rank = 1").first()
    assert tasks.arxiv_id == "1901.00001"
    labels = spark.createDataFrame([("0001-00001", "k3", "1901.00001", 1, 1), ("0001-00001", "k9", "x", 1, 2)], "pub_id string, bib_key string, arxiv_id string, label int, ord long")
    both = labelled_pairs(spark, corpus, labels).labelled
    rows = both.collect()
    assert {(r.bib_key, r.candidate_arxiv_id, r.pair_type) for r in rows if r.source == "manual" and r.label} == {("k3", "1901.00001", "manual_verified")}
    auto = [r for r in rows if r.source == "automatic"]
    assert auto and all(sum(r.label for r in auto if (r.pub_id, r.bib_key) == k) == 1 for k in {(r.pub_id, r.bib_key) for r in auto})
    sinks.write_pairs(both.drop("cand_ord", "ord"), str(tmp_path / "pairs"))
    assert files.read_pairs(spark, str(tmp_path / "pairs")).count() == len(rows)
    sinks.write_tasks(made.tasks, str(tmp_path / "tasks"))
    assert spark.read.text(str(tmp_path / "tasks")).count() == 2


def test_pairs_to_ranks(spark, tmp_path):
    rng, rows = random.Random(1), []
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    for p in range(6):
        titles = [" ".join(rng.sample(words, 4)) for _ in range(20)]
        for b in range(8):
            for c, t in enumerate(titles):
                rows.append((f"p{p}", f"b{b}", f"c{c:02d}", titles[b], t, [f"n{b} x"], [f"n{c} x"], [[f"n{b}"]], [[f"n{c}"]], "2001", str(2001 + (b != c)), "manual" if p % 2 else "automatic", int(b == c)))
    names = "pub_id string, bib_key string, candidate_arxiv_id string, bib_title_clean string, candidate_title_clean string, bib_authors_clean array<string>, candidate_authors_clean array<string>, bib_author_tokens array<array<string>>, candidate_author_tokens array<array<string>>, bib_year string, candidate_year string, source string, label int"
    made = ranked(spark.createDataFrame(rows, names))
    assert {r.pub_id: r.partition for r in made.parts.collect()} == {"p0": "test", "p1": "test", "p2": "valid", "p3": "valid", "p4": "train", "p5": "train"}
    assert made.mrr == {"train": 1.0, "valid": 1.0, "test": 1.0} and made.overfitting == "none"
    out = json.loads(made.output.where("pub_id = 'p0'").first().json)
    assert out["partition"] == "test" and out["groundtruth"]["b3"] == "c03" and out["prediction"]["b3"][0] == "c03" and len(out["prediction"]["b3"]) == 5
    loaded = Booster.load(spark, made.ranker.save(spark, str(tmp_path / "model")))
    assert loaded == made.ranker and made.ranker.importance(spark).count() == 5


def test_reciprocal_ranks_and_negatives(spark):
    truth = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "pub_id string, bib_key string, arxiv_id string")
    found = spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "9", 1), ("p", "b", "2", 2)], "pub_id string, bib_key string, candidate_arxiv_id string, rank int")
    assert ranking.mean_reciprocal_rank(found, truth).first().mrr == 0.5 and ranking.mean_reciprocal_rank(found, truth.limit(0)).first().mrr == 0.0
    rows = spark.createDataFrame([("q", 1 if i == 0 else 0, i, [1.0, i / 40]) for i in range(41)] + [("r", 0, 100 + i, [1.0, 1.0]) for i in range(40)], "q string, label int, id int, v array<double>")
    kept = ranking.sample_negatives(rows, F.col("v"), "q", "label", "id").collect()
    assert sum(r.q == "q" for r in kept) == 16 and sum(r.q == "r" for r in kept) == 6
    assert set(range(1, 10)) <= {r.id for r in kept}
