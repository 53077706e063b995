import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.conftest import SMALL
from vellum.llm.classifier import classify_documents
from vellum.llm.packing import load
from vellum.llm.quality_rules import rate_documents
from vellum.llm.secret_scan import default_forest, dictionary, find_secrets, redact

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def least_of_components(texts):
    """By brute force: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 are linked."""
    sets, root = {}, {d: d for d in texts}
    for d, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in (b for b in texts if b < a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                high, low = max(find(a), find(b)), min(find(a), find(b))
                root[high] = low
    return sorted(d for d in texts if find(d) == d)


def test_every_stage_does_what_its_operator_finds(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_copies", "secret_scans", "packing"]
    before, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rate_documents(before).where("kept").collect()}
        if name == "quality_classifier":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in classify_documents(before, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()}
        if name == "near_copies":
            assert sorted(r.doc_id for r in after.collect()) == least_of_components({r.doc_id: r.text for r in before.collect()})
        if name == "secret_scans":
            texts = {r.doc_id: r for r in before.collect()}
            for r in after.collect():
                found = [f for f in find_secrets(texts[r.doc_id].text, texts[r.doc_id].source, default_forest(VOCABULARY), dictionary(VOCABULARY)) if f[3] >= 0.5]
                assert r.text == redact(texts[r.doc_id].text, found) and r.n_chars == len(r.text)
        if name != "packing":
            assert after.columns == docs.columns
        rows[name], before = after, after
    model = load(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {r.doc_id: len(np.frombuffer(model.encode(r.text), "<u4")) + 1 for r in rows["secret_scans"].collect()}
    got = {}
    for r in rows["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == wanted
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == wanted.keys()
