import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from vellum.llm.packing import CAPACITY, OpenBins, cut, load, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_match_the_library(library):
    rng = random.Random(7)
    texts = ["", " ", "a", " a", "a ", "a\nb", "a\n\nb", "a  b", "a\t b", "it's DON'T 'll", "x\x1cy z", "a b c d", "<|endoftext|> x<|endoftext|>", "Ünï \U0001f600 中文 a", "y" * 5000, "é́ ﬁ​ z"]
    texts += ["".join(rng.choice("abcé'!1 \n　") for _ in range(rng.randrange(120))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(load(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:100]


def test_cut_leaves_full_pieces_behind_the_first():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_fills_well_and_bounds_its_space():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1025) for _ in range(20_000)]
    bins, used = OpenBins(1024, 64), {}
    for n in lengths:
        number, offset = bins.place(n)
        assert used.get(number, 0) == offset
        used[number] = offset + n
        assert bins.held <= 64
    assert max(used.values()) <= 1024 and len(used) <= 1.05 * sum(lengths) / 1024


def test_full_bins_close_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third is the fullest and isn't kept open
    assert bins.place(2) == (1, 7) and bins.place(4) == (0, 6)


def check(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        want = ids_of(library, texts[d])
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert [(r.piece, r.start, r.length) for r in pieces] == [(i, *p) for i, p in enumerate(cut(len(want), CAPACITY))]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(by_sequence), sum(r.length for r in rows)


def test_documents_round_trip(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sequences, tokens = check(pack_documents(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    assert sequences <= math.ceil(tokens / CAPACITY) * 1.05


def test_odd_rows(spark, odd, library):
    rows = pack_documents(odd, PATH).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, r.text)) for r in odd.collect())
    assert pack_documents(odd.limit(0), PATH).count() == 0
