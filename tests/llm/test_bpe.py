import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from vellum.llm.bpe import SHORT_WORD, encode_documents, load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def same(library, text):
    ids, decoded = load(PATH).round_trip(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:200]
    assert decoded == library.decode(want, skip_special_tokens=False) == load(PATH).decode(ids)


def test_texts_match_the_library(library):
    for text in ("", " ", "Hello World's it'll", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "ΟΔΥΣΣΕΥΣ ΣΑΣ. İstanbul ǅ", "x\x1cy\x1f z\x85w v u​",
                 "é Å ﬁ Ⅷ ² ½ ٣ 12345", "\U0001f600\U0001f468‍\U0001f469", "x" * 3000, "anthropology" * 300, "don't 'S 'RE ''ve!!! --'d", "\u0000﻿�"):
        same(library, text)


def test_random_texts_match_the_library(library):
    rng = random.Random(5)
    letters = "abcdeéñßüAEO'’ .,!?\n\t-0123456789中文字עΣς"
    for _ in range(400):
        same(library, "".join(rng.choice(letters) for _ in range(rng.randrange(200))))
    for n in range(SHORT_WORD - 3, SHORT_WORD + 4):
        same(library, "".join(rng.choice("etaoin") for _ in range(n)))


def test_documents_match_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = encode_documents(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_odd_rows(spark, odd):
    got = encode_documents(odd, PATH).collect()
    assert len(got) == odd.count()
    assert [(r.ids, r.decoded) for r in got if r.doc_id in (3, 4)] == [(b"", "")] * 2
    assert encode_documents(odd.limit(0), PATH).count() == 0
