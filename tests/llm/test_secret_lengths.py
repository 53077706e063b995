import random
import time

import public_tokenizers
import pytest

from vellum.llm.secret_scan import candidates, coverage, default_forest, dictionary, find_secrets, redact

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [513, 2001, 30_000])
def test_long_secrets_go_whole(n):
    some = lambda: "".join(random.Random(n).choices(LETTERS, k=n))
    token = f"eyJ{some()}.{some()}.{some()}"
    for text, value in ((f"token: {token} end", token), (f"see {token} end", token), (f"secret={some()} end", some()), (f"x ghp_{some()} end", "ghp_" + some()), (f"x sk-{some()} end", "sk-" + some()), (f"x xoxb-{some()} end", "xoxb-" + some())):
        found = find_secrets(text, "src", default_forest(VOCABULARY), dictionary(VOCABULARY))
        assert [text[s:e] for s, e, _, score in found if score >= 0.5] == [value]
        assert redact(text, found).endswith("-SECRET] end") and len(redact(text, found)) < 40


def test_coverage_reads_the_whole_value():
    assert coverage("q" * 600 + "password" * 75, frozenset({"password"})) == 0.5


def test_runs_that_are_no_tokens_are_scanned_once():
    began = time.perf_counter()
    assert candidates("eyJaaaaaaaa_" * 200_000) == []
    assert candidates("eyJaaaaaaaa-" * 1000 + "password=a1b2c3d4 x") == [(12_009, 12_017, "value")]
    assert time.perf_counter() - began < 20
