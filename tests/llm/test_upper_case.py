from vellum.llm.classifier import measures, upper_case, words_of


def test_upper_case_letters_of_the_whole_text_count():
    for text in ("", "abc", "A", "xxxAxxxBxxx", "ÄÖü Ünïé \U0001d400 \u01c5 A", "\ud800 B Ä", "Ab\n" * 1000):
        assert upper_case(text) == sum(c.isupper() for c in text)
        assert measures(text, words_of(text))[3] == 5 * sum(c.isupper() for c in text) / max(1, len(text))
    for stride in range(7):  # wherever the letters stand
        assert measures("x" * stride + "A" + "x" * (6 - stride), ["w"])[3] == 5 / 7
