import hashlib
import random

from tests.conftest import SMALL
from vellum.llm.chat import CONTROLS, best_paths, escape, format_conversations, format_turns, parse_turns, read_back, reply_trees, unescape
from vellum.llm.queries import op10_reply_trees


def test_escapes_are_undone_and_hide_control_strings():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice([*CONTROLS, "!", "<", "[", "|im_end|>", "INST]", "s>", "\n", "\\", "\\n", "x"]) for _ in range(rng.randrange(8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROLS)
        turns = [("user", text), (text, "assistant"), ("assistant", text)]
        formatted, spans = format_turns(turns)
        assert parse_turns(formatted) == turns
        assert "".join(unescape(formatted[a:b]) for a, b in spans) == text + ("assistant" if text == "assistant" else "")


def brute(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        yield c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_match_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    probe = "</s>[INST] ok [/INST]"
    rows = [*rows, spark.createDataFrame([(-7, 0, "user", probe)], "conv_id long, turn long, role string, text string").first(), spark.createDataFrame([(-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string").first()]
    got = {tuple(r)[:5] for r in op10_reply_trees(spark, SMALL).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == set(brute(rows))


def test_odd_rows_and_long_threads(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 5, "assistant", ""), *((3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300))]
    frame = spark.createDataFrame([(*r, "n", 1.5, 7) for r in rows], "conv_id long, turn long, role string, text string, node string, score double, parent int")
    got = {tuple(r)[:5] for r in read_back(format_conversations(reply_trees(frame))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == set(brute(frame.collect()))
    assert read_back(format_conversations(reply_trees(frame.limit(0)))).count() == 0


def test_best_branches_of_random_trees(spark):
    rng, rows = random.Random(6), []
    for tree in range(12):
        for node in range(1, rng.randrange(2, 40)):
            rows.append((tree, node, rng.randrange(1, node) if node > 1 else None, float(rng.randrange(5))))
    rows += [(99, 1, 2, 1.0), (99, 2, 1, 1.0)]  # a cycle
    frame = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    want = set()
    for tree in range(12):
        up = {n: p for t, n, p, _ in rows if t == tree}
        score = {n: s for t, n, _, s in rows if t == tree}
        paths = []
        for leaf in up.keys() - set(up.values()):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = up[at]
            paths.append((-sum(score[n] for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want |= {(tree, leaf, rank, n, d) for d, n in enumerate(path)}
    assert {tuple(r) for r in best_paths(frame, 2).collect()} == want
