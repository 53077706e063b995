from vellum.llm import quality_rules
from vellum.llm.quality_rules import keep_good_documents, rate_documents


def test_the_bar_does_not_grow_with_the_host(spark, monkeypatch):
    """A line of 25 documents goes on a host of 1,500, where 2 % would be 30; one of 19 stays. All ways of joining agree."""
    rows = [(i, f"own{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(12)) + ("\nshared by a few" if i < 25 else "\nshared by fewer" if i < 44 else ""), "hot") for i in range(1500)]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")
    for total, host in ((quality_rules.BROADCAST_LINES, quality_rules.HOST_LINES), (0, quality_rules.HOST_LINES), (quality_rules.BROADCAST_LINES, 0)):
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", total)
        monkeypatch.setattr(quality_rules, "HOST_LINES", host)
        got = rate_documents(frame).collect()
        assert len(got) == 1501 and all(r.removed_lines == (r.doc_id < 25) for r in got)
        kept = {r.doc_id: r.text for r in keep_good_documents(frame).collect()}
        assert len(kept) == 1500 and not any("by a few" in t and "fewer" not in t for t in kept.values()) and "by fewer" in kept[25]


def test_near_copies_count_once(spark, monkeypatch):
    """Of 30 near copies, each with a line of its own changed, all stay; a line that other documents hold as well goes."""
    common = [" ".join(f"c{k}x{j}" for j in range(20 - k)) for k in range(8)]
    rows = [(i, "\n".join([*(x if k != i % 8 else f"{x} changed{i}" for k, x in enumerate(common)), "foot of all"]), "h") for i in range(30)]
    rows += [(100 + i, " ".join(f"o{i}x{j}" for j in range(30)) + "\nfoot of all", "h") for i in range(200)]
    rows += [(400 + i, f"foot of all\nfoot of all\na{i} b{i}", "h") for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for total in (quality_rules.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", total)
        got = {r.doc_id: r for r in rate_documents(frame).collect()}
        assert all(got[i].kept and got[i].removed_lines == 1 for i in range(30))
        assert all(r.kept and r.removed_lines == 1 for d, r in got.items() if 100 <= d < 400) and not any(r.kept for d, r in got.items() if d >= 400)
