"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find emails, addresses, card and phone numbers. Looser patterns propose more spans. Labelers (format, check
digits, gazetteers, neighbouring words, plausible length) vote on all of them; expectation-maximisation estimates from the
votes alone how reliable each labeler is; a logistic span classifier is trained on the estimated truth and decides which
proposed spans are added. Votes and features of spans take few values, so what is learnt from is a short table of counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, stored
from vellum.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone")
#: A match can only begin where a run of its letters begins or the match before it ends, so no run is scanned twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Every repeated group is possessive: Java runs other ones by recursion, and a long text would overflow a task's stack.
#: Spans that the base patterns miss: numbers run together with others, phone numbers without a plus, masked emails, long addresses.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{14,19})(?![0-9])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}|(?<![0-9])\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9])",
}
#: A cheap test that a text may hold a loose span at all.
MAY_HOLD = {"email": r"[\[(](?:at|AT)[\])]", "ip": r"[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}", "phone": r"[0-9][.\x20)-]"}
#: Gazetteers: top-level domains, first digits of card numbers, country calling codes.
DOMAINS = r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|mil|info|biz|io|co|ai|dev|app|eu|uk|us|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|ru|ua|cn|jp|kr|in|br|mx|ar|ca|au|nz|za)$"
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|62|35)"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
NEAR = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel", "ip": r"(?i)\bip\b|address|host|server|adresse|direcci", "card": r"(?i)card|visa|master|amex|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|cell|fax|contact|anruf|appel|llam",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|version|serial|sku|item|page|part|build|tracking|hash|commit)\b"
CONTEXT = 40
#: Values that are folded into one array at a time.
BLOCK = 512
LABELERS, ROUNDS, STEPS, RATE = 6, 30, 80, 2.0
FEATURES = len(KINDS) + LABELERS + 2


def once(value: str, name: str, body: str) -> str:
    """SQL of `body`, in which `name` is the value. Spark may put a column's expression where the column is named; in a
    lambda it would then be computed for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(df: DataFrame, names: list[str], step: str, size: int = BLOCK) -> DataFrame:
    """`df` with `step` (SQL over {a} and {x}) over all integers up to each place in the arrays `names`; it is associative, as a sum.

    Appending to one array for each value copies it each time. So the values are cut into blocks, each block is folded by
    itself, and what the blocks before it come to is added: n values cost n * size / 2 + (n / size) ** 2 / 2 copies. The
    steps are columns of their own, as lambdas nested in lambdas take long to analyse.
    """
    add = step.format(a="element_at(acc, -1)", x="x")

    def fold(block: str) -> str:
        return f"aggregate(slice({block}, 2, greatest(size({block}) - 1, 0)), slice({block}, 1, 1), (acc, x) -> concat(acc, array({add})))"

    before = dict(zip(names, fresh(df, *(f"before_{n}" for n in names)), strict=True))
    places = "sequence(0, int((size({n}) - 1) div {size}))"
    df = df.withColumns({n: F.expr(f"if(size({n}) > 0, transform({places.format(n=n, size=size)}, b -> {fold(f'slice({n}, b * {size} + 1, {size})')}), cast(array() as array<array<int>>))") for n in names})
    df = df.withColumns({o: F.expr(f"if(size({n}) > 1, {fold(f'transform({n}, b -> element_at(b, -1))')}, null)") for n, o in before.items()})
    return df.withColumns({n: F.expr(once(o, "o", f"flatten(transform({n}, (b, i) -> if(i = 0, b, transform(b, x -> {step.format(a='get(o, i - 1)', x='x')}))))")) for n, o in before.items()}).drop(*before.values())


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """`df` with a column of that name for each (pattern, whether the text may hold it at all): (s, e, m, before, after) of
    all matches, leftmost and without overlaps; positions in code points, e exclusive."""
    found, pieces, ends = ([f"{part}_{n}" for n in patterns] for part in ("found", "pieces", "ends"))
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumns({f: F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for f, (p, may) in zip(found, patterns.values(), strict=True)})
    df = df.withColumns({x: F.when(F.size(f) > 0, F.split(text, p, -1)).otherwise(none) for x, f, (p, _) in zip(pieces, found, patterns.values(), strict=True)})
    df = df.withColumns({e: F.expr(once(x, "p", f"transform({f}, (m, i) -> length(get(p, i)) + length(m))")) for f, x, e in zip(found, pieces, ends, strict=True)})
    df = running(df, ends, "{a} + {x}")
    span = f"struct(get(u, i) - length(m) as s, get(u, i) as e, m as m, right(get(p, i), {CONTEXT}) as before, left(get(p, i + 1), {CONTEXT}) as after)"
    return df.withColumns({n: F.expr(once(e, "u", once(x, "p", f"transform({f}, (m, i) -> {span})"))) for n, f, x, e in zip(patterns, found, pieces, ends, strict=True)}).drop(*found, *pieces, *ends)


def apart(df: DataFrame, spans: str, taken: str) -> DataFrame:
    """`df` with those of `spans` only that overlap none of `taken`, in time that is linear but for a sort.

    A span overlaps one that begins before its end and not after its start if the furthest end of those lies behind its
    start, and one that begins later if the nearest start of those lies before its end.
    """
    all_, ends, starts = fresh(df, "merged", "ends", "starts")
    mark = "transform({}, x -> struct(x.s as s, {} as own, x.e as e, x as x))"
    df = df.withColumn(all_, F.expr(f"if(size({spans}) > 0 and size({taken}) > 0, sort_array(concat({mark.format(taken, 0)}, {mark.format(spans, 1)})), null)"))
    df = df.withColumns({ends: F.expr(f"transform({all_}, x -> if(x.own = 0, x.e, -1))"), starts: F.expr(f"transform(reverse({all_}), x -> if(x.own = 0, x.s, {1 << 30}))")})
    df = running(running(df, [ends], "greatest({a}, {x})"), [starts], "least({a}, {x})").withColumn(starts, F.reverse(starts))
    alone = once(ends, "e", once(starts, "s", f"transform(filter({all_}, (x, i) -> x.own = 1 and get(e, i) <= x.s and get(s, i) >= x.e), x -> x.x)"))
    return df.withColumn(spans, F.expr(f"if({all_} is null, {spans}, {alone})")).drop(all_, ends, starts)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits(m)), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda total, v: total + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {"email": F.lit(True), "ip": octets(m), "card": n.between(14, 19) & luhn(m), "phone": n.between(10, 15)}[kind]


def votes(kind: str, x: Column) -> list[Column]:
    """1 for personal data, 0 against, null for no opinion: format, check digits, gazetteer, words for, words against, length."""
    m, near, n = x["m"], F.concat_ws(" ", x["before"], x["after"]), F.length(digits(x["m"]))
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    form = {"email": r"^[A-Za-z0-9._%+-]+(@|\x20?[\[(](at|AT)[\])]\x20?)[A-Za-z0-9]", "ip": r"^[0-9A-Fa-f.:]{7,39}$", "card": r"^([0-9]{4}[\x20-]?){3}[0-9]{1,7}$|^3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$", "phone": r"^\+|^\("}[kind]
    check = {"email": m.rlike(r"[A-Za-z]{2,24}$"), "ip": m.contains(":") | octets(m), "card": luhn(m), "phone": n.between(10, 15)}[kind]
    known = {"email": m.rlike(DOMAINS), "ip": ~m.rlike(r"^(?:0|127|255)\."), "card": digits(m).rlike(CARD_PREFIXES), "phone": m.rlike(CALLING_CODES) | ~m.startswith("+")}[kind]
    length = {"email": F.length(m).between(6, 80), "ip": F.length(m).between(7, 39), "card": n.isin(14, 15, 16, 19), "phone": n.between(10, 13)}[kind]
    return [yes_no(m.rlike(form)), yes_no(check), yes_no(known), F.when(near.rlike(NEAR[kind]), 1), F.when(near.rlike(AGAINST), 0), yes_no(length)]


def judged(spans: Column, kind: str) -> Column:
    """Spans with their votes and features: s, e, k (number of the kind), v (votes), long, dense (few letters besides digits)."""

    def one(x: Column) -> Column:
        share = F.length(digits(x["m"])) / F.greatest(F.length(x["m"]), F.lit(1))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), F.array(*votes(kind, x)).alias("v"), F.when(F.length(x["m"]) > 20, 1).otherwise(0).alias("long"), F.when(share > 0.9, 1).otherwise(0).alias("dense"))

    return F.transform(spans, one)


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, base and loose (arrays of judged spans). Base matches that fail the check are dropped; nothing is looked for inside them."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    holds = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True)}
    patterns = {f"base_{k}": (BASE[k], holds[k]) for k in KINDS} | {f"loose_{k}": (LOOSE[k], F.col("text").rlike(MAY_HOLD[k])) for k in KINDS}
    rows = matches(rows, "text", patterns).drop("text")

    def checked(kind: str) -> Column:
        return F.filter(f"base_{kind}", lambda x: valid(kind, x["m"]))

    return rows.select("doc_id", F.concat(*(judged(checked(k), k) for k in KINDS)).alias("base"), F.concat(*(judged(F.col(f"loose_{k}"), k) for k in KINDS)).alias("loose"))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _sum(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + value(r))


def estimate_reliabilities(patterns: Column, rounds: int = ROUNDS) -> Column:
    """Expectation-maximisation over (k, v, n): [share of true spans by kind, P(vote for | true) and P(vote for | false) by labeler]."""
    kinds = len(KINDS)

    def truth(p: Column, m: Column) -> Column:
        share = F.element_at(m, p["k"] + 1)
        odds = F.log(share / (1 - share))
        for i in range(LABELERS):
            a, b, vote = F.get(m, F.lit(kinds + i)), F.get(m, F.lit(kinds + LABELERS + i)), F.get(p["v"], F.lit(i))
            odds = odds + F.when(vote == 1, F.log(a / b)).when(vote == 0, F.log((1 - a) / (1 - b))).otherwise(F.lit(0.0))
        return _logistic(odds)

    def step(m: Column, _: Column) -> Column:
        def update(q: Column) -> Column:
            new = [(_sum(q, lambda r, k=k: F.when(r["k"] == k, r["n"] * r["t"]).otherwise(0.0)) + 1) / (_sum(q, lambda r, k=k: F.when(r["k"] == k, r["n"]).otherwise(0.0)) + 2) for k in range(kinds)]
            for weight, prior in ((lambda r: r["t"], 2.0), (lambda r: 1 - r["t"], 0.5)):
                for i in range(LABELERS):
                    said = lambda r, i=i, w=weight: F.when(F.get(r["v"], F.lit(i)).isNotNull(), r["n"] * w(r)).otherwise(0.0)
                    agreed = lambda r, i=i, w=weight: F.when(F.get(r["v"], F.lit(i)) == 1, r["n"] * w(r)).otherwise(0.0)
                    new.append((_sum(q, agreed) + prior) / (_sum(q, said) + 2.5))
            return F.array(*new)

        return let(F.transform(patterns, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"), p["n"].alias("n"), truth(p, m).alias("t"))), update)

    first = F.array(*[F.lit(0.6)] * kinds, *[F.lit(0.8)] * LABELERS, *[F.lit(0.3)] * LABELERS)
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step), lambda m: F.transform(patterns, lambda p: truth(p, m)))


def span_features(x: Column) -> list[Column]:
    signed = [F.when(F.get(x["v"], F.lit(i)) == 1, 1.0).when(F.get(x["v"], F.lit(i)) == 0, -1.0).otherwise(0.0) for i in range(LABELERS)]
    return [*(F.when(x["k"] == k, 1.0).otherwise(0.0) for k in range(len(KINDS))), *signed, x["long"].cast("double"), x["dense"].cast("double")]


def train_classifier(rows: Column, steps: int = STEPS) -> Column:
    """Weights of a logistic regression of t on the features f with case weights n, by gradient steps."""
    total = _sum(rows, lambda r: r["n"])

    def step(w: Column, _: Column) -> Column:
        def update(q: Column) -> Column:
            return F.array(*(F.get(w, F.lit(i)) * 0.999 + RATE * _sum(q, lambda r, i=i: r["g"] * F.get(r["f"], F.lit(i))) / (total + 1) for i in range(FEATURES)))

        dot = lambda r: F.aggregate(F.zip_with(r["f"], w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return let(F.transform(rows, lambda r: F.struct(r["f"].alias("f"), (r["n"] * (r["t"] - _logistic(dot(r)))).alias("g"))), update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*[F.lit(0.0)] * FEATURES), step)


@dataclass(frozen=True)
class SpanClassifier:
    weights: tuple[float, ...]

    def keeps(self, x: Column) -> Column:
        score = F.lit(0.0)
        for weight, feature in zip(self.weights, span_features(x), strict=True):
            score = score + feature * weight
        return score > 0


def _fit(found: DataFrame) -> SpanClassifier:
    spans = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.k", "x.v", "x.long", "x.dense")
    counted = spans.groupBy("k", "v", "long", "dense").agg(F.count("*").cast("double").alias("n"))
    table = counted.agg(F.sort_array(F.collect_list(F.struct("k", "v", "long", "dense", "n"))).alias("p"))
    learnt = table.select("p", estimate_reliabilities(F.col("p")).alias("t"))
    rows = F.zip_with("p", "t", lambda p, t: F.struct(F.array(*span_features(p)).alias("f"), p["n"].alias("n"), t.alias("t")))
    weights = learnt.select(let(rows, train_classifier).alias("w")).first()["w"]
    return SpanClassifier(tuple(float(w) for w in weights))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> SpanClassifier:
    """Learn from all spans of all documents. Of them only counts by kind, votes and features are gathered: 4 kinds, 3^6
    votes and 4 features bound that table, whatever the input; the driver gets the weights."""
    return _fit(_found(docs, id_column, text_column))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classifier: SpanClassifier | None = None) -> DataFrame:
    """doc_id, base_spans and spans (arrays of s, k, e: start, number of the kind in KINDS, end), in the order of start and kind.

    spans are the base spans and those loose ones that the classifier takes for personal data and that meet no base span
    (nor one added for a kind before theirs: cards, emails, addresses, phones). Texts are read once: spans and their votes
    go to the shared folder, and learning and judging read them there. Null texts are empty; null ids are kept; repeated
    rows count as often as they come; other columns are ignored; with no spans at all, or an empty table, nothing is added.
    Very long texts are searched whole, in time near their length.
    """
    found = _found(docs, id_column, text_column)
    if classifier is None:
        found = stored(found)
        classifier = _fit(found)

    def of_kind(k: int) -> Column:
        return F.filter("added", lambda x: x["k"] == k)

    found = found.withColumn("added", F.filter("loose", classifier.keeps)).withColumn("taken", F.col("base"))
    for kind in ("card", "email", "ip", "phone"):
        found = apart(found.withColumn("mine", of_kind(KINDS.index(kind))), "mine", "taken").withColumn("taken", F.concat("taken", "mine"))
    plain = lambda spans: F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return found.select("doc_id", plain(F.col("base")).alias("base_spans"), plain(F.col("taken")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
