"""Secrets in texts: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, fresh, strings

#: What may be a secret: known token shapes, values assigned to telling names, and key blocks. The group v is the value.
CANDIDATE = re.compile(
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<block>[A-Za-z0-9+/=\s\\:,.]*+(?:-[A-Za-z0-9+/=\s\\:,.]++)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:\s*+[A-Za-z][A-Za-z0-9-]*+: [^\n]*+\n)*+(?:[\s\\]*+(?:n(?=[A-Za-z0-9+/]{40}))?[A-Za-z0-9+/]{20,}+=*+)*+)"
    r"|(?<![A-Za-z0-9])(?:(?P<shape>AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])|(?P<jwt>eyJ(?=[A-Za-z0-9_-]{8})))"
    r"|(?<![A-Za-z0-9])(?i:bearer|basic)\s{1,3}(?P<bearer>[A-Za-z0-9._~+/=-]{8,}+)"
    r"|://[^\s:/@\"'<>]*+:(?P<url>[^\s:/@\"'<>]{3,}+)(?=@)"
    r"|(?P<name>(?i:pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|api[_-]?key|access[_-]?key|auth|credential)s?)[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}(?P<quote>[\"'`]?)(?P<value>[^\s\"'`<>,;]{6,}+)"
)
#: A whole web token, and its first run of letters: if no token begins at one place of a run, none begins further on in it.
JWT, JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), re.compile(r"[A-Za-z0-9_-]++")
#: Words that tell of examples.
PLACEHOLDERS = frozenset("example sample changeme placeholder your xxxx dummy fake test todo redacted none null insert here env getenv config secret password token foobar default undefined".split())
#: The dictionary: whole words of letters, of so many letters at least and at most, of a public vocabulary with word ends.
DICTIONARY, WORD_LETTERS = "word_bpe_49k.json", (4, 20)
NEAR = ("key", "secret", "token", "password", "aws", "login", "auth", "example", "test", "dummy", "placeholder", "sha1", "commit", "hash", "md5", "checksum", "uuid")
FEATURES = 16
#: Trees, their depth, leaves' least size, and labelled findings of each kind that are made to train on.
TREES, DEPTH, LEAST_LEAF, LABELLED_FINDINGS, SEED = 40, 8, 3, 3000, 7
CONTEXT = 48


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, leftmost and without overlaps."""
    found, at, no_jwt = [], 0, 0
    while m := CANDIDATE.search(text, at):
        at = m.end()
        if m["jwt"]:
            whole = JWT.match(text, m.start()) if m.start() >= no_jwt else None
            if whole:
                found.append((*whole.span(), "shape"))
                at = whole.end()
            elif m.start() >= no_jwt:
                no_jwt = JWT_RUN.match(text, m.start()).end()
            continue
        kind = "block" if m["block"] is not None else "shape" if m["shape"] else "value"
        part = next(g for g in ("block", "shape", "bearer", "url", "value") if m[g] is not None)
        start, end = m.span(0) if kind == "block" else m.span(part)
        if part == "value":
            value = m["value"].rstrip(".)]}:")
            end = start + len(value)
            if len(value) < 6:
                continue
        found.append((start, end, kind))
    return found


def transitions(value: str) -> float:
    """Share of neighbouring letters that change class (lower, upper, digit, other)."""
    classes = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value]
    return sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, len(value) - 1)


@lru_cache(2)
def dictionary(path: str) -> frozenset[str]:
    """The words of a tokenizers file with word ends, read once by each worker, and the placeholders."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    words = (t.removesuffix(model["end_of_word_suffix"]) for t in model["vocab"] if t.endswith(model["end_of_word_suffix"]))
    return frozenset(w for w in words if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1] and w.isascii() and w.isalpha()) | PLACEHOLDERS


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters of the whole value that lie in words of the dictionary, the longest word at each place first."""
    lower, covered, at = value.lower(), 0, 0
    while at < len(lower):
        n = next((n for n in range(min(WORD_LETTERS[1], len(lower) - at), WORD_LETTERS[0] - 2, -1) if lower[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(lower))


def features(text: str, start: int, end: int, kind: str, path: str, words: frozenset[str]) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of one candidate."""
    value = text[start:end]
    near = re.findall(r"[a-z0-9]+", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower())
    counts, n = Counter(value), max(1, len(value))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    hexadecimal = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    path = path.lower()
    pairs = [a + b for a, b in zip(value.lower(), value.lower()[1:], strict=False)]
    return [
        n, transitions(value), coverage(value, words), entropy, hexadecimal, sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(not c.isalnum() for c in value) / n,
        max(counts.values()) / n, len(set(pairs)) / max(1, len(pairs)), float(kind == "shape"), float(kind == "block"),
        float(any(w in path for w in ("test", "example", "doc", "sample", "fixture", "mock"))), float(any(w in near for w in NEAR[:7])), float(any(w in near for w in NEAR[7:11])), float(any(w in near for w in NEAR[11:])),
    ]


def labelled_findings(n: int = LABELLED_FINDINGS, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, path, label) of findings written by a seeded generator: keys, tokens and passwords in prose and code, and look-alikes."""
    rng = random.Random(seed)
    syllables = "the an er on re in ed nd ha at en es of or nt ti hi to it st io le is ou ar as de rt ve com pro code data user name".split()
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, low, high=None: "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 9)))
    names, marks = ["password", "passwd", "pwd", "secret", "token", "api_key", "API-KEY", "access_key", "auth", "credential"], ["=", " = ", ": ", ":", " := "]

    def secret() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + some(upper + digits, 16)
        if kind == 1:
            return "gh" + rng.choice("pous") + "_" + some(lower + upper + digits, 36)
        if kind == 2:
            return rng.choice(["sk-" + some(lower + upper + digits, 24, 48), "AIza" + some(lower + upper + digits + "_-", 35), "xoxb-" + some(digits, 11) + "-" + some(lower + upper + digits, 24)])
        if kind == 3:
            return "eyJ" + some(lower + upper + digits, 20, 40) + "." + some(lower + upper + digits, 40, 90) + "." + some(lower + upper + digits + "_-", 43)
        quote = rng.choice(["", '"', "'"])
        value = [some("0123456789abcdef", 16, 64), some(lower + upper + digits + "!@#%_-+/", 10, 40), some(lower + upper + digits, 12, 40), word().capitalize() + some(digits, 2, 5) + rng.choice("!@#%") + some(lower + upper, 2, 6)][kind - 4]
        return rng.choice(names) + rng.choice(marks) + quote + value + quote

    def decoy() -> str:
        kind, quote = rng.randrange(8), rng.choice(["", '"', "'"])
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + rng.choice(["IOSFODNN7EXAMPLE", "X" * 16, "EXAMPLEEXAMPLE12", "0" * 16, "YOURACCESSKEYHER"])
        if kind == 1:
            return "ghp_" + rng.choice(["x" * 36, "your" * 9, "example" * 5 + "x", "0" * 36])
        value = [
            rng.choice(["changeme", "your_password_here", "<password>", "xxxxxxxx", "********", "example", "password123", "placeholder", "redacted", "insert-token-here", "secret_token", "dummy-password"]),
            word() + word() + word(), "${" + some(upper, 4, 12) + "}", "os.environ.get(" + word(), word() + "." + word() + "(" + word(), "self." + rng.choice(["password", "token", "secret", "config"]) + rng.choice(["", "_value", "_name"]),
        ][kind - 2]
        return rng.choice(names) + rng.choice(marks) + quote + value + quote

    rows = []
    for i in range(2 * n):
        true = i % 2
        hints = ["", "", "", "example ", "test ", "dummy "] if not true else ["", "", "", "", "", "login ", "aws key "]
        path = rng.choice(["src/main", "app/config", "docs/example", "tests/test_x", "", "src0", "web"])
        rows.append((f"{prose()} {rng.choice(hints)}{secret() if true else decoy()} {prose()}", path, true))
    return rows


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, children, share of true findings."""

    feature: tuple[np.ndarray, ...]
    threshold: tuple[np.ndarray, ...]
    left: tuple[np.ndarray, ...]
    right: tuple[np.ndarray, ...]
    share: tuple[np.ndarray, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in zip(self.feature, self.threshold, self.left, self.right, self.share, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / len(self.feature)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> list[np.ndarray]:
    """One tree by Gini impurity, each split over a random few of the features."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, level: int) -> int:
        mine = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level >= depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return mine
        best = (1e-9, -1, 0.0)
        whole = y[rows].mean() * (1 - y[rows].mean())
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, truth = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order) + 1)
            cut = np.flatnonzero((values[:-1] < values[1:]) & (n[:-1] >= least) & (len(order) - n[:-1] >= least))
            if not len(cut):
                continue
            a, b = truth[cut] / n[cut], (truth[-1] - truth[cut]) / (len(order) - n[cut])
            gain = whole - (n[cut] * a * (1 - a) + (len(order) - n[cut]) * b * (1 - b)) / len(order)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((values[cut[i]] + values[cut[i] + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[mine][:2] = best[1], best[2]
            nodes[mine][2] = add(rows[low], level + 1)
            nodes[mine][3] = add(rows[~low], level + 1)
        return mine

    add(rng.integers(0, len(x), len(x)), 0)
    columns = list(zip(*nodes, strict=True))
    return [np.array(c, dtype=t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)]


def fit_forest(rows: list[list[float]], labels: list[int], trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, seed: int = SEED) -> Forest:
    x, y, rng = np.array(rows, dtype=float), np.array(labels, dtype=float), np.random.default_rng(seed)
    grown = [_grow(x, y, rng, depth, least) for _ in range(trees)]
    return Forest(*(tuple(column) for column in zip(*grown, strict=True)))


def examples(findings: list[tuple[str, str, int]], words: frozenset[str]) -> tuple[list[list[float]], list[int]]:
    """Features and labels of findings (text, path, label): the label is that of the text's first candidate. Texts without a
    candidate teach nothing, as the forest judges candidates only."""
    found = [(features(text, *first[0], path, words), label) for text, path, label in findings if (first := candidates(text))]
    return [f for f, _ in found], [label for _, label in found]


@lru_cache(2)
def default_forest(path: str) -> Forest:
    return fit_forest(*examples(labelled_findings(), dictionary(path)))


def forest_of(findings: DataFrame, vocabulary: str | None = None, most: int = 20_000) -> Forest:
    """A forest of a table of labelled findings (text, path, label), of at most `most` rows: those with the least hash of their text."""
    chosen = findings.where("text is not null and label is not null").orderBy(F.xxhash64("text"), "text", "path", "label").limit(most)
    rows = [(r["text"], r["path"] or "", int(r["label"])) for r in chosen.select("text", "path", "label").collect()]
    return fit_forest(*examples(rows, dictionary(vocabulary or public_tokenizers.path(DICTIONARY))))


def find_secrets(text: str, path: str, forest: Forest, words: frozenset[str]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, share of trees) of every candidate."""
    found = candidates(text)
    if not found:
        return []
    scores = forest.predict(np.array([features(text, *c, path, words) for c in found]))
    return [(*c, float(s)) for c, s in zip(found, scores, strict=True)]


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", forest: Forest | None = None, threshold: float = 0.5, redacted: bool = False, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings (array of start, end, kind, score), and if asked for redacted (the text without its secrets).

    Whole texts are scanned in one narrow pass; positions are code points, the end exclusive. The forest is small and goes
    to every task; `vocabulary`, the file with the words of the dictionary, must be readable on every executor. Null texts
    are empty and stay null when redacted, null paths are empty, null ids are kept, repeated rows are scanned as often as
    they come; secrets and texts of any length are taken whole; other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = vocabulary or public_tokenizers.path(DICTIONARY)
    forest = forest or default_forest(vocabulary)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n_found, findings, texts = dictionary(vocabulary), [], [], []
        for text, path in zip(batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
            scored = find_secrets(text or "", path, forest, words)
            kept = [s for s in scored if s[3] >= threshold]
            n_found.append(len(scored))
            findings.append([dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in kept])
            if redacted:
                texts.append(redact(text, kept) if kept else text)
        columns = [batch.column(0), pa.array(n_found, pa.int64()), pa.array(findings, kinds)] + ([pa.array(texts, pa.string())] if redacted else [])
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_candidates", "findings", "redacted"][: len(columns)])

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(path_column).cast("string").alias("path"))
    schema = f"doc_id {dict(narrow.select('doc_id').dtypes)['doc_id']}, n_candidates long, findings array<struct<start: long, end: long, kind: string, score: double>>" + (", redacted string" if redacted else "")
    made = arrow_map(narrow, step, schema)
    return made.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), "findings", *(["redacted"] if redacted else []))


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    parts, at = [], 0
    for start, end, kind, _ in found:
        parts += (text[at:start], f"[{kind.upper()}-SECRET]")
        at = end
    return "".join(parts) + text[at:]


def redact_documents(docs: DataFrame, text_column: str = "text", path_column: str = "source", forest: Forest | None = None) -> DataFrame:
    """`docs` with its columns, the secrets in the texts replaced; n_chars, if there is one, follows the text.

    Every row stays, repeated ones and those with nulls too; null texts stay null; columns of any name are kept; an empty
    table gives an empty one.
    """
    row, text = fresh(docs, "row", "text")
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col(text_column).alias(text), F.col(path_column).alias("path" if "path" != text else "path_"))
    scanned = scan_documents(packed.select(F.col(row).alias("doc_id"), F.col(text).alias("text"), F.col(packed.columns[2]).alias("source")), forest=forest, redacted=True)
    changed = {text_column: F.col("redacted"), "n_chars": F.length("redacted").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return scanned.select(*((changed[c] if c in changed else F.col("doc_id").getField(c)).alias(c) for c in docs.columns))
