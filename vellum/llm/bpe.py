"""Byte-pair encoding and decoding with word ends, merged in contiguous arrays of boundaries and ranks."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_map, strings

NO_RANK = 1 << 30
#: Longer words are merged with a heap: scanning for the minimum would take time by the square of the length.
SHORT_WORD = 64
#: Words that one worker remembers; beyond that it forgets all and starts anew, so its memory is bounded.
REMEMBERED = 400_000
#: White space as the vocabulary's patterns mean it; Python's own also has the separators 1C to 1F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Memory(dict):
    """Remembers what `make` gave for a key."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordBpe:
    """A tokenizers file of kind BPE with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids = model["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.specials = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", SPACE))
        letters = byte_letters()
        self.bytes, self.last_bytes = ([self.ids[c + end] for c in letters] for end in ("", model["end_of_word_suffix"]))
        self.chunk_ids = _Memory(self._encode_chunk)
        self.chunk_text = _Memory(self.decode)

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """(ids, bounds) of one word: the tokens of its parts, and the byte where each part begins.

        ranks holds the rank of each part with the next. The least rank, the leftmost of equals, is merged by deleting the
        boundary in it; only the ranks on both sides of it change.
        """
        ids = [*map(self.bytes.__getitem__, word[:-1]), self.last_bytes[word[-1]]]
        if len(word) > SHORT_WORD:
            return self._merge_long(ids)
        rank, merged, bounds = self.ranks.get, self.merged, [*range(len(word))]
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_RANK:
            at = ranks.index(least)
            del ids[at + 1], bounds[at + 1], ranks[at]
            here = ids[at] = merged[least]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | here, NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(here << 32 | ids[at + 1], NO_RANK)
        return ids, bounds

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """The same merges, the least rank taken from a heap; entries whose parts have changed are skipped."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            least, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.merged[least], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(ids[a] << 32 | ids[b])) is not None:
                    heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0], [i for i, x in enumerate(ids) if x >= 0]

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            ids += self.merge(word.encode("utf-8", "surrogatepass"))[0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # letter by letter: no final sigma
        chunks = re.split(f"[{SPACE}]+", text) if re.search("[\x1c-\x1f]", text) else text.split()
        return [self.chunk_ids[c] for c in chunks if c]

    def encode_chunks(self, text: str) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, one piece for each run without white space or special token."""
        found: list[bytes] = []
        for i, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if part is None:
                continue
            found += [struct.pack("<I", self.special[part])] if i and part in self.special else self._encode_plain(part)
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_chunks(text))

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder: its tokens, word ends and special tokens included, with spaces between."""
        return " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def round_trip(self, text: str) -> tuple[bytes, str]:
        chunks = self.encode_chunks(text)
        return b"".join(chunks), " ".join(map(self.chunk_text.__getitem__, chunks))


@lru_cache(4)
def load(path: str) -> WordBpe:
    """The vocabulary, read once by each worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (string): one row per row, in one narrow pass.

    Null and empty texts have no ids and decode to the empty string. Long texts, long words included, are encoded whole.
    Repeated rows, null ids and other columns change nothing. `vocabulary` must be readable on every executor.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(vocabulary)
        ids, decoded = zip(*(model.round_trip(t) for t in strings(batch.column(1))), strict=True) if batch.num_rows else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(narrow, step, f"doc_id {dict(narrow.dtypes)['doc_id']}, ids binary, decoded string")
