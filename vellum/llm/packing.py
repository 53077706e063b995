"""Tokens of documents packed into sequences by bounded-space online best fit."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.bpe import byte_letters
from vellum.llm.common import pieces, strings

#: Tokens of a sequence, the id that ends a document, and the sequences that a packer holds open.
CAPACITY, END_OF_DOCUMENT, OPEN_BINS = 1024, 2, 512
#: Runs of letters that one worker remembers the ids of.
REMEMBERED = 300_000


#: White space other than the single spaces and line feeds that part most texts.
ODD_SPACE = re.compile(r"[^\S \n]")
#: Longer runs are not remembered.
LONG_RUN = 1000


class ByteBpe:
    """A tokenizers file of kind byte-level BPE.

    Its words hold at most a space in front and no other white space, so a text whose spaces and line feeds all stand alone
    is the sum of its runs, whose ids are remembered; any other text goes to the tokenizers library whole. New runs are
    encoded with the same vocabulary by tiktoken, whose calls cost less.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        of_letter = {letter: byte for byte, letter in enumerate(byte_letters())}
        ranks = {bytes(of_letter[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.runs = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, known: dict[str, bytes], words: list[str], space: str) -> bool:
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        for w in new:
            if len(w) > LONG_RUN:
                return False
            ids = self.runs.encode_ordinary(space + w)
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return True

    def encode(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD_SPACE.search(text) or any(t in text for t in self.specials):
            return self._whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        first, later = self.first, self.later
        while True:
            try:
                return self.feed.join([first[words[0]] + b"".join([later[w] for w in words[1:]]) for words in lines])
            except KeyError:
                if not (self._learn(first, [words[0] for words in lines], "") and self._learn(later, [w for words in lines for w in words[1:]], " ")):
                    return self._whole(text)


@lru_cache(4)
def load(path: str) -> ByteBpe:
    """The vocabulary, read once by each worker."""
    return ByteBpe(path)


class OpenBins:
    """At most `most` open sequences, kept by free space: a bit for each free space that some open sequence has."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free = 0, [[] for _ in range(capacity + 1)]
        self.held, self.made = 0, 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.held -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset): the open sequence with the least free space that suffices, or else a new one."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.held >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)  # closed: nothing is put there any more
                else:
                    return number, self.capacity - free
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.held += 1
        return number, self.capacity - free


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only longer documents are cut, and the first piece takes what full ones leave."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, length, capacity)]


def pack_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """doc_id, piece, start, length, ids (binary), sequence_id, offset (in tokens): one row per piece of each document.

    Each task packs its own input partition online, piece by piece in the order of its rows and without a shuffle; sequence
    ids carry the partition's number, so a task that is run again gives the same rows, and neither the size of Arrow batches
    nor the machine changes them. Full pieces fill a sequence alone. Null and empty texts consist of the end id only; texts of
    any length are encoded whole; repeated rows are packed as often as they come; null ids are kept; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        bins, end = OpenBins(capacity, open_bins), np.array([end_id], dtype="<u4").tobytes()
        for batch in pieces(batches):
            model = load(vocabulary)
            encoded = [model.encode(text) + end for text in strings(batch.column(1))]
            found = [(number, piece, start, length) for number, ids in enumerate(encoded) for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity))]
            rows: list[list] = [[], [], [], [], [], [], []]
            for number, piece, start, length in found:
                sequence, offset = bins.place(length)
                for column, value in zip(rows, (number, piece, start, length, encoded[number][4 * start : 4 * (start + length)], base + sequence, offset), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            ids_of_rows = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of_rows, *(pa.array(r, k) for r, k in zip(rows[1:], kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, piece int, start long, length long, ids binary, sequence_id long, offset long")
