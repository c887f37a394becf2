"""Packing documents into sequences of a fixed token length by bounded-space online best fit.

Each task packs the pieces of its own partition, so packing is one narrow stage. A fixed number of bins is open at a time. They
are filed by free space; a bitset, kept as one integer, has a bit for each free space that some bin has, so best fit is "lowest set bit at or
above the length". If none fits and all places are taken, the fullest bin closes first. Pieces arrive in bounded
batches, longest first within a batch, so that small pieces find the gaps that large ones leave; as many bins are open as a batch
has pieces, since otherwise bins would close before a batch's small pieces come.

Tokens are those of the `tokenizers` vocabulary file. The byte-pair merger of `tiktoken` makes them from the same file, in a quarter of the
time (tests hold both against each other); texts with runs that its pattern can't pass, such as a million spaces, are encoded by `tokenizers` itself.

Nulls and edge cases: a null or empty text is the closing id alone; a null id is passed on; documents longer than a sequence are cut, the
remainder first; very long texts are encoded whole; repeated rows are packed each; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def bytes_of_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text, as little-endian uint32 bytes."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        alphabet = bytes_of_alphabet()
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.special, self.vocabulary, self.slow = list(special), vocabulary, None
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        # the vocabulary's own special tokens are recognised in texts, as the tokenizer file has it
        allowed = "all" if any(s in text for s in self.special) else set()
        try:
            return self.bpe.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a run that the pattern can't pass
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class BestFit:
    """Bounded-space online best fit. add() gives (bin, offset); bins are numbered as they open."""

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.by_free: dict[int, list[int]] = {}
        self.bits, self.open, self.next = 0, 0, 0

    def _file(self, free: int, bin_: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return bin_

    def add(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.places:  # the fullest open bin closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_, free = self.next, self.capacity
            self.next, self.open = self.next + 1, self.open + 1
        if free == length:
            self.open -= 1  # full
        else:
            self._file(free - length, bin_)
        return bin_, self.capacity - free


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece; only documents over the capacity are cut, the remainder first."""
    first = n % capacity or capacity
    yield 0, min(first, n)
    for start in range(first, n, capacity):
        yield start, capacity


def pack(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, open_bins: int = 16_384, batch_pieces: int = 16_384, end_id: int = 0) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fit = encoder(vocabulary), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            waiting.sort(key=lambda w: -w[3])
            rows = []
            for doc, piece, start, length, crc in waiting:
                bin_, offset = fit.add(length)
                rows.append((doc, piece, start, length, crc, base + bin_, offset))
            waiting.clear()
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(body.as_py() or "") + end
                for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    waiting.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                if len(waiting) >= batch_pieces:
                    yield flush()
        if waiting:
            yield flush()

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(task, SCHEMA)
