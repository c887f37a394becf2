"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest vocabulary piece at each place. The automaton is a trie of the vocabulary with,
at each node, a failure link and the number of pieces that following it pops: both are precomputed, so a word is
counted in one pass over its bytes, each of which moves forward or pops, and no piece is ever built.

A vocabulary has pieces that end a word, marked by a suffix, and pieces that don't; a word is its UTF-8 bytes and one end mark,
which counts nothing when the last piece isn't one that ends words. If some place can't be matched, the whole word counts as one unknown piece.

Nulls and edge cases: a null, empty or blank text has 0 words and 0 tokens; a word of any length is counted in linear time;
repeated rows are counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import lower_words
from tracewell.llm.packing import bytes_of_alphabet

END = 256  # the symbol after a word's last byte
_MEMO = 400_000


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        """pieces: sequences of symbols 0..255 and END."""
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                at = self.child[node].get(symbol)
                if at is None:
                    at = len(self.child)
                    self.child[node][symbol] = at
                    self.child.append({})
                    final.append(False)
                node = at
            final[node] = True
        n = len(self.child)
        #: fail[v]: where the automaton stands after the pieces in v's string that no longer match can change; -1: nowhere.
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque((0, s, v) for s, v in self.child[0].items())
        while queue:
            parent, symbol, v = queue.popleft()
            if final[v]:
                # all of v is one piece; an end mark that is left over after the last byte's piece costs nothing
                self.fail[v], self.pops[v] = 0, int(parent != 0 or symbol != END)
            else:
                u, count = self.fail[parent], self.pops[parent]
                while u >= 0 and symbol not in self.child[u]:
                    count += self.pops[u]
                    u = self.fail[u]
                if u >= 0:
                    self.fail[v], self.pops[v] = self.child[u][symbol], count
            queue.extend((v, s, w) for s, w in self.child[v].items())

    def count(self, symbols: list[int]) -> int:
        """Pieces of the greedy longest-match segmentation; -1 if there is none."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for s in symbols:
            while True:
                to = child[node].get(s)
                if to is not None:
                    node = to
                    break
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else -1


@lru_cache(maxsize=2)
def automaton(vocabulary: str, suffix: str = "</w>") -> Automaton:
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = bytes_of_alphabet()
    special = {x["content"] for x in model["added_tokens"]}
    pieces = []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix(suffix)
            pieces.append((*(alphabet[c] for c in body), *[END] * (body != piece)))
    return Automaton([*pieces, (END,)])


def count_tokens(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens, n_unknown (words without a segmentation), longest (most pieces in one word)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, memo = automaton(vocabulary), {}
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(memo) > _MEMO:
                    memo.clear()
                words = lower_words(body.as_py() or "")
                total = unknown = longest = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        n = machine.count([*w, END])
                        if len(w) < 64:
                            memo[w] = n
                    if n < 0:
                        unknown, n = unknown + 1, 1
                    total += n
                    if n > longest:
                        longest = n
                rows.append((doc, len(words), total, unknown, longest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "n_words", "n_tokens", "n_unknown", "longest"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(task, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint, longest bigint")
