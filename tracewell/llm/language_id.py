"""Language identification by compression.

Per language, the texts of a bounded sample of labelled documents, each whole, make a raw-content dictionary for zstandard. A text is lowered and
compressed whole against each dictionary, and the language of the smallest result is chosen: its dictionary held most of the
text's strings. Where the two best are close, as for a few words, matches alone say little: the text is then compressed
behind pieces of each dictionary, whose letters shape the entropy codes, and counts by how much it lengthens them. A result whose
relative margin is under `margin` both times is marked as not confident, and `identify(..., reject=True)` then answers `und`.

Nulls and edge cases: a null text or one without letters is `und` with score 0; rows with null language or id outside the
training part never train; without any training text all rows are `und`; equal sizes go to the first language by code point;
repeated rows are answered alike; very long texts are compressed whole, and join a dictionary only where a language has too few others; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import crc_rest

UNKNOWN = "und"
_LETTER = re.compile("[A-Za-z]")


def sample(docs: DataFrame, training: Column, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", docs_per_language: int = 120, usual_chars: int = 10_000, languages: int = 256) -> dict[str, bytes]:
    """One dictionary a language, of whole training texts. Only these reach the driver.

    They are the docs_per_language documents with the smallest hash among those of up to usual_chars characters; longer ones come after
    them, so they serve where a language has too few others. The `languages` with the most training rows are learned.
    """
    body = F.col(text).cast("string")
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), body.alias("t"), F.xxhash64(F.col(id_col), body).alias("h"), (F.length(body) > usual_chars).alias("long"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    best = Window.partitionBy("lang").orderBy("long", "h")  # Spark limits each group before it shuffles
    places = rows.join(F.broadcast(most), "lang").select("lang", "h", "long").withColumn("r", F.dense_rank().over(best)).where(F.col("r") <= docs_per_language).select("lang", "h", "r").distinct()
    # docs_per_language * languages rows at most; copies of a row are one
    chosen = rows.select("lang", "h", "t").join(F.broadcast(places), ["lang", "h"]).groupBy("lang", "h", "r").agg(F.min("t").alias("t")).collect()
    parts: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], -r["r"], r["t"])):
        parts.setdefault(r["lang"], []).append(r["t"].lower().encode("utf-8", "surrogatepass"))
    return {k: b"\n".join(v) for k, v in parts.items() if any(v)}


class Judge:
    """Sizes of a text against every dictionary."""

    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], level: int, close_level: int, piece: int = 4096, pieces: int = 4) -> None:
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False}
        self.names = [k for k, _ in dictionaries]
        self.fast = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.fast.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_dict_id=False, **plain))
        self.close = zstandard.ZstdCompressor(level=close_level, **plain)
        self.pieces = [[content[i * piece : (i + 1) * piece] for i in range(pieces)] for _, content in dictionaries]
        self.alone = [sum(len(self.close.compress(x)) for x in parts) for parts in self.pieces]

    def sizes(self, body: bytes) -> list[int]:
        return [len(c.compress(body)) for c in self.fast]

    def lengthening(self, body: bytes) -> list[int]:
        return [sum(len(self.close.compress(x + b"\n" + body)) for x in parts) - n for parts, n in zip(self.pieces, self.alone)]


@lru_cache(maxsize=4)
def _judge(dictionaries: tuple[tuple[str, bytes], ...], level: int, close_level: int) -> Judge:
    return Judge(dictionaries, level, close_level)


def decide(judge: Judge | None, text: str | None, margin: float) -> tuple[str, float, bool]:
    """(language, score, confident). The score is the best size's share among all, as a power of two bits for each byte of difference."""
    if judge is None or text is None or not (_LETTER.search(text) or any(c.isalpha() for c in text)):
        return UNKNOWN, 0.0, False
    body = text.lower().encode("utf-8", "surrogatepass")
    sizes = judge.sizes(body)

    def gap() -> tuple[float, float]:
        least, second = sorted([*sizes, math.inf])[:2]
        return second - least, (second - least) / max(least, 1)

    apart, share = gap()
    sure = share >= margin
    if apart < 4 or share < 3 * margin:
        sizes = judge.lengthening(body)
        sure = sure or gap()[1] >= margin
    least = min(sizes)
    score = 1.0 / sum(math.exp2(-min(60.0, (n - least) / 2)) for n in sizes)
    return judge.names[sizes.index(least)], score, sure


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", id_col: str = "doc_id", level: int = 3, close_level: int = 6, margin: float = 0.01, reject: bool = False) -> DataFrame:
    """Per row: doc_id, lang_pred, score, confident."""
    fixed = tuple(sorted(dictionaries.items()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(fixed, level, close_level) if fixed else None
        for batch in batches:
            found = [decide(judge, body.as_py(), margin) for body in batch.column(1)]
            if found:
                names = [UNKNOWN if reject and not sure else name for name, _, sure in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([c for *_, c in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "confident"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(task, "doc_id bigint, lang_pred string, score double, confident boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_rest(id_col, 4) == 2
