"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1200, 120
# The characters a text may be cut beside, and their strength.
STRENGTH = {"\n": 4, ".": 3, "!": 3, "?": 3, "。": 3, "！": 3, "？": 3, " ": 1}
#: A blank line is the strongest boundary.
BLANK_LINE = 5
#: Cuts before a boundary character, and after a stop inside a number or name.
WEAK = 0.5

PIECES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("piece", T.StringType()),
        T.StructField("own_start", T.IntegerType()),
        T.StructField("own_end", T.IntegerType()),
        T.StructField("forced", T.BooleanType()),
    ]
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places inside the text where it may be cut (a cut at p separates p-1 and p), ascending, and their strength.

    A boundary character may end a piece or, as the weakest cut, start one.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    strength = np.zeros(len(code), dtype=np.float32)
    for char, value in STRENGTH.items():
        strength[code == ord(char)] = value
    lf = code == 10
    strength[1:][lf[1:] & lf[:-1]] = BLANK_LINE
    after = strength[:-1].copy()
    # A stop inside a number or name is weak; before white space it ends a sentence.
    inner = np.isin(code[:-1], [ord("."), ord("!"), ord("?")]) & ~np.isin(code[1:], [10, 13, 32])
    after[inner] = WEAK
    best = np.maximum(after, np.where(strength[1:] > 0, WEAK, 0))
    at = np.flatnonzero(best)
    return at + 1, best[at]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[bool]]:
    """Ends of the pieces' own parts, and whether each part was cut without a boundary.

    A part longer than ``limit - overlap`` is cut at the strongest boundary near its middle: each boundary's
    strength is lowered with its distance from the middle, so that a strong one half way to the edge ties with a
    weaker one in the middle. A part without a boundary stays whole up to ``limit`` and is cut in the middle beyond.
    """
    n, most = len(text), limit - overlap
    if n <= limit:
        return [n], [False]
    at, strength = boundaries(text)
    ends: list[int] = []
    forced: list[bool] = []
    todo = [(0, n, False)]
    while todo:
        a, b, hard = todo.pop()
        if b - a <= most:
            ends.append(b)
            forced.append(hard)
            continue
        lo, hi = np.searchsorted(at, a, "right"), np.searchsorted(at, b, "left")
        if lo < hi:
            middle = (a + b) / 2
            near = strength[lo:hi] * (1.0 - np.abs(at[lo:hi] - middle) / (b - a))
            cut, hard_here = int(at[lo + int(np.argmax(near))]), hard
        elif b - a <= limit:
            ends.append(b)
            forced.append(hard)
            continue
        else:
            cut, hard_here = (a + b) // 2, True
        todo.append((cut, b, hard_here))
        todo.append((a, cut, hard_here))
    return ends, forced


def _pieces(limit: int, overlap: int):
    schema = pa.schema([("id", pa.string()), ("section", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("piece", pa.string()), ("own_start", pa.int32()), ("own_end", pa.int32()), ("forced", pa.bool_())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, section, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text is None:
                    continue
                ends, forced = cuts(text, limit, overlap)
                begin = 0
                for k, (end, hard) in enumerate(zip(ends, forced)):
                    # What a piece repeats of its predecessor: up to the overlap, within the limit, from a word's start.
                    room = min(overlap, limit - (end - begin), begin)
                    start = begin - room
                    if 0 < room and start > 0 and text[start - 1] not in STRENGTH:
                        gaps = [p for p in (text.find(c, start, begin) for c in (" ", "\n")) if p >= 0]
                        start = min(gaps) + 1 if gaps else start
                    rows.append((key, section, k, start, text[start:end], begin, end, hard))
                    begin = end
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return split


def split_texts(items: DataFrame, id_: str = "id", section: str = "section", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered pieces of at most ``limit`` code points: (id, section, piece_no, start, piece, own_start, own_end, forced).

    The own parts [own_start, own_end) of an item's pieces join to its text; ``piece`` also repeats up to ``overlap``
    code points before its own part. ``forced`` marks parts cut where more than ``limit`` code points hold no boundary.
    A text within the limit is one piece, an empty text one empty piece, a null text none. Rows with the same id
    count once (the smallest of differing texts); rows with a null id are kept apart only if their texts differ. Each
    text is worked on alone, so nothing grows with the table.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")
    rows = items.select(F.col(id_).cast("string").alias("id"), F.col(section).cast("string").alias("section"), F.col(text).alias("text"))
    named = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(F.col("text").isNull(), "text", "section")).alias("r")).select("id", "r.section", "r.text")
    nameless = rows.where(F.col("id").isNull()).distinct()
    return named.unionByName(nameless).where(F.col("text").isNotNull()).mapInArrow(_pieces(limit, overlap), PIECES)
