"""Long exact spans shared between texts.

A shared span may start and end anywhere, so that it needn't hold several whole sentences, or even one; runs of
sentences would miss such spans. The runs hashed here are therefore cut where the text itself chooses: of every
``WINDOW`` consecutive runs of ``RUN`` code points the one with the smallest hash is taken. Texts that share a span of
``SPAN`` = WINDOW + RUN - 1 code points hold the same window of runs, take the same one from it, and so meet in the global
join of hashes, whatever surrounds the span. Every meeting of few texts is then compared as text; where many meet, as in a
notice that thousands of texts hold, they are grouped by all runs of ``SPAN`` code points around the place instead, so that the
work grows with the texts and not with their pairs. Where a run repeats with an overlap,
its places in two texts needn't be aligned, so such a stretch is compared by all runs of ``SPAN`` code points around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import fits_broadcast

SPAN, RUN = 200, 96
#: Texts that meet in one hash beyond which they aren't compared pair by pair.
HOT = 64
#: Members of a group whose pairs are written in one block.
BLOCK_ROWS = 1024
#: Code points that are hashed at a time.
BLOCK = 1 << 19
# Fixed values of the rolling hash: an odd base, its inverse modulo 2**64, and a multiplier that mixes bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MIX)
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def run_hashes(code: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of every run of ``run`` code points."""
    n = len(code)
    if n < run:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mixed(code.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    return _mixed((sums[run:] - sums[:-run]) * down[: n - run + 1])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, in three passes whatever the width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def chosen(texts: list[str], span: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the runs that the texts choose; texts shorter than ``span`` choose none."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    code = np.concatenate(parts) if parts else np.empty(0, dtype="<u4")
    hashes = run_hashes(code, run)
    width = span - run + 1
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = window_minima((hashes & ~low) | places, width)
    # Windows that lie in one text.
    of = np.searchsorted(ends, np.arange(len(least)), "right")
    least = least[np.arange(len(least)) + span <= ends[of]] if len(least) else least
    at = np.unique((least & low).astype(np.int64))
    text = np.searchsorted(ends, at, "right")
    key = hashes[at]
    order = np.lexsort((at, key, text))
    t, h, p = text[order], key[order], at[order]
    return t, p - (ends[t] - lengths[t]), h


def repetitions(t: np.ndarray, p: np.ndarray, h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first place, last place, hash) of what ``chosen`` gives.

    Where a run repeats with an overlap, as in "aaaa", the repetitions are one stretch from the first to the last; else first
    and last place are the same.
    """
    edge = np.ones(len(p) + 1, dtype=bool)
    edge[1:-1] = (t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (p[1:] - p[:-1] > run)
    first, last = edge[:-1], edge[1:]
    return t[first], p[first], p[last], h[first]


def _blocks(keys: list, texts: list) -> Iterator[tuple[list, list]]:
    some, own, size = [], [], 0
    for k, t in zip(keys, texts):
        if size and size + len(t) > BLOCK:
            yield some, own
            some, own, size = [], [], 0
        some.append(k)
        own.append(t)
        size += len(t)
    if some:
        yield some, own


def _hash_runs(span: int, run: int):
    step = BLOCK - span + 1

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A very long text goes in slices that overlap by a span less one, so that every span lies in one of them.
            slices = [(doc, i, text[i : i + BLOCK]) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in range(0, max(1, len(text) - span + 1), step)]
            for keys, texts in _blocks([x[:2] for x in slices], [x[2] for x in slices]):
                t, place, last, h = repetitions(*chosen(texts, span, run), run)
                docs, offsets = np.array(keys, dtype=np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs[t]), pa.array((place + offsets[t]).astype(np.int32)), pa.array((last + offsets[t]).astype(np.int32))], names=["h", "doc", "place", "last"])

    return hash_runs


def _around(span: int, run: int):
    """Cuts what lies left and right of each meeting run, as far as a shared span can reach. Of a stretch of repetitions
    come the distinct hashes of all runs of ``span`` code points that hold one of them instead; they are few, as it repeats."""
    reach = span - run

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                for r in runs:
                    p, last = r["place"], r["last"]
                    if p == last:
                        out.append((r["h"], doc, p, text[max(0, p - reach) : p], text[p : p + span], None))
                    else:
                        out.append((r["h"], doc, p, None, None, span_hashes(text[max(0, p - reach) : last + span], span)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())))], names=["h", "doc", "place", "left", "right", "grams"])

    return around


def span_hashes(text: str, span: int) -> np.ndarray:
    """The distinct hashes of all runs of ``span`` code points, sorted."""
    return np.unique(run_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), span).view(np.int64))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _same(span: int):
    def meet(la: str | None, ra: str | None, ga: np.ndarray | None, lb: str | None, rb: str | None, gb: np.ndarray | None) -> bool:
        if ga is None and gb is None:
            return common_prefix(ra, rb) + common_prefix(la[::-1], lb[::-1]) >= span
        ga = span_hashes(la + ra, span) if ga is None else ga
        gb = span_hashes(lb + rb, span) if gb is None else gb
        return len(np.intersect1d(ga, gb, assume_unique=True)) > 0

    def lists(column) -> list:
        return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, la, ra, lb, rb = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))
            good = [(i, j) for i, j, *both in zip(x, y, la, ra, lists(b.column(4)), lb, rb, lists(b.column(7))) if meet(*both)]
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*dict.fromkeys(good))], names=["a", "b"])

    return same


def _crowd_grams(span: int):
    """(g, doc) of the runs of ``span`` code points around a meeting run."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            found = [span_hashes(x + y, span) if g is None else np.asarray(g) for x, y, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.repeat(docs, [len(x) for x in found]), pa.int64())], names=["g", "doc"])

    return grams


def pairs_within(groups: DataFrame, group: str, item: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b), a < b: the pairs of items of one group. A group of many items is cut into parts by hash, and each two parts
    meet in a block of their own, so that no task gets a whole large group."""
    sizes = groups.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    cut = groups.join(sizes, group).select(F.col(group).alias("_g"), F.col(item).alias("_i"), "_parts", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int").alias("_p"))
    spread = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    block = spread.select("_g", F.least("_p", "_o").alias("_x"), F.greatest("_p", "_o").alias("_y"), "_p", "_i")
    a, b = block.alias("a"), block.alias("b")
    apart = (F.col("a._x") == F.col("a._y")) | (F.col("a._p") != F.col("b._p"))
    on = (F.col("a._g") == F.col("b._g")) & (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y")) & (F.col("a._i") < F.col("b._i")) & apart
    return a.join(b, on).select(F.col("a._i").alias("a"), F.col("b._i").alias("b"))


class SharedSpans:
    """Spans of at least ``span`` code points that stand in more than one text.

    ``docs`` has (doc BIGINT, text STRING). Rows with one id count once (the smallest of differing texts); null ids and
    null texts are left out, as they share nothing; texts shorter than ``span`` meet nobody. Equal texts are one class,
    stood for by its smallest id: only that one is hashed and compared. ``keep`` stores the tables used several times.
    """

    def __init__(self, docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], span: int = SPAN, run: int = RUN):
        self.keep, self.span, self.run = keep, span, run
        long = F.col("doc").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= span)
        self.docs = docs.where(long).select(F.col("doc").cast("long").alias("doc"), "text")
        ids = keep(self.docs.select("doc", F.sha2("text", 256).alias("digest")).groupBy("doc").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("n")), "digests")
        classes = ids.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep")
        #: (rep, doc) of every text that has exact copies.
        self.copies = keep(ids.join(classes, "digest").select("rep", "doc"), "copies")
        spare = self.copies.where("doc <> rep").select("doc")
        self.reps = self.docs.join(self._small(spare, 16), "doc", "left_anti")
        if not ids.where("n > 1").isEmpty():
            self.reps = self.reps.groupBy("doc").agg(F.min("text").alias("text"))
        runs = keep(self.reps.mapInArrow(_hash_runs(span, run), "h long, doc long, place int, last int"), "runs")
        several = runs.groupBy("h").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a < _b").select("h")
        meeting = keep(runs.join(self._small(several, 32), "h"), "meeting")
        places = meeting.groupBy("doc").agg(F.collect_list(F.struct("h", "place", "last")).alias("runs"))
        # A run takes 40 bytes, a text with runs as many again, and has one run at least.
        self.met = self.reps.join(F.broadcast(places) if fits_broadcast(meeting, 80) else places, "doc").select("doc", "text", "runs")
        self.meeting = meeting
        #: (h, doc, place, left, right, grams) of the runs that occur in two texts or more.
        self.meetings = self.met.mapInArrow(_around(span, run), "h long, doc long, place int, left string, right string, grams array<long>")

    @staticmethod
    def _small(df: DataFrame, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if fits_broadcast(df, row_bytes) else df

    def _crowds(self, around: DataFrame, hot: DataFrame) -> DataFrame:
        """(crowd, doc): texts that meet in the hashes ``hot``; those of one crowd share a run of ``span`` code points, and
        any two that share one around such a hash are in a crowd together. Equal crowds come once."""
        grams = around.join(hot, "h", "left_semi").select("doc", "left", "right", "grams").mapInArrow(_crowd_grams(self.span), "g long, doc long").distinct()
        grams = self.keep(grams, "crowds")
        same = [F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.hash("doc")).alias("y")]
        one = grams.groupBy("g").agg(*same).where("n > 1").groupBy("n", "a", "z", "x", "y").agg(F.min("g").alias("g")).select("g")
        return grams.join(self._small(one, 16), "g").select(F.col("g").alias("crowd"), "doc")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(a, b) and (crowd, doc): what texts share, without the pairs of large groups.

        The pairs are of texts, one for each set of exact copies (``copies`` has the sets), that meet with few others;
        the texts of a crowd all share a span with each other.
        """
        m = self.keep(self.meetings, "around")
        hot = self.keep(self.meeting.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h"), "hot")
        cold = m
        crowds = self.docs.sparkSession.createDataFrame([], "crowd long, doc long")
        if not hot.isEmpty():
            hot = self._small(hot, 16)
            cold = m.join(hot, "h", "left_anti")
            crowds = self._crowds(m, hot)
        a, b = cold.alias("a"), cold.alias("b")
        met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.doc") < F.col("b.doc")))
        met = met.select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), *(F.col(f"{s}.{c}").alias(c[0] + s) for s in "ab" for c in ("left", "right", "grams")))
        return met.mapInArrow(_same(self.span), "a long, b long"), crowds

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: every pair of documents whose texts share a span. Crowds and copies are expanded
        last, in blocks of bounded size."""
        few, crowds = self.links()
        linked = few.unionByName(pairs_within(crowds, "crowd", "doc")).distinct()
        wide = linked.join(self.copies.select(F.col("rep").alias("a"), F.col("doc").alias("da")), "a", "left").join(self.copies.select(F.col("rep").alias("b"), F.col("doc").alias("db")), "b", "left")
        x, y = F.coalesce("da", "a"), F.coalesce("db", "b")
        between = wide.select(F.least(x, y).alias("doc_a"), F.greatest(x, y).alias("doc_b"))
        return between.unionByName(pairs_within(self.copies, "rep", "doc").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))

    def stretches(self) -> DataFrame:
        """(doc, start, end, first): the parts of each text that stand in another text too, as [start, end).

        Every run of ``span`` code points near a meeting run is looked up among all such runs; no pairs are formed, so a
        span that a third of all texts share costs each of them the same. ``first`` tells that the document has the
        smallest id of those holding all of the part; copies of a text are not first. The parts are as long as they can be
        and don't touch others of the same kind.
        """
        grams = self.keep(self.met.mapInArrow(_grams(self.span, self.run), "g long, doc long, place int"), "grams")
        held = grams.groupBy("g").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a < _b")
        shared = grams.join(self._small(held, 48), "g").select("doc", "place", (F.col("doc") == F.col("_a")).alias("first"))
        w = Window.partitionBy("doc", "first").orderBy("place")
        island = F.sum(F.coalesce((F.col("place") - F.lag("place").over(w) > self.span).cast("int"), F.lit(0))).over(w)
        parts = shared.withColumn("_i", island).groupBy("doc", "first", "_i").agg(F.min("place").alias("start"), (F.max("place") + self.span).alias("end")).drop("_i")
        of_copies = parts.join(self.copies.where("doc <> rep").select(F.col("rep").alias("doc"), F.col("doc").alias("copy")), "doc").select(F.col("copy").alias("doc"), F.lit(False).alias("first"), "start", "end")
        whole = self.docs.join(self._small(self.copies, 16), "doc").select("doc", (F.col("doc") == F.col("rep")).alias("first"), F.lit(0).alias("start"), F.length("text").alias("end")).distinct()
        own = parts.select("doc", "first", "start", "end")
        return own.unionByName(of_copies).unionByName(whole)


def _near(runs: list, length: int, span: int, run: int) -> list[tuple[int, int]]:
    """Parts of a text, apart from each other, in which a shared span can lie: around each meeting run, and all that lies
    between the first and last place of a run that recurs, as in a text that repeats itself."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for r in runs:
        p = r["place"]
        first[r["h"]] = min(p, first.get(r["h"], p))
        last[r["h"]] = max(r["last"], last.get(r["h"], p))
    parts = [(r["place"], r["place"]) for r in runs] + [(first[h], last[h]) for h in first if last[h] > first[h]]
    out: list[tuple[int, int]] = []
    for a, z in sorted((max(0, a - span + run), min(length, z + span)) for a, z in parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _grams(span: int, run: int):
    """(hash, doc, place) of every run of ``span`` code points that can be shared."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                for a, z in _near(runs, len(text), span, run):
                    for at in range(a, z - span + 1, BLOCK):
                        h = run_hashes(np.frombuffer(text[at : min(z, at + BLOCK + span - 1)].encode("utf-32-le", "surrogatepass"), dtype="<u4"), span)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), doc, dtype=np.int64)), pa.array(np.arange(at, at + len(h), dtype=np.int32))], names=["g", "doc", "place"])

    return grams


def coverage(stretches: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, length, shared, share): how much of each text stands elsewhere too, 0 for texts that share nothing."""
    w = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(w), F.lit(0))
    new = stretches.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), seen)))
    per = new.groupBy("doc").agg(F.sum("_new").alias("shared"))
    size = docs.select("doc", F.length("text").alias("length"))
    out = size.join(per, "doc", "left").select(F.col("doc").alias("doc_id"), "length", F.coalesce("shared", F.lit(0)).alias("shared"))
    return out.withColumn("share", F.coalesce(F.try_divide("shared", "length"), F.lit(0.0)))


def sentences_left(text: str, parts: list[tuple[int, int]]) -> str:
    """The text without the sentences that lie wholly in one of the parts."""
    if not parts:
        return text
    parts = sorted(parts)
    out, start = [], 0
    for i, c in enumerate(text):
        last = i + 1 == len(text)
        ends = c == "\n" or c in "。！？" or (c in ".!?" and (last or text[i + 1] in " \r\n"))
        if ends or last:
            if not any(a <= start and i + 1 <= z for a, z in parts):
                out.append(text[start : i + 1])
            start = i + 1
    return "".join(out)


def without_repeats(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, text): each text without the sentences that a shared span covers of which it isn't the first holder."""
    later = stretches.where("NOT first").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    rows = docs.select("doc", "text").join(later, "doc", "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [t if t is None or not p else sentences_left(t, [(x["start"], x["end"]) for x in p]) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(strip, "doc_id long, text string")
