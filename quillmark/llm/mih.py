"""The most similar vectors of every vector: multi-index hashing over learned binary codes.

Vectors become binary codes: centred, rotated so that their signs lose least (iterative quantisation, learned on a bounded
sample), and cut to signs. The code is split into substrings, and each substring is an index of its own. Codes that differ
in fewer bits than there are substrings agree in one substring at least (the pigeonhole), so looking up every substring
retrieves all codes within that Hamming radius, and others with a probability that falls with their distance. The radius
grows by rounds: a round also looks up the values one more bit away from each substring. A vector is done once it has k
neighbours so similar that the round has missed nothing as similar; where the next radius would look at a large share of
all codes, the vectors left are compared with all of their collection. Of what is retrieved, codes further than a set
distance are dropped at once; the rest is compared as floats.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import fits_broadcast

#: Vectors on which a rotation is learned, and its rounds.
SAMPLE, ROUNDS = 4096, 12
#: Pairs of this similarity are missed with at most this probability by the first lookup, which flips no bits.
AIM, MISS = 0.85, 0.03
#: Bits compared before floats are, and how many standard deviations more of them than a pair of the similarity aimed at has
#: on average may differ.
CHECKED, SLACK = 384, 2.6
#: Similarity that a pair of AIM keeps at least when the mean is taken off; else vectors are not centred.
CENTRED = 0.6
#: Rows of one bucket beyond which it is compared in salted blocks of about this size.
HOT = 4096
#: log2 of a bucket's expected rows, where all vectors are asked for and where a part is.
FULL, PART = 6, 3
#: Bits flipped at most, and the share of a collection beyond which a round's buckets cost more than a scan of all rows.
FLIPS, SCANNED = 2, 0.25


def layout(n: int, aim: float = AIM, miss: float = MISS, fill: int = FULL) -> tuple[int, int]:
    """(bits of a substring, substrings) for ``n`` vectors.

    Substrings have about log2(n) bits, less ``fill``, so that a bucket's expected size doesn't grow with ``n``; there are as
    many as it takes to miss a pair of similarity ``aim`` with probability ``miss`` at most. Only the whole part of log2(n)
    counts.
    """
    bits = max(6, int(math.log2(max(n, 2))) - fill)
    agree = (1 - math.acos(aim) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def looked_at(bits: int, tables: int, flips: int) -> float:
    """The share of all codes that lookups of substrings with up to ``flips`` bits flipped retrieve, if codes are even."""
    return tables * sum(math.comb(bits, i) for i in range(flips + 1)) / 2**bits


def reached(bits: int, tables: int, flips: int, miss: float = MISS) -> float:
    """The lowest similarity at which such lookups miss a pair with probability ``miss`` at most."""

    def missed(part: float) -> float:
        one = sum(math.comb(bits, i) * part**i * (1 - part) ** (bits - i) for i in range(flips + 1))
        return (1 - one) ** tables

    lo, hi = 0.0, 0.5
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if missed(mid) <= miss else (lo, mid)
    return math.cos(math.pi * lo)


@dataclass
class Codes:
    """A mean and rotations; unit rows less the mean, times ``axes``, give one number per bit. ``aim`` is the similarity
    that a pair of similarity AIM keeps without the mean; buckets are laid out for ``fill``."""

    mean: np.ndarray
    axes: np.ndarray
    aim: float
    fill: int = FULL

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.axes > 0

    def layout(self, n: int) -> tuple[int, int]:
        return layout(n, self.aim, fill=self.fill)

    def reached(self, n: int, flips: int) -> float:
        """The similarity, with the mean, from which on a round of a collection of ``n`` vectors misses few pairs; above 1
        where the round isn't run."""
        plan = self.layout(n)
        if flips and looked_at(*plan, flips) > SCANNED:
            return 2.0
        part = float(self.mean @ self.mean)
        return min(reached(*plan, flips), self.aim) * (1 - part) + part

    def differ(self, n: int, flips: int) -> int:
        """Bits out of CHECKED that a pair of a round may differ in to be compared as floats."""
        part = math.acos(min(reached(*self.layout(n), flips), self.aim)) / math.pi
        return int(part * CHECKED + SLACK * math.sqrt(part * (1 - part) * CHECKED))


def centre(sample: np.ndarray, aim: float = AIM) -> tuple[np.ndarray, float]:
    """(mean, aim): what to take off, and the similarity that pairs of ``aim`` are left with.

    Without a mean of squared length m, similarity s becomes (s - m) / (1 - m) on average. Where all vectors crowd around one
    place that would leave near neighbours dissimilar, so nothing is taken off.
    """
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    m = float(mean @ mean)
    left = (aim - m) / (1 - m) if m < 1 else 0.0
    return (mean, left) if left >= CENTRED else (np.zeros(sample.shape[1]), aim)


def learn(sample: np.ndarray, most: int, seed: int = 7, fill: int = FULL) -> Codes:
    """Rotations by iterative quantisation: signs and rotation are fitted to each other in turn.

    A vector has as many bits as dimensions per rotation; more bits, as many as ``most`` vectors ask for, take more
    rotations, from other random starts.
    """
    d = sample.shape[1]
    mean, aim = centre(sample)
    bits = max(CHECKED, math.prod(layout(most, aim, fill=fill)))
    x = (sample - mean).astype(np.float32)
    rng = np.random.default_rng(seed)
    axes = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        for _ in range(ROUNDS if len(x) else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, np.float32(1), np.float32(-1)))
            r = (u @ vt).astype(np.float32)
        axes.append(r)
    return Codes(mean.astype(np.float32), np.concatenate(axes, axis=1)[:, :bits], aim, fill)


def unit_rows(column, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x /= scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _index(shared, width: int, longs: int, flips: int = 0):
    """(bucket, rid, far, code words): one row for every substring of a vector, and with ``flips`` for every value up to so
    many bits away from it; collections for which that isn't worth it give none."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        names = ["bucket", "rid", "far", *(f"c{i}" for i in range(longs))]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                if not b.num_rows:
                    continue
                rid, coll, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                signs = codes.signs(unit_rows(b.column(3), width).astype(np.float32))
                words = np.packbits(signs[:, : longs * 64], axis=1)
                words = np.pad(words, ((0, 0), (0, longs * 8 - words.shape[1]))).view(np.int64)
                for n in np.unique(size):
                    if codes.reached(int(n), flips) > 1:
                        continue
                    mine = np.flatnonzero(size == n)
                    bits, tables = codes.layout(int(n))
                    masks = np.array([sum(1 << i for i in c) for f in range(flips + 1) for c in itertools.combinations(range(bits), f)], dtype=np.uint64)
                    own = signs[mine][:, : bits * tables].reshape(len(mine), tables, bits)
                    value = (own @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)))[:, :, None] ^ masks
                    table = np.arange(tables, dtype=np.uint64)
                    salt = _mix(coll[mine].view(np.uint64)[:, None] + table * np.uint64(0x9E3779B97F4A7C15))
                    key = _mix(salt[:, :, None] + value)
                    times = tables * len(masks)
                    far = np.full(key.size, codes.differ(int(n), flips), dtype=np.int32)
                    data = [key.ravel().view(np.int64), np.repeat(rid[mine], times), far]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in data] + [pa.array(np.repeat(words[mine, i], times)) for i in range(longs)], names=names)

    return index


def _cosines(width: int):
    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                if b.num_rows:
                    cos = np.einsum("ij,ij->i", unit_rows(b.column(3), width), unit_rows(b.column(4), width))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.minimum(np.round(cos, 9), 1.0))], names=["coll", "key", "other", "cos"])

    return cosines


def usable(vectors: DataFrame, key: str, vec: str, width: int, coll) -> DataFrame:
    """(coll, key, vec): the vectors of the given width without null, NaN or infinite elements that aren't all
    zero."""
    v = F.col(vec)
    good = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(coll.alias("coll"), F.col(key).cast("long").alias("key"), v.cast("array<float>").alias("vec")).where(F.col("coll").isNotNull())


class Index:
    """Substring tables over distinct vectors (coll, key, vec) of ``usable``, one row for each of a collection.

    ``codes`` is None where there are no vectors.
    """

    def __init__(self, vectors: DataFrame, width: int, keep: Callable[[DataFrame, str], DataFrame], fill: int):
        spark = vectors.sparkSession
        self.width, self.keep, self.codes = width, keep, None
        sizes = keep(vectors.groupBy("coll").agg(F.count(F.lit(1)).alias("n")), "sizes")
        facts = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        #: The largest collection.
        self.most = facts["most"] or 0
        if not self.most:
            return
        known = F.broadcast(sizes) if fits_broadcast(sizes, 64) else sizes
        self.rows = vectors.withColumn("rid", F.xxhash64("coll", "key")).join(known, "coll")
        part = min(1.0, SAMPLE / facts["n"])
        sample = self.rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("vec").limit(2 * SAMPLE).toArrow()
        self.codes = learn(unit_rows(sample.column("vec").combine_chunks(), width), self.most, fill=fill)
        self.words = [f"c{i}" for i in range(CHECKED // 64)]
        self._shared = spark.sparkContext.broadcast(self.codes)
        self.table = keep(self._lookups(self.rows, 0), "index")

    def _lookups(self, rows: DataFrame, flips: int) -> DataFrame:
        inputs = rows.select("rid", F.xxhash64("coll").alias("h"), "n", "vec")
        return inputs.mapInArrow(_index(self._shared, self.width, len(self.words), flips), "bucket long, rid long, far int, " + ", ".join(f"{w} long" for w in self.words))

    def _differ(self) -> Column:
        each = [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in self.words]
        return sum(each[1:], each[0])

    def within(self) -> DataFrame:
        """(coll, key, other, cos), both ways round: what one lookup for all vectors retrieves."""
        hot = self.table.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT).select("bucket", F.ceil(F.col("rows") / HOT).cast("int").alias("parts"))
        hot = self.keep(hot, "hot")
        index = self.table.select("bucket", "rid", "far", F.lit(0).alias("part"), F.lit(True).alias("within"), *self.words)
        if not hot.isEmpty():
            # Crowded buckets are compared whole, in blocks: a row is in a block with each part of its bucket, and is
            # compared with the rows of that part only.
            hot = F.broadcast(hot) if fits_broadcast(hot, 16) else hot
            crowded = index.join(hot, "bucket").withColumn("part", F.pmod(F.xxhash64("rid", "bucket"), F.col("parts")).cast("int"))
            crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            block = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
            split = crowded.select(block.alias("bucket"), "rid", "far", "part", (F.col("part") == F.col("other")).alias("within"), *self.words)
            index = index.join(hot, "bucket", "left_anti").unionByName(split)
        a, b = index.alias("a"), index.alias("b")
        apart = F.col("a.within") | (F.col("a.part") != F.col("b.part"))
        near = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rid") < F.col("b.rid")) & apart & (self._differ() <= F.col("a.far")))
        one = self._compared(near)
        return one.unionByName(one.select("coll", F.col("other").alias("key"), F.col("key").alias("other"), "cos"))

    def probe(self, asked: DataFrame, flips: int) -> DataFrame:
        """(coll, key, other, cos): what lookups with up to ``flips`` bits flipped retrieve for the vectors (coll, key)
        ``asked``. Adaptive execution splits crowded buckets, as only one side of the join is the asked one."""
        a = self._lookups(self.rows.join(asked, ["coll", "key"], "left_semi"), flips).alias("a")
        b = self.table.alias("b")
        near = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rid") != F.col("b.rid")) & (self._differ() <= F.col("a.far")))
        return self._compared(near)

    def _compared(self, near: DataFrame) -> DataFrame:
        pairs = self.keep(near.select(F.col("a.rid").alias("ra"), F.col("b.rid").alias("rb")).distinct(), "pairs")
        ids = pairs.select(F.col("ra").alias("rid")).union(pairs.select("rb")).distinct()
        ids = F.broadcast(ids) if fits_broadcast(ids, 32) else ids
        floats = self.rows.join(ids, "rid", "left_semi").dropDuplicates(["coll", "key"])
        left = floats.select(F.col("rid").alias("ra"), F.col("coll"), F.col("key").alias("ka"), F.col("vec").alias("va"))
        right = floats.select(F.col("rid").alias("rb"), F.col("coll").alias("cb"), F.col("key").alias("kb"), F.col("vec").alias("vb"))
        # Ids are hashes: what two keys of one id bring along is compared as well, so a clash costs time but no vector.
        both = pairs.join(left, "ra").join(right, "rb").where(F.col("coll") == F.col("cb"))
        return self.keep(both.select("coll", "ka", "kb", "va", "vb").mapInArrow(_cosines(self.width), "coll string, key long, other long, cos double"), "cosines")


def nearest(vectors: DataFrame, width: int, k: int, keep: Callable[[DataFrame, str], DataFrame], asked: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    """(coll, key, other, cos, place): of every vector its ``k`` most similar others of its collection, best first.

    ``vectors`` comes from ``usable``; equal similarities rank by smaller key. ``asked`` (coll, key) names the vectors that are
    to get neighbours, all of them by default. Neighbours below ``floor`` aren't wanted; without a floor every vector gets
    ``k`` rows, or one for each other vector where there are fewer.

    Round r retrieves what agrees with a substring but for r bits, and a vector is done when its k-th neighbour is one that
    the round misses with probability MISS at most, or the round reaches that far below ``floor``. A round that would look at
    more than SCANNED of a collection isn't run; vectors that are left are compared with all others, block by block, so they
    lose nothing. For those alone the work grows with their number times the collection's.

    Vectors that are equal in every element are one class: a class is indexed once, stood for by its smallest key, and its
    members get their neighbours from it, so that copies are never compared pair by pair. Repeated rows of a key count once.
    A collection without usable vectors gives no rows.
    """
    keys = keep(vectors.select("coll", "key", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")).distinct(), "keys")
    rep = keys.groupBy("coll", "h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("coll", "h1", "h2", "rep")
    members = keep(keys.join(rep, ["coll", "h1", "h2"]).select("coll", "rep", "key"), "members")
    copies = members.where("key <> rep").select("coll", "key")
    copies = F.broadcast(copies) if fits_broadcast(copies, 64) else copies
    reps = vectors.join(copies, ["coll", "key"], "left_anti")
    index = Index(reps, width, keep, FULL if asked is None else PART)
    if index.codes is None:
        return vectors.sparkSession.createDataFrame([], "coll string, key long, other long, cos double, place int")

    def best(df: DataFrame, by: str, most: int) -> DataFrame:
        w = Window.partitionBy("coll", by).orderBy(F.desc("cos"), F.asc("other"))
        return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)

    # A class counts as a neighbour with its first members; k + 1 of them are enough, one may be the asking vector itself.
    order = Window.partitionBy("coll", "rep").orderBy("key")
    heads = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("coll", F.col("rep").alias("other"), F.col("key").alias("_m"))
    own = heads.select("coll", F.col("other").alias("key"), F.col("_m").alias("other"), F.lit(1.0).alias("cos"))

    def with_classes(pairs: DataFrame, of: DataFrame | None) -> DataFrame:
        wide = pairs.join(heads, ["coll", "other"], "left").select("coll", "key", F.coalesce("_m", "other").alias("other"), "cos")
        mine = own if of is None else own.join(of, ["coll", "key"], "left_semi")
        return best(wide.unionByName(mine), "key", k + 1).drop("place")

    wanted = None
    if asked is not None:
        wanted = asked.select("coll", "key").distinct().join(members, ["coll", "key"], "left").select("coll", F.coalesce("rep", "key").alias("key")).distinct()
        wanted = keep(wanted, "asked")
    left, parts = wanted, []
    sizes = [1 << e for e in range(int(math.log2(index.most)) + 1)]
    for flips in range(FLIPS + 1):
        reach = {e: index.codes.reached(n, flips) for e, n in enumerate(sizes)}
        if flips and min(reach.values()) > 1:
            continue
        pairs = index.within() if left is None else index.probe(left, flips)
        found = with_classes(pairs if floor is None else pairs.where(F.col("cos") >= floor), left)
        if floor is not None and max(reach.values()) <= floor:
            parts.append(found)
            left = None
            break
        found = keep(found, "round")
        at = F.floor(F.log2("n")).cast("int")
        limit = F.element_at(F.create_map(*[F.lit(x) for e in reach.items() for x in e]), at)
        every = index.rows.select("coll", "key", limit.alias("_limit")).distinct()
        every = every if left is None else every.join(left, ["coll", "key"], "left_semi")
        enough = F.count(F.when(F.col("cos") >= F.col("_limit"), 1)) >= k + F.max(F.coalesce((F.col("key") == F.col("other")).cast("int"), F.lit(0)))
        done = (enough | (F.first("_limit") <= F.lit(floor))) if floor is not None else enough
        state = keep(every.join(found, ["coll", "key"], "left").groupBy("coll", "key").agg(done.alias("done")), "state")
        parts.append(found.join(state.where("done"), ["coll", "key"], "left_semi"))
        left = state.where("NOT done").select("coll", "key")
        if left.isEmpty():
            left = None
            break
    if left is not None:
        exact = nearest_exact(reps, reps.join(left, ["coll", "key"], "left_semi"), width, k + 1, keep).drop("place")
        parts.append(with_classes(exact if floor is None else exact.where(F.col("cos") >= floor), left))
    of_reps = functools.reduce(DataFrame.unionByName, parts)
    of_all = of_reps.join(members.select("coll", F.col("rep").alias("key"), F.col("key").alias("_m")), ["coll", "key"], "left")
    of_all = of_all.select("coll", F.coalesce("_m", "key").alias("key"), "other", "cos").where(F.col("key") != F.col("other"))
    if asked is not None:
        of_all = of_all.join(asked.select("coll", "key").distinct(), ["coll", "key"], "left_semi")
    return best(of_all, "key", k)


def _exact_blocks(width: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            colls = np.array(b.column(0).to_pylist(), dtype=object)
            for coll in sorted(set(colls)):
                own = b.take(pa.array(np.flatnonzero(colls == coll)))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([coll]), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([flat], pa.list_(pa.float32()))], names=["coll", "keys", "flat"])

    return pack


def nearest_exact(vectors: DataFrame, asked: DataFrame, width: int, k: int, keep: Callable[[DataFrame, str], DataFrame], size: int = 1024) -> DataFrame:
    """(coll, key, other, cos, place): of every vector of ``asked`` its ``k`` most similar others of its collection, best
    first, at any similarity.

    Both come from ``usable``. All pairs are compared, block by block as products of matrices, so ``asked`` is to be a set
    of a stated size; of each block only ``k`` rows a vector go on. Similarities are rounded to 9 digits, so that copies tie;
    ties rank by smaller key. Of the rows of one key the smallest vector counts.
    """

    def blocks(df: DataFrame, label: str) -> DataFrame:
        one = df.groupBy("coll", "key").agg(F.min("vec").alias("vec"))
        return keep(one.mapInArrow(_exact_blocks(width, size), "coll string, keys array<long>, flat array<float>"), label)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (coll, qk, rk) in enumerate(zip(*(b.column(n) for n in (0, 1, 3)))):
                qk, rk = (x.values.to_numpy(zero_copy_only=False) for x in (qk, rk))
                qv, rv = b.column(2).slice(i, 1), b.column(4).slice(i, 1)
                order = np.argsort(rk)
                rk = rk[order]
                cos = np.minimum(np.round(unit_rows(qv, width) @ unit_rows(rv, width)[order].T, 9), 1.0)
                cos[qk[:, None] == rk[None, :]] = -np.inf
                most = min(k, len(rk))
                edge = -np.partition(-cos, most - 1, axis=1)[:, most - 1 : most]
                qi, ri = np.nonzero((cos >= edge) & (cos > -np.inf))
                best = np.lexsort((ri, -cos[qi, ri], qi))
                qi, ri = qi[best], ri[best]
                first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                qi, ri = qi[first], ri[first]
                yield pa.RecordBatch.from_arrays([pa.array([coll.as_py()] * len(qi), pa.string()), pa.array(qk[qi]), pa.array(rk[ri]), pa.array(cos[qi, ri])], names=["coll", "key", "other", "cos"])

    q, r = blocks(asked, "asked").alias("q"), blocks(vectors, "all").alias("r")
    # As a range, since an equality would bring all blocks of a collection into one task.
    met = r.join(q, (F.col("q.coll") <= F.col("r.coll")) & (F.col("q.coll") >= F.col("r.coll")))
    found = met.select("q.coll", F.col("q.keys").alias("qk"), F.col("q.flat").alias("qv"), F.col("r.keys").alias("rk"), F.col("r.flat").alias("rv")).mapInArrow(meet, "coll string, key long, other long, cos double")
    w = Window.partitionBy("coll", "key").orderBy(F.desc("cos"), F.asc("other"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
