"""Seeded samples that replay a sequential generator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.numeric import uniform, uniforms


def shuffled_first(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """(stratum, key, place): the first ``n`` of each stratum after a Fisher-Yates shuffle in key order.

    Each swap depends on those before, so a stratum is shuffled in one task; it holds keys only.
    """

    def shuffle(df: pd.DataFrame) -> pd.DataFrame:
        pool, draw = sorted(df[key]), uniforms(seed)
        for k in range(len(pool) - 1, 0, -1):
            j = int(next(draw) * (k + 1))
            pool[k], pool[j] = pool[j], pool[k]
        return pd.DataFrame({stratum: df[stratum].iloc[0], key: pool[:n], "place": range(1, min(n, len(pool)) + 1)})

    kind = rows.schema
    return rows.select(stratum, key).where(F.col(stratum).isNotNull() & F.col(key).isNotNull()).distinct().groupBy(stratum).applyInPandas(shuffle, f"{stratum} {kind[stratum].dataType.simpleString()}, {key} {kind[key].dataType.simpleString()}, place int")


def random_others(queries: DataFrame, barred: DataFrame, passages: int, count: int, seed: int = 42) -> DataFrame:
    """(query, draw, ord): ``count`` passages per query, with replacement, none that is barred for it.

    One generator runs through the queries in order and skips barred draws, so each draw depends on all before: the
    replay is one task over the query set, with each query's barred passages beside it.
    """
    listed = queries.select("query").distinct().join(barred.groupBy("query").agg(F.collect_set("ord").alias("barred")), "query", "left")

    def draw(df: pd.DataFrame) -> pd.DataFrame:
        df, stream, out = df.sort_values("query"), uniforms(seed), []
        for q, bad in zip(df["query"], df["barred"]):
            bad, got = set(bad if bad is not None else ()), 0
            if passages and len(bad) < passages:
                while got < count:
                    i = int(next(stream) * passages)
                    if i not in bad:
                        out.append((q, got, i))
                        got += 1
        return pd.DataFrame(out, columns=["query", "draw", "ord"])

    kind = queries.schema["query"].dataType.simpleString()
    return listed.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(draw, f"query {kind}, draw int, ord long")


def hashed_others(queries: DataFrame, passages: int, count: int, seed: int = 42) -> DataFrame:
    """(query, draw, ord): the same kind of sample without the replay, any number of queries at once: numbers of the
    counter-based stream, a query's own starting at a hash of it. Barred passages are left to an anti-join."""
    each = queries.select("query").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    start = F.pmod(F.xxhash64("query"), F.lit(1 << 32))
    return each.withColumn("ord", F.floor(uniform(start + F.col("draw"), seed) * F.lit(passages)).cast("long"))
