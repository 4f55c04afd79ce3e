"""Analytics of the call log: latest rows, failures, latency, ties, stability and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.stats import order_statistics

CALL = ["machine", "ranker", "repeat_no", "question"]
# Messages of refusals by one's own account, and of faults worth another attempt.
REFUSED = r"(?i)no credits|insufficient_quota|billing|payment required|organization max RPM|rate_limit_reached_error|rate limit reached for .+ in organization"
RETRYABLE = r"(?i)\b(408|409|429|5\d\d)\b|internal server error|service ?unavailable|throttl|rate.?limit|too many requests|overloaded|timed? ?out|ECONNRESET|ETIMEDOUT|EAI_AGAIN|socket hang up|fetch failed|network"


def refused(error: Column) -> Column:
    return F.coalesce(error, F.lit("")).rlike(REFUSED)


def retryable(error: Column) -> Column:
    return F.coalesce(error, F.lit("")).rlike(RETRYABLE)


def latest(calls: DataFrame, keys: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """The last appended row of each call. Repeated rows are one row; null keys are keys.

    A maximum by key with partial aggregation picks the lines; the rows follow by a semi-join on the unique line number.
    """
    last = calls.groupBy(*(keys or CALL)).agg(F.max(order).alias(order)).select(order)
    return calls.join(last, order, "left_semi").dropDuplicates([order])


def counted(calls: DataFrame) -> DataFrame:
    """Latest rows without the calls our own account refused."""
    return latest(calls).where(~refused(F.col("error")))


def uncached() -> Column:
    """Calls whose prompt wasn't mostly served from a cache."""
    read = F.coalesce("cachedtokens", F.lit(0))
    return (read == 0) | (read < F.col("inputtokens") / 2)


def latency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p50, p95) of uncached calls, end to end where that was timed."""
    ms = rows.where(uncached()).withColumn("_ms", F.coalesce("totalms", "ms"))
    q = order_statistics(ms, keys, "_ms", {"p50": 0.5, "p95": 0.95})
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s)
    return q.groupBy(*keys, "n").agg(pick("p50"), pick("p95"))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates per group: calls, failures, untimed retries, reasoning share, coverage and mean tokens."""
    yes = lambda c: F.count(F.when(c, 1))
    answered = F.col("scores").isNotNull() & F.col("covered").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        yes(F.col("error").isNotNull()).alias("failures"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("failure_rate"),
        yes((F.col("attempts") > 1) & F.col("totalms").isNull()).alias("untimed_retries"),
        F.avg((F.coalesce("reasoningtokens", F.lit(0)) > 0).cast("double")).alias("reasoning_rate"),
        yes(answered).alias("coverage_recorded"),
        F.avg(F.when(answered, (F.col("covered") >= F.size("scores")).cast("double"))).alias("full_coverage"),
        F.avg("inputtokens").alias("input_tokens"),
        F.avg("outputtokens").alias("output_tokens"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )


def throughput(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens_per_second): tokens over summed request time, a ratio of sums."""
    good = F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") > 0)
    return rows.where(good).groupBy(*keys).agg((F.sum(F.coalesce("inputtokens", F.lit(0)) + F.coalesce("outputtokens", F.lit(0))) / (F.sum("ms") / 1000)).alias("tokens_per_second"))


def tie_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scored, tie_rate): share of scored calls whose two best scores are equal; 0 without any. A missing
    score equals none."""
    best = F.sort_array("scores", asc=False)
    scored = F.size("scores") > 1
    tied = F.when(scored, F.coalesce(best[0] == best[1], F.lit(False)).cast("double"))
    return rows.groupBy(*keys).agg(F.count(F.when(scored, 1)).alias("scored"), F.coalesce(F.avg(tied), F.lit(0.0)).alias("tie_rate"))


def ordered(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, passage, rank): each call's passages by score, ties and missing scores in the given order.

    A missing or NaN score counts 0; a call without scores keeps its order.
    """
    zero = lambda s: F.when(s.isNull() | F.isnan(s), F.lit(0.0)).otherwise(s)
    pairs = F.transform("order_ids", lambda p, i: F.struct((-F.coalesce(zero(F.get("scores", i)), F.lit(0.0))).alias("s"), i.alias("i"), p.alias("p")))
    return rows.where(F.col("order_ids").isNotNull()).select(*keep, F.posexplode(F.array_sort(pairs)).alias("rank", "x")).select(*keep, (F.col("rank") + 1).alias("rank"), F.col("x.p").alias("passage"))


def stability(rows: DataFrame, first: str, keys: list[str]) -> DataFrame:
    """(keys, questions, stability): share of questions asked more than once whose first choice is always the same; null
    where none is asked twice."""
    per = rows.groupBy(*keys, "question").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(first).alias("_d"))
    return per.groupBy(*keys).agg(F.count(F.when(F.col("_n") > 1, 1)).alias("questions"), F.avg(F.when(F.col("_n") > 1, (F.col("_d") == 1).cast("double"))).alias("stability"))


def pending(calls: DataFrame) -> DataFrame:
    """The calls that a resumed run must make again: those without a row that settled them.

    A row settles its call unless it failed by our account's refusal or by a fault worth another attempt.
    """
    settled = calls.where(F.col("error").isNull() | ~(refused(F.col("error")) | retryable(F.col("error")))).select(*CALL).distinct()
    asked = calls.select(*CALL).distinct()
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in CALL]
    return asked.alias("a").join(settled.alias("s"), on[0] & on[1] & on[2] & on[3], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_o"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")
