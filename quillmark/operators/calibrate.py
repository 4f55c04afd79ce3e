"""Distance cutoffs: histograms, noise floors and how they carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import strict_from_tail
from quillmark.operators.stats import order_statistics

BINS, WIDTH = 100, 0.02
LEVELS = {"strict": 0.001, "balanced": 0.01, "loose": 0.05}


def flattened(sets: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys, value): the countable distances of a list column, 0 to 2; equal rows are one row."""
    rows = sets.select(*keys, "question", "random", "relevant").distinct().select(*keys, F.explode(field).alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("value").between(0, 2))


def histogram(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n): counts in a hundred bins over 0 to 2, empty ones too."""
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col("value") * 50))).cast("int")
    counts = values.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fullest_bin(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n): the fullest bin, the lowest of equals."""
    best = bins.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(*keys, (-F.col("m.b")).alias("bin"), F.col("m.n").alias("n"))


def floors(random: DataFrame, keys: list[str], levels: dict[str, float] | None = None) -> DataFrame:
    """(keys, level, cutoff): the distance below which a level's share of random pairs falls, by nearest rank."""
    return order_statistics(random, keys, "value", levels or LEVELS, nearest=True).select(*keys, F.col("stat").alias("level"), F.col("value").alias("cutoff"))


def share_below(values: DataFrame, cutoffs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, level, cutoff, name): the share of values strictly below each cutoff of their group."""
    return values.join(cutoffs, keys).groupBy(*keys, "level", "cutoff").agg(F.avg((F.col("value") < F.col("cutoff")).cast("double")).alias(name))


def leave_one_out(random: DataFrame, relevant: DataFrame, by: list[str], set_: str) -> DataFrame:
    """(by, set, level, cutoff, keeps, lets): each set held to the floors of the other sets.

    The others' values aren't copied out per set: their quantile over the union is searched in counts by value, of which a
    set's own are taken off.
    """
    counts = random.groupBy(*by, set_, "value").agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.groupBy(*by, "value").agg(F.sum("c").alias("c"))
    sets = counts.select(*by, set_).distinct()
    rest = sets.join(all_, by).join(counts.withColumnRenamed("c", "own"), [*by, set_, "value"], "left")
    rest = rest.select(*by, set_, "value", (F.col("c") - F.coalesce("own", F.lit(0))).alias("c")).where("c > 0")
    w = Window.partitionBy(*by, set_)
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("_upto", F.sum("c").over(upto)).withColumn("_n", F.sum("c").over(w))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("q")) for k, v in LEVELS.items()])).alias("l")
    at = rest.select("*", levels).withColumn("_r", F.floor(F.col("l.q") * (F.col("_n") - 1) + 0.5))
    cut = at.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("c"))).select(*by, set_, F.col("l.level").alias("level"), F.col("value").alias("cutoff"))
    keys = [*by, set_]
    keeps = share_below(relevant, cut, keys, "keeps")
    lets = share_below(random, cut, keys, "lets")
    return lets.join(keeps.drop("cutoff"), [*keys, "level"], "left").select(*keys, "level", "cutoff", "keeps", "lets")


def levels_of(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, strict, balanced, loose): levels set from distances of unrelated pairs, of which ``statistics`` has (keys, least,
    stat, value) for the balanced and the loose level; strict follows the tail."""
    at = lambda stat: F.max(F.when(F.col("stat") == stat, F.col("value"))).alias(stat)
    wide = statistics.groupBy(*keys, "least").agg(at("balanced"), at("loose"))
    return wide.select(*keys, strict_from_tail(F.col("balanced"), F.col("loose"), F.col("least")).alias("strict"), "balanced", "loose")


def style_levels(nulls: DataFrame, keys: list[str]) -> DataFrame:
    """The same from rows (keys, value) of unrelated distances."""
    q = order_statistics(nulls, keys, "value", {"balanced": LEVELS["balanced"], "loose": LEVELS["loose"]}, nearest=True)
    return levels_of(q.join(nulls.groupBy(*keys).agg(F.min("value").alias("least")), keys), keys)


def transfer(random: DataFrame, relevant: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, aim, cutoff, lets, keeps, within): whether a cutoff lets through half to double its aimed share."""
    lets = share_below(random, cutoffs.drop("aim"), keys, "lets")
    keeps = share_below(relevant, cutoffs.drop("aim"), keys, "keeps").drop("cutoff")
    both = lets.join(keeps, [*keys, "level"], "left").join(cutoffs.select(*keys, "level", "aim"), [*keys, "level"])
    return both.select(*keys, "level", "aim", "cutoff", "lets", "keeps", F.col("lets").between(F.col("aim") / 2, F.col("aim") * 2).alias("within"))
