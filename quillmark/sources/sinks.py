"""Writing: JSON lines, appended logs, keyed tables, small reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import without_nul


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def keyed_table(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 64) -> None:
    """A managed table; bucketed by a join key, later joins on it need no shuffle."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    clean = df.withColumns({c: without_nul(F.col(c)) for c in text})
    writer = clean.write.mode("overwrite")
    (writer.bucketBy(buckets, bucket).sortBy(bucket) if bucket else writer).saveAsTable(name)


def by_run(df: DataFrame, path: str, keys: list[str]) -> None:
    """A partitioned table in which only the partitions written to are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def report_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """A small result as one nested JSON document, keyed by the given columns. A report has a row per system, not per
    datum; beyond 100,000 rows it is refused."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("too many rows for a report")
    out: dict = {}
    for row in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(row.pop(k)), {})
        at[str(row.pop(keys[-1]))] = row
    with open(path, "w") as f:
        json.dump(out, f, indent=2, sort_keys=True)


def markdown(df: DataFrame, columns: dict[str, Column], order: list[Column]) -> str:
    """A leaderboard as a Markdown table, of formatted columns; refused beyond 1,000 rows."""
    rows = df.orderBy(*order).select(*[c.cast("string").alias(n) for n, c in columns.items()]).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many rows for a leaderboard")
    lines = [list(columns), ["---"] * len(columns), *[["" if x is None else x for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): columns padded to widths, numbers to the right."""
    kind = dict(df.dtypes)
    pad = lambda c, n: (F.rpad if kind[c] == "string" else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    return df.select(F.concat_ws(" ", *[pad(c, n) for c, n in widths.items()]).alias("line"))


def spliced(text: str, start: str, end: str, inner: str) -> str:
    """The text with what stands between two markers replaced."""
    a = text.index(start) + len(start)
    return f"{text[:a]}\n{inner}\n{text[text.index(end, a):]}"


def imported_vectors(source: DataFrame, path: str, count: int, width: int, vec: str = "vec") -> None:
    """Copies vectors of another table after checking their number and width."""
    facts = source.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(vec) != width, 1)).alias("bad")).first()
    if facts["n"] != count or facts["bad"]:
        raise ValueError(f"{facts['n']} vectors, {facts['bad']} of another width; {count} of {width} expected")
    source.write.mode("overwrite").parquet(path)
