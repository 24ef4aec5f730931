"""Value frequencies: distinct counts, most frequent values, imbalance, dates, booleans.

Columns of one type share one unpivot and one aggregation by (variable, value). Equal
values are combined before the shuffle, so a very frequent value is one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ...session import written
from .columns import columns_of_kind, kind_of, present


def _storage_type(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
        return "string"
    return dt.simpleString()


# Texts longer than this travel as digests where only their equality matters. A digest is
# longer still, so it never equals a text that was left as it is.
DIGEST_ABOVE = 64


def _digest(c: Column) -> Column:
    return F.when(F.octet_length(c) > DIGEST_ABOVE, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def value_frequencies(
    df: DataFrame, columns: list[str] | None = None, keys: list[str] = (), digest: bool = False
) -> list[DataFrame]:
    """``(keys, variable, value, n)`` with nulls kept, one DataFrame per value type.

    With ``digest`` long texts are replaced by their SHA-256, so that documents do not
    cross the network to be counted.
    """
    keys = list(keys)
    by_type: dict[str, list[str]] = {}
    for c in columns or [c for c in df.columns if c not in keys]:
        by_type.setdefault(_storage_type(df.schema[c].dataType), []).append(c)
    frames = []
    for value_type, names in by_type.items():
        values = {c: present(df, c).cast(value_type) for c in names}
        if digest and value_type == "string":
            values = {c: _digest(v) for c, v in values.items()}
        cells = df.select(*keys, *[v.alias(c) for c, v in values.items()])
        cells = cells.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in names], "variable", "value")
        frames.append(cells.groupBy(*keys, "variable", "value").agg(F.count(F.lit(1)).alias("n")))
    return frames


_COUNTS = ("n", "n_missing", "n_distinct", "n_unique")


def frequency_summary(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """Per column: rows, missing, distinct values, values seen once, and the sum of n log n."""
    keys = list(keys)
    names = list(columns or [c for c in df.columns if c not in keys])
    seen = F.col("value").isNotNull()
    parts = [
        f.groupBy(*keys, "variable").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("n_missing"),
            F.count("value").alias("n_distinct"),
            F.count_if(seen & (F.col("n") == 1)).alias("n_unique"),
            F.coalesce(F.sum(F.when(seen, F.col("n") * F.log2("n"))), F.lit(0.0)).alias("n_log_n"),
        )
        for f in value_frequencies(df, names, keys, digest=True)
    ]
    if keys:
        return reduce(DataFrame.unionByName, parts)
    # A table without rows still has its variables.
    zeros = df.sparkSession.range(1).select(
        F.explode(F.lit(names)).alias("variable"),
        *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS],
        F.lit(0.0).alias("n_log_n"),
    )
    merged = reduce(DataFrame.unionByName, [*parts, zeros])
    return merged.groupBy("variable").agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "n_log_n")])


def distinct_metrics() -> list[Column]:
    """Counts and shares from a frequency summary; distinct and unique are of the present rows."""
    present_rows = F.col("n") - F.col("n_missing")
    return [
        F.col("n"),
        F.col("n_missing"),
        F.coalesce(F.try_divide(F.col("n_missing"), F.col("n")), F.lit(0.0)).alias("p_missing"),
        F.col("n_distinct"),
        F.coalesce(F.try_divide(F.col("n_distinct"), present_rows), F.lit(0.0)).alias("p_distinct"),
        F.col("n_unique"),
        F.coalesce(F.try_divide(F.col("n_unique"), present_rows), F.lit(0.0)).alias("p_unique"),
        ((present_rows > 0) & (F.col("n_unique") == present_rows)).alias("is_unique"),
    ]


def imbalance_metric() -> Column:
    """1 less the entropy of the values as a share of its maximum; 0 for a single value."""
    rows = F.col("n") - F.col("n_missing")
    entropy = F.log2(rows) - F.col("n_log_n") / rows
    return F.when(F.col("n_distinct") > 1, 1 - entropy / F.log2("n_distinct")).otherwise(F.lit(0.0))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """Per column: rows, missing, distinct values, values seen once, and their shares."""
    return frequency_summary(df, columns, keys).select(*keys, "variable", *distinct_metrics())


def imbalance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(variable, imbalance)`` of the categorical and boolean columns."""
    names = columns or columns_of_kind(df, "Categorical") + columns_of_kind(df, "Boolean")
    return frequency_summary(df, names).select("variable", imbalance_metric().alias("imbalance"))


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 10, keys: list[str] = ()) -> DataFrame:
    """The ``n`` most frequent present values per column: ``(keys, variable, rank, value, count)``.

    Ties go to the lower value. Each task keeps its own best ``n`` before rows move.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys, "variable").orderBy(F.desc("n"), "value")
    parts = [
        f.where("value is not null")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(*keys, "variable", "rank", F.col("value").cast("string").alias("value"), F.col("n").alias("count"))
        for f in value_frequencies(df, columns, keys)
    ]
    return reduce(DataFrame.unionByName, parts)


# Frequent values by sketch: values that a sketch tracks, candidates counted per wanted value, buckets of the others.
TRACKED, CANDIDATES, BUCKETS = 4096, 8, 4096


def frequent_values(df: DataFrame, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """``top_values`` without a shuffle of all distinct values, where that can be proven right.

    A first scan sketches each column's frequent values; the sketches merge. A second one
    counts the best candidates exactly and all other rows by a hash of their value into
    ``BUCKETS`` buckets, so only candidates and buckets are shuffled. No other value can
    have more rows than the fullest bucket: if the ``n``-th candidate has more, or no row
    lies outside the candidates, the column is done. The rest, such as columns whose values
    are all different, takes the way of ``top_values``. Results are equal in any case.
    """
    names = list(columns or df.columns)
    by_type: dict[str, list[str]] = {}
    for c in names:
        by_type.setdefault(_storage_type(df.schema[c].dataType), []).append(c)
    parts, proven = [], []
    for value_type, own in by_type.items():
        cells = df.select(*[present(df, c).cast(value_type).alias(c) for c in own])
        cells = cells.unpivot([], [F.col(f"`{c}`") for c in own], "variable", "value").where("value IS NOT NULL")
        sketched = cells.groupBy("variable").agg(F.expr(f"approx_top_k(string(value), {CANDIDATES * n}, {max(TRACKED, CANDIDATES * n)})").alias("top"))
        # At most CANDIDATES * n values per column.
        few = sketched.select("variable", F.explode("top.item").alias("_text")).withColumn("_hit", F.lit(True))
        text = F.col("value").cast("string")
        met = cells.withColumn("_text", text).join(F.broadcast(few), ["variable", "_text"], "left")
        bucket = F.when(F.col("_hit").isNull(), F.pmod(F.xxhash64("_text"), F.lit(BUCKETS)))
        counted = met.groupBy("variable", F.when(F.col("_hit"), F.col("value")).alias("value"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        counted = written(counted, "candidates")
        order = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
        best = counted.where("bucket IS NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        others = counted.groupBy("variable").agg(F.coalesce(F.max(F.when(F.col("bucket").isNotNull(), F.col("n"))), F.lit(0)).alias("most"))
        last = best.groupBy("variable").agg(F.min("n").alias("least"), F.max("rank").alias("found"))
        sure = (F.col("most") == 0) | ((F.col("found") == n) & (F.col("least") > F.col("most")))
        done = {r["variable"] for r in others.join(last, "variable").where(sure).select("variable").collect()}
        proven += done
        parts.append(
            best.where(F.col("variable").isin(*done)).select("variable", "rank", F.col("value").cast("string").alias("value"), F.col("n").alias("count"))
        )
    rest = [c for c in names if c not in proven]
    if rest:
        parts.append(top_values(df, rest, n))
    return reduce(DataFrame.unionByName, parts)


# Registers of a sketch of distinct values, as a power of two: its estimate is off by 0.9 % in two of three cases.
HLL_BITS = 14


def approximate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``frequency_summary`` in one scan without a shuffle of values; distinct values are estimated.

    Values seen once and the entropy cannot be told from a sketch, and are null.
    """
    names = list(columns or df.columns)
    cells = df.select(*[present(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    figures = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        figures += [F.count(f"v{i}").alias(f"p{i}"), F.expr(f"hll_sketch_estimate(hll_sketch_agg(string(v{i}), {HLL_BITS}))").alias(f"d{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("variable"), F.col("n"), (F.col("n") - F.col(f"p{i}")).alias("n_missing"),
            F.when(F.col(f"p{i}") > 0, F.col(f"d{i}")).otherwise(F.lit(0).cast("bigint")).alias("n_distinct"),
            F.lit(None).cast("bigint").alias("n_unique"), F.lit(None).cast("double").alias("n_log_n"),
        )
        for i, c in enumerate(names)
    ]
    return cells.agg(*figures).select(F.inline(F.array(*rows)))


def datetime_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per date or time column: rows, missing, earliest, latest and the seconds between."""
    names = columns_of_kind(df, "DateTime", columns)
    if not names:
        raise ValueError("no date or time columns to profile")
    aggregates = []
    for i, c in enumerate(names):
        value = F.col(f"`{c}`").cast("timestamp")
        aggregates += [F.count(value).alias(f"c{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates)
    structs = []
    for i, c in enumerate(names):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        structs.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.col("n"),
                (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
                lo.alias("min"),
                hi.alias("max"),
                ((F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(1e6)).alias("range_seconds"),
            )
        )
    return row.select(F.inline(F.array(*structs)))


def boolean_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per value of each boolean column, missing ones included."""
    names = [c for c in (columns or df.columns) if kind_of(df.schema[c].dataType) == "Boolean"]
    if not names:
        raise ValueError("no boolean columns to profile")
    frame = value_frequencies(df, names)[0]
    return frame.select("variable", F.col("value").cast("string").alias("value"), F.col("n").alias("count"))
