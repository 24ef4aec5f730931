"""Profiles of tables, columns and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.plans.profiling import profile_dataset, profile_feature_group, profile_online_group, profile_training_set
from tabloom.session import scratch_path, scratch_table
from tabloom.sources.tables import append_rows, save_feature_table, save_training_set

from .base import ORACLES, load, query, settle, settled_sql, sql_list

NUMBERS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)
COLUMNS = (*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")

# Line items with nulls, a constant and a unique column planted.
PLANTED = (
    "l_orderkey",
    "l_orderkey * 10 + l_linenumber AS line_id",
    "nullif(l_tax, 0.05) AS l_tax",
    "CASE WHEN l_orderkey = 7 AND l_linenumber = 1 THEN 1e9 ELSE 1.0 END AS spike",
    "nullif(l_returnflag, 'A') AS l_returnflag",
    "'same' AS constant",
    "CASE WHEN l_partkey < 5 THEN 'rare' ELSE 'usual' END AS uneven",
    "concat('o', CAST(l_orderkey AS {text})) AS label",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_linestatus",
    "l_shipdate",
)
PLANTED_SQL = "SELECT " + ", ".join(p.format(text="VARCHAR") for p in PLANTED) + " FROM lineitem"


def planted(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(*[p.format(text="string") for p in PLANTED])


def counts_sql(c: str, source: str) -> str:
    """Metrics every column has."""
    once = f"(SELECT count(*) FROM (SELECT {c} FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1))"
    return f"""count(*) AS n, count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*) AS p_missing,
      count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count({c}) AS p_distinct,
      {once} AS n_unique, {once} / count({c}) AS p_unique, count(*) > 0 AND {once} = count({c}) AS is_unique"""


def moments_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""avg({v}) AS mean, stddev_samp({v}) AS std, var_samp({v}) AS variance, min({v}) AS min, max({v}) AS max,
      max({v}) - min({v}) AS range, sum({v}) AS sum, CASE WHEN avg({v}) <> 0 THEN stddev_samp({v}) / avg({v}) END AS cv,
      count(*) FILTER ({c} < 0) AS n_negative, count(*) FILTER ({c} < 0) / count(*) AS p_negative,
      count(*) FILTER ({c} = 0) AS n_zeros, count(*) FILTER ({c} = 0) / count(*) AS p_zeros,
      count(*) FILTER (isinf({v})) AS n_infinite, count(*) FILTER (isinf({v})) / count(*) AS p_infinite,
      CASE WHEN var_samp({v}) = 0 THEN 0 ELSE skewness({v}) END AS skewness,
      CASE WHEN var_samp({v}) = 0 THEN 0 ELSE kurtosis({v}) END AS kurtosis"""


def quantiles_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    parts = [f"quantile_cont({v}, {p}) AS q{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return ", ".join(parts) + f", quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr"


MOMENTS = (
    "mean", "std", "variance", "min", "max", "range", "sum", "cv", "n_negative", "p_negative", "n_zeros", "p_zeros",
    "n_infinite", "p_infinite", "skewness", "kurtosis",
)
DOUBLES = set(MOMENTS) - {"n_negative", "n_zeros", "n_infinite"} | {"p_missing", "p_distinct", "p_unique"}


QUANTILES = ("q05", "q25", "q50", "q75", "q95", "iqr")


def settled_columns(columns) -> str:
    return ", ".join(f"{settled_sql(c)} AS {c}" if c in DOUBLES or c[0] == "q" or c in ("iqr", "mad", "median") else c for c in columns)


def numeric_sql(columns, source: str, keys: str = "") -> str:
    head = ["n", "n_missing", "p_missing"]
    group = f" GROUP BY {keys}" if keys else ""
    prefix = f"{keys}, " if keys else ""
    parts = [
        f"""SELECT {prefix}'{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_missing,
            (count(*) - count({c})) / count(*) AS p_missing, {moments_sql(c)} FROM ({source}){group}"""
        for c in columns
    ]
    return f"SELECT {prefix}variable, {settled_columns([*head, *MOMENTS])} FROM ({' UNION ALL '.join(parts)})"


PLANTED_NUMBERS = ("l_orderkey", "line_id", "l_tax", "spike", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
PLANTED_TEXTS = ("l_returnflag", "constant", "uneven", "label", "l_linestatus")
PLANTED_NAMES = (*PLANTED_NUMBERS, *PLANTED_TEXTS, "l_shipdate")


@query(
    "profile_table",
    f"""
    SELECT count(*) AS n_rows, {len(PLANTED_NAMES)} AS n_columns,
      count(*) * {len(PLANTED_NAMES)} - {" - ".join(f"count({c})" for c in PLANTED_NAMES)} AS n_cells_missing,
      round((count(*) * 2 - count(l_tax) - count(l_returnflag)) / (count(*) * {len(PLANTED_NAMES)}), 6) AS p_cells_missing,
      2 AS n_vars_with_missing, {len(PLANTED_NUMBERS)} AS n_numeric, {len(PLANTED_TEXTS)} AS n_categorical, 1 AS n_datetime, 0 AS n_boolean
    FROM ({PLANTED_SQL})""",
)
def profile_table(spark, sf):
    return settle(P.table_profile(planted(spark, sf)))


COUNTS = ("n", "n_missing", "p_missing", "n_distinct", "p_distinct", "n_unique", "p_unique", "is_unique")


def columns_sql(columns, source: str) -> str:
    parts = [f"SELECT '{c}' AS variable, {counts_sql(c, source)} FROM ({source})" for c in columns]
    return f"SELECT variable, {settled_columns(COUNTS)} FROM ({' UNION ALL '.join(parts)})"


@query("profile_columns", columns_sql(PLANTED_NAMES, PLANTED_SQL))
def profile_columns(spark, sf):
    return settle(P.distinct_counts(planted(spark, sf)))


@query("profile_numeric", numeric_sql(NUMBERS, "SELECT * FROM lineitem"))
def profile_numeric(spark, sf):
    return settle(P.numeric_profile(load(spark, sf, "lineitem")))


@query(
    "profile_quantiles",
    "SELECT variable, "
    + settled_columns(["q05", "q25", "q50", "q75", "q95", "iqr"])
    + " FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, {quantiles_sql(c)} FROM lineitem" for c in NUMBERS)
    + ")",
)
def profile_quantiles(spark, sf):
    return settle(P.quantiles(load(spark, sf, "lineitem")))


@query(
    "profile_mad",
    "SELECT variable, "
    + settled_columns(["median", "mad"])
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, median(CAST({c} AS DOUBLE)) AS median, mad(CAST({c} AS DOUBLE)) AS mad FROM lineitem"
        for c in NUMBERS
    )
    + ")",
)
def profile_mad(spark, sf):
    return settle(P.median_absolute_deviation(load(spark, sf, "lineitem")))


def histogram_sql(c: str, source: str) -> str:
    """Edges and counts of 50 bins; a constant column lies in the middle of a range of width 1."""
    return f"""
    SELECT '{c}' AS variable, CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / 50) AS lower,
      lo + (b.bin + 1) * ((hi - lo) / 50) AS upper, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(50)) AS bin) b
    CROSS JOIN (SELECT CASE WHEN lo < hi THEN lo ELSE lo - 0.5 END AS lo, CASE WHEN lo < hi THEN hi ELSE lo + 0.5 END AS hi
      FROM (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM ({source})))
    LEFT JOIN (SELECT least(49, floor((v - CASE WHEN lo < hi THEN lo ELSE lo - 0.5 END)
        / CASE WHEN lo < hi THEN hi - lo ELSE 1 END * 50)) AS bin, count(*) AS n
      FROM (SELECT CAST({c} AS DOUBLE) AS v FROM ({source})),
           (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM ({source}))
      WHERE v IS NOT NULL GROUP BY 1) h
    ON h.bin = b.bin WHERE lo IS NOT NULL"""


@query(
    "profile_histogram",
    "SELECT variable, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count FROM ("
    + " UNION ALL ".join(histogram_sql(c, "SELECT * FROM lineitem") for c in NUMBERS)
    + ")",
)
def profile_histogram(spark, sf):
    found = P.histogram(load(spark, sf, "lineitem"))
    return found.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query(
    "profile_value_counts",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS variable, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
        CAST({c} AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY {c}) WHERE rank <= 10"""
        for c in COLUMNS
    ),
)
def profile_value_counts(spark, sf):
    return P.top_values(load(spark, sf, "lineitem"))


@query("profile_frequent_values", ORACLES["profile_value_counts"])
def profile_frequent_values(spark, sf):
    return P.frequent_values(load(spark, sf, "lineitem"))


@query(
    "profile_datetime",
    """
    SELECT 'ts' AS variable, count(*) AS n, count(*) - count(ts) AS n_missing,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS min, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS max,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS range_seconds
    FROM (SELECT CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events)""",
)
def profile_datetime(spark, sf):
    rows = load(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return P.datetime_profile(rows).withColumns(
        {
            "min": F.date_format("min", pattern),
            "max": F.date_format("max", pattern),
            "range_seconds": F.round("range_seconds", 0),
        }
    )


FLAGS = {"is_error": "event_type = 'error'", "is_large": "CASE WHEN event_type <> 'view' THEN value > 20 END"}


@query(
    "profile_boolean",
    " UNION ALL ".join(
        f"SELECT '{n}' AS variable, CAST({e} AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY ALL"
        for n, e in FLAGS.items()
    ),
)
def profile_boolean(spark, sf):
    return P.boolean_counts(load(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in FLAGS.items()]))


def alerts_sql(numeric, text, source: str, times=()) -> str:
    rules = []
    for c in (*numeric, *text, *times):
        common = f"(SELECT {counts_sql(c, source)} FROM ({source}))"
        rules += [
            f"SELECT '{c}' AS variable, 'CONSTANT' AS alert FROM {common} WHERE n_distinct = 1",
            f"SELECT '{c}', 'MISSING' FROM {common} WHERE p_missing > 0.01",
            f"SELECT '{c}', 'UNIQUE' FROM {common} WHERE is_unique",
        ]
    for c in numeric:
        common = f"(SELECT {moments_sql(c)} FROM ({source}))"
        rules += [
            f"SELECT '{c}', 'ZEROS' FROM {common} WHERE p_zeros > 0.01",
            f"SELECT '{c}', 'INFINITE' FROM {common} WHERE p_infinite > 0.01",
            f"SELECT '{c}', 'SKEWED' FROM {common} WHERE abs(skewness) > 20",
        ]
    for c in text:
        rules += [
            f"SELECT '{c}', 'HIGH_CARDINALITY' FROM (SELECT count(DISTINCT {c}) AS d FROM ({source})) WHERE d > 50",
            f"SELECT '{c}', 'IMBALANCE' FROM (SELECT {imbalance_sql(c, source)} AS s) WHERE s > 0.5",
        ]
    return " UNION ALL ".join(rules)


def imbalance_sql(c: str, source: str) -> str:
    return f"""(SELECT CASE WHEN count(*) > 1 THEN 1 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) ELSE 0 END
      FROM (SELECT count(*) AS n FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c}))"""


@query("profile_alerts", alerts_sql(PLANTED_NUMBERS, PLANTED_TEXTS, PLANTED_SQL, ("l_shipdate",)))
def profile_alerts(spark, sf):
    return P.alerts(planted(spark, sf))


MONOTONIC = {"o_orderkey": "o_orderkey", "backwards": "-o_orderkey", "steps": "floor(o_orderkey / 100)", "o_totalprice": "o_totalprice"}


@query(
    "profile_monotonic",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS variable, bool_and(v >= p) AS increasing, bool_and(v <= p) AS decreasing,
        bool_and(v > p) AS strictly_increasing, bool_and(v < p) AS strictly_decreasing
        FROM (SELECT {e} AS v, lag({e}) OVER (ORDER BY o_orderkey) AS p FROM orders)"""
        for n, e in MONOTONIC.items()
    ),
)
def profile_monotonic(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS k", *[f"{e} AS {n}" for n, e in MONOTONIC.items()])
    return P.monotonic_profile(rows, "k", list(MONOTONIC))


@query("profile_grouped", numeric_sql(NUMBERS, "SELECT * FROM lineitem", "l_returnflag"))
def profile_grouped(spark, sf):
    return settle(P.grouped_profile(load(spark, sf, "lineitem"), ["l_returnflag"]))


@query(
    "profile_grouped_quantiles",
    f"SELECT event_type, variable, {settled_columns(QUANTILES)} FROM ("
    + " UNION ALL ".join(
        f"SELECT event_type, '{c}' AS variable, {quantiles_sql(c)} FROM events GROUP BY event_type"
        for c in ("event_id", "user_id", "value")
    )
    + ")",
)
def profile_grouped_quantiles(spark, sf):
    return settle(P.grouped_quantiles(load(spark, sf, "events"), ["event_type"], ["event_id", "user_id", "value"]))


@query(
    "profile_grouped_columns",
    f"SELECT event_type, variable, {settled_columns(COUNTS)} FROM ("
    + " UNION ALL ".join(
        f"""SELECT event_type, '{c}' AS variable, CAST(sum(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS DOUBLE) AS p_missing, count(*) AS n_distinct,
        count(*) / sum(n) AS p_distinct, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n = 1) / sum(n) AS p_unique,
        count(*) FILTER (n = 1) = sum(n) AS is_unique
        FROM (SELECT event_type, {c}, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type"""
        for c in ("event_id", "ts", "user_id", "value", "props")
    )
    + ")",
)
def profile_grouped_columns(spark, sf):
    columns = ["event_id", "ts", "user_id", "value", "props"]
    return settle(P.distinct_counts(load(spark, sf, "events"), columns, keys=["event_type"]))


@query(
    "profile_grouped_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT event_type, '{c}' AS variable, CAST(row_number() OVER (PARTITION BY event_type
        ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS count
      FROM events GROUP BY event_type, {c}) WHERE rank <= 5"""
        for c in ("event_id", "user_id", "value", "props")
    ),
)
def profile_grouped_values(spark, sf):
    return P.top_values(load(spark, sf, "events"), ["event_id", "user_id", "value", "props"], n=5, keys=["event_type"])


@query(
    "profile_grouped_mad",
    f"SELECT event_type, variable, {settled_columns(['median', 'mad'])} FROM ("
    + " UNION ALL ".join(
        f"SELECT event_type, '{c}' AS variable, median(CAST({c} AS DOUBLE)) AS median, mad(CAST({c} AS DOUBLE)) AS mad FROM events GROUP BY event_type"
        for c in ("event_id", "user_id", "value")
    )
    + ")",
)
def profile_grouped_mad(spark, sf):
    columns = ["event_id", "user_id", "value"]
    return settle(P.grouped_median_absolute_deviation(load(spark, sf, "events"), ["event_type"], columns))


def grouped_histogram_sql(key: str, c: str, source: str, bins: int) -> str:
    """Edges and counts of the bins of each group, whose own ends they share out."""
    return f"""
    SELECT e.{key}, '{c}' AS variable, CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / {bins}) AS lower,
      lo + (b.bin + 1) * ((hi - lo) / {bins}) AS upper, coalesce(n, 0) AS count
    FROM (SELECT {key}, min({c})::DOUBLE - CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS lo,
        max({c})::DOUBLE + CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS hi FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {key}) e
    CROSS JOIN (SELECT unnest(range({bins})) AS bin) b
    LEFT JOIN (SELECT {key}, least({bins - 1}, floor(({c}::DOUBLE - lo) / CASE WHEN lo < hi THEN hi - lo ELSE 1 END * {bins})) AS bin, count(*) AS n
      FROM (SELECT {key}, {c}, min({c}) OVER w - CASE WHEN min({c}) OVER w = max({c}) OVER w THEN 0.5 ELSE 0 END::DOUBLE AS lo,
          max({c}) OVER w::DOUBLE AS hi FROM ({source}) WINDOW w AS (PARTITION BY {key})) WHERE {c} IS NOT NULL GROUP BY ALL) h
    ON h.{key} IS NOT DISTINCT FROM e.{key} AND h.bin = b.bin"""


@query(
    "profile_grouped_histogram",
    "SELECT l_returnflag, variable, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count FROM ("
    + " UNION ALL ".join(grouped_histogram_sql("l_returnflag", c, "SELECT * FROM lineitem", 20) for c in NUMBERS)
    + ")",
)
def profile_grouped_histogram(spark, sf):
    found = P.grouped_histogram(load(spark, sf, "lineitem"), ["l_returnflag"], list(NUMBERS), bins=20)
    return found.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


def appended(spark, sf):
    """Line items in a table that got three appends, each followed by a refresh of the states; what the states tell."""
    rows = load(spark, sf, "lineitem")
    table = scratch_table("line_features")
    states = scratch_path(spark, "states")
    for part in range(4):
        some = rows.where(F.col("l_orderkey") % 4 == part)
        if part:
            append_rows(spark, some, table)
        else:
            save_feature_table(some, table, scratch_path(spark, table))
        P.refresh_states(spark, table, states)
    return P.state_sections(P.stored_states(spark, table, states))


# Sums of other parts of the rows differ in the last digits: a value that lies between two rounded ones is moved off.
NUDGE = 1 + 1e-10


@query(
    "profile_incremental",
    "SELECT variable, "
    + ", ".join(f"{settled_sql(f'({c} * {NUDGE})')} AS {c}" if c in DOUBLES else c for c in ("n", "n_missing", "p_missing", *MOMENTS))
    + " FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*) AS p_missing,
        {moments_sql(c)} FROM lineitem"""
        for c in NUMBERS
    )
    + ")",
)
def profile_incremental(spark, sf):
    """The profile of a growing table from states that were stored append by append."""
    found = appended(spark, sf)["numeric"]
    return settle(found.withColumns({c: F.col(c) * NUDGE for c in found.columns if c in DOUBLES}))


@query(
    "profile_incremental_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS variable, CAST(row_number() OVER (ORDER BY count(*) DESC, {e}) AS INTEGER) AS rank,
        {e} AS value, count(*) AS count, true AS exact FROM lineitem GROUP BY {e}) WHERE rank <= 10"""
        for c, e in {c: f"CAST({c} AS VARCHAR)" for c in ("l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")}.items()
    ),
)
def profile_incremental_values(spark, sf):
    found = appended(spark, sf)["top"]
    return found.where(F.col("variable").isin("l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"))


def metrics_sql(source: str, numeric=(), text=(), times=()) -> str:
    """One row per variable and metric."""
    parts = []
    for c in numeric:
        mad = f"mad(CAST({c} AS DOUBLE)) AS mad"
        metrics = f"{counts_sql(c, source)}, {moments_sql(c)}, {quantiles_sql(c)}, {mad}"
        parts.append((c, metrics, (*COUNTS, *MOMENTS, *QUANTILES, "mad")))
    for c in text:
        metrics = f"{counts_sql(c, source)}, {imbalance_sql(c, source)} AS imbalance"
        parts.append((c, metrics, (*COUNTS, "imbalance")))
    for c in times:
        metrics = f"""{counts_sql(c, source)}, epoch_us(min({c})) / 1e6 AS min, epoch_us(max({c})) / 1e6 AS max,
            (epoch_us(max({c})) - epoch_us(min({c}))) / 1e6 AS range"""
        parts.append((c, metrics, (*COUNTS, "min", "max", "range")))
    rows = []
    for c, metrics, names in parts:
        pairs = ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in names)
        rows.append(f"SELECT '{c}' AS variable, unnest([{pairs}], recursive := true) FROM (SELECT {metrics} FROM ({source}))")
    return f"SELECT variable, metric, value FROM ({' UNION ALL '.join(rows)})"


def report_sql(source: str, numeric=(), text=(), times=()) -> str:
    """The whole report of a table, by section."""
    columns = (*numeric, *text, *times)
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    affected = " + ".join(f"CAST(count(*) > count({c}) AS INTEGER)" for c in columns)
    figures = {
        "n_rows": "count(*)", "n_columns": str(len(columns)), "n_cells_missing": missing,
        "p_cells_missing": f"coalesce(({missing}) / (count(*) * {len(columns)}), 0)", "n_vars_with_missing": affected,
        "n_numeric": str(len(numeric)), "n_categorical": str(len(text)), "n_datetime": str(len(times)), "n_boolean": "0",
    }
    pairs = ", ".join(f"{{'name': '{n}', 'value': CAST({e} AS DOUBLE)}}" for n, e in figures.items())
    rank, nothing = "CAST(NULL AS INTEGER) AS rank", "CAST(NULL AS VARCHAR)"
    parts = [
        f"SELECT 'table' AS section, {nothing} AS variable, name, {rank}, {nothing} AS text, value "
        f"FROM (SELECT unnest([{pairs}], recursive := true) FROM ({source}))",
        f"SELECT 'metric', variable, metric, {rank}, {nothing}, value FROM ({metrics_sql(source, numeric, text, times)})",
        f"SELECT 'alert', variable, alert, {rank}, {nothing}, CAST(NULL AS DOUBLE) FROM ({alerts_sql(numeric, text, source, times)})",
    ]
    for c in columns:
        parts.append(
            f"""SELECT 'top', '{c}', {nothing}, rank, value, count FROM (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, {c})
            AS INTEGER) AS rank, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) AS count
            FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
        )
    for c in numeric:
        ends = "unnest([{'name': 'lower', 'value': lower}, {'name': 'upper', 'value': upper}, {'name': 'count', 'value': CAST(count AS DOUBLE)}], recursive := true)"
        parts.append(
            f"SELECT 'bin', variable, name, bin, {nothing}, value FROM (SELECT variable, bin, {ends} FROM ({histogram_sql(c, source)}))"
        )
    return f"SELECT section, variable, name, rank, text, {settled_sql('value')} AS value FROM ({' UNION ALL '.join(parts)})"


ORDERS = (
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price",
    "nullif(o_orderpriority, '5-LOW') AS priority",
    "o_orderdate",
)
FILLED_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(price, 0) AS price, coalesce(priority, '0') AS priority,
    o_orderdate FROM (SELECT {', '.join(ORDERS)} FROM orders)"""
COMPLETE_SQL = f"SELECT * FROM (SELECT {', '.join(ORDERS)} FROM orders) WHERE price IS NOT NULL AND priority IS NOT NULL"
ORDER_NUMBERS, ORDER_TEXTS = ("o_orderkey", "o_custkey", "price"), ("o_orderstatus", "priority")


def orders(spark, sf):
    return load(spark, sf, "orders").selectExpr(*ORDERS)


@query("profile_dataset", report_sql(FILLED_SQL, ORDER_NUMBERS, ORDER_TEXTS, ("o_orderdate",)))
def profile_dataset_query(spark, sf):
    return settle(profile_dataset(orders(spark, sf)))


@query(
    "profile_feature_group",
    report_sql(
        COMPLETE_SQL.replace("SELECT *", "SELECT *, '2024-01-02T03:04:05.000Z' AS fg_date", 1),
        ORDER_NUMBERS,
        (*ORDER_TEXTS, "fg_date"),
        ("o_orderdate",),
    ),
)
def profile_feature_group_query(spark, sf):
    table = scratch_table("orders_features")
    save_feature_table(
        orders(spark, sf), table, scratch_path(spark, table), stamp_at=F.lit("2024-01-02 03:04:05")
    )
    return settle(profile_feature_group(spark, table))


@query(
    "profile_training_set",
    report_sql(
        f"""SELECT o_orderkey, o_custkey, o_orderstatus, price, priority, strftime(o_orderdate, 'd%Y-%m-%d') AS day
            FROM ({COMPLETE_SQL})""",
        ORDER_NUMBERS,
        (*ORDER_TEXTS, "day"),
    ),
)
def profile_training_set_query(spark, sf):
    path = scratch_path(spark, "training")
    rows = orders(spark, sf).withColumn("day", F.date_format("o_orderdate", "'d'yyyy-MM-dd"))
    save_training_set(rows.drop("o_orderdate"), path)
    return settle(profile_training_set(spark, path))


@query(
    "profile_online_group",
    report_sql("SELECT event_id, user_id, value FROM events", ("event_id", "user_id", "value")),
)
def profile_online_group_query(spark, sf):
    stored = load(spark, sf, "events").selectExpr("'list' AS kind", "to_json(struct(event_id, user_id, value)) AS payload")
    return settle(profile_online_group(stored, "kind", "payload"))


CUSTOMER_NUMBERS, CUSTOMER_TEXTS = ("c_custkey", "c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")


@query(
    "profile_json",
    f"""
    WITH r AS ({report_sql('SELECT * FROM customer', CUSTOMER_NUMBERS, CUSTOMER_TEXTS)})
    SELECT variable, {settled_sql("max(value) FILTER (section = 'metric' AND name = 'mean')")} AS mean,
      {settled_sql("max(value) FILTER (section = 'metric' AND name = 'mad')")} AS mad,
      max(value) FILTER (name IN ('n', 'n_rows')) AS n, max(value) FILTER (section = 'metric' AND name = 'n_distinct') AS n_distinct,
      max(text) FILTER (section = 'top' AND rank = 1) AS top, count(*) FILTER (section = 'top') AS n_top,
      count(*) FILTER (section = 'bin') AS n_bin, CAST(sum(CASE WHEN section = 'bin' AND name = 'count' THEN value ELSE 0 END) AS DOUBLE) AS binned,
      coalesce(string_agg(name, ',' ORDER BY name) FILTER (section = 'alert'), '') AS alerts
    FROM r GROUP BY variable""",
)
def profile_json(spark, sf):
    path = scratch_path(spark, "reports")
    P.profile_json(P.profile_report(load(spark, sf, "customer"))).write.json(path)
    written = spark.read.schema("variable string, profile string").json(path)
    part = (
        "struct<metrics: map<string,double>, top: array<struct<rank:int,text:string,value:double>>, "
        "bin: array<struct<rank:int,name:string,value:double>>, alerts: array<string>>"
    )
    p = written.select("variable", F.from_json("profile", part).alias("p"))
    counts = F.filter("p.bin", lambda b: b["name"] == "count")
    return settle(
        p.select(
            "variable",
            F.col("p.metrics")["mean"].alias("mean"),
            F.col("p.metrics")["mad"].alias("mad"),
            F.coalesce(F.col("p.metrics")["n"], F.col("p.metrics")["n_rows"]).alias("n"),
            F.col("p.metrics")["n_distinct"].alias("n_distinct"),
            F.get("p.top", F.lit(0))["text"].alias("top"),
            F.size("p.top").cast("bigint").alias("n_top"),
            F.size("p.bin").cast("bigint").alias("n_bin"),
            F.aggregate(counts, F.lit(0.0), lambda a, b: a + b["value"]).alias("binned"),
            F.array_join("p.alerts", ",").alias("alerts"),
        )
    )
