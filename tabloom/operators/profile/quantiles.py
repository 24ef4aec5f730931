"""Exact quantiles, median absolute deviation and histograms.

An exact percentile aggregate keeps every distinct value of a column in one task, and a
global sort moves every row. Here a quantile is found by narrowing instead: a mergeable
sketch gives values on both sides of the wanted rank, a count tells how many rows lie
between them, and the next pass looks only there. Rows never move; a pass is an
aggregate per group of columns, and some hundred numbers per column reach the driver.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ...session import Scratch, written
from .columns import chunks, columns_of_kind, sql_text

DEFAULT_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)

# Scans per pass at most; each reads its own columns only, several to a scan.
BRANCHES = 4

# A sketch is off by at most 1/ACCURACY of the ranks it covers.
ACCURACY = 10_000

# The outer values tried for a rank lie at most this many sketch errors apart.
SPREAD = 12

# Rows between two tried values that may be fetched, by the sketch's bound.
FETCH_ROWS = 1_000

# Steps of the evenly spaced sketch taken inside an interval.
STEPS = 200


@dataclass
class _Search:
    """One wanted rank of one variable, between ``lo`` and ``hi``, both exclusive."""

    variable: str
    rank: int
    upto: int  # rows below hi
    below: int = 0  # rows up to lo
    lo: float = -math.inf
    hi: float = math.inf
    value: float | None = None
    tried: list[float] = field(default_factory=list)

    @property
    def inside(self) -> int:
        return self.upto - self.below

    def place(self, b: float, less: int, upto: int) -> None:
        """Take in that ``less`` rows are below ``b`` and ``upto`` rows not above it."""
        if less <= self.rank < upto:
            self.value = b
        elif upto <= self.rank and upto >= self.below:
            self.lo, self.below = b, upto
        elif less > self.rank and less <= self.upto:
            self.hi, self.upto = b, less


def _literal(x: float) -> str:
    return f"double('{x!r}')"


def _position(value: str, bounds: list[float]) -> str:
    """SQL for the place of a value among sorted bounds: even between two, odd on one."""
    if not bounds:
        return f"CASE WHEN {value} IS NOT NULL THEN 0 END"
    arms = []
    for i, b in enumerate(bounds):
        arms.append(f"WHEN {value} < {_literal(b)} THEN {2 * i} WHEN {value} = {_literal(b)} THEN {2 * i + 1}")
    return f"CASE {' '.join(arms)} WHEN {value} IS NOT NULL THEN {2 * len(bounds)} END"


def _branches(variables: Iterable[str]) -> list[list[str]]:
    variables = list(variables)
    return chunks(variables, max(1, math.ceil(len(variables) / BRANCHES)))


def _positioned(df: DataFrame, values: dict[str, str], bounds: dict[str, list[float]], keep: dict[str, set[int]]) -> list[DataFrame]:
    """``(variable, position, value)`` cells; the value only at the positions to keep."""
    frames = []
    for part in _branches(bounds):
        placed = df.selectExpr(*[f"{values[c]} as v{i}" for i, c in enumerate(part)])
        placed = placed.selectExpr("*", *[f"{_position(f'v{i}', bounds[c])} as p{i}" for i, c in enumerate(part)])
        cells = []
        for i, c in enumerate(part):
            kept = ", ".join(map(str, sorted(keep.get(c, ())))) or "-1"
            cells.append(f"{sql_text(c)}, p{i}, CASE WHEN p{i} IN ({kept}) THEN v{i} END")
        stacked = placed.selectExpr(f"stack({len(part)}, {', '.join(cells)}) as (variable, position, value)")
        frames.append(stacked.where("position is not null"))
    return frames


def _first_sketch(df: DataFrame, values: dict[str, str], points: list[float]) -> dict[str, tuple[int, list[float]]]:
    frames = []
    for part in _branches(values):
        cells = ", ".join(f"{sql_text(c)}, {values[c]}" for c in part)
        frames.append(
            df.selectExpr(f"stack({len(part)}, {cells}) as (variable, value)")
            .groupBy("variable")
            .agg(F.count("value").alias("n"), F.percentile_approx("value", points, ACCURACY).alias("s"))
        )
    return {r.variable: (r.n, r.s) for r in reduce(DataFrame.unionByName, frames).collect()}


def _probes(p: float) -> list[float]:
    d = 2.0 / ACCURACY
    return [max(0.0, p - d), p, min(1.0, p + d)]


def _search(df: DataFrame, values: dict[str, str], probs: list[float]) -> tuple[list[_Search], dict[str, int]]:
    sketch = _first_sketch(df, values, [q for p in probs for q in _probes(p)])
    counts = {c: sketch[c][0] if c in sketch else 0 for c in values}
    searches: list[_Search] = []
    for c in (c for c in values if counts[c]):
        ranks: dict[int, _Search] = {}
        for i, p in enumerate(probs):
            h = (counts[c] - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                ranks.setdefault(rank, _Search(c, rank, counts[c])).tried += sketch[c][1][3 * i : 3 * i + 3]
        searches += ranks.values()
    pending = searches
    while pending:
        _count(df, values, pending)
        pending = [s for s in pending if s.value is None]
        if pending:
            _sketch_inside(df, values, pending)
    return searches, counts


def _count(df: DataFrame, values: dict[str, str], pending: list[_Search]) -> None:
    """Count the rows around every tried value; fetch the values of narrow gaps on the way."""
    bounds = {c: sorted({b for s in pending if s.variable == c for b in s.tried}) for c in {s.variable: 0 for s in pending}}
    keep: dict[str, set[int]] = {}
    for s in pending:
        if s.inside * SPREAD / ACCURACY <= FETCH_ROWS:
            first = bisect.bisect_left(bounds[s.variable], min(s.tried))
            last = bisect.bisect_left(bounds[s.variable], max(s.tried))
            keep.setdefault(s.variable, set()).update(2 * i for i in range(first + 1, last + 1))
    frames = [
        f.groupBy("variable", "position", "value").agg(F.count(F.lit(1)).alias("n"))
        for f in _positioned(df, values, bounds, keep)
    ]
    rows: dict[str, list] = {}
    for r in reduce(DataFrame.unionByName, frames).collect():
        rows.setdefault(r.variable, []).append((r.position, r.value, r.n))
    for c, b in bounds.items():
        seen = 0
        todo = [s for s in pending if s.variable == c]
        for position, value, n in sorted(rows[c], key=lambda r: (r[0], r[1] is not None, r[1] or 0.0)):
            known = b[position // 2] if position % 2 else value
            for s in todo:
                if known is not None:
                    s.place(known, seen, seen + n)
            seen += n


def _sketch_inside(df: DataFrame, values: dict[str, str], pending: list[_Search]) -> None:
    """Sketch the open interval of every search and pick values around its rank."""
    bounds = {
        c: sorted({b for s in pending if s.variable == c for b in (s.lo, s.hi)}) for c in {s.variable: 0 for s in pending}
    }
    gaps = {id(s): 2 * bisect.bisect_right(bounds[s.variable], s.lo) for s in pending}
    keep: dict[str, set[int]] = {}
    for s in pending:
        keep.setdefault(s.variable, set()).add(gaps[id(s)])
    grid = [i / STEPS for i in range(STEPS + 1)]
    frames = [
        f.where("value is not null")
        .groupBy("variable", "position")
        .agg(F.percentile_approx("value", grid, ACCURACY).alias("s"))
        for f in _positioned(df, values, bounds, keep)
    ]
    sketches = {(r.variable, r.position): r.s for r in reduce(DataFrame.unionByName, frames).collect()}
    for s in pending:
        sketch = sketches[(s.variable, gaps[id(s)])]
        low, _, high = _probes((s.rank - s.below + 1) / s.inside)
        s.tried = sketch[math.floor(low * STEPS) : math.ceil(high * STEPS) + 1]


def quantile_values(df: DataFrame, values: dict[str, str], probs: Iterable[float]) -> dict[str, dict[float, float | None]]:
    """Exact, linearly interpolated quantiles of SQL expressions of type double."""
    probs = list(probs)
    searches, counts = _search(df, values, probs)
    found = {(s.variable, s.rank): s.value for s in searches}

    def at(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        h = (counts[c] - 1) * p
        low, high = found[(c, math.floor(h))], found[(c, math.ceil(h))]
        return low if low == high else low + (high - low) * (h - math.floor(h))

    return {c: {p: at(c, p) for p in probs} for c in values}


def _numeric(df: DataFrame, columns: list[str] | None) -> dict[str, str]:
    """Each numeric column as a double, with not-a-number as null."""
    names = columns_of_kind(df, "Numeric", columns)
    if not names:
        raise ValueError("no numeric columns to profile")
    exprs = {}
    for c in names:
        name = f"`{c}`"
        floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        exprs[c] = f"CASE WHEN NOT isnan({name}) THEN double({name}) END" if floating else f"double({name})"
    return exprs


def quantiles(df: DataFrame, columns: list[str] | None = None, probs: Iterable[float] = DEFAULT_PROBS) -> DataFrame:
    """``(variable, q05, q25, q50, q75, q95, iqr)`` for every numeric column."""
    probs = sorted({*probs, 0.25, 0.75})
    got = quantile_values(df, _numeric(df, columns), probs)
    rows = [(c, *[q[p] for p in probs], None if q[0.25] is None else q[0.75] - q[0.25]) for c, q in got.items()]
    names = ", ".join(f"q{round(p * 100):02d} double" for p in probs)
    return df.sparkSession.createDataFrame(rows, f"variable string, {names}, iqr double")


def grouped_quantiles(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, probs: Iterable[float] = DEFAULT_PROBS
) -> DataFrame:
    """``quantiles`` for every value of the keys, any number of them, in one job.

    Equal values are combined and written once in order of key, column and value, so each
    file is one range however large a single group is. Rows per file and group give the
    offset of every file; only files that hold a wanted rank are looked into.
    """
    probs = sorted({*probs, 0.25, 0.75})
    group = [*keys, "variable"]
    found = _grouped_at(_grouped_values(df, keys, columns), group, probs)
    return found.withColumn("iqr", F.col("q75") - F.col("q25"))


def _grouped_values(df: DataFrame, keys: list[str], columns: list[str] | None) -> DataFrame:
    """``(keys, variable, value, n)``: equal values of a group combined, missing ones left out."""
    values = {c: v for c, v in _numeric(df, columns).items() if c not in keys}
    pairs = ", ".join(f"{sql_text(c)}, {v}" for c, v in values.items())
    cells = df.select(*keys, F.expr(f"stack({len(values)}, {pairs}) as (variable, value)")).where("value is not null")
    return cells.groupBy(*keys, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def _grouped_at(counted: DataFrame, group: list[str], probs: list[float], scratch: Scratch | None = None) -> DataFrame:
    """``(group, q05, ...)``: exact quantiles of counted values, one table ordered by group and value."""
    ranged = counted.repartitionByRange(*group, "value").sortWithinPartitions(*group, "value")
    ordered = written(ranged, "ordered", scratch).select("*", F.col("_metadata.file_path").alias("_file"))

    per_file = ordered.groupBy(*group, "_file").agg(F.sum("n").alias("_rows"), F.min("value").alias("_least"))
    whole = Window.partitionBy(*group)
    before = F.sum("_rows").over(whole.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1))
    files = per_file.withColumns(
        {"_offset": F.coalesce(before, F.lit(0)), "_total": F.sum("_rows").over(whole)}
    ).drop("_least")
    places = [(F.col("_total") - 1) * F.lit(p) for p in probs]
    ranks = F.array(*[fn(h) for h in places for fn in (F.floor, F.ceil)])
    files = files.where(F.exists(ranks, lambda r: (r >= F.col("_offset")) & (r < F.col("_offset") + F.col("_rows"))))

    left, right = ordered.alias("l"), files.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_file"]]
    inside = left.join(right, same).select("l.*", "r._offset", "r._total")
    running = F.col("_offset") + F.sum("n").over(Window.partitionBy(*group, "_file").orderBy("value"))
    placed = inside.withColumn("_upto", running)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("n")) & (rank < F.col("_upto")), F.col("value")))

    ends = [at(fn(h)).alias(f"{fn.__name__}{i}") for i, h in enumerate(places) for fn in (F.floor, F.ceil)]
    found = placed.groupBy(*group, "_total").agg(*ends)

    def between(i: int) -> Column:
        low, high, h = F.col(f"floor{i}"), F.col(f"ceil{i}"), places[i]
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    return found.select(*group, *[between(i).alias(f"q{round(p * 100):02d}") for i, p in enumerate(probs)])


def _same_group(group: list[str], left: str, right: str) -> list[Column]:
    """Equality of groups, of which a null key is one."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in group]


def grouped_median_absolute_deviation(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """``median_absolute_deviation`` for every value of the keys.

    Equal values are combined and written once; medians and distances from them come from
    that table. Medians are one row per group, and a group of any size is split between
    the tasks that join them.
    """
    group = [*keys, "variable"]
    counted = written(_grouped_values(df, keys, columns), "counted", scratch)
    medians = written(_grouped_at(counted, group, [0.5], scratch), "medians", scratch)
    both = counted.alias("l").join(medians.alias("r"), _same_group(group, "l", "r"))
    distances = both.select(*[F.col(f"l.{c}") for c in group], F.abs(F.col("l.value") - F.col("r.q50")).alias("value"), "n")
    distances = distances.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    mads = _grouped_at(distances, group, [0.5], scratch)
    both = medians.alias("l").join(mads.alias("r"), _same_group(group, "l", "r"))
    return both.select(*[F.col(f"l.{c}") for c in group], F.col("l.q50").alias("median"), F.col("r.q50").alias("mad"))


def grouped_histogram(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, bins: int = 50, scratch: Scratch | None = None
) -> DataFrame:
    """``histogram`` for every value of the keys, with the group's own range: ``(keys, variable, bin, lower, upper, count)``."""
    group = [*keys, "variable"]
    finite = _grouped_values(df, keys, columns).where("abs(value) < double('Infinity')")
    counted = written(finite, "counted", scratch)
    ends = counted.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    narrow = F.col("lo") == F.col("hi")
    ends = ends.withColumns({"lo": F.when(narrow, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(narrow, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    ends = written(ends, "ends", scratch)
    both = counted.alias("l").join(ends.alias("r"), _same_group(group, "l", "r"))
    place = F.least(F.floor((F.col("l.value") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * bins), F.lit(bins - 1)).cast("int")
    held = both.select(*[F.col(f"l.{c}") for c in group], place.alias("bin"), "n").groupBy(*group, "bin").agg(F.sum("n").alias("count"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    every = every.withColumns({"lower": F.col("lo") + F.col("bin") * width, "upper": F.col("lo") + (F.col("bin") + 1) * width})
    joined = every.alias("l").join(held.alias("r"), _same_group([*group, "bin"], "l", "r"), "left")
    return joined.select(*[F.col(f"l.{c}") for c in (*group, "bin")], "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"))


def median_absolute_deviation(
    df: DataFrame, columns: list[str] | None = None, medians: dict[str, float | None] | None = None
) -> DataFrame:
    """``(variable, median, mad)``: the median distance from the median.

    Medians already known are not searched again.
    """
    values = _numeric(df, columns)
    if medians is None:
        medians = {c: q[0.5] for c, q in quantile_values(df, values, [0.5]).items()}
    distances = {c: f"abs({v} - {_literal(medians[c])})" for c, v in values.items() if medians[c] is not None}
    mads = quantile_values(df, distances, [0.5]) if distances else {}
    rows = [(c, medians[c], mads[c][0.5] if c in mads else None) for c in values]
    return df.sparkSession.createDataFrame(rows, "variable string, median double, mad double")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 50) -> DataFrame:
    """Equal-width bins of the finite values: ``(variable, bin, lower, upper, count)``.

    Empty bins are listed. The last bin includes its upper edge; a constant column has
    its values in the middle of a range of width 1.
    """
    values = {c: f"CASE WHEN abs({v}) < double('Infinity') THEN {v} END" for c, v in _numeric(df, columns).items()}
    names = list(values)
    ends = [f"{fn}({values[c]}) as {fn}{i}" for i, c in enumerate(names) for fn in ("min", "max")]
    row = df.selectExpr(*ends).first()
    schema = "variable string, bin int, lower double, upper double, count bigint"
    cells, frames = [], []
    for i, c in enumerate(names):
        lo, hi = row[f"min{i}"], row[f"max{i}"]
        if lo is None:
            continue
        lo, hi = (lo, hi) if lo < hi else (lo - 0.5, lo + 0.5)
        place = f"floor(({values[c]} - {_literal(lo)}) / {_literal(hi - lo)} * {bins})"
        # least() passes over nulls, so a missing value must not reach it.
        cells.append(f"{sql_text(c)}, CASE WHEN {values[c]} IS NOT NULL THEN int(least({place}, {bins - 1})) END")
        frames.append(
            df.sparkSession.range(bins).selectExpr(
                f"{sql_text(c)} as variable",
                "int(id) as bin",
                f"{_literal(lo)} + id * {_literal((hi - lo) / bins)} as lower",
                f"{_literal(lo)} + (id + 1) * {_literal((hi - lo) / bins)} as upper",
            )
        )
    if not frames:
        return df.sparkSession.createDataFrame([], schema)
    counted = (
        df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (variable, bin)")
        .where("bin is not null")
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    joined = reduce(DataFrame.unionByName, frames).join(counted, ["variable", "bin"], "left")
    return joined.selectExpr("variable", "bin", "lower", "upper", "coalesce(count, 0L) as count")
