"""Readers for delimited text. Every column arrives as a string unless stated."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.names import WHITESPACE_RUN
from ..session import Scratch, written

NUMBER_PATTERN = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
INTEGER_PATTERN = "^\\s*[+-]?[0-9]+\\s*$"
BOOLEAN_PATTERN = "^(?i)(true|false)$"

# Marks that can separate fields.
DELIMITERS = "\t,;|"

# Texts that stand for a missing value in typed files.
MISSING_MARKERS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# What to do with a row that has more fields than its header; "only" reads these rows as they stand.
LONG_ROWS = ("fail", "drop", "only")


def first_line(spark: SparkSession, path: str | list[str]) -> str:
    row = spark.read.text(path).limit(1).collect()
    return row[0][0] if row else ""


def delimiter_of(line: str, default: str = ",") -> str:
    """The delimiter that stands earliest in a line."""
    places = {line.index(mark): mark for mark in DELIMITERS if mark in line}
    return places[min(places)] if places else default


def _without_quoted(line: Column, delimiter: str) -> Column:
    """The line without its quoted fields that end on it."""
    mark = re.escape(delimiter)
    return F.regexp_replace(line, f'(^|{mark})"(?:[^"]++|"")*+"(?=$|{mark})', "$1")


def _open_quote(line: Column, delimiter: str) -> Column:
    """True if a line ends inside a quoted field; a quote within a plain field opens nothing."""
    return _without_quoted(line, delimiter).rlike(f'(?:^|{re.escape(delimiter)})"')


def _odd_quote(line: Column, delimiter: str) -> Column:
    """True if a quoted field ends on the line, but not at a delimiter, so that quotes alone do not tell records apart."""
    field = F.regexp_extract(_without_quoted(line, delimiter), f'(?s)(?:^|{re.escape(delimiter)})"(.*)$', 1)
    return field.rlike('^(?:[^"]++|"")*+"')


def _heads(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """``(file, head, open)``: the first line of each file that has lines, and whether a record of it spans lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # Only the task that reads the start of a file sees its first line, and sees it first.
        F.when(F.col("_metadata.file_block_start") == 0, F.col("value")).alias("head"),
        _open_quote(F.col("value"), delimiter).alias("open"),
    )
    return lines.groupBy("file").agg(F.first("head", ignorenulls=True).alias("head"), F.bool_or("open").alias("open"))


def file_headers(spark: SparkSession, path: str | list[str], delimiter: str) -> dict[str, tuple[str, bool]]:
    """{file: (its first line, does a record of it span lines)}, for files that have lines.

    One splittable pass; a row per file reaches the driver, as does the listing of files.
    """
    return {unquote(r["file"]): (r["head"], r["open"]) for r in _heads(spark, path, delimiter).collect()}


def _literal(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _rows(spark: SparkSession, path: str | list[str], delimiter: str, multi_line: bool, long_rows: str) -> DataFrame:
    """Files that share one header; short rows are padded with nulls.

    A row whose fields do not match the header arrives with its raw text beside it; it is
    long if that has more delimiters outside quotes than the header. Column pruning is
    off for this read, since a row cannot be judged by some of its fields.
    """
    if long_rows not in LONG_ROWS:
        raise ValueError(f"long_rows must be one of {LONG_ROWS}")
    options = {"header": True, "sep": delimiter, "escape": '"', "multiLine": multi_line}
    # Names come from the first line alone unless a quote in it is still open.
    named = spark.read.options(**{**options, "multiLine": first_line(spark, path).count('"') % 2 == 1}).csv(path)
    header = named.columns
    if not header:
        return named
    raw = "_raw"
    while raw in header:
        raw += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, raw]])
    parsing = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw, "columnPruning": False}
    records = _records(spark, path, delimiter) if multi_line else None
    if records is None:
        rows = spark.read.schema(schema).options(**parsing).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    else:
        said = {k: str(v).lower() if isinstance(v, bool) else v for k, v in parsing.items() if k != "header"}
        rows = records.select(F.col("file").alias("_file"), F.from_csv("record", _ddl(schema), said).alias("_row"))
        rows = rows.select("_row.*", "_file")
    unquoted = F.regexp_replace(raw, '"(?:[^"]++|"")*+"', "")
    delimiters = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit("")))
    # Always true, and names a field: a plan that needs the raw text alone is refused.
    readable = F.length(F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))) >= 0
    fits = F.col(raw).isNull() | (delimiters < len(header))
    if long_rows == "only":
        return rows.where(~fits & readable).select(
            F.col("_file").alias("file"), F.col(raw).alias("row"), (delimiters + 1).alias("n_fields"), F.lit(len(header)).alias("n_columns")
        )
    if long_rows == "fail":
        fits = fits | F.raise_error(F.concat(F.lit(f"a row has more than {len(header)} fields: "), F.col(raw))).cast("boolean")
    return rows.where(fits & readable).select(*[F.col(f"`{n}`") for n in header])


def _mixed(spark: SparkSession, path: str | list[str], delimiter: str, heads: DataFrame, kinds: list[T.Row], long_rows: str) -> DataFrame:
    """Files with several headers, in one plan whatever their number.

    Records are parsed by place. Each file brings the places of the columns, so that a field
    finds its column by a lookup and no header has a branch of its own. Only files whose
    records span lines are listed, since they are put together apart from the others.
    """
    if long_rows not in LONG_ROWS:
        raise ValueError(f"long_rows must be one of {LONG_ROWS}")
    options = {"sep": delimiter, "escape": '"'}
    fold = str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    columns: dict[str, str] = {}
    held = {}
    for kind in kinds:
        spans = kind["head"].count('"') % 2 == 1
        names = spark.read.options(header=True, multiLine=spans, **options).csv(_literal(unquote(kind["file"]))).columns
        held[kind["head"]] = {fold(n): i for i, n in enumerate(names)}
        for n in names:
            columns.setdefault(fold(n), n)
    places = [(head, len(at), [at.get(n, -1) for n in columns]) for head, at in held.items()]
    told = heads.join(spark.createDataFrame(places, "head string, width int, places array<int>"), "head")
    told = told.select(F.col("file").alias("_of"), "width", "places")

    # A separator that no table holds leaves each line whole; the header of each file goes.
    whole = {"header": True, "sep": "\u0001", "quote": "", "escape": "\u0000"}
    spanning = [_literal(unquote(r["file"])) for r in heads.where("open").select("file").collect()] if any(k["open"] for k in kinds) else []
    lines = spark.read.options(**whole).schema("record string").csv(path).select(F.col("_metadata.file_path").alias("file"), "record")
    if spanning:
        lines = lines.join(heads.where("NOT open").select("file"), "file", "left_semi")
    most = max(width for _, width, _ in places)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(most)])
    fields = F.array(*[F.col(f"_row.c{i}") for i in range(most)]).alias("fields")
    said = {**options, "mode": "PERMISSIVE"}
    rows = lines.select("file", "record", F.from_csv("record", _ddl(schema), said).alias("_row")).select("file", "record", fields)
    if spanning:
        records = _records(spark, spanning, delimiter)
        if records is not None:
            more = records.select("file", "record", F.from_csv("record", _ddl(schema), said).alias("_row"))
            rows = rows.unionByName(more.select("file", "record", fields))
        else:
            # A field more than any header has, so that every row but the longest comes with its text.
            wide = T.StructType([*schema.fields, T.StructField("over", T.StringType()), T.StructField("_raw", T.StringType())])
            parsing = {**said, "header": True, "multiLine": True, "columnNameOfCorruptRecord": "_raw", "columnPruning": False}
            more = spark.read.schema(wide).options(**parsing).csv(spanning)
            text = F.coalesce("_raw", F.to_csv(F.struct(*[f"c{i}" for i in range(most)], "over"), {"sep": delimiter}))
            more = more.select(F.col("_metadata.file_path").alias("file"), text.alias("record"), F.array(*schema.names).alias("fields"))
            rows = rows.unionByName(more)
    rows = rows.join(told, F.col("file") == F.col("_of"))
    unquoted = F.regexp_replace("record", '"(?:[^"]++|"")*+"', "")
    found = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) + 1
    fits = found <= F.col("width")
    if long_rows == "only":
        return rows.where(~fits).select("file", F.col("record").alias("row"), found.alias("n_fields"), F.col("width").alias("n_columns"))
    if long_rows == "fail":
        said_why = F.concat(F.lit("a row has more than "), F.col("width").cast("string"), F.lit(" fields: "), F.col("record"))
        fits = fits | F.raise_error(said_why).cast("boolean")
    return rows.where(fits).select(*[F.get("fields", F.get("places", F.lit(i))).alias(n) for i, n in enumerate(columns.values())])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def _records(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame | None:
    """``(file, record)`` of files whose records span lines, read in splits; None if only a whole file can be parsed.

    A line either opens a quoted field, closes one, does both or neither, depending on
    whether it begins inside one; what it does in both cases is known from the line alone.
    These changes are chained within each split of a file, then over the splits, which gives
    every split the state it begins in, and every line the record it belongs to. Lines that
    are a record by themselves stay where they are; the others are joined in order. The
    header of each file is left out, as are blank lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # grows within a split
        "value",
    )
    bare = F.regexp_replace("value", "\r$", "")
    inside = F.concat(F.lit('"'), bare)
    lines = lines.withColumns(
        {
            "shut": _open_quote(bare, delimiter), "open": _open_quote(inside, delimiter),
            "odd_shut": _odd_quote(bare, delimiter), "odd_open": _odd_quote(inside, delimiter),
        }
    )
    split = Window.partitionBy("file", "block").orderBy("at")
    fixed, turns = F.col("shut") == F.col("open"), (F.col("shut") & ~F.col("open")).cast("int")
    # Turns so far, and the state that the last line which fixes it leaves, less the turns before it.
    lines = lines.withColumn("turns", F.sum(turns).over(split) % 2)
    lines = lines.withColumn("base", F.last(F.when(fixed, (F.col("shut").cast("int") + F.col("turns")) % 2), ignorenulls=True).over(split))
    ends = lines.groupBy("file", "block").agg(F.max_by(F.struct("turns", "base"), "at").alias("end")).select("file", "block", "end.*")
    over = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("sum", F.sum("turns").over(over) % 2)
    left = F.when(F.col("base").isNotNull(), (F.col("base") + F.col("turns") + F.col("sum")) % 2)
    ends = ends.withColumn("after", (F.coalesce(F.last(left, ignorenulls=True).over(over), F.lit(0)) + F.col("sum")) % 2)
    ends = ends.withColumn("before", F.coalesce(F.lag("after").over(over), F.lit(0)))
    # A row for each split; an open quote at the end of a file is for the parser of whole files.
    ends = written(ends.select("file", "block", "before", "after"), "splits")
    last = ends.groupBy("file").agg(F.max_by("after", "block").alias("after"))
    if not last.where("after = 1").isEmpty():
        return None
    placed = lines.join(F.broadcast(ends.select("file", "block", "before")), ["file", "block"])
    after = (F.coalesce("base", "before") + F.col("turns")) % 2
    placed = placed.withColumn("after", after).withColumn("begins", F.coalesce(F.lag("after").over(split), F.col("before")) == 0)
    placed = placed.withColumn("number", F.sum(F.col("begins").cast("int")).over(split))
    # Up to the first line with an odd quote all states are right, so that none is overlooked.
    odd = F.bool_or(F.when(F.col("begins"), F.col("odd_shut")).otherwise(F.col("odd_open"))).alias("odd")
    counts = placed.groupBy("file", "block").agg(F.max("number").alias("n"), odd)
    so_far = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("file", "block", "odd", so_far.alias("so_far")), "splits")
    if not counts.where("odd").isEmpty():
        return None
    numbered = placed.join(F.broadcast(counts.drop("odd")), ["file", "block"]).withColumn("number", F.col("number") + F.col("so_far"))
    alone = F.col("begins") & (F.col("after") == 0)
    parts = numbered.where(~alone).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = parts.select("file", "number", F.array_join(F.col("lines.value"), "\n").alias("record"))
    whole = numbered.where(alone).select("file", "number", F.col("value").alias("record")).unionByName(joined)
    record = F.regexp_replace("record", "\r$", "")
    return whole.where("number > 1").select("file", record.alias("record")).where("trim(record) <> ''")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str | None = None,
    multi_line: bool | str = "auto",
    long_rows: str = "fail",
) -> DataFrame:
    """CSV files with headers and doubled quotes, all columns strings.

    The delimiter is found in the first line unless given. Files whose headers differ are
    joined by column name; a column that a file lacks is null there. A row with more
    fields than its header is an error, or is left out with ``long_rows="drop"``. Records
    that span lines are put together first (see ``_records``), with ``"auto"`` only in files in
    which a quoted field stays open at the end of a line, so such files are split, too.
    """
    delimiter = delimiter or delimiter_of(first_line(spark, path))
    scratch = Scratch(spark)
    heads = _heads(spark, path, delimiter)
    if multi_line != "auto":
        heads = heads.withColumn("open", F.lit(bool(multi_line)))
    heads = scratch.write(heads, "heads")
    # A row for each different header; files are not listed here.
    kinds = heads.groupBy("head").agg(F.min("file").alias("file"), F.bool_or("open").alias("open")).orderBy("file").collect()
    if len(kinds) > 1:
        return _mixed(spark, path, delimiter, heads, kinds, long_rows)
    scratch.drop(heads)
    return _rows(spark, path, delimiter, any(k["open"] for k in kinds), long_rows)


def rejected_rows(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """``(file, row, n_fields, n_columns)``: the rows that readers with ``long_rows="drop"`` leave out, as they stand.

    With the rows that are read they account for every row of the files.
    """
    empty = "file string, row string, n_fields int, n_columns int"
    found = read_csv(spark, path, delimiter, long_rows="only")
    return found if found.columns else spark.createDataFrame([], empty)


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str = ",", long_rows: str = "fail") -> DataFrame:
    """A file whose delimiter the caller knows, without type inference."""
    return read_csv(spark, path, delimiter=delimiter, long_rows=long_rows)


def blank_markers(df: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """Null in place of every text that stands for a missing value, in all string columns."""
    markers = list(markers)
    if not markers:
        return df
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{n}`").isin(markers), F.col(f"`{n}`")).alias(n) if n in strings else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def _castable(c: Column, pattern: str) -> Column:
    return F.coalesce(F.bool_and(F.when(c.isNotNull(), c.rlike(pattern))), F.lit(False))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Cast string columns to bigint, double or boolean where every value fits.

    One aggregate over all columns decides; nothing but its single row reaches the driver.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        fits_long = F.when(c.isNotNull(), F.expr(f"try_cast(`{n}` as bigint)").isNotNull())
        checks += [
            (_castable(c, INTEGER_PATTERN) & F.coalesce(F.bool_and(fits_long), F.lit(False))).alias(f"i{i}"),
            _castable(c, NUMBER_PATTERN).alias(f"d{i}"),
            _castable(c, BOOLEAN_PATTERN).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    kinds = {}
    for i, n in enumerate(names):
        kinds[n] = "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "boolean" if row[f"b{i}"] else None
    return df.select(
        *[
            F.expr(f"try_cast(`{n}` as {kinds[n]})").alias(n) if kinds.get(n) else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def read_lenient(
    spark: SparkSession,
    path: str | list[str],
    file_type: str = "csv",
    infer_types: bool = True,
    markers: Iterable[str] = MISSING_MARKERS,
) -> DataFrame:
    """The reader used before profiling: long rows are dropped, short rows padded with nulls.

    Texts that stand for missing values (``markers``) are null before types are found.
    """
    delimiter = "\t" if file_type == "tsv" else delimiter_of(first_line(spark, path))
    kept = blank_markers(read_csv(spark, path, delimiter, long_rows="drop"), markers)
    return infer_column_types(kept) if infer_types else kept


def read_text_table(spark: SparkSession, path: str | list[str], long_rows: str = "fail") -> DataFrame:
    """A ``.txt`` table: separated as a CSV file if the first line has a delimiter, else by white space.

    The first line of each file is its header and must be the same in all; blank lines
    are skipped. A row with more fields than the header is an error, or is left out.
    """
    line = first_line(spark, path)
    if any(mark in line for mark in DELIMITERS):
        return read_csv(spark, path, delimiter_of(line), long_rows=long_rows)
    names = line.split()
    # A separator that no text table holds leaves each line whole; the header of each file goes.
    lines = spark.read.options(header=True, sep="\u0001", quote="", escape="\u0000").schema("value string").csv(path)
    rows = lines.select(F.split(F.trim("value"), WHITESPACE_RUN).alias("_fields")).where("_fields[0] <> ''")
    fits = F.size("_fields") <= len(names)
    if long_rows == "fail":
        fits = fits | F.raise_error(F.lit(f"a row has more than {len(names)} fields")).cast("boolean")
    return rows.where(fits).select(*[F.get("_fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_training_set(spark: SparkSession, path: str, markers: Iterable[str] = ()) -> DataFrame:
    """A training set: a folder of CSV files with headers, any number of them.

    All columns are strings as written; ``markers`` names texts that stand for missing values.
    """
    return blank_markers(read_csv(spark, path), markers)
