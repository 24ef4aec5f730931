"""Feature selection, specs, labels and extraction."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import names, text
from ..functions.stopwords import stop_words
from ..session import Scratch, written
from ..sources.tables import STAMP_COLUMN
from .joins import split_join

READY_STATUS = "SUCCESS"

# The fields of one feature in a spec, and their types.
FEATURE_FIELDS = {
    "feature_id": "string",
    "name": "string",
    "description": "string",
    "feature_type": "string",
    "extraction_algorithm": "string",
    "text_cleaning": "array<string>",
    "language": "string",
    "partition_key": "boolean",
    "feature_group_id": "string",
}

# Above this many entries a lexicon is joined instead of written into the expression.
INLINE_LEXICON = 2000


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def parse_spec(spec: str | dict) -> dict:
    """A feature-group spec held by the driver; the JSON reader names every key in snake case."""
    text = spec if isinstance(spec, str) else json.dumps(spec)
    return json.loads(text, object_pairs_hook=lambda pairs: {names.snake_text(k): v for k, v in pairs})


def spec_features(df: DataFrame, spec: str, keep: Iterable[str] = ()) -> DataFrame:
    """One row per feature of every JSON spec in a column; keys in either case style."""
    keep = list(keep)
    fields = []
    for name, kind in FEATURE_FIELDS.items():
        fields += [f"`{n}`: {kind}" for n in dict.fromkeys([name, _camel(name)])]
    parsed = F.from_json(F.col(spec), f"struct<features: array<struct<{', '.join(fields)}>>>")
    rows = df.select(*keep, F.explode(parsed["features"]).alias("_f"))
    picked = []
    for name in FEATURE_FIELDS:
        options = [F.col("_f").getField(n) for n in dict.fromkeys([name, _camel(name)])]
        picked.append((F.coalesce(*options) if len(options) > 1 else options[0]).alias(name))
    return rows.select(*keep, *picked)


def feature_columns(spec: Mapping) -> list[str]:
    return [names.clean_name_text(f["name"]) for f in spec["features"]]


def select_features(df: DataFrame, feature_names: Iterable[str]) -> DataFrame:
    """Project the named features of a table whose columns are already clean."""
    return df.select(*[F.col(f"`{names.clean_name_text(n)}`") for n in feature_names])


def preview_features(df: DataFrame, spec: Mapping, limit: int | None = None) -> DataFrame:
    """The spec's features in order, and the stamp if there is one."""
    if not spec.get("table_name") or spec.get("status") != READY_STATUS:
        raise ValueError("the feature group has no data yet")
    columns = feature_columns(spec)
    if STAMP_COLUMN in df.columns:
        columns.append(STAMP_COLUMN)
    shown = df.select(*[F.col(f"`{c}`") for c in columns])
    return shown if limit is None else shown.limit(limit)


def apply_value_labels(df: DataFrame, labels: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace codes by labels from a ``(column, code, label)`` table; other codes stay.

    A code that is listed twice with one label counts once; with two labels it is an error.
    """
    out = df
    for i, c in enumerate(columns):
        listed = labels.where(F.col("column") == c).groupBy(F.col("code").cast("string").alias(f"_code{i}"))
        twice = F.raise_error(F.concat(F.lit(f"two labels in {c} for code "), F.col(f"_code{i}"))).cast("boolean")
        # A null label beside another is a second one, too.
        same = F.min("label").eqNullSafe(F.max("label")) & F.count("label").isin(0, F.count(F.lit(1)))
        table = listed.agg(F.min("label").alias(f"_label{i}"), same.alias(f"_one{i}"))
        table = table.where(F.col(f"_one{i}") | twice).drop(f"_one{i}")
        out = out.join(table, F.col(f"`{c}`").cast("string") == F.col(f"_code{i}"), "left")
        out = out.withColumn(c, F.coalesce(F.col(f"_label{i}"), F.col(f"`{c}`").cast("string")))
        out = out.drop(f"_code{i}", f"_label{i}")
    return out


def fill_zero(df: DataFrame) -> DataFrame:
    """Nulls to zero: ``0`` in numbers, ``'0'`` in strings, false in booleans; times stay null."""
    filled = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.coalesce(F.nanvl(c, F.lit(0).cast(f.dataType)), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit("0"))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        filled.append(c.alias(f.name))
    return df.select(*filled)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.dropna("any")


def known_forms(lexicon: DataFrame) -> DataFrame:
    """One lemma per form: the least of those given; entries with a null are left out."""
    given = lexicon.where("form IS NOT NULL AND lemma IS NOT NULL")
    return given.groupBy("form").agg(F.min("lemma").alias("lemma"))


def lemmatize_with_table(
    df: DataFrame, key: str, tokens: str, lexicon: DataFrame, output: str, scratch: Scratch | None = None
) -> DataFrame:
    """Replace the known forms of a token array by a ``(form, lemma)`` table of any size.

    The lexicon is cleaned and written once. A short one becomes part of the expression
    and nothing moves. A longer one meets the distinct tokens of the rows only once, and
    what comes back to a row is the lemmas of its own tokens. ``key`` must be unique.
    """
    known = written(known_forms(lexicon), "lexicon", scratch)
    head = known.limit(INLINE_LEXICON + 1).collect()
    if len(head) <= INLINE_LEXICON:
        return df.withColumn(output, text.lemmatize(F.col(tokens), {r.form: r.lemma for r in head}))
    low = df.withColumn(output, F.transform(tokens, F.lower))
    pairs = low.select(key, F.explode(F.array_distinct(output)).alias("form"))
    found = pairs.join(known, "form")  # both sides come straight from a shuffle, so frequent forms are split
    maps = found.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas")
    )
    joined = low.join(maps, key, "left")
    lemmas = _replaced(F.col(output), F.map_keys("_lemmas"), F.map_values("_lemmas"))
    return joined.withColumn(output, F.when(F.col("_lemmas").isNull(), F.col(output)).otherwise(lemmas)).drop("_lemmas")


def _replaced(tokens: Column, forms: Column, lemmas: Column) -> Column:
    """Tokens with known forms replaced, by a hash lookup for each; a map's keys would be searched one by one.

    A form has the same lemma in every row, so the rows of a batch are looked up together.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def replaced(words: pa.Array, known: pa.Array, put: pa.Array) -> pa.Array:
        flat = words.flatten()
        done = pc.coalesce(put.flatten().take(pc.index_in(flat, value_set=known.flatten())), flat)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0))
        starts = pa.concat_arrays([pa.array([0], ends.type), ends])
        return pa.ListArray.from_arrays(starts, done, mask=words.is_null())

    return replaced(tokens, forms, lemmas)


def term_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, term, tf)``: lower-cased white-space words per row.

    The texts are dealt out by key and split where they arrive, which moves a fraction of
    what their terms would. Their tasks are not put together, since terms need more room.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(key, column).repartition(tasks, key)
    terms = dealt.select(key, F.explode(F.split(F.lower(column), names.WHITESPACE_RUN)).alias("term"))
    return terms.where("term <> ''").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(df: DataFrame, key: str, column: str, scratch: Scratch | None = None) -> DataFrame:
    """``(key, term, tf, df, tfidf)`` with ``tf * ln((N + 1) / (df + 1))``; N counts all rows.

    The term counts are written once, since both the document counts and the weights are
    made from them. Terms found in most rows are split between tasks: see ``split_join``.
    """
    counts = written(term_counts(df, key, column), "terms", scratch)
    docs = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    both = split_join(counts, docs, "term", scratch=scratch)
    n = df.agg(F.count(F.lit(1))).scalar()
    weight = F.col("tf") * F.log((n + 1) / (F.col("df") + 1))
    return both.select(key, "term", "tf", "df", weight.alias("tfidf"))


# Values of a column that may become a column each.
MOST_CATEGORIES = 10_000


def categories(df: DataFrame, column: str, at_most: int | None = None) -> list[str]:
    """The sorted values of a column; more than ``at_most``, or ``MOST_CATEGORIES``, is an error.

    They come to the driver, since each becomes a column. Columns of more values are for
    ``vectors.one_hot_vector`` or ``one_hot_long``.
    """
    at_most = MOST_CATEGORIES if at_most is None else at_most
    rows = df.select(F.col(f"`{column}`").cast("string").alias("v")).where("v is not null").distinct()
    found = sorted(r.v for r in rows.limit(at_most + 1).collect())
    if len(found) > at_most:
        raise ValueError(f"{column} has over {at_most} values: use one_hot_vector or one_hot_long")
    return found


def one_hot(df: DataFrame, column: str, values: Iterable[str] | None = None, at_most: int | None = None) -> DataFrame:
    """One 0/1 column per category, named ``<column>_<category>``, after the given columns.

    Categories whose clean names are equal, or equal to a column, get a number behind.
    """
    values = categories(df, column, at_most) if values is None else list(values)
    taken, flags = set(df.columns), []
    for v in values:
        base = name = f"{column}_{names.clean_name_text(v)}"
        k = 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        flags.append(F.coalesce((F.col(f"`{column}`").cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(name))
    return df.select("*", *flags)


def one_hot_long(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, category, flag)`` with only the ones, for columns of any number of values."""
    return df.where(F.col(column).isNotNull()).select(
        key, F.col(column).cast("string").alias("category"), F.lit(1).alias("flag")
    )


# Extraction algorithms by their names without marks; no name is no extraction.
ALGORITHMS = ("", "none", "onehot", "onehotencoding", "onehotlong", "tfidf")


def extract_features(df: DataFrame, spec: Mapping, key: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Apply each feature's extraction: text cleaning in place, one-hot flags, TF-IDF maps.

    A TF-IDF feature turns into a map from term to weight by row. Rows are told apart by
    ``key`` or the spec's ``row_key``, a unique column; without one, rows are numbered and
    written first. ``OneHotLong`` gives an array of the categories instead of a column for
    each. Algorithms that are not known are an error.
    """
    key = key or (names.clean_name_text(spec["row_key"]) if spec.get("row_key") else None)
    out, numbered = df, None
    for feature in spec["features"]:
        column = names.clean_name_text(feature["name"])
        named = feature.get("extraction_algorithm") or ""
        algorithm = names.snake_text(named).replace("-", "").replace("_", "").replace(" ", "")
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown extraction algorithm: {named}")
        methods = feature.get("text_cleaning") or []
        if methods:
            stop = stop_words(feature.get("language") or "english") if "remove_stop_words" in methods else []
            out = out.withColumn(column, text.clean_text(F.col(column), methods, stop))
        if algorithm in ("onehot", "onehotencoding"):
            out = one_hot(out, column, at_most=feature.get("at_most"))
        elif algorithm == "onehotlong":
            out = out.withColumn(f"{column}_categories", F.array_compact(F.array(F.col(column).cast("string"))))
        elif algorithm == "tfidf":
            if key is None:
                key = numbered = "_row"
                out = written(out.withColumn(numbered, F.monotonically_increasing_id()), "rows", scratch)
            weights = tfidf(out, key, column, scratch).groupBy(key).agg(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tfidf")))).alias(f"{column}_tfidf")
            )
            out = out.join(weights, key, "left")
    return out.drop(numbered) if numbered else out
