"""Personal data in columns and documents, and eye regions in images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import WHITESPACE_CLASS
from ..session import Scratch, written
from .joins import split_join
from .profile.columns import sql_text
from ..functions.privacy import (
    ENTITY_HINTS,
    ENTITY_PATTERNS,
    PII_SAMPLE_ROWS,
    PII_THRESHOLD,
    landmark_box,
)

# From the first to the last letter or digit of a run without white space.
BARE_WORD = f"(?U)[\\p{{L}}\\p{{N}}](?:[^{WHITESPACE_CLASS}]*[\\p{{L}}\\p{{N}}])?"

# Names up to this many are sent to every task.
BROADCAST_NAMES = 200_000

# Landmark numbers of the two eyes.
FIRST_EYE_POINT, LAST_EYE_POINT = 36, 47

# What is reported for an image without and with eye regions.
NO_REGIONS = "Analysis complete: No faces or eye landmarks detected"
REGIONS_BEFORE, REGIONS_AFTER = "Success: Detected ", " eye region(s)"


def cells(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """``(key, column_name, value)`` for all non-null values, as strings."""
    columns = columns or [c for c in df.columns if c not in key]
    text = df.select(*key, *[F.col(c).cast("string").alias(f"_cell_{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"{sql_text(c)}, _cell_{i}" for i, c in enumerate(columns))
    stacked = text.select(*key, F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)"))
    return stacked.where("value is not null")


def sample_cells(df: DataFrame, key: list[str], columns: list[str] | None = None, n: int = PII_SAMPLE_ROWS) -> DataFrame:
    """Up to ``n`` non-null values of every column: ``(column_name, rank, value)``.

    The sample is the rows with the lowest hash of column and key, so it is the same on
    every run. ``key`` must identify a row. Hashes are counted by their leading zeros first,
    which says how many zeros the lowest ``n`` of a column have at least; only hashes with as
    many, some ``16 * n`` of a column of any size, are ranked, and only the values of the
    winners are fetched.
    """
    present = cells(df, key, columns)
    hashed = present.select("column_name", *key, F.md5(F.concat_ws("|", "column_name", *key)).alias("_hash"))
    hashed = hashed.withColumn("_zeros", F.length("_hash") - F.length(F.ltrim("_hash", F.lit("0"))))
    counts = hashed.groupBy("column_name", "_zeros").agg(F.count(F.lit(1)).alias("_n"))
    # A row per column and number of zeros.
    as_many = F.sum("_n").over(Window.partitionBy("column_name").orderBy(F.desc("_zeros")))
    enough = counts.withColumn("_enough", as_many >= n).groupBy(F.col("column_name").alias("_column"))
    least = enough.agg(F.coalesce(F.max(F.when(F.col("_enough"), F.col("_zeros"))), F.lit(0)).alias("_least"))
    lowest = (F.col("column_name") == F.col("_column")) & (F.col("_zeros") >= F.col("_least"))
    low = hashed.join(F.broadcast(least), lowest).select("column_name", *key, "_hash")
    order = Window.partitionBy("column_name").orderBy("_hash", *key)
    winners = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_hash")
    # At most n rows per column. Keys may be null and still name a row.
    few = winners.select(F.col("column_name").alias("_column"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], "rank")
    same = F.col("column_name") == F.col("_column")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return present.join(F.broadcast(few), same).select("column_name", *key, "rank", "value")


def count_patterns(df: DataFrame, text: str) -> DataFrame:
    """The given columns and one count per pattern label, named ``n_<label>``.

    Matches of a label are taken out before the next label is counted. Each label is a
    projection of its own, so the shortened text is computed once, and only where it is
    needed.
    """
    kept = df.columns
    out = df.withColumn("_rest", F.coalesce(F.col(text).cast("string"), F.lit("")))
    counts = []
    for label, pattern in ENTITY_PATTERNS.items():
        hint = F.col("_rest").rlike(ENTITY_HINTS[label])
        found = F.when(hint, F.regexp_count("_rest", F.lit(pattern))).otherwise(0)
        out = out.select(*kept, *counts, "_rest", found.cast("bigint").alias(f"n_{label}"))
        counts.append(f"n_{label}")
        rest = F.when(F.col(f"n_{label}") > 0, F.regexp_replace("_rest", pattern, " ")).otherwise(F.col("_rest"))
        out = out.select(*kept, *counts, rest.alias("_rest"))
    return out.drop("_rest")


def bare_words(text: Column | str) -> Column:
    """Lower-cased words without the marks around them."""
    return F.regexp_extract_all(F.lower(text), F.lit(BARE_WORD), F.lit(0))


def _word_runs(words: str, longest: int) -> Column:
    """The words of an array column, and its runs of up to ``longest`` words."""
    runs = [F.col(words)]
    for k in range(2, longest + 1):
        following = F.slice(words, k, F.size(words))
        # Runs cut off by the end of the text have no following word and are null.
        runs.append(F.array_compact(F.zip_with(runs[-1], following, lambda run, w: F.concat(run, F.lit(" "), w))))
    return F.concat(*runs)


def gazetteer_counts(
    df: DataFrame, keys: list[str], text: str, gazetteer: DataFrame, longest: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """``(keys, label, n)``: names from a ``(name, label)`` table found in a text column.

    Names are lower-case runs of up to ``longest`` words, by default as many as the longest
    name has. The names are written once. A table of at most
    ``BROADCAST_NAMES`` names goes to the words, and only matches are counted. A longer
    table is joined by shuffle after equal words of one key have been counted, so that a
    frequent word is one row per key.
    """
    names = written(gazetteer.select("name", "label").distinct(), "names", scratch)
    size = names.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("name", " "))).alias("longest")).first()
    longest = min(longest or size.longest or 1, size.longest or 1)
    if longest == 1:
        found = df.select(*keys, F.explode(bare_words(text)).alias("name"))
    else:
        words = df.select(*keys, bare_words(text).alias("_words"))
        found = words.select(*keys, F.explode(_word_runs("_words", longest)).alias("name"))
    if size.n <= BROADCAST_NAMES:
        return found.join(F.broadcast(names), "name").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    counts = written(found.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n")), "words", scratch)
    # Both sides are scans, so a word of very many keys is split.
    return counts.join(names, "name").groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def name_index(names: DataFrame) -> DataFrame:
    """``(first, sizes)``: how many words names that begin with a word have."""
    words = names.select(F.split("name", " ").alias("words"))
    return words.groupBy(F.col("words")[0].alias("first")).agg(F.collect_set(F.size("words")).alias("sizes"))


def found_entities(
    df: DataFrame, keys: list[str], text: str, gazetteer: DataFrame | None = None, longest: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """``(keys, label, n)`` of patterns and names, and under the empty label the number of texts; n is above 0.

    Patterns and words come from one projection, so texts are read once. A word leaves the
    scan only if a name begins with it, and then only the runs of as many words as such
    names have are built. More than ``BROADCAST_NAMES`` names are counted by a join of
    their own, in a second scan.
    """
    parts = [*keys, "_label", "_n"]
    counted = count_patterns(df.select(*keys, F.col(text).alias("_text")), "_text")
    plain = [F.struct(F.lit("").alias("label"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("int").alias("at"))]
    plain += [F.struct(F.lit(label).alias("label"), F.col(f"n_{label}").alias("n"), F.lit(None).cast("int").alias("at")) for label in ENTITY_PATTERNS]
    items = F.filter(F.array(*plain), lambda item: item["n"] > 0)
    names = n = None
    if gazetteer is not None:
        names = written(gazetteer.select("name", "label").distinct(), "names", scratch)
        n = names.count()
    if not n or n > BROADCAST_NAMES:
        rows = counted.select(*keys, F.explode(items).alias("_item"))
        sums = rows.groupBy(*keys, F.col("_item.label").alias("label")).agg(F.sum("_item.n").alias("n"))
        return sums.unionByName(gazetteer_counts(df, keys, text, names, longest, scratch)) if n else sums
    if longest:
        names = names.where(F.size(F.split("name", " ")) <= longest)
    rows = counted.select(*keys, items.alias("_items"), bare_words("_text").alias("_words"))
    word = F.transform("_words", lambda w, i: F.struct(F.lit(None).cast("string").alias("label"), F.lit(1).cast("bigint").alias("n"), i.alias("at")))
    rows = rows.select(*keys, "_words", F.explode(F.concat("_items", word)).alias("_item"))
    rows = rows.withColumn("_first", F.get("_words", F.col("_item.at")))
    index = name_index(names).select(F.col("first").alias("_first"), F.col("sizes").alias("_sizes"))
    met = rows.join(F.broadcast(index), "_first", "left").where("_item.label IS NOT NULL OR _sizes IS NOT NULL")
    runs = met.select(*keys, "_item", "_words", F.explode_outer("_sizes").alias("_size"))
    run = F.when(F.col("_item.at") + F.col("_size") <= F.size("_words"), F.array_join(F.expr("slice(_words, _item.at + 1, _size)"), " "))
    runs = runs.select(*keys, "_item", run.alias("_name"))
    known = names.select(F.col("name").alias("_name"), F.col("label").alias("_known"))
    labelled = runs.join(F.broadcast(known), "_name", "left").select(*keys, F.coalesce("_item.label", "_known").alias("_label"), F.col("_item.n").alias("_n"))
    sums = labelled.select(*parts).where("_label IS NOT NULL").groupBy(*keys, "_label").agg(F.sum("_n").alias("n"))
    return sums.withColumnRenamed("_label", "label")


def entity_counts(df: DataFrame, key: str, text: str, gazetteer: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """``(key, label, n)`` for the labels found in every document; n is above 0."""
    return found_entities(df, [key], text, gazetteer, longest).where("label <> ''")


def _column_totals(sample: DataFrame, gazetteer: DataFrame | None, longest: int | None) -> DataFrame:
    found = found_entities(sample.select("column_name", "value"), ["column_name"], "value", gazetteer, longest)
    return found.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("label") != "", F.col("n"))), F.lit(0).cast("bigint")).alias("n_entities"),
        F.sum(F.when(F.col("label") == "", F.col("n"))).alias("n_sampled"),
    )


def _flagged(totals: DataFrame, threshold: float) -> DataFrame:
    ratio = F.try_divide(F.col("n_entities"), F.col("n_sampled"))
    return totals.select(
        "column_name", "n_entities", "n_sampled", ratio.alias("ratio"), (ratio >= F.lit(threshold)).alias("is_pii")
    )


def pii_columns(
    df: DataFrame,
    key: list[str],
    columns: list[str] | None = None,
    gazetteer: DataFrame | None = None,
    longest: int | None = None,
    n: int = PII_SAMPLE_ROWS,
    threshold: float = PII_THRESHOLD,
) -> DataFrame:
    """``(column_name, n_entities, n_sampled, ratio, is_pii)`` from a sample of every column.

    Blank values count as sampled; a value may hold several entities.
    """
    sample = sample_cells(df, key, columns, n)
    return _flagged(_column_totals(sample, gazetteer, longest), threshold)


def pii_columns_full(
    df: DataFrame,
    columns: list[str],
    gazetteer: DataFrame | None = None,
    longest: int | None = None,
    threshold: float = PII_THRESHOLD,
) -> DataFrame:
    """As ``pii_columns`` over all values instead of a sample."""
    return _flagged(_column_totals(cells(df, [], columns), gazetteer, longest), threshold)


def eye_boxes(points: DataFrame, images: DataFrame) -> DataFrame:
    """``(image_id, face_id, x1, y1, x2, y2)`` around the eye points of every face.

    ``points(image_id, face_id, point, x, y)``, ``images(image_id, width, height)``.
    """
    eyes = points.where(F.col("point").between(FIRST_EYE_POINT, LAST_EYE_POINT))
    edges = eyes.groupBy("image_id", "face_id").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
    box = landmark_box(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")], "width", "height")
    return edges.join(images, "image_id").select("image_id", "face_id", *[c.alias(k) for k, c in box.items()])


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "image_id") -> DataFrame:
    """The primary detections, and the fallback's for images where the primary has none."""
    unmatched = split_join(fallback, primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(unmatched.select(*primary.columns))


def detection_summary(images: DataFrame, detections: DataFrame, key: str = "image_id") -> DataFrame:
    """``(image_id, n_regions, message)`` for every image."""
    counts = detections.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    message = F.when(n == 0, NO_REGIONS).otherwise(F.concat(F.lit(REGIONS_BEFORE), n, F.lit(REGIONS_AFTER)))
    return images.select(key).join(counts, key, "left").select(key, n.alias("n_regions"), message.alias("message"))


def outcome_totals(summary: DataFrame) -> DataFrame:
    """``(message, n_images, n_regions)``: images per outcome."""
    return summary.groupBy("message").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("n_regions").alias("n_regions")
    )
