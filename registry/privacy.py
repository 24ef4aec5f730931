"""Personal data and eye regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import privacy as V
from tabloom.operators import privacy as P
from tabloom.plans.privacy import privacy_job

from .base import WS, load, query, settle, settled_sql

# Customers with columns that hold each kind of entity.
CUSTOMER_CELLS = {
    "c_name": "c_name",
    "c_acctbal": "CAST(c_acctbal AS {text})",
    "email": "CASE WHEN c_nationkey < 20 THEN concat('user', CAST(c_custkey AS {text}), '@mail.example.com') END",
    "phone": "CASE WHEN c_nationkey < 5 THEN concat('+1 555-0', CAST(10 + c_nationkey AS {text}), '-1234') ELSE '' END",
    "ssn": "concat('id 123-45-', CAST(1000 + c_nationkey AS {text}), ' or 987-65-4321')",
    "card": "concat('4111 1111 1111 ', CAST(1000 + c_nationkey AS {text}))",
    "address": "concat('10.0.', CAST(c_nationkey AS {text}), '.7')",
    "country": "n_name",
    "region": "concat('in ', r_name, '.')",
}
JOINED = "customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def customer_cells(spark, sf):
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    joined = (
        load(spark, sf, "customer")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return joined.selectExpr("c_custkey", *[f"{e.format(text='string')} AS {n}" for n, e in CUSTOMER_CELLS.items()])


def place_names(spark, sf):
    nations = load(spark, sf, "nation").selectExpr("lower(n_name) AS name", "'GPE' AS label")
    return nations.unionByName(load(spark, sf, "region").selectExpr("lower(r_name) AS name", "'LOC' AS label"))


CELLS_SQL = " UNION ALL ".join(
    f"SELECT c_custkey, '{n}' AS column_name, {e.format(text='VARCHAR')} AS value FROM {JOINED}"
    for n, e in CUSTOMER_CELLS.items()
)
SAMPLE_SQL = f"""
    SELECT column_name, c_custkey, rank, value FROM (
      SELECT column_name, c_custkey, value, CAST(row_number() OVER (PARTITION BY column_name
        ORDER BY md5(column_name || '|' || CAST(c_custkey AS VARCHAR)), c_custkey) AS INTEGER) AS rank
      FROM ({CELLS_SQL}) WHERE value IS NOT NULL) WHERE rank <= 10"""


def counts_sql(text: str) -> dict[str, str]:
    """Matches per label, each taken out before the next label is counted."""
    counts = {}
    for label, pattern in V.ENTITY_PATTERNS.items():
        counts[label] = f"len(regexp_extract_all({text}, '{pattern}'))"
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return counts


def words_sql(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{WS}'), "
        r"lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"
    )


PLACES_SQL = "SELECT lower(n_name) AS name FROM nation UNION ALL SELECT lower(r_name) FROM region"
PAIRS_SQL = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"


def flagged_sql(cells: str, names: str) -> str:
    total = " + ".join(counts_sql("value").values())
    return f"""
    WITH s AS ({cells}),
    t AS (SELECT column_name, sum({total}) AS n, count(*) AS n_sampled FROM s GROUP BY column_name),
    g AS (SELECT column_name, count(*) AS n FROM
            (SELECT column_name, unnest({PAIRS_SQL}) AS name FROM
               (SELECT column_name, {words_sql("value")} AS ws FROM s)) JOIN ({names}) USING (name)
          GROUP BY column_name)
    SELECT column_name, CAST(t.n + coalesce(g.n, 0) AS BIGINT) AS n_entities, n_sampled,
      round((t.n + coalesce(g.n, 0)) / n_sampled, 6) AS ratio,
      (t.n + coalesce(g.n, 0)) / n_sampled >= 0.15 AS is_pii
    FROM t LEFT JOIN g USING (column_name)"""


@query("sample_per_column", SAMPLE_SQL)
def sample_per_column(spark, sf):
    return P.sample_cells(customer_cells(spark, sf), ["c_custkey"])


@query("pii_columns", flagged_sql(SAMPLE_SQL, PLACES_SQL))
def pii_columns(spark, sf):
    found = P.pii_columns(customer_cells(spark, sf), ["c_custkey"], gazetteer=place_names(spark, sf))
    return settle(found)


DOCUMENT_COLUMNS = ("text", "source", "lang", "n_chars")
DOCUMENT_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM documents" for c in DOCUMENT_COLUMNS
)
# The words of the benchmark texts stand in for a caller's list of names.
NAMES_SQL = f"""SELECT DISTINCT name FROM (SELECT unnest({words_sql("text")}) AS name FROM benchmark)"""


def benchmark_names(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(P.bare_words("text")).alias("name"))
    return words.distinct().select("name", F.lit("PERSON").alias("label"))


@query("pii_columns_full", flagged_sql(DOCUMENT_CELLS_SQL, NAMES_SQL))
def pii_columns_full(spark, sf):
    found = P.pii_columns_full(
        load(spark, sf, "documents"), list(DOCUMENT_COLUMNS), benchmark_names(spark, sf)
    )
    return settle(found)


ENTITY_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, CAST({n} AS BIGINT) AS n FROM documents"
    for label, n in counts_sql("text").items()
)


@query(
    "pii_entities",
    f"""
    SELECT doc_id, label, n FROM ({ENTITY_ROWS}) WHERE n > 0
    UNION ALL
    SELECT doc_id, 'PERSON' AS label, count(*) AS n
    FROM (SELECT doc_id, unnest({words_sql("text")}) AS name FROM documents) JOIN ({NAMES_SQL}) USING (name)
    GROUP BY doc_id""",
)
def pii_entities(spark, sf):
    return P.entity_counts(load(spark, sf, "documents"), "doc_id", "text", benchmark_names(spark, sf))


PAIR_NAMES_SQL = "SELECT DISTINCT ws[1] || ' ' || ws[2] AS name FROM (SELECT {words} AS ws FROM benchmark)"


@query(
    "pii_names_default",
    f"""
    SELECT doc_id, label, n FROM ({ENTITY_ROWS}) WHERE n > 0
    UNION ALL
    SELECT doc_id, 'PERSON' AS label, count(*) AS n
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS name
          FROM (SELECT doc_id, {words_sql("text")} AS ws FROM documents))
    JOIN ({PAIR_NAMES_SQL.format(words=words_sql("text"))}) USING (name) GROUP BY doc_id""",
)
def pii_names_default(spark, sf):
    """Names of two words are found without being told how long names are."""
    words = load(spark, sf, "benchmark").select(P.bare_words("text").alias("w"))
    names = words.select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("name")).distinct()
    return P.entity_counts(load(spark, sf, "documents"), "doc_id", "text", names.select("name", F.lit("PERSON").alias("label")))


JOB_SAMPLE_SQL = f"""
    SELECT column_name FROM (SELECT column_name, sum({" + ".join(counts_sql("value").values())}) AS n, count(*) AS m FROM ({SAMPLE_SQL})
    GROUP BY column_name) WHERE n / m >= 0.15"""


@query(
    "privacy_job",
    f"""
    SELECT 'customer' AS id, 'csv' AS file_type, '[' || (SELECT string_agg('"' || column_name || '"', ',' ORDER BY column_name) FROM ({JOB_SAMPLE_SQL})) || ']'
      AS privacy_detection_result
    UNION ALL SELECT 'nation', 'csv', 'no_pii_found' UNION ALL SELECT 'gone', 'csv', 'processing_error'""",
)
def privacy_job_query(spark, sf):
    """Tables are scanned, coded and upserted; one of them cannot be read."""
    catalog = spark.createDataFrame([("customer", "csv", None), ("nation", "csv", "older"), ("gone", "csv", None)], "id string, file_type string, privacy_detection_result string")

    def read(item, kind):
        return customer_cells(spark, sf) if item == "customer" else load(spark, sf, item)

    return privacy_job(catalog, "id", "file_type", read, lambda item: ["c_custkey" if item == "customer" else "n_nationkey"])


MESSAGE = (
    "CASE event_type WHEN 'click' THEN 'Analysis complete: No PII columns detected' "
    "WHEN 'view' THEN 'Analysis complete: No faces or eye landmarks detected' "
    "WHEN 'error' THEN CASE WHEN value < 10 THEN 'Download Failed: 404' WHEN value < 20 THEN 'Unsupported file type: exe' "
    "ELSE 'Processing Error: bad row' END "
    "WHEN 'purchase' THEN 'Success: Detected 2 PII column(s)' ELSE '  Done with all' END"
)


@query(
    "privacy_outcome",
    f"""
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN '["' || event_type || '","u' || user_id || '"]'
      WHEN event_type = 'click' THEN 'no_pii_found' WHEN event_type = 'view' THEN 'no_eyes_found'
      WHEN event_type = 'error' AND value >= 10 AND value < 20 THEN 'unsupported_format'
      WHEN event_type = 'error' THEN 'processing_error' ELSE 'done' END AS outcome
    FROM events""",
)
def privacy_outcome(spark, sf):
    found = F.expr("CASE WHEN event_type = 'purchase' THEN array(event_type, concat('u', user_id)) ELSE array() END")
    return load(spark, sf, "events").select("event_id", V.outcome_code(F.expr(MESSAGE), found).alias("outcome"))


STORED = (
    "CASE event_type WHEN 'click' THEN 'no_pii_found' WHEN 'view' THEN '[\"a\",\"b\",\"c\"]' "
    "WHEN 'error' THEN CASE WHEN value < 10 THEN 'processing_error' ELSE '[\"cut' END "
    "WHEN 'purchase' THEN '[[1,2,3,4],[5,6,7,8]]' END"
)
KIND = "CASE WHEN event_type = 'purchase' THEN 'eye_detection' WHEN value < 30 THEN 'pii_detection' END"


@query(
    "privacy_decode",
    f"""
    SELECT event_id, CASE WHEN r IS NULL THEN NULL
      WHEN r = 'no_pii_found' THEN 'No PII columns detected previously (from cache)'
      WHEN r = 'processing_error' THEN 'Previous processing resulted in an error (from cache)'
      WHEN NOT json_valid(r) THEN 'Error: Cached data is corrupt'
      WHEN k = 'eye_detection' THEN 'Retrieved ' || json_array_length(r) || ' eye region(s) from cache'
      WHEN k = 'pii_detection' THEN 'Retrieved ' || json_array_length(r) || ' PII column(s) from cache'
      ELSE 'Privacy detection results retrieved from cache' END AS message,
      CAST(CASE WHEN r IN ('no_pii_found', 'processing_error') THEN 0
        WHEN json_valid(r) THEN json_array_length(r) END AS INTEGER) AS n_found
    FROM (SELECT event_id, {STORED} AS r, {KIND} AS k FROM events)""",
)
def privacy_decode(spark, sf):
    rows = load(spark, sf, "events").selectExpr("event_id", f"{STORED} AS r", f"{KIND} AS k")
    return rows.select(
        "event_id", V.decoded_message("r", "k").alias("message"), V.decoded_size("r").cast("int").alias("n_found")
    )


FILE_TYPE = (
    "CASE event_type WHEN 'click' THEN 'JPG' WHEN 'view' THEN 'csv' WHEN 'error' THEN 'exe' "
    "WHEN 'signup' THEN 'Sav' END"
)


@query(
    "file_category",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'image' WHEN 'view' THEN 'data' WHEN 'signup' THEN 'data'
      ELSE 'unknown' END AS category FROM events""",
)
def file_category(spark, sf):
    return load(spark, sf, "events").select("event_id", V.file_category(F.expr(FILE_TYPE)).alias("category"))


FACE = {
    "x": "l_partkey",
    "y": "CAST(floor(l_extendedprice / 100) AS INT)",
    "w": "l_suppkey + 30",
    "h": "l_linenumber * 47 + 30",
}
FACE_SELECT = ", ".join(f"{e} AS {n}" for n, e in FACE.items())


@query(
    "eye_region_from_face",
    f"""
    WITH f AS (SELECT l_orderkey, l_linenumber, {FACE_SELECT} FROM lineitem),
    e AS (SELECT *, x + trunc(w * 0.15::DOUBLE) AS l, x + trunc(w * 0.85::DOUBLE) AS r,
                 y + trunc(h * 0.30::DOUBLE) AS t, y + trunc(h * 0.45::DOUBLE) AS b FROM f),
    p AS (SELECT *, trunc((r - l) * 0.15::DOUBLE) AS px, trunc((b - t) * 0.20::DOUBLE) AS py FROM e)
    SELECT l_orderkey, l_linenumber, CAST(greatest(0, l - px) AS INT) AS x1, CAST(greatest(0, t - py) AS INT) AS y1,
      CAST(least(1200, r + px) AS INT) AS x2, CAST(least(800, b + py) AS INT) AS y2 FROM p""",
)
def eye_region_from_face(spark, sf):
    faces = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in FACE.items()])
    box = V.eye_region("x", "y", "w", "h", F.lit(1200), F.lit(800))
    return faces.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in box.items()])


@query(
    "eye_bbox_landmarks",
    """
    WITH p AS (SELECT l_orderkey AS image_id, l_linenumber AS face_id, CAST(l_quantity AS INT) AS point,
                 CAST(l_partkey AS INT) AS x, CAST(floor(l_extendedprice / 100) AS INT) AS y FROM lineitem),
    e AS (SELECT image_id, face_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p
          WHERE point BETWEEN 36 AND 47 GROUP BY ALL),
    q AS (SELECT *, trunc((b - a) * 0.15::DOUBLE) AS px, trunc((d - c) * 0.15::DOUBLE) AS py FROM e)
    SELECT image_id, face_id, CAST(greatest(0, a - px) AS INT) AS x1, CAST(greatest(0, c - py) AS INT) AS y1,
      CAST(least(width, b + px) AS INT) AS x2, CAST(least(900, d + py) AS INT) AS y2
    FROM q JOIN (SELECT o_orderkey AS image_id, CAST(o_custkey AS INT) + 800 AS width FROM orders) USING (image_id)""",
)
def eye_bbox_landmarks(spark, sf):
    points = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS image_id",
        "l_linenumber AS face_id",
        "int(l_quantity) AS point",
        "int(l_partkey) AS x",
        "int(floor(l_extendedprice / 100)) AS y",
    )
    images = load(spark, sf, "orders").selectExpr("o_orderkey AS image_id", "int(o_custkey) + 800 AS width", "900 AS height")
    return P.eye_boxes(points, images)


DETECTION = ("l_orderkey AS image_id", "l_linenumber AS face_id", "l_returnflag AS detector", "l_partkey AS x1")


@query(
    "detect_fallback",
    f"""
    WITH d AS (SELECT {', '.join(DETECTION)} FROM lineitem)
    SELECT * FROM d WHERE detector = 'R'
    UNION ALL
    SELECT * FROM d WHERE detector = 'A' AND image_id NOT IN (SELECT image_id FROM d WHERE detector = 'R')""",
)
def detect_fallback(spark, sf):
    found = load(spark, sf, "lineitem").selectExpr(*DETECTION)
    return P.with_fallback(found.where("detector = 'R'"), found.where("detector = 'A'"))


@query(
    "eye_summary",
    """
    WITH c AS (SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN
      (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey)
    SELECT CASE WHEN n = 0 THEN 'Analysis complete: No faces or eye landmarks detected'
      ELSE 'Success: Detected ' || n || ' eye region(s)' END AS message,
      count(*) AS n_images, CAST(sum(n) AS BIGINT) AS n_regions
    FROM c GROUP BY message""",
)
def eye_summary(spark, sf):
    images = load(spark, sf, "orders").selectExpr("o_orderkey AS image_id")
    found = load(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS image_id")
    return P.outcome_totals(P.detection_summary(images, found))
