"""Catalog filters, joins, listings, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import catalog as C
from tabloom.plans.profiling import profile_pending
from tabloom.operators.profile import numeric_profile
from tabloom.session import scratch_path, scratch_table, written
from tabloom.sources import ranges as R, stored as S

from .base import load, query, settle, settled_sql
from .text import CUSTOMER_PERMISSION

# Stand-ins for the catalog tables: customers are datasets, orders their file versions.
SEGMENT_STATUS = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 WHEN 'HOUSEHOLD' THEN 2 "
    "WHEN 'AUTOMOBILE' THEN 3 END"
)
PRIORITY_TYPE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'csv' WHEN '2-HIGH' THEN 'tsv' WHEN '3-MEDIUM' THEN 'pdf' "
    "WHEN '4-NOT SPECIFIED' THEN 'xlsx' ELSE 'sav' END"
)
ORDER_STATUS = "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 ELSE 2 END"

ALL_ITEMS_SQL = f"""
    SELECT c_custkey AS datasetid, o_orderkey AS id, {PRIORITY_TYPE} AS file_type,
           {SEGMENT_STATUS} AS dataset_preprocessed
    FROM customer JOIN orders ON o_custkey = c_custkey"""
ITEMS_SQL = f"SELECT * FROM ({ALL_ITEMS_SQL}) WHERE file_type IN ('csv', 'tsv', 'xls', 'xlsx', 'sav')"


def datasets(spark, sf):
    return load(spark, sf, "customer").selectExpr(
        "c_custkey AS datasetid", "c_custkey AS latest_version", f"{SEGMENT_STATUS} AS dataset_preprocessed"
    )


def items(spark, sf, types=C.PROFILED_TYPES):
    orders = load(spark, sf, "orders")
    versions = orders.selectExpr("o_custkey AS version_id", "o_orderkey AS file_item_id")
    files = orders.selectExpr("o_orderkey AS id", f"{PRIORITY_TYPE} AS file_type")
    return C.catalog_items(datasets(spark, sf), versions, files, types)


@query(
    "filter_visible",
    f"SELECT c_custkey, c_name FROM customer WHERE {CUSTOMER_PERMISSION} IN (0, 2) AND NOT (c_nationkey = 24)",
)
def filter_visible(spark, sf):
    rows = load(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name", f"{CUSTOMER_PERMISSION} AS permission", "c_nationkey = 24 AS hidden"
    )
    return C.visible(rows, "permission", "hidden").select("c_custkey", "c_name")


@query("filter_optional", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def filter_optional(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.matching(rows, o_orderstatus="F", o_orderpriority=None)


PENDING_COLUMNS = (
    "o_orderkey",
    f"{ORDER_STATUS} AS dataprep_status",
    "nullif(o_orderpriority, '5-LOW') AS table_name",
    "CASE WHEN o_totalprice < 250000 THEN 'csv' ELSE 'tfrecord' END AS dataset_format",
)


@query(
    "pending_queue",
    f"""
    SELECT o_orderkey, table_name FROM (SELECT {', '.join(PENDING_COLUMNS)} FROM orders)
    WHERE dataprep_status = 1 AND table_name IS NOT NULL AND dataset_format = 'csv'""",
)
def pending_queue(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(*PENDING_COLUMNS)
    queue = C.pending_queue(rows, "dataprep_status", "table_name", "dataset_format", "csv")
    return queue.select("o_orderkey", "table_name")


@query("catalog_by_status", f"SELECT id, file_type FROM ({ITEMS_SQL}) WHERE dataset_preprocessed = 1")
def catalog_by_status(spark, sf):
    return C.items_by_status(items(spark, sf), C.PENDING)


@query("catalog_by_id", f"SELECT id, file_type, dataset_preprocessed FROM ({ITEMS_SQL}) WHERE id = 25")
def catalog_by_id(spark, sf):
    return C.item_by_id(items(spark, sf), 25)


PDF_SQL = f"(SELECT min(id) FROM ({ALL_ITEMS_SQL}) WHERE file_type = 'pdf' AND dataset_preprocessed IS NOT NULL)"


@query("catalog_status", f"SELECT dataset_preprocessed FROM ({ALL_ITEMS_SQL}) WHERE id = {PDF_SQL}")
def catalog_status(spark, sf):
    """The status of a file of a type that is not profiled."""
    every = items(spark, sf, types=None)
    wanted = every.where("file_type = 'pdf' AND dataset_preprocessed IS NOT NULL").agg(F.min("id")).scalar()
    return every.where(F.col("id") == wanted).select("dataset_preprocessed")


@query(
    "status_update",
    f"""
    SELECT c_custkey AS datasetid, c_custkey AS latest_version,
      CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
           THEN 2 ELSE {SEGMENT_STATUS} END AS dataset_preprocessed
    FROM customer""",
)
def status_update(spark, sf):
    urgent = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    keys = urgent.select(F.col("o_custkey").alias("datasetid"))
    return C.set_status_where(datasets(spark, sf), "datasetid", "dataset_preprocessed", keys, C.RUNNING)


@query(
    "status_update_keyed",
    f"""
    WITH u AS (SELECT l_orderkey, nullif(max(l_linenumber) % 5, 4) AS new_status FROM lineitem
               WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN {ORDER_STATUS} ELSE new_status END AS dataprep_status
    FROM orders LEFT JOIN u ON l_orderkey = o_orderkey""",
)
def status_update_keyed(spark, sf):
    updates = (
        load(spark, sf, "lineitem").where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.expr("nullif(max(l_linenumber) % 5, 4)").alias("new_status"))
    )
    rows = load(spark, sf, "orders").selectExpr("o_orderkey", f"{ORDER_STATUS} AS dataprep_status")
    return C.set_status(rows, "o_orderkey", "dataprep_status", updates)


@query(
    "list_datasets",
    f"SELECT id, file_type, dataset_preprocessed FROM ({ITEMS_SQL}) ORDER BY id LIMIT 100 OFFSET 0",
)
def list_datasets(spark, sf):
    return C.listing(items(spark, sf), "id").select("id", "file_type", "dataset_preprocessed")


@query(
    "list_feature_groups",
    f"""
    SELECT c_name, dataprep_status FROM (SELECT c_name, {SEGMENT_STATUS} AS dataprep_status FROM customer)
    WHERE dataprep_status = 2 ORDER BY c_name LIMIT 50 OFFSET 30""",
)
def list_feature_groups(spark, sf):
    rows = load(spark, sf, "customer").selectExpr("c_name", f"{SEGMENT_STATUS} AS dataprep_status")
    return C.listing(rows, "c_name", limit=50, offset=30, dataprep_status=2)


@query(
    "list_training_sets",
    f"""
    SELECT o_orderkey, dataprep_status, dataset_format FROM (SELECT {', '.join(PENDING_COLUMNS)} FROM orders)
    WHERE dataset_format = 'csv' ORDER BY o_orderkey LIMIT 100 OFFSET 200""",
)
def list_training_sets(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(*PENDING_COLUMNS).drop("table_name")
    return C.listing(rows, "o_orderkey", offset=200, dataset_format="csv", dataprep_status=None)


@query(
    "list_total",
    f"SELECT count(*) AS total FROM (SELECT {', '.join(PENDING_COLUMNS)} FROM orders) WHERE dataset_format = 'csv'",
)
def list_total(spark, sf):
    return C.listing_total(load(spark, sf, "orders").selectExpr(*PENDING_COLUMNS), dataset_format="csv")


EVENT = (
    "CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'finish' "
    "WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'error' END"
)
CURRENT = "CASE WHEN value < 5 THEN 0 WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 WHEN value < 30 THEN 3 END"


@query(
    "status_transition",
    f"""
    SELECT event_id, CASE WHEN cur = 0 THEN 0 WHEN ev = 'request' THEN 1 WHEN ev = 'start' THEN 2
      WHEN ev = 'finish' THEN 0 WHEN ev = 'fail' THEN 3 WHEN ev = 'error' THEN NULL ELSE cur END AS status
    FROM (SELECT event_id, {EVENT} AS ev, {CURRENT} AS cur FROM events)""",
)
def status_transition(spark, sf):
    rows = load(spark, sf, "events").selectExpr("event_id", f"{EVENT} AS ev", f"{CURRENT} AS cur")
    return rows.select("event_id", C.next_status("cur", "ev").alias("status"))


PENDING_METRICS = ("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "profile_pending",
    f"""
    WITH q AS (SELECT o_orderpriority AS item, CASE WHEN o_orderpriority < '4' THEN 1 ELSE 2 END AS s FROM orders GROUP BY ALL),
    m AS ({" UNION ALL ".join(f"SELECT o_orderpriority AS item, '{c}' AS variable, count(*) AS n, avg({c}) AS mean FROM orders WHERE o_orderpriority NOT LIKE '2%' GROUP BY 1" for c in PENDING_METRICS)})
    SELECT item, CAST(CASE WHEN s <> 1 THEN s WHEN item LIKE '2%' THEN 3 ELSE 0 END AS INTEGER) AS dataprep_status,
      s = 1 AND item LIKE '2%' AS has_error, m.variable, m.n, {settled_sql("m.mean")} AS mean
    FROM q LEFT JOIN (SELECT m.* FROM m JOIN q USING (item) WHERE s = 1) m USING (item)""",
)
def profile_pending_query(spark, sf):
    """One item of the queue fails only when its rows are computed."""
    orders = load(spark, sf, "orders")
    queue = orders.select(F.col("o_orderpriority").alias("item")).distinct()
    queue = queue.selectExpr("item", "CASE WHEN item < '4' THEN 1 ELSE 2 END AS dataprep_status")
    broken = F.when(F.col("o_orderpriority").startswith("2"), F.raise_error(F.lit("unreadable row")).cast("bigint"))
    rows = orders.withColumn("o_custkey", F.coalesce(broken, "o_custkey"))
    run = profile_pending(
        queue,
        "item",
        "dataprep_status",
        load=lambda item: rows.where(F.col("o_orderpriority") == item),
        profile=lambda found: numeric_profile(found).select("variable", "n", "mean"),
    )
    errors = run.outcomes.select("item", F.col("error").contains("unreadable row").alias("has_error"))
    joined = run.catalog.join(run.reports, "item", "left").join(errors, "item", "left")
    return settle(joined.select("item", "dataprep_status", F.coalesce("has_error", F.lit(False)).alias("has_error"), "variable", "n", "mean"))


@query(
    "privacy_upsert",
    """
    WITH ch AS (SELECT doc_id, nullif(lang, 'en') AS r, source AS t FROM documents)
    SELECT coalesce(l.doc_id, ch.doc_id) AS doc_id,
      CASE WHEN ch.doc_id IS NULL THEN CAST(quality AS VARCHAR) ELSE r END AS privacy_detection_result,
      CASE WHEN ch.doc_id IS NULL THEN CAST(toxic AS VARCHAR) ELSE t END AS privacy_detection_type
    FROM labels l FULL JOIN ch ON ch.doc_id = l.doc_id""",
)
def privacy_upsert(spark, sf):
    stored = load(spark, sf, "labels").selectExpr(
        "doc_id", "string(quality) AS privacy_detection_result", "string(toxic) AS privacy_detection_type"
    )
    documents = load(spark, sf, "documents")
    older = documents.selectExpr(
        "doc_id", "'older' AS privacy_detection_result", "'older' AS privacy_detection_type", "0 AS run"
    )
    newer = documents.selectExpr(
        "doc_id", "nullif(lang, 'en') AS privacy_detection_result", "source AS privacy_detection_type", "1 AS run"
    )
    return C.upsert(stored, older.unionByName(newer), "doc_id", order="run")


@query(
    "upsert_null_order",
    """
    WITH ch AS (SELECT doc_id, source AS r, CASE WHEN doc_id % 2 = 0 THEN 1 END AS run, lang AS old FROM documents)
    SELECT coalesce(l.doc_id, ch.doc_id) AS doc_id,
      CASE WHEN ch.doc_id IS NULL THEN CAST(quality AS VARCHAR) WHEN run = 1 THEN r ELSE 'only' END AS privacy_detection_result
    FROM labels l FULL JOIN ch ON ch.doc_id = l.doc_id""",
)
def upsert_null_order(spark, sf):
    """Changes without an order come before those with one, and count where there is no other."""
    stored = load(spark, sf, "labels").selectExpr("doc_id", "string(quality) AS privacy_detection_result")
    documents = load(spark, sf, "documents")
    first = documents.selectExpr("doc_id", "'only' AS privacy_detection_result", "CAST(NULL AS INT) AS run")
    later = documents.where("doc_id % 2 = 0").selectExpr("doc_id", "source AS privacy_detection_result", "1 AS run")
    return C.upsert(stored, first.unionByName(later), "doc_id", order="run")


@query(
    "status_update_stored",
    """
    SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 AND c_nationkey < 4 THEN CAST(nullif(c_custkey % 20, 0) // 5 AS INTEGER)
      ELSE 1 END AS dataprep_status, c_nationkey FROM customer""",
)
def status_update_stored(spark, sf):
    """New statuses in a table partitioned by nation; only four nations are written again."""
    customers = load(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment", "1 AS dataprep_status", "c_nationkey")
    table = scratch_table("catalog")
    customers.write.format("orc").partitionBy("c_nationkey").option("path", scratch_path(spark, table)).saveAsTable(table)
    updates = customers.where("c_custkey % 5 = 0 AND c_nationkey < 4").selectExpr("c_custkey", "int(nullif(c_custkey % 20, 0) div 5) AS new_status")
    S.update_status(spark, table, "c_custkey", "dataprep_status", updates)
    return spark.table(table)


@query(
    "privacy_upsert_stored",
    """
    WITH ch AS (SELECT doc_id, nullif(lang, 'en') AS r, source AS t FROM documents)
    SELECT coalesce(l.doc_id, ch.doc_id) AS doc_id,
      CASE WHEN ch.doc_id IS NULL THEN CAST(quality AS VARCHAR) ELSE r END AS privacy_detection_result,
      CASE WHEN ch.doc_id IS NULL THEN CAST(toxic AS VARCHAR) ELSE t END AS privacy_detection_type
    FROM labels l FULL JOIN ch ON ch.doc_id = l.doc_id""",
)
def privacy_upsert_stored(spark, sf):
    """Results of a privacy run into a stored table in partitions by a hash of the key."""
    stored = load(spark, sf, "labels").selectExpr(
        "doc_id", "string(quality) AS privacy_detection_result", "string(toxic) AS privacy_detection_type"
    )
    table = scratch_table("privacy")
    S.save_keyed_table(stored, table, scratch_path(spark, table), "doc_id", 16)
    changes = load(spark, sf, "documents").selectExpr("doc_id", "nullif(lang, 'en') AS privacy_detection_result", "source AS privacy_detection_type")
    S.upsert_rows(spark, table, changes, "doc_id")
    return spark.table(table).drop(S.KEY_PART)


def sorted_orders(spark, sf):
    """Orders in a table of sorted files, and the ranges of their keys."""
    table = scratch_table("sorted")
    R.save_sorted_table(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), table, scratch_path(spark, table), "o_orderkey", 12)
    return table, written(R.file_ranges(spark, table, "o_orderkey"), "ranges")


@query(
    "catalog_by_id",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 700)",
)
def catalog_by_id(spark, sf):
    """One item of a stored table by its key."""
    table, ranges = sorted_orders(spark, sf)
    wanted = load(spark, sf, "orders").where("o_orderkey > 700").agg(F.min("o_orderkey")).scalar()
    return R.lookup(spark, table, ranges, "o_orderkey", wanted)


@query(
    "list_keyset",
    """
    SELECT page, o_orderkey, o_orderstatus, o_orderpriority FROM (
      SELECT 'first' AS page, * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
      UNION ALL SELECT 'middle', * FROM (SELECT * FROM orders WHERE o_orderkey > (SELECT median(o_orderkey) // 1 FROM orders) ORDER BY o_orderkey LIMIT 100)
      UNION ALL SELECT 'last', * FROM (SELECT * FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - 30 FROM orders) ORDER BY o_orderkey LIMIT 100))""",
)
def list_keyset(spark, sf):
    """Three pages of a stored table, each from the files that hold it."""
    table, ranges = sorted_orders(spark, sf)
    ends = load(spark, sf, "orders").agg(F.floor(F.median("o_orderkey")).alias("middle"), (F.max("o_orderkey") - 30).alias("last")).first()
    pages = [R.keyset_page(spark, table, ranges, "o_orderkey", after).withColumn("page", F.lit(name)) for name, after in (("first", None), ("middle", ends["middle"]), ("last", ends["last"]))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])
