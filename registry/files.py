"""Sources and sinks: everything written goes to a new path under the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.plans.ingest import append_csv, create_feature_group, import_csv
from tabloom.plans.training import create_training_set, preview_training_set
from tabloom.session import scratch_path, scratch_table, shared_root
from tabloom.sources import delimited as D, online, tables as T

from .base import WS, load, query, settle, settled_sql, texts, texts_sql

PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
SUPPLIER = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def write_csv(df: DataFrame, label: str, delimiter: str) -> str:
    path = scratch_path(df.sparkSession, label)
    T.export_csv(df, path, delimiter)
    return path


def write_lines(df: DataFrame, line: str, header: str, label: str) -> str:
    """Raw lines with a raw header in every file."""
    path = scratch_path(df.sparkSession, label)
    lines = df.select(F.expr(line).alias(header))
    lines.write.options(header=True, sep="\u0001", quote="\u0000").csv(path)
    return path


@query(
    "scan_csv_detect",
    f"""SELECT {texts_sql(c for c in PART if c != 'p_name')}, 'a "b"; ' || p_name || chr(10) || 'x,y' AS p_name FROM part""",
)
def scan_csv_detect(spark, sf):
    rows = load(spark, sf, "part").withColumn("p_name", F.expr("concat('a \"b\"; ', p_name, '\\n', 'x,y')"))
    return D.read_csv(spark, write_csv(rows, "parts", ";"))


@query("scan_csv_delim", f"SELECT {texts_sql(SUPPLIER)} FROM supplier")
def scan_csv_delim(spark, sf):
    return D.read_delimited(spark, write_csv(load(spark, sf, "supplier"), "suppliers", "|"), "|")


@query(
    "scan_csv_lenient",
    """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
      CASE WHEN c_nationkey < 22 THEN c_acctbal END AS c_acctbal
    FROM customer WHERE c_nationkey >= 3""",
)
def scan_csv_lenient(spark, sf):
    line = """concat_ws(';', c_custkey, c_name, c_nationkey,
        CASE WHEN c_nationkey < 3 THEN concat(c_acctbal, ';extra') WHEN c_nationkey < 22 THEN string(c_acctbal) END)"""
    path = write_lines(load(spark, sf, "customer"), line, "c_custkey;c_name;c_nationkey;c_acctbal", "lenient")
    return D.read_lenient(spark, path)


@query(
    "scan_txt_detect",
    "SELECT CAST(s_suppkey AS VARCHAR) AS suppkey, s_name AS name, CAST(s_acctbal AS VARCHAR) AS acctbal FROM supplier",
)
def scan_txt_detect(spark, sf):
    line = "concat(s_suppkey, '   ', s_name, ' ', s_acctbal)"
    return D.read_text_table(spark, write_lines(load(spark, sf, "supplier"), line, "suppkey name  acctbal", "words"))


@query(
    "scan_csv_mixed_headers",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size <= 20 THEN p_brand END AS p_brand,
         CASE WHEN p_size > 40 THEN p_type || chr(10) || 'x' END AS p_type FROM part""",
)
def scan_csv_mixed_headers(spark, sf):
    """Three groups of files in one folder: other columns, in another order, one with records that span lines."""
    rows, path = load(spark, sf, "part"), scratch_path(spark, "mixed")
    for where, columns in {
        "p_size <= 20": ["p_partkey", "p_brand", "p_name"],
        "p_size > 20 AND p_size <= 40": ["p_name", "p_partkey"],
        "p_size > 40": ["concat(p_type, '\\nx') AS p_type", "p_partkey", "p_name"],
    }.items():
        rows.where(where).selectExpr(*columns).write.options(header=True, escape='"').mode("append").csv(path)
    return D.read_csv(spark, path)


@query(
    "scan_csv_long_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_nationkey >= 3",
)
def scan_csv_long_rows(spark, sf):
    line = "concat_ws(',', c_custkey, c_name, CASE WHEN c_nationkey < 3 THEN 'extra' END)"
    path = write_lines(load(spark, sf, "customer"), line, "c_custkey,c_name", "long")
    return D.read_csv(spark, path, long_rows="drop")


@query(
    "scan_csv_rejects",
    """SELECT concat_ws(',', c_custkey, c_name, repeat('x,', c_nationkey) || 'extra') AS row, c_nationkey + 3 AS n_fields, 2 AS n_columns
       FROM customer WHERE c_nationkey < 3""",
)
def scan_csv_rejects(spark, sf):
    """The rows that a reader leaves out because they have too many fields."""
    line = "concat_ws(',', c_custkey, c_name, CASE WHEN c_nationkey < 3 THEN concat(repeat('x,', c_nationkey), 'extra') END)"
    path = write_lines(load(spark, sf, "customer"), line, "c_custkey,c_name", "rejects")
    return D.rejected_rows(spark, path).drop("file")


@query(
    "scan_csv_na_markers",
    """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey,
         CASE WHEN c_nationkey % 4 <> 1 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_nationkey % 5 <> 2 THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def scan_csv_na_markers(spark, sf):
    rows = load(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'NA' ELSE string(c_nationkey) END AS c_nationkey",
        "CASE WHEN c_nationkey % 4 = 1 THEN 'NaN' ELSE string(c_acctbal) END AS c_acctbal",
        "CASE WHEN c_nationkey % 5 = 2 THEN 'n/a' ELSE c_mktsegment END AS c_mktsegment",
    )
    return D.read_lenient(spark, write_csv(rows, "markers", ","))


@query("scan_training_set", f"SELECT {texts_sql(PART)} FROM part")
def scan_training_set(spark, sf):
    path = scratch_path(spark, "training")
    T.save_training_set(load(spark, sf, "part"), path)
    return D.read_training_set(spark, path)


@query("scan_table", "SELECT *, '2024-01-02T03:04:05.000Z' AS fg_date FROM part")
def scan_table(spark, sf):
    table = scratch_table("part_features")
    stamp = F.lit("2024-01-02 03:04:05")
    T.save_feature_table(load(spark, sf, "part"), table, scratch_path(spark, table), stamp_at=stamp)
    return T.scan_table(spark, table)


@query(
    "online_json_rows",
    """
    WITH e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
    SELECT event_id, k FROM e WHERE event_type IN ('click', 'view')
    UNION ALL SELECT event_id, k FROM e WHERE event_type = 'click'""",
)
def online_json_rows(spark, sf):
    stored = load(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN 'string' WHEN 'view' THEN 'list' ELSE 'hash' END AS kind",
        "CASE event_type WHEN 'click' THEN concat('[', props, ',', props, ']') ELSE props END AS payload",
    )
    return online.json_rows(stored, "kind", "payload", keep=["event_id"])


@query(
    "online_json_schema",
    """SELECT event_id, CASE WHEN event_type <> 'click' THEN user_id END AS user_id,
         CASE WHEN event_type = 'click' THEN CAST(value AS DOUBLE) END AS value,
         CASE WHEN event_type = 'view' THEN props END AS props FROM events""",
)
def online_json_schema(spark, sf):
    """Payloads whose fields differ by event type; none holds all of them."""
    stored = load(spark, sf, "events").selectExpr(
        "'list' AS kind",
        """CASE event_type WHEN 'click' THEN to_json(struct(event_id, value))
           WHEN 'view' THEN to_json(struct(event_id, user_id, props)) ELSE to_json(struct(event_id, user_id)) END AS payload""",
    )
    return online.json_rows(stored, "kind", "payload").select("event_id", "user_id", "value", "props")


@query(
    "online_members",
    "SELECT user_id || ':' || event_type || ':' || event_id AS key, CAST(event_id AS VARCHAR) AS value FROM events",
)
def online_members(spark, sf):
    member = F.concat_ws(":", "user_id", "event_type", "event_id")
    return online.set_members(load(spark, sf, "events"), member)


@query(
    "sink_feature_table",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""",
)
def sink_feature_table(spark, sf):
    table = scratch_table("orders_features")
    T.save_feature_table(load(spark, sf, "orders"), table, scratch_path(spark, table), ["o_orderstatus"])
    stored = T.scan_table(spark, table).drop(T.STAMP_COLUMN)
    return stored.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def customer_csv(spark, sf, where: str) -> str:
    rows = load(spark, sf, "customer").where(where).select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Name!"), F.col("c_acctbal").alias("Acct-Bal")
    )
    return write_csv(rows, "customers", "|")


CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_name AS name,
    CAST(c_acctbal AS VARCHAR) AS acctbal, '2024-01-02T03:04:05.000Z' AS fg_date FROM customer"""
STAMP = "2024-01-02 03:04:05"


@query("ingest_csv_new", CUSTOMER_TEXT)
def ingest_csv_new(spark, sf):
    name = import_csv(
        spark, customer_csv(spark, sf, "true"), scratch_table("New Customers"), shared_root(spark), "|", F.lit(STAMP)
    )
    return T.scan_table(spark, name)


@query("ingest_csv_append", CUSTOMER_TEXT)
def ingest_csv_append(spark, sf):
    low, high = customer_csv(spark, sf, "c_acctbal < 5000"), customer_csv(spark, sf, "c_acctbal >= 5000")
    name = import_csv(spark, low, scratch_table("customers"), shared_root(spark), "|", F.lit(STAMP))
    append_csv(spark, high, name, "|", F.lit(STAMP))
    return T.scan_table(spark, name)


GROUP_SPEC = """{"featureGroupId": "g7", "tableName": "%s", "dataType": "csv", "partitionKeys": ["Mkt Segment"],
  "features": [{"name": "Cust Key"}, {"name": "Mkt Segment"},
    {"name": "Full Name", "textCleaning": ["standardize_letter_case", "remove_punctuation"]}]}"""


@query(
    "feature_group_create",
    """SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_mktsegment AS mkt_segment,
       replace(lower(c_name), '#', '  ') AS full_name FROM customer""",
)
def feature_group_create(spark, sf):
    source = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("Cust Key"),
        F.col("c_name").alias("Full Name"),
        F.col("c_acctbal").alias("Unused"),
        F.col("c_mktsegment").alias("Mkt Segment"),
    )
    spec = create_feature_group(
        spark, GROUP_SPEC % scratch_table("customer_group"), write_csv(source, "group", "\t"), shared_root(spark)
    )
    return T.scan_table(spark, spec["table_name"]).drop(T.STAMP_COLUMN)


TFIDF_SPEC = """{"featureGroupId": "g8", "tableName": "%s", "dataType": "csv",
  "features": [{"name": "Event Id"}, {"name": "Props", "extractionAlgorithm": "TF-IDF"}]}"""


@query(
    "feature_group_tfidf",
    f"""
    WITH w AS (SELECT event_id, unnest(regexp_split_to_array(lower(event_type || ' ' || props), '{WS}')) AS term FROM events),
    c AS (SELECT event_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
    SELECT CAST(event_id AS VARCHAR) AS event_id, term,
      {settled_sql("tf * ln(((SELECT count(*) FROM events) + 1) / (df + 1))")} AS weight FROM c JOIN d USING (term)""",
)
def feature_group_tfidf(spark, sf):
    source = load(spark, sf, "events").selectExpr("event_id AS `Event Id`", "concat(event_type, ' ', props) AS Props", "value AS Unused")
    spec = create_feature_group(spark, TFIDF_SPEC % scratch_table("event_group"), write_csv(source, "group", "|"), shared_root(spark))
    stored = T.scan_table(spark, spec["table_name"])
    return settle(stored.select("event_id", F.explode("props_tfidf").alias("term", "weight")))


@query("sink_training_csv", f"SELECT {texts_sql(CUSTOMER)} FROM customer")
def sink_training_csv(spark, sf):
    path = scratch_path(spark, "training")
    T.save_training_set(load(spark, sf, "customer"), path)
    return D.read_csv(spark, path)


@query("export_csv", f"SELECT {texts_sql(('doc_id', 'text', 'lang', 'source', 'n_chars'))} FROM documents")
def export_csv(spark, sf):
    path = scratch_path(spark, "export")
    T.export_csv(load(spark, sf, "documents"), path)
    return D.read_csv(spark, path)


@query("export_pipe_csv", f"SELECT {texts_sql(PART)} FROM part")
def export_pipe_csv(spark, sf):
    path = scratch_path(spark, "pipes")
    T.export_csv(load(spark, sf, "part"), path, "|")
    return D.read_delimited(spark, path, "|")


@query(
    "alter_add_columns",
    """SELECT *, '2024-01-02T03:04:05.000Z' AS fg_date, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS owner
       FROM supplier""",
)
def alter_add_columns(spark, sf):
    table = scratch_table("supplier_features")
    stamp = F.lit(STAMP)
    T.save_feature_table(load(spark, sf, "supplier"), table, scratch_path(spark, table), stamp_at=stamp)
    T.add_string_columns(spark, table, ["s_name", "note", "owner"])
    return T.scan_table(spark, table)


@query("drop_table", "SELECT count(*) AS n_rows, true AS existed, false AS remains FROM supplier")
def drop_table(spark, sf):
    table = scratch_table("supplier_features")
    T.save_feature_table(load(spark, sf, "supplier"), table, scratch_path(spark, table))
    existed = spark.catalog.tableExists(table)
    T.drop_table(spark, table)
    remains = spark.catalog.tableExists(table)
    return load(spark, sf, "supplier").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(existed).alias("existed"), F.lit(remains).alias("remains")
    )


@query(
    "table_size",
    "SELECT unnest(['orders', 'part', 'supplier']) AS source, true AS matches",
)
def table_size(spark, sf):
    """Sizes from listings against the sizes that Spark reports with the rows of each file."""
    names = {}
    for source in ("supplier", "part", "orders"):
        names[source] = scratch_table(source)
        T.save_feature_table(load(spark, sf, source), names[source], scratch_path(spark, names[source]))
    listed = T.table_sizes(spark, [*names.values(), "no_such_table"])
    found = None
    for source, table in names.items():
        files = T.scan_table(spark, table).select("_metadata.file_path", "_metadata.file_size").distinct()
        size = files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
        size = size.select(F.lit(table).alias("table_name"), F.lit(source).alias("source"), "files", "bytes")
        found = size if found is None else found.unionByName(size)
    same = (F.col("files") == F.col("n_files")) & (F.col("bytes") == F.col("total_bytes"))
    return found.join(listed, "table_name", "left").select("source", F.coalesce(same, F.lit(False)).alias("matches"))


@query("training_set_create", f"SELECT {texts_sql(SUPPLIER)}, '2024-01-02T03:04:05.000Z' AS fg_date FROM supplier")
def training_set_create(spark, sf):
    table = scratch_table("supplier_features")
    stamp = F.lit(STAMP)
    T.save_feature_table(load(spark, sf, "supplier"), table, scratch_path(spark, table), stamp_at=stamp)
    path = create_training_set(spark, table, shared_root(spark), table)
    return preview_training_set(spark, path)


@query(
    "training_set_delete",
    """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, false AS outside, true AS inside, false AS remains
       FROM supplier""",
)
def training_set_delete(spark, sf):
    """Two training sets: one may be deleted, the other lies outside the allowed folder and is read afterwards."""
    root, other = scratch_path(spark, "deletable"), scratch_path(spark, "other")
    rows = load(spark, sf, "supplier")
    gone, kept = T.training_set_path(root, "1"), T.training_set_path(other, "2")
    for path in (gone, kept):
        T.save_training_set(rows, path)
    outside = T.delete_training_set(spark, kept, root)
    inside = T.delete_training_set(spark, gone, root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(gone)
    remains = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    flags = {"outside": outside, "inside": inside, "remains": bool(remains)}
    return D.read_training_set(spark, kept).select("s_suppkey", *[F.lit(v).alias(k) for k, v in flags.items()])
