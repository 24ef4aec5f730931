"""Feature selection, specs, labels and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.stopwords import ENGLISH
from tabloom.operators import features as X, vectors as V
from tabloom.plans.ingest import feature_rows
from tabloom.sources.tables import add_stamp

from .base import WS, load, query, settle, settled_sql, sql_list
from .text import STRIPPED


@query(
    "select_features",
    "SELECT c_custkey AS cust_key, c_mktsegment AS market_segment FROM customer",
)
def select_features(spark, sf):
    clean = load(spark, sf, "customer").toDF("cust_key", "name", "nation", "balance", "market_segment")
    return X.select_features(clean, ["Cust Key", "Market Segment"])


SUPPLIER_SPEC = """{"featureGroupId": "g1", "tableName": "supplier_features", "status": "SUCCESS",
  "features": [{"name": "S AcctBal"}, {"name": "S SuppKey"}]}"""


@query(
    "preview_features",
    """SELECT s_acctbal AS s_acctbal, s_suppkey AS s_suppkey, '2024-01-02T03:04:05.000Z' AS fg_date FROM supplier""",
)
def preview_features(spark, sf):
    stamped = add_stamp(load(spark, sf, "supplier"), F.lit("2024-01-02 03:04:05"))
    spec = X.parse_spec(SUPPLIER_SPEC)
    return X.preview_features(stamped, spec)


@query(
    "add_fg_date",
    """
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS fg_date
    FROM orders""",
)
def add_fg_date(spark, sf):
    orders = load(spark, sf, "orders")
    return add_stamp(orders, F.col("o_orderdate")).select("o_orderkey", "o_totalprice", "fg_date")


@query(
    "spec_features",
    """
    SELECT p_partkey, p_name AS name, p_type AS feature_type, 'OneHot' AS extraction_algorithm,
           NULL AS text_cleaning, p_size > 25 AS partition_key FROM part
    UNION ALL
    SELECT p_partkey, p_brand, 'true text', NULL, 'standardize_letter_case,remove_punctuation', false FROM part""",
)
def spec_features(spark, sf):
    one = F.struct(
        F.col("p_name").alias("name"),
        F.col("p_type").alias("featureType"),
        F.lit("OneHot").alias("extractionAlgorithm"),
        F.lit(None).cast("array<string>").alias("textCleaning"),
        (F.col("p_size") > 25).alias("partitionKey"),
    )
    two = F.struct(
        F.col("p_brand").alias("name"),
        F.lit("true text").alias("featureType"),
        F.lit(None).cast("string").alias("extractionAlgorithm"),
        F.array(F.lit("standardize_letter_case"), F.lit("remove_punctuation")).alias("textCleaning"),
        F.lit(False).alias("partitionKey"),
    )
    specs = load(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.array(one, two).alias("features"))).alias("spec"))
    return X.spec_features(specs, "spec", keep=["p_partkey"]).select(
        "p_partkey",
        "name",
        "feature_type",
        "extraction_algorithm",
        F.array_join("text_cleaning", ",").alias("text_cleaning"),
        "partition_key",
    )


@query(
    "apply_value_labels",
    """
    SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS c_nationkey, c_mktsegment
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON n_nationkey = c_nationkey""",
)
def apply_value_labels(spark, sf):
    labels = load(spark, sf, "nation").where("n_regionkey <> 3").select(
        F.lit("c_nationkey").alias("column"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")
    )
    customers = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return X.apply_value_labels(customers, labels, ["c_nationkey"])


PLANTED = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_tax": "nullif(l_tax, 0)",
    "l_returnflag": "nullif(l_returnflag, 'A')",
}
PLANTED_SELECT = ", ".join(f"{e} AS {n}" for n, e in PLANTED.items())


@query(
    "profile_fill_zero",
    f"""
    SELECT l_orderkey, l_linenumber, coalesce(l_tax, 0) AS l_tax, coalesce(l_returnflag, '0') AS l_returnflag
    FROM (SELECT {PLANTED_SELECT} FROM lineitem)""",
)
def profile_fill_zero(spark, sf):
    return X.fill_zero(load(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PLANTED.items()]))


@query(
    "drop_null_rows",
    f"""
    SELECT * FROM (SELECT {PLANTED_SELECT} FROM lineitem) WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL""",
)
def drop_null_rows(spark, sf):
    return X.drop_null_rows(load(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PLANTED.items()]))


@query(
    "feature_tfidf",
    f"""
    WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{WS}')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
    SELECT doc_id, term, tf, df,
      {settled_sql("tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))")} AS tfidf
    FROM c JOIN d USING (term)""",
)
def feature_tfidf(spark, sf):
    return settle(X.tfidf(load(spark, sf, "documents"), "doc_id", "text"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "feature_onehot",
    "SELECT event_id, event_type, "
    + ", ".join(f"CAST(event_type = '{v}' AS INTEGER) AS event_type_{v}" for v in EVENT_TYPES)
    + " FROM events",
)
def feature_onehot(spark, sf):
    return X.one_hot(load(spark, sf, "events").select("event_id", "event_type"), "event_type")


@query(
    "feature_onehot_vector",
    """
    WITH d AS (SELECT value, row_number() OVER (ORDER BY encode(value)) - 1 AS number
      FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id IS NOT NULL))
    SELECT event_id, (SELECT count(*) FROM d) AS size, CAST(number AS VARCHAR) AS indices, 1.0::DOUBLE AS total
    FROM events LEFT JOIN d ON CAST(user_id AS VARCHAR) = d.value""",
)
def feature_onehot_vector(spark, sf):
    """Every user a place of a sparse vector."""
    rows = V.one_hot_vector(load(spark, sf, "events").select("event_id", "user_id"), "user_id", "v")
    total = F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x).alias("total")
    return rows.select("event_id", "v.size", F.array_join(F.col("v.indices").cast("array<string>"), ",").alias("indices"), total)


@query(
    "feature_tfidf_vector",
    f"""
    WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{WS}')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    d AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, encode(term)) - 1 AS number FROM c GROUP BY term),
    e AS (SELECT doc_id, number, CAST(round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) * 1000) AS BIGINT) AS weight FROM c JOIN d USING (term))
    SELECT doc_id, (SELECT count(*) FROM d) AS size, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number), '') AS indices,
      coalesce(string_agg(CAST(weight AS VARCHAR), ',' ORDER BY number), '') AS weights
    FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
)
def feature_tfidf_vector(spark, sf):
    """Sparse vectors with the most frequent terms first; weights in thousandths."""
    rows = V.tfidf_vector(load(spark, sf, "documents"), "doc_id", "text", by_frequency=True)
    weights = F.transform("vector.values", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    indices = F.col("vector.indices").cast("array<string>")
    return rows.select("doc_id", "vector.size", F.array_join(indices, ",").alias("indices"), F.array_join(weights, ",").alias("weights"))


@query(
    "labels_repeated_code",
    """
    SELECT c_custkey, n_name AS c_nationkey, c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def labels_repeated_code(spark, sf):
    """Every code listed once per customer of the nation: rows stay as many as they are."""
    customers = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    listed = customers.join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    labels = listed.select(F.lit("c_nationkey").alias("column"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return X.apply_value_labels(customers, labels, ["c_nationkey"])


TEXT_SPEC = {
    "features": [
        {"name": "doc id"},
        {
            "name": "Text",
            "text_cleaning": ["remove_stop_words", "remove_punctuation", "standardize_letter_case"],
            "language": "english",
        },
        {"name": "lang", "extraction_algorithm": "OneHot"},
    ]
}


@query(
    "feature_text_clean",
    f"""
    SELECT doc_id, array_to_string(list_filter(list_transform({STRIPPED}, lambda w: lower(w)),
        lambda w: NOT list_contains([{sql_list(ENGLISH)}], w)), ' ') AS text, lang,
      CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'en' AS INTEGER) AS lang_en,
      CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr
    FROM documents""",
)
def feature_text_clean(spark, sf):
    source = load(spark, sf, "documents").select(F.col("doc_id").alias("Doc ID"), F.col("text").alias("TEXT"), "lang")
    return feature_rows(source, TEXT_SPEC)
