"""Clean names, on data and on metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import names as N
from tabloom.functions.privacy import report_id

from .base import WS, load, query


@query(
    "clean_column_names",
    """
    SELECT c_custkey AS customer_key, c_name AS fullname, c_acctbal AS balance_usd, c_mktsegment AS mkt_segment
    FROM customer""",
)
def clean_column_names(spark, sf):
    messy = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("Customer  Key"),
        F.col("c_name").alias("Full.Name"),
        F.col("c_acctbal").alias("Balance (USD)"),
        F.col("c_mktsegment").alias("MKT\tSegment!"),
    )
    return N.clean_column_names(messy)


@query(
    "clean_name_expr",
    f"""
    SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '{WS}', '_', 'g'),
      '[^A-Za-z0-9_]', '', 'g')) AS clean_name FROM part""",
)
def clean_name_expr(spark, sf):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return load(spark, sf, "part").select("p_partkey", N.clean_name(raw).alias("clean_name"))


@query(
    "clean_table_name",
    f"""
    SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '{WS}', '_', 'g'),
      '[^A-Za-z0-9_]', '', 'g') AS table_name FROM customer""",
)
def clean_table_name(spark, sf):
    raw = F.concat_ws(" ", "c_name", "c_mktsegment")
    return load(spark, sf, "customer").select("c_custkey", N.clean_table_name_expr(raw).alias("table_name"))


@query(
    "camel_to_snake",
    r"""
    SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '') || p_brand || p_type,
      '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM part""",
)
def camel_to_snake(spark, sf):
    raw = F.concat(F.expr("replace(p_name, ' ', '')"), "p_brand", "p_type")
    return load(spark, sf, "part").select("p_partkey", N.camel_to_snake(raw).alias("snake"))


@query("report_id", "SELECT p_partkey, replace(replace(p_name, ' ', '_') || '_' || p_type, '_', '-') AS id FROM part")
def report_id_query(spark, sf):
    raw = F.concat(F.expr("replace(p_name, ' ', '_')"), F.lit("_"), "p_type")
    return load(spark, sf, "part").select("p_partkey", report_id(raw).alias("id"))
