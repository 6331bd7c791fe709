"""The provided tables in the shapes of the message corpus: pure projections, the same in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf}/{name}.parquet"))


#: Rows of a task whose work on a row costs far more than reading it, such as parsing a message, and of one that sorts or groups.
ROWS, GROUPED_ROWS = 2_000, 250_000


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of about so many rows a table asks for; their number grows with it, not what each of them holds."""
    return max(1, math.ceil(df.count() / rows))


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """A table's rows dealt to as many tasks as their number asks for: a small file is one task, however many rows it has."""
    return df.repartition(tasks(df, rows), *keys)


def messages(spark, sf) -> DataFrame:
    scope = F.when(F.col("o_orderstatus") == "F", "org").otherwise("restricted")
    return table(spark, sf, "orders").select(F.lit("org").alias("org_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("person_id"), F.col("o_orderdate").alias("received_at"), scope.alias("visibility_scope"), F.col("o_custkey").alias("sender"), F.col("o_orderpriority").alias("subject"), F.col("o_totalprice").alias("size"))


def recipients(spark, sf) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "to").when(F.col("l_returnflag") == "N", "cc").otherwise("reply_to")
    return table(spark, sf, "lineitem").select(F.lit("org").alias("org_id"), F.col("l_orderkey").alias("email_id"), F.col("l_linenumber").alias("line"), kind.alias("kind"), (F.col("l_suppkey") % 100).alias("person_id"), F.col("l_suppkey").alias("address"))


def grants(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_returnflag").alias("flag"))
    return rows.select(F.lit("org").alias("org_id"), F.lit("email_message").alias("object_type"), F.col("l_orderkey").alias("object_id"), (F.col("l_suppkey") % 100).alias("person_id"), F.when(F.col("flag") == "R", F.lit("2000-01-01").cast("timestamp")).alias("revoked_at"), F.col("l_suppkey").alias("address"))


def persons(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.lit("org").alias("org_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"))


def links(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.lit("org").alias("org_id"), F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("company_id"))


def thread(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations").where("not (turn = 0 and conv_id % 10 = 0)")
    return rows.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))).alias("in_reply_to"), "role", "text")


def attachments(spark, sf) -> DataFrame:
    status = F.when(F.col("n_chars") < 200, "empty").when(F.col("n_chars") > 5000, "truncated").otherwise("extracted")
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), status.alias("extraction_status"))


#: The same in DuckDB SQL, as common table expressions.
SQL = {
    "messages": "SELECT 'org' AS org_id, o_orderkey AS id, o_custkey % 100 AS person_id, o_orderdate AS received_at, CASE WHEN o_orderstatus = 'F' THEN 'org' ELSE 'restricted' END AS visibility_scope, o_custkey AS sender, o_orderpriority AS subject, o_totalprice AS size FROM orders",
    "recipients": "SELECT 'org' AS org_id, l_orderkey AS email_id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'to' WHEN 'N' THEN 'cc' ELSE 'reply_to' END AS kind, l_suppkey % 100 AS person_id, l_suppkey AS address FROM lineitem",
    "grants": "SELECT 'org' AS org_id, l_orderkey AS object_id, l_suppkey % 100 AS person_id, CASE WHEN max(l_returnflag) = 'R' THEN TIMESTAMP '2000-01-01' END AS revoked_at, l_suppkey AS address FROM lineitem GROUP BY l_orderkey, l_suppkey",
    "persons": "SELECT c_custkey AS id, c_name AS display_name FROM customer",
    "links": "SELECT c_custkey AS person_id, c_nationkey AS company_id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
    "thread": "SELECT conv_id, turn, concat_ws('-', conv_id, turn) AS message_id, CASE WHEN turn > 0 THEN concat_ws('-', conv_id, turn - 1) END AS in_reply_to, role, text FROM conversations WHERE NOT (turn = 0 AND conv_id % 10 = 0)",
    "attachments": "SELECT doc_id, text, lang, source, n_chars AS size_bytes, sha256(text) AS content_hash, CASE WHEN n_chars < 200 THEN 'empty' WHEN n_chars > 5000 THEN 'truncated' ELSE 'extracted' END AS extraction_status FROM documents",
}


def with_views(*names: str, sql: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
