"""The ledger's inputs, derived from the given tables.

Sessions are groups of ten users; every day a session works on two other documents, so all
documents are files of the log, and a file has a revision for every two hours of a day. The log
stays narrow: hash, size and tokens are computed once a revision that was seen and joined;
text is fetched late by (file_no, rev).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores is dealt over them by a key, as what is made
    of its rows outweighs the shuffle; one that has a split a core is read where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_no, text`` of all documents."""
    return dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_no"), "text"), "file_no")


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, without contents."""
    e = table(spark, sf_dir, "events")
    n_files = max(1, table(spark, sf_dir, "documents").count())  # from the files' footers
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "read")
        .when(F.col("event_type") == "purchase", "edit")
        .when(F.col("event_type") == "signup", "reset")
        .otherwise("partial")
    )
    session = F.expr("user_id div 10")
    file_no = F.pmod(session * 62 + F.day("ts") * 2 + F.col("event_id") % 2, F.lit(n_files))
    return e.select(
        F.col("event_id").alias("action_id"),
        session.cast("string").alias("session_id"),
        file_no.alias("file_no"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("occurred_at"),
        F.expr("hour(ts) div 2").cast("int").alias("rev"),
        kind.alias("kind"),
        (k + 1).alias("win_start"),
        (k + 1 + F.floor(F.col("value") / 20)).alias("win_end"),
        F.concat(F.lit("src/f"), file_no.cast("string"), F.lit(".txt")).alias("file_path"),
    )


def revision(text: Column, rev: Column) -> Column:
    """A document's text with numbered lines, every 24th of which a revision marks, and a
    last line that names it."""
    line = lambda x, i: F.concat(
        x, F.lit(" #"), (i + 1).cast("string"), F.when((rev > 0) & ((i + 1) % 24 == 2 * rev), F.concat(F.lit(" rev"), rev.cast("string"))).otherwise("")
    )
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)
    return F.concat(F.array_join(lines, "\n"), F.lit("\nrev "), rev.cast("string"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the revisions that the log holds, with hash, sizes and tokens."""
    seen = raw_actions(spark, sf_dir).select("file_no", "rev").distinct()
    v = texts(spark, sf_dir).join(seen, "file_no").select("file_no", "rev", revision(F.col("text"), F.col("rev")).alias("content"))
    return v.select(
        "file_no",
        "rev",
        "content",
        S.content_hash(F.col("content")).alias("content_hash"),
        S.token_estimate(F.col("content")).alias("tokens_full"),
        F.octet_length("content").cast("long").alias("n_bytes"),
        S.line_count(F.col("content")).alias("n_lines"),
    )


def plain_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log without what is only known from contents, for reports that ask for none."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_no"))
    return raw_actions(spark, sf_dir).join(known, "file_no", "left_semi")


def both_contents(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``file_no, old_rev, rev``) with ``old``, ``content`` and its ``n_lines``: both
    revisions are made of the one text that the join brings."""
    made = pairs.join(texts(spark, sf_dir), "file_no").withColumns({"old": revision(F.col("text"), F.col("old_rev")), "content": revision(F.col("text"), F.col("rev"))})
    return made.drop("text").withColumn("n_lines", S.line_count(F.col("content")))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log with the version's hash and sizes."""
    v = versions(spark, sf_dir).drop("content")
    return raw_actions(spark, sf_dir).join(v, ["file_no", "rev"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, content."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


#: The same views for DuckDB.
ACTIONS_SQL = """
raw AS (SELECT event_id AS action_id, CAST(user_id // 10 AS VARCHAR) AS session_id, (user_id // 10 * 62 + day(ts) * 2 + event_id % 2) % (SELECT count(*) FROM documents) AS file_no,
  CAST(floor(epoch(ts)) AS BIGINT) AS occurred_at, CAST(hour(ts) // 2 AS INTEGER) AS rev,
  CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'edit' WHEN event_type = 'signup' THEN 'reset' ELSE 'partial' END AS kind,
  CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS win_start, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 + CAST(floor(value / 20) AS BIGINT) AS win_end FROM events),
seen AS (SELECT DISTINCT file_no, rev FROM raw),
versions AS (SELECT file_no, rev, array_to_string(list_transform(string_split(coalesce(d.text, ''), chr(10)),
  lambda l, i: l || ' #' || i || CASE WHEN rev > 0 AND i % 24 = 2 * rev THEN ' rev' || rev ELSE '' END), chr(10)) || chr(10) || 'rev ' || rev AS content FROM seen JOIN documents d ON d.doc_id = file_no),
vs AS (SELECT *, sha256(content) AS content_hash, CAST((strlen(content) + 3) // 4 AS BIGINT) AS tokens_full, CAST(strlen(content) AS BIGINT) AS n_bytes,
  CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM versions),
actions AS (SELECT raw.*, 'src/f' || file_no || '.txt' AS file_path, content_hash, tokens_full, n_bytes, n_lines FROM raw JOIN vs USING (file_no, rev))"""
FILES_SQL = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents)"
