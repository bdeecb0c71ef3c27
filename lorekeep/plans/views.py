"""The given tables seen as the inputs of the operators.

Each view has a Spark form (a function of ``Tables``) and, in ``SQL``, the same
definition for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OLD_COPY = "ARCHIVE"


class Tables:
    """Parquet tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def feed_columns(events: DataFrame) -> DataFrame:
    """Events as feed rows; works on a stream as well."""
    fname = F.concat(F.lit("upd"), F.date_format("ts", "yyyyMMdd"), F.lit(".xml.gz"))
    return events.select(
        fname.alias("fname"), F.col("event_id").alias("pos"), F.col("user_id").alias("pmid"),
        F.col("props").alias("body"), F.col("event_type").alias("kind"), "value",
    )


def feed(t: Tables) -> DataFrame:
    return feed_columns(t.events)


def corpus(t: Tables) -> DataFrame:
    """Customers as articles, some of them stored in a second domain too."""
    own = t.customer.where("c_nationkey < 13").select(
        F.col("c_mktsegment").alias("domain"), F.col("c_custkey").alias("pmid"),
        F.col("c_name").alias("body"), "c_nationkey",
    )
    copies = own.where("c_nationkey between 4 and 6").withColumn("domain", F.lit(OLD_COPY))
    return own.unionByName(copies).drop("c_nationkey")


def docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("source").alias("repo"), "lang", "text", "n_chars")


def packages(t: Tables) -> DataFrame:
    visibility = F.when(F.col("c_nationkey") < 10, "public").when(
        F.col("c_nationkey") != 24, "private"
    )
    return t.customer.select(
        "c_custkey", F.concat("c_mktsegment", F.lit("/"), "c_name").alias("name"),
        visibility.alias("visibility"), (F.col("c_mktsegment") == "BUILDING").alias("excluded"),
        "c_acctbal",
    )


def orders_with_status(t: Tables, status: str) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == status)


def package_names(t: Tables, status: str) -> DataFrame:
    return orders_with_status(t, status).select(F.col("o_custkey").alias("name"))


def package_tags(t: Tables, flag: str) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag") == flag).select(
        F.col("l_suppkey").alias("name"), (F.col("l_partkey") % 50).alias("tag")
    )


def inventory(t: Tables) -> DataFrame:
    """Parts as files. The sums of their lines say which go by another name, are folders, or are empty."""
    sums = t.lineitem.groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("_q"), F.sum("l_linenumber").alias("_l"))
    path = F.when(F.col("_q") % 3 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return sums.select(
        path.alias("path"), (F.col("_l") % 4 != 0).alias("is_file"), (F.col("_q") % 7 * 700_000).alias("size"))


def coverage_parts(t: Tables) -> DataFrame:
    """Labelled documents as reports: a source is a repository, a language a part."""
    covered = F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0)
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id").select(
        "doc_id", F.col("source").alias("repo"), F.col("lang").alias("part"),
        F.col("n_chars").alias("stmts"), covered.alias("covered"),
        F.when(F.col("lang") != "fr", F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("tests"),
    )


def run_events(t: Tables) -> DataFrame:
    return run_columns(t.events)


def run_columns(events: DataFrame) -> DataFrame:
    """Events as run snapshots; works on a stream as well."""
    state = F.when(F.col("event_type") == "purchase", "COMPLETED").when(
        F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), state.alias("state"),
        F.col("ts").alias("observed_at"), "event_id", "event_type", "props",
    )


SQL = {
    "v_feed": """
        v_feed AS (SELECT 'upd' || strftime(ts, '%Y%m%d') || '.xml.gz' AS fname, event_id AS pos,
                          user_id AS pmid, props AS body, event_type AS kind, value FROM events)""",
    "v_corpus": """
        v_own AS (SELECT c_mktsegment AS domain, c_custkey AS pmid, c_name AS body, c_nationkey
                  FROM customer WHERE c_nationkey < 13),
        v_corpus AS (SELECT domain, pmid, body FROM v_own
                     UNION ALL SELECT 'ARCHIVE', pmid, body FROM v_own
                     WHERE c_nationkey BETWEEN 4 AND 6)""",
    "v_latest": """
        v_latest AS (SELECT pmid, fname, pos, body, kind FROM (
            SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY fname DESC, pos DESC) AS rn
            FROM v_feed) WHERE rn = 1)""",
    "v_applied": """
        v_home AS (SELECT pmid, min(domain) AS domain FROM v_corpus GROUP BY pmid),
        v_applied AS (SELECT c.domain, c.pmid, coalesce(l.body, c.body) AS body,
                             l.pmid IS NOT NULL AS touched
                      FROM v_corpus c
                      LEFT JOIN v_home h ON h.pmid = c.pmid AND h.domain = c.domain
                      LEFT JOIN v_latest l ON l.pmid = h.pmid)""",
    "v_pkg": """
        v_pkg AS (SELECT c_custkey, c_mktsegment || '/' || c_name AS name,
                         CASE WHEN c_nationkey < 10 THEN 'public' WHEN c_nationkey <> 24
                              THEN 'private' END AS visibility,
                         c_mktsegment = 'BUILDING' AS excluded, c_acctbal FROM customer)""",
    "v_old_new": """
        v_old AS (SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderstatus = 'F'),
        v_new AS (SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderstatus = 'O')""",
    "v_tags": """
        v_tag_old AS (SELECT DISTINCT l_suppkey AS name, l_partkey % 50 AS tag FROM lineitem
                      WHERE l_returnflag = 'R'),
        v_tag_new AS (SELECT DISTINCT l_suppkey AS name, l_partkey % 50 AS tag FROM lineitem
                      WHERE l_returnflag = 'A'),
        v_missing AS (SELECT * FROM v_tag_old EXCEPT SELECT * FROM v_tag_new)""",
    "v_inventory": """
        v_inventory AS (SELECT CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 3 = 0 THEN -l_partkey ELSE l_partkey END AS path,
                               sum(l_linenumber) % 4 <> 0 AS is_file,
                               CAST(sum(l_quantity) AS BIGINT) % 7 * 700000 AS size
                        FROM lineitem GROUP BY l_partkey)""",
    "v_part": """
        v_part AS (SELECT d.doc_id, d.source AS repo, d.lang AS part, d.n_chars AS stmts,
                          CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END AS covered,
                          CASE WHEN d.lang <> 'fr' THEN CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END END AS tests
                   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "v_report": """
        v_cov AS (SELECT repo || '_' || part AS repo, CAST(sum(stmts) AS BIGINT) AS num_statements,
                         CAST(sum(covered) AS BIGINT) AS covered_lines,
                         CAST(sum(stmts) - sum(covered) AS BIGINT) AS missing_lines
                  FROM v_part GROUP BY 1),
        v_tests AS (SELECT repo || '_' || part AS repo, CAST(sum(tests) AS BIGINT) AS tests
                    FROM v_part GROUP BY 1),
        v_report AS (SELECT c.repo, num_statements, covered_lines,
                            coalesce(t.tests, 0) AS tests,
                            CASE WHEN num_statements > 0 THEN
                              round_even(CAST(covered_lines AS DOUBLE) / CAST(num_statements AS DOUBLE) * 100.0, 2)
                              ELSE 0.0 END AS percent_covered
                     FROM v_cov c LEFT JOIN v_tests t ON c.repo = t.repo)""",
    "v_run": """
        v_run AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts AS observed_at, props,
                         event_type,
                         CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
                              ELSE 'RUNNING' END AS state FROM events)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",".join(SQL[n] for n in names) + "\n"
