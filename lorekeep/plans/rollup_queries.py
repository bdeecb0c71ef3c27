"""Coverage, status, issue, build and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import image_tag, last_passed_count, platform_flag
from ..operators import builds, coverage, issues, runs, status
from ..sinks.reports import coverage_documents
from ..sources.reports import parse_build_log, parse_snapshots
from . import views
from .registry import query
from .views import with_views

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MARKER = "entention"


def _part_totals(t, repo):
    return views.coverage_parts(t).select(
        repo.alias("repo"), F.col("stmts").alias("num_statements"),
        F.col("covered").alias("covered_lines"),
        (F.col("stmts") - F.col("covered")).alias("missing_lines"))


@query("q21_cov_merge", with_views("v_part") + """
    SELECT repo, CAST(sum(stmts) AS BIGINT) AS num_statements, CAST(sum(covered) AS BIGINT) AS covered_lines,
           CAST(sum(stmts - covered) AS BIGINT) AS missing_lines,
           CASE WHEN sum(stmts) > 0 THEN round_even(CAST(sum(covered) AS DOUBLE) / CAST(sum(stmts) AS DOUBLE) * 100.0, 2)
                ELSE 0.0 END AS percent_covered
    FROM v_part GROUP BY repo""")
def cov_merge(t):
    return coverage.merge_parts(_part_totals(t, F.col("repo")))


def _file_entries(t):
    return views.coverage_parts(t).select(
        "repo", F.struct("part", "doc_id").alias("part"),
        F.concat(F.lit("f"), F.col("doc_id") % 40).alias("file"),
        F.concat(F.lit('{"n":'), F.col("stmts"), F.lit("}")).alias("entry"))


FILES_SQL = with_views("v_part").rstrip() + """,
    v_files AS (SELECT repo, file, entry FROM (
        SELECT repo, 'f' || (doc_id % 40) AS file, '{"n":' || stmts || '}' AS entry,
               row_number() OVER (PARTITION BY repo, doc_id % 40 ORDER BY part DESC, doc_id DESC) AS rn
        FROM v_part) WHERE rn = 1)
"""


@query("q21b_cov_files", FILES_SQL + "SELECT * FROM v_files")
def cov_files(t):
    return coverage.merge_files(_file_entries(t)).drop("part")


@query("q21c_cov_documents", FILES_SQL.rstrip() + """,
    v_sum AS (SELECT repo, sum(stmts) AS s, sum(covered) AS c,
                     round(CASE WHEN sum(stmts) > 0 THEN CAST(sum(covered) AS DOUBLE) / CAST(sum(stmts) AS DOUBLE) * 100.0 ELSE 0.0 END, 2) AS p
              FROM v_part GROUP BY repo),
    v_rank AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file) - 1 AS rn,
                      count(*) OVER (PARTITION BY repo) AS n FROM v_files),
    v_text AS (SELECT repo, rn // 8 AS part, (max(n) - 1) // 8 + 1 AS parts, string_agg('"' || file || '":' || entry, ',' ORDER BY file) AS files
               FROM v_rank GROUP BY 1, 2)
    SELECT x.repo, part, parts, '{"meta":{},"files":{' || files || '},"totals":{"num_statements":'
           || CASE WHEN part = 0 THEN CAST(s AS BIGINT) ELSE 0 END || ',"covered_lines":'
           || CASE WHEN part = 0 THEN CAST(c AS BIGINT) ELSE 0 END || ',"missing_lines":'
           || CASE WHEN part = 0 THEN CAST(s - c AS BIGINT) ELSE 0 END || ',"percent_covered":'
           || CASE WHEN part = 0 THEN CAST(p AS VARCHAR) ELSE '0.0' END || ',"percent_covered_display":"'
           || CASE WHEN part = 0 THEN printf('%.2f', p) ELSE '0.00' END || '%"}}' AS value
    FROM v_text x JOIN v_sum y ON x.repo = y.repo""")
def cov_documents(t):
    # Two decimals: beyond, the two engines print doubles differently.
    totals = cov_merge(t).withColumn("percent_covered", F.round("percent_covered", 2))
    return coverage_documents(totals, cov_files(t), per_document=8, rows_per_range=1000)


def _report(t):
    parts = views.coverage_parts(t)
    repo = F.concat_ws("_", "repo", "part")
    merged = coverage.merge_parts(_part_totals(t, repo))
    counts = coverage.merge_counts(parts.select(repo.alias("repo"), "tests"))
    return coverage.coverage_report(merged, counts)


@query("q22_cov_report", with_views("v_part", "v_report") + """
    SELECT repo, num_statements, covered_lines, tests, percent_covered,
           CASE WHEN percent_covered >= 90 THEN 'ok' WHEN percent_covered >= 80 THEN 'warn' ELSE 'low' END AS band
    FROM v_report""")
def cov_report(t):
    return coverage.weakest_first(_report(t))


@query("q23_cov_rollup", with_views("v_part", "v_report") + """
    SELECT CASE WHEN grouping(repo) = 1 THEN 'TOTAL' ELSE repo END AS repo,
           CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(num_statements) AS BIGINT) AS num_statements,
           CAST(sum(covered_lines) AS BIGINT) AS covered_lines,
           round(CAST(sum(covered_lines) AS DOUBLE) / CAST(sum(num_statements) AS DOUBLE) * 100.0, 4) AS percent_covered
    FROM v_report GROUP BY ROLLUP (repo)""")
def cov_rollup(t):
    return coverage.coverage_rollup(_report(t)).withColumn(
        "percent_covered", F.round("percent_covered", 4))


@query("q23b_cov_total", with_views("v_part", "v_report") + """
    SELECT count(*) AS repos, CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(num_statements) AS BIGINT) AS num_statements,
           CAST(sum(covered_lines) AS BIGINT) AS covered_lines,
           round(CAST(sum(covered_lines) AS DOUBLE) / CAST(sum(num_statements) AS DOUBLE) * 100.0, 4) AS percent_covered
    FROM v_report""")
def cov_total(t):
    return coverage.coverage_total(_report(t)).withColumn(
        "percent_covered", F.round("percent_covered", 4))


@query("q24_cov_gap", with_views("v_part", "v_report") + """
    SELECT repo, percent_covered, round(90.0 - percent_covered, 2) AS gap FROM v_report
    WHERE percent_covered > 0 AND percent_covered < 90""")
def cov_gap(t):
    return coverage.coverage_gaps(_report(t)).withColumn("gap", F.round("gap", 2))


@query("q25_passed_count", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(value) AS BIGINT)
                          WHEN 1 THEN CAST(floor(value) AS BIGINT) + 1 WHEN 2 THEN 0
                          ELSE event_id END AS passed FROM events""")
def passed_count(t):
    n = F.floor("value").cast("bigint")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.format_string("32 failed, %d passed, 19 skipped", n))
        .when(kind == 1, F.format_string("%d passed, 8 skipped in 2.1s", n + 1))
        .when(kind == 2, F.lit("no tests ran"))
        .otherwise(F.format_string("%d passed in part one; %d passed in part two", n, F.col("event_id")))
    )
    return t.events.select("event_id", last_passed_count(text).alias("passed"))


STATUS_SQL = """
    WITH v_user AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS modified,
                           count(*) FILTER (WHERE event_type = 'error') AS untracked,
                           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS unpushed
                    FROM events GROUP BY user_id),
    v_status AS (SELECT 'r' || user_id AS repo,
                        CASE user_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'main'
                             WHEN 3 THEN 'master' ELSE 'dev' END AS branch,
                        modified, untracked, unpushed, modified + untracked + unpushed = 0 AS clean,
                        user_id % 5 NOT IN (2, 3) AS non_main FROM v_user)
"""


def _status_inputs(t):
    events = t.events.select("user_id", "event_id", "event_type", "value")
    repo = F.concat(F.lit("r"), F.col("user_id")).alias("repo")
    kind = F.col("user_id") % 5
    branch = F.when(kind == 1, "").when(kind == 2, "main").when(kind == 3, "master").when(kind == 4, "dev")
    repos = events.select("user_id").distinct().select(repo, branch.alias("branch"))
    code = F.when(F.col("event_type") == "error", "?? ").when(F.col("event_type") == "click", " M ").otherwise("A  ")
    lines = events.where("event_type in ('error', 'click', 'view')").select(
        repo, F.col("event_id").alias("line_no"), F.concat(code, F.lit("f"), "event_id").alias("line"))
    ahead = events.where("event_type = 'purchase'").select(repo, F.lit(1).alias("unpushed"))
    return repos, lines, ahead


@query("q29_status_rollup", STATUS_SQL + "SELECT * FROM v_status")
def status_rollup(t):
    return status.status_rollup(*_status_inputs(t))


@query("q29b_status_totals", STATUS_SQL + """
    SELECT count(*) AS total, count(*) FILTER (WHERE clean) AS clean,
           count(*) FILTER (WHERE NOT clean) AS dirty, count(*) FILTER (WHERE non_main) AS non_main FROM v_status""")
def status_totals(t):
    return status.status_totals(status.status_rollup(*_status_inputs(t)))


@query("q29c_non_main", STATUS_SQL + "SELECT repo, branch FROM v_status WHERE branch = 'dev'")
def non_main(t):
    return status.non_main_repos(status.status_rollup(*_status_inputs(t)))


@query("q30_first_n", """
    SELECT source AS image, doc_id AS line_no, rank FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank
        FROM documents WHERE n_chars % 10 <> 0) WHERE rank <= 5""")
def first_layers(t):
    layers = t.documents.select(
        F.col("source").alias("image"), F.col("doc_id").alias("line_no"),
        F.when(F.col("n_chars") % 10 == 0, "0B").otherwise(F.concat("n_chars", F.lit("B"))).alias("size_txt"))
    return builds.first_layers(layers, 5).select(
        "image", "line_no", F.col("rank").cast("bigint").alias("rank"))


@query("q30b_dirty_details", """
    SELECT 'r' || user_id AS repo, event_id AS line_no, rank FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events
        WHERE event_type IN ('error', 'click', 'view')) WHERE rank <= 10""")
def dirty_details(t):
    repos, lines, ahead = _status_inputs(t)
    rollup = status.status_rollup(repos, lines, ahead)
    return status.dirty_details(rollup, lines, 10).select(
        "repo", "line_no", F.col("rank").cast("bigint").alias("rank"))


def _issues(t):
    return t.orders.select(
        F.concat(F.lit("r"), F.col("o_custkey") % 15).alias("repo"),
        F.col("o_orderpriority").alias("priority"),
        F.format_string("Order %d of customer %d", "o_orderkey", "o_custkey").alias("title"),
        F.array(F.col("o_orderstatus")).alias("labels"),
        F.when(F.col("o_orderstatus") == "P", "DRY_NODE").when(F.col("o_orderkey") % 9 != 0, "n").alias("node_id"),
        "o_orderkey")


@query("q31_issue_counts", """
    SELECT o_orderpriority AS priority, count(*) AS n,
           CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3
                WHEN '3-MEDIUM' THEN 5 ELSE 6 END AS place
    FROM orders GROUP BY 1""")
def issue_counts(t):
    return issues.counts_by_priority(_issues(t), ("2-HIGH", "1-URGENT", "5-LOW", "absent", "3-MEDIUM", "4-NOT SPECIFIED"))


@query("q31b_issue_repos", "SELECT 'r' || (o_custkey % 15) AS repo, count(*) AS n FROM orders GROUP BY 1")
def issue_repos(t):
    return issues.counts_by_repo(_issues(t))


@query("q31c_issue_lines", """
    SELECT o_orderkey, left('Order ' || o_orderkey || ' of customer ' || o_custkey, 14) AS title,
           o_orderstatus || ',' || o_orderpriority AS labels FROM orders""")
def issue_lines(t):
    labelled = issues.with_priority_label(_issues(t))
    return labelled.select("o_orderkey", issues.shown_title(F.col("title"), 14).alias("title"),
                           F.array_join("labels", ",").alias("labels"))


@query("q31d_linked_total", """
    SELECT count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 9 <> 0) AS linked, count(*) AS total
    FROM orders""")
def linked_total(t):
    return issues.linked_total(_issues(t))


@query("q31e_repos_touched", "SELECT count(DISTINCT o_custkey % 15) AS repos FROM orders")
def repos_touched(t):
    return issues.repos_touched(_issues(t))


@query("q32_label_gap", """
    SELECT c_custkey AS repo, label FROM customer
    CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS label)
    EXCEPT SELECT o_custkey, o_orderpriority FROM orders""")
def label_gap(t):
    have = t.orders.select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("label"))
    return issues.missing_labels(t.customer.select(F.col("c_custkey").alias("repo")), PRIORITIES, have)


@query("q33_run_state", with_views("v_run") + """
    SELECT run_id, arg_max(CASE WHEN event_id % 6 = 0 THEN 'UNKNOWN' ELSE state END, (observed_at, event_id)) AS state,
           arg_max(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 3 END, (observed_at, event_id)) AS rows_count,
           max(observed_at) AS observed_at
    FROM v_run GROUP BY run_id""")
def run_state(t):
    """Snapshots as JSON text: the state may be missing or empty, the rows too."""
    run = views.run_events(t)
    state = F.when(F.col("event_id") % 12 == 0, F.lit('"state":"",')).when(
        F.col("event_id") % 6 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"state":"'), F.lower("state"), F.lit('",')))
    rows = F.when(F.col("event_id") % 3 == 0, "[]").when(F.col("event_id") % 3 == 1, "[1]").otherwise("[1,2]")
    body = F.when(F.col("event_id") % 4 == 0, F.lit('"bioquery":{}')).otherwise(
        F.concat(F.lit('"bioquery":{"payload":{"rows":'), rows, F.lit("}}")))
    doc = F.concat(F.lit("{"), state, F.lit('"run_id":"'), "run_id", F.lit('",'), body, F.lit("}"))
    snapshots = parse_snapshots(run.select("observed_at", "event_id", doc.alias("doc")))
    return runs.latest_state(snapshots, order_by=("observed_at", "event_id")).drop("event_id")


BUDGET_SECONDS = 36 * 3600

LIVE_OUTCOME_SQL = with_views("v_run").rstrip() + f""",
    v_per AS (SELECT run_id, min(observed_at) AS started_at,
                     min(CASE WHEN state <> 'RUNNING' THEN observed_at END) AS end_at,
                     arg_min(state, observed_at) FILTER (WHERE state <> 'RUNNING') AS end_state,
                     (SELECT max(ts) FROM events) AS clock FROM v_run GROUP BY run_id),
    v_out AS (SELECT run_id, started_at, started_at + INTERVAL {BUDGET_SECONDS} SECOND AS deadline, end_at, end_state, clock FROM v_per)
    SELECT run_id, CASE WHEN end_at <= deadline THEN end_state ELSE 'TIMED_OUT' END AS outcome, started_at,
           CASE WHEN end_at <= deadline THEN end_at ELSE deadline END AS ended_at
    FROM v_out"""
OUTCOME_SQL = LIVE_OUTCOME_SQL + " WHERE end_at IS NOT NULL OR clock > deadline"


@query("q33b_run_outcomes", OUTCOME_SQL)
def run_outcomes(t):
    return runs.run_outcomes(views.run_events(t), BUDGET_SECONDS)


@query("q34_topic_payload", """
    SELECT c_nationkey AS repo, (rn - 1) // 50 AS part, (max(n) - 1) // 50 + 1 AS parts,
           '{"names":["' || string_agg(topic, '","' ORDER BY rn) || '"]}' AS payload
    FROM (SELECT c_nationkey, c_mktsegment || '#' || (c_custkey % 7) AS topic,
                 row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn,
                 count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    GROUP BY 1, 2""")
def topic_payload(t):
    topics = t.customer.select(
        F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("pos"),
        F.concat_ws("#", "c_mktsegment", F.col("c_custkey") % 7).alias("topic"))
    return issues.topic_payloads(topics, per_payload=50, rows_per_range=1000)


def _sizes(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "kB", "MB", "GB")]),
                        (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.col("p_retailprice").cast("decimal(12,1)").cast("string"), unit)
    return t.part.select(
        F.concat(F.lit("img"), F.floor(F.col("p_partkey") / 2)).alias("image"),
        F.when(F.col("p_partkey") % 2 == 0, "new").otherwise("latest").alias("tag"),
        text.alias("size_txt"), "p_partkey")


SIZE_SQL = """
    WITH v_size AS (SELECT 'img' || (p_partkey // 2) AS image, p_partkey % 2 = 0 AS is_new,
                           CAST(CAST(p_retailprice AS DECIMAL(12,1)) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000
                                WHEN 2 THEN 1000000 ELSE 1000000000 END AS BIGINT) AS bytes,
                           (CAST(p_retailprice AS DECIMAL(12,1)) * 10) % 10 AS tenths, p_partkey
                    FROM part)
"""


@query("q35_size_compare", SIZE_SQL + """,
    v_wide AS (SELECT image, max(CASE WHEN is_new THEN bytes END) AS new_bytes,
                      max(CASE WHEN NOT is_new THEN bytes END) AS old_bytes FROM v_size GROUP BY image)
    SELECT *, round(CASE WHEN old_bytes > 0 THEN CAST(new_bytes AS DOUBLE) / CAST(old_bytes AS DOUBLE) END, 6) AS ratio
    FROM v_wide""")
def size_compare(t):
    return builds.compare_sizes(_sizes(t)).withColumn("ratio", F.round("ratio", 6))


@query("q35b_build_log", """
    SELECT 'b' || p_brand AS file, p_partkey * 3 + k AS line_no,
           CASE k WHEN 1 THEN 'size' ELSE 'layer' END AS kind, p_name || p_partkey AS image,
           CASE k WHEN 1 THEN 'new' END AS tag,
           CASE k WHEN 1 THEN p_size || 'MB' ELSE p_size || '.5kB' END AS size_txt,
           CASE k WHEN 1 THEN '2026-05-08' END AS created,
           CASE k WHEN 2 THEN 'COPY ' || p_type END AS command
    FROM part CROSS JOIN (SELECT unnest([1, 2]) AS k)""")
def build_log(t):
    """Parts written as log text: a header, a size row and a layer row each."""
    rows = F.array(
        F.concat(F.lit("── "), "p_name", "p_partkey", F.lit(" ──")),
        F.concat(F.lit("new\t"), "p_size", F.lit("MB\t2026-05-08")),
        F.concat("p_size", F.lit(".5kB\tCOPY "), "p_type"),
    )
    lines = t.part.select(F.concat(F.lit("b"), "p_brand").alias("file"), "p_partkey",
                          F.posexplode(rows).alias("k", "text"))
    lines = lines.select("file", (F.col("p_partkey") * 3 + F.col("k")).alias("line_no"), "text")
    return parse_build_log(lines, rows_per_range=500)


@query("q36_first_match", """
    WITH v_doc AS (SELECT doc_id, 1 AS source_rank, string_split(text, chr(10)) AS parts FROM documents),
    v_line AS (SELECT doc_id, source_rank, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS text FROM v_doc
               UNION ALL SELECT conv_id, 2, turn + 1, text FROM conversations),
    v_hit AS (SELECT doc_id, source_rank, line_no, regexp_extract(text, 'qu([a-z]+)', 1) AS value,
                     row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, line_no) AS rn
              FROM v_line WHERE regexp_extract(text, 'qu([a-z]+)', 1) <> '')
    SELECT doc_id, source_rank, line_no, value FROM v_hit WHERE rn = 1""")
def first_match(t):
    docs = t.documents.select(
        "doc_id", F.lit(1).cast("bigint").alias("source_rank"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    docs = docs.select("doc_id", "source_rank", (F.col("p") + 1).cast("bigint").alias("line_no"), "text")
    turns = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.lit(2).cast("bigint").alias("source_rank"),
        (F.col("turn") + 1).alias("line_no"), "text")
    value = F.nullif(F.regexp_extract("text", "qu([a-z]+)", 1), F.lit(""))
    return builds.first_match(docs.union(turns), value, ["doc_id"])


@query("q36b_plugin_flags", """
    SELECT p_partkey AS plugin, p_brand || ':' || p_size AS image,
           CASE WHEN p_partkey % 4 = 0 THEN 'linux/' || p_size WHEN p_partkey % 4 = 1 THEN 'linux/' || p_brand[1:5]
                END AS platform
    FROM part WHERE p_partkey % 6 <> 0""")
def plugin_flags(t):
    """Tag and platform of plugins whose files are made from the parts."""
    key = F.col("p_partkey")
    tag = F.when(key % 6 == 0, F.lit("IMAGE = none")).otherwise(
        F.concat(F.lit('DOCKER_IMAGE  = "'), "p_brand", F.lit(":"), "p_size", F.lit('"')))
    docker = F.when(key % 4 == 0, F.concat(F.lit("# docker build --platform=linux/"), "p_size")).otherwise("FROM x")
    readme = F.when(key % 4 <= 1, F.concat(F.lit("use --platform linux/"), F.substring("p_brand", 1, 5), F.lit(" ."))).otherwise("")
    lines = t.part.select(key.alias("plugin"), F.posexplode(F.array(docker, readme)).alias("source_rank", "text")
                          ).withColumn("line_no", F.lit(1))
    flags = builds.first_match(lines, platform_flag(F.col("text")), ["plugin"]).select(
        "plugin", F.col("value").alias("platform"))
    tags = t.part.select(key.alias("plugin"), image_tag(tag).alias("image")).where("image is not null")
    return tags.join(flags, "plugin", "left")


SPEC_SQL = f"""
    WITH v_spec AS (SELECT DISTINCT source AS tool, lang AS apt, CAST(NULL AS VARCHAR) AS pip FROM documents
                    UNION ALL SELECT s_name, NULL, 'p' || s_suppkey FROM supplier),
    v_built AS (SELECT source AS tool, bool_or(contains(text, '{MARKER}')) AS ok FROM documents GROUP BY source)
"""


@query("q37_build_outcome", SPEC_SQL + """
    SELECT s.tool, apt, pip, CASE WHEN coalesce(ok, FALSE) THEN 'success' ELSE 'failed' END AS outcome
    FROM v_spec s LEFT JOIN v_built b ON s.tool = b.tool""")
def build_outcome(t):
    specs = t.documents.select(F.concat_ws("|", "source", "lang", F.lit("")).alias("spec")).distinct().union(
        t.supplier.select(F.concat("s_name", F.lit("||p"), "s_suppkey").alias("spec")))
    logs = t.documents.select(F.col("source").alias("tool"), "text")
    return builds.build_outcomes(builds.parse_specs(specs), logs, MARKER)
