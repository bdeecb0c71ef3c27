"""Catalog comparison, visibility and worklist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import escape_path, escape_slashes
from ..operators import digests, reconcile
from ..session import work_dir
from ..sources.catalogs import name_list, read_two_columns
from . import views
from .registry import query
from .views import with_views

LIMIT = 120
TAGS_PER_LINE = 3


@query("q16_names_missing", with_views("v_old_new") + """
    SELECT name FROM v_old EXCEPT SELECT name FROM v_new""")
def names_missing(t):
    return reconcile.missing_names(views.package_names(t, "F"), views.package_names(t, "O")).orderBy("name")


@query("q17_names_common", with_views("v_old_new") + """
    SELECT name FROM v_old WHERE name IN (SELECT name FROM v_new)""")
def names_common(t):
    return reconcile.common_names(views.package_names(t, "F"), views.package_names(t, "O"))


def _missing(t):
    old, new = views.package_tags(t, "R"), views.package_tags(t, "A")
    return reconcile.missing_tags(old, new, reconcile.common_names(old, new)), old, new


@query("q18_tags_missing", with_views("v_tags") + f"""
    SELECT name, (rn - 1) // {TAGS_PER_LINE} AS part, (max(n) - 1) // {TAGS_PER_LINE} + 1 AS parts, count(*) AS n_tags,
           string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) AS tags
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tag) AS rn, count(*) OVER (PARTITION BY name) AS n FROM v_missing
          WHERE name IN (SELECT name FROM v_tag_new)) GROUP BY 1, 2""")
def tags_missing(t):
    return reconcile.missing_tag_report(_missing(t)[0], per_line=TAGS_PER_LINE, rows_per_range=500)


@query("q18b_reconcile_summary", with_views("v_tags").rstrip() + """,
    v_o AS (SELECT DISTINCT name FROM v_tag_old), v_n AS (SELECT DISTINCT name FROM v_tag_new),
    v_row AS (SELECT (SELECT count(*) FROM v_o) AS old_count, (SELECT count(*) FROM v_n) AS new_count,
                     (SELECT count(*) FROM (SELECT name FROM v_o EXCEPT SELECT name FROM v_n)) AS missing_names,
                     (SELECT count(*) FROM v_o WHERE name IN (SELECT name FROM v_n)) AS checked,
                     (SELECT count(DISTINCT name) FROM v_missing WHERE name IN (SELECT name FROM v_n)) AS with_missing_tags)
    SELECT *, CASE WHEN missing_names = 0 AND with_missing_tags = 0 THEN 'complete'
                   ELSE 'incomplete' END AS verdict FROM v_row""")
def reconcile_summary(t):
    missing, old, new = _missing(t)
    return reconcile.reconcile_summary(old, new, missing)


#: Two copies of the line items' tags that differ in the lines of a few parts.
COPY_SQL = """
    WITH v_o AS (SELECT DISTINCT l_partkey AS name, l_linenumber AS tag FROM lineitem),
    v_n AS (SELECT DISTINCT l_partkey AS name, l_linenumber AS tag FROM lineitem
            WHERE NOT (l_partkey % 97 = 3 AND l_linenumber = 1) AND l_partkey % 89 <> 5),
    v_lost AS (SELECT * FROM v_o EXCEPT SELECT * FROM v_n)"""


def _copies(t):
    old = t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("tag"))
    return old, old.where("not (name % 97 = 3 and tag = 1) and name % 89 <> 5")


@query("q16b_names_by_digest", COPY_SQL + "SELECT name FROM v_o EXCEPT SELECT name FROM v_n")
def names_by_digest(t):
    return digests.missing_names_by_digest(*_copies(t))


@query("q18c_tags_by_digest", COPY_SQL + "SELECT * FROM v_lost WHERE name IN (SELECT name FROM v_n)")
def tags_by_digest(t):
    return digests.missing_tags_by_digest(*_copies(t))


@query("q18d_summary_by_digest", COPY_SQL + """,
    v_row AS (SELECT (SELECT count(DISTINCT name) FROM v_o) AS old_count, (SELECT count(DISTINCT name) FROM v_n) AS new_count,
                     (SELECT count(*) FROM (SELECT name FROM v_o EXCEPT SELECT name FROM v_n)) AS missing_names,
                     (SELECT count(DISTINCT name) FROM v_o WHERE name IN (SELECT name FROM v_n)) AS checked,
                     (SELECT count(DISTINCT name) FROM v_lost WHERE name IN (SELECT name FROM v_n)) AS with_missing_tags)
    SELECT *, CASE WHEN missing_names = 0 AND with_missing_tags = 0 THEN 'complete' ELSE 'incomplete' END AS verdict FROM v_row""")
def summary_by_digest(t):
    return digests.summary_by_digest(*_copies(t))


PLAN_SQL = with_views("v_pkg").rstrip() + f""",
    v_known AS (SELECT name, coalesce(visibility, 'unknown') AS visibility, excluded FROM v_pkg),
    v_first AS (SELECT * FROM v_known ORDER BY name LIMIT {LIMIT}),
    v_public AS (SELECT * FROM v_known WHERE visibility = 'public' ORDER BY name LIMIT {LIMIT})
    SELECT 'copy' AS variant, name, visibility FROM v_public
    UNION ALL SELECT 'publish', name, visibility FROM v_first WHERE visibility <> 'public'
    UNION ALL SELECT 'skip', name, visibility FROM v_known WHERE visibility <> 'public'
    UNION ALL SELECT 'browse', name, visibility FROM v_known WHERE visibility <> 'public' AND NOT excluded"""


@query("q19_visibility_plan", PLAN_SQL)
def visibility_plan(t):
    raw = views.packages(t)
    known = reconcile.with_known_visibility(raw)
    is_public = F.col("visibility") == "public"
    never = raw.where("excluded").select("name")
    variants = {
        "copy": reconcile.limit_after_filter(known, is_public, LIMIT),
        "publish": reconcile.limit_before_filter(known, ~is_public, LIMIT),
        "skip": reconcile.with_known_visibility(reconcile.non_public_packages(raw)),
        "browse": reconcile.exclude_names(reconcile.non_public_packages(known), never),
    }
    out = None
    for variant, rows in variants.items():
        tagged = rows.select(F.lit(variant).alias("variant"), "name", "visibility")
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("q19b_two_column_lines", with_views("v_pkg") + """
    SELECT name, visibility FROM v_pkg WHERE visibility IS NOT NULL AND c_custkey % 10 <> 0""")
def two_columns(t):
    """The same packages as lines of text files; some lines are blank, short or long."""
    pkg = views.packages(t)
    extra = F.when(F.col("c_custkey") % 10 == 0, F.lit("\textra")).otherwise("")
    line = F.when(F.col("visibility").isNull() & (F.col("c_custkey") % 2 == 0), F.lit("  ")).otherwise(
        F.concat("name", F.coalesce(F.concat(F.lit("\t"), "visibility"), F.lit("")), extra))
    path = work_dir(t.spark, "two-columns")
    pkg.select(line.alias("value")).write.text(path)
    return read_two_columns(t.spark, path)


def _candidates(t):
    pkg = views.packages(t)
    done = t.orders.where("o_orderstatus = 'P'").join(
        pkg, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("  "), "name").alias("value"))
    there = pkg.where("c_acctbal < 0").select(F.col("name").alias("key"))
    todo = reconcile.non_public_packages(pkg).where("not excluded").select(F.col("name").alias("key"), "c_custkey")
    return todo, name_list(done), there


CANDIDATE_SQL = with_views("v_pkg").rstrip() + """,
    v_done AS (SELECT DISTINCT name FROM v_pkg JOIN orders ON o_custkey = c_custkey
               WHERE o_orderstatus = 'P'),
    v_cand AS (SELECT * FROM v_pkg WHERE coalesce(visibility, 'private') <> 'public' AND NOT excluded)
"""


@query("q20_worklist", CANDIDATE_SQL + """
    SELECT name AS key, c_custkey, replace(name, '/', '%2F') AS slashes,
           replace(replace(name, '/', '%2F'), '#', '%23') AS encoded
    FROM v_cand WHERE name NOT IN (SELECT name FROM v_done) AND c_acctbal >= 0""")
def worklist(t):
    todo, done, there = _candidates(t)
    left = reconcile.worklist(todo, done, elsewhere=there).orderBy("key")
    return left.select("key", "c_custkey", escape_slashes(F.col("key")).alias("slashes"),
                       escape_path(F.col("key")).alias("encoded"))


def _files(t):
    """Package names as image files: two spellings per key, some without the suffix."""
    pkg = views.packages(t)
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat("name", F.lit(".sif"))).otherwise(
        F.concat("name", F.lit("_arm64.sif")))
    upper = pkg.where("c_custkey % 5 = 1").select(
        (F.col("c_custkey") * 2).alias("pos"),
        F.concat(F.upper("name"), F.lit("_arm64.sif")).alias("file"))
    return pkg.select((F.col("c_custkey") * 2 + 1).alias("pos"), name.alias("file")).union(upper)


FILES_SQL = with_views("v_pkg").rstrip() + """,
    v_file AS (SELECT c_custkey * 2 + 1 AS pos,
                      CASE WHEN c_custkey % 5 = 0 THEN name || '.sif' ELSE name || '_arm64.sif' END AS file,
                      CASE WHEN c_custkey % 5 <> 0 THEN lower(name) || ':arm64' END AS key FROM v_pkg
               UNION ALL SELECT c_custkey * 2, upper(name) || '_arm64.sif', lower(name) || ':arm64'
               FROM v_pkg WHERE c_custkey % 5 = 1),
    v_gone AS (SELECT lower(name) || ':arm64' AS key FROM v_pkg WHERE c_acctbal < 0 OR c_custkey % 3 = 0),
    v_class AS (SELECT pos, file, key,
                       CASE WHEN key IS NULL THEN 'no_match'
                            WHEN key IN (SELECT key FROM v_gone) THEN 'skipped'
                            WHEN pos = min(pos) OVER (PARTITION BY key) THEN 'todo'
                            ELSE 'skipped' END AS outcome FROM v_file)
"""


def _classified(t):
    pkg = views.packages(t)
    key = F.concat(F.lower("name"), F.lit(":arm64")).alias("key")
    return reconcile.classify_files(
        _files(t), pkg.where("c_custkey % 3 = 0").select(key), pkg.where("c_acctbal < 0").select(key), ["pos"])


@query("q20b_image_files", FILES_SQL + "SELECT * FROM v_class")
def image_files(t):
    return _classified(t)


@query("q20c_outcome_tally", FILES_SQL + """
    SELECT o.outcome, count(c.pos) AS n
    FROM (SELECT unnest(['pushed', 'skipped', 'no_match', 'failed']) AS outcome) o
    LEFT JOIN (SELECT pos, CASE outcome WHEN 'todo' THEN CASE WHEN pos % 8 = 3 THEN 'failed'
                      ELSE 'pushed' END ELSE outcome END AS outcome FROM v_class) c
      ON c.outcome = o.outcome GROUP BY 1""")
def outcome_tally(t):
    """The list worked off: every eighth push or so breaks."""
    ended = F.when(F.col("pos") % 8 == 3, "error: timeout").otherwise("pushed")
    worked = _classified(t).withColumn(
        "outcome", F.when(F.col("outcome") == "todo", ended).otherwise(F.col("outcome")))
    return reconcile.outcome_tally(worked, ["pushed", "skipped", "no_match", "failed"])


@query("q20d_dry_run", CANDIDATE_SQL + """
    SELECT 'delete' AS action, name AS key FROM v_cand WHERE name NOT IN (SELECT name FROM v_done)""")
def dry_run(t):
    todo, done, _ = _candidates(t)
    return reconcile.planned_actions(reconcile.worklist(todo, done), "delete", "key")
