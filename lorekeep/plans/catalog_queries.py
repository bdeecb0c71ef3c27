"""Registry, selection, status and fetch-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from . import views
from .registry import query
from .views import with_views


@query("q11_file_grid", """
    SELECT s_suppkey, chrom, suffix, s_name || '/sites.chr' || chrom || suffix AS file
    FROM supplier
    CROSS JOIN (SELECT CAST(i AS VARCHAR) AS chrom FROM generate_series(1, 22) g(i)
                UNION ALL SELECT 'X' UNION ALL SELECT 'Y')
    CROSS JOIN (SELECT '.vcf.bgz' AS suffix UNION ALL SELECT '.vcf.bgz.tbi')""")
def file_grid(t):
    bases = t.supplier.select("s_suppkey", "s_name")
    grid = catalog.chromosome_files(bases, (".vcf.bgz", ".vcf.bgz.tbi"))
    return grid.select("s_suppkey", "chrom", "suffix", F.concat(
        "s_name", F.lit("/sites.chr"), "chrom", "suffix").alias("file"))


def _entries(t):
    return t.part.select(F.col("p_type").alias("category"), F.col("p_name").alias("name"),
                         F.col("p_brand").alias("entry"), F.col("p_partkey").alias("seq"))


@query("q12_registry_upsert", """
    SELECT p_type AS category, p_name AS name, arg_max(p_brand, p_partkey) AS entry,
           min(p_partkey) AS position FROM part GROUP BY 1, 2""")
def registry_upsert(t):
    return catalog.upsert_registry(_entries(t), ["seq"])


@query("q12b_registry_size", """
    SELECT count(*) AS entries, count(DISTINCT p_type) AS categories
    FROM (SELECT DISTINCT p_type, p_name FROM part)""")
def registry_size(t):
    return catalog.registry_size(catalog.upsert_registry(_entries(t), ["seq"]))


def _selection(t):
    """Nations as species, suppliers as their assemblies, customers as unknown names."""
    defaults = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("species"), F.col("s_name").alias("assembly"),
        F.col("s_suppkey").alias("pos"))
    species = t.nation.where("n_regionkey in (1, 3)").select(
        (100 - F.col("n_nationkey")).alias("pos"), F.col("n_name").alias("species"))
    given = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("assembly"))
    again = given.select((F.col("pos") + 1_000_000_000).alias("pos"), "assembly")
    unknown = t.customer.where("c_acctbal < 0").select(
        (F.col("c_custkey") + 2_000_000_000).alias("pos"), F.col("c_name").alias("assembly"))
    return defaults, species, given.union(again).union(unknown)


SELECTION_SQL = """
    WITH v_default AS (SELECT n_name AS species, s_name AS assembly, s_suppkey AS pos, n_nationkey, n_regionkey
                       FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    v_given AS (SELECT s_suppkey AS pos, s_name AS assembly FROM supplier WHERE s_acctbal > 0
                UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier WHERE s_acctbal > 0
                UNION ALL SELECT c_custkey + 2000000000, c_name FROM customer WHERE c_acctbal < 0),
    v_resolved AS (SELECT 'assemblies' AS mode, pos, assembly FROM v_given
    UNION ALL SELECT 'species', CAST(100 - n_nationkey AS BIGINT) * 1000000000 + pos, assembly
              FROM v_default WHERE n_regionkey IN (1, 3)
    UNION ALL SELECT 'both', pos, assembly FROM v_given
              WHERE assembly IN (SELECT assembly FROM v_default WHERE n_regionkey IN (1, 3)))
"""


def _resolved(t):
    defaults, species, given = _selection(t)
    modes = {
        "assemblies": catalog.resolve_selection(defaults, species.limit(0), given),
        "species": catalog.resolve_selection(defaults, species, None),
        "both": catalog.resolve_selection(defaults, species, given),
    }
    out = None
    for mode, rows in modes.items():
        tagged = rows.select(F.lit(mode).alias("mode"), F.col("pos").cast("bigint").alias("pos"), "assembly")
        out = tagged if out is None else out.unionByName(tagged)
    return out, defaults


@query("q13_resolve", SELECTION_SQL + "SELECT mode, CAST(pos AS BIGINT) AS pos, assembly FROM v_resolved")
def resolve(t):
    return _resolved(t)[0].orderBy("mode", "pos")


@query("q13b_match_manifest", SELECTION_SQL + """
    SELECT mode, CAST(r.pos AS BIGINT) AS pos, r.assembly, coalesce(d.species, 'unknown') AS species
    FROM v_resolved r LEFT JOIN v_default d ON r.assembly = d.assembly""")
def match_manifest(t):
    targets, defaults = _resolved(t)
    manifest = defaults.select("assembly", "species")
    known = catalog.match_manifest(targets, manifest)
    unknown = catalog.unknown_assemblies(targets, manifest).withColumn("species", F.lit("unknown"))
    return known.unionByName(unknown)


def _checks(t):
    return t.part.select(F.col("p_partkey").alias("path"), F.col("p_name").alias("label"))


SIZE_SQL = " ".join(
    ["CASE WHEN size < 1024 THEN printf('%.1f%s', CAST(size AS DOUBLE), 'B')"]
    + [f"WHEN size < {1024**(i + 1)} THEN printf('%.1f%s', CAST(size AS DOUBLE) / {1024**i}, '{u}')"
       for i, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB"))]
    + [f"ELSE printf('%.1f%s', CAST(size AS DOUBLE) / {1024**5}, 'PB') END"])


@query("q14_status_report", with_views("v_inventory") + f"""
    SELECT p_partkey AS path, p_name AS label, path IS NOT NULL AS present,
           CASE WHEN is_file THEN {SIZE_SQL} ELSE '' END AS size_text
    FROM part LEFT JOIN v_inventory ON p_partkey = path""")
def status_report(t):
    return catalog.status_report(_checks(t), views.inventory(t))


@query("q14b_status_totals", with_views("v_inventory") + """
    SELECT count(*) FILTER (WHERE path IS NOT NULL) AS present,
           count(*) FILTER (WHERE path IS NULL) AS missing
    FROM part LEFT JOIN v_inventory ON p_partkey = path""")
def status_totals(t):
    return catalog.status_totals(catalog.status_report(_checks(t), views.inventory(t)))


@query("q15_fetch_plan", with_views("v_inventory") + """
    SELECT p_partkey AS path, p_name AS label FROM part
    WHERE NOT EXISTS (SELECT 1 FROM v_inventory WHERE path = p_partkey AND size > 0)""")
def fetch_plan(t):
    return catalog.fetch_plan(_checks(t), views.inventory(t))


@query("q15b_register_present", with_views("v_inventory") + """
    SELECT p_partkey AS path, p_name AS label FROM part
    WHERE p_partkey IN (SELECT path FROM v_inventory)""")
def register_present(t):
    return catalog.register_present(_checks(t), views.inventory(t))
