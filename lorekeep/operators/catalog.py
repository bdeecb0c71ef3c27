"""Dataset registry, manifests, selections, and expected-versus-present status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import human_size
from .ordering import keys_of

# Default assemblies of each species, in order.
SPECIES_ASSEMBLIES = {
    "human": ("GRCh38", "GRCh37", "T2T-CHM13"),
    "mouse": ("GRCm39", "GRCm38"),
    "rat": ("GRCr8",),
    "zebrafish": ("GRCz11",),
    "drosophila": ("BDGP6",),
    "yeast": ("R64",),
}

HUMAN_CHROMOSOMES = 22


def upsert_registry(
    entries: DataFrame, order_by: Sequence[str],
    key: Sequence[str] = ("category", "name"),
) -> DataFrame:
    """One row per key: the last entry, at the position of the first one.

    ``entries`` is the old registry followed by the new rows; ``order_by`` is
    their arrival order. ``position`` holds the arrival of the first entry.
    """
    rest = [c for c in entries.columns if c not in key]
    arrival = F.struct(*order_by)
    packed = entries.groupBy(*key).agg(
        F.max_by(F.struct(*rest), arrival).alias("_entry"), F.min(arrival).alias("position")
    )
    fields = [F.col(f"_entry.{c}").alias(c) for c in rest if c not in order_by]
    position = "position" if len(order_by) > 1 else F.col(f"position.{order_by[0]}").alias("position")
    return packed.select(*key, *fields, position)


def registry_size(registry: DataFrame) -> DataFrame:
    """Total entries and number of categories, in one row."""
    per = registry.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("categories")
    )


#: Between the positions of two species; no species has as many defaults.
SPECIES_STEP = 1_000_000_000


def resolve_selection(
    defaults: DataFrame, species: DataFrame | None = None, assemblies: DataFrame | None = None
) -> DataFrame:
    """Assemblies to work on, as (pos, assembly).

    ``defaults``: species, assembly, pos. ``species`` and ``assemblies``: pos and
    the name. Assemblies alone are taken as given. Species alone give their
    defaults in species order, each once. Both give the assemblies that belong to
    one of the species, order and repeats kept. Neither gives no rows. An empty table
    counts as one that is not given; the plan finds that out. ``pos`` is a bigint in all
    cases; defaults of one species follow each other in the order of their own ``pos``.
    """
    if species is None:
        species = defaults.where("false").select("pos", "species")
    if assemblies is None:
        assemblies = defaults.where("false").select("pos", "assembly")
    some_species = species.agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    some_assemblies = assemblies.agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    chosen = defaults.join(species.select(F.col("pos").alias("_sp"), "species"), "species")
    at = F.min(F.struct("_sp", F.col("pos").alias("_dp")))
    place = F.col("_at._sp").cast("bigint") * SPECIES_STEP + F.col("_at._dp").cast("bigint")
    own = chosen.groupBy("assembly").agg(at.alias("_at")).select(place.alias("pos"), "assembly")
    given = assemblies.select(F.col("pos").cast("bigint").alias("pos"), "assembly")
    belongs = F.col("_known").isNotNull()
    known = keys_of(chosen, "assembly").withColumn("_known", F.lit(True))
    kept = given.join(known, "assembly", "left").where(belongs | ~some_species).select("pos", "assembly")
    return own.where(~some_assemblies).unionByName(kept)


def match_manifest(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of the targets; an unknown assembly gives none."""
    return targets.join(manifest, "assembly")


def unknown_assemblies(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    return targets.join(keys_of(manifest, "assembly"), "assembly", "left_anti")


def status_report(checks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each expected path: present or not, and its printed size if it is a file.

    A directory and a file of zero bytes both count as present.
    """
    found = checks.join(inventory.withColumn("_found", F.lit(True)), "path", "left")
    size = F.when(F.col("is_file"), human_size(F.col("size")))
    return found.select(
        *checks.columns, F.col("_found").isNotNull().alias("present"),
        F.coalesce(size, F.lit("")).alias("size_text"),
    )


def status_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("present")).alias("present"), F.count_if(~F.col("present")).alias("missing")
    )


def fetch_plan(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest rows still to fetch. A file of zero bytes is fetched again."""
    have = keys_of(inventory.where(F.col("size") > 0), "path")
    return manifest.join(have, "path", "left_anti")


def register_present(entries: DataFrame, inventory: DataFrame, only_present: bool = True) -> DataFrame:
    """Entries to register; by default only those whose path is in the inventory."""
    if not only_present:
        return entries
    return entries.join(keys_of(inventory, "path"), "path", "left_semi")


def chromosome_files(
    bases: DataFrame, suffixes: Sequence[str], autosomes: int = HUMAN_CHROMOSOMES
) -> DataFrame:
    """Per base row the file names of chromosomes 1..n, X and Y with every suffix."""
    chroms = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(autosomes)), lambda n: n.cast("string")),
        F.array(F.lit("X"), F.lit("Y")),
    )
    return bases.select("*", F.explode(chroms).alias("chrom")).select(
        "*", F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix")
    )
