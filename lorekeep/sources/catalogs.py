"""Registry, inventory, package, tag and name-list readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.ordering import ROWS_PER_RANGE, carry_down, dense_index
from ..session import settle
from .files import list_tree, read_texts


def path_text(uri: Column) -> Column:
    """A file URI as a plain path (scheme off, percent signs decoded)."""
    plain = F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


#: A line of a written document: perhaps the begin of a category, and entries.
_LINE = r'(?s)^\s*+(?:\{|,)?(?:("(?:[^"\\]|\\.)*+"):\[)?(\{.*\})(?:\]\}|\],|\]|,)?\s*$'


def read_registry_document(spark: SparkSession, path: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """A nested registry document as rows: category, position, and the entry fields.

    ``path`` is a JSON file of any layout, or a folder as ``write_registry_document`` leaves it. In the latter the
    part files, read in turn, are the document, and a line holds one entry: lines are parsed where they are, and
    the category that stands at its first entry is carried down. A document that does not parse fails the job.
    """
    try:
        lines = spark.read.text(path).where(F.trim("value") != "").select(
            F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"), F.regexp_extract("value", _LINE, 1).alias("_name"),
            F.from_json(F.concat(F.lit("["), F.nullif(F.regexp_extract("value", _LINE, 2), F.lit("")), F.lit("]")),
                        T.ArrayType(schemas.REGISTRY_ENTRY)).alias("_es"))
        shape = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_es").isNull()).alias("odd")).first()
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.REGISTRY_ROW)
    if shape["n"] > 1 and not shape["odd"]:
        entries = lines.select("_file", "_block", "_line", "_name", F.posexplode("_es").alias("_at", "e"))
        order = ["_file", "_block", "_line", "_at"]
        entries = settle(entries, "registry-lines")
        name = F.try_element_at(F.from_json(F.concat(F.lit("["), "_name", F.lit("]")), "array<string>"), F.lit(1))
        named = F.when((F.col("_name") != "") & (F.col("_at") == 0), name)
        carried = settle(carry_down(entries, order, "category", named, rows_per_range=rows_per_range), "registry-named")
        return dense_index(carried, order, "position", ["category"], rows_per_range).select("category", "position", "e.*")
    parsed = F.from_json("value", schemas.REGISTRY)
    sound = F.when(parsed.isNull(), F.raise_error(F.lit("a registry document does not parse"))).otherwise(parsed)
    by_category = docs.select(F.explode(sound).alias("category", "es"))
    return by_category.select("category", F.posexplode("es").alias("position", "e")).select(
        "category", F.col("position").cast("bigint").alias("position"), "e.*"
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry written one entry per line; empty if absent."""
    try:
        return spark.read.schema(schemas.REGISTRY_ROW).json(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.REGISTRY_ROW)


def read_inventory(spark: SparkSession, root: str, spread: int = 2) -> DataFrame:
    """Everything below ``root``: path relative to it, is_file, size (null for a folder).

    Files of zero bytes count as present here. Contents are not read.
    """
    return list_tree(spark, root, spread).select("path", "is_file", "size")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of a folder, or one page: page, text."""
    files = list_tree(spark, path, spread=1).where("is_file")
    return read_texts(files).select(F.element_at(F.split("path", "/"), -1).alias("page"), "text")


def parse_package_pages(pages: DataFrame) -> DataFrame:
    """Packages of JSON pages (page, text). A page that is no array of packages gives none."""
    rows = F.from_json("text", T.ArrayType(schemas.PACKAGE))
    return pages.select(F.explode(rows).alias("_p")).select("_p.*").where(F.col("name").isNotNull())


def read_package_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages (JSON arrays of packages), concatenated.

    See :func:`listing_status` for which listings are incomplete.
    """
    return parse_package_pages(_pages(spark, path))


def parse_listing_status(pages: DataFrame) -> DataFrame:
    """Per page (page, text) ``ok`` if it is an array of packages, else ``failed``."""
    # Spark reads a lone object as an array of one, so the bracket is looked for as well.
    rows = F.when(F.startswith(F.trim("text", F.lit(" \n\r\t")), F.lit("[")), F.from_json("text", "array<struct<name string>>"))
    return pages.select("page", F.when(rows.isNull(), "failed").otherwise("ok").alias("listing_status"))


def listing_status(spark: SparkSession, path: str) -> DataFrame:
    """Per landed page ``ok`` or ``failed``, to tell an outage from a missing name."""
    return parse_listing_status(_pages(spark, path))


def parse_version_pages(pages: DataFrame) -> DataFrame:
    """(name, metadata) of version pages (page, text); the page's folder or file name is the package."""
    versions = F.from_json("text", T.ArrayType(schemas.PACKAGE_VERSION))
    return pages.select("name", F.explode(versions).alias("_v")).select("name", "_v.metadata")


def read_version_tags(spark: SparkSession, path: str) -> DataFrame:
    """(name, tag) of landed version pages, kept as ``<package>/<page>.json``; a package without tags gives no rows."""
    files = list_tree(spark, path).where("is_file and endswith(path, '.json')")
    pages = read_texts(files).select(F.element_at(F.split("path", "/"), 1).alias("name"), "text")
    return explode_tags(parse_version_pages(pages))


def explode_tags(versions: DataFrame, pkg: str = "name") -> DataFrame:
    """(package, tag); a version without tags gives no rows."""
    return versions.select(pkg, F.explode("metadata.container.tags").alias("tag"))


def read_names(spark: SparkSession, path: str, column: str = "key") -> DataFrame:
    """One name per line, trimmed, blanks dropped, each once; empty if absent."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{column} string")
    return name_list(lines, column)


def name_list(lines: DataFrame, column: str = "key", value: str = "value") -> DataFrame:
    trimmed = F.trim(F.col(value), F.lit(" \t\r"))
    return lines.select(trimmed.alias(column)).where(F.col(column) != "").distinct()


def read_done_log(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the append-only done table, each once."""
    from .articles import read_or_empty

    return read_or_empty(spark, path, schemas.DONE).select("key").distinct()


def two_column_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``name<TAB>visibility`` lines; any other line is dropped."""
    parts = F.split(F.col(value), "\t")
    return lines.where((F.trim(F.col(value)) != "") & (F.size(parts) == 2)).select(
        parts[0].alias("name"), parts[1].alias("visibility")
    )


def read_two_columns(spark: SparkSession, path: str) -> DataFrame:
    return two_column_lines(spark.read.text(path))
