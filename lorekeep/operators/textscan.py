"""Literal search over text trees, per-repository sweep, and line counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders the reference search leaves out.
SCAN_EXCLUDED_DIRS = (
    ".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".cache",
    "work", "release", "obsolete",
)

# Folders and extensions the line count leaves out.
COUNT_EXCLUDED_DIRS = (
    "node_modules", ".venv", "__pycache__", "migrations", "htmlcov", ".git", "obsolete",
    "locale", "data", "work", "uploads", "downloads", "results", "output", "cache", "logs", "tmp",
)
COUNT_EXCLUDED_EXTENSIONS = (
    "json", "lock", "svg", "min.js", "map", "po", "pot", "txt", "csv", "log", "sql",
)

# The counted languages, their extensions and line-comment marks.
LANGUAGE_EXTENSIONS = {
    "Python": ("py",),
    "JavaScript": ("js", "mjs", "cjs"),
    "TypeScript": ("ts", "tsx"),
    "CSS": ("css",),
    "HTML": ("html", "htm"),
    "Shell": ("sh", "bash"),
    "R": ("r", "R"),
    "Dockerfile": ("Dockerfile",),
    "YAML": ("yml", "yaml"),
    "Groovy": ("groovy", "nf"),
    "JSX": ("jsx",),
    "SCSS": ("scss",),
}
LINE_COMMENTS = {
    "Python": "#",
    "JavaScript": "//",
    "TypeScript": "//",
    "Shell": "#",
    "R": "#",
    "Dockerfile": "#",
    "YAML": "#",
    "Groovy": "//",
    "JSX": "//",
    "SCSS": "//",
}


BLANKS = " \t\r\f\x0b"


def lines_of(text: Column) -> Column:
    """Lines of a whole text; the empty piece after a final newline is no line."""
    body = F.when(
        F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def outside_dirs(path: Column, excluded: Sequence[str]) -> Column:
    """True when no folder of the path is in ``excluded``."""
    segments = F.split(path, "/")
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded]))


def lacks_extension(path: Column, excluded: Sequence[str]) -> Column:
    test = F.lit(True)
    for ext in excluded:
        test = test & ~F.endswith(path, F.lit("." + ext))
    return test


def language_of(path: Column) -> Column:
    """Language by extension; ``Dockerfile`` and ``Dockerfile.x`` by name; else null."""
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.element_at(F.split(base, "[.]"), -1)
    out = F.when(F.startswith(base, F.lit("Dockerfile")), "Dockerfile")
    for language, extensions in LANGUAGE_EXTENSIONS.items():
        out = out.when(F.contains(base, F.lit(".")) & ext.isin(list(extensions)), language)
    return out


def is_binary(text: Column) -> Column:
    return F.contains(text, F.lit("\0"))


def numbered_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with ``line_no`` from 1; stays in the task that read the file."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_pos", text)).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), text
    )


def find_literal(
    files: DataFrame, literal: str, replacement: str | None = None, text: str = "text"
) -> DataFrame:
    """Matching lines with path and number; with the replaced line if asked for.

    Search and replacement are both literal. Files without the string are
    dropped before they are cut into lines.
    """
    hits = numbered_lines(files.where(F.contains(F.col(text), F.lit(literal))), text)
    hits = hits.where(F.contains(F.col(text), F.lit(literal)))
    if replacement is None:
        return hits
    return hits.withColumn("replaced", F.replace(F.col(text), F.lit(literal), F.lit(replacement)))


def replace_in_files(files: DataFrame, literal: str, replacement: str, text: str = "text") -> DataFrame:
    """Whole replaced texts of the files that hold the string. Inputs stay as they are."""
    return files.where(F.contains(F.col(text), F.lit(literal))).withColumn(
        text, F.replace(F.col(text), F.lit(literal), F.lit(replacement))
    )


def _matching_lines(text: Column, literal: str) -> Column:
    return F.size(F.filter(lines_of(text), lambda t: F.contains(t, F.lit(literal)))).cast("bigint")


def scan_totals(files: DataFrame, literal: str, text: str = "text") -> DataFrame:
    """One row: matching lines and files with a match."""
    n = files.select(_matching_lines(F.col(text), literal).alias("n"))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count_if(F.col("n") > 0).alias("files")
    )


def sweep(
    files: DataFrame, repos: DataFrame, literal: str, repo: str = "repo", text: str = "text"
) -> DataFrame:
    """Per listed repository: matches, files, and skip (no such folder) / ok / hit.

    Lines are counted inside the row of their file; only counts are shuffled.
    """
    counts = (
        files.select(repo, _matching_lines(F.col(text), literal).alias("n"))
        .groupBy(repo)
        .agg(F.sum("n").alias("_m"), F.count_if(F.col("n") > 0).alias("_f"))
    )
    kind = F.when(F.col("_m").isNull(), "skip").when(F.col("_m") == 0, "ok").otherwise("hit")
    return repos.select(repo).distinct().join(counts, repo, "left").select(
        repo, F.coalesce("_m", F.lit(0)).alias("matches"), F.coalesce("_f", F.lit(0)).alias("files"),
        kind.alias("outcome"),
    )


def line_counts(
    files: DataFrame, comment_marks: Mapping[str, str] = LINE_COMMENTS,
    language: str = "language", text: str = "text",
) -> DataFrame:
    """Files, blank, comment and code lines per language, and a ``TOTAL`` row.

    A comment line is one that begins with the language's line-comment mark.
    Block comments are not followed; ``linecount.source_line_counts`` does that.
    """
    lines = lines_of(F.col(text))
    mark = F.lit(None).cast("string")
    for name, value in comment_marks.items():
        mark = F.when(F.col(language) == name, F.lit(value)).otherwise(mark)
    per_file = files.select(
        F.col(language).alias("language"), mark.alias("_mark"), lines.alias("_lines")
    ).select(
        "language",
        F.size("_lines").cast("bigint").alias("lines"),
        F.size(F.filter("_lines", lambda t: F.trim(t, F.lit(BLANKS)) == "")).cast("bigint").alias("blank"),
        F.size(F.filter("_lines", lambda t: F.startswith(F.trim(t, F.lit(BLANKS)), F.col("_mark"))))
        .cast("bigint").alias("comment"),
    )
    return rollup_languages(per_file)


def rollup_languages(per_file: DataFrame) -> DataFrame:
    """Lines, blank and comment lines of files, summed per language and in all."""
    counted = per_file.rollup("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
        F.sum("blank").alias("blank"), F.sum("comment").alias("comment"),
        F.grouping("language").alias("_all"),
    )
    return counted.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("language")).alias("language"),
        "files", "blank", "comment",
        (F.col("lines") - F.col("blank") - F.col("comment")).alias("code"),
    )
