"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names of the human-readable size, smallest first.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

# Decimal factors of printed image sizes.
PRINTED_UNITS = {"B": 1, "kB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}


def human_size(n_bytes: Column) -> Column:
    """Size with one decimal, divided by 1024 until below 1024; PB is the last unit.

    ``bround`` settles exact ties to the even digit, as C-style printing does;
    ``format_string`` alone would round them up.
    """
    def shown(power: int, unit: str) -> Column:
        scaled = F.bround(n_bytes.cast("double") / F.lit(float(1024**power)), 1)
        return F.format_string("%.1f%s", scaled, F.lit(unit))

    out = F.when(n_bytes.isNull(), F.lit(None).cast("string"))
    for power, unit in enumerate(SIZE_UNITS):
        out = out.when(n_bytes < F.lit(1024 ** (power + 1)), shown(power, unit))
    return out.otherwise(shown(len(SIZE_UNITS), "PB"))


def printed_size_bytes(text: Column) -> Column:
    """``61.7MB`` -> bytes. Null when the text is not a printed size."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$", 2)
    factor = F.lit(None).cast("decimal(20,0)")
    for name, value in PRINTED_UNITS.items():
        factor = F.when(unit == name, F.lit(value).cast("decimal(20,0)")).otherwise(factor)
    amount = F.nullif(number, F.lit("")).cast("decimal(18,4)")
    return (amount * factor).cast("decimal(20,0)")


def last_passed_count(text: Column) -> Column:
    """The last ``N passed`` in a test summary, 0 if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+) passed"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("bigint"), F.lit(0).cast("bigint"))


def escape_slashes(name: Column) -> Column:
    """Only ``/`` becomes ``%2F``; every other character stays."""
    return F.replace(name, F.lit("/"), F.lit("%2F"))


def escape_path(name: Column) -> Column:
    """Percent-encode every reserved character (a space is ``%20``, not ``+``).

    The form encoder underneath also leaves ``*`` alone and escapes ``~``; both
    are put right, so only letters, digits and ``_.-~`` stay.
    """
    out = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def image_name(file_name: Column, suffix: str = "_arm64.sif") -> Column:
    """Lower-cased name in front of ``suffix``; null when the suffix is absent."""
    stem = F.substring(file_name, F.lit(1), F.length(file_name) - F.lit(len(suffix)))
    return F.when(F.endswith(file_name, F.lit(suffix)), F.lower(stem))


def image_tag(line: Column) -> Column:
    """The quoted value after ``DOCKER_IMAGE =``; null if absent."""
    return F.nullif(F.regexp_extract(line, r'DOCKER_IMAGE\s*=\s*"([^"]+)', 1), F.lit(""))


def platform_flag(line: Column) -> Column:
    """The value after ``--platform`` with ``=`` or a blank; null if absent."""
    return F.nullif(F.regexp_extract(line, r"--platform[= ]([a-zA-Z0-9/]+)", 1), F.lit(""))


def chunk_name(number: Column, prefix: str) -> Column:
    """``prefix`` and the number padded to three digits."""
    return F.concat(F.lit(prefix), F.format_string("%03d", number.cast("bigint")))


def chunk_number(name: Column, prefix: str) -> Column:
    """The number in a chunk name, null when it is not a number."""
    rest = F.replace(name, F.lit(prefix), F.lit(""))
    return rest.try_cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """part/whole x 100 as a double, 0 when whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0)).otherwise(
        F.lit(0.0)
    )


def coverage_band(pct: Column, ok: float = 90.0, warn: float = 80.0) -> Column:
    """``ok`` / ``warn`` / ``low``; ``unknown`` for an unreadable report (null)."""
    return (
        F.when(pct.isNull(), "unknown").when(pct >= ok, "ok").when(pct >= warn, "warn")
        .otherwise("low")
    )


def json_state(doc: Column) -> Column:
    """Upper-cased ``state`` of a JSON document; missing, null or empty -> UNKNOWN."""
    state = F.nullif(F.get_json_object(doc, "$.state"), F.lit(""))
    return F.upper(F.coalesce(state, F.lit("UNKNOWN")))


def json_row_count(doc: Column, path: str = "$.bioquery.payload.rows") -> Column:
    """Length of a nested array, 0 if any step of the path is missing."""
    return F.coalesce(F.json_array_length(F.get_json_object(doc, path)), F.lit(0)).cast("bigint")


def join_text(parts: Column) -> Column:
    """Non-empty parts joined by one space."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def visibility_or_unknown(visibility: Column) -> Column:
    return F.coalesce(visibility, F.lit("unknown"))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))
