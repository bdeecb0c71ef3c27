"""Declared schemas. Sources read with these; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


ARTICLE = _struct(
    pmid=_S, title=_S, abstract=_S, year=_S, mesh_terms=T.ArrayType(_S), last_updated=_TS
)

# A parsed feed row: which file it came from, and its place in that file.
FEED_ROW = T.StructType(
    [T.StructField("feed_file", _S), T.StructField("feed_pos", _L), *ARTICLE.fields]
)

# A stored article. feed_file/feed_pos say which feed row wrote it last.
CORPUS = T.StructType(
    [*ARTICLE.fields, T.StructField("feed_file", _S), T.StructField("feed_pos", _L),
     T.StructField("domain", _S)]
)

SYNC_LOG = _struct(file=_S, status=_S, updated=_L, new=_L, synced_at=_TS, batch_id=_L, batch=_S)

REGISTRY_ENTRY = _struct(
    name=_S, organism=_S, assembly=_S, annotation=_S, path=_S,
    files=T.ArrayType(_S), sources=T.ArrayType(_S), downloaded_at=_S,
)
REGISTRY = T.MapType(_S, T.ArrayType(REGISTRY_ENTRY))

# Written form of the registry: one entry per line.
REGISTRY_ROW = T.StructType(
    [T.StructField("category", _S), T.StructField("position", _L), *REGISTRY_ENTRY.fields]
)

PACKAGE = _struct(name=_S, visibility=_S)
PACKAGE_VERSION = _struct(metadata=_struct(container=_struct(tags=T.ArrayType(_S))))
DONE = _struct(key=_S, at=_TS)

COVERAGE_TOTALS = _struct(
    num_statements=_L, covered_lines=_L, missing_lines=_L, percent_covered=T.DoubleType()
)
COVERAGE = _struct(meta=T.MapType(_S, _S), files=T.MapType(_S, _S), totals=COVERAGE_TOTALS)

STATUS_LINE = _struct(repo=_S, branch=_S, line=_S)

