"""Article feed, corpus and sync-log readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalars import join_text
from .files import list_tree, read_texts

RECORD_END = "</PubmedArticle>"
FEED_END = "</PubmedArticleSet>"
FEED_GLOB = "*.xml.gz"

# A record starts at this tag; the feed's root tag only shares the prefix.
_RECORD = r"(?s)<PubmedArticle[\s>].*"
_LOOSE_END = r"</PubmedArticle\s+>"
# Entities that plain XML does not declare, and two characters it does not allow:
# not well formed, though the check below would let them pass.
_ILLEGAL = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)|[\uFFFE\uFFFF]"
# Attributes of a start tag; their values may hold a closing bracket.
_ATTRS = r"""(?:\s+[^\s<>=/"']+\s*=\s*(?:"[^"]*"|'[^']*'))*+\s*"""
# A character for private use, which stands for a missing text.
_MARK = "\uE000"
_ASIDES = r"(?s)<!--.*?-->|<\?.*?\?>"
_GUARD = T.StructType(
    [T.StructField("b", T.StringType()), T.StructField("_corrupt_record", T.StringType())]
)


def feed_file_name(path: Column | None = None) -> Column:
    path = F.col("_metadata.file_path") if path is None else path
    return F.element_at(F.split(path, "/"), -1)


def _pieces(reader, path: str, glob: str) -> DataFrame:
    """Feed files cut at the end tag of a record: feed_file, value.

    A file is never one string. One that breaks off half-way gives the pieces
    before the break.
    """
    reader = reader.option("lineSep", RECORD_END).option("pathGlobFilter", glob)
    text = reader.option("ignoreCorruptFiles", "true").text(path)
    # An end tag may hold blanks before its bracket; those are cut here.
    return text.select(
        feed_file_name().alias("feed_file"), F.explode(F.split("value", _LOOSE_END)).alias("value")
    )


def number_pieces(pieces: DataFrame) -> DataFrame:
    """Add ``feed_pos``, which rises within a file.

    One task reads a gzip file from start to end, so the row id keeps its order.
    The id says nothing about the order of files: that is their names.
    """
    return pieces.select("feed_file", F.monotonically_increasing_id().alias("feed_pos"), "value")


def read_feed_pieces(spark: SparkSession, path: str, glob: str = FEED_GLOB) -> DataFrame:
    """One row per record of the feed: feed_file, feed_pos, value."""
    return number_pieces(_pieces(spark.read, path, glob))


def stream_feed_pieces(
    spark: SparkSession, path: str, glob: str = FEED_GLOB, **options
) -> DataFrame:
    """The same as a stream, without feed_pos: a stream cannot number its rows, so
    ``streaming.ingest`` does it batch by batch.
    """
    return _pieces(spark.readStream.options(**options), path, glob)


def record_block(piece: Column) -> Column:
    """The record in a piece, end tag included; the bare end tag if there is none."""
    lines = F.when(F.contains(piece, F.lit("\r")), F.regexp_replace(piece, r"\r\n?", "\n"))
    return F.concat(F.regexp_extract(lines.otherwise(piece), _RECORD, 0), F.lit(RECORD_END))


def _leaf(unless: str = "") -> str:
    """An element without child elements; not one named ``unless``."""
    other = rf"(?!{unless}[\s/>])" if unless else ""
    return rf"<{other}[^\s<>/]+{_ATTRS}(?:/>|>[^<]*</[^<>]+>)"


def _text(name: str) -> str:
    """Start tag of ``name`` and, as group 1, the text up to the next tag."""
    return rf"<{name}{_ATTRS}(?:/>|>([^<]*))"


def _child_text(parent: str, name: str) -> str:
    """The same for the first child ``name`` of a ``parent``."""
    return rf"<{parent}{_ATTRS}>(?:[^<]*{_leaf(name)})*+[^<]*{_text(name)}"


def _nested(parent: str) -> str:
    """A ``parent`` with a child that has children, which the pattern above cannot see through."""
    return rf"<{parent}{_ATTRS}>(?:[^<]*{_leaf()})*+[^<]*<[^\s<>/]+{_ATTRS}>[^<]*<[^/]"


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def is_plain(x: Column) -> Column:
    """Whether patterns read a well-formed record exactly as an XML parser would.

    True unless it has comments, CDATA, processing instructions, numeric
    references, or deeper structure where a direct child is asked for.
    """
    return ~(
        F.contains(x, F.lit("<!")) | F.contains(x, F.lit("<?")) | F.contains(x, F.lit("&#"))
        | x.rlike(_nested("PubDate")) | x.rlike(_nested("MeshHeading"))
    )


def article_by_pattern(x: Column) -> Column:
    """The article in a plain, well-formed record."""
    def first(pattern: str) -> Column:
        return F.nullif(_unescape(F.regexp_extract(x, pattern, 1)), F.lit(""))

    year = _child_text("PubDate", "Year")
    abstract = F.regexp_extract_all(x, F.lit(_text("AbstractText")), F.lit(1))
    mesh = F.regexp_extract_all(x, F.lit(_child_text("MeshHeading", "DescriptorName")), F.lit(1))
    return F.struct(
        first(_text("PMID")).alias("pmid"),
        F.when(x.rlike(r"<ArticleTitle[\s/>]"), first(_text("ArticleTitle"))).otherwise("").alias("title"),
        _unescape(join_text(abstract)).alias("abstract"),
        F.when(x.rlike(year), first(year)).otherwise("").alias("year"),
        F.transform(mesh, lambda m: F.nullif(_unescape(m), F.lit(""))).alias("mesh_terms"),
    )


def _descriptors(x: Column) -> Column:
    """The text of each heading's descriptor, null where it does not begin with text.

    ``xpath`` lists text nodes only, so a mark is put where a text is missing.
    """
    marked = F.regexp_replace(x, rf"<DescriptorName{_ATTRS}/>", f"<DescriptorName>{_MARK}</DescriptorName>")
    marked = F.regexp_replace(marked, rf"(<DescriptorName{_ATTRS}>)(?=<)", f"$1{_MARK}")
    texts = F.xpath(marked, F.lit("//MeshHeading/DescriptorName[1]/node()[1][self::text()]"))
    return F.transform(texts, lambda t: F.nullif(F.replace(t, F.lit(_MARK), F.lit("")), F.lit("")))


def article_by_xpath(x: Column) -> Column:
    """The article in any well-formed record. ``xpath`` parses the record anew for
    every field, so this is for the records the patterns cannot read.
    """
    # Comments and processing instructions do not split a text; markup in CDATA is none.
    aside = ~F.contains(x, F.lit("<![CDATA["))
    x = F.when(aside, F.regexp_replace(x, _ASIDES, "")).otherwise(x)

    def first(where: str) -> Column:
        return F.try_element_at(F.xpath(x, F.lit(f"({where})[1]/node()[1][self::text()]")), F.lit(1))

    def exists(where: str) -> Column:
        return F.xpath_boolean(x, F.lit(f"boolean({where})"))

    return F.struct(
        first("//PMID").alias("pmid"),
        F.when(exists("//ArticleTitle"), first("//ArticleTitle")).otherwise("").alias("title"),
        join_text(F.xpath(x, F.lit("//AbstractText/node()[1][self::text()]"))).alias("abstract"),
        F.when(exists("//PubDate/Year"), first("//PubDate/Year")).otherwise("").alias("year"),
        _descriptors(x).alias("mesh_terms"),
    )


def parse_articles(pieces: DataFrame, piece: str = "value") -> DataFrame:
    """Parse record pieces; other columns are kept.

    Text of an element is the text before its first child. A record that is not
    well formed, has no id, or has an empty abstract is dropped.
    """
    keep = [c for c in pieces.columns if c != piece]
    # Each step goes through a generator: filters on its result then stay above it,
    # and Spark neither cuts nor parses a record twice.
    blocks = pieces.select(*keep, F.explode(F.array(record_block(F.col(piece)))).alias("_x"))
    x = F.col("_x")
    # Broken records go first: xpath would fail the job on them.
    sound = blocks.where(
        (x != RECORD_END) & ~x.rlike(_ILLEGAL) & F.from_xml(x, _GUARD)["_corrupt_record"].isNull()
    )
    article = F.when(is_plain(x), article_by_pattern(x)).otherwise(article_by_xpath(x))
    parsed = sound.select(*keep, F.inline(F.array(article)))
    return parsed.where(F.col("pmid").isNotNull() & (F.col("abstract") != ""))


def articles_of(pieces: DataFrame, status: DataFrame, now: Column | None = None) -> DataFrame:
    """Feed rows of all complete files. A file that broke off gives none."""
    complete = status.where(F.col("status") == "ok").select("feed_file")
    articles = parse_articles(pieces).join(complete, "feed_file", "left_semi")
    stamp = F.current_timestamp() if now is None else now
    return articles.withColumn("last_updated", stamp).select(*schemas.FEED_ROW.names)


def read_articles(
    spark: SparkSession, path: str, now: Column | None = None, glob: str = FEED_GLOB
) -> DataFrame:
    """Articles of a feed folder, as feed rows."""
    pieces = read_feed_pieces(spark, path, glob)
    return articles_of(pieces, feed_status(pieces), now)


def feed_status(pieces: DataFrame) -> DataFrame:
    """Per file ``ok``, or ``corrupt`` when its end tag never came."""
    ended = F.bool_or(F.contains(F.col("value"), F.lit(FEED_END)))
    return pieces.groupBy("feed_file").agg(
        F.when(ended, "ok").otherwise("corrupt").alias("status")
    )


def list_feed(spark: SparkSession, path: str, glob: str = FEED_GLOB) -> DataFrame:
    """Names in a feed folder, sorted. File contents are not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return listing.select(
        feed_file_name(F.col("path")).alias("file"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    ).orderBy("file")


def parse_json_articles(files: DataFrame) -> DataFrame:
    """Articles of JSON documents (path, text, modified_at); the domain is the parent folder, a bad document is dropped."""
    broken = "_broken"
    schema = T.StructType([*schemas.ARTICLE.fields, T.StructField(broken, T.StringType())])
    doc = F.from_json("text", schema, {"columnNameOfCorruptRecord": broken})
    rows = files.select(doc.alias("_d"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("domain"), "modified_at")
    return rows.where(F.col("_d").isNotNull() & F.col(f"_d.{broken}").isNull()).select(
        *[F.col(f"_d.{n}").alias(n) for n in schemas.ARTICLE.names], F.lit(None).cast("string").alias("feed_file"),
        F.lit(None).cast("bigint").alias("feed_pos"), "domain", "modified_at",
    )


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as one JSON file per article in one folder per domain.

    Domains and files may have any name; unreadable files are dropped. Read once, then
    keep the result as Parquet: listing millions of small files is the slow part.
    """
    files = list_tree(spark, path).where("is_file and endswith(path, '.json')")
    return parse_json_articles(read_texts(files))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet corpus, partitioned by ``domain``."""
    return read_or_empty(spark, path, schemas.CORPUS)


def without_chunks(corpus: DataFrame, prefix: str) -> DataFrame:
    """Leave out chunk folders, which lie next to the domains."""
    return corpus.where(~F.startswith(F.col("domain"), F.lit(prefix)))


def read_sync_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per processed file; empty before the first run."""
    return read_or_empty(spark, path, schemas.SYNC_LOG)


def sync_state(log: DataFrame) -> DataFrame:
    """The run state as one row, with the defaults of a first run; ``files`` names what was processed."""
    return log.agg(
        F.max(F.when(F.col("status") == "ok", F.col("file"))).alias("last_file"),
        F.max("synced_at").alias("last_sync"),
        F.coalesce(F.sum("updated"), F.lit(0)).alias("total_updated"),
        F.coalesce(F.sum("new"), F.lit(0)).alias("total_new"),
        F.count(F.lit(1)).alias("files_processed"),
        F.array_sort(F.collect_set("file")).alias("files"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with its declared schema; empty if it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
