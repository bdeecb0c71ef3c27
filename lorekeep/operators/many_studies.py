"""Study selection for a table of studies: one automaton finds all terms in one reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import first_n
from .studies import RETMAX

#: Terms of one reading, in bytes: what a task's automaton is built of (some 60 bytes a character).
PART_BYTES = 2_000_000
#: Terms of a study that are looked for together; a longer study is put together by a count.
BLOCK_TERMS = 1_000
HITS_PER_BATCH = 50_000

Block = tuple[str, int, list[str]]


def study_blocks(studies: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(study, blocks, terms): the distinct lower-cased terms, in blocks of about ``block_terms``.

    A null study is left out, and so is a study with a null term, which nothing can match.
    """
    terms = studies.select("study", F.lower("term").alias("term")).where("study IS NOT NULL").distinct()
    sizes = terms.groupBy("study").agg(
        F.ceil(F.count(F.lit(1)) / block_terms).alias("_of"), F.bool_or(F.col("term").isNull()).alias("_void")
    ).where("NOT _void")
    held = terms.join(sizes, "study").withColumn("_block", F.pmod(F.xxhash64("term"), F.col("_of")))
    packed = held.groupBy("study", "_block").agg(F.collect_list("term").alias("terms"))
    blocks = packed.groupBy("study").agg(F.count(F.lit(1)).cast("int").alias("blocks"))
    return packed.join(blocks, "study").select("study", "blocks", "terms")


def parts_of(blocks: DataFrame, part_bytes: int) -> Iterator[list[Block]]:
    """Blocks in lists of about ``part_bytes``; the driver holds one partition and one list."""
    part, size = [], 0
    for study, count, terms in blocks.toLocalIterator():
        part.append((study, count, terms))
        size += sum(len(term.encode()) + 1 for term in terms) + len(study.encode())
        if size >= part_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def matcher(part: list[Block]) -> Callable[[str], list[int]]:
    """A function from a lower-cased text to the places, in ``part``, of blocks whose terms all occur.

    A block is looked at only where its longest term occurs.
    """
    automaton, numbers = ahocorasick.Automaton(), {}
    waiting: dict[int, list[tuple[int, frozenset[int]]]] = {}
    always = []
    for place, (_, _, terms) in enumerate(part):
        terms = sorted((term for term in terms if term), key=len)
        for term in terms:
            if term not in numbers:
                numbers[term] = len(numbers)
                automaton.add_word(term, numbers[term])
        if terms:
            rest = frozenset(numbers[term] for term in terms[:-1])
            waiting.setdefault(numbers[terms[-1]], []).append((place, rest))
        else:
            always.append(place)
    if not numbers:
        return lambda text: always
    automaton.make_automaton()

    def match(text: str) -> list[int]:
        found = {number for _, number in automaton.iter(text)}
        return always + [place for number in found for place, rest in waiting.get(number, ()) if rest <= found]

    return match


def _hits(docs: DataFrame, part: list[Block], key: str, text: str) -> DataFrame:
    """(study, blocks, key): a row per block of ``part`` and text in which all its terms occur."""
    schema = T.StructType([
        T.StructField("study", T.StringType()), T.StructField("blocks", T.IntegerType()),
        T.StructField(key, docs.schema[key].dataType),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(part)

        def rows(keys: pa.Array, at: list[int], places: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part[place][0] for place in places], pa.string()),
                pa.array([part[place][1] for place in places], pa.int32()),
                keys.take(pa.array(at, pa.int64())),
            ], names=["study", "blocks", key])

        for batch in batches:
            keys, at, places = batch.column(0), [], []
            for row, value in enumerate(batch.column(1)):
                found = match(value.as_py())
                at += [row] * len(found)
                places += found
                if len(at) >= HITS_PER_BATCH:
                    yield rows(keys, at, places)
                    at, places = [], []
            if at:
                yield rows(keys, at, places)

    lowered = docs.where(F.col(text).isNotNull()).select(F.col(key), F.lower(F.col(text)).alias("_low"))
    return lowered.mapInArrow(search, schema)


def select_many_studies(
    docs: DataFrame, studies: DataFrame, key: str, text: str = "text",
    retmax: int | None = RETMAX, part_bytes: int = PART_BYTES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(study, key, rank): up to ``retmax`` documents per study, by key; as ``select_studies`` does.

    ``studies`` has a row per study and term. The plan does not grow with the studies: up to
    ``part_bytes`` of terms (some 50,000 studies) take one reading of the texts, and each further
    part takes one more. Only (study, key) pairs are shuffled. A null text matches nothing, an
    empty term every text; repeated terms count once; without studies there are no rows. For studies
    of more than ``block_terms`` terms a key must stand for one document, as their blocks are counted.
    """
    blocks = study_blocks(studies, block_terms)
    found = None
    split = False
    for part in parts_of(blocks, part_bytes):
        split = split or any(count > 1 for _, count, _ in part)
        hits = _hits(docs, part, key, text)
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        found = _hits(docs.limit(0), [], key, text)
    if split:
        whole = found.where("blocks > 1").groupBy("study", "blocks", key).agg(F.count(F.lit(1)).alias("_n"))
        found = found.where("blocks = 1").unionByName(whole.where("_n = blocks").drop("_n"))
    found = found.select("study", key)
    if retmax is None:
        return found
    return first_n(found, ["study"], [key], retmax)
