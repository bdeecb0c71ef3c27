"""The operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .drift_kmeans import CLUSTER_SQL, cluster_digest
from .hnsw import link_vectors
from .imatch import edited_digest
from .license_scan import license_digest
from .mixing import mix_digest
from .odd_sketch import link_documents
from .packing import pack_documents
from .slot_shards import shard_digest
from .spelling_variants import variants_digest
from .suffix_dedup import repeats_digest
from .template import TEXT_SQL, text_digest
from .toxicity import toxicity_digest
from .warc import WARC_SQL, warc_digest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


QUERIES["op1_license_scan"] = _over("documents", license_digest)
QUERIES["op2_warc"] = _over("pages", warc_digest)
ORACLES["op2_warc"] = WARC_SQL
QUERIES["op3_template"] = _over("pages", text_digest)
ORACLES["op3_template"] = TEXT_SQL
QUERIES["op4_imatch"] = _over("documents", edited_digest)
QUERIES["op5_hnsw"] = _over("embeddings", link_vectors)
QUERIES["op7_pack"] = _over("documents", pack_documents)
QUERIES["op8_odd_sketch"] = _over("documents", link_documents)
QUERIES["op10_suffix_dedup"] = _over("documents", repeats_digest)
QUERIES["op9_mix_sources"] = _over("documents", mix_digest)
QUERIES["op11_drift_kmeans"] = _over("embeddings", cluster_digest)
ORACLES["op11_drift_kmeans"] = CLUSTER_SQL
QUERIES["op12_slot_shards"] = _over("documents", shard_digest)
QUERIES["op13_spelling_variants"] = _over("documents", variants_digest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = sf_dir.rstrip("/")
    return toxicity_digest(spark.read.parquet(f"{home}/documents.parquet"), spark.read.parquet(f"{home}/labels.parquet"))


QUERIES["op6_toxicity"] = op6_toxicity

#: Cosines of all pairs of a label, and the closure of the links.
ORACLES["op5_hnsw"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
"""
