"""Study selection: documents in which every term of a study occurs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import first_n

# The five studies, their terms and the limit.
STUDIES = {
    "Parkinson_CaseStudy": ("Parkinson Disease", "therapy", "neurodegeneration"),
    "CRISPR_GenomeEditing": ("CRISPR Cas9", "gene editing", "therapeutic"),
    "Immunotherapy_Cancer": ("cancer immunotherapy", "checkpoint inhibitor", "PD-1"),
    "Cardiovascular_Disease": ("cardiovascular disease", "heart failure", "biomarker"),
    "SingleCell_RNAseq": ("single cell RNA sequencing", "cell type", "transcriptomics"),
}
RETMAX = 500


def split_search(search: str) -> list[str]:
    """``'a AND b'`` -> ``['a', 'b']``."""
    return [term.strip() for term in search.split(" AND ")]


def select_studies(
    docs: DataFrame,
    studies: Mapping[str, Sequence[str]],
    key: str,
    text: str = "text",
    retmax: int | None = RETMAX,
) -> DataFrame:
    """(study, key, rank): up to ``retmax`` documents per study, by key.

    The study list is a parameter, so it becomes expressions of one scan and no
    join. Text is read and matched whole, then dropped before anything is sorted.
    """
    lowered = docs.select(key, F.lower(F.col(text)).alias("_low"))
    low = F.col("_low")
    hits = []
    for study, terms in studies.items():
        match = F.lit(True)
        for term in terms:
            match = match & F.contains(low, F.lit(term.lower()))
        hits.append(F.when(match, F.lit(study)))
    found = lowered.select(F.explode(F.array_compact(F.array(*hits))).alias("study"), key)
    if retmax is None:
        return found
    return first_n(found, ["study"], [key], retmax)
