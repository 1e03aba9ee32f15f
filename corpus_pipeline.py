"""A training corpus from ``documents``: quality rules, near duplicates, benchmark passages, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next one, so a
lost executor costs the running stage at most. All but the last return the columns of documents.

Defined results: null, empty and wordless texts fail the quality rules and go; repeated rows are near duplicates, so one stays;
very long texts pass like others; columns besides those of documents are kept through all stages, but one named like an output
of the last stage is replaced there; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasq.llm import bpe, decontaminate, near_duplicates, pii, quality_rules, registry
from atlasq.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.filtered(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the lowest id stays of each class."""
    return near_duplicates.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.without_documents(docs, registry.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kinds; n_chars follows."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digest are added."""
    return bpe.encode(docs, *registry.byte_bpe(), outputs=("ids", "n_tokens", "ids_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate),
    ("decontamination", benchmark),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]

#: The rules' estimates, the near-duplicate classes and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = registry.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else materialise(docs), sf_dir)
    return docs
