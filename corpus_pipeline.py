"""The corpus pipeline: stages over the documents table, each over all that its predecessor kept.

1. language ID: null texts and texts without a letter go, as any other gets a learned language, however low its score;
2. MinHash near-dedup: one document of each group stays;
3. benchmark decontamination: contaminated documents go;
4. secret scans: secrets are masked in the text;
5. best-fit packing: the texts become token sequences.

Language ID judges rows by their text alone. A group of near duplicates leaves one row, whatever ids its rows have, and
rows that share an id but not a text are told apart. Contamination is joined back by doc_id and text. Rows with a null
id or a null in any other column are treated as all others; further columns stay up to the packing.

A stage begins with executors that have given back what the one before it needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the labelled documents teach; the columns stay."""
    from entigraph.llm.language import keep_languages

    return keep_languages(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    from entigraph.llm._store import release_executors
    from entigraph.llm.near_duplicates import one_of_each_group

    release_executors(spark)
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    from entigraph.llm._store import release_executors
    from entigraph.llm.decontamination import keep_clean

    release_executors(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where a text changed."""
    from entigraph.llm._store import release_executors
    from entigraph.llm.secrets import mask_secrets

    release_executors(spark)
    return mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of what is left in sequences of 1024 tokens.

    Workers and executors of the earlier stages hold memory still, so the tokenizer remembers less than by itself and
    takes less text at once.
    """
    from entigraph.llm._store import release_executors
    from entigraph.llm.packing import pack

    release_executors(spark)
    return pack(docs, memo_bytes=16 << 20, chunk_bytes=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the models nor the packing: the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    from entigraph.llm._store import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
