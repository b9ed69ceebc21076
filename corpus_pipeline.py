"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet. The first four return the columns of documents,
the last the packed sequences of the texts that are left. A stage's own
intermediate tables are released by the next stage, whose input stands by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewscope.llm import jaccard_join, langid, packing, quality, suffix_dedup
from viewscope.llm.common import table
from viewscope.session import materialize, recorded, release, ship_package

_LEFT: dict[int, list[str]] = {}    # folders of the intermediate tables of a stage, by its number


def _numbered_stage(number: int, run):
    """``run`` as the stage of that number: its input is written, so what the stage before left behind can go."""
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _LEFT.pop(number - 1, [])
        read = docs.inputFiles() if before else []
        if not any(path.rsplit("/", 1)[-1] in file for path in before for file in read):
            release(spark, before)
        _LEFT[number] = []
        with recorded(_LEFT[number]):
            return run(spark, docs, sf_dir)
    call.__doc__, call.__name__ = run.__doc__, run.__name__
    return call


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, the one of least doc_id."""
    return jaccard_join.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also start earlier are cut out of the texts."""
    return suffix_dedup.dedup_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token pieces packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [(name, _numbered_stage(number, stage)) for number, (name, stage) in enumerate([
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
])]

# tokenizers, fitted classifiers and suffix order have no SQL form; tests/llm checks the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
