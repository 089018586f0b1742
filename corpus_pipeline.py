"""From raw documents to packed training sequences, one operator per stage.

Every stage takes all that the one before kept, and all but the last return the columns of
``documents``.  Rows that repeat a document after the mix are packed as often as they occur.

What a stage writes for itself is removed when the next stage starts on an input that was
written, or when ``run`` has written the stage's output; so at any time the shared folder holds
the private tables of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import staged, table
from logharbor.llm.mixing import mixed_documents
from logharbor.llm.ngram_join import drop_near_duplicates
from logharbor.llm.packing import packed_sequences
from logharbor.llm.pii import redact
from logharbor.llm.quality_rules import quality_filter
from logharbor.shared import collected_tables, remove_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the last stage wrote for itself.
_private: list[str] = []


def _free(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the last stage's private tables, unless ``docs`` still reads one of them."""
    names = {path.rstrip("/").rpartition("/")[2] for path in _private}
    if any(names & set(file.split("/")) for file in docs.inputFiles()):
        return
    while _private:
        remove_folder(spark, _private.pop())


def _owning(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _free(spark, docs)
        with collected_tables() as own:
            out = stage(spark, docs, sf_dir)
        _private.extend(own)
        return out

    return run_stage


@_owning
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their host's verdicts."""
    return quality_filter(docs)


@_owning
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts linked by 0.8 of their five-word shingles."""
    return drop_near_duplicates(docs)


@_owning
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_owning
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed_documents(docs)


@_owning
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return packed_sequences(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Sampling, tokenizing and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES[:-1]:
        with collected_tables() as own:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for path in [*done, *own[:-1]]:  # the last one is the output itself
            remove_folder(spark, path)
        done = own[-1:]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _private.clear()  # what is left is read by the result, and goes with the application
    return out
