"""A corpus prepared in five stages; each reads what the stage before wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of documents, the last one with the tokens' columns as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, decontaminate, pii, simhash, toxicity
from mnemospark.llm.arrow import column, unused
from mnemospark.llm.queries import TOXIC, VOCABULARY
from mnemospark.plans.lineage import cut, forget

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold.

    Null and empty texts have no term and get the score of such examples; repeated rows
    are judged alike; a score of exactly the threshold rejects; without labels nothing
    goes; all columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, toxicity.learnable(labels))
    score, evidence = unused("__score", docs), unused("__evidence", docs)
    return toxicity.score(docs, model, score=score, evidence=evidence).where(F.col(score) < TOXIC).drop(score, evidence)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Null and empty texts are copies of one another; repeated rows, and rows that share
    the smallest id, leave one; null ids come last; all columns stay, whatever their names.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and items match nothing; repeated rows stay or go together, null
    ids too; a similarity of exactly the threshold rejects; all columns stay, whatever
    their names.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced in their texts.

    Null and empty texts stay as they are; repeated rows each stay and count; n_chars, if
    it is there, is the new text's length; all other columns stay, whatever their names.
    """
    clean, spans = unused("__clean", docs), unused("__spans", docs)
    found = pii.sanitise(docs, spans=spans, clean=clean)
    shown = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("text").eqNullSafe(F.col(clean)), F.col("n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return found.select(*(shown.get(c, column(c)).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, ids_sha256, decoded_sha256 and their ids, in place of columns of those names.

    Null and empty texts have no ids; repeated rows are encoded each; other columns stay.
    """
    return bpe.encode_decode(docs, VOCABULARY, more=("ids",))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", hide_personal_data),
    ("encoding", encode),
]

#: Votes of neighbours, fingerprints and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
