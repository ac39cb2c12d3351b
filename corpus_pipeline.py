"""A training corpus from `documents`: five operators of tarnfold.llm, each stage written and read again.

Every stage but the last returns the columns of `documents`, so columns that the table has besides, whatever their names,
pass through. An empty table stays empty in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import jaccard_join, langid, mixing, packing, suffix_dedup
from tarnfold.llm.common import settle
from tarnfold.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter or far from every language go.

    Null and empty texts go, as they have no letter; very long texts are read whole; ties of centroids go to the first
    language; equal texts are judged alike and repeated rows stay. Without a labelled row that isn't held out every
    document goes.
    """
    return docs.where(~langid.judge(spark, langid.fitted(docs))(F.col("text"))["rejected"])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of exact or near copies.

    Documents without words are groups of their own and stay. Rows of one doc_id stay or go together, so repeated rows of
    the smallest id all stay. Rows with a null doc_id stay. Very long texts are compared whole.
    """
    kept = jaccard_join.jaccard_components(docs.select("doc_id", "text")).where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 50 that an earlier document has; n_chars, if there, counts what is left.

    A null text stays null, and one that is removed whole stays as an empty row. Rows of one doc_id don't cut
    each other; a null doc_id is neither cut nor cuts. Very long texts are cut whole.
    """
    out = suffix_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words; they are taken like others of size 0. A null source is a source of its own. Ties
    of size stand by a hash of the doc_id. Repeated rows are rows of their own.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the sequences; the last stage, with columns of its own.

    A null or empty text is one piece, the end id. Very long texts are cut into pieces; a document that the mix took more
    than once, or a repeated row, has its pieces as often. Of several sequences with equal room the one used last is taken.
    """
    return packing.packed(packing.token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_to_targets", mixing_to_targets),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what each returns is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
