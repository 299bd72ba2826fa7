"""A training corpus from ``documents``: five stages, each one operator of ``rasterjobs.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of ``documents``, and further columns whatever their names. Null ids,
repeated ids and repeated rows are kept or go as each stage says; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.llm import decontaminate, mixing, ngram_join, queries, tokenpack
from rasterjobs.llm.common import small, stage, table


def _without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``docs`` without the rows whose ``_id`` and ``_hash`` (null-safe; of the text) are in ``gone``."""
    gone = small(stage(gone.select(*(F.col(k).alias(f"{k}_gone") for k in keys)).distinct(), "gone"))
    own = {"_id": F.col("doc_id"), "_hash": F.xxhash64(F.col("text").cast("string"))}
    match = [own[k].eqNullSafe(F.col(f"{k}_gone")) for k in keys]
    return docs.join(gone, match, "left_anti").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id`` (here the hash of the text) and ``text`` of each different text, for decisions that hang on the text alone."""
    t = F.col("text").cast("string")
    return docs.select(F.xxhash64(t).alias("doc_id"), t.alias("text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    The text alone decides, so rows with equal texts stay or go together, with or
    without an id. Null and empty texts score as texts without hits.
    """
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    scores = queries.toxicity.score(_numbered(docs), model)
    return _without(docs, scores.filter(F.col("score") >= queries.TOXIC).select(F.col("doc_id").alias("_hash")), "_hash")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five words, 0.8).

    Rows that share an id are one document, which stays or goes whole. A row
    without an id goes if a document has an equal set of shingles, else it stays.
    Texts without words are in no group and stay.
    """
    groups = ngram_join.similar_documents(docs, n=5, num=80, den=100)
    gone = groups.filter("component_id is not null and not doc_id <=> component_id")
    return _without(docs, gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "_id", "_hash")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat benchmark items.

    The text alone decides, as in ``reject_toxic``; texts without words stay.
    """
    hits = decontaminate.decontaminate(_numbered(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.filter(decontaminate.contaminated()).select(F.col("doc_id").alias("_hash")), "_hash")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a begun repetition included; documents not taken go.

    Repeated rows are documents of their own, and so are rows without an id or
    with a repeated one; a null source is a source. Texts without words go.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    out = mixing.repeated(queries.mix_documents(whole), F.col("taken"), F.col("size"))
    return out.select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token shards, read back: a row for each document of the mix, rows without an id first."""
    return tokenpack.token_table(docs, queries.tokenizer(), end_id=queries.END_ID)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each_group), ("decontamination", decontaminated), ("mix", mixed), ("tokens", tokens)]

#: Learned scores and a tokenizer stand between the tables and the rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written down and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
