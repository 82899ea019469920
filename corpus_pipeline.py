"""A corpus from raw documents to packed training sequences.

Five stages, each over all that its predecessor kept, written as Parquet and read again in between: quality (rejected
documents go), language (rejected documents go), near-duplicates (one document of each group stays), mixing to target
weights (documents are left out or repeated) and packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import langid, minhash, mixing, packing, quality
from gapline.llm.common import cut
from gapline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out what the classifier rejects; it learns from the labelled rows of ``docs``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(COLUMNS), model, 0.3).where("predicted = 1").select(COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out what no language model vouches for."""
    return langid.identify(docs.select(COLUMNS), langid.train(docs)).where("not rejected").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or nearly equal texts stays, that with the smallest id; null ids and null texts stay.

    Of rows with one id and one text one stays, with the smallest values of the other columns.
    """
    found = cut(minhash.near_duplicates(docs).where("doc_id is not null and digest is not null"))
    gone = found.where("not kept").select("doc_id", "digest").distinct()
    again = cut(found.where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest"))
    rows = docs.select(*COLUMNS, F.md5("text").alias("digest"))
    out = rows.join(gone, ["doc_id", "digest"], "left_anti")
    if again.isEmpty():
        return out.select(COLUMNS)
    once = out.join(again, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min(F.struct(COLUMNS)).alias("x"))
    return out.join(again, ["doc_id", "digest"], "left_anti").select(COLUMNS).unionByName(once.select("x.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source nears its target of words."""
    return mixing.emit(mixing.mix(docs.select(COLUMNS)), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of up to 4,096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_language),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
