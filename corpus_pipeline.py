"""A corpus pipeline over the documents table: classify, deduplicate, mask, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again. All stages but the last return the columns of documents.

Defined results: a null text is an empty one in every decision and stays null; rows with a null id are copies of
nothing and draw like id 0; rows that repeat an id and a text are one copy group, unlike texts of one id are not; other
columns are carried along whatever their names; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import minhash, mixing, pii, resample, tokens
from plumbline.llm.queries import pieces_model
from plumbline.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw keeps; all of them where labels of one kind are missing."""
    return resample.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the least id): five words a shingle, similarity of 0.8 or more.

    Texts without words and rows without an id all stay.
    """
    return minhash.dedup(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows; null texts stay null."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities; a null source or language is a category, texts without words stay."""
    return mixing.sample(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids of every text that is left; an empty or null text has none."""
    coded = tokens.encode(docs, pieces_model(), keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("pii", mask_pii),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
