"""The stages of the corpus pipeline: from documents to token ids, each written as Parquet and read again.

Stages keep clean documents: the classifier drops what it rejects, near-duplicate groups keep their smallest document,
repeated passages stay in the document that has them first, and mixing draws documents that are more likely not good
than good at their fitted rates. Columns stay those of documents, and any others there are, until the last stage;
n_chars follows the text.

Defined cases: a null or empty text stays while the classifier takes it for good, is no near copy and loses nothing;
rows that share a doc_id are judged each by their own text, but for near copies, where they are one document; exact
repeats of a row are treated alike; a null doc_id is no copy of anything; columns may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.debruijn_dedup import remove_repeated_passages
from tallyspark.llm.factor_machine import score_quality
from tallyspark.llm.minhash_dedup import near_duplicates
from tallyspark.llm.sentencepiece_bpe import encode_documents
from tallyspark.llm.shared import forget, tables_of, written
from tallyspark.llm.soft_mixing import drawn, label_domains, mix

#: Shares of the tokens that result; those of good texts stay as many as they are.
WANTED = {"good": 0.93, "low": 0.03, "toxic": 0.04}


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a tag of the text, and the whole row as a struct, so that no name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.struct(*docs.columns).alias("all"))


def without(docs: DataFrame, spare: DataFrame) -> DataFrame:
    """docs but for the (doc_id, row) of spare."""
    return packed(docs).join(spare.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_anti").select("all.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("others"))
    kept = score_quality(rows, labels, keep=("text", "others")).filter("predicted = 1")
    return kept.select(*(F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles at a similarity of 0.8."""
    spare = near_duplicates(docs, width=5, percent=80, bands=40, rows=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; a document of which nothing is left goes."""
    changed = remove_repeated_passages(docs, 50).filter("n_removed > 0").select("doc_id", "row", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")).dropDuplicates(["doc_id", "row"])
    both = packed(docs).join(changed, ["doc_id", "row"], "left").filter("gone IS NULL OR NOT gone")
    new = {"text": F.coalesce("kept_text", "all.text"), "n_chars": F.when(F.col("kept_text").isNull(), F.col("all.n_chars")).otherwise(F.char_length("kept_text").cast("long"))} if "n_chars" in docs.columns else {"text": F.coalesce("kept_text", "all.text")}
    return both.select(*(new.get(c, F.col("all")[c]).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely good than not, and of the others as many as their fitted rates say."""
    rates = mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), WANTED, fixed="good")
    return without(docs, rates.filter(~stays()))


def stays() -> F.Column:
    return (F.col("p")[0] >= 0.5) | drawn(F.col("doc_id"), F.col("row"), F.col("rate"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, their number, and hashes of the ids and of the text that they decode to."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the fitted models nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and its operators wrote goes once the next stage has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with tables_of() as tables:
            docs = written(stage(spark, docs, sf_dir))
        for table in [*before, *tables[:-1]]:
            forget(table)
        before = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
