"""From raw documents to packed training sequences, in five stages that each take all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoflux.llm.cluster import materialise, read
from genoflux.llm.line_dedup import drop_boilerplate
from genoflux.llm.packing import pack_documents
from genoflux.llm.pu_quality import CUT, learn, score_documents
from genoflux.llm.similar_texts import one_of_each
from genoflux.llm.substring_dedup import drop_repeats
from genoflux.scratch import begin_run, drop_since, mark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts have a score like others; without a good label in the tables none goes;
    repeated rows go or stay together."""
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model, COLUMNS).where(F.col("_score") >= CUT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines; one that loses lines and has nothing left goes.

    Copies of a text count as one page here, as the next stage takes them out. Null texts, and rows without a source, stay as they are."""
    d = drop_boilerplate(docs.select(*COLUMNS), copies_once=True).where("n_dropped = 0 or trim(text) <> ''")
    return d.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles overlap by 0.8 or more: that of smallest doc_id (null after all), then of smallest
    text hash. Rows without a doc_id, or that share one, are told apart by their texts; empty texts are one group; repeated rows are one row."""
    return one_of_each(docs.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of passages of 20 words or more that occur earlier; a text that loses none stays as it is, one that loses all
    goes. Null texts stay; rows without a doc_id, or that share one, are told apart by their texts; repeated rows stay as they are."""
    d = drop_repeats(docs.select(*COLUMNS), carry=COLUMNS).where("n_removed = 0 or kept <> ''")
    less = F.col("n_removed") > 0
    text = F.when(less, F.col("kept")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"), "lang", "source", F.when(less, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096; null texts are empty documents, repeated rows are documents of their own."""
    d = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", sequences)]
#: No SQL expresses a trained model, balls of fingerprints or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again but for the last; what a stage has written goes once the next is there."""
    begin_run()
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        since = mark()
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(since - (k > 0), keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
