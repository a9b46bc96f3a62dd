"""From raw documents to tokens: quality rules, line dedup, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm import bpe, fuzzy_lines, line_crf, mixing, ngram_join
from opslake.llm.queries import MIX_WEIGHTS, mix_levels
from opslake.llm.registry import table
from opslake.session import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels accept."""
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(line_crf.keeps(docs["text"], model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of lines stays; documents left without a word go."""
    kept = fuzzy_lines.dedup(docs, wide=True)
    return kept.where(F.col("text").rlike(mixing.WORD)).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    The smallest id stays. Rows equal in id and text are one document, so rows without an id are told apart by text.
    """
    key = F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("none")),
                      F.hex(F.xxhash64(F.lit(1), "text")), F.hex(F.xxhash64(F.lit(2), "text")))
    keyed = docs.withColumn("__key", key)
    linked = ngram_join.link(keyed, id_col="__key", width=5, percent=80)
    gone = linked.where(F.col("component_id") != F.col("__key")).select("__key")
    return keyed.join(gone, "__key", "left_anti").dropDuplicates(["__key"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the weights, none more than once."""
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=0.5, max_epochs=1, seed=1, name="__copies")
    return mixed.where("__copies > 0").drop("__copies")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates),
          ("mixing", mix), ("byte-level bpe", tokens)]
# A field, fits and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
