"""A corpus pipeline over ``documents``: every stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restate.llm import decontaminate, language_id, ngram_join, packing, quality
from restate.llm.common import held_out, ship, store, table, text_key, without

TOKENIZER = "word_bpe_49k.json"
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those rejected (no letter, narrow margin) go."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    dictionaries = language_id.fit(docs.where(~held_out("doc_id")))
    return language_id.identify(docs, dictionaries).where(~F.col("rejected")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality under their site's rate is not below ``quality.MIN_QUALITY``."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out("doc_id"))
    judged = quality.judge(docs, quality.fit(docs.where(~held_out("doc_id")), labels), labels)
    return without(docs, store(judged.where("rejected").select("id", "text_key"), "low-quality"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links: the least id (then the least text hash).

    Rows that repeat both id and text become one; texts without a word are linked with nothing and all stay."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    groups = store(ngram_join.similar_groups(docs, n=NEAR_WORDS, percent=NEAR_PERCENT), "near-duplicates")
    rest = without(docs, ngram_join.spare_copies(groups))
    # rows that repeat id and text: decided on the narrow table, so that the texts are not shuffled for none
    repeated = groups.where(F.col("component").isNotNull()).groupBy("id", "text_key").count().where("count > 1")
    repeated = store(repeated.select("id", "text_key"), "repeated")
    if not repeated.take(1):
        return rest
    again = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")) & (text_key("text") == F.col("text_key")), "left_semi")
    again = without(again, ngram_join.spare_copies(groups)).dropDuplicates(["doc_id", "text"])
    return without(rest, repeated).unionByName(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover no word, or under a twentieth of the words."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = hits.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("id", "text_key")
    return without(docs, store(bad, "contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences in bins of the permitted lengths, a row per piece."""
    ship(spark)
    lengths = packing.token_lengths(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(lengths).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language_stage), ("quality", quality_stage), ("near duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]
#: Stages 1 and 2 are models: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
