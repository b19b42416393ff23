"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of
their input, whatever these are called. Rows are told apart by doc_id and text, so null ids and ids
that repeat with other texts go through every stage like any other row. Rows that repeat both are
near-duplicates of each other, unless they have no words: those link with nothing and all stay.
Null and empty texts are scored like a text without features, keep no bytes, are taken once by the
mix and packed as the end id. Empty input gives empty output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import mixing, nearjoin, packing, quality, suffixes, words
from emberline.runtime import read_table, remove, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled rows, does not reject."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, threshold=0.3).where("predicted = 1").select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", *(k.alias(f"__row_{i}") for i, k in enumerate(nearjoin.row_key())))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    key = ["__row_0", "__row_1"]
    kept = nearjoin.near_duplicate_documents(docs, similarity=0.8, width=5).where("kept").select(F.col("row_a").alias(key[0]), F.col("row_b").alias(key[1]))
    worded = F.coalesce(F.regexp_like("text", F.lit(words.WORD)), F.lit(False))
    chosen = _keyed(docs.where(worded)).join(kept, key, "left_semi").dropDuplicates(key)
    return chosen.select(docs.columns).unionByName(docs.where(~worded))


def remove_copied_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus."""
    cleaned = suffixes.remove_repeated_strings(docs, length=100, text_name="text")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole; texts without words once."""
    key = ["__row_0", "__row_1"]
    carry = tuple(k.alias(n) for k, n in zip(nearjoin.row_key(), key))
    taken = mixing.mix(docs, carry=carry).groupBy(*key, F.col("source").alias("__source")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    copies = taken.withColumn("__times", times).where("__times > 0").select(*key, "__source", "__times")
    same = [F.col("k." + n) == F.col("d." + n) for n in key] + [F.col("d.source").eqNullSafe(F.col("k.__source"))]
    repeated = _keyed(docs).alias("d").join(copies.alias("k"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*(F.col(f"d.`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, placed into sequences of 2048 tokens.

    Workers come from other stages and hold ids, so they remember fewer segments than by default.
    """
    return packing.pack_documents(docs, end=0, capacity=2048, keep_ids=True, most=1 << 19)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", remove_copied_strings),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and reread, and dropped once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: A trained classifier is no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
