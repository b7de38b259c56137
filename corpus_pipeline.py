"""From raw documents to token ids: quality rules, near-duplicates, personal data, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes every stage's rows
to the shared folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm.bpe_tree import encode_documents
from entityframe.llm.common import read_table, ship, written
from entityframe.llm.mixing import Target, mixture, n_pieces
from entityframe.llm.near_dups import near_duplicates
from entityframe.llm.pii import pseudonymised
from entityframe.llm.quality_rules import passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PII_KEY = "example key; a deployment passes its own"
REPETITIONS = 2.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts go."""
    ship(spark)
    return passing(docs.select(*COLUMNS))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least id; of repeated rows with this id, one.

    Rows with a null id and rows without words are in no group and stay.
    """
    ship(spark)
    found = near_duplicates(docs)
    best = found.where("kept AND component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("id"), F.min("row").alias("key")).select("id", "key", F.lit(True).alias("__once"))
    free = found.where("component IS NULL").select(F.col("doc_id").alias("id"), F.col("row").alias("key"), F.lit(False).alias("__once")).distinct()
    keys = best.unionByName(free).select(F.coalesce("id", F.lit(0)).alias("__id"), F.isnull("id").alias("__no_id"), F.col("key").alias("__row"), "__once")
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).alias("__id"), F.isnull("doc_id").alias("__no_id"), F.xxhash64("text").alias("__row"))
    at = ["__id", "__no_id", "__row"]
    # rows of a group that share id and text are one document; the join's exchange serves for this too
    kept = rows.join(keys, at).withColumn("__n", F.when(F.col("__once"), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates([*at, "__n"]).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and n_chars of the new text."""
    ship(spark)
    return pseudonymised(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream in its order, block by block: every document once at least, those of small sources again up to
    the repetition limit. Files and rows follow the stream; the columns are those of documents."""
    ship(spark)
    # equal rows are one content, which comes as often as all of them together; two hashes tell contents apart, and
    # their join needs no exchange of texts beyond that of the deduplication
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__k1"), F.xxhash64(F.lit(1), *COLUMNS, *[F.isnull(x) for x in COLUMNS]).alias("__k2"))
    tokens = keyed.select(F.struct("__k1", "__k2").alias("key"), "source", n_pieces("text").alias("n_tokens"))
    stream = mixture(tokens, Target(repetitions=REPETITIONS), id_col="key").select("doc_id.*", "block", "position")
    mixed = keyed.dropDuplicates(["__k1", "__k2"]).join(stream, ["__k1", "__k2"])
    return mixed.repartitionByRange("block", "position").sortWithinPartitions("block", "position").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, and digests of ids and decoded bytes."""
    import public_tokenizers

    ship(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_stage), ("near-duplicates", near_dup_stage), ("personal data", pii_stage), ("source mixing", mixing_stage), ("byte-level BPE", bpe_stage)]

#: The hashes of pseudonyms, permutations and tokenizer merges have no SQL form; tests hold each stage against brute force
#: or, where it permutes, against the operator's own plain-Python form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
