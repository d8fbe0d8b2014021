"""From raw documents to token ids: quality, near duplicates, repeated strings, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept; all but the last return the columns of
documents (other columns go). Rows that share a doc_id stay or go together; rows without one are judged as one document by the stages
that compare ids; the stage that cuts strings gives rows that share an id the least of their pairs of lang and source. Null texts are empty.
Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import _session as S

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without (or, left_semi, with only) the given ids; a null id is one of them if it is there."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), how).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject in every row of theirs."""
    from palisade.llm.quality import quality_scores

    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.groupBy("doc_id").agg(F.max("predicted").alias("p")).where("p = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five-word shingles, Jaccard 0.75)."""
    from palisade.llm.jaccard import similar_documents

    groups = similar_documents(docs, 5, 75)
    return _without(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that stand earlier; those of which nothing is left go."""
    from palisade.llm.suffix_dedup import repeated_strings

    kept = repeated_strings(docs, 100).where("kept <> '' OR n_bytes = 0").select(F.col("doc_id").alias("_id"), F.col("kept").alias("text"))
    about = docs.select(*COLUMNS).groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("x")).select("doc_id", "x.lang", "x.source")
    return about.join(kept, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    from palisade.llm.decontam import contaminated

    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and their decoding, as digests."""
    import public_tokenizers

    from palisade.llm.bpe import round_trip

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages), ("byte-level BPE", encoding),
]
#: The classifier can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = S.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
