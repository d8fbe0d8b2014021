"""Session helpers: where to cut lineage, how executors get this package, how many blocks a table needs."""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text bytes that one block of documents holds on average; a task works on one block at a time.
BLOCK_BYTES = 4 << 20
LOWEST_ID = -(1 << 63)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="palisade-src-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder named by spark.checkpoint.dir, without its lineage.

    A folder of our own is set only in local mode, where driver and executors are one process.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palisade-ckpt-"))
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one aggregate over the column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0)


def block_count(size: int, least: int = 12, block: int = BLOCK_BYTES) -> int:
    """Blocks for so many bytes of text at about `block` bytes each."""
    return max(least, math.ceil(size / block))


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) only: null texts are empty, a null id ranks before all others."""
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )


def blocked(docs: DataFrame, n: int) -> DataFrame:
    """documents() with a block number each, dealt out one block to a partition; every later use reuses that exchange."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartitionById(n, "block")


def public_id(name: str = "doc_id"):
    """The id as given: the rank of a null id becomes null again."""
    return F.when(F.col(name) != F.lit(LOWEST_ID), F.col(name)).alias(name)
