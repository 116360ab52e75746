"""The driver's tables as the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import postings
from quarry.operators.search import Tables
from quarry.operators.staged import spread

TYPES = ("pdf", "docx", "xlsx", "csv", "txt", "md", "png", "jpg")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    return read(spark, sf_dir, "documents").select("source").distinct().select(n.alias("id"), F.concat(F.lit("/data/"), "source").alias("path"), F.col("source").alias("label"), (n % 10 != 9).alias("active"), (n + 1_700_000_000).alias("created_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (d % 8 + 1).cast("int"))
    name = F.concat(d.cast("string"), F.lit("."), kind)
    return spread(read(spark, sf_dir, "documents")).select(
        d.alias("id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("root_id"), F.concat("lang", F.lit("/"), name).alias("rel_path"), name.alias("filename"), kind.alias("media_type"), F.col("n_chars").alias("size_bytes"),
        ((d * 3600 + 1_704_067_200) * 1_000_000_000).alias("mtime_ns"), F.sha2("text", 256).alias("fingerprint"), F.when(d % 29 == 0, "").otherwise("ext-v1").alias("model_version"),
        F.element_at(F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0)), (d % 3 + 1).cast("int")).cast("float").alias("confidence"), F.col("text").alias("extracted_text"), F.col("lang").alias("lang_hint"), (d % 5).alias("index_marker"), (d + 1_704_067_200).alias("indexed_at"),
        F.when(d % 37 == 0, F.lit(1_800_000_000).cast("long")).alias("deleted_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that carry the driver's vectors: five to a file."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("file_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit(". tail")).alias("text"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("file_id"), F.posexplode(text.chunks("text")).alias("chunk_index", "c"))
    return c.select("file_id", "chunk_index", "c.start_token", "c.end_token", "c.text")


_stored: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def text_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(postings, sizes) of the files, stored on first use in a session and read by every later query of the same table."""
    source = read(spark, sf_dir, "documents")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for name in sorted(source.inputFiles()):
        at = fs.Path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        stamps.append((name, status.getLen(), status.getModificationTime()))
    key = spark.sparkContext.applicationId, tuple(stamps)
    if key not in _stored:
        _stored[key] = postings.store(files(spark, sf_dir))
    return _stored[key]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(roots(spark, sf_dir), files(spark, sf_dir), vector_chunks(spark, sf_dir), vectors(spark, sf_dir), *text_index(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """The vector of one chunk stands in for an embedded query."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan: some files gone, some edited, some at another path, some touched."""
    d = F.col("id")
    f = files(spark, sf_dir).where("deleted_at is null").where(d % 11 != 0)
    moved, edited, touched = d % 17 == 0, d % 13 == 0, d % 19 == 0
    return f.select(
        "root_id", F.when(moved, F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path")).alias("rel_path"), F.when(edited, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(touched, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), F.when(edited, F.sha2(F.concat("extracted_text", F.lit("!")), 256)).otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
