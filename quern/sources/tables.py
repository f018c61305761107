"""Relations of a virtual project over the Parquet tables: files, lines, edges, functions, commits."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import line_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, area (source), language, text, lines, is_test."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("path"), F.col("source").alias("area"), F.col("lang").alias("language"), "text", line_count("text").alias("lines"), (F.col("doc_id") % 7 == 0).alias("is_test"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, n (from 0), line."""
    return files(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct src -> dst without self edges: consecutive parts of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("src <> dst").distinct()


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # as a pattern, since a stream's plain path must be a folder
