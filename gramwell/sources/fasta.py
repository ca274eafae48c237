"""FASTA files and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.functions.strings import reverse_complement


def read_fasta(spark: SparkSession, path: str, symbols: str = "ACGTN", unknown: str | None = None) -> DataFrame:
    """name, text of each record, upper-cased, lines joined; records are split by '>' in parallel.

    unknown: what other symbols become; without it they raise.
    """
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    cut = raw.select(F.split("value", "\r?\n", 2).alias("p"))
    out = cut.select(F.trim(F.col("p")[0]).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "")).alias("text"))
    other = f"[^{symbols}$]"
    if unknown is not None:
        return out.withColumn("text", F.regexp_replace("text", other, unknown))
    bad = F.raise_error(F.concat(F.lit("unknown symbol in "), F.col("name")))
    return out.withColumn("text", F.when(F.col("text").rlike(other), bad).otherwise(F.col("text")))


def with_reverse_complements(queries: DataFrame) -> DataFrame:
    """qid, pattern, is_reverse: each pattern (2 * qid) and its reverse complement (2 * qid + 1)."""
    forward = queries.select((F.col("qid") * 2).alias("qid"), "pattern", F.lit(False).alias("is_reverse"))
    return forward.unionByName(queries.select((F.col("qid") * 2 + 1).alias("qid"), reverse_complement(F.col("pattern")).alias("pattern"), F.lit(True).alias("is_reverse")))


def write_hits(hits: DataFrame, path: str) -> None:
    """qid seq_id pos, a line each."""
    hits.select("qid", "seq_id", "pos").write.mode("overwrite").option("sep", " ").csv(path)


def save_index(sa: DataFrame, path: str) -> None:
    """An index as Parquet with its format's number."""
    sa.withColumn("version", F.lit(1)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.parquet(path)
    if got.where("version <> 1").limit(1).count():
        raise ValueError("an index of another format")
    return got.drop("version")


def build_or_load(spark: SparkSession, path: str, build) -> DataFrame:
    """The index at the path, built and saved first if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        save_index(build(), path)
    return load_index(spark, path)
