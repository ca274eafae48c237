"""A training-corpus pipeline: toxic texts go, near duplicates go, benchmark texts go, secrets are
blanked, and what is left is packed into sequences.

Each stage takes all documents that the one before kept. All but the last return the columns of
documents; run() writes each stage's rows to the cluster's shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.llm.decontamination import WINDOW, find_items
from gramwell.llm.jaccard_join import jaccard_components
from gramwell.llm.packing import pack
from gramwell.llm.secret_scans import scan_secrets
from gramwell.llm.store import written
from gramwell.llm.toxicity import CUT, fold, learn, score_texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies of the pipeline: least percentage of common shingles, and words of a shingle.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; labels are learnt from the folds that op7 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(docs, labels, lambda i: fold(i) != 1)
    return score_texts(docs, model, keep=COLUMNS).where(F.col("score") < CUT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest id, null ids last. Rows without words stay.

    Texts link from 80 % of common five-word shingles, which is more than op9's four words and 85 % find.
    Where ids are null or repeated, each row is a node by a key of its own, written once.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").limit(1).count():
        linked = jaccard_components(docs.select("doc_id", "text"), percent=NEAR_PERCENT, size=NEAR_SHINGLE).where("component_id = doc_id").select("doc_id")
        return docs.select(*COLUMNS).join(linked, "doc_id", "left_semi").select(*COLUMNS)
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = jaccard_components(rows, percent=NEAR_PERCENT, size=NEAR_SHINGLE, id_column="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    kept = rows.select("_row", "doc_id").join(linked, "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of eight words of any benchmark item; items of fewer words have none."""
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS, least_words=WINDOW)
    return found.where(F.size("items") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; n_chars follows where a text changes."""
    found = scan_secrets(docs, keep=COLUMNS, redact=True)
    changed = F.size("spans") > 0
    return found.withColumns({"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 ids."""
    rows = pack(docs).rows(F.crc32("ids"))
    return rows.select(F.col("_id").alias("doc_id"), "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Training, components and packing have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
