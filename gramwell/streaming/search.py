"""A stream of queries against stored texts: the seed join as a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gramwell.operators.search import search


def search_stream(seqs: DataFrame, queries: DataFrame, path: str, checkpoint: str, errors: int = 0, edit: bool = True):
    """Starts a query that appends the hits of each micro-batch of queries (qid, pattern) to a Parquet folder.

    A batch is written under its number, so that a repeated batch replaces its own rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        hits = search(seqs, rows.select("qid", "pattern"), errors, edit)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
