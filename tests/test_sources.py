import pytest
from gramwell.functions import strings
from gramwell.sources import fasta
from pyspark.sql import functions as F


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nacg\n>two\n\n>three\r\nNNA\r\n")
    rows = {r["name"]: r["text"] for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one first": "ACGTACG", "two": "", "three": "NNA"}
    with pytest.raises(Exception, match="unknown symbol"):
        fasta.read_fasta(spark, str(tmp_path / "a.fa"), "ACGT").collect()
    assert "TTA" in {r["text"] for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), "ACGT", "T").collect()}


def test_reverse_complements_and_hits(spark, tmp_path):
    q = spark.createDataFrame([(3, "AACG")], "qid long, pattern string")
    assert sorted(map(tuple, fasta.with_reverse_complements(q).collect())) == [(6, "AACG", False), (7, "CGTT", True)]
    hits = spark.createDataFrame([(1, 2, 3, 0)], "qid long, seq_id long, pos long, errors int")
    fasta.write_hits(hits, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 2 3"]


def test_bits(spark):
    one = spark.createDataFrame([(-1, 0b1011)], "a long, b long")
    got = one.select(strings.count_after_left_shift(F.col("a"), 60), strings.count_after_right_shift(F.col("a"), 60), strings.count_signed_shift(F.col("b"), 1), strings.count_outside(F.col("b"), 2, True), strings.ternary(0b11101000, F.col("a"), F.col("b"), F.lit(0).cast("long")), strings.bits_of(F.array(F.lit(True), F.lit(False), F.lit(True))), strings.marks(F.array(F.lit(1), F.lit(3)), 2, "less")).first()
    assert tuple(got) == (4, 4, 2, 1, 0b1011, 5, [True, False])


def test_streamed_queries(spark, tmp_path):
    from gramwell.streaming.search import search_stream

    seqs = spark.createDataFrame([(0, "abcabc")], "seq_id long, text string")
    spark.createDataFrame([(0, "abc"), (1, "cab")], "qid long, pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, pattern string").parquet(str(tmp_path / "in"))
    job = search_stream(seqs, stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["qid"], r["pos"]) for r in got.collect()) == [(0, 0), (0, 3), (1, 2)]
