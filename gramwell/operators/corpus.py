"""Sequences as tables: sequences(seq_id, text), queries(qid, pattern), and overlapping chunks of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE = 512
#: Texts of at most STRIDE symbols that stand this often on average are searched once each.
REPEATS = 2
#: Tables are broadcast up to this size, estimated before they are made at ROW_BYTES a row.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 48


def sequences(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """seq_id, text; null texts have no position and are left out."""
    return df.select(F.col(id_column).cast("long").alias("seq_id"), F.col(text_column).alias("text")).where("text is not null")


def queries(df: DataFrame, id_column: str, pattern_column: str, first: int | None = None, read_length: int | None = None) -> DataFrame:
    """qid, pattern. first: only that many of the smallest ids; read_length: each pattern's first symbols."""
    pattern = F.col(pattern_column) if read_length is None else F.substring(pattern_column, 1, read_length)
    out = df.select(F.col(id_column).cast("long").alias("qid"), pattern.alias("pattern")).where("pattern is not null")
    return out if first is None else out.orderBy("qid").limit(first)


def ascii_only(text: Column) -> Column:
    """The printable ASCII symbols of a text."""
    return F.regexp_replace(text, "[^ -~]", "")


def with_sentinel(ranks: Column) -> Column:
    """An array of ranks, each one higher, so that 0 is free for the delimiter."""
    return F.transform(ranks, lambda x: x + 1)


def alphabet(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """symbol, rank (from 1) of all symbols; ValueError beyond `most` of them."""
    from pyspark.sql.window import Window

    one = seqs.select(F.explode(F.array_distinct(F.split("text", ""))).alias("symbol")).where("symbol <> ''").distinct()
    # an alphabet is small: one partition ranks it
    ranked = one.withColumn("rank", F.dense_rank().over(Window.orderBy("symbol")).cast("int"))
    if most is not None and (n := ranked.count()) > most:
        raise ValueError(f"{n} symbols; {most} are allowed")
    return ranked


def to_ranks(text: Column, symbols: list[str]) -> Column:
    """A text as an array of ranks (from 1); symbols outside the alphabet are null."""
    table = F.create_map(*[x for k, s in enumerate(symbols, 1) for x in (F.lit(s), F.lit(k))])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))


def chunks(seqs: DataFrame, overlap: int, stride: int = STRIDE, keep: tuple[str, ...] = ()) -> DataFrame:
    """seq_id, off, chunk (and the columns to keep): pieces of stride + overlap symbols; a match that starts in [off, off + stride) is the piece's own."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(stride)), lambda o: F.struct(o.alias("off"), F.substring(F.col("text"), o + 1, F.lit(stride + overlap)).alias("chunk")))
    return seqs.where(F.length("text") > 0).select("seq_id", *keep, F.explode(cut).alias("c")).select("seq_id", F.col("c.off").cast("long").alias("off"), F.col("c.chunk").alias("chunk"), *keep)


def positions(seqs: DataFrame) -> DataFrame:
    """seq_id, pos (from 0), sym: one row per symbol."""
    return seqs.where(F.length("text") > 0).select("seq_id", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))


def delimiter_run(text: Column, delimiter: str = "\x00") -> Column:
    """Length of the longest run of the delimiter."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({delimiter}+)"), F.lit(1)), F.length)), F.lit(0))


def distinct_texts(seqs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(texts, members, most): texts(seq_id, text, n) to search in, members(seq_id, tid) of them, and how many starts texts have at most.

    Where short texts repeat, each is one row with its number of copies and its hash as seq_id, which
    is a member's tid; elsewhere texts are the sequences themselves and members None.
    """
    key = F.xxhash64("text")
    seen = seqs.agg(F.max(F.length("text")).alias("longest"), F.count("text").alias("n"), F.approx_count_distinct(key).alias("kinds")).first()
    if not seen["n"] or seen["longest"] > STRIDE or seen["n"] < REPEATS * seen["kinds"]:
        return seqs.withColumn("n", F.lit(1).cast("long")), None, 0
    texts = seqs.where("text is not null").groupBy("text").agg(F.count("*").alias("n")).select(key.alias("seq_id"), "text", "n")
    # the number of kinds is an estimate, good to 5 %
    return texts, seqs.select("seq_id", key.alias("tid")), int(seen["kinds"] * 1.3 + 1) * max(1, seen["longest"])


def given_back(found: DataFrame, members: DataFrame | None, most: int) -> DataFrame:
    """Rows found in distinct texts (seq_id, ...), at most `most` of them, for each text's members.

    The members are dealt out by seq_id first: what follows makes many rows of each.
    """
    if members is None:
        return found
    dealt = members.repartition(4 * found.sparkSession.sparkContext.defaultParallelism, "seq_id")
    own = found.withColumnRenamed("seq_id", "tid")
    return dealt.join(F.broadcast(own) if most * ROW_BYTES <= BROADCAST_BYTES else own, "tid").drop("tid")
