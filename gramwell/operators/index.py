"""Full-text index views as tables: suffix order, BWT, counts, ranks, intervals, locate, merge.

sa(idx, seq_id, pos, sym, prev): all suffixes of a collection in order, with the symbol at and before
each. The collection reads as its texts in order of seq_id, each closed by a delimiter that sorts before
every symbol; delimiters compare by what follows, and the end of the collection sorts first. The symbol
before a text's first is the delimiter.

A suffix is compared by its text up to the delimiter and then by the rank of the text that follows,
which prefix doubling over whole texts gives. Positions are numbered with a range-partitioned sort and
per-partition offsets, texts are ranked in the same way, and ranks are prefix sums over blocks and
groups of blocks, so that one partition only ever holds a row a partition or a group.
Sorting by whole suffixes suits collections of short texts; search does not use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramwell.operators import search
from gramwell.operators.corpus import distinct_texts, positions

DELIMITER = ""
BLOCK = 1 << 16


def _settled(df: DataFrame) -> DataFrame:
    """df with its rows and partitions fixed: in the folder of spark.checkpoint.dir, or in memory where none is set."""
    sc, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            return df.persist()
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in the given total order, by offsets of sorted partitions."""
    placed = _settled(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row a partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.shiftleft(F.col("_p"), 33)).drop("_p", "_i", "_before")


def text_ranks(seqs: DataFrame) -> DataFrame:
    """seq_id, follow: the rank of each text, read on through the collection, among all texts (1-based; prefix doubling).

    Ranks are numbers of the distinct texts, then of the distinct pairs of ranks, in a range-partitioned sort.
    """
    ordered = numbered(seqs.select("seq_id", "text"), "seq_id", name="at")
    kinds = numbered(ordered.select("text").distinct(), "text", name="r")
    now = _settled(ordered.join(kinds, "text").select("seq_id", "at", (F.col("r") + 1).alias("r")))
    n, step = now.count(), 1
    while step < n and now.select("r").distinct().count() < n:
        ahead = now.select((F.col("at") - step).alias("at"), F.col("r").alias("r2"))
        pair = now.join(ahead, "at", "left").withColumn("r2", F.coalesce("r2", F.lit(0)))
        kinds = numbered(pair.select("r", "r2").distinct(), "r", "r2", name="k")
        now = _settled(pair.join(kinds, ["r", "r2"]).select("seq_id", "at", (F.col("k") + 1).alias("r")))
        step *= 2
    following = now.select((F.col("at") - 1).alias("at"), F.col("r").alias("follow"))
    return now.join(following, "at", "left").select("seq_id", F.coalesce("follow", F.lit(0)).alias("follow"))


def suffix_array(seqs: DataFrame) -> DataFrame:
    """idx, seq_id, pos, sym, prev of every suffix, the delimiters' included (pos = the text's length)."""
    each = seqs.join(text_ranks(seqs), "seq_id").select("seq_id", "text", "follow", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("pos"))
    each = each.withColumn("suffix", F.substring(F.col("text"), F.col("pos") + 1, F.length("text")))
    each = each.withColumn("sym", F.substring("suffix", 1, 1)).withColumn("prev", F.when(F.col("pos") > 0, F.substring(F.col("text"), F.col("pos"), F.lit(1))).otherwise(F.lit(DELIMITER)))
    return numbered(each, "suffix", "follow", "seq_id", "pos").select("idx", "seq_id", F.col("pos").cast("long").alias("pos"), "sym", "prev")


def suffix_array_cyclic(seqs: DataFrame) -> DataFrame:
    """idx, seq_id, pos, sym, prev without delimiters: each text is a cycle, compared by its rotations (then seq_id, pos)."""
    each = seqs.where(F.length("text") > 0).select("seq_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("pos"))
    doubled = F.concat("text", "text")
    each = each.withColumn("suffix", F.substring(doubled, F.col("pos") + 1, F.length("text"))).withColumn("sym", F.substring("suffix", 1, 1)).withColumn("prev", F.substring("suffix", -1, 1))
    return numbered(each, "suffix", "seq_id", "pos").select("idx", "seq_id", F.col("pos").cast("long").alias("pos"), "sym", "prev")


def mirrored(seqs: DataFrame) -> DataFrame:
    """seq_id, text, is_reverse: each text and its reverse. A hit of length m at pos in a reverse is one at length - pos - m."""
    return seqs.select("seq_id", "text", F.lit(False).alias("is_reverse")).unionByName(seqs.select("seq_id", F.reverse("text").alias("text"), F.lit(True).alias("is_reverse")))


def mapped_back(hits: DataFrame, seqs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits in reversed texts (as mirrored() or reversed_texts() give them) at the place where they end in the texts themselves.

    A pattern of length m at pos in a reverse covers pos' .. pos' + m of the text, where pos' = length - pos - m.
    """
    sizes = seqs.select("seq_id", F.length("text").alias("_n"))
    full = hits.join(sizes, "seq_id").join(queries.select("qid", F.length("pattern").alias("_m")), "qid")
    return full.withColumn("pos", (F.col("_n") - F.col("pos") - F.col("_m")).cast("long")).drop("_n", "_m")


def search_reversed(seqs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search_hamming by reversed patterns in reversed texts, each hit mapped back to its place in the text."""

    def find(texts: DataFrame, distinct: DataFrame) -> DataFrame:
        hits = search.hamming_hits(reversed_texts(texts), distinct.withColumn("pattern", F.reverse("pattern")), k).withColumnRenamed("pid", "qid")
        back = mapped_back(hits, texts, distinct.select(F.col("pid").alias("qid"), "pattern"))
        return back.select(F.col("qid").alias("pid"), "seq_id", "pos", "errors")

    return search.once(seqs, queries, k, find)


def reversed_texts(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("text", F.reverse("text"))


def merge(*collections: DataFrame) -> DataFrame:
    """One collection of several: the later ones' ids follow the earlier ones'."""
    out, base = None, 0
    for c in collections:
        moved = c.withColumn("seq_id", F.col("seq_id") + F.lit(base))
        out = moved if out is None else out.unionByName(moved)
        last = out.agg(F.max("seq_id").alias("m")).first()["m"]
        base = 0 if last is None else last + 1
    return out


def sampled(sa: DataFrame, rate: int) -> DataFrame:
    """Every rate-th text position, as a row's payload; others have none."""
    return sa.select("idx", F.when(F.col("pos") % rate == 0, F.struct("seq_id", "pos")).alias("sample"))


def with_payload(sa: DataFrame, payload: DataFrame) -> DataFrame:
    """sa with the optional value that `payload` (seq_id, pos, ...) has for each position."""
    return sa.join(payload, ["seq_id", "pos"], "left")


def bwt(sa: DataFrame) -> DataFrame:
    return sa.select("idx", F.col("prev").alias("sym"))


def bwt_steps(seqs: DataFrame, sa: DataFrame, k: int) -> DataFrame:
    """idx, prev_k: the k symbols before each suffix, nearest first, within its text (fewer at its start)."""
    full = sa.join(seqs, "seq_id")
    before = F.substring(F.col("text"), F.greatest(F.lit(1), (F.col("pos") - k + 1).cast("int")), F.least(F.lit(k), F.col("pos").cast("int")))
    return full.select("idx", F.reverse(before).alias("prev_k"))


def cumulative_counts(symbols: DataFrame) -> DataFrame:
    """sym, n, c: how often each symbol stands in the column sym, and how many smaller symbols there are."""
    counts = symbols.groupBy("sym").agg(F.count("*").alias("n"))
    # one row a symbol
    return counts.withColumn("c", F.coalesce(F.sum("n").over(Window.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def _running(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """idx and, for each column, its sum over all smaller idx.

    Sums of blocks are added up in groups of blocks, and those of the groups in one window: a row for
    each block * block symbols.
    """
    far = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c)
    sums = [F.sum(c).alias(c) for c in columns]
    placed = rows.withColumn("b", F.floor(F.col("idx") / block)).withColumn("g", F.floor(F.col("b") / block))
    blocks = placed.groupBy("g", "b").agg(*sums)
    groups = blocks.groupBy("g").agg(*sums).select("g", *[before(c, far("g")) for c in columns]).withColumnsRenamed({c: f"{c}_g" for c in columns})
    blocks = blocks.select("g", "b", *[before(c, far("g", "b")) for c in columns]).withColumnsRenamed({c: f"{c}_b" for c in columns})
    inside = placed.select("idx", "b", *[before(c, far("b", "idx")) for c in columns])
    return inside.join(blocks, "b").join(groups, "g").select("idx", *[(F.col(c) + F.col(f"{c}_b") + F.col(f"{c}_g")).alias(c) for c in columns])


def all_ranks(rows: DataFrame, symbols: list[str], block: int = BLOCK) -> DataFrame:
    """idx, ranks, prefix_ranks: arrays over the symbols, of symbols equal to each, and smaller ones, before idx of rows(idx, sym)."""
    n = range(len(symbols))
    marks = rows.select("idx", *[(F.col("sym") == s).cast("long").alias(f"e{k}") for k, s in enumerate(symbols)], *[(F.col("sym") < s).cast("long").alias(f"s{k}") for k, s in enumerate(symbols)])
    own = _running(marks, [f"{x}{k}" for x in "es" for k in n], block)
    return own.select("idx", F.array(*[F.col(f"e{k}") for k in n]).alias("ranks"), F.array(*[F.col(f"s{k}") for k in n]).alias("prefix_ranks"))


def ranks(rows: DataFrame, symbol: str, block: int = BLOCK) -> DataFrame:
    """idx, rank, prefix_rank of a symbol for every idx of rows(idx, sym): symbols equal to it, and smaller ones, before idx."""
    return all_ranks(rows, [symbol], block).select("idx", F.col("ranks")[0].alias("rank"), F.col("prefix_ranks")[0].alias("prefix_rank"))


def dual_ranks(rows: DataFrame, cursors: DataFrame, symbols: list[str], block: int = BLOCK) -> DataFrame:
    """qid, lo, hi: for each run of rows(idx, sym), the ranks of all symbols before its first row and after its last; empty runs have none."""
    # the row after the last has the ranks of all rows
    end = rows.agg((F.max("idx") + 1).alias("idx")).select("idx", F.lit(None).cast("string").alias("sym")).where("idx is not null")
    table = all_ranks(rows.select("idx", "sym").unionByName(end), symbols, block).select("idx", "ranks")
    ends = cursors.where("len > 0").select("qid", F.explode(F.array(F.struct(F.lit(False).alias("after"), F.col("lb").alias("idx")), F.struct(F.lit(True).alias("after"), (F.col("lb") + F.col("len")).alias("idx")))).alias("e")).select("qid", "e.after", "e.idx")
    met = ends.join(table, "idx")
    return met.groupBy("qid").agg(F.max(F.when(~F.col("after"), F.col("ranks"))).alias("lo"), F.max(F.when(F.col("after"), F.col("ranks"))).alias("hi"))


def low_bits(symbol: Column, bits: int) -> Column:
    """A rank's low bits, as a symbol of a smaller alphabet."""
    return symbol.bitwiseAND(F.lit((1 << bits) - 1))


def high_bits(symbol: Column, bits: int, of: int) -> Column:
    return F.shiftright(symbol, of - bits)


# --- cursors: the suffixes that start with a pattern are a run of idx


def cursors(sa: DataFrame, seqs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, lb, len: the run of suffixes that start with each pattern; len 0 and null lb without any.

    An empty pattern is the root: all suffixes. Needs the suffixes' texts: joined from seqs.
    """
    starts = sa.join(seqs, "seq_id")
    sizes = [r["m"] for r in queries.select(F.length("pattern").alias("m")).distinct().collect()]
    heads = starts.select("idx", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.lit(m)).alias("head")) for m in sizes])).alias("h")).select("idx", "h.m", "h.head").where(F.length("head") == F.col("m"))
    runs = heads.groupBy("head").agg(F.min("idx").alias("lb"), F.count("*").alias("len"))
    return queries.join(runs, queries["pattern"] == runs["head"], "left").select("qid", "lb", F.coalesce("len", F.lit(0)).alias("len"))


def locate(sa: DataFrame, cursors: DataFrame) -> DataFrame:
    """qid, seq_id, pos of every suffix of each cursor."""
    rows = cursors.where("len > 0").select("qid", F.explode(F.sequence("lb", F.col("lb") + F.col("len") - 1)).alias("idx"))
    return rows.join(sa, "idx").select("qid", "seq_id", "pos")


def extend(seqs: DataFrame, hits: DataFrame, queries: DataFrame, left: bool) -> DataFrame:
    """qid, sym, count: what stands before (left) or after each hit, the delimiter at a text's ends included.

    A text of distinct_texts() counts n times.
    """
    full = hits.join(queries, "qid").join(seqs, "seq_id")
    sym = F.when(F.col("pos") > 0, F.substring(F.col("text"), F.col("pos").cast("int"), F.lit(1))).otherwise(F.lit(DELIMITER)) if left else F.substring(F.col("text"), (F.col("pos") + F.length("pattern") + 1).cast("int"), F.lit(1))
    copies = F.col("n") if "n" in seqs.columns else F.lit(1).cast("long")
    return full.select("qid", sym.alias("sym"), copies.alias("n")).groupBy("qid", "sym").agg(F.sum("n").alias("count"))


def extensions(seqs: DataFrame, queries: DataFrame, left: bool) -> DataFrame:
    """qid, sym, count: extend() of all exact hits, which are found and counted once for equal patterns and, where short texts repeat, equal texts."""
    own = search.patterns(queries, 0)
    distinct = own.select("pid", "pattern", "m").distinct()
    texts = distinct_texts(seqs)[0]
    hits = search.hamming_hits(texts.select("seq_id", "text"), distinct, 0).withColumnRenamed("pid", "qid")
    each = extend(texts, hits, distinct.select(F.col("pid").alias("qid"), "pattern"), left)
    return search.to_queries(each.withColumnRenamed("qid", "pid"), own, own.count()).select("qid", "sym", "count")


def extend_by(seqs: DataFrame, hits: DataFrame, queries: DataFrame, symbols: str, left: bool) -> DataFrame:
    """The hits of symbols + pattern (left) or pattern + symbols: one step for one symbol, several for more."""
    full = hits.join(queries, "qid").join(seqs, "seq_id")
    n = len(symbols)
    start = F.col("pos") - n if left else F.col("pos") + F.length("pattern")
    kept = full.where((start >= 0) & (F.substring(F.col("text"), (start + 1).cast("int"), F.lit(n)) == symbols))
    return kept.select("qid", "seq_id", (F.col("pos") - (n if left else 0)).alias("pos"))


def reconstruct(sa: DataFrame) -> DataFrame:
    """seq_id, text from an index's positions and symbols."""
    one = sa.where(F.length("sym") > 0).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("s"))
    return one.select("seq_id", F.array_join(F.transform("s", lambda x: x["sym"]), "").alias("text"))


def kmer_groups(seqs: DataFrame, sa: DataFrame, size: int) -> DataFrame:
    """idx, kmer, is_start: whether a new k-mer starts at a suffix (suffixes shorter than size count with what they have)."""
    full = sa.join(seqs, "seq_id").select("idx", F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.lit(size)).alias("kmer"))
    first = full.groupBy("kmer").agg(F.min("idx").alias("first"))
    return full.join(first, "kmer").select("idx", "kmer", (F.col("idx") == F.col("first")).alias("is_start"))


def clipped(queries: DataFrame, size: int) -> DataFrame:
    """Patterns cut to their first k-mer: the cursor's run widens to the k-mer's."""
    return queries.withColumn("pattern", F.substring("pattern", 1, size))


def clipped_cursors(cursors: DataFrame, groups: DataFrame) -> DataFrame:
    """qid, lb, len: each run widened to whole k-mer groups, from its first row's group to its last row's; empty runs stay.

    groups: idx, kmer, is_start of kmer_groups().
    """
    runs = groups.groupBy("kmer").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    rows = groups.select("idx", "kmer").join(runs, "kmer")
    first, last = rows.select(F.col("idx").alias("_at"), "first"), rows.select(F.col("idx").alias("_to"), "last")
    wide = cursors.join(first, F.when(F.col("len") > 0, F.col("lb")) == F.col("_at"), "left").join(last, F.when(F.col("len") > 0, F.col("lb") + F.col("len") - 1) == F.col("_to"), "left")
    return wide.select("qid", F.coalesce("first", "lb").alias("lb"), F.coalesce(F.col("last") - F.col("first") + 1, "len").alias("len"))


def linear_index(records: DataFrame, length: int) -> DataFrame:
    """idx, seq_id, and a trie over records of one length: prefix, depth, lb, len of every distinct prefix.

    Records of another length raise.
    """
    same = records.withColumn("text", F.when(F.length("text") == length, F.col("text")).otherwise(F.raise_error(F.lit(f"records must have {length} symbols"))))
    ordered = numbered(same, "text", "seq_id")
    each = ordered.select("idx", F.explode(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda d: F.struct(d.alias("depth"), F.substring(F.col("text"), F.lit(1), d).alias("prefix")))).alias("t"))
    return each.select("t.depth", "t.prefix", "idx").groupBy("depth", "prefix").agg(F.min("idx").alias("lb"), F.count("*").alias("len"))


def symbol_counts(seqs: DataFrame) -> DataFrame:
    return positions(seqs).groupBy("sym").agg(F.count("*").alias("n"))
