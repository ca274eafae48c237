"""Approximate search as a join: hits(qid, seq_id, pos, errors) of patterns in texts.

A pattern with at most k errors has k + 1 parts of which one is exact. So each part gives seeds, texts
give grams at every step-th position, and an equi-join on the gram yields candidate places; a part of
length q + step - 1 always holds a gram at such a position. Only a candidate's chunk is then compared.
The side of the seeds is counted and broadcast where it is small, so that texts are read once and compared
where they are read; a larger one is joined by shuffles.

Equal patterns are searched once, and so are equal texts where short ones repeat: hits of distinct patterns in
distinct texts are given to the texts' members and at the very end, by a broadcast of the queries, to the patterns'
qids, so that the product of members and qids is made in place and never moved. A hit is reported once per (qid, seq_id, pos), with its least number
of errors. Families: hamming; edit with the ends that alignments may have: "MI" (default: the matched
interval starts and ends on matched symbols, pattern symbols may be left out before and after), "MS"
(matched or substituted), "MSI" (all of these).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramwell.operators.corpus import BROADCAST_BYTES, ROW_BYTES, STRIDE, chunks, distinct_texts, given_back

#: Gram length and step of seeds by the least part length that allows them.
SEEDS = ((47, 16, 32), (23, 16, 8), (11, 8, 4), (5, 4, 2), (3, 3, 1), (2, 2, 1), (1, 1, 1))
ENDS = ("MI", "MS", "MSI")


def hamming(a: Column, b: Column) -> Column:
    """Unequal symbols of two texts of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def patterns(queries: DataFrame, k: int) -> DataFrame:
    """qid, pid, pattern, m: pid is a pattern's hash. Empty patterns give no hit; those of at most k symbols raise."""
    own = queries.where(F.length("pattern") > 0).select("qid", "pattern", F.xxhash64("pattern").alias("pid"), F.length("pattern").alias("m"))
    return own.withColumn("m", F.when(F.col("m") <= k, F.raise_error(F.lit(f"a pattern of at most {k} symbols matches everywhere with {k} errors"))).otherwise(F.col("m"))) if k else own


def seeds(distinct: DataFrame, k: int) -> DataFrame:
    """pid, m, pattern, q, step, gram, at (place of the gram in the pattern)."""
    n = k + 1
    part = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("part")
    d, r = F.floor(F.col("m") / n).cast("int"), (F.col("m") % n).cast("int")
    cut = distinct.select("pid", "pattern", "m", part).withColumns({"length": d + (F.col("part") < r).cast("int"), "start": F.col("part") * d + F.least(F.col("part"), r)})
    # the least part decides, so that all seeds of a pattern are of one kind
    kind = reduce(lambda acc, s: F.when(d >= s[0], F.struct(F.lit(s[1]).alias("q"), F.lit(s[2]).alias("step"))).otherwise(acc), reversed(SEEDS), F.lit(None).cast("struct<q:int,step:int>"))
    cut = cut.withColumn("kind", kind).select("pid", "pattern", "m", "start", "kind.q", "kind.step", F.explode(F.sequence(F.lit(0), F.col("kind.step") - 1)).alias("shift"))
    return cut.withColumn("at", F.col("start") + F.col("shift")).withColumn("gram", F.substring(F.col("pattern"), F.col("at") + 1, F.col("q"))).select("pid", "m", "q", "step", "gram", "at")


def grams(pieces: DataFrame, kinds: list[tuple[int, int]], of: Column | None = None) -> DataFrame:
    """seq_id, off, chunk, q, step, gram, i: the grams of each kind at every step-th place of each chunk (or of `of`, a view of it)."""
    of = F.col("chunk") if of is None else of

    def of_kind(q: int, step: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.length("chunk") - q, F.lit(step)), lambda i: F.struct(F.lit(q).alias("q"), F.lit(step).alias("step"), i.alias("i"), F.substring(F.col("_view"), i + 1, F.lit(q)).alias("gram")))
        return F.when(F.length("chunk") >= q, cut).otherwise(F.array().cast("array<struct<q:int,step:int,i:int,gram:string>>"))

    each = [of_kind(q, step) for q, step in kinds]
    return pieces.withColumn("_view", of).select("seq_id", "off", "chunk", F.explode(F.concat(*each)).alias("g")).select("seq_id", "off", "chunk", "g.q", "g.step", "g.i", "g.gram")


#: A seed's size; seeds and patterns are broadcast up to BROADCAST_BYTES, estimated from their counted rows and lengths; more are joined by shuffles.
SEED_BYTES = 96


def candidates(seqs: DataFrame, distinct: DataFrame, parts: DataFrame, low: int, slack: int, overlap: int, stride: int = STRIDE, of: Column | None = None) -> DataFrame:
    """Places where an exact part stands, with what is to be compared: pid, seq_id, off, p, chunk, pattern, m. A place may come up several times.

    p lies from `low` to stride + slack. Seeds and patterns are broadcast, so that a chunk's grams are looked up and
    its places compared where the text is read, and only hits move. Beyond BROADCAST_BYTES grams and seeds
    meet by a shuffle, and places their chunk by another.

    Chunks are as long as the longest pattern at least, so that they hold each symbol twice at most.
    """
    size = distinct.agg(F.max("m").alias("longest"), F.sum(F.col("m") + SEED_BYTES).alias("bytes")).first()
    stride = max(stride, size["longest"] or 1)
    counted = parts.groupBy("q", "step").count().collect()  # one row a kind of SEEDS at most
    kinds = [(r["q"], r["step"]) for r in counted] or [(1, 1)]
    small = sum(r["count"] for r in counted) * SEED_BYTES + (size["bytes"] or 0) <= BROADCAST_BYTES
    pieces = chunks(seqs, (size["longest"] or 1) + overlap, stride)
    side = F.broadcast if small else (lambda df: df)
    cut = grams(pieces, kinds, of)
    found = (cut if small else cut.drop("chunk")).join(side(parts.select("pid", "q", "step", "gram", "at")), ["q", "step", "gram"])
    inside = (F.col("p") >= low) & (F.col("p") < stride + slack)
    if small:
        places = found.select("pid", "seq_id", "off", (F.col("i") - F.col("at")).alias("p"), "chunk").where(inside)
    else:
        places = found.select("pid", "seq_id", "off", (F.col("i") - F.col("at")).alias("p")).where(inside).distinct().join(pieces, ["seq_id", "off"])
    return places.join(side(distinct.select("pid", "pattern", "m")), "pid").withColumn("stride", F.lit(stride))


def to_queries(found: DataFrame, own: DataFrame, rows: int, key: str = "pid") -> DataFrame:
    """Rows of patterns, for every query of them: own(qid, `key`) of so many rows, broadcast up to BROADCAST_BYTES, joined by a shuffle beyond."""
    own = own.select("qid", key)
    return found.join(F.broadcast(own) if rows * ROW_BYTES <= BROADCAST_BYTES else own, key).drop(key)


def once(seqs: DataFrame, queries: DataFrame, k: int, find: Callable[[DataFrame, DataFrame], DataFrame], first: int | None = None) -> DataFrame:
    """qid, seq_id, pos and more: what `find` gives for distinct texts(seq_id, text) and distinct patterns(pid, pattern, m), by pid, for all that are equal to them.

    One row per (qid, seq_id, pos): the least by what follows pos. first: that many of each query.
    """
    own = patterns(queries, k)
    distinct = own.select("pid", "pattern", "m").distinct()
    texts, members, most = distinct_texts(seqs)
    found = find(texts.select("seq_id", "text"), distinct)
    more = [c for c in found.columns if c not in ("pid", "seq_id", "pos")]
    if members is not None:
        found = _least(given_back(found, members, most * distinct.count()), more)
    if first is not None:
        found = first_hits(found, first, "pid")
    elif members is not None:
        # rows of one pattern get the same qids: side by side they are written small. The optimizer takes
        # a sort below a join away, but not one below a filter by partition number, which drops nothing
        found = found.sortWithinPartitions("pid").where(F.spark_partition_id() >= 0)
    return to_queries(found, own, own.count()).select("qid", "seq_id", "pos", *more)


def _least(hits: DataFrame, more: list[str]) -> DataFrame:
    each = hits.groupBy("pid", "seq_id", "pos")
    if len(more) < 2:
        return each.agg(*[F.min(c).alias(c) for c in more]) if more else hits.select("pid", "seq_id", "pos").distinct()
    return each.agg(F.min(F.struct(*more)).alias("_l")).select("pid", "seq_id", "pos", "_l.*")


def search_hamming(seqs: DataFrame, queries: DataFrame, k: int = 0, stride: int = STRIDE) -> DataFrame:
    """Windows of the pattern's length with at most k unequal symbols; k = 0 is exact search."""
    return once(seqs, queries, k, lambda texts, distinct: hamming_hits(texts, distinct, k, stride))


def hamming_hits(seqs: DataFrame, distinct: DataFrame, k: int, stride: int = STRIDE) -> DataFrame:
    """pid, seq_id, pos, errors of search_hamming."""
    full = candidates(seqs, distinct, seeds(distinct, k), 0, 0, k, stride)
    window = F.substring(F.col("chunk"), F.col("p") + 1, F.col("m"))
    full = full.withColumn("w", window).where(F.length("w") == F.col("m"))
    full = full.withColumn("errors", F.when(F.col("w") == F.col("pattern"), F.lit(0)).otherwise(hamming(F.col("w"), F.col("pattern"))) if k else F.when(F.col("w") == F.col("pattern"), F.lit(0)))
    return _least(full.where(F.col("errors") <= k).select("pid", "seq_id", (F.col("off") + F.col("p")).alias("pos"), "errors"), ["errors"])


def search_edit(seqs: DataFrame, queries: DataFrame, k: int, ends: str = "MI", stride: int = STRIDE) -> DataFrame:
    """Starts of text intervals that align to the pattern with at most k edits and with the given ends."""
    if ends not in ENDS:
        raise ValueError(f"ends must be one of {ENDS}")
    return once(seqs, queries, k, lambda texts, distinct: edit_hits(texts, distinct, k, ends, stride))


def edit_hits(seqs: DataFrame, distinct: DataFrame, k: int, ends: str = "MI", stride: int = STRIDE) -> DataFrame:
    """pid, seq_id, pos, errors of search_edit."""
    if k == 0:
        return hamming_hits(seqs, distinct, 0, stride)
    places = candidates(seqs, distinct, seeds(distinct, k), -k, k, k, stride)
    full = places.withColumn("p", F.explode(F.sequence(F.col("p") - k, F.col("p") + k))).where((F.col("p") >= 0) & (F.col("p") < F.col("stride")))
    # left out before and after: x and z symbols of the pattern
    outs = [(x, z) for x in range(k + 1) for z in range(k + 1 - x)] if "I" in ends else [(0, 0)]
    out = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in outs])).alias("xz")
    full = full.select("pid", "seq_id", "off", "p", "m", "pattern", F.substring(F.col("chunk"), F.col("p") + 1, F.col("m") + k).alias("w"), out)
    full = full.withColumn("y", F.substring(F.col("pattern"), F.col("xz.x") + 1, F.col("m") - F.col("xz.x") - F.col("xz.z"))).where(F.length("y") > 0)
    if "S" not in ends:
        full = full.where(F.substring("w", 1, 1) == F.substring("y", 1, 1))
    left = k - F.col("xz.x") - F.col("xz.z")
    full = full.select("pid", "seq_id", "off", "p", "w", "y", (F.col("xz.x") + F.col("xz.z")).alias("out"), left.alias("left"), F.explode(F.sequence(F.greatest(F.length("y") - left, F.lit(1)), F.length("y") + left)).alias("size")).where(F.col("size") <= F.length("w"))
    t = F.substring(F.col("w"), F.lit(1), F.col("size"))
    full = full.withColumn("t", t)
    tail = lambda c: F.substring(c, -1, 1)
    if "S" not in ends:
        full = full.where(tail(F.col("t")) == tail(F.col("y")))
        cost = F.levenshtein("t", "y", k)  # -1 beyond k
    else:
        # both ends are aligned to each other; what is between is free
        one = (F.length("t") == 1) | (F.length("y") == 1)
        inner = lambda c: F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
        apart = lambda a, b: (a != b).cast("int")
        single = F.when((F.length("t") == 1) & (F.length("y") == 1), apart(F.col("t"), F.col("y")))
        both = apart(F.substring("t", 1, 1), F.substring("y", 1, 1)) + apart(tail(F.col("t")), tail(F.col("y"))) + F.col("inner")
        full = full.withColumn("inner", F.levenshtein(inner(F.col("t")), inner(F.col("y")), k))
        cost = F.when(one, single).when(F.col("inner") >= 0, both).otherwise(F.lit(-1))
    full = full.withColumn("cost", cost).where(F.col("cost") >= 0).withColumn("errors", F.col("cost") + F.col("out")).where(F.col("errors") <= k)
    return _least(full.select("pid", "seq_id", (F.col("off") + F.col("p")).alias("pos"), "errors"), ["errors"])


def search(seqs: DataFrame, queries: DataFrame, errors: int = 0, edit: bool = True, n: int | None = None, best: bool = False, ends: str = "MI") -> DataFrame:
    """All hits, or each query's best ones, or n of each query: those of fewest errors, then smallest seq_id, pos."""
    if edit and errors and ends not in ENDS:
        raise ValueError(f"ends must be one of {ENDS}")

    def find(texts: DataFrame, distinct: DataFrame) -> DataFrame:
        hits = edit_hits(texts, distinct, errors, ends) if edit else hamming_hits(texts, distinct, errors)
        return best_hits(hits, "pid") if best else hits

    return once(seqs, queries, errors, find, n)


def early_candidates(seqs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, seq_id, pos of every place where a part of the pattern is exact: a superset of the hits' neighbourhoods, not compared."""

    def find(texts: DataFrame, distinct: DataFrame) -> DataFrame:
        return candidates(texts, distinct, seeds(distinct, k), 0, 0, k).select("pid", "seq_id", (F.col("off") + F.col("p")).alias("pos")).distinct()

    return once(seqs, queries, k, find)


# --- limits


def first_hits(hits: DataFrame, n: int, by: str = "qid") -> DataFrame:
    w = Window.partitionBy(by).orderBy("errors", "seq_id", "pos")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def best_hits(hits: DataFrame, by: str = "qid") -> DataFrame:
    """The hits of each query's least number of errors."""
    least = hits.groupBy(by).agg(F.min("errors").alias("errors"))
    return hits.join(least, [by, "errors"]).select(by, "seq_id", "pos", "errors")


def found(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits, "qid", "left_semi")


def not_found(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits, "qid", "left_anti")


# --- scoring matrices


def symbol_classes(alike: dict[str, list[str]]) -> dict[str, str] | None:
    """Symbol: the least of its class, for symbols that are of cost 0 with exactly the members of one class; None if they form no classes."""
    own = {a: {a, *bs} for a, bs in alike.items()}
    if all(own.get(b, {b}) == members for members in own.values() for b in members):
        return {a: min(members) for a, members in sorted(own.items()) if len(a) == 1}
    return None


def search_matrix(seqs: DataFrame, queries: DataFrame, costs: dict[tuple[str, str], int], k: int, ambiguous: int | None = None, stride: int = STRIDE) -> DataFrame:
    """Windows of the pattern's length under a cost a symbol pair: (pattern symbol, text symbol) -> cost.

    Pairs that aren't listed cost 1, equal symbols 0. With `ambiguous`, a pair of cost 1 is ambiguous and
    one of cost 2 (or not listed) a mismatch: at most `ambiguous` of the first and k of the second.
    errors: the cost, or the number of mismatches.
    """
    return once(seqs, queries, k, lambda texts, distinct: matrix_hits(texts, distinct, costs, k, ambiguous, stride))


def matrix_hits(seqs: DataFrame, distinct: DataFrame, costs: dict[tuple[str, str], int], k: int, ambiguous: int | None = None, stride: int = STRIDE) -> DataFrame:
    """pid, seq_id, pos, errors of search_matrix."""
    pair = ambiguous is not None
    spend = k + (ambiguous if pair else 0)
    alike: dict[str, list[str]] = {}
    for (a, b), c in sorted(costs.items()):
        if c == 0:
            alike.setdefault(a, []).append(b)
    parts = seeds(distinct, spend)
    classes = symbol_classes(alike)
    if classes is not None:
        # a part without cost may still differ from the text: both are compared by their symbols' classes
        shape = lambda c: F.translate(c, "".join(classes), "".join(classes.values())) if classes else c
        parts, view = parts.withColumn("gram", shape(F.col("gram"))), shape(F.col("chunk"))
    else:
        free = F.create_map(*[x for a, bs in sorted(alike.items()) for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
        symbols = F.filter(F.split("gram", ""), lambda c: c != "")
        # without classes each gram stands for all grams of cost 0
        choices = lambda c: F.array_union(F.array(c), F.coalesce(F.try_element_at(free, c), F.array().cast("array<string>")))
        grown = F.aggregate(symbols, F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(choices(c), lambda x: F.concat(a, x)))))
        parts, view = parts.withColumn("gram", F.explode(grown)), None
    full = candidates(seqs, distinct, parts, 0, 0, 0, stride, view)
    full = full.withColumn("w", F.substring(F.col("chunk"), F.col("p") + 1, F.col("m"))).where(F.length("w") == F.col("m"))
    listed = F.create_map(*[x for (a, b), c in sorted(costs.items()) for x in (F.lit(a + b), F.lit(c))]) if costs else None
    other = 2 if pair else 1
    cost = lambda a, b: F.coalesce(*([F.try_element_at(listed, F.concat(a, b))] if listed is not None else []), F.when(a == b, F.lit(0)).otherwise(F.lit(other)))
    pairs = F.zip_with(F.filter(F.split("pattern", ""), lambda c: c != ""), F.filter(F.split("w", ""), lambda c: c != ""), cost)
    full = full.withColumn("c", pairs)
    count = lambda v: F.size(F.filter("c", lambda x: x == v))
    if pair:
        full = full.withColumn("errors", count(2)).where((F.col("errors") <= k) & (count(1) <= ambiguous))
    else:
        full = full.withColumn("errors", F.aggregate("c", F.lit(0), lambda s, v: s + v)).where(F.col("errors") <= k)
    return _least(full.select("pid", "seq_id", (F.col("off") + F.col("p")).alias("pos"), "errors"), ["errors"])


# --- k-mer filter


def search_kmers(seqs: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """qid, kmer, seq_id, pos of the rarest k-mer of each query all of whose k-mers occur (ties: first in byte order)."""
    kmer = lambda c: F.explode(F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(0), F.length(c) - size), lambda i: F.struct(i.alias("i"), F.substring(c, i + 1, F.lit(size)).alias("kmer")))))
    own = queries.where("pattern is not null").select("qid", F.xxhash64("pattern").alias("pid"), "pattern")
    texts, members, most = distinct_texts(seqs)
    pieces = chunks(texts, size - 1, keep=("n",))
    text = pieces.select("seq_id", "n", "off", kmer(F.col("chunk")).alias("g")).where(F.col("g.i") < STRIDE).select("seq_id", "n", (F.col("off") + F.col("g.i")).alias("pos"), F.col("g.kmer").alias("kmer"))
    asked = own.select("pid", "pattern").distinct().select("pid", kmer(F.col("pattern")).alias("g")).select("pid", F.col("g.kmer").alias("kmer")).distinct()
    # a few rows a pattern: texts are read where they are, so that no common k-mer fills one task
    side = F.broadcast if asked.count() * SEED_BYTES <= BROADCAST_BYTES else (lambda df: df)
    counted = text.join(side(asked.select("kmer").distinct()), "kmer", "left_semi").groupBy("kmer").agg(F.sum("n").alias("count"))
    each = asked.join(counted, "kmer", "left")
    rarest = each.groupBy("pid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "kmer")).alias("r")).where("r.n > 0").select("pid", F.col("r.kmer").alias("kmer"))
    found = text.join(side(rarest.select("kmer").distinct()), "kmer").select("kmer", "seq_id", "pos")
    full = given_back(found, members, most).withColumn("_kmer", F.col("kmer"))
    return to_queries(full, own.join(rarest, "pid"), own.count(), "kmer").select("qid", F.col("_kmer").alias("kmer"), "seq_id", "pos")


# --- transcripts


def transcript(pattern: str, text: str, k: int) -> str | None:
    """The M, S, I, D steps of a cheapest alignment of all of both, at most k edits; M or S before I before D from the end."""
    m, n = len(pattern), len(text)
    big = k + 1
    d = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if abs(i - j) > k:
                d[i][j] = big
            elif not i or not j:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    if d[m][n] > k:
        return None
    steps, i, j = [], m, n
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]):
            steps.append("M" if pattern[i - 1] == text[j - 1] else "S")
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            steps.append("I")
            i -= 1
        else:
            steps.append("D")
            j -= 1
    return "".join(reversed(steps))


def with_transcripts(hits: DataFrame, seqs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hits of search_edit(..., ends="MS") with the transcript of a cheapest interval (then the shortest) at each place."""

    @F.pandas_udf("string")
    def steps(pattern: pd.Series, text: pd.Series, errors: pd.Series) -> pd.Series:
        def one(p: str, t: str, e: int) -> str | None:
            found = (transcript(p, t[:n], e) for n in range(max(1, len(p) - e), min(len(t), len(p) + e) + 1))
            return next((s for s in found if s and s.count("M") == len(s) - e and s[0] in "MS" and s[-1] in "MS"), None)

        return pd.Series([one(p, t, e) for p, t, e in zip(pattern, text, errors, strict=True)])

    full = hits.join(queries, "qid").join(seqs, "seq_id")
    window = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.length("pattern") + k)
    return full.select("qid", "seq_id", "pos", "errors", steps("pattern", window, "errors").alias("transcript"))


def search_transcripts(seqs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search_edit(..., ends="MS") with transcripts, aligned once for equal patterns and texts."""

    def find(texts: DataFrame, distinct: DataFrame) -> DataFrame:
        hits = edit_hits(texts, distinct, k, "MS").withColumnRenamed("pid", "qid")
        return with_transcripts(hits, texts, distinct.select(F.col("pid").alias("qid"), "pattern"), k).withColumnRenamed("qid", "pid")

    return once(seqs, queries, k, find)
