"""The queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.functions import strings
from gramwell.operators import corpus, index, search
from gramwell.plans import schemes
from gramwell.sources import fasta


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sequences(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name")


def _part_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches over part: rows whose key is divisible by 100."""
    return corpus.queries(spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 100 = 0"), "p_partkey", "p_name")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sequences(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return corpus.queries(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sequences(spark.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", "s_name")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sequences(spark.read.parquet(f"{d}/nation.parquet"), "n_nationkey", "n_name")


def exact_occurrences(spark, d):
    return search.search_hamming(_docs(spark, d), _items(spark, d))


def exact_counts(spark, d):
    return exact_occurrences(spark, d).groupBy("qid").agg(F.count("*").alias("n_hits"), F.countDistinct("seq_id").alias("n_docs"))


def exact_found(spark, d):
    return search.found(_items(spark, d), exact_occurrences(spark, d)).select("qid")


def exact_not_found(spark, d):
    return search.not_found(_items(spark, d), exact_occurrences(spark, d)).select("qid")


def hamming_k1(spark, d):
    return search.search_hamming(_parts(spark, d), _part_queries(spark, d), 1)


def hamming_k2(spark, d):
    return search.search_hamming(_parts(spark, d), _part_queries(spark, d), 2)


def edit_k1(spark, d):
    return search.search_edit(_parts(spark, d), _part_queries(spark, d), 1)


def edit_k2(spark, d):
    return search.search_edit(_parts(spark, d), _part_queries(spark, d), 2)


def edit_k1_ms(spark, d):
    return search.search_edit(_parts(spark, d), _part_queries(spark, d), 1, "MS")


def edit_k1_msi(spark, d):
    return search.search_edit(_parts(spark, d), _part_queries(spark, d), 1, "MSI")


def search_first(spark, d):
    return search.search(_parts(spark, d), _part_queries(spark, d), 1, n=3)


def search_best(spark, d):
    return search.search(_parts(spark, d), _part_queries(spark, d), 2, best=True)


def search_best_first(spark, d):
    return search.search(_parts(spark, d), _part_queries(spark, d), 1, n=2, best=True)


def search_truncated(spark, d):
    own = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 100 = 0")
    return search.search_hamming(_parts(spark, d), corpus.queries(own, "p_partkey", "p_name", first=5, read_length=6), 0)


#: Vowels stand for each other.
VOWELS = {(a, b): 0 for a in "aeiou" for b in "aeiou" if a != b}
#: Vowels are ambiguous, all else mismatches.
AMBIGUOUS = {(a, b): 1 for a in "aeiou" for b in "aeiou" if a != b}


def matrix_k1(spark, d):
    return search.search_matrix(_parts(spark, d), _part_queries(spark, d), VOWELS, 1)


def matrix_ambiguous(spark, d):
    return search.search_matrix(_parts(spark, d), _part_queries(spark, d), AMBIGUOUS, 0, ambiguous=1)


def transcripts_k1(spark, d):
    return search.search_transcripts(_parts(spark, d), _part_queries(spark, d), 1)


def early_candidates(spark, d):
    return search.early_candidates(_parts(spark, d), _part_queries(spark, d), 1)


def kmer_rarest(spark, d):
    return search.search_kmers(_parts(spark, d), _part_queries(spark, d), 4)


def batch_join(spark, d):
    """All names against all names: both sides are tables, equal patterns are searched once."""
    own = corpus.queries(spark.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", "s_name")
    return search.search_hamming(_suppliers(spark, d), own, 1)


def symbol_counts(spark, d):
    return index.symbol_counts(_docs(spark, d))


def cumulative_counts(spark, d):
    return index.cumulative_counts(corpus.positions(_parts(spark, d)))


def suffix_array(spark, d):
    return index.suffix_array(_nations(spark, d))


def suffix_array_sampled(spark, d):
    return index.sampled(index.suffix_array(_nations(spark, d)), 3).select("idx", F.col("sample.seq_id").alias("seq_id"), F.col("sample.pos").alias("pos"))


def bwt(spark, d):
    return index.bwt(index.suffix_array(_nations(spark, d)))


def bwt_two_steps(spark, d):
    seqs = _nations(spark, d)
    return index.bwt_steps(seqs, index.suffix_array(seqs), 2)


def suffix_array_cyclic(spark, d):
    return index.suffix_array_cyclic(_nations(spark, d))


def suffix_array_reversed(spark, d):
    return index.suffix_array(index.reversed_texts(_nations(spark, d)))


def mirrored(spark, d):
    return index.mirrored(_parts(spark, d))


def reverse_located(spark, d):
    """Names found by their reversed patterns in reversed texts, at their places in the texts."""
    return index.search_reversed(_parts(spark, d), _part_queries(spark, d), 1)


def mirrored_hits(spark, d):
    """Hits of two short patterns in texts and in their reverses, each at its place in the text."""
    seqs, own = _parts(spark, d), spark.createDataFrame([(0, "re"), (1, "dn")], "qid long, pattern string")
    ahead = search.search_hamming(seqs, own).select("qid", "seq_id", "pos").withColumn("is_reverse", F.lit(False))
    back = index.mapped_back(search.search_hamming(index.reversed_texts(seqs), own), seqs, own)
    return ahead.unionByName(back.select("qid", "seq_id", "pos").withColumn("is_reverse", F.lit(True)))


def cursors_clipped(spark, d):
    seqs = _suppliers(spark, d)
    sa = index.suffix_array(seqs)
    asked = spark.createDataFrame([(0, "Supplier"), (1, "000"), (2, "x"), (3, "")], "qid long, pattern string")
    return index.clipped_cursors(index.cursors(sa, seqs, asked), index.kmer_groups(seqs, sa, 2))


def dual_ranks(spark, d):
    seqs = _suppliers(spark, d)
    sa = index.suffix_array(seqs)
    asked = spark.createDataFrame([(0, "Supp"), (1, "00"), (2, "x"), (3, "")], "qid long, pattern string")
    return index.dual_ranks(index.bwt(sa), index.cursors(sa, seqs, asked), ["0", "#", "r"])


def merged_index(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    regions = corpus.sequences(spark.read.parquet(f"{d}/region.parquet"), "r_regionkey", "r_name")
    return index.suffix_array(index.merge(corpus.sequences(nations, "n_nationkey", "n_name"), regions))


def rank_table(spark, d):
    return index.ranks(index.bwt(index.suffix_array(_nations(spark, d))), "N", 64)


def all_ranks(spark, d):
    return index.all_ranks(index.bwt(index.suffix_array(_nations(spark, d))), ["A", "N", "_"])


def cursors(spark, d):
    seqs = _suppliers(spark, d)
    asked = spark.createDataFrame([(0, "Supp"), (1, "0"), (2, "00"), (3, "x"), (4, "")], "qid long, pattern string")
    return index.cursors(index.suffix_array(seqs), seqs, asked)


def located(spark, d):
    seqs = _suppliers(spark, d)
    sa = index.suffix_array(seqs)
    asked = spark.createDataFrame([(0, "Supp"), (1, "00"), (2, "x")], "qid long, pattern string")
    return index.locate(sa, index.cursors(sa, seqs, asked))


def extend_left(spark, d):
    short = _part_queries(spark, d).withColumn("pattern", F.substring("pattern", 5, 2))
    return index.extensions(_parts(spark, d), short, True)


def extend_right(spark, d):
    short = _part_queries(spark, d).withColumn("pattern", F.substring("pattern", 1, 2))
    return index.extensions(_parts(spark, d), short, False)


def extend_two(spark, d):
    seqs = _parts(spark, d)
    own = spark.createDataFrame([(0, "bolt"), (1, "ring")], "qid long, pattern string")
    return index.extend_by(seqs, search.search_hamming(seqs, own), own, "d ", True)


def reconstructed(spark, d):
    return index.reconstruct(index.suffix_array(_parts(spark, d)))


def kmer_groups(spark, d):
    seqs = _nations(spark, d)
    return index.kmer_groups(seqs, index.suffix_array(seqs), 2)


def kmer_clipped(spark, d):
    return search.search_hamming(_parts(spark, d), index.clipped(_part_queries(spark, d), 3))


def linear_trie(spark, d):
    return index.linear_index(_suppliers(spark, d), 18)


def reverse_complement(spark, d):
    own = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("qid"), F.translate(F.upper("p_name"), "BDEHIORLMNPSUWXYZFJKQV ", "ACGTACGTACGTACGTACGTACG").alias("pattern"))
    return fasta.with_reverse_complements(own)


def alphabet(spark, d):
    return corpus.alphabet(_parts(spark, d), 30)


def delimiter_run(spark, d):
    return _docs(spark, d).select("seq_id", corpus.delimiter_run(F.col("text"), "e").cast("long").alias("longest"))


def bit_functions(spark, d):
    b = F.col("l_orderkey").cast("long") * 2654435761
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), b.alias("b"))
    a, c = F.col("b"), F.col("l_linenumber")
    return x.select("l_orderkey", "l_linenumber", strings.count_after_left_shift(a, 60).cast("long").alias("lefts"), strings.count_after_right_shift(a, 7).cast("long").alias("rights"), strings.count_outside(a, 9, True).cast("long").alias("outside"), strings.ternary(0b10010110, a, c, F.lit(5).cast("long")).alias("parity"), strings.ternary(0b11101000, a, c, F.lit(6).cast("long")).alias("majority"))


#: Parameters of the scheme table: each generator for 0 to 3 errors, alphabet 4.
SCHEME_ERRORS, SIGMA = (0, 1, 2, 3), 4


def _scheme_costs() -> list[tuple]:
    out = []
    for name in schemes.GENERATORS:
        for k in SCHEME_ERRORS:
            if made := schemes.GENERATORS[name][1](0, k, SIGMA, 10**9):
                out.append((name, k, len(made), schemes.is_valid(made), schemes.is_complete(made, 0, k), schemes.is_non_redundant(made, 0, k), float(schemes.node_count(schemes.expand(made, 20), SIGMA))))
    return out


def scheme_costs(spark, d):
    return spark.createDataFrame(_scheme_costs(), "name string, k int, searches int, valid boolean, complete boolean, non_redundant boolean, nodes double")


QUERIES = {f.__name__: f for f in (
    exact_occurrences, exact_counts, exact_found, exact_not_found, hamming_k1, hamming_k2, edit_k1, edit_k2, edit_k1_ms, edit_k1_msi, search_first, search_best, search_best_first, search_truncated,
    matrix_k1, matrix_ambiguous, transcripts_k1, early_candidates, kmer_rarest, batch_join, symbol_counts, cumulative_counts, suffix_array, suffix_array_sampled, bwt, bwt_two_steps, suffix_array_cyclic,
    suffix_array_reversed, mirrored, mirrored_hits, reverse_located, merged_index, rank_table, all_ranks, dual_ranks, cursors_clipped, cursors, located, extend_left, extend_right, extend_two, reconstructed, kmer_groups, kmer_clipped, linear_trie, reverse_complement,
    alphabet, delimiter_run, bit_functions, scheme_costs,
)}


# --- SQL

_EXACT = """
c AS (SELECT b.item_id AS qid, d.doc_id AS seq_id, b.text AS pat, d.text AS txt FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT qid, seq_id, i::BIGINT AS pos, 0 AS errors FROM (SELECT qid, seq_id, pat, txt, unnest(range(0, length(txt) - length(pat) + 1)) AS i FROM c) WHERE substring(txt, i + 1, length(pat)) = pat)"""
_NAMES = "s AS (SELECT p_partkey::BIGINT AS seq_id, p_name AS txt FROM part), q AS (SELECT p_partkey::BIGINT AS qid, p_name AS pat FROM part WHERE p_partkey % 100 = 0), dt AS (SELECT DISTINCT txt FROM s), dq AS (SELECT DISTINCT pat FROM q)"


def _hamming_sql(k: int, names: str = _NAMES) -> str:
    return f"""{names},
w AS (SELECT pat, txt, i, substring(txt, i + 1, length(pat)) AS x FROM (SELECT pat, txt, unnest(range(0, length(txt) - length(pat) + 1)) AS i FROM dq, dt WHERE length(txt) >= length(pat))),
v AS (SELECT pat, txt, i, hamming(x, pat)::INTEGER AS errors FROM w WHERE hamming(x, pat) <= {k}),
h AS (SELECT q.qid, s.seq_id, v.i::BIGINT AS pos, v.errors FROM v JOIN q USING (pat) JOIN s USING (txt))"""


def _edit_sql(k: int, ends: str) -> str:
    outs = ", ".join(f"({x}, {z})" for x in range(k + 1) for z in range(k + 1 - x)) if "I" in ends else "(0, 0)"
    if "S" in ends:
        cost = "CASE WHEN length(t) = 1 AND length(y) = 1 THEN (t <> y)::INTEGER WHEN length(t) = 1 OR length(y) = 1 THEN NULL ELSE (t[1] <> y[1])::INTEGER + (t[-1] <> y[-1])::INTEGER + levenshtein(substring(t, 2, length(t) - 2), substring(y, 2, length(y) - 2)) END"
        keep = "true"
    else:
        cost, keep = "levenshtein(t, y)", "t[1] = y[1] AND t[-1] = y[-1]"
    return f"""{_NAMES}, o(x, z) AS (VALUES {outs}),
y AS (SELECT pat, x + z AS out, substring(pat, x + 1, length(pat) - x - z) AS y FROM dq, o WHERE length(pat) > x + z),
p AS (SELECT txt, unnest(range(0, length(txt))) AS i FROM dt),
l AS (SELECT pat, out, y, txt, i, unnest(range(greatest(1, length(y) - {k}), length(y) + {k} + 1)) AS n FROM y, p),
t AS (SELECT pat, out, y, txt, i, substring(txt, i + 1, n) AS t FROM l WHERE i + n <= length(txt)),
v AS (SELECT pat, txt, i, min(out + {cost})::INTEGER AS errors FROM t WHERE {keep} GROUP BY pat, txt, i HAVING min(out + {cost}) <= {k}),
h AS (SELECT q.qid, s.seq_id, v.i::BIGINT AS pos, v.errors FROM v JOIN q USING (pat) JOIN s USING (txt))"""


def _with(body: str, select: str = "SELECT qid, seq_id, pos, errors FROM h") -> str:
    return f"WITH {body}\n{select}"


def _matrix_sql(costs: dict, k: int, ambiguous: int | None = None) -> str:
    values = ", ".join(f"('{a}', '{b}', {c})" for (a, b), c in sorted(costs.items()))
    other = 1 if ambiguous is None else 2
    total = f"sum(c)::INTEGER AS errors, 0 AS amb FROM e GROUP BY pat, txt, i HAVING sum(c) <= {k}" if ambiguous is None else f"count_if(c = 2)::INTEGER AS errors, count_if(c = 1) AS amb FROM e GROUP BY pat, txt, i HAVING count_if(c = 2) <= {k} AND count_if(c = 1) <= {ambiguous}"
    return f"""{_NAMES}, m(a, b, c) AS (VALUES {values}),
w AS (SELECT pat, txt, i, unnest(range(1, length(pat) + 1)) AS j FROM (SELECT pat, txt, unnest(range(0, length(txt) - length(pat) + 1)) AS i FROM dq, dt WHERE length(txt) >= length(pat))),
e AS (SELECT pat, txt, i, coalesce(m.c, CASE WHEN pat[j] = txt[i + j] THEN 0 ELSE {other} END) AS c FROM w LEFT JOIN m ON m.a = pat[j] AND m.b = txt[(i + j)::BIGINT]),
v AS (SELECT pat, txt, i, {total}),
h AS (SELECT q.qid, s.seq_id, v.i::BIGINT AS pos, v.errors FROM v JOIN q USING (pat) JOIN s USING (txt))"""


def _sa_sql(source: str, text: str = "txt") -> str:
    """All suffixes in order; a suffix reads on through the collection, chr(1) standing for the delimiter and chr(0) for the end."""
    return f"""s AS (SELECT seq_id, {text} AS txt FROM ({source})),
r AS (SELECT seq_id, txt, coalesce(string_agg(txt, chr(1)) OVER (ORDER BY seq_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) || chr(1), '') AS rest FROM s),
x AS (SELECT seq_id, txt, i, substring(txt, i + 1) || chr(1) || rest AS suffix FROM (SELECT seq_id, txt, rest, unnest(range(0, length(txt) + 1)) AS i FROM r)),
sa AS (SELECT row_number() OVER (ORDER BY suffix) - 1 AS idx, seq_id, i::BIGINT AS pos, CASE WHEN i < length(txt) THEN txt[i + 1] ELSE '' END AS sym, CASE WHEN i > 0 THEN txt[i] ELSE '' END AS prev, txt FROM x)"""


_NATION = "SELECT n_nationkey::BIGINT AS seq_id, n_name AS txt FROM nation"
_SUPPLIER = "SELECT s_suppkey::BIGINT AS seq_id, s_name AS txt FROM supplier"
_SUPPLIER_NAMES = "s AS (SELECT s_suppkey::BIGINT AS seq_id, s_name AS txt FROM supplier), q AS (SELECT s_suppkey::BIGINT AS qid, s_name AS pat FROM supplier), dt AS (SELECT DISTINCT txt FROM s), dq AS (SELECT DISTINCT pat FROM q)"
_ROW = "row_number() OVER (PARTITION BY qid ORDER BY errors, seq_id, pos)"
_SYMBOLS = "y AS (SELECT txt[i] AS sym FROM (SELECT txt, unnest(range(1, length(txt) + 1)) AS i FROM {}))"


def _ranks_sql(symbol: str) -> tuple[str, str]:
    before = "OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"coalesce(sum((prev = '{symbol}')::BIGINT) {before}, 0)::BIGINT", f"coalesce(sum((prev < '{symbol}')::BIGINT) {before}, 0)::BIGINT"


def _short_sql(start: int) -> str:
    return f"s AS (SELECT p_partkey::BIGINT AS seq_id, p_name AS txt FROM part), q AS (SELECT p_partkey::BIGINT AS qid, substring(p_name, {start}, 2) AS pat FROM part WHERE p_partkey % 100 = 0), h AS (SELECT qid, seq_id, pat, txt, i FROM (SELECT qid, seq_id, pat, txt, unnest(range(0, length(txt))) AS i FROM q, s) WHERE substring(txt, i + 1, 2) = pat AND length(pat) = 2)"


def oracle() -> dict[str, str]:
    ranks_n = _ranks_sql("N")
    three = [_ranks_sql(x) for x in ("A", "N", "_")]
    out = {
        "exact_occurrences": _with(_EXACT),
        "exact_counts": _with(_EXACT, "SELECT qid, count(*) AS n_hits, count(DISTINCT seq_id) AS n_docs FROM h GROUP BY qid"),
        "exact_found": "SELECT item_id AS qid FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
        "exact_not_found": "SELECT item_id AS qid FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
        "hamming_k1": _with(_hamming_sql(1)),
        "hamming_k2": _with(_hamming_sql(2)),
        "edit_k1": _with(_edit_sql(1, "MI")),
        "edit_k2": _with(_edit_sql(2, "MI")),
        "edit_k1_ms": _with(_edit_sql(1, "MS")),
        "edit_k1_msi": _with(_edit_sql(1, "MSI")),
        "search_first": _with(_edit_sql(1, "MI"), f"SELECT qid, seq_id, pos, errors FROM h QUALIFY {_ROW} <= 3"),
        "search_best": _with(_edit_sql(2, "MI"), "SELECT qid, seq_id, pos, errors FROM h QUALIFY rank() OVER (PARTITION BY qid ORDER BY errors) = 1"),
        "search_best_first": _with(_edit_sql(1, "MI"), f"SELECT qid, seq_id, pos, errors FROM (SELECT * FROM h QUALIFY rank() OVER (PARTITION BY qid ORDER BY errors) = 1) QUALIFY {_ROW} <= 2"),
        "search_truncated": "WITH q AS (SELECT p_partkey::BIGINT AS qid, substring(p_name, 1, 6) AS pat FROM part WHERE p_partkey % 100 = 0 ORDER BY p_partkey LIMIT 5) SELECT qid, p_partkey::BIGINT AS seq_id, i::BIGINT AS pos, 0 AS errors FROM (SELECT qid, pat, p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM q, part) WHERE substring(p_name, i + 1, length(pat)) = pat",
        "matrix_k1": _with(_matrix_sql(VOWELS, 1)),
        "matrix_ambiguous": _with(_matrix_sql(AMBIGUOUS, 0, 1)),
        "early_candidates": _with(f"""{_NAMES}, z AS (SELECT pat, unnest([0, 1]) AS part, (length(pat) + 1) // 2 AS a FROM dq),
g AS (SELECT pat, CASE WHEN part = 0 THEN 0 ELSE a END AS start, length(pat) // 2 AS d FROM z),
kq AS (SELECT pat, start, CASE WHEN d >= 47 THEN 16 WHEN d >= 23 THEN 16 WHEN d >= 11 THEN 8 WHEN d >= 5 THEN 4 WHEN d >= 3 THEN 3 WHEN d >= 2 THEN 2 ELSE 1 END AS qn, CASE WHEN d >= 47 THEN 32 WHEN d >= 23 THEN 8 WHEN d >= 11 THEN 4 WHEN d >= 5 THEN 2 ELSE 1 END AS step FROM g),
sd AS (SELECT pat, qn, step, start + sh AS place FROM (SELECT pat, start, qn, step, unnest(range(0, step)) AS sh FROM kq)),
hit AS (SELECT DISTINCT pat, txt, i - place AS p FROM (SELECT pat, txt, qn, step, place, unnest(range(0, length(txt), step)) AS i FROM sd, dt) WHERE substring(txt, i + 1, qn) = substring(pat, place + 1, qn) AND i + qn <= length(txt) AND i - place >= 0)""", "SELECT qid, seq_id, p::BIGINT AS pos FROM hit JOIN q USING (pat) JOIN s USING (txt)"),
        "kmer_rarest": _with(f"""{_NAMES}, t AS (SELECT seq_id, i::BIGINT AS pos, substring(txt, i + 1, 4) AS kmer FROM (SELECT seq_id, txt, unnest(range(0, length(txt) - 3)) AS i FROM s)),
n AS (SELECT kmer, count(*) AS n FROM t GROUP BY kmer), a AS (SELECT DISTINCT qid, substring(pat, i + 1, 4) AS kmer FROM (SELECT qid, pat, unnest(range(0, length(pat) - 3)) AS i FROM q)),
e AS (SELECT qid, a.kmer, coalesce(n, 0) AS n FROM a LEFT JOIN n USING (kmer)), r AS (SELECT qid, kmer FROM (SELECT *, min(n) OVER (PARTITION BY qid) AS least FROM e) WHERE least > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n, kmer) = 1)""", "SELECT qid, kmer, seq_id, pos FROM r JOIN t USING (kmer)"),
        "batch_join": _with(_hamming_sql(1, _SUPPLIER_NAMES)),
        "symbol_counts": "SELECT sym, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS sym FROM documents) WHERE sym <> '' GROUP BY sym",
        "cumulative_counts": _with("s AS (SELECT p_name AS txt FROM part), " + _SYMBOLS.format("s") + ", g AS (SELECT sym, count(*) AS n FROM y GROUP BY sym)", "SELECT sym, n, coalesce(sum(n) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM g"),
        "suffix_array": _with(_sa_sql(_NATION), "SELECT idx, seq_id, pos, sym, prev FROM sa"),
        "suffix_array_sampled": _with(_sa_sql(_NATION), "SELECT idx, CASE WHEN pos % 3 = 0 THEN seq_id END AS seq_id, CASE WHEN pos % 3 = 0 THEN pos END AS pos FROM sa"),
        "bwt": _with(_sa_sql(_NATION), "SELECT idx, prev AS sym FROM sa"),
        "bwt_two_steps": _with(_sa_sql(_NATION), "SELECT idx, prev || CASE WHEN pos > 1 THEN txt[pos - 1] ELSE '' END AS prev_k FROM sa"),
        "suffix_array_cyclic": f"WITH s AS ({_NATION}), x AS (SELECT seq_id, txt, i, substring(txt || txt, i + 1, length(txt)) AS rot FROM (SELECT seq_id, txt, unnest(range(0, length(txt))) AS i FROM s)) SELECT row_number() OVER (ORDER BY rot, seq_id, i) - 1 AS idx, seq_id, i::BIGINT AS pos, rot[1] AS sym, rot[-1] AS prev FROM x",
        "suffix_array_reversed": _with(_sa_sql(_NATION, "reverse(txt)"), "SELECT idx, seq_id, pos, sym, prev FROM sa"),
        "mirrored": "SELECT p_partkey::BIGINT AS seq_id, p_name AS text, false AS is_reverse FROM part UNION ALL SELECT p_partkey, reverse(p_name), true FROM part",
        "mirrored_hits": "SELECT qid::BIGINT AS qid, p_partkey::BIGINT AS seq_id, i::BIGINT AS pos, is_reverse FROM (SELECT *, unnest(range(0, length(p_name))) AS i FROM part, (VALUES (0, 're', false), (1, 'dn', false), (0, 'er', true), (1, 'nd', true)) AS a(qid, pat, is_reverse)) WHERE substring(p_name, i + 1, 2) = pat",
        "reverse_located": _with(_hamming_sql(1)),
        "cursors_clipped": _with(_sa_sql(_SUPPLIER) + ", a(qid, pat) AS (VALUES (0, 'Supplier'), (1, '000'), (2, 'x'), (3, '')), k AS (SELECT idx, pos, txt, substring(txt, pos + 1, 2) AS kmer FROM sa), g AS (SELECT kmer, min(idx) AS first, max(idx) AS last FROM k GROUP BY kmer)", "SELECT qid::BIGINT AS qid, min(first) AS lb, coalesce(max(last) - min(first) + 1, 0)::BIGINT AS len FROM a LEFT JOIN (k JOIN g USING (kmer)) ON substring(txt, pos + 1, length(pat)) = pat GROUP BY qid"),
        "dual_ranks": _with(_sa_sql(_SUPPLIER) + ", a(qid, pat) AS (VALUES (0, 'Supp'), (1, '00'), (2, 'x'), (3, '')), c AS (SELECT qid, min(idx) AS lo, max(idx) AS hi FROM a JOIN sa ON substring(txt, pos + 1, length(pat)) = pat GROUP BY qid)", "SELECT qid::BIGINT AS qid, [count_if(prev = '0' AND idx < lo), count_if(prev = '#' AND idx < lo), count_if(prev = 'r' AND idx < lo)]::BIGINT[] AS lo, [count_if(prev = '0' AND idx <= hi), count_if(prev = '#' AND idx <= hi), count_if(prev = 'r' AND idx <= hi)]::BIGINT[] AS hi FROM c, sa GROUP BY qid"),
        "merged_index": _with(_sa_sql(_NATION + " UNION ALL SELECT r_regionkey + 1 + (SELECT max(n_nationkey) FROM nation), r_name FROM region"), "SELECT idx, seq_id, pos, sym, prev FROM sa"),
        "rank_table": _with(_sa_sql(_NATION), f"SELECT idx, {ranks_n[0]} AS rank, {ranks_n[1]} AS prefix_rank FROM sa"),
        "all_ranks": _with(_sa_sql(_NATION), f"SELECT idx, [{', '.join(r[0] for r in three)}] AS ranks, [{', '.join(r[1] for r in three)}] AS prefix_ranks FROM sa"),
        "cursors": _with(_sa_sql(_SUPPLIER) + ", a(qid, pat) AS (VALUES (0, 'Supp'), (1, '0'), (2, '00'), (3, 'x'), (4, ''))", "SELECT qid::BIGINT AS qid, min(idx) AS lb, count(idx) AS len FROM a LEFT JOIN sa ON substring(txt, pos + 1, length(pat)) = pat GROUP BY qid"),
        "located": _with(_sa_sql(_SUPPLIER) + ", a(qid, pat) AS (VALUES (0, 'Supp'), (1, '00'), (2, 'x'))", "SELECT qid::BIGINT AS qid, seq_id, pos FROM a JOIN sa ON substring(txt, pos + 1, length(pat)) = pat"),
        "extend_left": _with(_short_sql(5), "SELECT qid, CASE WHEN i > 0 THEN txt[i] ELSE '' END AS sym, count(*) AS count FROM h GROUP BY ALL"),
        "extend_right": _with(_short_sql(1), "SELECT qid, substring(txt, i + 3, 1) AS sym, count(*) AS count FROM h GROUP BY ALL"),
        "extend_two": "SELECT qid::BIGINT AS qid, p_partkey::BIGINT AS seq_id, i::BIGINT AS pos FROM (SELECT qid, pat, p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM part, (VALUES (0, 'd bolt'), (1, 'd ring')) AS a(qid, pat)) WHERE substring(p_name, i + 1, 6) = pat",
        "reconstructed": "SELECT p_partkey::BIGINT AS seq_id, p_name AS text FROM part",
        "kmer_groups": _with(_sa_sql(_NATION), "SELECT idx, substring(txt, pos + 1, 2) AS kmer, idx = min(idx) OVER (PARTITION BY substring(txt, pos + 1, 2)) AS is_start FROM sa"),
        "kmer_clipped": "WITH q AS (SELECT p_partkey::BIGINT AS qid, substring(p_name, 1, 3) AS pat FROM part WHERE p_partkey % 100 = 0) SELECT qid, p_partkey::BIGINT AS seq_id, i::BIGINT AS pos, 0 AS errors FROM (SELECT qid, pat, p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM q, part) WHERE substring(p_name, i + 1, 3) = pat",
        "linear_trie": f"WITH s AS ({_SUPPLIER}), o AS (SELECT row_number() OVER (ORDER BY txt, seq_id) - 1 AS idx, txt FROM s) SELECT d::INTEGER AS depth, substring(txt, 1, d) AS prefix, min(idx) AS lb, count(*) AS len FROM (SELECT idx, txt, unnest(range(1, 19)) AS d FROM o) GROUP BY ALL",
        "reverse_complement": "WITH q AS (SELECT p_partkey::BIGINT AS qid, translate(upper(p_name), 'BDEHIORLMNPSUWXYZFJKQV ', 'ACGTACGTACGTACGTACGTACG') AS pattern FROM part) SELECT qid * 2 AS qid, pattern, false AS is_reverse FROM q UNION ALL SELECT qid * 2 + 1, translate(reverse(pattern), 'ACGTacgt', 'TGCAtgca'), true FROM q",
        "alphabet": "SELECT sym AS symbol, (row_number() OVER (ORDER BY sym))::INTEGER AS rank FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS sym FROM part) WHERE sym <> ''",
        "delimiter_run": "SELECT doc_id::BIGINT AS seq_id, coalesce(list_max(list_transform(regexp_extract_all(text, 'e+'), lambda x: length(x))), 0)::BIGINT AS longest FROM documents",
        "bit_functions": """WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey::BIGINT * 2654435761 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, bit_count(b & 15)::BIGINT AS lefts, bit_count(b >> 7)::BIGINT AS rights, bit_count(b >> 9)::BIGINT AS outside, xor(xor(b, l_linenumber), 5::BIGINT) AS parity, ((b & l_linenumber) | (b & 6) | (l_linenumber & 6)) AS majority FROM x""",
        "scheme_costs": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {c}, {v}, {m}, {r}, {x!r}::DOUBLE)" for n, k, c, v, m, r, x in _scheme_costs()) + ") AS t(name, k, searches, valid, complete, non_redundant, nodes)",
    }
    return out
