import random

import pytest
from gramwell.operators import corpus, index, search

TEXTS = [(0, "AAACAAABAAA"), (1, "AAABAAACAAA")]


def seqs_of(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, text string")


def queries_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, pattern string")


def places(df):
    return sorted((r["qid"], r["seq_id"], r["pos"]) for r in df.collect())


def brute_edit(text, pattern, k, ends):
    """Least errors by start, over all splits and lengths."""
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    out = {}
    for s in range(len(text)):
        for x in range(k + 1 if "I" in ends else 1):
            for z in range(k + 1 - x if "I" in ends else 1):
                y = pattern[x : len(pattern) - z]
                for n in range(1, len(y) + k + 1):
                    t = text[s : s + n]
                    if not y or len(t) < n:
                        continue
                    if "S" not in ends:
                        if t[0] != y[0] or t[-1] != y[-1]:
                            continue
                        cost = lev(t, y)
                    elif len(t) == 1 or len(y) == 1:
                        if len(t) != len(y):
                            continue
                        cost = int(t != y)
                    else:
                        cost = (t[0] != y[0]) + (t[-1] != y[-1]) + lev(t[1:-1], y[1:-1])
                    if x + z + cost <= k:
                        out[s] = min(out.get(s, k), x + z + cost)
    return out


def test_fixture(spark):
    s, q = seqs_of(spark, TEXTS), queries_of(spark, [(0, "CC"), (1, "BB")])
    raw = [(0, 0, 2), (0, 0, 3), (0, 1, 6), (0, 1, 7), (1, 0, 6), (1, 0, 7), (1, 1, 2), (1, 1, 3)]
    matched = [(0, 0, 3), (0, 1, 7), (1, 0, 7), (1, 1, 3)]
    assert places(search.search(s, q)) == []
    assert places(search.search_hamming(s, q, 1)) == raw
    assert places(search.search_edit(s, q, 1, "MSI")) == raw
    assert places(search.search_edit(s, q, 1, "MS")) == raw
    assert places(search.search_edit(s, q, 1)) == matched
    assert places(search.search_edit(s, queries_of(spark, [(0, "CD"), (1, "DB")]), 1)) == matched
    best = search.search(s, q, 2 - 1, best=True)
    assert {r["errors"] for r in best.collect()} == {1}
    assert len(places(search.search(s, q, 1, n=1))) == 2


@pytest.mark.parametrize("k,ends", [(1, "MI"), (2, "MI"), (2, "MS"), (2, "MSI")])
def test_edit_against_brute_force(spark, k, ends):
    rng = random.Random(k)
    texts = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for i in range(12)]
    asked = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(k + 2, 12)))) for i in range(10)]
    got = {(r["qid"], r["seq_id"], r["pos"]): r["errors"] for r in search.search_edit(seqs_of(spark, texts), queries_of(spark, asked), k, ends, stride=16).collect()}
    want = {(q, i, s): e for q, p in asked for i, t in texts for s, e in brute_edit(t, p, k, ends).items()}
    assert got == want


def test_exact_across_chunks(spark):
    text = "".join(random.Random(3).choice("abcd") for _ in range(3000))
    asked = [(0, text[500:560]), (1, text[1000:1100]), (2, text[2990:]), (3, text), (4, "abcdabcdabcdx"), (5, ""), (6, text[500:560]), (7, "é")]
    got = places(search.search(seqs_of(spark, [(0, text), (1, ""), (2, "aaaa"), (3, "éé")]), queries_of(spark, asked)))
    want = sorted((q, i, s) for q, p in asked for i, t in [(0, text), (2, "aaaa"), (3, "éé")] for s in range(len(t)) if p and t.startswith(p, s))
    assert got == want


def test_edges(spark):
    s = seqs_of(spark, [(0, "AAAA"), (1, None), (2, "AAAA")])
    got = places(search.search(s, queries_of(spark, [(0, "AA"), (1, "AAAAA"), (2, None), (3, "B")])))
    assert got == [(0, i, p) for i in (0, 2) for p in range(3)]
    with pytest.raises(Exception, match="matches everywhere"):
        search.search_edit(s, queries_of(spark, [(0, "AA")]), 2).collect()
    empty = search.search(seqs_of(spark, []), queries_of(spark, []), 1)
    assert empty.columns == ["qid", "seq_id", "pos", "errors"] and empty.count() == 0
    with pytest.raises(ValueError):
        search.search_edit(s, queries_of(spark, [(0, "AAAA")]), 1, "X")


def test_found_and_not_found(spark):
    s, q = seqs_of(spark, TEXTS), queries_of(spark, [(0, "CAAAB"), (1, "CCC")])
    hits = search.search(s, q)
    assert [r["qid"] for r in search.found(q, hits).collect()] == [0]
    assert [r["qid"] for r in search.not_found(q, hits).collect()] == [1]


def test_matrix(spark):
    s, q = seqs_of(spark, [(0, "abcabd"), (1, "xbcxbd")]), queries_of(spark, [(0, "abc"), (1, "abd")])
    plain = places(search.search_matrix(s, q, {}, 1))
    assert plain == places(search.search_hamming(s, q, 1))
    wild = places(search.search_matrix(s, q, {("a", "x"): 0}, 0))
    assert wild == [(0, 0, 0), (0, 1, 0), (1, 0, 3), (1, 1, 3)]
    assert places(search.search_matrix(s, q, {("a", "x"): 1}, 0, ambiguous=1)) == wild
    assert places(search.search_matrix(s, q, {("a", "x"): 1}, 0, ambiguous=0)) == [(0, 0, 0), (1, 0, 3)]


def test_kmers(spark):
    s = seqs_of(spark, [(0, "abcabcabd"), (1, "zzabd")])
    got = [(r["qid"], r["kmer"], r["seq_id"], r["pos"]) for r in search.search_kmers(s, queries_of(spark, [(0, "cabd"), (1, "abz"), (2, "ab")]), 3).collect()]
    assert got == [(0, "cab", 0, 2), (0, "cab", 0, 5)] or sorted(got) == [(0, "abd", 0, 6), (0, "abd", 1, 2)]


def test_transcripts(spark):
    assert search.transcript("abc", "abc", 0) == "MMM"
    assert search.transcript("abc", "axc", 1) == "MSM"
    assert search.transcript("abc", "ac", 1) == "MIM"
    assert search.transcript("ac", "abc", 1) == "MDM"
    assert search.transcript("aaaa", "bbbb", 2) is None
    s, q = seqs_of(spark, [(0, "xxabcdexx"), (1, "xxabdexx")]), queries_of(spark, [(0, "abcde")])
    got = {(r["seq_id"], r["pos"]): r["transcript"] for r in search.with_transcripts(search.search_edit(s, q, 1, "MS"), s, q, 1).collect()}
    assert got[0, 2] == "MMMMM" and got[1, 2] == "MMIMM"


def test_candidates_hold_all_hits(spark):
    s, q = seqs_of(spark, TEXTS), queries_of(spark, [(0, "ACAAB"), (1, "AABAA")])
    near = {(r["qid"], r["seq_id"], r["pos"]) for r in search.early_candidates(s, q, 1).collect()}
    assert set(places(search.search_hamming(s, q, 1))) <= near


def test_alphabet(spark):
    s = seqs_of(spark, TEXTS)
    assert [(r["symbol"], r["rank"]) for r in corpus.alphabet(s).orderBy("rank").collect()] == [("A", 1), ("B", 2), ("C", 3)]
    with pytest.raises(ValueError):
        corpus.alphabet(s, 2)
    from pyspark.sql import functions as F

    assert s.select(corpus.to_ranks(F.col("text"), ["A", "B"]).alias("r")).first()["r"][:4] == [1, 1, 1, None]


def test_suffix_array(spark):
    s = seqs_of(spark, [(0, "Hello"), (1, "World")])
    got = [(r["seq_id"], r["pos"]) for r in index.suffix_array(s).orderBy("idx").collect()]
    assert got == [(1, 5), (0, 5), (0, 0), (1, 0), (1, 4), (0, 1), (1, 3), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2)]


def test_suffix_array_against_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for i in range(9)]
    whole = ["".join(t + "\x01" for _, t in texts[i:]) for i in range(len(texts))]
    want = sorted(((whole[i][p:], i, p) for i, t in texts for p in range(len(t) + 1)))
    got = [(r["seq_id"], r["pos"]) for r in index.suffix_array(seqs_of(spark, texts)).orderBy("idx").collect()]
    assert got == [(i, p) for _, i, p in want]


def test_index_round_trips(spark, tmp_path):
    from gramwell.sources import fasta

    s = seqs_of(spark, TEXTS)
    sa = index.suffix_array(s)
    assert sorted(map(tuple, index.reconstruct(sa).collect())) == TEXTS
    path = str(tmp_path / "sa")
    assert fasta.build_or_load(spark, path, lambda: sa).count() == 24
    assert fasta.build_or_load(spark, path, lambda: 1 / 0).count() == 24
    q = queries_of(spark, [(0, "A"), (1, "AC"), (2, "ZZ")])
    cursors = index.cursors(sa, s, q)
    assert {r["qid"]: r["len"] for r in cursors.collect()} == {0: 18, 1: 2, 2: 0}
    assert places(index.locate(sa, cursors)) == places(search.search(s, q))
    rows = index.bwt(sa).collect()
    ranks = {r["idx"]: (r["rank"], r["prefix_rank"]) for r in index.ranks(index.bwt(sa), "B", 5).collect()}
    syms = [r["sym"] for r in sorted(rows, key=lambda r: r["idx"])]
    assert ranks == {i: (syms[:i].count("B"), sum(x < "B" for x in syms[:i])) for i in range(len(syms))}


def test_extend(spark):
    s = seqs_of(spark, [(0, "1111222")])
    root = queries_of(spark, [(0, "1")])
    hits = search.search(s, root)
    assert {r["sym"]: r["count"] for r in index.extend(s, hits, root, False).collect()} == {"1": 3, "2": 1}
    assert {r["sym"]: r["count"] for r in index.extend(s, hits, root, True).collect()} == {"1": 3, "": 1}
    assert places(index.extend_by(s, hits, root, "22", False)) == [(0, 0, 3)]


def test_merge_and_reverse(spark):
    a, b = seqs_of(spark, [(0, "11112222")]), seqs_of(spark, [(0, "21212122")])
    both = index.merge(a, b)
    assert sorted(map(tuple, both.collect())) == [(0, "11112222"), (1, "21212122")]
    twice = {(r["seq_id"], r["is_reverse"]): r["text"] for r in index.mirrored(a).collect()}
    assert twice == {(0, False): "11112222", (0, True): "22221111"}
    with pytest.raises(Exception, match="must have"):
        index.linear_index(both, 7).collect()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_broadcast_and_shuffled_seeds_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_BYTES", most)
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 1500))) for _ in range(12)]
    asked = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(8)] + [texts[0][3:700], texts[1][:12]]
    s, q = spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "qid long, pattern string")
    for k in (0, 1):
        got = {tuple(r) for r in search.search_hamming(s, q, k).collect()}
        want = set()
        for i, p in enumerate(asked):
            for j, t in enumerate(texts):
                for at in range(len(t) - len(p) + 1):
                    if (e := sum(a != b for a, b in zip(p, t[at : at + len(p)], strict=True))) <= k:
                        want.add((i, j, at, e))
        assert got == want
    plan = search.search_hamming(s, q, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(most)


def test_symbol_classes():
    assert search.symbol_classes({}) == {}
    assert search.symbol_classes({"a": ["e"], "e": ["a"]}) == {"a": "a", "e": "a"}
    assert search.symbol_classes({"a": ["e"]}) is None
    assert search.symbol_classes({"n": ["a", "c"], "a": ["n"], "c": ["n"]}) is None
