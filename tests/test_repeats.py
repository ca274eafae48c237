"""Work on repeated texts and patterns grows with the distinct ones."""

import random

import pytest
from gramwell.operators import corpus, index, search
from pyspark.sql import functions as F

NAMES = ["red bolt", "red boat", "new ring", "cold gear", "old gear", "small plate", "bolt"]
ASKED = ["red bolt", "old gear", "new rind"]
TEXTS = list(enumerate(NAMES * 6)) + [(90, ""), (91, None), (92, "old gear"), (92, "cold gear")]
QUERIES = list(enumerate(ASKED * 4))


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(TEXTS, "seq_id long, text string"), spark.createDataFrame(QUERIES, "qid long, pattern string")


def spied(monkeypatch, name, of=search):
    """Rows of the first argument of each call."""
    seen, own = [], getattr(of, name)
    monkeypatch.setattr(of, name, lambda df, *a, **kw: seen.append(df.count()) or own(df, *a, **kw))
    return seen


def alone(spark, run, columns):
    """What distinct texts and patterns give, written out for all that are equal to them: the least of a (qid, seq_id, pos)."""
    texts, asked = list(enumerate(NAMES)), list(enumerate(ASKED))
    at = {}
    for r in run(spark.createDataFrame(texts, "seq_id long, text string"), spark.createDataFrame(asked, "qid long, pattern string")).collect():
        at.setdefault((ASKED[r["qid"]], NAMES[r["seq_id"]]), []).append(tuple(r[c] for c in columns))
    out = {}
    for q, p in QUERIES:
        for i, t in TEXTS:
            for r in at.get((p, t), []):
                out[q, i, r[0]] = min(out.get((q, i, r[0]), r[1:]), r[1:])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_equal_texts_are_searched_once(spark, monkeypatch, tables, most):
    monkeypatch.setattr(search, "BROADCAST_BYTES", most)
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", most)
    seen = spied(monkeypatch, "candidates")
    got = [tuple(r) for r in search.search_hamming(*tables, 1).collect()]
    assert seen == [len(NAMES) + 1]  # and the empty text
    assert len(got) == len(set(got)) and set(got) == alone(spark, lambda s, q: search.search_hamming(s, q, 1), ["pos", "errors"])


def test_equal_texts_are_aligned_once(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "with_transcripts")
    got = [tuple(r) for r in search.search_transcripts(*tables, 1).collect()]
    assert len(seen) == 1 and seen[0] <= len(NAMES) * len(set(ASKED))
    plain = lambda s, q: search.with_transcripts(search.search_edit(s, q, 1, "MS"), s, q, 1)
    assert len(got) == len(set(got)) and set(got) == alone(spark, plain, ["pos", "errors", "transcript"])


def best_of(rows):
    least = {}
    for q, _, _, e in rows:
        least[q] = min(least.get(q, e), e)
    return {r for r in rows if r[3] == least[r[0]]}


def test_best_hits_are_chosen_among_distinct_texts(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "best_hits")
    got = [tuple(r) for r in search.search(*tables, 2, best=True).collect()]
    assert len(seen) == 1 and seen[0] <= len(NAMES) * len(set(ASKED)) * 3
    assert len(got) == len(set(got)) and set(got) == best_of(alone(spark, lambda s, q: search.search_edit(s, q, 2), ["pos", "errors"]))


def test_common_kmers_fill_no_single_task(spark):
    texts, asked = list(enumerate(["abcd"] * 40 + ["xabcabcd"])), [(i, p) for i, p in enumerate(["abcd", "abcd", "cabc", "zz", "abcz", None])]
    for rows in (texts, [(i, f"{t}{i:05}") for i, t in texts]):  # with and without repeated texts
        s, q = spark.createDataFrame(rows, "seq_id long, text string"), spark.createDataFrame(asked, "qid long, pattern string")
        df = search.search_kmers(s, q, 3)
        where = {k: sorted((i, p) for i, t in rows for p in range(len(t) - 2) if t[p : p + 3] == k) for k in ("abc", "bcd", "cab")}
        rare = {0: "bcd", 1: "bcd", 2: "cab"}
        assert sorted(tuple(r) for r in df.collect()) == sorted((i, k, *x) for i, k in rare.items() for x in where[k])
        assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString().split("Generate")[0]


def test_candidates_of_equal_texts(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "candidates")
    got = [tuple(r) for r in search.early_candidates(*tables, 1).collect()]
    assert seen == [len(NAMES) + 1]
    assert len(got) == len(set(got)) and set(got) == alone(spark, lambda s, q: search.early_candidates(s, q, 1), ["pos"])


def first_of(rows, n):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return {r for rs in by.values() for r in rs[:n]}


def test_first_of_the_best_are_taken_for_each_pattern(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "first_hits")
    got = {tuple(r) for r in search.search(*tables, 1, n=2, best=True).collect()}
    every = best_of(alone(spark, lambda s, q: search.search_edit(s, q, 1), ["pos", "errors"]))
    assert got == first_of(every, 2)
    assert seen == [len(every) * len(set(ASKED)) // len(QUERIES)]


def test_first_hits_are_taken_for_each_pattern(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "first_hits")
    got = {tuple(r) for r in search.search(*tables, 1, n=3).collect()}
    every = alone(spark, lambda s, q: search.search_edit(s, q, 1), ["pos", "errors"])
    assert got == first_of(every, 3)
    assert seen == [len(every) * len(set(ASKED)) // len(QUERIES)]


def test_two_edits_of_equal_texts(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "candidates")
    got = [tuple(r) for r in search.search_edit(*tables, 2).collect()]
    assert seen == [len(NAMES) + 1]
    assert len(got) == len(set(got)) and set(got) == alone(spark, lambda s, q: search.search_edit(s, q, 2), ["pos", "errors"])


def test_rows_of_one_pattern_lie_together(spark):
    rng = random.Random(9)
    s = spark.createDataFrame([(i, rng.choice(NAMES)) for i in range(600)], "seq_id long, text string")
    q = index.clipped(spark.createDataFrame([(i, rng.choice(NAMES)) for i in range(60)], "qid long, pattern string"), 3)
    rows = search.search_hamming(s, q).withColumn("part", F.spark_partition_id()).collect()
    kept = {r["qid"]: r["pattern"] for r in q.collect()}
    texts = {r["seq_id"]: r["text"] for r in s.collect()}
    assert {tuple(r)[:3] for r in rows} == {(i, j, p) for i, x in kept.items() for j, t in texts.items() for p in range(len(t)) if t.startswith(x, p)}
    runs = sum(a["part"] != b["part"] or kept[a["qid"]] != kept[b["qid"]] for a, b in zip(rows, rows[1:], strict=False)) + 1
    assert runs <= len({r["part"] for r in rows}) * len(set(kept.values()))


def test_inserted_ends_of_equal_texts(spark, monkeypatch, tables):
    seen = spied(monkeypatch, "candidates")
    got = [tuple(r) for r in search.search_edit(*tables, 1, "MSI").collect()]
    assert seen == [len(NAMES) + 1]
    assert len(got) == len(set(got)) and set(got) == alone(spark, lambda s, q: search.search_edit(s, q, 1, "MSI"), ["pos", "errors"])


@pytest.mark.parametrize("left", [True, False])
def test_extensions_are_counted_for_distinct_texts(spark, monkeypatch, left):
    s = spark.createDataFrame([(i, t) for i, t in TEXTS if i < 92], "seq_id long, text string")
    q = spark.createDataFrame([(i, p) for i, p in enumerate(["ol", "ar", "ol", "re", "ar", "zz", ""])], "qid long, pattern string")
    want = sorted(map(tuple, index.extend(s, search.search(s, q), q, left).collect()))
    seen = spied(monkeypatch, "extend", index)
    df = index.extensions(s, q, left)
    assert sorted(map(tuple, df.collect())) == want and df.dtypes == [("qid", "bigint"), ("sym", "string"), ("count", "bigint")]
    assert seen == [len(NAMES) + 1]
    back = index.search_reversed(s, q.where("pattern <> ''"), 0)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in search.search(s, q).collect()}
