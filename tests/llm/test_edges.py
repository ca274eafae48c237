"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import pytest
from gramwell.llm import decontamination, jaccard_join, license_scans, media_columns, packing, secret_scans, suffix_dedup, token_counts, toxicity, url_filters
from gramwell.llm.store import work_path
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 6000
ROWS = [(0, "token = 'abcdef1234'"), (1, None), (2, ""), (3, LONG), (3, LONG), (4, "All rights reserved."), (None, "no id here at all"), (5, "é" * 300), (6, "é" * 300), (7, "a\x00b \n\n  c")]
SCHEMA = "doc_id long, text string"
#: Columns that the operators use themselves.
CLASHING = ("_id", "_text", "spans", "n", "score", "ids", "kept", "rule_", "words", "items", "key", "block", "u", "v")


@pytest.fixture(params=["rows", "empty", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, SCHEMA)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING]) if request.param == "clashing" else df


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_packing(docs):
    rows = packing.pack(docs).rows().collect()
    given = rows_of(docs)
    assert sum(r["piece"] == 0 for r in rows) == len(given)
    if given:
        assert sum(r["length"] for r in rows if r["_id"] == 1) == 1
        assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
        used = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == used.get(r["sequence_id"], 0)
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(used.values()) <= 1024


def test_secrets(docs):
    got = by_id((r["doc_id"], [tuple(s) for s in r["spans"]], r["redacted"]) for r in secret_scans.scan_secrets(docs, keep=("doc_id",), redact=True).collect())
    want = by_id((d, s := secret_scans.find_secrets(t or ""), secret_scans.redacted(t, s) if s else t) for d, t in rows_of(docs))
    assert got == want


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(0, "lorem ipsum dolor lorem ipsum dolor lorem ipsum"), (1, None), (2, ""), (3, "no id"), (3, "no id")], "item_id long, text string")
    got = {(r["doc_id"], tuple(r["items"])) for r in decontamination.find_items(docs, items, keep=("doc_id",)).collect()}
    if rows_of(docs):
        assert (3, ("0",)) in got and (None, ("3",)) in got and (1, ()) in got and (2, ()) in got
    none = decontamination.find_items(docs, spark.createDataFrame([], "item_id long, text string"), keep=("doc_id",))
    assert none.where(F.size("items") > 0).count() == 0 and none.count() == len(rows_of(docs))


def test_suffix_dedup(docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()))
    seen, want, kept = set(), [], {}
    order = sorted(set(rows_of(docs)), key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept[d, t] = bytes(c for c, m in zip(b, cover, strict=True) if not m)
    want = sorted((d is None, d or 0, len((t or "").encode()), kept[d, t]) for d, t in rows_of(docs))
    assert got == want


def test_token_counts(spark, docs):
    listed = token_counts.write_token_files(docs, work_path(spark, "tokens"))
    counted = token_counts.scan_token_files(listed.select("file", "size"), block_bytes=1000)
    rows = listed.join(counted, ["file", "ordinal"], "left").collect()
    encode = token_counts.encoder(token_counts.default_vocabulary())
    assert by_id((r["doc_id"], r["n_tokens"]) for r in rows) == by_id((d, len(encode.ids(t or ""))) for d, t in rows_of(docs))


def test_media(docs):
    own = docs.select("doc_id", "text")
    features = media_columns.read_features(media_columns.store_payloads(docs))
    got = media_columns.resolve(media_columns.interleave(media_columns.document_pages(own)), features, ("doc_id",)).collect()
    want = []
    for d, t in rows_of(docs):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert by_id((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == by_id(want)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(0, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score_texts(docs, model, keep=("doc_id",)).collect()
    assert len(rows) == len(rows_of(docs)) and all(0 <= r["score"] <= 1 for r in rows)


def test_licenses(docs):
    rows = license_scans.scan_licenses(docs).collect()
    given = rows_of(docs)
    assert len(rows) == len(given)
    if given:
        one = next(r for r in rows if r["doc_id"] == 4)
        assert (one["n_words"], one["n_base"], one["first_word"], one["labels"], one["score"]) == (3, 1, 0, "reserved", 1.0)
        null = next(r for r in rows if r["doc_id"] == 1)
        assert (null["n_words"], null["n_base"], null["first_word"], null["labels"], null["score"]) == (0, 0, None, "", 0.0)


def test_jaccard(docs):
    got = by_id(jaccard_join.jaccard_components(docs).collect())
    given = rows_of(docs)
    want = []
    for d, t in given:
        words = (t or "").split()
        n = len({tuple(words[i : i + 4]) for i in range(len(words) - 3)}) if len(words) >= 4 else int(bool(words))
        want.append((d, n, 5 if d == 6 else d))
    assert got == by_id(want)


def test_urls(spark):
    rows = [(0, "HTTP://A.Example.NET/en/x?q"), (1, None), (2, ""), (3, "no scheme"), (4, "http://x.casino-win.com"), (5, "http://net"), (6, "http://example.com/de/"), (6, "http://example.com/de/"), (None, "https://b.org/fr/#x"), (7, "http://a.org/fr"), (8, "http://badexample.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("old"))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, listed_hosts=url_filters.hosts_with_labels(pages)).collect()}
    assert got == {(0, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.casino-win.com", "", None, "block"), (5, "net", "", None, "allow"), (6, "example.com", "/de/", "example.com/de/", "block"), (None, "b.org", "/fr/", "org/fr/", "allow"), (7, "a.org", "/fr", None, "allow"), (8, "badexample.com", "/de/", None, "allow")}
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_urls_beyond_the_filter_bound(spark):
    rows = [(None, "https://b.org/fr/#x"), (None, "http://x.casino-win.com"), (None, None), (6, "http://example.com/de/"), (6, "http://a.example.net/en/x"), (6, "http://example.com/de/"), (7, ""), (8, "http://plain.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = lambda most: by_id(url_filters.judge_urls(pages, listed_hosts=url_filters.hosts_with_labels(pages), max_filter_bytes=most).collect())
    got = judged(0)
    assert got == judged(64 << 20)
    assert [r[-2:] for r in got if r[1] == "http://x.casino-win.com"] == [(None, "block")] and [r[-2:] for r in got if r[1] == "http://a.example.net/en/x"] == [("example.net/en/", "allow")]
