"""Each stage of the pipeline against a plain version, on planted cases."""

import random

import corpus_pipeline
from gramwell.llm.store import written

RUDE = ["grumbo", "vexitor", "snarled", "wretchy"]


def make(spark, folder):
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = prose(rng.randint(40, 160)).split()
        if i % 3 == 0:
            for _ in range(6):
                text.insert(rng.randint(0, len(text)), rng.choice(RUDE))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    passage = prose(20)
    rows += [(400, rows[1][1]), (401, rows[1][1] + " z"), (402, f"{prose(50)} {passage} {prose(50)}"), (403, f"{prose(60)} token = 'abcdef123456' {prose(9)}"), (404, None), (405, "")]
    spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows)


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    given = make(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = written(stage["toxicity"](spark, docs, d), "a")
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns
    assert len([i for i in range(0, 300, 3) if i in kept]) <= 20 and len([i for i in given if i < 300 and i % 3 and i not in kept]) <= 6
    single = written(stage["near_duplicates"](spark, docs, d), "b")
    assert {r["doc_id"] for r in single.collect()} == set(given) - {400, 401}
    pure = written(stage["decontamination"](spark, docs, d), "c")
    assert {r["doc_id"] for r in pure.collect()} == set(given) - {402}
    safe = {r["doc_id"]: r for r in stage["secrets"](spark, docs, d).collect()}
    assert set(safe) == set(given)
    assert "abcdef123456" not in safe[403]["text"] and safe[403]["n_chars"] == len(safe[403]["text"])
    assert all(safe[i]["text"] == t for i, t in given.items() if i != 403)
    packed = stage["packing"](spark, docs, d).collect()
    assert {r["doc_id"] for r in packed} == set(given)


def test_run(spark, tmp_path):
    d = str(tmp_path)
    make(spark, d)
    rows = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and not ids & {400, 401, 402} and {403, 404, 405} <= ids


def test_near_copies_and_rows_without_a_unique_id(spark):
    words = [f"w{i}" for i in range(50)]
    changed = words[:25] + ["other"] + words[26:]  # 41 of 51 five-word shingles are common, 43 of 51 four-word ones
    far = words[:24] + ["other", "more"] + words[26:]  # 40 of 52 five-word shingles
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    given = [(7, " ".join(words)), (3, " ".join(changed)), (8, " ".join(far).replace("w1 ", "v1 "))]
    given += [(None, other), (None, other), (None, third), (5, third), (6, fourth), (6, fourth), (6, "not a copy"), (None, None), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    kept = written(corpus_pipeline.near_duplicates(spark, docs, ""), "d")
    want = [(3, " ".join(changed)), given[2], (None, other), (5, third), (6, fourth), (6, "not a copy"), (None, None), (None, None), (9, ""), (9, "")]
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_short_items_drop_no_clean_document(spark, tmp_path):
    d = str(tmp_path)
    eight = "one two three four five six seven eight"
    items = [(0, "yes"), (1, "Ada Lovelace"), (2, "a b c d e f g"), (3, eight), (4, ""), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    given = [(0, "well yes it is so"), (1, "Ada Lovelace wrote a b c d e f g"), (2, f"x {eight} y"), (3, eight[4:]), (4, None), (5, "yes")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, d).collect()} == {0, 1, 3, 4, 5}
