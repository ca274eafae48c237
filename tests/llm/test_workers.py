"""What Python workers keep between tasks of different operators."""

import gc

import corpus_pipeline
import pyarrow as pa
import pytest

from gramwell.llm import tokens, toxicity, workers


def encoders(spark):
    """The largest number of encoders that a worker holds."""

    def count(batches):
        from gramwell.llm.tokens import Encoder

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, Encoder) for x in gc.get_objects())], pa.int64())], ["n"])

    return max(r["n"] for r in spark.range(0, 64, 1, 32).mapInArrow(count, "n long").collect())


def scored(spark, docs):
    toxicity.score_texts(docs, toxicity.Model(b"", b"", 0, (0.0, 0.0, 0.0), False), keep=("doc_id",)).collect()


def single(spark, docs):
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 64


@pytest.mark.parametrize("stage", [scored, single])
def test_stages_hold_no_encoder_of_an_earlier_packing(spark, stage):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "en", "src", 0) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(32)
    assert len(corpus_pipeline.packing(spark, docs, "").collect()) == 64
    assert encoders(spark) == 1
    stage(spark, docs)
    assert encoders(spark) == 0


def test_one_key_is_remembered():
    made = []
    get = lambda key: workers.remembered(key, lambda: made.append(key) or [key])
    assert get("a") is get("a") and get("b") == ["b"] and get("a") == ["a"]
    assert made == ["a", "b", "a"]
    workers.give_back()
    assert get("a") == ["a"] and made == ["a", "b", "a", "a"]


def test_the_plain_tokenizer_is_loaded_only_when_asked_for():
    e = tokens.Encoder(tokens.default_vocabulary())
    e.encode("some words")
    assert "tokenizer" not in vars(e)
    assert e.tokenizer.encode("some words", add_special_tokens=False).ids == e.ids("some words")
