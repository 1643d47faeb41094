"""What the third round of findings says about the training-data operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import common, decontaminate, simhash, token_files, toxicity


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """with bands that never meet, a text and its copy with one more word still link, and only these."""
    monkeypatch.setattr(simhash, "banded", lambda *a, plain=simhash.banded: plain(*a).withColumn("keys", F.array("id")))
    rows = []
    for i in range(8):
        words = [f"t{i}w{x}" for x in range(1000)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component"] for r in simhash.near_copies(docs).collect()} == {i: i // 10 * 10 for i, _ in rows}


def long_texts(n: int, words: int) -> list[str]:
    g = np.random.Generator(np.random.PCG64(1))
    return [" ".join(f"w{x}" for x in g.integers(0, 5000, words)) for _ in range(n)]


@pytest.mark.parametrize("stage", ["decontamination", "toxicity"])
def test_stages_hold_little_of_a_batch(spark, monkeypatch, stage):
    """pipeline: beyond the batch itself, a worker holds the arrays of a small piece of it."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(long_texts(700, 1000))], ["doc_id", "text"])
    if stage == "toxicity":
        monkeypatch.setattr(common, "arrow", lambda df, function, schema: function)
        scan = toxicity.with_score(spark.createDataFrame([], "doc_id long, text string"), toxicity.new_model())
    else:
        items = decontaminate.Items([(1, long_texts(1, 60)[0])], 7, {}, 4)
        scan = decontaminate._scan(lambda: items, 0.8, 1, True)
    tracemalloc.start()
    for _ in scan(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (30 if stage == "toxicity" else 24) << 20, peak >> 20


def test_stages_get_small_batches(spark, monkeypatch, tmp_path):
    """pipeline: 10,000 whole texts no longer come at once; a size that the session names itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.createDataFrame([(i, "text " * 400) for i in range(6000)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    monkeypatch.setattr(common, "read_table", lambda *_: bench)
    try:
        spark.conf.unset(key)
        assert corpus_pipeline.leaks(spark, docs, "").count() == 6000
        assert max(r["n"] for r in common.arrow(docs, sizes, "n long").collect()) < common.BATCH_BYTES + 10_000
        spark.conf.set(key, 1 << 20)
        common.small_batches(spark)
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)


def test_documents_are_coded_once(spark, monkeypatch, tmp_path):
    """op12_token_files: the ends of the sorted ranges are sampled from written bits; coding does not run again for them."""
    import public_tokenizers

    coded = spark.sparkContext.accumulator(0)

    def counted(batches, *rest, plain=token_files._coded):
        for batch in plain(batches, *rest):
            coded.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(token_files, "_coded", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long_texts(40, 30))], "doc_id long, text string").repartition(4)
    token_files.write_token_files(docs, str(tmp_path / "files"), public_tokenizers.path("word_bpe_49k.json"), 1, by_word=True)
    assert coded.value == 40
    assert [r["doc_id"] for r in token_files.read_token_files(spark, str(tmp_path / "files")).orderBy("start").collect()] == list(range(40))
