"""What an encoding worker holds beside its texts."""

from __future__ import annotations

import pickle
import tracemalloc

from tidemark.llm import bpe
from tidemark.llm.queries import TOKENIZER


def test_a_sent_vocabulary_encodes_alike_and_takes_less_than_the_file():
    with open(TOKENIZER, "rb") as f:
        raw = f.read()
    sent = pickle.dumps(bpe.Vocabulary(raw))
    peak = {}
    for name, make in (("file", lambda: bpe.Codec(raw)), ("sent", lambda: bpe.Codec(pickle.loads(sent)))):
        tracemalloc.start()
        codec = make()
        peak[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        ids = codec.encode("Ein Straßenname, <|im_end|> naïve co-operation 12,345 \U0001f600 " + "x" * 300)
        peak[name, "ids"] = ids
        peak[name, "text"] = codec.decode(ids)
    assert peak["sent", "ids"] == peak["file", "ids"] and peak["sent", "text"] == peak["file", "text"]
    assert peak["sent"] < 0.75 * peak["file"]


def test_a_slice_of_texts_is_small():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 20_000] * 20)], names=["text"])
    assert [s.num_rows for s in bpe.slices(batch, 0)] == [5, 5, 5, 5]


def test_whole_texts_reach_the_workers_in_small_batches(spark):
    import pyarrow as pa

    from tidemark.llm.common import BATCH

    key = BATCH[0]
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    docs = spark.range(0, 8000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 1000) as text")
    try:
        got = bpe.round_trip(docs, TOKENIZER)
        assert spark.conf.get(key) == BATCH[1]
        seen = [r[0] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["doc_id"]) for b in batches), "doc_id long").collect()]
        assert sum(seen) == 8000 and max(seen) < 2000 and got.columns[:2] == ["doc_id", "text"]
        spark.conf.set(key, "1m")
        bpe.round_trip(docs, TOKENIZER)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
