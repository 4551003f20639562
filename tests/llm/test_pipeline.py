import corpus_pipeline
from tests.llm.test_llm import babble


def test_stages(spark, tmp_path):
    texts = [f"Menu\n{t}" for t in babble(40, 11, 60)]
    texts += [texts[0] + " x", texts[1], "short", None, "## " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (44, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == names
    assert not {42, 43, 44} & set(seen[0]) and set(seen[1]) == set(seen[0])
    assert not any("Menu" in r["text"] for r in seen[1].values())
    assert 41 not in seen[2] and set(seen[3]) == set(seen[2]) == set(seen[4])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])
