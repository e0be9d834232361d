"""The pipeline's decisions against brute force, stage by stage, and its last result."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import documents, jaccard_truth, sentence


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(2)
    item = " ".join(f"q{i}" for i in range(16))
    long = sentence(rng, 400)  # 16 of 416 words are hit: under a twentieth
    docs = documents(spark, [(600, "see " + item + " end", "en", "a"), (601, long + " " + item, "en", "a"), (602, "mail me at x.y@z.org or 10.0.0.1 now please dear friend", "en", "a")])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert set(seen["language"]) == {r.doc_id for r in docs.collect()} - {1, 2, 9}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (1, 2, 9)]
    assert set(seen["near_duplicates"]) == {c for _, _, c in jaccard_truth(left)}
    assert set(seen["decontaminated"]) == set(seen["near_duplicates"]) - {600}
    clean = seen["without_pii"]
    assert set(clean) == set(seen["decontaminated"]) and clean[602].text.startswith("mail me at [EMAIL] or [IP] now") and clean[602].n_chars == len(clean[602].text)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(clean) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
