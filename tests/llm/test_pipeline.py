"""The stages one by one against what each promises, and the whole run."""
import collections

import corpus_pipeline
from test_shingles import _kept

from trialweave.llm import packing, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    machine = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            assert set(after) == {i for i, r in before.items() if machine.score(r["text"]) < 0.5}
            assert all(after[i] == before[i] for i in after)
        elif name == "simhash_near_dedup":
            assert all(after[i] == before[i] for i in after)
            assert collections.Counter(list(after)) == _kept([(i, r["text"] or "") for i, r in before.items()])
        else:
            assert set(after) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "secret_scans":
            assert not any(secrets.base_spans(r["text"]) for r in after.values())
    assert {r["doc_id"] for r in docs.collect()} == set(before)
    counts = {r["length"]: r["count"] for r in docs.groupBy("length").count().collect()}
    used = docs.select("sequence_id").distinct().count()
    assert used >= packing.lower_bound(counts, 1024)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
