from pathlib import Path

import public_tokenizers as P
import pytest
from test_near_text import plain as plain_near
from test_packing import check as check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from tilespan.llm import packing
from tilespan.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    for name in ("quality", "toxicity", "exact_dedup", "near_dedup"):
        now = spark.createDataFrame(before, docs.schema)
        after = stages[name](spark, now, SF)
        assert after.columns == docs.columns
        kept = after.collect()
        ids = {r.doc_id for r in kept}
        assert len(ids) == len(kept) and {*kept} <= {*before}
        if name in ("quality", "toxicity"):
            good = [(labels[r.doc_id].quality == 1 if name == "quality" else labels[r.doc_id].toxic == 0) == (r.doc_id in ids) for r in before if r.doc_id in labels]
            assert sum(good) >= 0.9 * len(good)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
            assert ids == {*last.values()}
        else:
            assert ids == {d for d, c in map(eval, plain_near([(r.doc_id, r.text) for r in before])) if d == c}
        before = kept
    pieces = stages["packing"](spark, spark.createDataFrame(before, docs.schema), SF).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in before], packing.CAPACITY, Tokenizer.from_file(P.path(packing.VOCABULARY)))
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    def one(spark, docs, sf_dir):
        return written(docs.where("n % 2 = 0"), "half").groupBy("n").count().select("n")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", one), ("two", one), ("three", one)])
    spark.range(10).selectExpr("id AS n").write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.iterdir()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [p.name.rsplit("-", 1)[0] for p in {*shared.iterdir()} - before] == ["stage-three"]
    assert sorted(r.n for r in out.collect()) == [0, 2, 4, 6, 8]
