import pytest
from tests.conftest import SF
from tests.llm import odd
from tests.llm.test_packing import check
from tests.llm.test_rules import brute
from tests.llm.test_shingles import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    """Every stage against brute force over its own input; decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns
        before = {r["doc_id"]: tuple(r) for r in docs.collect()}
        after = {r["doc_id"]: tuple(r) for r in kept.collect()}
        assert len(after) == kept.count()
        assert after.items() <= before.items()
        at = columns.index("text")
        if name == "quality_rules":
            assert not any(brute(r[at])[-1] for r in after.values())
        if name == "simhash_near_dedup":
            assert set(after) == set(brute_components([(key, r[at]) for key, r in before.items()]).values())
        assert 0 < len(after) < len(before) or k == 2
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check(packed, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("stage", range(5))
def test_odd_and_empty_documents(spark, stage):
    _, function = corpus_pipeline.STAGES[stage]
    out = function(spark, odd.table(spark), SF)
    assert out.count() <= 100
    if stage < 4:
        assert out.columns == odd.table(spark).columns
    assert function(spark, odd.empty(spark), SF).count() == 0


def test_clean_documents_pass_the_filters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi").where("size(split(text, ' ')) >= 25")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.01").join(clean, "doc_id", "left_semi")
    assert kept.count() >= 0.98 * clean.count()


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
