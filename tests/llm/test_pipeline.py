import __spark_entry__
import corpus_pipeline
from orrery.llm import fm_index, minhash_forest, pii_crf

from texts import prose

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_follow_each_other(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == documents.columns, name
        after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        assert set(after) <= set(before)
        assert name in ("quality classifier", "near duplicates") or set(after) == set(before)
        assert all(n == len(t) for t, n in after.values())
        before = {i: t for i, (t, _) in after.items()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(before)
    assert all(r.kept for r in minhash_forest.near_duplicates(docs).collect())
    assert not fm_index.occurrences(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").count()
    assert not any(pii_crf.base_spans(t) for t in before.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(r.n_tokens == len(r["ids"]) for r in out.collect())


def test_nulls_go_through(spark, with_clashes, edges):
    docs = with_clashes([*edges, (9, "mail me at a@b.co " + "fine words here " * 30)])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
    assert docs.count() >= 1


def test_near_duplicates_of_null_and_repeated_ids(spark, with_clashes, rng):
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(None, a), (None, a), (9, a), (3, a), (3, a), (None, b), (None, b), (None, f"{b} more"), (5, c), (5, d), (None, e)]
    docs = with_clashes(rows)
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        assert out.schema == docs.schema
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert len(got) == 5 and {(3, a), (5, c), (5, d), (None, e)} < set(got)
        assert sum(i is None and t.startswith(b) for i, t in got) == 1
