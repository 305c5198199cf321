"""Very long texts and repeated rows, through each operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from orrery.llm import divergence, fm_index, huffman_files, license_rules, minhash_forest, pii_crf, quality_crf, sharding, stages, trie_bpe

import test_fm_index
import test_minhash_forest
import test_text_models
from texts import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rows(rng, long_text):
    """The long text, a near copy of it, a short one, and all of them twice."""
    some = [(1, long_text), (2, long_text + " more"), (3, prose(rng, 30) + " write to a.b@c.example.com"), (4, None)]
    return some + some


@pytest.fixture
def docs(with_clashes, rows):
    return with_clashes(rows).repartition(3)


def test_op1(docs, rows):
    got = sorted(tuple(r) for r in minhash_forest.near_duplicates(docs).collect())
    want = test_minhash_forest.expected(dict(rows).items(), 80)
    assert got == sorted((i, *want[i]) for i, _ in rows)


def test_op2(docs, rows):
    model = pii_crf.fit(docs)
    got = sorted((r.doc_id, r.n_email, r.spans) for r in pii_crf.spans(docs, model).collect())
    assert len(got) == 8 and got[::2] == got[1::2]
    assert [x[1] for x in got[::2]] == [0, 0, 1, 0]


def test_op3(docs, rows):
    out = sharding.shard(docs, 3).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((i, sizes[i]) for i, _ in rows)
    assert len({(r.shard, r.position) for r in out}) == 8


def test_op4(spark, docs, rows, rng):
    items = [("a", " ".join(rows[0][1].split()[59_000:59_030])), ("b", "x" * 600_000), ("c", prose(rng, 12))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = test_fm_index.expected(dict(rows).items(), items)
    got = [(r.doc_id, (r.n_words, r.n_hit, tuple(sorted(r["items"])))) for r in fm_index.occurrences(docs, bench).collect()]
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)
    clean = fm_index.remove(docs, bench)
    assert clean.schema == docs.schema
    for r in clean.collect():
        n, hit, _ = want[r.doc_id]
        assert len(test_fm_index.words_of(r.text)) == n - hit


def test_op5(docs, rows):
    got = sorted(tuple(r)[:6] for r in divergence.judge(docs).collect())
    assert got == sorted((i, *test_text_models.base_counts(t)) for i, t in rows)


def test_op7(spark, docs, rows):
    path = stages.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in dict(rows).items()}
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in huffman_files.read(spark, huffman_files.write(docs, path), with_ids=False).collect())
    assert got == sorted((i, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, _ in rows)


def test_op8(docs):
    labels = docs.select("doc_id").distinct().selectExpr("doc_id", "cast(doc_id = 3 as int) as quality")
    out = quality_crf.with_scores(docs, quality_crf.fit(docs, labels))
    assert sorted(out.columns) == sorted(docs.columns)  # a column of the score's name is replaced
    got = sorted((r.doc_id, r.score) for r in out.collect())
    assert len(got) == 8 and got[::2] == got[1::2] and all(0 <= s <= 1 for _, s in got)


def test_op9(spark, docs, long_text):
    more = docs.limit(0).select("doc_id", "text").union(spark.createDataFrame([(9, f"{long_text} Released under the MIT License.")] * 2, "doc_id long, text string"))
    found = {(r.doc_id, tuple(r.licenses)) for r in license_rules.scan(docs.select("doc_id", "text").union(more)).collect()}
    assert found == {(1, ()), (2, ()), (3, ()), (4, ()), (9, ("MIT",))}


def test_op10(docs, rows):
    path = stages.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    sums = {}
    for i, t in dict(rows).items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        sums[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in trie_bpe.digests(docs, path).collect())
    assert got == sorted((i, *sums[i]) for i, _ in rows)


def test_stages(spark, docs):
    """Columns of any names go through as they are, and an empty table stays one."""
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF).checkpoint()
            assert now.schema.names == docs.schema.names, name
        for r in now.collect():
            assert (r["_row"], r["_score"], r["Shard"], r["kept"]) == (2, 1, 5, 14)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
