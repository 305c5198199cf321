"""The registered queries' columns against brute-force versions, over whole tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from orrery.llm import pii_crf, quality_crf, stages

import test_fm_index
import test_minhash_forest
import test_text_models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, folder=SF):
    return __spark_entry__.queries()[name](spark, folder).collect()


def test_op1(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows_of(spark, "op1_lsh_forest")}
    assert got == test_minhash_forest.expected(texts.items())


def test_op2(spark, texts):
    for r in rows_of(spark, "op2_skip_chain"):
        base = test_text_models.plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, kind, _ in base) for k in range(4)]
        listed = [f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and len(spans) == len(listed) + r.n_added and r.settled


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_op2_adds_spans_and_leaves_clean_documents(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    secret = re.compile(r"""token = "[0-9a-f]{20,}"|AKIA[0-9A-Z]{16}""")
    holding = found = 0
    for r in rows_of(spark, "op2_skip_chain", folder):
        if secret.search(docs[r.doc_id]):
            holding += 1
            found += "secret:" in r.spans
        elif not re.search(r"[0-9@]", docs[r.doc_id]):
            assert not r.spans
    assert holding and found >= 0.99 * holding


def test_op3(spark, texts):
    rows = rows_of(spark, "op3_virtual_slots")
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    shards = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(16))
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in members) for members in shards.values()]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_op5(spark, texts):
    for r in rows_of(spark, "op5_divergence"):
        want = test_text_models.base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_op7(spark, texts):
    library = Tokenizer.from_file(stages.tokenizer_path("byte_bpe_50k.json"))
    start = 0
    rows = sorted(rows_of(spark, "op7_huffman_files"), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def enumerated(bins, lengths, model):
    """The score of one document by the sum over all label sequences of up to twelve lines."""
    n = len(bins)
    f = np.arange(quality_crf.N_FEATURES)
    u = np.array([model.own[f, x].sum() for x in bins])
    for k in range(n):
        u[k] += model.last[f, bins[k - 1]].sum() if k else model.edges[0]
        u[k] += model.next[f, bins[k + 1]].sum() if k < n - 1 else model.edges[1]
    y = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    score = y @ u + model.transitions[2 * y[:, :-1] + y[:, 1:]].sum(axis=1)
    p = np.exp(score - score.max())
    good = (p / p.sum()) @ y
    return 1 / (1 + np.exp(-(model.slope * (good @ lengths / lengths.sum()) + model.shift)))


def test_op8(spark, texts):
    import pyarrow as pa

    from orrery.llm import words as w

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, checked = quality_crf.fit(docs.select("doc_id", "text"), labels), 0
    for r in rows_of(spark, "op8_line_crf"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
        (chunk,) = w.chunks(pa.array([texts[r.doc_id]], pa.string()), False)
        _, lengths, bins = quality_crf.line_bins(chunk)
        if len(bins) == 0:
            assert r.score == pytest.approx(model.prior)
        elif len(bins) <= 12:
            checked += 1
            assert r.score == pytest.approx(enumerated(bins, lengths, model), abs=1e-6)
    assert checked >= 50


def test_op10(spark, texts):
    library = Tokenizer.from_file(stages.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in rows_of(spark, "op10_trie_bpe"):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def cut(text, items):
    """The text without benchmark passages, from each run of hit words' first to its last character."""
    lower, spans = text.translate(test_fm_index.LOWER), []
    words = list(test_fm_index.WORD.finditer(lower))
    wanted = set()
    for item in items:
        ws = test_fm_index.words_of(item)
        wanted |= {tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9))} if ws else set()
    hit = set()
    for n in {len(x) for x in wanted}:
        for k in range(len(words) - n + 1):
            if tuple(m.group() for m in words[k : k + n]) in wanted:
                hit |= set(range(k, k + n))
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1][1] = words[k].end()
        else:
            spans.append([words[k].start(), words[k].end()])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def test_pipeline(spark, texts):
    """Each stage against a plain version of it, on what the stage before has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_crf.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_crf.with_scores(docs, model).collect()}
    kept = {i: t for i, t in texts.items() if scores[i] >= 0.5}
    kept = {i: kept[i] for i, (_, _, first) in test_minhash_forest.expected(kept.items(), 80).items() if first or not (kept[i] or "").split()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: cut(t, items) for i, t in kept.items()}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    found = pii_crf.find(list(kept.values()), pii_crf.fit(frame))
    kept = {i: pii_crf.redact(t, every) for (i, t), (_, every, _) in zip(kept.items(), found, strict=True)}
    library = Tokenizer.from_file(stages.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    assert {r.doc_id: r.ids for r in rows_of(spark, "pipeline")} == want
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "token_ids"]
