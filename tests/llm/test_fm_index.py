import hashlib
import re

import numpy as np

from orrery.llm import fm_index
from orrery.llm import words as w

from texts import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, window=10):
    wanted = {}
    for name, text in items:
        ws = words_of(text)
        for k in range(max(1, len(ws) - window + 1)) if ws else ():
            wanted.setdefault(tuple(ws[k : k + window]), set()).add(str(name))
    out = {}
    for i, text in docs:
        ws, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    names |= wanted[tuple(ws[k : k + n])]
        out[i] = (len(ws), len(hit), tuple(sorted(names)))
    return out


def found(docs, items):
    return {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in fm_index.occurrences(docs, items).collect()}


def make(rng):
    items = [(k, prose(rng, rng.randint(10, 40))) for k in range(30)] + [(90, "short one"), (91, None), (92, "..."), (93, "short one"), (94, "Zu")]
    docs = []
    for k in range(200):
        text = prose(rng, rng.randint(0, 120))
        if k % 3 == 0:
            words = items[rng.randrange(30)][1].split()
            cut = rng.randint(0, 5)
            text += " " + ", ".join(words[cut:]).upper() + " " + prose(rng, 5)
        if k % 7 == 0:
            text += " Short? ONE! " + items[3][1] * 2
        docs.append((k, text))
    return docs, items


def test_against_brute_force(spark, rng):
    docs, items = make(rng)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(df, bench) == expected(docs, items)


def test_blocks_of_items_and_small_shards(spark, rng, monkeypatch):
    docs, items = make(rng)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 200)
    got = fm_index.occurrences(df, bench)
    assert {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()} == expected(docs, items)


def test_removal(spark, rng, with_clashes):
    docs, items = make(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = fm_index.remove(with_clashes(docs), bench)
    assert clean.columns == with_clashes(docs).columns
    want = expected(docs, items)
    for r in clean.collect():
        n, hit, _ = want[r.doc_id]
        assert len(words_of(r.text)) == n - hit
        assert hit or r.text == dict(docs)[r.doc_id]


def test_removal_does_not_depend_on_blocks(spark, rng, with_clashes, monkeypatch):
    docs, items = make(rng)
    passage = " ".join(f"w{k}" for k in range(30))
    items = [("short", "w14"), *items, ("whole", passage), ("near", passage.replace("w20", "x20")), ("next", " ".join(f"v{k}" for k in range(12)))]
    docs += [(10_001, f"Before {passage}, after."), (10_002, f"é {passage.replace('w20', 'x20')} {items[-1][1]}\nend"), (10_003, None)]
    df, bench = with_clashes(docs), spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    want = {r.doc_id: r.text for r in fm_index.remove(df, bench).collect()}
    assert (want[10_001], want[10_002]) == ("Before , after.", "é \nend")
    for most in (1, 200):
        monkeypatch.setattr(fm_index, "BLOCK_WORDS", most)
        clean = fm_index.remove(df, bench if most > 1 else bench.where("item_id in ('short', 'whole', 'near', 'next')"))
        assert clean.schema == df.schema
        got = {r.doc_id: r.text for r in clean.collect()}
        assert got == want if most > 1 else all(got[k] == want[k] for k in (10_001, 10_002, 10_003))


def test_edges(spark, with_clashes, edges):
    bench = spark.createDataFrame([(1, "one"), (2, "a b"), (3, None)], "item_id long, text string")
    assert found(with_clashes(edges), bench) == expected(edges, [(1, "one"), (2, "a b"), (3, None)])
    assert {v[1] for v in found(with_clashes(edges), bench.limit(0)).values()} == {0}
    assert fm_index.occurrences(with_clashes(edges).limit(0), bench).count() == 0
    assert [r.text for r in fm_index.remove(with_clashes(edges), bench).orderBy("doc_id").collect()][:4] == [None, "", " \n\t ", ""]


def test_no_word_of_any_phrase(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert found(docs, bench) == {1: (3, 0, ()), 2: (0, 0, ())}


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([np.append(rng.integers(1, 5, rng.integers(1, 60)), 0) for _ in range(40)]).astype(np.int64)
    index = fm_index.FMIndex(symbols, 4)
    for n in (1, 2, 3, 7):
        phrases = np.zeros((30, 8), np.int64)
        phrases[:, :n] = rng.integers(1, 5, (30, n))
        low, high = index.search(phrases, np.full(30, n))
        for p, a, b in zip(phrases[:, :n], low, high, strict=True):
            want = [k for k in range(len(symbols) - n + 1) if (symbols[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_query_digest(spark):
    from orrery.llm import queries

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {i: (n, h, len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), h > 0) for i, (n, h, s) in expected(docs, items).items()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op4_fm_index"](spark, d).collect()}
    assert got == want


def test_words_of_long_and_broken_chunks():
    import pyarrow as pa

    texts = ["ab " * 10, "", None, "x" * 100, "é z", "a"]
    for most in (1, 7, 1 << 20):
        got = []
        for chunk in w.chunks(pa.array(texts), True, most):
            starts, ends, firsts = w.spans(chunk, w.SPACED)
            for a, b in zip(firsts[:-1], firsts[1:], strict=True):
                got.append([bytes(chunk.data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)])
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
