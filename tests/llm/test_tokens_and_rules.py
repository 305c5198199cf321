import hashlib
import heapq
import re
import textwrap
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import huffman_files, license_rules, sharding, stages, trie_bpe, url_rules

SF = "/root/testdata/sf0.01"
MIXED = "aAbetthingheéÉßΣσς İı'’ ́ \x1c\x85 \n\t12９٣!*.-_</w>|é日本語한ﬁÅÅ👍🏽‍İǄ "


def texts_of(spark, rng):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    rows += ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    return rows + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>x", "", "don't I'll WE'VE", "thethe" * 50, "a" * 3000, " lead", "tail ", "  two", " \n", "\n\n"]


def test_trie_bpe_against_the_library(spark, rng):
    path = stages.tokenizer_path("word_bpe_49k.json")
    texts = texts_of(spark, rng)
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    vocabulary = trie_bpe.vocabulary(path)
    for cache in (16, 100_000):
        encoder = trie_bpe.Encoder(vocabulary, cache)
        got = [x for k in range(0, len(texts), 500) for x in encoder.encode(texts[k : k + 500])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    for x, ids in zip(got, want, strict=True):
        assert trie_bpe.decode(x, vocabulary.names) == library.decode(ids, skip_special_tokens=False)


def test_trie_shares_prefixes():
    vocabulary = trie_bpe.vocabulary(stages.tokenizer_path("word_bpe_49k.json"))
    words = [b"thing", b"things", b"thin", b"t", b"th", b"zebra"]
    together = vocabulary.encode_words(words)
    assert together == {x: vocabulary.encode_words([x])[x] for x in words}


def test_trie_query_edges(spark, with_clashes, edges):
    path = stages.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = trie_bpe.encode(with_clashes(edges), path).collect()
    for r in rows:
        ids = library.encode(dict(edges)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))
    digest = {r.doc_id: r for r in trie_bpe.digests(with_clashes(edges), path, with_ids=True).collect()}
    assert all(digest[r.doc_id].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and digest[r.doc_id]["ids"] == r.ids for r in rows)
    assert trie_bpe.encode(with_clashes(edges).limit(0), path).count() == 0


def test_code_lengths_are_limited_and_least():
    for n in (1, 2, 3, 7, 300):
        counts = np.random.default_rng(n).integers(0, 50, n) ** 2 + (np.arange(n) % 3 > 0)
        counts[0] = 1
        free = huffman_files.code_lengths(counts, 40)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = sum(heap) if len(heap) == 1 else 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((counts * free).sum()) == cost
        tight = huffman_files.code_lengths(counts, 10)
        assert tight.max() <= 10 and (0.5 ** tight[tight > 0]).sum() <= 1 and ((tight > 0) == (counts > 0)).all()


def test_blocks_decode_from_checkpoints():
    rng = np.random.default_rng(8)
    ids = (rng.zipf(1.3, 50_000) % 3000).astype(np.int64)
    code = huffman_files.Code(huffman_files.code_lengths(np.bincount(ids)))
    cuts = [0, 0, 1, 5, 300, 20_000, 20_256, len(ids)]
    blocks = [(*code.encode(ids[a:b]), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for got, a, b in zip(code.decode(blocks), cuts[:-1], cuts[1:], strict=True):
        assert got.tolist() == ids[a:b].tolist()


def test_piecewise_encoding_against_the_library(spark, rng):
    path = stages.tokenizer_path("byte_bpe_50k.json")
    texts = texts_of(spark, rng)
    encoder = huffman_files.Encoder(path, 0, cache=1000)
    got = [x for k in range(0, len(texts), 500) for x in encoder.encode(texts[k : k + 500])]
    want = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == want


def test_files_round_trip(spark, with_clashes, edges, monkeypatch):
    path = stages.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*edges, *[(100 + k, f"word {k} " * (k % 40)) for k in range(300)], (50, "same"), (50, "same")]
    monkeypatch.setattr(huffman_files, "BLOCK_IDS", 500)
    docs = with_clashes(rows).repartition(7)
    got = sorted(huffman_files.read(spark, huffman_files.write(docs, path)).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    for r in got:
        ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert huffman_files.read(spark, huffman_files.write(docs.limit(0), path)).count() == 0


def test_long_documents_are_cut(spark, monkeypatch):
    path = stages.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(huffman_files, "BLOCK_IDS", 64)
    rows = [(1, "a few"), (2, "many words here " * 200), (3, "x " * 64), (4, None), (5, "more words " * 32), (5, "more words " * 32), (None, "no id " * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = huffman_files.write(docs, path)
    assert spark.read.parquet(f"{folder}/blocks").selectExpr("max(aggregate(lengths, 0L, (a, x) -> a + x))").first()[0] <= 128
    got = sorted(huffman_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5]
    by_id, start = dict(rows), 0
    for r in got:
        ids = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    short = sorted(huffman_files.read(spark, folder, with_ids=False).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in short] == [tuple(r)[:4] for r in got]


def test_crc_of_both(rng):
    for _ in range(200):
        one, two = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 5000))
        assert huffman_files._crc_of_both(zlib.crc32(one), zlib.crc32(two), len(two)) == zlib.crc32(one + two)


def test_words_of_the_byte_level_pre_tokenizer(rng):
    path = stages.tokenizer_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), huffman_files.Encoder(path, 0, cache=200)
    alphabet = [chr(k) for k in range(0x560)] + list(" \n\t'a stmdrevl1.") * 60
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [x for k in range(0, len(texts), 300) for x in encoder.encode(texts[k : k + 300])]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == want


def test_sharding_is_even_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs, 16).collect()
    sizes = np.bincount([r.shard for r in rows], [r["size"] for r in rows])
    assert len(rows) == 1000 and sizes.max() - sizes.min() <= 0.01 * sizes.mean()
    for s in range(16):
        assert sorted(r.position for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_edges(with_clashes, edges):
    df = with_clashes([*edges, (4, "one"), (None, "x")])
    rows = sharding.shard(df, 4).collect()
    assert len(rows) == len(edges) + 2 and {r["size"] for r in rows if r.text is None} == {1}
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_sharding_keeps_columns_of_any_names(spark):
    rows = [(k, "t" * k, "old", 7, 8, "w", "b", 9) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, position int, virtual_slot int, within string, before string, size int")
    out = sharding.shard(df, 3)
    assert sorted(out.columns) == sorted(df.columns)
    for r in out.select("shard", "position", "within", "before", "size", "text").collect():
        assert r.shard in (0, 1, 2) and (r.within, r.before, r["size"]) == ("w", "b", len(r.text) + 1)


def test_sharding_spreads_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, f"text {k}") for k in range(600)], "doc_id long, text string")
    rows = sharding.shard(df, 4).collect()
    counts = np.bincount([r.shard for r in rows], minlength=4)
    assert len(rows) == 600 and counts.min() > 120


def test_maps_are_versions_and_edits_are_small(spark, tmp_path):
    rng = np.random.default_rng(1)
    weights = {k: (int(rng.integers(1, 1000)), 1) for k in range(0, 512, 1)}
    first = sharding.assign(weights, 8, 512)
    more = sharding.rebalance(first, weights, 9)
    moved = [k for k in first if first[k] != more[k]]
    loads = np.bincount(list(more.values()), [weights[k][0] for k in more])
    assert len(moved) <= 1.3 * 512 / 9 and sum(more[k] == 8 for k in moved) >= 0.6 * len(moved)
    assert loads.max() - loads.min() <= 0.02 * loads.mean()
    fewer = sharding.rebalance(more, weights, 8)
    assert set(fewer.values()) == set(range(8))
    folder = tmp_path.as_uri() + "/maps"
    for version, m in ((1, first), (2, more)):
        sharding.store_map(sharding.map_table(spark, version, m, weights), folder)
    assert {r.slot: r.shard for r in sharding.load_map(spark, folder).collect()} == more
    assert {r.slot: r.shard for r in sharding.load_map(spark, folder, 1).collect()} == first


def plain_verdict(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h.count("."), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.mark.parametrize("block", [50_000, 3])
def test_url_rules_against_brute_force(spark, rng, block):
    labels = ["com", "net", "a", "b", "www", "example", "a-b"]
    names = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/", "/e"]
    rules = list({(h, p): (v, h, p) for v, h, p in ((rng.choice(["allow", "block"]), names(), rng.choice(paths)) for _ in range(40))}.values())
    urls = [f"http://{names()}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x', 'y', '/'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/En/", "x://a://b/", "http://com?x://y/", urls[0], urls[0], "http://é.com/\n/en/"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, rules, block_rules=block).collect()}
    assert got == {k: plain_verdict(u, rules) for k, u in enumerate(urls)}


def test_url_rules_edges(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in url_rules.judge(df, df.sparkSession.createDataFrame([], "verdict string, host string, path string")).collect()] == ["allow"] * 2
    assert url_rules.judge(df.limit(0)).count() == 0
    assert [r.rule for r in url_rules.judge(df).collect()] == ["com/"] * 2


def scan(spark, rows, **rest):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.licenses for r in license_rules.scan(df, **rest).collect()}


def test_license_rules(spark):
    apache = license_rules.RULES[5][1]
    mit = license_rules.RULES[3][1]
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore"),
        (2, "RELEASED under   the mit license!"),
        (3, "He said it was released under the MIT License."),
        (4, "no stop before\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (5, "X. " + ".\n ".join(apache).replace("use this", "use\nthis") + "."),
        (6, ". ".join(apache[::-1]) + "."),
        (7, "Copyright 2020. " + ". ".join(mit) + ". " + "x " * 500),
        (8, mit[0] + ". " + "other words " * 60 + ". " + mit[1] + "."),
        (9, None),
        (10, ""),
    ]
    got = scan(spark, rows)
    assert got == {1: ["MIT"], 2: ["MIT"], 3: [], 4: ["Apache-2.0", "CC-BY-NC-4.0"], 5: ["Apache-2.0"], 6: [], 7: ["MIT"], 8: [], 9: [], 10: []}


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
""",
    "Apache-2.0": """Copyright 2020 Some Body

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "GPL-3.0-or-later": """A program
    Copyright (C) 2020  Some Body

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """A program
    Copyright (C) 2020  Some Body

    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "MPL-2.0": """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "BSD": """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
""",
    "ISC": """Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.
""",
}


def test_rules_are_found_in_wrapped_notices(spark):
    names = list(NOTICES)
    docs = list(enumerate(NOTICES.values()))
    docs += [(100 + k, t.replace("\n", "\r\n")) for k, t in docs]
    got = scan(spark, docs)
    assert got == {k: [names[k % 100]] for k, _ in docs}
    wrapped = [(k, "A title\n\n" + textwrap.fill(". ".join(texts) + ".", 50) + "\n\nMore words") for k, (_, texts) in enumerate(license_rules.RULES)]
    got = scan(spark, wrapped)
    assert got == {k: [name] for k, (name, _) in enumerate(license_rules.RULES)}


def test_versions_end_no_sentence(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
    rows = [(1, mpl), (2, f"Words\n{mpl}.\nWords"), (3, mpl.replace("v. ", "v.\n")), (4, mpl.replace("v. 2.0", "v. x")), (5, mpl.replace("License, v", "License. V"))]
    got = scan(spark, rows)
    assert {k for k, v in got.items() if v == ["MPL-2.0"]} == {1, 2, 3} and not got[4] and not got[5]


def test_license_edges(with_clashes, edges):
    assert all(r.licenses == [] and r.matches == [] for r in license_rules.scan(with_clashes(edges)).collect())
    assert license_rules.scan(with_clashes(edges).limit(0)).count() == 0


def plain_licenses(text, rules, gap=license_rules.MAX_GAP):
    """Names of the rules found, by cutting the text at separators between words in each of the three ways."""
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    words = [m.group() for m in found]
    between = [text[a.end() : b.start()] for a, b in zip(found, found[1:])]
    known = set()
    for way in range(3):
        first = 0
        for k in range(len(words)):
            sep = between[k] if k < len(between) else None
            stops = len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r])", sep or ""))
            version = sep is not None and words[k] == "v" and sep[:1] == "." and words[k + 1][0] in "0123456789"
            cut = sep is None or stops > version or way == 1 and "\n" in sep or way == 2 and (sep.count("\n") > 1 or "\n" in sep and ":" in sep)
            if cut:
                known.add((first, k + 1, " ".join(words[first : k + 1])))
                first = k + 1
    normal = lambda t: " ".join(re.findall(r"[0-9a-z]+", t.lower()))
    matches = []
    for name, sentences in rules:
        wanted = [normal(t) for t in sentences]
        for a, end, sentence in known:
            if sentence == wanted[0]:
                for t in wanted[1:]:
                    ends = [(x, y) for x, y, z in known if z == t and end <= x <= end + gap]
                    end = min(ends)[1] if ends else None
                    if end is None:
                        break
                if end is not None:
                    matches.append((a, end, name))
    return sorted({n for a, b, n in matches if not any(x <= a and b <= y and (x, y) != (a, b) for x, y, _ in matches)})


def test_licenses_against_brute_force(spark, rng):
    rules = license_rules.RULES
    pool = [s for _, sentences in rules for s in sentences]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            name, sentences = rng.choice(rules)
            if kind < 0.5:
                parts += [x + rng.choice([". ", ".\n", ".\n\n", ":\n", " \n", "! "]) for x in sentences]
            elif kind < 0.7:
                parts += [rng.choice(pool) + ". ", rng.choice(sentences) + ". "]
            else:
                parts.append(f"Some {rng.choice(['short', 'longer ' * rng.randint(1, 60)])} prose v. 2.0 here{rng.choice(['. ', ', ', chr(10)])}")
        text = "".join(parts)
        texts.append("\n".join(textwrap.wrap(text, 60)) if rng.random() < 0.3 else text)
    rows = list(enumerate([*texts, None, ""]))
    got = scan(spark, rows)
    wrong = [(t, got[k], plain_licenses(t, rules)) for k, t in rows if got[k] != plain_licenses(t, rules)]
    assert not wrong, wrong[0]
    assert len({x for names in got.values() for x in names}) >= 12
