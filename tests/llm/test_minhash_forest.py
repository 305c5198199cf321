import random
import re

import numpy as np
import pytest

from orrery.llm import components, minhash_forest

from texts import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, percent=85):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def found(df, percent=85):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, percent=percent).collect()}


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def test_limits_follow_the_similarity():
    assert (minhash_forest.limits(85), minhash_forest.limits(80)) == ((4, 40), (3, 35))


@pytest.mark.parametrize("percent", [85, 80, 70])
def test_families_against_brute_force(spark, rng, percent):
    rows = [(k, prose(rng, rng.randint(1, 200))) for k in range(150)]
    for base in range(12):
        text = prose(rng, 150)
        rows += [(1000 + 100 * base + k, edited(rng, text, rng.randint(0, 6))) for k in range(25)]
    rows += [(5000 + k, rows[3][1]) for k in range(20)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), percent) == expected(rows, percent)


def test_one_dense_region_over_blocks(spark, monkeypatch):
    """A family larger than a block, with links that run through few documents."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 32)
    rng = random.Random(5)
    text = prose(rng, 120)
    rows = [(k, edited(rng, text, rng.randint(0, 9))) for k in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_crowded_regions(spark, monkeypatch):
    """Many documents that are alike and not linked, and some near copies: rows of the second round are linear, links are found."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 48)
    rng = random.Random(17)
    words = prose(rng, 160).split()

    def alike(k):  # seven other words: about 0.6 to 0.7 of the shingles are shared by two
        own = list(words)
        for at in rng.sample(range(160), 7):
            own[at] = f"{prose(rng, 1)}{k}"
        return own

    rows = [(k, alike(k)) for k in range(2000)]
    for n, source in enumerate(rng.sample(range(2000), 150)):
        near = list(rows[source][1])
        near[rng.randrange(160)] = f"q{n}"
        rows.append((10_000 + n, near))
    rows = [(k, " ".join(w)) for k, w in rows]
    made = []
    regions = minhash_forest.regions
    monkeypatch.setattr(minhash_forest, "regions", lambda *a: made.append(regions(*a)) or made[0])
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(156)} for i, t in rows}
    linked = [i for i, _ in rows if i >= 10_000]
    want = [next(j for j in range(2000) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in linked]
    right = sum(got[i][1] == j for i, j in zip(linked, want, strict=True))
    n_rows = made[0].count()
    print(f"links found {right} of {len(linked)}; {n_rows} rows in regions of {16 * len(rows)} in the forest; largest block", made[0].groupBy("bucket", "block").count().agg({"count": "max"}).first()[0])
    assert right >= 0.99 * len(linked)
    assert n_rows <= 2 * 16 * len(rows)
    assert sum(v[1] != i for i, v in got.items()) == right  # no others


def test_edges(spark, with_clashes, edges):
    rows = [*edges, (20, "w " * 3000), (21, "W " * 2999)]
    assert found(with_clashes(rows)) == expected(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash_forest.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert minhash_forest.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("nodes", [1_000_000, 10])
def test_components_of_long_paths(spark, monkeypatch, nodes):
    monkeypatch.setattr(components, "NODES", nodes)
    rng = np.random.default_rng(2)
    order = rng.permutation(400)
    links = [(int(order[k]), int(order[k + 1])) for k in range(299)] + [(int(order[k]), int(order[k + 1])) for k in range(301, 399)]
    df = spark.createDataFrame(links, "u long, v long").repartition(8)
    got = dict(tuple(r) for r in components.components(df).collect())
    one, two = sorted(order[:300].tolist()), sorted(order[301:400].tolist())
    assert got == {**dict.fromkeys(one[1:], one[0]), **dict.fromkeys(two[1:], two[0])}


@pytest.mark.parametrize("n", [0, 1])
def test_components_of_nothing(spark, n):
    assert components.components(spark.createDataFrame([(1, 1)] * n, "u long, v long")).count() == 0
