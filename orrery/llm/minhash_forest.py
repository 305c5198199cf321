"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct 5-word shingles (of fewer words, the whole sequence).
Documents with equal sets form a class, and one document stands for it from then on.  A
signature has a byte of each of 64 minima.  The forest is 16 sorted orders of the signatures,
the t-th beginning with the t-th four bytes.  Candidates come in two rounds, and are confirmed
on full sets and merged to components after each:

1. In each order, neighbours (a signature has its longest common prefix with one of its two)
   that share the first bytes.
2. In each order, the signatures of a region, all of one prefix, that are in different
   components.  One with more than ``BLOCK`` signatures outside its largest component is divided by
   longer prefixes (``DEPTHS``) until it has no more.  The largest component is dealt out in
   blocks, and each block meets all the others.

How many first bytes are shared at least, and in how many of 64 bytes a pair must agree to be
confirmed, follows from the similarity asked for: at 0.85 four and 40, at 0.8 three and 35.

Recall: a pair at the threshold agrees in too few bytes, or shares the first bytes in none of the
orders, with probability of about 1e-5 (closer ones with less).  At 0.85, if its regions are
crowded in all orders, so that five, six, seven, eight or ten bytes have to agree, it is missed
with 0.0003, 0.002, 0.009, 0.023 or 0.10, unless neighbours or links over third documents bring it
back (simulated; what is left over in a crowded region is measured in the tests).

Scale: the shuffles are the signatures once (to class representatives), 16 rows of 73 bytes a
class (range-partitioned, with the id as tiebreak, so no key is hot), and full sets of those
documents only that have a candidate.  In a region of n signatures the second round makes at most
2 n rows, and compares a signature with 2 ``BLOCK`` others at most, unless all 64 bytes are
equal, where blocks are dealt by hash and not compared with each other.  Copies never meet in
one task: classes are grouped with partial aggregation, and classes of more than ``HOT_COPIES``
rows are joined back by broadcast (there are at most that many times fewer of them than rows).

Edge cases: null and empty texts have no shingles and link with nothing; repeated rows are
copies; a null id is never a representative; ties of ids are of repeated rows, which are all
kept if their id is the smallest; a text of any length is one set; an empty table has no rows.
Columns other than the key and the text are not looked at, so their names may clash with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .components import Sets, components
from .stages import lean, saved, slices, small

SHINGLE = 5
PERCENT = 80
MINIMA = 64
TREES = 16
#: With what probability a pair at the threshold may share too few first bytes in all orders, and how many standard deviations fewer bytes than expected it may agree in.
MISSED = 2e-5
DEVIATIONS = 5
BLOCK = 256
#: Bytes of the prefixes that divide crowded regions.
DEPTHS = (4, 5, 6, 7, 8, 10, 12, 16, 24, 64)
#: Rows of one class that are still joined by a shuffle.
HOT_COPIES = 10_000
#: Ids of 8 bytes that are broadcast at most; beyond that the join is a shuffled one.
BROADCAST_IDS = 4_000_000
#: Pairs whose signatures are compared at a time.
PAIRS = 50_000
#: Regions, likewise.
BROADCAST_BUCKETS = 1_000_000

_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xA5A5F00D12345678)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[w.Chunk, np.ndarray, np.ndarray]]:
    """Each chunk's distinct shingle hashes, sorted within rows, and where each row's begin (one more entry ends the last)."""
    for chunk in w.chunks(column, lower=True):
        starts, ends, firsts = w.spans(chunk, w.SPACED)
        hashed = w.hashes(chunk.data, starts, ends)
        values, begins = w.grams(hashed, firsts, size)
        n_words = np.diff(firsts)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(short):
            whole = np.array([_fold(hashed[firsts[r] : firsts[r + 1]]) for r in short], np.uint64)
            values = np.insert(values, begins[short], whole)
            counts = np.diff(begins)
            counts[short] = 1
            begins = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            values[a:b].sort()
        keep = np.ones(len(values), bool)
        keep[1:] = values[1:] != values[:-1]
        keep[begins[:-1][np.diff(begins) > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield chunk, values[keep], kept[begins]


def _fold(hashed: np.ndarray) -> int:
    total = len(hashed)
    for x in hashed.tolist():
        total = (total * 0xD6E8FEB86659FD93 + x) & 0xFFFFFFFFFFFFFFFF
    return int(w.mix(np.array([total], np.uint64))[0])


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for chunk, values, begins in _sets(batch.column(1), size):
                counts = np.diff(begins)
                full = np.flatnonzero(counts)
                signature = np.zeros((len(counts), MINIMA), np.uint8)
                one, two = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                if len(full):
                    at = begins[:-1][full]
                    for k, factor in enumerate(_FACTORS):
                        signature[full, k] = (np.minimum.reduceat(values * factor, at) >> np.uint64(20)).astype(np.uint8)
                    one[full] = np.add.reduceat(w.mix(values), at)
                    two[full] = np.add.reduceat(w.mix(values ^ _SECOND), at)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(np.arange(0, (len(counts) + 1) * MINIMA, MINIMA, dtype=np.int32)), pa.py_buffer(signature)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(counts)), pa.array(counts), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), packed],
                    ["doc_id", "n_shingles", "one", "two", "signature"],
                )

    return run


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, one, two (a 128-bit hash of the set) and signature of each row."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        _features(size), "doc_id long, n_shingles long, one long, two long, signature binary"
    )


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for chunk, values, begins in _sets(batch.column(1), size):
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(begins) - 1), lists], ["rep", "shingles"])

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """rep, shingles of the documents whose ids are in the column ``rep`` of ids."""
    docs = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    docs = docs.join(small(ids.select("rep").distinct(), BROADCAST_IDS), "rep", "left_semi")
    sets = docs.mapInArrow(_shingles(size), "rep long, shingles array<long>")
    return saved(sets, "sets")


def _rows(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix of bytes."""
    column = column.cast(pa.binary())
    n = len(column)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4)
    return np.frombuffer(values, np.uint8)[offsets[0] : offsets[n]].reshape(n, -1)


def limits(percent: int) -> tuple[int, int]:
    """How many first bytes candidates share, and in how many bytes of all they agree."""
    p = percent / 100
    floor = max(f for f in range(1, MINIMA // 4) if f == 1 or (1 - p**f) ** TREES <= MISSED)
    return floor, max(1, int(MINIMA * p - DEVIATIONS * (MINIMA * p * (1 - p)) ** 0.5))


def _neighbours(floor: int, least: int):
    return lambda batches: _neighbours_of(batches, floor, least)


def _neighbours_of(batches: Iterator[pa.RecordBatch], floor: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: rows with a neighbour of the same tree and first bytes, and the next one if the two agree.

    The partition's first and last rows are kept as well, as their neighbours are elsewhere.
    """

    def out(labels, reps, share, nexts, keep):
        n = int(keep.sum())
        packed = np.ascontiguousarray(labels[keep])
        width = labels.shape[1]
        offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                pa.array(reps[keep]),
                pa.array(nexts[keep], mask=nexts[keep] == np.iinfo(np.int64).min),
            ],
            ["label", "rep", "next"],
        )

    none = np.iinfo(np.int64).min
    labels, reps, before = None, None, True
    for batch in lean(batches):
        if not batch.num_rows:
            continue
        more, ids = _rows(batch.column(0)), batch.column(1).to_numpy()
        labels = more if labels is None else np.concatenate([labels, more])
        reps = ids if reps is None else np.concatenate([reps, ids])
        if len(reps) < 2:
            continue
        equal = labels[1:] == labels[:-1]
        share = equal[:, : floor + 1].all(axis=1)
        agree = share & (equal[:, 1:].sum(axis=1) >= least)
        nexts = np.where(agree, reps[1:], none)
        keep = share.copy()
        keep[1:] |= share[:-1]
        keep[0] |= before
        yield out(labels[:-1], reps[:-1], share, nexts, keep)
        before = bool(share[-1])
        labels, reps = labels[-1:], reps[-1:]
    if reps is not None:
        yield out(labels, reps, None, np.full(len(reps), none), np.ones(len(reps), bool))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches in which each key, of the first columns of a sorted partition, is whole."""
    held: list[pa.RecordBatch] = []
    for batch in lean(batches):
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[-1] for k in range(n_keys)]
        cut = batch.num_rows - 1
        while cut > 0 and all(batch.column(k)[cut - 1] == last[k] for k in range(n_keys)):
            cut -= 1
        if cut == 0:
            if all(held[0].column(k)[0] == last[k] for k in range(n_keys)):
                continue
            whole, held = held[:-1], held[-1:]
            # an earlier batch may end with the same key
            tail = whole[-1]
            back = tail.num_rows
            while back > 0 and all(tail.column(k)[back - 1] == last[k] for k in range(n_keys)):
                back -= 1
            held = [tail.slice(back), *held]
            whole = [*whole[:-1], tail.slice(0, back)]
        else:
            whole, held = [*held[:-1], batch.slice(0, cut)], [batch.slice(cut)]
        merged = pa.Table.from_batches(whole).combine_chunks()
        if merged.num_rows:
            yield merged.to_batches()[0]
    if held:
        merged = pa.Table.from_batches(held).combine_chunks()
        if merged.num_rows:
            yield merged.to_batches()[0]


def _bounds(batch: pa.RecordBatch) -> np.ndarray:
    """Where runs of equal (bucket, block) begin, and the end."""
    buckets, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()  # prefixes may differ in length
    codes = {x: k for k, x in enumerate(dict.fromkeys(buckets))}
    bucket = np.array([codes[x] for x in buckets], np.int64)
    new = np.ones(batch.num_rows + 1, bool)
    new[1:-1] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
    return np.flatnonzero(new)


def _pairs(labels: np.ndarray, comps: np.ndarray, shared: np.ndarray, block: int, least: int) -> np.ndarray:
    """Which pairs of rows of a block, lower row first, are in different components and agree; two that all blocks have meet in the first."""
    n = len(labels)
    apart = (comps[:, None] != comps[None, :]) & np.tri(n, n, -1, bool).T
    if block:
        apart &= ~(shared[:, None] & shared[None, :])
    a, b = np.nonzero(apart)
    live = np.zeros((n, n), bool)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        ok = (labels[x, 1:] == labels[y, 1:]).sum(axis=1) >= least
        live[x[ok], y[ok]] = True
    return live


def _live(least: int):
    return lambda batches: _live_of(batches, least)


def _live_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that have a candidate."""
    for batch in _runs(batches, 2):
        bounds = _bounds(batch)
        labels, comps, shared = _rows(batch.column(3)), batch.column(5).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        block = batch.column(1).to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        sizes = np.diff(bounds)
        two = bounds[:-1][(sizes == 2)]
        close = (comps[two] != comps[two + 1]) & ((labels[two, 1:] == labels[two + 1, 1:]).sum(axis=1) >= least)
        close &= (block[two] == 0) | ~(shared[two] & shared[two + 1])
        keep[two[close]] = keep[two[close] + 1] = True
        for at in np.flatnonzero(sizes > 2):
            a, b = bounds[at], bounds[at + 1]
            live = _pairs(labels[a:b], comps[a:b], shared[a:b], int(block[a]), least)
            keep[a:b] = live.any(axis=0) | live.any(axis=1)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _confirm(percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2):
            bounds = _bounds(batch)
            labels, comps, shared = _rows(batch.column(3)), batch.column(5).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            reps, block = batch.column(4).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(6)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            us, vs = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                live = _pairs(labels[a:b], comps[a:b], shared[a:b], int(block[a]), least)
                sets = Sets()
                for x in np.flatnonzero(live.any(axis=1)):
                    own = values[offsets[a + x] : offsets[a + x + 1]]
                    for y in np.flatnonzero(live[x]):
                        if sets.root(int(comps[a + x])) == sets.root(int(comps[a + y])):
                            continue
                        other = values[offsets[a + y] : offsets[a + y + 1]]
                        low, high = (own, other) if len(own) <= len(other) else (other, own)
                        if 100 * len(low) < percent * len(high):
                            continue
                        at = np.searchsorted(high, low)
                        at[at == len(high)] = 0
                        common = int((high[at] == low).sum())
                        if 100 * common >= percent * (len(low) + len(high) - common):
                            sets.join(int(comps[a + x]), int(comps[a + y]))
                            us.append(int(reps[a + x]))
                            vs.append(int(reps[a + y]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; other columns of ``docs`` are not looked at."""
    spark = docs.sparkSession
    floor, least = limits(percent)
    feats = saved(features(docs, key, text, size), "features")
    classes = (
        feats.where("n_shingles > 0")
        .groupBy("n_shingles", "one", "two")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    )
    classes = saved(classes.where("rep is not null"), "classes")

    step = MINIMA // TREES
    labels = [
        F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("signature", t * step + 1, MINIMA), F.substring("signature", 1, t * step) if t else F.lit(b""))
        for t in range(TREES)
    ]
    forest = classes.select("rep", F.explode(F.array(*labels)).alias("label")).select("label", "rep")
    forest = forest.repartitionByRange(slices(spark), "label", "rep").sortWithinPartitions("label", "rep")
    dense = saved(forest.mapInArrow(_neighbours(floor, least), "label binary, rep long, next long"), "forest")

    pairs = dense.where("next is not null").select(F.least("rep", "next").alias("u"), F.greatest("rep", "next").alias("v")).distinct()
    pairs = saved(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("rep")).union(pairs.select("v"))
    sets = shingle_sets(docs, ids, key, text, size)
    common = F.size(F.array_intersect("a", "b")).cast("long")
    links = (
        pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
        .where(100 * common >= percent * (F.size("a") + F.size("b") - common))
        .select("u", "v")
    )
    merged = components(links)

    dense = dense.select("label", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    dense = saved(dense.select("label", "rep", F.coalesce("component", "rep").alias("comp")), "dense")
    keys = ["bucket", "block"]
    rest = regions(dense, floor).repartition(slices(spark), *keys).sortWithinPartitions(*keys, "rep")
    rest = saved(rest.mapInArrow(_live(least), rest.schema), "rest")
    sets = shingle_sets(docs, rest, key, text, size)
    whole = rest.join(sets, "rep").select(*rest.columns, "shingles")
    whole = whole.repartition(slices(spark), *keys).sortWithinPartitions(*keys, "rep")
    more = saved(whole.mapInArrow(_confirm(percent, least), "u long, v long"), "links")  # a task has one Python worker at a time
    merged = components(merged.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    found = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.where("copies > 1 or component is not null").select(
        "n_shingles", "one", "two", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    feats, found, of = feats.drop("signature"), saved(found, "found"), ["n_shingles", "one", "two"]
    hot = F.broadcast(found.where(F.col("copies") > HOT_COPIES).drop("copies"))
    rare = found.where(F.col("copies") <= HOT_COPIES).drop("copies")
    full, none = feats.where("n_shingles > 0"), feats.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long"))
    out = full.join(hot, of).unionByName(full.join(hot, of, "left_anti").join(rare, of, "left")).unionByName(none)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def regions(dense: DataFrame, floor: int) -> DataFrame:
    """bucket, block, shared, label, rep, comp: the rows (label, rep, comp) of all regions with several components, in blocks.

    ``shared`` rows, those outside the region's largest component, are in each of its blocks.
    """
    parts = []
    for depth in (floor, *[d for d in DEPTHS if d > floor]):
        keyed = dense.withColumn("bucket", F.substring("label", 1, depth + 1))
        groups = keyed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        groups = groups.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"))
        others = F.col("n") - F.col("top.n")
        crowded = (others > BLOCK) & F.lit(depth < DEPTHS[-1])
        plan = groups.where("comps > 1").select(
            "bucket",
            F.col("top.comp").alias("top"),
            F.when(others > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("top.n") / BLOCK))).cast("int").alias("blocks"),
            crowded.alias("crowded"),
            (others <= BLOCK).alias("meets"),
        )
        plan = saved(plan, "regions")
        rows = keyed.join(small(plan, BROADCAST_BUCKETS), "bucket")
        shared = F.col("meets") & (F.col("comp") != F.col("top"))
        dealt = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
        placed = rows.where("not crowded").withColumn("shared", shared)
        placed = placed.withColumn("block", F.explode(F.when(F.col("shared"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(dealt))))
        parts.append(placed.select("bucket", "block", "shared", "label", "rep", "comp"))
        if plan.where("crowded").isEmpty():
            break
        dense = saved(rows.where("crowded").select("label", "rep", "comp"), "crowded")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
