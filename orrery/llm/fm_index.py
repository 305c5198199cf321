"""Benchmark decontamination with an FM-index per training shard.

A shard is what a task holds at a time: an Arrow batch of documents, in parts of at most
``SHARD_WORDS`` indexed words.  Its words become symbols of the test phrases' alphabet; a
word in no phrase can be in no occurrence, so it only ends a run, and runs shorter than the
shortest phrase are left out.  Over the runs stand a Burrows-Wheeler transform in a wavelet
matrix, with ranks by popcount, and suffix positions at every ``SAMPLE``-th word and each
run's start.  All phrases are searched backwards at once, their occurrences located by steps
back to a sampled position, and overlapping ones merged to removal spans.

A phrase is a window of 10 consecutive words of an item, or a shorter item as a whole.

Scale: one pass over the documents without a shuffle; what is broadcast are the phrases, in
blocks of items of at most ``BLOCK_WORDS`` words (as many passes as blocks).  A passage that
a third of all documents hold is found in each document's own shard.

Edge cases: null and empty texts have no words and no hit; an item without words has no
phrase and occurs nowhere; equal items each count; no items, no hits; repeated rows are each
searched, a null id as any other; a text of any length is searched whole, a longer one than a
shard in an index of its own; an empty table has no rows.  ``occurrences`` looks at no other columns,
``remove`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .stages import lean, saved

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 4_000_000
SAMPLE = 8


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros((n >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class Wavelet:
    """A wavelet matrix over symbols below 2^levels."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each end."""
        at = [np.zeros_like(symbol), *ends]
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            for x, i in enumerate(at):
                r = bits.rank(i)
                at[x] = np.where(one, zeros + r, i - r)
        return [i - at[0] for i in at[1:]]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each 0 is a different symbol, smaller than all others, so runs that 0 ends stay short."""
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    key = symbols + (n_ends - 1)
    key[ends] = np.arange(n_ends)
    order = np.argsort(key)
    step = 1
    while True:
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:]
        step *= 2
        order = np.argsort(key)


class FMIndex:
    """Over runs of symbols from 1 up, each ended by a 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        order = suffix_order(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix; before the first, the last 0
        self.wavelet = Wavelet(self.last, max(1, int(alphabet).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        run_start = np.ones(len(symbols), bool)
        run_start[1:] = symbols[:-1] == 0
        sampled = run_start | (np.arange(len(symbols)) % SAMPLE == 0)
        self.sampled = Bits(sampled[order])
        self.positions = order[sampled[order]]
        self.is_sampled = sampled[order]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that begin with each phrase (a row of symbols, filled up behind its length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[low[live] < high[live]]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            symbol = phrases[now, lengths[now] - back]
            below, above = self.wavelet.rank(symbol, low[now], high[now])
            low[now], high[now] = self.smaller[symbol] + below, self.smaller[symbol] + above
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes in these rows, by steps back to a sampled one."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            here = rows[live]
            done = self.is_sampled[here]
            out[live[done]] = self.positions[self.sampled.rank(here[done])] + steps
            live, here = live[~done], here[~done]
            symbol = self.last[here]
            (before,) = self.wavelet.rank(symbol, here)
            rows[live] = self.smaller[symbol] + before
            steps += 1
        return out


@dataclass
class Phrases:
    """The distinct phrases of some items: words as hashes (sorted), phrases as rows of 1-based places among them."""

    vocabulary: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    items: list[tuple[int, ...]]  # of each phrase, as places in names
    names: list[str]


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    texts = pa.array([t for _, t in items], pa.string())
    found: dict[bytes, set[int]] = {}
    for chunk in w.chunks(texts, lower=True):
        starts, ends, firsts = w.spans(chunk, w.ALNUM)
        hashed = w.hashes(chunk.data, starts, ends)
        for r, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
            for k in range(a, max(a + 1, b - window + 1)) if b > a else ():
                found.setdefault(hashed[k : min(k + window, b)].tobytes(), set()).add(chunk.first + r)
    keys = list(found)
    lengths = np.array([len(k) // 8 for k in keys], np.int64)
    hashed = np.frombuffer(b"".join(keys), np.uint64)
    vocabulary = np.unique(hashed)
    rows = np.zeros((len(keys), window), np.int64)
    rows[np.arange(window) < lengths[:, None]] = np.searchsorted(vocabulary, hashed) + 1
    return Phrases(vocabulary, rows, lengths, [tuple(sorted(found[k])) for k in keys], [str(i) for i, _ in items])


def _search(symbols: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Position and phrase of each occurrence."""
    index = FMIndex(symbols, len(wanted.vocabulary))
    low, high = index.search(wanted.rows, wanted.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    return index.locate(rows), phrase


@dataclass
class Found:
    """Of the rows of a batch: their words, hit words as (row, word, first byte, end byte) columns in order, and (row, phrase) pairs."""

    n_words: np.ndarray
    hits: np.ndarray
    pairs: np.ndarray


def find(column: pa.Array, wanted: Phrases) -> Found:
    n_words = np.zeros(len(column), np.int64)
    hits, pairs = [np.zeros((4, 0), np.int64)], [np.zeros((0, 2), np.int64)]
    held: list[np.ndarray] = []
    size = 0
    shortest = int(wanted.lengths.min()) if len(wanted.lengths) else 0

    def flush() -> None:
        nonlocal held, size
        if size:
            table = np.concatenate(held, axis=1)  # row, word, first byte, end byte, symbol
            at, phrase = _search(table[4], wanted)
            cover = np.zeros(table.shape[1] + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + wanted.lengths[phrase], -1)
            hits.append(table[:4, np.cumsum(cover[:-1]) > 0])
            pairs.append(np.unique(np.stack([table[0, at], phrase], axis=1), axis=0))
        held, size = [], 0

    for chunk in w.chunks(column, lower=True):
        starts, ends, firsts = w.spans(chunk, w.ALNUM)
        n_words[chunk.first : chunk.last] = np.diff(firsts)
        if not shortest or not len(starts):
            continue
        hashed = w.hashes(chunk.data, starts, ends)
        symbol = np.searchsorted(wanted.vocabulary, hashed)
        symbol[symbol == len(wanted.vocabulary)] = 0
        symbol = np.where(wanted.vocabulary[symbol] == hashed, symbol + 1, 0)
        row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        # Runs of known words within a row.
        known = symbol > 0
        if not known.any():
            continue
        new = known.copy()
        new[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        run = np.cumsum(new) - 1
        lengths = np.bincount(run[known], minlength=int(new.sum()))
        kept = np.flatnonzero(known & (lengths[run] >= shortest))
        if not len(kept):
            continue
        ends_run = np.ones(len(kept), bool)
        ends_run[:-1] = run[kept[1:]] != run[kept[:-1]]
        place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(ends_run)[:-1]])
        part = np.zeros((5, len(kept) + int(ends_run.sum())), np.int64)
        first = firsts[:-1][row[kept]]
        base = chunk.bounds[row[kept]]
        part[:, place] = [row[kept] + chunk.first, kept - first, starts[kept] - base, ends[kept] - base, symbol[kept]]
        held.append(part)
        size += part.shape[1]
        if size >= SHARD_WORDS:
            flush()
    flush()
    return Found(n_words, np.concatenate(hits, axis=1), np.concatenate(pairs))


def _merged(found: Found) -> tuple[np.ndarray, np.ndarray]:
    """Spans of consecutive hit words: rows, and (first word, end word, first byte, end byte)."""
    row, word, first, end = found.hits
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(row)]]) - 1 if len(a) else a
    return row[a], np.stack([word[a], word[b] + 1, first[a], end[b]], axis=1)


SPAN = "array<struct<first_word: long, end_word: long, first_byte: long, end_byte: long>>"


def _report(wanted_b, names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Phrases = wanted_b.value
        for batch in lean(batches):
            if not batch.num_rows:
                continue
            column = batch.column(text_at)
            found = find(column, wanted)
            rows, spans = _merged(found)
            n = batch.num_rows
            n_hit = np.bincount(found.hits[0], minlength=n)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array(spans[:, k]) for k in range(4)], ["first_word", "end_word", "first_byte", "end_byte"])
            items: list[list[str]] = [[] for _ in range(n)]
            if len(found.pairs):
                by_row: dict[int, set[int]] = {}
                for r, p in found.pairs.tolist():
                    by_row.setdefault(r, set()).update(wanted.items[p])
                for r, places in by_row.items():
                    items[r] = [wanted.names[k] for k in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.n_words), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(offsets), span), pa.array(items, pa.list_(pa.string()))],
                names,
            )

    return run


def _joined(rows: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of several blocks' spans those of a row that overlap or touch become one; in order."""
    order = np.lexsort((spans[:, 0], rows))
    rows, spans = rows[order], spans[order]
    own = rows << 32  # words and bytes of a row are fewer
    end, end_byte = (np.maximum.accumulate(spans[:, k] + own) for k in (1, 3))
    new = np.ones(len(rows), bool)
    new[1:] = spans[1:, 0] + own[1:] > end[:-1]
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(rows)]]) - 1 if len(a) else a
    return rows[a], np.stack([spans[a, 0], end[b] - own[b], spans[a, 2], end_byte[b] - own[b]], axis=1)


def _removal(wanted_b, names: list[str], text_at: int, first: bool, last: bool):
    """A pass of remove(): the block's spans are added to those of the passes before, in a column behind the others; the last pass cuts them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Phrases = wanted_b.value
        for batch in lean(batches):
            n = batch.num_rows
            if not n:
                continue
            columns = list(batch.columns)
            rows, spans = _merged(find(columns[text_at], wanted))
            if not first:
                earlier = columns.pop().to_pylist()
                rows = np.concatenate([np.repeat(np.arange(n), [len(e) // 32 for e in earlier]), rows])
                spans = np.concatenate([np.frombuffer(b"".join(earlier), np.int64).reshape(-1, 4), spans])
                rows, spans = _joined(rows, spans)
            if last:
                texts = columns[text_at].to_pylist()
                cuts: dict[int, list[np.ndarray]] = {}
                for r, s in zip(rows.tolist(), spans, strict=True):
                    cuts.setdefault(r, []).append(s)
                for r, parts in cuts.items():
                    raw, at, left = texts[r].encode(), 0, []
                    for s in parts:
                        left.append(raw[at : s[2]])
                        at = s[3]
                    texts[r] = b"".join([*left, raw[at:]]).decode()
                columns[text_at] = pa.array(texts, pa.string())
            else:
                at = np.searchsorted(rows, np.arange(n + 1))
                columns.append(pa.array([spans[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Phrases]:
    """The phrases of the items, read in blocks of about BLOCK_WORDS words; a block is all that the driver holds."""
    held, size = [], 0
    rows = benchmark.select(benchmark[item], benchmark[text].cast("string")).toLocalIterator()
    for name, words in rows:
        held.append((name, words))
        size += len(words or "") // 2 + 1
        if size >= BLOCK_WORDS:
            yield phrases(held, window)
            held, size = [], 0
    if held:
        yield phrases(held, window)


def occurrences(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (merged, of words and UTF-8 bytes) and items (names, unordered) of each row."""
    spark = docs.sparkSession
    names = ["doc_id", "n_words", "n_hit", "spans", "items"]
    docs = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark, item, item_text, window)]  # the driver holds one at a time
    blocks = blocks or [spark.sparkContext.broadcast(phrases([]))]
    schema = f"doc_id {kind}, n_words long, n_hit long, spans {SPAN}, items array<string>"
    if len(blocks) == 1:
        return docs.mapInArrow(_report(blocks[0], names, 1), schema)
    docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # the same rows in every pass
    found = []
    for block in blocks:
        run = _report(block, ["row", *names[1:]], 1)
        found.append(docs.select("row", "text").mapInArrow(run, schema.replace(f"doc_id {kind}", "row long")))
    parts = found[0]
    for more in found[1:]:
        parts = parts.union(more)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        spans,
        F.array().cast(SPAN),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end_word"] >= s["first_word"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(
                    F.try_element_at(acc, F.lit(-1))["first_word"].alias("first_word"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["end_word"], s["end_word"]).alias("end_word"),
                    F.try_element_at(acc, F.lit(-1))["first_byte"].alias("first_byte"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["end_byte"], s["end_byte"]).alias("end_byte"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    parts = parts.groupBy("row").agg(F.first("n_words").alias("n_words"), merged.alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])
    return docs.select("row", "doc_id").join(parts, "row").select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def remove(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """All rows and columns of ``docs``; from the texts, every merged span is cut from its first word's start to its last word's end.

    Each block is searched in the texts as given, and all are cut at once, so the result doesn't depend on the blocks.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark, item, item_text, window)]
    schema, names, text_at = docs.schema, docs.columns, docs.columns.index(text)
    extra = "_spans" + "_" * max(map(len, names))
    for k, block in enumerate(shared):
        last = k == len(shared) - 1
        out = schema if last else T.StructType([*schema.fields, T.StructField(extra, T.BinaryType())])
        docs = docs.mapInArrow(_removal(block, names if last else [*names, extra], text_at, k == 0, last), out)
    return docs
