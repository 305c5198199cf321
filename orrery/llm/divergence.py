"""Quality rules by distribution divergence.

Each document has a histogram of character classes and one of common words.  A language's
reference is the sum of both over all its documents that the base rules let pass.  A document is held against every
reference by Jensen-Shannon distance (base 2, so 0 to 1) and judged by the nearest; the
label of its own language is not used for that.  A histogram of n counts lies off its own
distribution by about 1/sqrt(n), so the limits have a fixed part and one that shrinks with
length.  Guards: with fewer than ``MIN_CHARS`` characters the classes don't count against a
document, with fewer than ``MIN_WORDS`` words the common words don't.

Scale: one pass over the texts writes counts (about 0.4 kB a document); the references are
their sums by language, about 1 kB each and one for every language.  They are sent in blocks
of ``BLOCK_LANGUAGES``; the driver holds one block at a time, and a task scores its documents
against block after block, keeping the nearest so far.

Edge cases: null and empty texts have zero counts and fail the base rule of words; a null
language is a language of its own; repeated rows are judged alike, and each counts in its
reference; of references that are equally near the first in the order of documents and name is
taken; a text of any length is measured whole; without any document that the base rules let pass
there is no reference, the nearest is null and both distances are 0; an empty table has no rows.
Columns other than the key, the text and the language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .minhash_forest import _rows
from .stages import lean, saved

#: Common words of languages that a corpus may hold.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with as be at by this from are not or an have which you he they we his her but all",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie so dass aus bei nach",
    "fr": "le la les de des et un une du en est que qui dans pour par sur au pas ce il elle ne se plus avec son aux sont ou",
    "es": "el la los las de y en un una que por con para del se no es lo al su como más o pero sus le ha son sobre",
}

MIN_CHARS = 100
MIN_WORDS = 50
#: The limit of a distance: the first, plus the second over the square root of the counts.
MAX_CLASSES = (0.17, 1.5)
MAX_WORDS = (0.15, 2.5)
BLOCK_LANGUAGES = 1024

MIN_WORDS_BASE = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: lower, upper, digit, space, new line, sentence marks, listed symbols, other ASCII, other letters
CLASSES = 9
_CLASS = np.full(256, 7, np.int64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[_SYMBOLS] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = CLASSES  # the rest of a character; not counted


def _common() -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the common words, in three spellings, and their bins."""
    words = sorted({x for line in COMMON_WORDS.values() for x in line.split()})
    bins = {}
    for k, x in enumerate(words):
        for form in (x, x.capitalize(), x.upper()):
            bins.setdefault(int(w.hash_words([form.encode()])[0]), k)
    keys = np.array(sorted(bins), np.uint64)
    return keys, np.array([bins[int(k)] for k in keys]), len(words)


_KEYS, _BINS, N_COMMON = _common()
WIDTH = CLASSES + N_COMMON + 1
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,;:?!'\"()"]] = True


def _per_row(firsts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over rows."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _repeats(values: np.ndarray, row: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of values within their rows: which are found more than once, and which were found before."""
    keyed = w.mix(values + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(len(keyed) + 1, bool)
    same[1:-1] = keyed[order[1:]] == keyed[order[:-1]]
    many, later = np.zeros(len(keyed), bool), np.zeros(len(keyed), bool)
    later[order] = same[:-1]
    many[order] = same[:-1] | same[1:]
    return many, later


def measure(chunk: w.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the histograms side by side."""
    data, n = chunk.data, chunk.last - chunk.first
    starts, ends, firsts = w.spans(chunk, w.SPACED)
    n_words = np.diff(firsts)
    row = np.repeat(np.arange(n), n_words)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    word_chars = _per_row(firsts, lead[ends] - lead[starts])
    n_symbols = _per_row(chunk.bounds, _SYMBOLS[data])

    # Lines: from the start of a row or after a \n, to the next \n or the row's end.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(breaks + 1, chunk.bounds[:-1][np.diff(chunk.bounds) > 0])
    line_starts = line_starts[line_starts < len(data)] if len(line_starts) else line_starts
    line_ends = np.minimum(
        np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, line_starts)], chunk.bounds[np.searchsorted(chunk.bounds, line_starts, "right")]
    ) if len(line_starts) else line_starts
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_row = np.searchsorted(chunk.bounds, line_starts, "right") - 1
    hashed_lines = w.hashes(data, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    n_dup_lines = np.bincount(line_row[_repeats(hashed_lines, line_row, 1)[1]], minlength=n)

    hashed = w.hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    values, begins = w.grams(hashed, firsts, REPEAT_WINDOW)
    gram_row = np.repeat(np.arange(n), np.diff(begins))
    many, _ = _repeats(values, gram_row, 2)
    at = np.flatnonzero(many) - begins[gram_row[many]] + firsts[gram_row[many]]
    cover = np.zeros(len(starts) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    n_repeat_words = _per_row(firsts, np.cumsum(cover)[: len(starts)] > 0)

    histogram = np.zeros((n, WIDTH), np.int32)
    byte_row = np.repeat(np.arange(n), np.diff(chunk.bounds))
    counts = np.bincount(byte_row * (CLASSES + 1) + _CLASS[data], minlength=n * (CLASSES + 1))
    histogram[:, :CLASSES] = counts.reshape(n, CLASSES + 1)[:, :CLASSES]
    if len(starts):
        cut = ends - (_STRIP[data[ends - 1]] & (ends - starts > 1))  # a mark behind the word doesn't make it another
        bare = hashed.copy()
        moved = np.flatnonzero(cut != ends)
        bare[moved] = w.hashes(data, starts[moved], cut[moved])
        place = np.searchsorted(_KEYS, bare)
        place[place == len(_KEYS)] = 0
        bins = np.where(_KEYS[place] == bare, _BINS[place], N_COMMON)
        histogram[:, CLASSES:] = np.bincount(row * (N_COMMON + 1) + bins, minlength=n * (N_COMMON + 1)).reshape(n, -1)
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], axis=1).astype(np.int64), histogram


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "histogram"]
    for batch in lean(batches):
        for chunk in w.chunks(batch.column(2), lower=False):
            base, histogram = measure(chunk)
            n = len(base)
            offsets = np.arange(0, (n + 1) * WIDTH * 4, WIDTH * 4, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(histogram))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, n), batch.column(1).slice(chunk.first, n), *[pa.array(base[:, k]) for k in range(5)], packed], names
            )


def _histograms(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_rows(column)).view(np.int32)


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's histograms by language, as (lang, bin, count), and the documents as bin -1."""
    sums: dict[str, np.ndarray] = {}
    for batch in lean(batches):
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        table = _histograms(batch.column(1))
        place = codes.indices.to_numpy()
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            own = table[place == k]
            total = np.concatenate([own.sum(axis=0, dtype=np.int64), [len(own)]])
            sums[lang] = sums[lang] + total if lang in sums else total
    for lang, total in sums.items():
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bins), pa.string()), pa.array(np.where(bins == WIDTH, -1, bins).astype(np.int32)), pa.array(total[bins])], ["lang", "bin", "total"]
        )


def _failed(n_words, n_repeat):
    """The base rules, on columns or arrays."""
    return (n_words < MIN_WORDS_BASE) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def references(measured: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """All languages with a document that passes the base rules, those of most first, and their summed histograms as rows; in blocks."""
    sums = measured.where(~_failed(F.col("n_words"), F.col("n_repeat_words"))).select(F.coalesce("lang", F.lit("")).alias("lang"), "histogram").mapInArrow(_language_sums, "lang string, bin int, total long")
    sums = sums.groupBy("lang", "bin").agg(F.sum("total").alias("total"))
    bins = F.collect_list(F.struct("bin", "total")).alias("bins")  # WIDTH + 1 at most
    rows = saved(sums.groupBy("lang").agg(F.max(F.when(F.col("bin") == -1, F.col("total"))).alias("n_docs"), bins), "references")
    langs, table = [], []
    for lang, _, counts in rows.orderBy(F.desc("n_docs"), "lang").toLocalIterator():
        row = np.zeros(WIDTH)
        for k, total in counts:
            if k >= 0:
                row[k] = total
        langs.append(lang)
        table.append(row)
        if len(langs) >= BLOCK_LANGUAGES:
            yield langs, np.stack(table)
            langs, table = [], []
    if langs:
        yield langs, np.stack(table)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of count rows from reference rows; of an empty row 1."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = references / np.maximum(references.sum(axis=1, keepdims=True), 1)
    out = np.ones((len(p), len(q)))
    for k in range(len(q)):
        d = _entropy((p + q[k]) / 2) - (_entropy(p) + _entropy(q[k])) / 2
        out[:, k] = np.where(total[:, 0] > 0, np.sqrt(np.clip(d, 0, 1)), 1)
    return out


Limits = tuple[tuple[float, float], tuple[float, float], int, int]


def verdicts(histogram: np.ndarray, blocks: Iterable[tuple[list[str], np.ndarray]], limits: Limits) -> tuple[np.ndarray, ...]:
    """The nearest language, distances of classes and words from it, and whether both are within the limits or guarded."""
    max_classes, max_words, min_chars, min_words = limits
    n = len(histogram)
    near, class_distance, word_distance = np.full(n, None, object), np.zeros(n), np.zeros(n)
    least, at = np.full(n, np.inf), np.arange(n)
    for langs, table in blocks:
        classes = distance(histogram[:, :CLASSES], table[:, :CLASSES])
        common = distance(histogram[:, CLASSES:], table[:, CLASSES:])
        both = classes + common
        k = np.argmin(both, axis=1)
        nearer = np.flatnonzero(both[at, k] < least)
        k = k[nearer]
        least[nearer] = both[nearer, k]
        near[nearer] = np.array(langs, object)[k]
        class_distance[nearer], word_distance[nearer] = classes[nearer, k], common[nearer, k]
    chars, n_words = histogram[:, :CLASSES].sum(axis=1), histogram[:, CLASSES:].sum(axis=1)
    good = (class_distance <= max_classes[0] + max_classes[1] / np.sqrt(np.maximum(chars, 1))) | (chars < min_chars)
    good &= (word_distance <= max_words[0] + max_words[1] / np.sqrt(np.maximum(n_words, 1))) | (n_words < min_words)
    return near, class_distance, word_distance, good


def _judged(shared: list, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            if not batch.num_rows:
                continue
            near, classes, common, good = verdicts(_histograms(batch.column(7)), (block.value for block in shared), limits)
            n_words, n_repeat = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            failed = _failed(n_words, n_repeat)
            nearest = pa.array(near, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(k) for k in range(2, 7)], pa.array(failed), pa.array(~failed & good), nearest, pa.array(classes), pa.array(common)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance"],
            )

    return run


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_classes: tuple[float, float] = MAX_CLASSES,
    max_words: tuple[float, float] = MAX_WORDS,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the nearest language and both distances of each row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    measured = saved(rows.mapInArrow(_measured, f"doc_id {kind}, lang string, {counts}, histogram binary"), "measured")
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in references(measured)]
    return measured.mapInArrow(
        _judged(shared, (max_classes, max_words, min_chars, min_words)),
        f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double",
    )
