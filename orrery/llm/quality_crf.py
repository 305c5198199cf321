"""Document quality by a linear-chain conditional random field over lines.

Every line that has a word is labelled good or bad.  A line's potential sums weights of its
own feature bins and of its neighbours'; adjacent labels share a transition potential.  With
two labels the forward and backward messages are log-odds, so a pass is one scalar a line,
taken over all documents of a batch at a time.  A document's quality is the mean of its
lines' marginals, weighted by length, put on a scale where 0.5 divides the classes.

Training: the labelled documents of a bounded sample (``TRAIN_DOCS``, by hash of the id), each
line with its document's label, by maximum likelihood with an L2 penalty.  What the driver
holds is a byte per feature and line of that sample.  Inputs are texts only.

Scale: one map pass over the texts; the model is some kB.  Edge cases: null and empty texts,
or texts without words, score the training documents' share of good ones; without labels of
both classes every score is that share (0.5 without any); repeated rows score alike, and count
once in training; of several texts of one labelled id that of smallest hash is learned from; a
text of any length is scored whole; an empty table has no rows.  All columns stay; one of the
score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .divergence import _KEYS, _STRIP, _SYMBOLS, _repeats
from .stages import lean

TRAIN_DOCS = 4000
PENALTY = 2.0
STEPS = 80
REPEAT_WINDOW = 4

#: Limits of the bins of each feature.
FEATURES = {
    "words": (1.5, 3.5, 7.5, 15.5, 31.5, 63.5),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 11.0),
    "upper": (0.001, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8),
    "symbols": (0.001, 0.05, 0.2, 0.6, 1.5, 2.5),
    "shouts": (0.001, 0.05, 0.2, 0.8, 1.5),
    "bars": (0.001, 0.05, 0.2, 0.45),
    "common": (0.001, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6),
    "same_as_last": (0.001, 0.03, 0.1, 0.3, 0.7),
    "repeated": (0.001, 0.1, 0.3, 0.6, 0.9),
    "duplicate": (0.5,),
    "digits": (0.001, 0.02, 0.1, 0.3),
    "marks": (0.001, 0.03, 0.08, 0.15, 0.3, 0.6),
    "ends": (0.5,),
    "other_letters": (0.001, 0.02, 0.05, 0.1, 0.2),
    "longest": (6.5, 9.5, 12.5, 16.5, 24.5),
    "lines": (1.5, 2.5, 4.5, 8.5, 16.5, 64.5),
    "text_words": (4.5, 19.5, 49.5, 99.5, 299.5, 999.5),
}
N_FEATURES = len(FEATURES)
N_BINS = 8  # the most limits, and one


def line_bins(chunk: w.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length in bytes and feature bins of each line that has a word, in order."""
    data = chunk.data
    starts, ends, firsts = w.spans(chunk, w.SPACED)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N_FEATURES), np.uint8)
    breaks = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    # A word begins a line if a \n or the row's start is between it and the word before.
    cuts = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (cuts[1:] != cuts[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]])
    line = np.cumsum(new) - 1
    n, n_words = len(first), (last - first).astype(np.float64)
    line_row = row[first]
    begin, end = starts[first], ends[last - 1]
    length = end - begin

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[end] - sums[begin]).astype(np.float64)

    upper = per_line((data >= 65) & (data <= 90))
    letters = upper + per_line((data >= 97) & (data <= 122))
    chars = per_line((data & 0xC0) != 0x80)
    hashed = w.hashes(data, starts, ends)
    cut = ends - (_STRIP[data[ends - 1]] & (ends - starts > 1))
    bare = hashed.copy()
    moved = np.flatnonzero(cut != ends)
    bare[moved] = w.hashes(data, starts[moved], cut[moved])
    place = np.searchsorted(_KEYS, bare)
    place[place == len(_KEYS)] = 0
    common = np.bincount(line, _KEYS[place] == bare, n)
    same = np.zeros(len(starts), bool)
    same[1:] = (bare[1:] == bare[:-1]) & (line[1:] == line[:-1])
    values, begins = w.grams(hashed, firsts, REPEAT_WINDOW)
    gram_row = np.repeat(np.arange(len(firsts) - 1), np.diff(begins))
    many, _ = _repeats(values, gram_row, 3)
    at = np.flatnonzero(many) - begins[gram_row[many]] + firsts[gram_row[many]]
    cover = np.zeros(len(starts) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    repeated = np.bincount(line, np.cumsum(cover)[: len(starts)] > 0, n)
    _, later = _repeats(w.hashes(data, begin, end), line_row, 4)
    tail = data[end - 1]
    lines_of = np.bincount(line_row, minlength=len(firsts) - 1)
    columns = {
        "words": n_words,
        "word_length": chars / n_words,
        "upper": upper / np.maximum(letters, 1),
        "symbols": per_line(_SYMBOLS[data]) / n_words,
        "shouts": per_line(data == 33) / n_words,
        "bars": per_line(data == 124) / n_words,
        "common": common / n_words,
        "same_as_last": np.bincount(line, same, n) / n_words,
        "repeated": repeated / n_words,
        "duplicate": later,
        "digits": per_line((data >= 48) & (data <= 57)) / np.maximum(chars, 1),
        "marks": per_line((data == 46) | (data == 44) | (data == 63)) / n_words,
        "ends": (tail == 46) | (tail == 33) | (tail == 63),
        "other_letters": per_line(data >= 0xC0) / np.maximum(chars, 1),
        "longest": np.maximum.reduceat(ends - starts, first),
        "lines": lines_of[line_row],
        "text_words": np.diff(firsts)[line_row],
    }
    bins = np.stack([np.digitize(columns[k], limits) for k, limits in FEATURES.items()], axis=1)
    return line_row, length, bins.astype(np.uint8)


@dataclass
class Layout:
    """Lines of several documents in the order of a pass: all first lines, all second ones and so on, documents by falling length."""

    order: np.ndarray  # lines in that order
    begins: np.ndarray  # of each step, and the end
    before: np.ndarray  # for a line from the second step on, the place of the line before it


def layout(rows: np.ndarray) -> Layout:
    """rows: each line's document, in order of documents."""
    n = len(rows)
    new = np.ones(n, bool)
    new[1:] = rows[1:] != rows[:-1]
    first = np.flatnonzero(new)
    doc = np.cumsum(new) - 1
    step = np.arange(n) - first[doc]
    counts = np.bincount(doc)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    order = np.lexsort((rank[doc], step))
    begins = np.concatenate([[0], np.cumsum(np.bincount(step))]) if n else np.zeros(1, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Layout(order, begins, place[order[begins[1] :] - 1] if n else place)


def _log_odds(x: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    """log((e^a + e^(x+b)) / (e^c + e^(x+d)))"""
    return np.logaddexp(a, x + b) - np.logaddexp(c, x + d)


def messages(u: np.ndarray, lay: Layout, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own potential) and backward log-odds of potentials in the layout's order; t: transitions 00, 01, 10, 11."""
    forward, backward = u.copy(), np.zeros(len(u))
    steps = len(lay.begins) - 1
    for s in range(1, steps):
        a, b = lay.begins[s], lay.begins[s + 1]
        p = lay.begins[s - 1]
        forward[a:b] += _log_odds(forward[p : p + b - a], t[1], t[3], t[0], t[2])
    for s in range(steps - 1, 0, -1):
        a, b = lay.begins[s], lay.begins[s + 1]
        p = lay.begins[s - 1]
        backward[p : p + b - a] = _log_odds(u[a:b] + backward[a:b], t[2], t[3], t[0], t[1])
    return forward, backward


@dataclass
class Model:
    own: np.ndarray  # by feature and bin
    last: np.ndarray  # of the line before
    next: np.ndarray  # of the line behind
    edges: np.ndarray  # for the first and the last line
    transitions: np.ndarray
    slope: float
    shift: float
    prior: float


def _neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have one before them, and behind them, in their document."""
    joined = rows[1:] == rows[:-1]
    return np.concatenate([[False], joined]), np.concatenate([joined, [False]])


def _score(bins: np.ndarray, rows: np.ndarray, m: Model) -> np.ndarray:
    f = np.arange(N_FEATURES)
    own, last, following = (x[f, bins].sum(axis=1) for x in (m.own, m.last, m.next))
    u = own.copy()
    if len(rows):
        before, behind = _neighbours(rows)
        u[before] += last[np.flatnonzero(before) - 1]
        u[behind] += following[np.flatnonzero(behind) + 1]
        u[~before] += m.edges[0]
        u[~behind] += m.edges[1]
    return u


def quality(bins: np.ndarray, rows: np.ndarray, lengths: np.ndarray, n: int, m: Model) -> np.ndarray:
    """The score of each of n documents."""
    mean = np.full(n, np.nan)
    if len(rows):
        u, lay = _score(bins, rows, m), layout(rows)
        forward, backward = messages(u[lay.order], lay, m.transitions)
        good = np.empty(len(u))
        good[lay.order] = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        total = np.bincount(rows, lengths, n)
        mean = np.divide(np.bincount(rows, good * lengths, n), total, out=mean, where=total > 0)
    out = 1 / (1 + np.exp(-(m.slope * mean + m.shift)))
    return np.where(np.isnan(mean), m.prior, out)


def _objective(x: np.ndarray, flat: np.ndarray, lay: Layout, y: np.ndarray, last_lines: np.ndarray, size: int):
    """Negative log-likelihood and its gradient; flat: places of the weights of each line, in the layout's order."""
    t = x[size:]
    u = x[:size][flat].sum(axis=1)
    forward, backward = messages(u, lay, t)
    later = lay.begins[1]
    previous = lay.before
    base = np.logaddexp(t[0], forward[previous] + t[2])  # log of what state 0 gains from each step
    log_z = base.sum() + np.logaddexp(0, forward[last_lines]).sum()
    y1 = y[later:]
    y0 = y[previous]
    pair = (2 * y0 + y1).astype(np.int64)
    value = log_z - u[y == 1].sum() - t[pair].sum()
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    gradient = np.bincount(flat.ravel(), np.repeat(p - y, flat.shape[1]), size)
    z = np.stack([np.full(len(previous), t[0]), t[1] + u[later:] + backward[later:], t[2] + forward[previous], t[3] + forward[previous] + u[later:] + backward[later:]])
    z = np.exp(z - z.max(axis=0))
    expected = (z / z.sum(axis=0)).sum(axis=1)
    return value, np.concatenate([gradient, expected - np.bincount(pair, minlength=4)])


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, gradient = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, taken = -gradient, []
        for s, g in reversed(pairs):
            a = s @ direction / (s @ g)
            direction = direction - a * g
            taken.append(a)
        if pairs:
            s, g = pairs[-1]
            direction = direction * (s @ g) / (g @ g)
        else:
            direction = direction / max(1.0, np.abs(gradient).max())
        for (s, g), a in zip(pairs, reversed(taken), strict=True):
            direction = direction + (a - g @ direction / (s @ g)) * s
        rate, slope = 1.0, gradient @ direction
        if slope >= 0:
            break
        for _ in range(25):
            new_value, new_gradient = f(x + rate * direction)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, g = rate * direction, new_gradient - gradient
        if s @ g > 1e-10:
            pairs = [*pairs[-memory + 1 :], (s, g)]
        done = value - new_value < 1e-6 * abs(value)
        x, value, gradient = x + s, new_value, new_gradient
        if done:
            break
    return x


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """samples: label, line lengths and line bins of each document."""
    labels = np.array([s[0] for s in samples], np.int64)
    prior = float(labels.mean()) if len(labels) else 0.5
    shape = (N_FEATURES, N_BINS)
    model = Model(np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(2), np.zeros(4), 0.0, 0.0, prior)
    model.shift = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    used = [k for k, s in enumerate(samples) if len(s[2])]
    if not used or len(set(labels[used])) < 2:
        return model
    rows = np.repeat(np.arange(len(used)), [len(samples[k][2]) for k in used])
    bins = np.concatenate([samples[k][2] for k in used]).astype(np.int64)
    lengths = np.concatenate([samples[k][1] for k in used])
    y = labels[used][rows]
    one = N_FEATURES * N_BINS
    size = 3 * one + 3  # the last place is for no weight
    before, behind = _neighbours(rows)
    own = np.arange(N_FEATURES) * N_BINS + bins
    none = np.full(own.shape, size - 1)
    last, following = none.copy(), none.copy()
    last[before] = one + own[np.flatnonzero(before) - 1]
    following[behind] = 2 * one + own[np.flatnonzero(behind) + 1]
    edge = np.stack([np.where(before, size - 1, 3 * one), np.where(behind, size - 1, 3 * one + 1)], axis=1)
    lay = layout(rows)
    flat = np.concatenate([own, last, following, edge], axis=1)[lay.order]
    ends = np.empty(len(rows), np.int64)
    ends[lay.order] = np.arange(len(rows))
    last_lines = ends[~behind]

    def f(x: np.ndarray):
        x = x.copy()
        x[size - 1] = 0
        value, gradient = _objective(x, flat, lay, y[lay.order], last_lines, size)
        gradient[size - 1] = 0
        return value + penalty / 2 * (x @ x), gradient + penalty * x

    x = _minimise(f, np.zeros(size + 4), steps)
    model.own, model.last, model.next = x[: 3 * one].reshape(3, *shape)
    model.edges, model.transitions = x[3 * one : 3 * one + 2], x[size:]
    model.slope, model.shift = 1.0, 0.0
    raw = quality(bins, rows, lengths, len(used), model)
    mean = np.log(raw / (1 - raw))
    target = labels[used]

    def g(v: np.ndarray):
        z = v[0] * mean + v[1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return (np.logaddexp(0, z) - target * z).sum() + 1e-3 * (v @ v), np.array([((p - target) * mean).sum(), (p - target).sum()]) + 2e-3 * v

    model.slope, model.shift = (float(v) for v in _minimise(g, np.array([4.0, -2.0]), 100))
    return model


def held_out(key: Column) -> Column:
    """Rows from which no label is learned."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        for chunk in w.chunks(batch.column(1), lower=False):
            rows, lengths, bins = line_bins(chunk)
            at = np.searchsorted(rows, np.arange(chunk.last - chunk.first + 1))
            packed = [(lengths[a:b].astype(np.int64).tobytes(), bins[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(packed)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                ["label", "lengths", "bins"],
            )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Learns from at most ``most`` labelled documents, those of smallest hash; rows of held_out() are left out.

    A document counts once for each label it has, however many rows it has; of different texts the one of smallest hash is taken.
    """
    known = labels.where(labels[label].isNotNull() & ~held_out(labels[key])).select(labels[key].alias("_key"), labels[label].cast("int").alias("_label"))
    known = known.distinct().orderBy(F.xxhash64("_key"), "_key", "_label").limit(most)
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text")).join(F.broadcast(known), "_key")
    rows = rows.groupBy("_key", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text"))["_text"].alias("_text"))
    rows = rows.select("_label", "_text").mapInArrow(_sampled, "label int, lengths binary, bins binary")
    samples = [
        (r.label, np.frombuffer(r.lengths, np.int64), np.frombuffer(r.bins, np.uint8).reshape(-1, N_FEATURES)) for r in rows.toLocalIterator()
    ]
    return train(sorted(samples, key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes())))


def _scored(shared, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in lean(batches):
            out = []
            for chunk in w.chunks(batch.column(text_at), lower=False):
                rows, lengths, bins = line_bins(chunk)
                out.append(quality(bins, rows, lengths, chunk.last - chunk.first, model))
            if out:
                columns = [batch.column(k) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out))], names)

    return run


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns, with a score from 0 to 1; a column of its name is replaced."""
    docs = docs.drop(score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_scored(shared, docs.columns.index(text), schema.names), schema)
