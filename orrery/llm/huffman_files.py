"""Token ids in files, by canonical length-limited Huffman coding.

The ids' counts over the whole corpus give code lengths of at most ``LIMIT`` bits (package-
merge); codes are canonical, so the file needs the lengths only.  A file is Parquet whose rows
are blocks: documents in ascending order until ``BLOCK_IDS`` ids are reached, with the
documents' ids and lengths, the code bits, and the bit offset of every ``STRIDE``-th id.
A longer document is cut and goes on in the next blocks.  Blocks are independent of each other.
A block is decoded by table look-ups of LIMIT bits, one id of every stretch between checkpoints
at a time.

Layout of a folder: ``lengths`` (id, bits), ``blocks`` (part, first, serial, opens, closes, docs,
lengths, bits, checkpoints; ``first`` counts ids, and ``serial`` documents, from the part's start;
``opens`` and ``closes`` say whether the first piece is the rest of a document, and whether the last
one ends it) and ``parts`` (part, start).

Scale: documents are encoded once, and each task writes the counts of its ids with them; counts
are summed by Spark to a row per id in use.  The bits are sorted by document through a range
partition, with the row as tiebreak.  The driver holds the code table and a row per partition.

Edge cases: null and empty texts are documents of the end id alone; equal document ids keep
all their rows, in no defined order; null ids come first; a document of any length is in blocks
of at most 2 ``BLOCK_IDS``; an empty table makes files without blocks; a vocabulary of one id takes
one bit per id.  Columns other than the key and the text are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as w
from .word_table import BLANK, CLASS, FAR, FOREIGN, SPACE, Table, codes_of, contractions
from .stages import lean, per_worker, saved, shared_folder, slices

LIMIT = 16
BLOCK_IDS = 1 << 16
STRIDE = 256
#: Words whose ids a worker keeps, of up to 50 bytes each.
CACHE = 1 << 20
#: Texts of about so many characters are encoded at a time.
SLICE_CHARS = 400_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol (0 of those that don't occur) such that the sum over all occurrences is least, by package-merge."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        even = len(both) // 2 * 2
        packages = both[:even:2] + both[1:even:2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter ones first, of equal length by symbol."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        self.width = int(self.lengths.max()) if len(used) else 1
        starts = np.zeros(len(order) + 1, np.int64)
        np.cumsum(1 << (self.width - self.lengths[order]), out=starts[1:])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (starts[:-1] >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbols = np.zeros(1 << self.width, np.uint32)
        self.symbols[: starts[-1]] = np.repeat(order, np.diff(starts))

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Bits, filled up to whole 64-bit words and one more, and the offsets of every stride-th id."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        begins = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        out = np.zeros((total >> 6) + 2, np.uint64)
        if len(ids):
            word, room = begins >> 6, 64 - (begins & 63) - bits
            code = self.codes[ids]
            part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] = np.bitwise_or.reduceat(part, first)
            over = np.flatnonzero(room < 0)
            out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes(), begins[::stride]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]], stride: int = STRIDE) -> list[np.ndarray]:
        """The ids of blocks of (bits, checkpoints, number of ids); stretches of all of them side by side."""
        words = np.frombuffer(b"".join([b[0] for b in blocks]), ">u8").astype(np.uint64)
        base = np.concatenate([[0], np.cumsum([len(b[0]) for b in blocks])])[:-1] * 8
        at = np.concatenate([b[1] + o for b, o in zip(blocks, base, strict=True)] or [np.zeros(0)]).astype(np.int64)
        left = np.concatenate([np.minimum(stride, b[2] - np.arange(len(b[1])) * stride) for b in blocks] or [np.zeros(0)]).astype(np.int64)
        out = np.zeros((len(at), stride), np.uint32)
        live = np.arange(len(at))
        shift = np.uint64(64 - self.width)
        for k in range(stride):
            live = live[left[live] > k] if k else live[left[live] > 0]
            if not len(live):
                break
            here = at[live]
            word, off = here >> 6, (here & 63).astype(np.uint64)
            window = words[word] << off
            window |= np.where(off > 0, words[word + 1] >> (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
            found = self.symbols[(window >> shift).astype(np.int64)]
            out[live, k] = found
            at[live] = here + self.lengths[found]
        flat = out[np.arange(stride) < left[:, None]] if len(at) else np.zeros(0, np.uint32)
        return np.split(flat, np.cumsum([b[2] for b in blocks])[:-1]) if blocks else []


@per_worker
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _chars() -> list[str]:
    """The public byte-to-character table: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    return [out[b] for b in range(256)]


def word_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pre-tokenizer begin, in texts side by side (``bounds``: where each begins, and the end).

    A blank belongs to what follows it, the rest of the white space before that is a word, a run of letters, of
    numbers, or of other marks is one, and so is an apostrophe with s, t, m, d, re, ve or ll that begins a word.
    """
    n = len(codes)
    kind = CLASS[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    space = kind <= SPACE
    run = np.maximum(kind, SPACE)
    start = first[:n].copy()
    start[1:] |= run[1:] != run[:-1]
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # white space before something else
    start[last] = True
    start[last + 1] = kind[last] != BLANK
    contractions(codes, first, start)
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer is byte-level with its regular expression.

    Texts are divided as the pre-tokenizer does it, side by side in arrays, and the library's
    model is asked for words that aren't kept.  Texts with special tokens or far characters go
    through the library whole.
    """

    def __init__(self, path: str, end: int, cache: int = CACHE) -> None:
        self.tokenizer, self.most = _tokenizer(path), cache
        self.model, self.chars = self.tokenizer.model, _chars()
        self.blank = self.chars[32]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letter = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end], self.kind).tobytes()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Table(self.kind, cache)

    def _word(self, word: str) -> bytes:
        if word[0] == " " and word.isascii() and word[1:].isalnum():
            mapped = self.blank + word[1:]
        else:
            mapped = "".join([self.chars[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, packed, with the end id."""
        texts = [t or "" for t in texts]
        whole: dict[int, bytes] = {}
        for k, t in enumerate(texts):
            if any([s in t for s in self.specials]) or not t.isascii() and CLASS[np.minimum(codes_of(t), FAR)].max() == FOREIGN:
                whole[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
                texts[k] = ""
        text = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes = codes_of(text)
        starts = word_starts(codes, bounds) if text else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        keys = np.maximum(w.hashes(codes, starts, ends), np.uint64(1))
        slots = self.known.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if self.known.size + len(missing) > self.known.most:  # what is kept goes, so all words of these texts are new
                missing = np.arange(len(keys))
                self.known = Table(self.kind, max(self.most, len(keys)))
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            self.known.add(new, [self._word(text[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots = self.known.find(keys)
        ids, before = self.known.ids(slots)
        cut = before[np.searchsorted(starts, bounds)].tolist()
        packed = ids.tobytes()
        size = ids.itemsize
        return [whole.get(k, b"") + packed[a * size : b * size] + self.end for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


@per_worker
def encoder(path: str, end: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, end)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encoded(path: str, end: int):
    """Each document's ids, and behind a task's last document a row with the counts of all its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; Spark runs the others
        one = encoder(path, end)
        total = np.zeros(0, np.int64)
        kind = pa.int64()
        names = ["doc_id", "ids", "counts"]
        for batch in lean(batches, _tokenizer, encoder):
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                ids = one.encode(texts[a:b])
                more = np.bincount(np.frombuffer(b"".join(ids), one.kind))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.nulls(b - a, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in lean(batches):
        for counts in batch.column(0).to_pylist():
            more = np.frombuffer(counts, "<i8").copy()
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


_BLOCKS = "first long, serial long, opens boolean, closes boolean, docs array<long>, lengths array<long>, bits binary, checkpoints array<long>"


def _blocked(shared, kind: str):
    """Of a partition in order of documents: its blocks; a document of more than BLOCK_IDS ids is in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        names: list = []
        parts: list[np.ndarray] = []
        ready = first = 0
        serial = -1  # of the last document
        opens = False  # whether the block's first piece is the rest of a document

        def block(closes: bool) -> pa.RecordBatch:
            nonlocal names, parts, ready, first, opens
            ids = np.concatenate(parts).astype(np.int64)
            bits, checkpoints = code.encode(ids)
            row = {
                "first": first, "serial": serial - len(parts) + 1, "opens": opens, "closes": closes, "docs": names, "lengths": [len(x) for x in parts],
                "bits": bits, "checkpoints": checkpoints.tolist(),
            }
            first += len(ids)
            names, parts, ready, opens = [], [], 0, not closes
            return pa.RecordBatch.from_pylist([row], _BLOCK_TYPES)

        for batch in lean(batches):
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(packed, kind)
                serial += 1
                for at in range(0, len(ids), BLOCK_IDS):
                    names.append(name)
                    parts.append(ids[at : at + BLOCK_IDS])
                    ready += len(parts[-1])
                    if ready >= BLOCK_IDS:
                        yield block(at + BLOCK_IDS >= len(ids))
        if parts:
            yield block(True)

    return run


_BLOCK_TYPES = pa.schema([
    ("first", pa.int64()), ("serial", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("docs", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.list_(pa.int64())),
])


def write(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end: int = 0) -> str:
    """Encodes all texts, each followed by the id ``end``, and writes the files in ascending order of the key; returns the folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    kind = encoder(path, end).kind
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    made = saved(rows.mapInArrow(_encoded(path, end), "doc_id long, ids binary, counts binary"), "encoded", "zstd")
    counts = made.where("counts is not null").select("counts").mapInArrow(_summed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id in use
    ids = made.where("ids is not null").select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))  # rows of one id may be many
    table = np.zeros(max([r.id for r in counts], default=0) + 1, np.int64)
    for r in counts:
        table[r.id] = r.n
    lengths = code_lengths(table)
    spark.createDataFrame([(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id int, bits int").write.parquet(f"{folder}/lengths")
    shared = spark.sparkContext.broadcast(lengths)
    ordered = ids.repartitionByRange(slices(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    ordered.mapInArrow(_blocked(shared, kind), _BLOCKS).withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/blocks")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(total).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{folder}/parts")
    return folder


def _crc_of_both(one: int, two: int, n_two: int) -> int:
    """The crc32 of two byte strings one behind the other, of theirs: the first's is moved on by the zeros of n_two bytes, squaring the operator of one bit."""

    def apply(operator: list[int], x: int) -> int:
        out = k = 0
        while x:
            if x & 1:
                out ^= operator[k]
            x >>= 1
            k += 1
        return out

    operator = [0xEDB88320, *[1 << k for k in range(31)]]  # a zero bit
    n = 8 * n_two
    while n:
        if n & 1:
            one = apply(operator, one)
        operator = [apply(operator, x) for x in operator]
        n >>= 1
    return one ^ two


def _read(shared, with_ids: bool):
    """The pieces of documents in blocks; ``serial`` is null for those that are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in lean(batches):
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                found = code.decode([(r["bits"], np.array(r["checkpoints"], np.int64), sum(r["lengths"])) for r in rows])
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "part", "serial", "ids")}
                for r, ids in zip(rows, found, strict=True):
                    ends = np.cumsum(r["lengths"])
                    ids = ids.astype("<u4")
                    raw, last = ids.tobytes(), len(ends) - 1
                    for k, (n, e) in enumerate(zip(r["lengths"], ends.tolist(), strict=True)):
                        whole = not (k == 0 and r["opens"] or k == last and not r["closes"])
                        out["start"].append(r["first"] + e - n)
                        out["ids_crc32"].append(zlib.crc32(raw[4 * (e - n) : 4 * e]))
                        out["serial"].append(None if whole else r["serial"] + k)
                        if with_ids:
                            out["ids"].append(ids[e - n : e].astype(np.int32))
                    out["doc_id"] += r["docs"]
                    out["n_tokens"] += r["lengths"]
                    out["part"] += [r["part"]] * len(ends)
                columns = [pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32", "part", "serial")]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, list(out)[: len(columns)])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The crc32 of documents in several pieces."""
    for batch in lean(batches):
        sums = []
        for pieces in batch.column("pieces").to_pylist():
            total = pieces[0]["ids_crc32"]
            for piece in pieces[1:]:
                total = _crc_of_both(total, piece["ids_crc32"], 4 * piece["n_tokens"])
            sums.append(total)
        at = batch.schema.get_field_index("pieces")
        yield batch.set_column(at, "ids_crc32", pa.array(sums, pa.int64()))


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian 32-bit ids) and ids of each document, from the files."""
    rows = spark.read.schema("id int, bits int").parquet(f"{folder}/lengths").collect()
    lengths = np.zeros(max([r.id for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(f"{_BLOCKS}, part int").parquet(f"{folder}/blocks")
    parts = spark.read.schema("part int, start long").parquet(f"{folder}/parts")
    blocks = blocks.join(F.broadcast(parts), "part")  # a row per partition of the writer
    blocks = blocks.withColumn("first", F.col("start") + F.col("first")).drop("start")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    made = "doc_id long, start long, n_tokens long, ids_crc32 long, part long, serial long" + ", ids array<int>" * with_ids
    long = blocks.where("not closes or opens")  # blocks that hold a piece of a document, and maybe whole ones
    whole = blocks.mapInArrow(_read(shared, with_ids), made).where("serial is null").select(names)
    pieces = long.mapInArrow(_read(shared, with_ids), made).where("serial is not null")
    pieces = pieces.groupBy("part", "serial").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "n_tokens", "ids_crc32", *["ids"] * with_ids))).alias("pieces")
    )
    ids = [F.flatten("pieces.ids").alias("ids")] * with_ids
    total = F.aggregate("pieces.n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    pieces = pieces.select("doc_id", F.col("pieces.start")[0].alias("start"), total.alias("n_tokens"), F.transform("pieces", lambda x: F.struct(x["n_tokens"].alias("n_tokens"), x["ids_crc32"].alias("ids_crc32"))).alias("pieces"), *ids)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return whole.unionByName(pieces.mapInArrow(_joined, kind))
