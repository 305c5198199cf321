"""BPE encoding by prefix-sharing trie traversal, and decoding, for vocabularies with word ends.

The last token of a prefix's encoding decides the rest: the encoding of a prefix is that of
the prefix without its last token, and that token.  So a prefix needs one token as its state,
found among the tokens that end there as the one that may stand behind the state before it.
Distinct words are put in order, which is the depth-first order of their trie; the path from
the root is kept, and a word starts from the states of the prefix that it shares with the
word before.  A word's last symbol carries the word end, so it is a branch of its own.  The
tokens that end at a place come from an automaton over the tokens' texts, whose state is the
longest end of the prefix that begins a token (its steps are made as they are met, by suffix
links).

Two tokens may stand side by side if merging their text doesn't join anything across the
boundary: the merges that made them are undone, latest first, and no pair at the boundary may
have a merge that comes earlier than what was undone (of equal ones the left is first).

Scale: a map over the documents without a shuffle.  Texts are divided into words in arrays, and
a worker keeps the ids of up to ``CACHE`` words in a table by hash; when it is full, it begins anew.
The trie runs over the words of some texts that aren't there.

Edge cases: null and empty texts have no ids and decode to nothing; special tokens in a text
are found first, as the library does; equal rows are encoded alike; an empty table has no
rows.  A text of any length is encoded whole.  Columns other than the key and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import words as w
from .stages import lean, per_worker
from .word_table import CLASS, FAR, FOREIGN, NUMBER, SPACE, Table, codes_of, contractions

#: Words whose ids a worker keeps, of up to 60 bytes each.
CACHE = 1 << 20
#: Pairs of tokens whose fit a worker keeps, and steps of the automaton.
PAIRS = 200_000
STEPS = 300_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_of_char() -> dict[str, int]:
    """The public byte-to-character table: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def normalised(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # by single characters


class Vocabulary:
    """Tokens and merges of a tokenizer file with end_of_word_suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        chars = byte_of_char()
        self.names: list[str] = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, k in model["vocab"].items():
            self.names[k] = name
            last = name.endswith(self.end) and name != self.end
            raw = name[: -len(self.end)] if last else name
            (self.final if last else self.inner)[bytes(chars[c] for c in raw)] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.names[k] = content
        self.size = {k: len(raw) for table in (self.inner, self.final) for raw, k in table.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        ids = model["vocab"]
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            self.pairs[ids[a], ids[b]] = r
            self.left[made], self.right[made], self.rank[made] = ids[a], ids[b], r
        self.span = len(self.names)
        self.beside: dict[int, bool] = {}  # by the left token times span, and the right one
        #: The automaton: beginnings of tokens, the states met so far, their texts and tokens, and steps by state and byte.
        self.heads = {raw[:k] for table in (self.inner, self.final) for raw in table for k in range(len(raw) + 1)}
        self.state_of = {b"": 0}
        self.texts = [b""]
        self.inner_at: list[tuple[tuple[int, int], ...]] = [()]
        self.final_at: list[tuple[tuple[int, int], ...]] = [()]
        self.steps: dict[int, int] = {}
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens."""
        if len(self.beside) > PAIRS:
            self.beside.clear()
        known = self.beside[a * self.span + b] = self._may_follow(a, b)
        return known

    def step(self, key: int) -> int:
        """The state behind one (times 256) and a byte: the longest end of its text that begins a token."""
        text = self.texts[key >> 8] + bytes([key & 255])
        while text not in self.heads:
            text = text[1:]
        state = self.state_of.get(text)
        if state is None:
            state = self.state_of[text] = len(self.texts)
            self.texts.append(text)
            ends = [text[k:] for k in range(len(text))]  # longest first
            self.inner_at.append(tuple((len(x), self.inner[x]) for x in ends if x in self.inner))
            self.final_at.append(tuple((len(x), self.final[x]) for x in ends if x in self.final))
        if len(self.steps) > STEPS:
            self.steps.clear()
        self.steps[key] = state
        return state

    def _may_follow(self, a: int, b: int) -> bool:
        rank, limit = self.rank, len(self.pairs)
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < limit:
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a > made_b:
                limit, a = made_a, self.right[a]
            elif made_b >= 0:
                limit, b = made_b + 1, self.left[b]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, packed; shared prefixes of words are encoded once."""
        out: dict[bytes, bytes] = {}
        inner_at, final_at, size, span = self.inner_at, self.final_at, self.size, self.span
        steps, beside, may, step = self.steps, self.beside, self.may_follow, self.step
        before = b""
        states = [-1]  # the last token of each prefix of the path
        places = [0]  # the automaton's state behind it
        for word in sorted(set(words)):
            n = len(word) - 1  # the last byte is with the word end
            shared = 0
            most = min(n, len(states) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], places[shared + 1 :]
            place = places[shared]
            for i in range(shared, n):
                key = place << 8 | word[i]
                place = steps.get(key)
                if place is None:
                    place = step(key)
                places.append(place)
                for length, token in inner_at[place]:
                    k = i + 1 - length
                    if not k:
                        break
                    fits = beside.get(states[k] * span + token)
                    if fits is None:
                        fits = may(states[k], token)
                    if fits:
                        break
                states.append(token)
            key = place << 8 | word[n]
            place = steps.get(key)
            if place is None:
                place = step(key)
            for length, token in final_at[place]:
                k = n + 1 - length
                if not k:
                    break
                fits = beside.get(states[k] * span + token)
                if fits is None:
                    fits = may(states[k], token)
                if fits:
                    break
            ids = [token]
            while k:
                ids.append(states[k])
                k -= size[states[k]]
            out[word] = pack(ids[::-1])
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        return _PIECE.findall(normalised(text))

    def parts(self, text: str) -> list[str]:
        """A text cut at special tokens, which stand at odd places."""
        return self.splitter.split(text) if self.splitter else [text]


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def word_spans(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in normalised texts side by side (``bounds``: where each begins, and the end).

    A run of letters is a word, a single number, a run of other marks, and an apostrophe with s, t, m, d, re, ve or ll.
    """
    n = len(codes)
    kind = np.maximum(CLASS[codes], SPACE)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = first[:n] | (kind == NUMBER)
    start[1:] |= kind[1:] != kind[:-1]
    contractions(codes, first, start)
    edges = np.flatnonzero(start)
    words = kind[edges] != SPACE
    return edges[words], np.append(edges[1:], n)[words]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Texts are divided side by side in arrays; those with special tokens or far characters one by one.
    """

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE) -> None:
        self.vocabulary, self.most = vocabulary, cache
        self.special = {f" {x}": pack([k]) for x, k in vocabulary.special.items()}  # behind a blank, which no word has
        self.known = Table("<u4", cache)

    def _alone(self, text: str) -> bytes:
        """A text with special tokens or far characters."""
        line: list[str] = []
        for k, part in enumerate(self.vocabulary.parts(text)):
            line += [f" {part}"] if k % 2 else self.vocabulary.words(part)
        ids = self.vocabulary.encode_words({x.encode() for x in line if x not in self.special})
        return b"".join([self.special[x] if x in self.special else ids[x.encode()] for x in line])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        alone: dict[int, bytes] = {}
        plain = [normalised(t or "") for t in texts]
        for k, t in enumerate(plain):
            if any([s in (texts[k] or "") for s in self.vocabulary.special]) or not t.isascii() and CLASS[np.minimum(codes_of(t), FAR)].max() == FOREIGN:
                alone[k] = self._alone(texts[k])
                plain[k] = ""
        text = "".join(plain)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
        if not text:
            return [alone.get(k, b"") for k in range(len(texts))]
        codes = codes_of(text)
        starts, ends = word_spans(codes, bounds)
        keys = np.maximum(w.hashes(codes, starts, ends), np.uint64(1))
        slots = self.known.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if self.known.size + len(missing) > self.known.most:  # what is kept goes, so all words of these texts are new
                missing = np.arange(len(keys))
                self.known = Table("<u4", max(self.most, len(keys)))
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            words = [text[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            ids = self.vocabulary.encode_words(words)
            self.known.add(new, [ids[x] for x in words])
            slots = self.known.find(keys)
        ids, before = self.known.ids(slots)
        cut = (4 * before[np.searchsorted(starts, bounds)]).tolist()
        packed = ids.tobytes()
        return [alone[k] if k in alone else packed[a:b] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def decode(ids: bytes, names: list[str]) -> str:
    """As of a tokenizer file without a decoder: the tokens' names, divided by blanks."""
    return " ".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@per_worker
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@per_worker
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(vocabulary(path))


#: Texts of about so many characters are encoded at a time.
SLICE_CHARS = 400_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


_SCHEMA = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def _ids(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _run(path: str, wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        names = one.vocabulary.names
        for batch in lean(batches, vocabulary, encoder):
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = one.encode(texts[a:b])
                columns = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if "ids_sha256" in wanted:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(decode(x, names).encode()).hexdigest() for x in ids])
                if "ids" in wanted:
                    columns["ids"] = _ids(ids)
                if "decoded" in wanted:
                    columns["decoded"] = pa.array([decode(x, names) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([columns[k] for k in ["doc_id", *wanted]], ["doc_id", *wanted])

    return run


def _mapped(docs: DataFrame, path: str, key: str, text: str, wanted: list[str]) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(_run(path, wanted), f"doc_id {kind}, " + ", ".join(f"{k} {_SCHEMA[k]}" for k in wanted))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each row."""
    return _mapped(docs, path, key, text, ["n_tokens", "ids", "decoded"])


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text, and the ids if asked, of each row."""
    return _mapped(docs, path, key, text, ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
