"""Personal data and secrets by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; what fails their checks
is dropped.  What looks like such data at all becomes a node of a random field over the
document: something around an @, an address in words (``bob [at] mail [dot] com``), a run of
digits with their separators, a long run of letters and digits, a value behind a key word and
``=`` or ``:``.  Labels are the kinds (the patterns' four, and secrets) and "none".  Nodes that
follow each other share a chain potential; distant ones share a skip potential if their text is
the same, or similar: the same beginning or end, or the same name before the @.  Nodes that a
pattern found keep their kind, and loopy message passing carries it along the skips, so a
number that is personal data in one place is found where its surroundings spoil the pattern.
Nodes whose belief in a kind is ``SURE`` at least are added to the patterns' spans.

Weights are learned by pseudo-likelihood on the documents of a bounded sample (``TRAIN_DOCS``, by
hash of the id).  The patterns' finds are given; learned are the labels of the other nodes.
Those are none, but for tokens in the form of access keys and values of secrets' key words
(secret), and for what is added to the sample's texts: fabricated secrets of public forms, and
spoiled copies of the finds, each with a decoy: the like of it with other digits or another name,
labelled none.  So only the skip potentials can tell the two apart, and are learned from that.

Among nodes of one text or key only successive ones are linked, so a document's graph is as
large as its nodes.  Messages are damped, and passed until none changes by ``STILL`` or more, or
``ROUNDS`` times; whether a document's have settled is returned.

Scale: a map over the documents without a shuffle; the model is some hundred numbers, and a
worker holds texts of ``SLICE_CHARS`` characters, or one longer, at a time.  Edge cases: null and
empty texts have no spans; equal rows have equal spans, whatever their ids; overlapping spans of
different kinds are all returned, in the order of start and kind; very long texts are searched
whole, in linear time; an empty table has no rows, and without any node in the sample the
weights are the prior.  Columns other than the key and the text are not looked at, and ``redacted``
returns them as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_crf import _minimise
from .stages import lean

KINDS = ("email", "ip", "card", "phone", "secret")
#: Those that patterns find.
N_BASE = 4
EMAIL, IP, CARD, PHONE, SECRET = range(5)
NONE = len(KINDS)
TRAIN_DOCS = 3000
PENALTY = 0.05
#: Skip potentials are learned around this reward for equal labels.
SKIP_PRIOR = 1.0
#: Spoiled copies of each find in the sample.
COPIES = 3
SURE = 0.5
ROUNDS = 200
STILL = 1e-4
#: Edges whose messages are made at a time.
EDGES = 50_000
KEY_DIGITS = 8
KEY_NAME = 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9.-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,3}[0-9])*+")
_TRIGGER = re.compile(r"[0-9@]")
#: Addresses in words.
_HIDDEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({]at[\])}] ?[A-Za-z0-9-]+(?:(?: ?[\[({]dot[\])}] ?|\.| dot )[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)", re.I
)
_HIDING = ("at]", "at)", "at}", "AT]", "AT)", "AT}", " dot ", " DOT ")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_VALUE = re.compile(r"[=:]\s{0,3}[\"']?([^\s\"',;]{6,})")
_KEY = re.compile(r"(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|password|passwd|pwd|credential|bearer)s?[\"']?\s{0,3}$", re.I)
#: The public form of an access key id.
_ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _around_at(text: str, domain: re.Pattern[str]) -> Iterator[tuple[int, int, int]]:
    """Start, place of the @ and end of each address, leftmost first; linear in the text, also where long runs have no @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = domain.match(text, at + 1)
        if end and start < at:
            done = end.end()
            yield start, at, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, _, b in _around_at(text, _DOMAIN)]
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


FEATURES = (
    "bias", "address", "no_domain", "no_dot", "hidden", "d1", "d2_4", "d5_8", "d9_11", "d12_15", "d16", "d17_19", "d20",
    "plus", "bracket", "blank", "hyphen", "dots3", "dots", "small_parts", "luhn", "after_letter", "before_letter",
    "token", "t15", "t16_23", "t24_39", "t40", "few_digits", "some_digits", "many_digits", "hex", "capitals", "keyed", "quoted", "access_key",
)
_PLACE = {f: k for k, f in enumerate(FEATURES)}

NUMBER, ADDRESS, HIDDEN, TOKEN = range(4)


@dataclass
class Node:
    start: int
    end: int
    form: int
    at: int = -1  # the place of an address's @
    keyed: bool = False


def _candidates(text: str) -> list[Node]:
    """What may be personal data or a secret, by start; none inside another."""
    out: list[Node] = []
    if "@" in text:
        out += [Node(a, b, ADDRESS, at) for a, at, b in _around_at(text, _LOOSE_DOMAIN)]
    if any([x in text for x in _HIDING]):
        out += [Node(m.start(), m.end(), HIDDEN) for m in _HIDDEN.finditer(text)]
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            if _KEY.search(text, max(0, m.start() - 24), m.start()):
                out.append(Node(m.start(1), m.end(1), TOKEN, keyed=True))
    if _TRIGGER.search(text):
        for m in _TOKEN.finditer(text):
            token = m.group()
            if not token.isalpha() and any([c.isdigit() for c in token]) and any([c.isalpha() for c in token]):
                out.append(Node(m.start(), m.end(), TOKEN))
        out += [Node(m.start(), m.end(), NUMBER) for m in _NUMBER.finditer(text)]
    # Addresses before values before tokens before numbers, whatever overlaps.
    order = {ADDRESS: 0, HIDDEN: 1, TOKEN: 2, NUMBER: 4}
    kept: list[Node] = []
    ends: list[tuple[int, int]] = []
    for rank in range(5):
        mine = sorted((n for n in out if order[n.form] + (n.form == TOKEN and not n.keyed) == rank), key=lambda n: n.start)
        at, merged = 0, []
        for n in mine:
            while at < len(ends) and ends[at][1] <= n.start:
                at += 1
            if at < len(ends) and ends[at][0] < n.end or merged and merged[-1].end > n.start:
                continue
            merged.append(n)
        kept += merged
        ends = sorted(ends + [(n.start, n.end) for n in merged])
    return sorted(kept, key=lambda n: n.start)


def _features(text: str, node: Node) -> list[int]:
    start, end = node.start, node.end
    s = text[start:end]
    on = ["bias"]
    if node.form == ADDRESS:
        on.append("address")
        if end == node.at + 1:
            on.append("no_domain")
        elif "." not in text[node.at + 1 : end]:
            on.append("no_dot")
    elif node.form == HIDDEN:
        on.append("hidden")
    elif node.form == TOKEN:
        n, share = len(s), sum(c.isdigit() for c in s) / len(s)
        on += ["token", "t15" if n < 16 else "t16_23" if n < 24 else "t24_39" if n < 40 else "t40"]
        on.append("few_digits" if share < 0.15 else "some_digits" if share < 0.45 else "many_digits")
        on += [f for f, x in (("hex", all(c in "0123456789abcdefABCDEF" for c in s)), ("capitals", s.isupper()), ("keyed", node.keyed)) if x]
        if text[start - 1 : start] in ("'", '"') and start:
            on.append("quoted")
        if _ACCESS_KEY.fullmatch(s):
            on.append("access_key")
    else:
        d = _digits(s)
        n = len(d)
        on.append("d1" if n < 2 else "d2_4" if n < 5 else "d5_8" if n < 9 else "d9_11" if n < 12 else "d12_15" if n < 16 else "d16" if n < 17 else "d17_19" if n < 20 else "d20")
        on += [f for f, c in (("plus", "+"), ("bracket", "("), ("blank", " "), ("hyphen", "-")) if c in s]
        parts = s.split(".")
        if len(parts) > 1:
            on.append("dots3" if len(parts) == 4 else "dots")
            if all(len(p) <= 3 for p in parts):
                on.append("small_parts")
        if 12 <= n <= 19 and luhn(d):
            on.append("luhn")
    if start and text[start - 1].isalpha():
        on.append("after_letter")
    if end < len(text) and text[end].isalpha():
        on.append("before_letter")
    return [_PLACE[f] for f in on]


def _keys(text: str, node: Node) -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """By what a node is linked to others: its whole text, and parts of it."""
    raw = text[node.start : node.end]
    if node.form in (ADDRESS, HIDDEN):
        name = (text[node.start : node.at] if node.form == ADDRESS else re.split(r"[ \[({]", raw, maxsplit=1)[0]).lower()
        return ("a", raw.lower()), [("n", name)] if len(name) >= KEY_NAME else []
    if node.form == TOKEN:
        return ("t", raw), [("b", raw[:KEY_DIGITS]), ("e", raw[-KEY_DIGITS:])] if len(raw) > KEY_DIGITS else []
    d = _digits(raw)
    if len(d) < 5:
        return ("s", raw), []  # of few digits the separators are half of what is said
    return ("d", d), [("f", d[:KEY_DIGITS]), ("l", d[-KEY_DIGITS:])] if len(d) >= KEY_DIGITS else []


@dataclass
class Graph:
    """Nodes and edges of documents side by side."""

    spans: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end
    features: list[list[int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)  # of the patterns, or NONE
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # nodes, and 0 chain, 1 same, 2 similar
    truth: list[int] = field(default_factory=list)  # labels to learn

    def add(self, document: int, text: str, found: list[Span], told: list[Span] | None = None) -> None:
        """Appends a document's nodes and edges; told: spans with kinds, or NONE, that are to be learned."""
        first = len(self.spans)
        last: dict[tuple[str, str], int] = {}
        place = 0
        for k, node in enumerate(_candidates(text), first):
            a, b = node.start, node.end
            while place < len(found) and found[place][2] <= a:
                place += 1
            kind, at = NONE, place
            while at < len(found) and found[at][0] < b:
                s, found_kind, e = found[at]
                if e > a and (node.form != TOKEN or s <= a and b <= e):  # a secret may hold a number
                    kind = min(kind, found_kind)
                at += 1
            self.spans.append((document, a, b))
            self.features.append(_features(text, node))
            self.labels.append(kind)
            if told is not None:
                mine = [label for s, label, e in told if s < b and a < e]
                secret = node.form == TOKEN and (node.keyed or _ACCESS_KEY.fullmatch(text, a, b))
                self.truth.append(kind if kind != NONE else mine[0] if mine else SECRET if secret else NONE)
            if k > first:
                self.edges.append((k - 1, k, 0))
            whole, parts = _keys(text, node)
            linked = {}
            for kind_of_edge, key in ((1, whole), *((2, x) for x in parts)):
                if key in last:
                    linked.setdefault(last[key], kind_of_edge)
                last[key] = k
            self.edges += [(j, k, e) for j, e in linked.items()]


def spoiled(text: str, span: Span, rng: random.Random) -> str:
    """A find so written that its pattern misses it."""
    a, kind, b = span
    s = text[a:b]
    if kind == EMAIL:
        name, domain = s.split("@", 1)
        hidden = domain.replace(".", rng.choice([" [dot] ", " (dot) "]))
        return rng.choice([f"{name}@{domain.split('.')[0]}", f"{name} [at] {hidden}", f"{name}@"])
    if kind == IP:
        return s.replace(".", rng.choice([" . ", ". ", "-"]))
    if kind == CARD:
        return rng.choice([f"{rng.randint(1, 9)} {s}", f"{s} {rng.randint(10, 99)}", "  ".join(re.findall(".{1,4}", _digits(s))), ". ".join(re.findall(".{1,4}", _digits(s)))])
    return rng.choice([s[1:], f"{rng.randint(1, 9)} {s[1:]}", s[1:].replace(" ", ".")])


def decoy(s: str, rng: random.Random) -> str:
    """The like of a text, with other digits and names."""
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.islower() else c for c in s)


def fabricated(rng: random.Random) -> list[tuple[str, int]]:
    """Secrets of public forms, an address in words and what is only long, with the labels."""
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    key = rng.choice(["token", "api_key", "password", "secret"]) + rng.choice([" = ", ": ", "="])
    value = rng.choice([some("abcdef" + digits, rng.choice([32, 40])), some(small + small.upper() + digits, rng.randint(20, 44)), some(small + digits, 8)])
    words = rng.choice("-_/").join([some(small, rng.randint(3, 12)) for _ in range(4)])
    return [
        (f"{key}{rng.choice(['', chr(34)])}{value}", SECRET),
        (f"AKIA{some(small.upper() + digits, 16)}", SECRET),
        (f"{some(small, 5)}.{some(small, 4)} [at] {some(small, 4)} [dot] {some(small, 3)}", EMAIL),
        (f"{words}{rng.choice('-_/')}{some(digits, rng.randint(1, 2))}", NONE),
    ]


def with_copies(text: str, found: list[Span], rng: random.Random, copies: int = 1) -> tuple[str, list[Span]]:
    """The text with spoiled copies and decoys behind it for each find, and their spans with what is to be learned."""
    added: list[tuple[str, int]] = []
    for span in [x for x in found for _ in range(copies)]:
        copy = spoiled(text, span, rng)
        added.append((copy, span[1]))
        if "[at]" not in copy:  # an address in words is one whosever it is
            added.append((decoy(copy, rng), NONE))
    rng.shuffle(added)  # nothing is to be learned from what follows what
    told: list[Span] = []
    for s, kind in added:
        text += " and "
        told.append((len(text), kind, len(text) + len(s)))
        text += s
    return text, told


@dataclass
class Model:
    unary: np.ndarray  # feature, label
    pairs: np.ndarray  # kind of edge, label, label

    @staticmethod
    def untrained() -> Model:
        pairs = np.zeros((3, NONE + 1, NONE + 1))
        pairs[1:] = SKIP_PRIOR * np.eye(NONE + 1)
        return Model(np.zeros((len(FEATURES), NONE + 1)), pairs)


def _unary(graph: Graph, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(graph.spans), weights.shape[1]))
    rows = np.repeat(np.arange(len(graph.features)), [len(f) for f in graph.features])
    np.add.at(out, rows, weights[[i for f in graph.features for i in f]])
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(graph: Graph, penalty: float = PENALTY) -> Model:
    """Weights under which the label of each node that no pattern found is likeliest, given those of its neighbours."""
    n, k = len(graph.spans), NONE + 1
    if not n:
        return Model.untrained()
    y = np.array(graph.truth)
    free = (np.array(graph.labels) == NONE)[:, None]
    edges = np.array(graph.edges, np.int64).reshape(-1, 3)
    a, b, kind = edges.T
    rows = np.repeat(np.arange(n), [len(f) for f in graph.features])
    flat = np.array([i for f in graph.features for i in f])
    size = len(FEATURES) * k
    one = np.eye(k)[y]
    prior = np.concatenate([np.zeros(size), Model.untrained().pairs.ravel(), np.zeros(3)])
    agree = np.eye(k)
    agree[NONE, NONE] = 0  # a reward that all kinds share, so that the rarer ones learn from the others

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:size].reshape(-1, k), x[size:-3].reshape(3, k, k) + x[-3:, None, None] * agree

    def f(x: np.ndarray):
        w, p = parts(x)
        z = np.zeros((n, k))
        np.add.at(z, rows, w[flat])
        np.add.at(z, a, p[kind, :, y[b]])
        np.add.at(z, b, p[kind, y[a], :])
        q = _softmax(z)
        value = -np.log(np.maximum(q[free[:, 0], y[free[:, 0]]], 1e-300)).sum() + penalty / 2 * ((x - prior) @ (x - prior))
        r = np.where(free, q - one, 0)
        gw, gp = np.zeros_like(w), np.zeros_like(p)
        np.add.at(gw, flat, r[rows])
        np.add.at(gp.transpose(0, 2, 1), (kind, y[b]), r[a])
        np.add.at(gp, (kind, y[a]), r[b])
        return value, np.concatenate([gw.ravel(), gp.ravel(), (gp * agree).sum(axis=(1, 2))]) + penalty * (x - prior)

    return Model(*parts(_minimise(f, prior, 200)))


def beliefs(graph: Graph, model: Model, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes' labels by damped loopy message passing, and which nodes' messages have settled; nodes that a pattern found are held."""
    n, k = len(graph.spans), NONE + 1
    unary = _unary(graph, model.unary)
    labels = np.array(graph.labels, np.int64)
    held = np.flatnonzero(labels != NONE)
    unary[held] = -50.0
    unary[held, labels[held]] = 0.0
    if not graph.edges:
        return _softmax(unary) if n else unary, np.ones(n, bool)
    a, b, kind = np.array(graph.edges, np.int64).T
    to, of = np.concatenate([b, a]), np.concatenate([a, b])
    potentials = np.concatenate([model.pairs, model.pairs.transpose(0, 2, 1)])  # kind and direction, label of `of`, label of `to`
    which = np.concatenate([kind, kind + len(model.pairs)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(to), k))
    change = np.zeros(len(to))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, to, message)
        new = np.empty_like(message)
        for at in range(0, len(to), EDGES):
            part = slice(at, at + EDGES)
            z = (total[of[part]] - message[back[part]])[:, :, None] + potentials[which[part]]
            top = z.max(axis=1)
            new[part] = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = (new + message) / 2
        change = np.abs(new - message).max(axis=1)
        message = new
        if change.max() < STILL:
            break
    total = unary.copy()
    np.add.at(total, to, message)
    settled = np.ones(n, bool)
    settled[to[change >= STILL]] = False
    return _softmax(total), settled


def find(texts: list[str | None], model: Model, sure: float = SURE) -> list[tuple[list[Span], list[Span], bool]]:
    """Of each text the patterns' spans, all spans, and whether its messages have settled."""
    bases = [base_spans(t or "") for t in texts]
    graph = Graph()
    for k, (t, found) in enumerate(zip(texts, bases, strict=True)):
        if t:
            graph.add(k, t, found)
    every, calm = [list(found) for found in bases], [True] * len(texts)
    if graph.spans:
        p, settled = beliefs(graph, model)
        kind = p.argmax(axis=1)
        new = (kind != NONE) & (p.max(axis=1) >= sure) & (np.array(graph.labels) == NONE)
        for node in np.flatnonzero(new):
            document, a, b = graph.spans[node]
            every[document].append((a, int(kind[node]), b))
        for document in {graph.spans[k][0] for k in np.flatnonzero(new)}:
            every[document].sort()
        for node in np.flatnonzero(~settled):
            calm[graph.spans[node][0]] = False
    return list(zip(bases, every, calm, strict=True))


def write_spans(found: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in found])


def redact(text: str, found: list[Span]) -> str:
    """The text with spans replaced by their kind in brackets; overlapping ones by the first's."""
    out, done = [], 0
    for a, k, b in found:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sample_graph(texts: Iterable[str], seed: int = 1) -> Graph:
    """What is learned from: the texts with spoiled copies and decoys of their finds, and fabricated secrets."""
    graph, rng = Graph(), random.Random(seed)
    for k, text in enumerate(texts):
        found = base_spans(text)
        longer, told = with_copies(text, found, rng, COPIES)
        for s, kind in fabricated(rng) if found else ():
            longer += " as "
            told.append((len(longer), kind, len(longer) + len(s)))
            longer += s
        graph.add(k, longer, base_spans(longer), told)
    return graph


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> Model:
    """Learns on at most ``most`` documents with a digit or an @, those of smallest hash."""
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    chosen = rows.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(most).distinct()
    sample = rows.join(F.broadcast(chosen), "_key", "left_semi").orderBy("_key", "_text").limit(most)  # a key may have many rows
    return train(sample_graph(r["_text"] for r in sample.toLocalIterator()))


#: Texts of about so many characters are looked at together.
SLICE_CHARS = 1_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


_NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "settled"]


def _reported(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                found = find(texts[a:b], shared.value)
                counts = [[sum(s[1] == k for s in base) for base, _, _ in found] for k in range(N_BASE)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _, _ in found]),
                        pa.array([write_spans(every) for _, every, _ in found]),
                        pa.array([len(every) - len(base) for base, every, _ in found], pa.int64()),
                        pa.array([calm for _, _, calm in found]),
                    ],
                    _NAMES,
                )

    return run


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, numbers of the patterns' spans by kind, base_sha256 (of those spans, written), spans (all, written), n_added and settled of each row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS[:N_BASE])
    return rows.mapInArrow(_reported(shared), f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long, settled boolean")


def _redacted(shared, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts = batch.column(text_at).to_pylist()
            for a, b in _slices(texts):
                found = find(texts[a:b], shared.value)
                new = [t if not every else redact(t, every) for t, (_, every, _) in zip(texts[a:b], found, strict=True)]
                columns = [pa.array(new, pa.string()) if k == text_at else batch.column(k).slice(a, b - a) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def redacted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, with every span in the text replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_redacted(shared, docs.columns.index(text), docs.columns), docs.schema)
