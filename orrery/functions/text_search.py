"""Full-text predicates without dictionaries: words, phrases, or and negation.

A query reads like a web search: words are all required, ``"a b"`` is a phrase, ``or`` makes
alternatives of its neighbours, ``-word`` excludes.  Words are runs of letters and digits in
lower case; there is no stemming.  A query without a word matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')


def normalised(text: Column) -> Column:
    """The words in lower case, each with a blank on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def parse(query: str) -> list[list[tuple[bool, str]]]:
    """Alternatives of terms that are all required: whether negated, and the words."""
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, minus_word, word in _TOKEN.findall(query):
        if word.lower() == "or" and not minus_word:
            groups.append([])
            continue
        words = " ".join(re.findall(r"[^\W_]+", (phrase or word).lower()))
        if words:
            groups[-1].append((bool(minus or minus_word), words))
    return [g for g in groups if g]


def matches(texts: Sequence[Column], query: str, language: str | None = None) -> Column:
    """Whether the texts, one behind the other, match; there are no languages with stemming, so only "simple" may be asked for."""
    if language not in (None, "simple"):
        raise ValueError(f"no text search for the language {language}")
    words = normalised(F.concat_ws(" ", *texts))
    found = F.lit(False)
    for group in parse(query):
        every = F.lit(True)
        for negated, term in group:
            hit = words.contains(f" {term} ")
            every = every & (~hit if negated else hit)
        found = found | every
    return found
