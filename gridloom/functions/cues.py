"""Cues in prompts: words and phrases, looked up in a plain form of the text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _singular(word: str) -> str:
    return re.sub(r"(?<=[^s]{3})s$", "", word)


def spoken(prompt: Column) -> Column:
    """The words of a prompt in lower case, without apostrophes and plural endings, as an array; null has none."""
    plain = F.translate(F.lower(F.coalesce(prompt, F.lit(""))), "'’", "")
    return F.transform(F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"(?<=[^s]{3})s$", ""))


def has_word(words: Column, cues: str) -> Column:
    """Whether any of the space-separated ``cues`` is among the words."""
    return F.arrays_overlap(words, F.array(*[F.lit(_singular(c)) for c in cues.split()]))


def joined(words: Column) -> Column:
    """The words in one text, with a space before and after each."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def has_phrase(text: Column, *parts: str) -> Column:
    """Whether a choice of one of the ``|``-separated options of each part follows each other in a :func:`joined` text;
    an option may be empty."""
    plain = lambda option: "".join(_singular(w) + " " for w in option.split())
    return text.rlike(" " + "".join(f"(?:{'|'.join(plain(o) for o in p.split('|'))})" for p in parts))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
