"""Expressions on whole texts: sentences, tokens, stop words."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from origintrace.constants import ABBREVIATIONS, CONTEXT_CHARS, SPLIT_CHARS, STOP_WORDS

_MARK, _HELD = "\u0001", "\u0002"
_SPACE = r"[ \n\t\r]"
_SPLIT = f"[{SPLIT_CHARS}]+"
_CONTEXT = f"[{CONTEXT_CHARS}]+"


def sentences(text: Column, abbreviations: list[str] = ABBREVIATIONS) -> Column:
    """Pieces that end in one of ``.!?`` followed by white space, but for the full stop of an abbreviation.

    Blank pieces are left out, so an empty text has no sentence.
    """
    short = "|".join(re.escape(a) for a in abbreviations)
    held = F.regexp_replace(text, rf"\b({short})\.(\s)", "$1" + _HELD + "$2") if abbreviations else text
    marked = F.regexp_replace(held, r"([.!?])\s+", "$1" + _MARK)
    pieces = F.filter(F.split(marked, _MARK), lambda s: s.rlike(r"\S"))
    return F.transform(pieces, lambda s: F.replace(s, F.lit(_HELD), F.lit(".")))


def tokens(text: Column) -> Column:
    """Words of a text, in order.

    Split characters separate like white space and vanish. A run of context characters at either
    end of a word becomes a token of its own; inside a word it stays, so links and numbers hold.
    """
    spaced = F.regexp_replace(text, _SPLIT, " ")
    led = F.regexp_replace(spaced, f"(^|{_SPACE})({_CONTEXT})", "$1$2 ")
    ended = F.regexp_replace(led, f"({_CONTEXT})({_SPACE}|\\z)", " $1$2")
    return F.filter(F.split(ended, f"{_SPACE}+"), lambda t: t != "")


def without_stop_words(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Tokens that are not stop words, whatever their case."""
    return F.filter(words, lambda t: ~F.lower(t).isin(stop_words))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits: the terms of the exact TF-IDF."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def run_ends(words: Column) -> Column:
    """Of a sorted array without nulls: the places, from 1, where a run of equal words ends."""
    return F.array_compact(F.transform(words, lambda t, i: F.when(~t.eqNullSafe(F.get(words, i + 1)), i + 1)))


def runs(words: Column, ends: Column) -> Column:
    """(term, tf) of each run of equal words; ``words`` and ``ends``, their ``run_ends``, should be columns of a table."""
    return F.transform(ends, lambda e, k: F.struct(
        F.get(words, e - 1).alias("term"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("long").alias("tf")
    ))
