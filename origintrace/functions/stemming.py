"""English suffix stripping (Porter, 1980) on columns of token arrays.

A table of words gets its stems by expressions, see ``porter``. Arrays of tokens in their order get them here,
inside the scan stage and without a shuffle: the tokens of an Arrow batch become numbers of a dictionary, Python
sees each different word of the batch once and remembers its stem, and the numbers bring the stems to their places.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Executors need not have this package installed: its functions travel with the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = 1 << 18  # stems a worker remembers before it starts afresh

# --- fixed values: suffixes and their replacements, by step, as published -------------------------
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

VOWELS = "aeiou"


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in VOWELS or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many vowel runs are followed by a consonant run."""
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("cc")


def _longest_suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and _has_vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_end(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
        if word.endswith(suffix):
            return word
    return word


def _replace(word: str, table: dict[str, str]) -> str:
    suffix = _longest_suffix(word, table)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def _remove(word: str) -> str:
    suffix = _longest_suffix(word, STEP_4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if suffix == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem if _measure(stem) > 1 else word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(word: str) -> str:
    """The stem of one word, in lower case; words of one or two letters stay."""
    word = word.lower()
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2), STEP_3)
    return _tidy(_remove(word))


_known: dict[str, str] = {}


def _remembered(word: str) -> str:
    found = _known.get(word)
    if found is None:
        if len(_known) >= MEMORY:
            _known.clear()
        found = _known[word] = stem_word(word)
    return found


def _stems(words: pa.Array) -> pa.Array:
    """Arrays with every token replaced by its stem; null arrays and null tokens stay."""
    # Of a slice, the offsets start at its own first token and the values are those of the whole.
    first, last = (words.offsets[i].as_py() for i in (0, -1))
    tokens = words.values.slice(first, last - first).dictionary_encode()
    known = pa.array([None if w is None else _remembered(w) for w in tokens.dictionary.to_pylist()], pa.string())
    offsets = pa.compute.subtract(words.offsets, first)
    return pa.ListArray.from_arrays(offsets, known.take(tokens.indices), mask=words.is_null())


stems = F.arrow_udf(_stems, T.ArrayType(T.StringType()))  # of every token array
