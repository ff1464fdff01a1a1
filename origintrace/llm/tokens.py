"""Token ids of whole texts by a given tokenizer file, with a bounded memo of words per Python worker.

A tokenizer of the form ``WORDWISE`` drops white space and never lets a piece cross it, so the ids of a text are
the ids of its words one after another; with any other file whole texts are encoded. Words are encoded by the ``tokenizers`` library, many at a time, and kept in a
memo of two generations with a bounded number of words each, whatever the size of the data.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: Entries per generation of a memo where a job has memory for it (measured: 250 MB a Python worker, and 350 MB
#: where nothing else is held), and where the worker also serves other stages (120 MB); words longer than
#: ``LONGEST`` are not kept.
ROOMY, ROOMIEST, GENERATION, LONGEST = 500_000, 800_000, 150_000, 40
#: What the tokenizer file defines: how a normalised text falls into pieces, and the end of a piece.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END_OF_PIECE = "</w>"
#: Normalizer, pre-tokenizer and end of a piece for which the two lines above hold, as the file writes them.
WORDWISE = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    END_OF_PIECE,
)

_NOT_PLAIN = re.compile(r"[^\x00-įĲ-ž]|<\|")  # U+0130 and U+0131 do not lower-case one to one
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"[\x09-\x0d\x20\x85\xa0  -     　]+")


class Memo:
    """A dictionary of the entries used last: between one and two generations of them."""

    def __init__(self, generation: int):
        self.generation = generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lacking(self, wanted: set[str]) -> set[str]:
        """Move what is known of ``wanted`` to the young generation and return the rest."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        missing = wanted.difference(self.young)
        again = {w: x for w in missing if (x := self.old.get(w)) is not None}
        self.young.update(again)
        return missing.difference(again)


class Encoder:
    """``encode_many(texts)``: ids as little-endian unsigned integers of 16 bits (32, if the vocabulary needs them)."""

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.wordwise = (rules["normalizer"], rules["pre_tokenizer"], rules["model"].get("end_of_word_suffix")) == WORDWISE
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(END_OF_PIECE)
        self.words, self.pieces = Memo(generation), Memo(generation)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _learn_pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """Pieces encoded in one call: a piece ends at an id whose token has the end mark."""
        missing = list(self.pieces.lacking(wanted))
        known = self.pieces.young
        if missing:
            (encoded,) = self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)
            ids = np.asarray(encoded.ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(missing) and stops[-1] == len(ids):
                data, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
                known.update(zip(missing, [data[i:j] for i, j in zip([0, *stops], stops)]))
            else:
                known.update((p, self._whole(p)) for p in missing)
        return known

    def _learn(self, missing: set[str]) -> list[str]:
        """Put the ids of ``missing`` into the memo; returns those words that are too long to stay there."""
        simple, split, known = {}, {}, self.words.young
        for w in missing:
            if len(w) > LONGEST or "<|" in w or not (w.isascii() or not _NOT_PLAIN.search(w)):
                known[w] = self._whole(w)
            elif w.isalpha():
                simple[w] = w.lower()
            elif w[-1] in ".," and w[:-1].isalpha():
                split[w] = (w[:-1].lower(), w[-1])
            else:
                split[w] = PIECES.findall(w.lower())
        ids = self._learn_pieces(set(simple.values()).union(*split.values()))
        known.update((w, ids[p]) for w, p in simple.items())
        known.update((w, b"".join([ids[p] for p in pieces])) for w, pieces in split.items())
        return [w for w in missing if len(w) > LONGEST]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text counts as empty."""
        if not self.wordwise:
            return [self._whole(t or "") for t in texts]
        out = []
        for i in range(0, len(texts), 64):
            lists = [_words(t) for t in texts[i : i + 64]]
            passing = self._learn(self.words.lacking(set().union(*lists)))
            known = self.words.young
            out += [b"".join(map(known.__getitem__, words)) for words in lists]
            for w in passing:
                del known[w]
        return out


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    if _SEPARATORS.search(text):  # Python takes these four for white space, the tokenizer does not
        return [w for w in _SPACE.split(text) if w]
    return text.split()


@lru_cache(maxsize=2)
def encoder(path: str, generation: int = GENERATION) -> Encoder:
    """One encoder and memo for each tokenizer file and size of the memo in a Python worker."""
    return Encoder(path, generation)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
