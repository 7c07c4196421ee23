"""Encoding whole columns with a public tokenizer of the tokenizers library, each different word once."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docmill.llm._common import ranges

WORDS_HELD = 200_000  # words whose ids a worker keeps; beyond that it starts anew
SLICE = 2 << 20  # bytes of text that are encoded at once

#: Words of small and capital letters of Latin-1: each is one pre-token, and its normal form is its small letters.
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: A Latin-1 letter before ASCII punctuation: one pre-token ends there. (Other letters may have a normal form that ends in no letter.)
_BEFORE_MARK = "([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-/:-@\\[-`{-~])"
#: How special tokens begin; and a capital before a combining mark, which joins it only once it is small. Such texts the library encodes whole.
_SPECIAL = r"<\||[A-Z]\p{M}"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the bytes of a small Latin-1 letter in a byte-level vocabulary: printable bytes as they are, the others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).lower().encode()) for c in range(0xC0, 0x100)}


_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary of that name lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCoder:
    """For word_bpe vocabularies (lower case, white space dropped, a pre-token never reaches from a letter into ASCII punctuation).

    A text's ids are those of its words in a row. Texts are put into small ASCII letters and split at ASCII white space and before the ASCII
    punctuation that follows a letter, both of which the vocabulary's own rules do too; the words are made distinct; the library's model encodes
    each new Latin-1 word, and the library as a whole every other one and the texts that may hold a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _plain(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        latin = [w for w in words if _LATIN.fullmatch(w)]
        parts = [(latin, [[t.id for t in self.model.tokenize(w if w.isascii() else w.translate(_LETTERS))] for w in latin])]
        rest = [w for w in words if not _LATIN.fullmatch(w)]
        parts += [(rest[k : k + 5000], self._plain(rest[k : k + 5000])) for k in range(0, len(rest), 5000)]
        for part, got in parts:
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, flat)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _BEFORE_MARK, r"\1 \2"))
        code = split.flatten().dictionary_encode()
        words = code.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS_HELD:
            self.forget()
            new = words
        self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[np.asarray(code.indices)] if words else np.zeros(0, np.int64)
        size = self.size[number]
        ids = self.ids[ranges(self.start[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.asarray(split.offsets) - split.offsets[0].as_py()]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = np.asarray(pc.match_substring_regex(texts, _SPECIAL))
        if not special.any():
            return self._by_words(texts)
        ids, off = self._by_words(pc.if_else(pa.array(special), "", texts))
        parts = [ids[off[k] : off[k + 1]] for k in range(len(texts))]
        at = np.flatnonzero(special)
        for k, got in zip(at.tolist(), self._plain(texts.take(pa.array(at)).to_pylist()), strict=True):
            parts[k] = np.array(got, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, texts: pa.Array):
        """(first row, ids of these rows in a row, their offsets), slice by slice; nulls have no ids."""
        texts = texts.fill_null("").cast(pa.large_string())
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
            yield i, *self._encode(texts.slice(i, j - i))
            i = j


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    """One coder for each worker process and vocabulary."""
    return WordCoder(path)
