"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The vocabulary drops white space and never joins across it, so a text's ids are those of
its words in turn. A worker keeps the ids of words it has met (a bounded cache) and asks
the tokenizers library for the others. Texts with control characters that Python and the
library separate differently are encoded whole. A column of texts is split at ASCII white
space by Arrow, and each distinct word of it is looked up once.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import column_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in one of the two generations that a worker remembers.
CACHE_WORDS = 250_000

_ODD = re.compile("[\x1c-\x1f᠎​⁠﻿]")
#: Letters that are composed already, then ASCII marks: pieces which the library's
#: normaliser leaves as they are once in lower case.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The same before lower-casing, which changes Latin-1 letters one by one.
_PLAIN_ANY_CASE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """``ids(text)`` as little-endian unsigned 32-bit bytes.

    Known words are kept in two generations: when the young one is full it becomes the old
    one, and words met again move on, so frequent words are never forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word that isn't among the young ones."""
        ids = self.old.get(word)
        if ids is None:
            low = word.lower()
            plain = _PLAIN.fullmatch(low) if len(low) == len(word) else None
            if plain is None or "<|" in word:
                ids = self.whole(word)
            else:
                letters, marks = plain.groups()
                if not marks and low == word:
                    ids = self._letters(word)
                else:
                    get = self.young.get
                    ids = get(letters) or self._word(letters)
                    if marks:
                        ids += get(marks) or self._marks(marks)
        self._keep(word, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = ids

    def _letters(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _marks(self, marks: str) -> bytes:
        self.young[marks] = ids = self.old.get(marks) or self.whole(marks)
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        get, word = self.young.get, self._word
        out = []
        for w in text.split():
            ids = get(w)
            if ids is None:
                ids = word(w)
                get = self.young.get
            out.append(ids)
        return b"".join(out)

    def _each(self, words: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
        """The ids of distinct words, known or made."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.young.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = self.old.get(words[i])
            out[i] = make(words[i]) if ids is None else ids
            self._keep(words[i], out[i])
        return pa.array(out, pa.large_binary())

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, unsigned 32-bit, and the offsets of the texts.

        A distinct word of letters and marks takes the ids of both, which are looked up
        once each; other words are looked up as they are.
        """
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        plain = pc.extract_regex(words.dictionary, _PLAIN_ANY_CASE)
        fits = plain.is_valid()
        letters = pc.utf8_lower(plain.field("letters").filter(fits)).dictionary_encode()
        marks = plain.field("marks").filter(fits).dictionary_encode()
        parts = [self._each(x.dictionary, make).take(x.indices) for x, make in ((letters, self._letters), (marks, self.whole))]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        others = self._each(words.dictionary.filter(pc.invert(fits)), self.whole)
        order = np.argsort(~fits.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        raw, at = column_bytes(pa.concat_arrays([joined, others]).take(pa.array(place).take(words.indices)))
        ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return raw.view("<u4"), at[ends] // 4


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and cache for each worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encoded(path: str, texts: Iterable[str], end_id: int | None) -> list[bytes]:
    """The ids of each text and the end id, as little-endian unsigned 32-bit bytes."""
    tok, end = tokenizer(path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return [tok.ids(t) + end for t in texts]


def encoded_column(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text of a column without nulls and the end id, one text after the
    other, as unsigned 32-bit values; and the offsets of the texts in them."""
    ids, offs = tokenizer(path).column(texts)
    return np.insert(ids, offs[1:], end_id), offs + np.arange(len(offs))


def largest_id(path: str, end_id: int | None) -> int:
    """The largest id that ``encoded`` can give."""
    return max(end_id or 0, *tokenizer(path).library.get_vocab(with_added_tokens=True).values())
