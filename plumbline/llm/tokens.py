"""Token ids of whole texts by a public tokenizer, a batch of texts at a time.

Both vocabularies cut a text into words before any merge, and no merge crosses the place before
a blank that is followed by a printing character. So a batch is cut at such places, every
distinct piece is looked up once, and the ids are gathered back by position. The tokenizer sees a
word only when a worker has not met it. Texts with other white space go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by one worker; the cache starts anew beyond that, which changes no ids.
CACHED_WORDS = 700_000
#: Words given to the tokenizer at once.
BATCH = 2_000
#: Plain words put into one line for it.
LINE = 50

_PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space side by side or at an end, or other than blanks and line ends; the mark that pieces are cut at.
_UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.spaced = self.tokenizer.normalizer is None  # byte-level: a blank belongs to the word after it
        # words that are one to the tokenizer too, whatever stands beside them; a byte-level one has its blank with it
        self.plain, self.joint = re.compile((" " if self.spaced else "") + "[A-Za-zÀ-ÖØ-öø-ÿ]+"), "" if self.spaced else " "
        self.letters: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids and the number of each word's, from plain words put into lines: the tokenizer is called for a line, not for a word."""
        lines = [self.joint.join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        found = self.tokenizer.encode_batch(lines, add_special_tokens=False)
        size = np.concatenate([np.bincount(np.array(e.word_ids, np.int64), minlength=1) for e in found])
        if len(size) != len(words):
            return None
        return np.fromiter(chain.from_iterable([e.ids for e in found]), np.uint32, int(size.sum())), size

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.array(list(map(len, ids)), np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _learn(self, words: list[str]) -> None:
        plain = list(map(bool, map(self.plain.fullmatch, words)))
        for kind in (True, False):
            self._learn_some([w for w, p in zip(words, plain) if p is kind], kind)

    def _learn_some(self, words: list[str], plain: bool) -> None:
        for i in range(0, len(words), BATCH):
            some = words[i : i + BATCH]
            flat, size = (self._lines(some) if plain else None) or self._one_by_one(some)
            first, last = len(self.place), len(self.place) + len(some)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while last > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.pool[self.used : self.used + len(flat)] = flat
            self.start[first:last] = self.used + np.cumsum(size) - size
            self.length[first:last] = size
            self.used += len(flat)
            self.place.update(zip(some, range(first, last)))

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place in the pool of every word; those met for the first time go to the tokenizer."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        found = list(map(self.place.get, distinct))
        if new := [w for w, x in zip(distinct, found) if x is None]:
            self._learn(new)
            found = list(map(self.place.__getitem__, distinct))
        return np.array(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def _ends_word(self, letter: str) -> bool:
        """Whether signs after the letter are a word of their own. The normal form of some letters ends in a mark, which joins them."""
        if letter not in self.letters:
            self.letters[letter] = all((self._plain(letter + x) == np.concatenate([self._plain(letter), self._plain(x)])).all()
                                       if len(self._plain(letter + x)) == len(self._plain(letter)) + len(self._plain(x)) else False for x in ("--", "."))
        return self.letters[letter]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Two places in the pool for every piece: of its word and of the signs after it."""
        if len(self.place) > CACHED_WORDS:
            self._forget()
        # a word and the signs after it are two words to both vocabularies
        core = pc.utf8_rtrim(pieces, characters=_PUNCT)
        cut = pc.and_(pc.and_(pc.not_equal(core, pieces), pc.match_substring_regex(core, r"[\pL\pN]$")), pc.invert(pc.match_substring(pieces, "<|")))
        other = core.filter(pc.and_(cut, pc.invert(pc.string_is_ascii(core))))
        bad = [c for c in pc.utf8_slice_codeunits(other, -1).unique().to_pylist() if not self._ends_word(c)]
        if bad:
            cut = pc.and_(cut, pc.invert(pc.is_in(pc.utf8_slice_codeunits(core, -1), pa.array(bad, core.type))))
        out = np.zeros((len(pieces), 2), np.int64)
        out[:, 0] = self._known(pc.if_else(cut, core, pieces))
        signs = pc.replace_substring_regex(pieces.filter(cut), r"(?s)^.*[\pL\pN]", "")
        out[cut.to_numpy(zero_copy_only=False), 1] = self._known(signs)
        return out

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and where each text's ids begin (with the end at last); a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = pc.if_else(uneven, "", texts)
        if self.spaced:
            even = pc.replace_substring(pc.replace_substring(even, "\n", "\0\n\0"), " ", "\0 ")
        else:
            even = pc.replace_substring(pc.replace_substring(even, "\n", "\0"), " ", "\0")
        cut = pc.split_pattern(even, "\0")
        coded = cut.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        length = self.length[places].sum(axis=1)
        ids = self.pool[runs(self.start[places].ravel(), self.length[places].ravel())]  # of the distinct pieces
        first = np.cumsum(length) - length
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = length[codes]
        flat = ids[runs(first[codes], each)]
        at = np.concatenate([[0], np.cumsum(each)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        if whole := np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            parts = [flat[a:b] for a, b in zip(at, at[1:])]
            for i in whole:
                parts[i] = self._plain(texts[i].as_py())
            flat, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, at


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(file)
