"""Token ids of whole texts by the word-end BPE tokenizer, one lookup per word.

White space always ends a token of this tokenizer and carries no id, so a
text's ids are those of its white-space separated words one after another. Arrow
splits and names the words of many texts and parts letters from the signs after
them; each different part is looked up once in a bounded memory, unseen ones are
encoded together, and the ids are gathered by their places. The tokenizer's own marks, as `<|endoftext|>`, are what they are
in the library's default: one id, wherever they stand.
"""

from __future__ import annotations

import os
import string
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from tessera.llm.words import split

#: Parts of words remembered by a task before it forgets all.
REMEMBERED = 500_000
#: Letters up to U+00FF whose lower case is one of them; always in their normal form, and the tokenizer takes a run of them whole.
LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
#: Signs that the tokenizer cuts from letters before them, and takes whole where no letter or digit follows.
SIGNS = string.punctuation


@dataclass(frozen=True)
class Parted:
    """Words as places in parts: letters in lower case (the first `stems` parts) and the signs after them, or the word and an empty part."""

    parts: pa.Array
    stems: int
    first: np.ndarray
    second: np.ndarray


def _parted(words: pa.Array) -> Parted:
    after = pc.utf8_ltrim(words, characters=LETTERS)
    no_more = pc.equal(pc.binary_length(pc.ascii_ltrim(after, characters=SIGNS)), 0)
    plain = pc.and_(no_more, pc.less(pc.binary_length(after), pc.binary_length(words)))
    stems = pc.utf8_lower(pc.ascii_rtrim(words.filter(plain), characters=SIGNS)).dictionary_encode()
    others = pa.chunked_array([after.filter(plain), words.filter(pc.invert(plain)), pa.array([""], pa.string())])
    others = others.combine_chunks().dictionary_encode()
    plain, tails = plain.to_numpy(zero_copy_only=False), others.indices.to_numpy() + len(stems.dictionary)
    first, second = np.empty(len(words), np.int64), np.full(len(words), tails[-1], np.int64)
    first[plain], second[plain] = stems.indices.to_numpy(), tails[: len(stems)]
    first[~plain] = tails[len(stems) : -1]
    return Parted(pa.concat_arrays([stems.dictionary, others.dictionary]), len(stems.dictionary), first, second)


def _laid(ids: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of the runs at these places, one after another; run i of the given ones is ids[ends[i] : ends[i + 1]]."""
    length = np.diff(ends)[places]
    after = np.cumsum(length)
    return ids[np.repeat(ends[:-1][places] - (after - length), length) + np.arange(int(length.sum()))], np.r_[0, after]


class WordIds:
    """Encoder of one worker: texts to ids."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words in lower case, parted by a space, that need no other normal form or cut
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = tuple(str(token) for token in self.tokenizer.get_added_tokens_decoder().values())
        self.remembered = remembered
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts; text i has ids[ends[i] : ends[i + 1]], a null one none."""
        words = split(texts)
        parted = _parted(words.vocabulary)
        known = parted.parts.to_numpy(zero_copy_only=False).tolist()
        found: list[bytes] = []
        step = max(1, self.remembered // 4)
        for start in range(0, len(known), step):
            some = known[start : start + step]
            if len(self.ids) > self.remembered:
                self.ids.clear()
            stems = max(0, parted.stems - start)
            self._together(self.bare, [part for part in some[:stems] if part not in self.ids])
            self._learn([part for part in some[stems:] if part not in self.ids])
            found += map(self.ids.__getitem__, some)
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)]
        ids, ends = _laid(ids, ends, np.column_stack([parted.first, parted.second]).ravel())  # of parts
        ids, ends = _laid(ids, ends[::2], words.codes)  # of words
        return ids, ends[words.ends]

    def forget(self) -> None:
        """Lets the words go, and what Arrow holds without using it: an idle worker keeps the tokenizer only."""
        self.ids = {}
        pa.default_memory_pool().release_unused()

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of unseen words: a run of letters, perhaps with a stop or comma, or anything else."""
        known, stems, tails, others = self.ids, set(), [], []
        for word in words:
            if not word:  # beside leading or trailing white space, or no signs after letters
                known[word] = b""
                continue
            stem, tail = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
            if not _letters(stem):
                if len(word.split()) != 1 or not _ODD.isdisjoint(word) or any(mark in word.lower() for mark in self.marks):
                    known[word] = self._plain(word)
                else:
                    others.append(word)
                continue
            if stem not in known:
                stems.add(stem)
            if tail:
                tails.append((word, stem, tail))
        self._together(self.tokenizer, list(stems))
        for part in range(0, len(others), 2000):
            self._apart(others[part : part + 2000])
        for mark in {tail for _, _, tail in tails}:
            if mark not in known:
                known[mark] = self._plain(mark)
        for word, stem, tail in tails:
            known[word] = known[stem] + known[tail]

    def _apart(self, words: list[str]) -> None:
        """Encodes any words as one text; an id belongs to the word in which its characters start."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(word) + 1 for word in words)])
        owner = np.searchsorted(starts, [start for start, _ in encoded.offsets], "right") - 1
        data = np.array(encoded.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        for word, start, end in zip(words, cuts, cuts[1:]):
            self.ids[word] = data[start:end]

    def _together(self, tokenizer: Tokenizer, stems: list[str]) -> None:
        """Encodes words of letters, many as one text; each ends with the id of a word's end."""
        for part in range(0, len(stems), 2000):
            some = stems[part : part + 2000]
            encoded = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # letters of a newer alphabet than the tokenizer's
                for stem in some:
                    self.ids[stem] = self._plain(stem)
                continue
            data, start = ids.tobytes(), 0
            for stem, end in zip(some, (4 * ends).tolist(), strict=True):
                self.ids[stem] = data[start:end]
                start = end


#: Signs that Python takes for white space and the tokenizer drops or keeps.
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85")


def _letters(word: str) -> bool:
    """Is a word, also in its normal form and in lower case, a run of letters?"""
    return word.isalpha() and (word.isascii() or word.lower().isalpha() and unicodedata.is_normalized("NFC", word))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file, kept between tasks; `forget` is to end each of them."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
