"""Encoding and decoding with a SentencePiece BPE vocabulary by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array,
sorted by as many characters as the longest piece has. Every piece of the
vocabulary is searched in it by bisection; its range holds all places where
the piece occurs. These edges, sorted by their end, are relaxed: the encoding
of a prefix ends in exactly one piece, the one that is compatible with the
last piece of the prefix before it, where two pieces are compatible if
merging their characters in the vocabulary's order gives just these two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.common import renamed

SPACE = "▁"
NEVER = np.int64(1 << 40)


class Pieces:
    """A vocabulary, its merges, and the encoder of a worker."""

    #: Words remembered between batches, characters of a batch.
    REMEMBERED, BATCH = 300_000, 4_000_000

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ":
            raise ValueError("only vocabularies without normalisation and with a space in front are read")
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.special = special
        self.byte = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        if len(self.byte) != 256:
            raise ValueError("only vocabularies with a piece for every byte are read")
        self.id = {self.names[i]: i for i in range(size) if not special[i]}
        # merges come in the order of the scores, the highest first
        order = sorted((i for i in self.id.values()), key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size, -1, np.int64)
        for place, i in enumerate(order):
            if len(self.names[i]) > 1:
                self.rank[i] = place
        self.longest = max(map(len, self.id))
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        if any(SPACE in name.lstrip(SPACE) for name in self.id):
            self.words = re.compile(".+", re.DOTALL)  # pieces may cross words: a text is one word
        self._merges()
        self._alphabet()
        self.known: dict[str, bytes] = {}

    def _merges(self) -> None:
        """Pairs whose concatenation is a piece, and the last merge of each piece."""
        pairs: dict[tuple[int, int], int] = {}
        for name, i in self.id.items():
            for cut in range(1, len(name)):
                left, right = self.id.get(name[:cut]), self.id.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.pairs = pairs
        size = len(self.names)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.usable = np.zeros(size, bool)
        for name, i in self.id.items():
            symbols, last = self._merged(name)
            self.usable[i] = len(symbols) == 1
            if last:
                self.left[i], self.right[i] = last
        slots = 1 << max(12, (16 * len(pairs)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.merged_rank = np.full(slots, -1, np.int64), np.full(slots, NEVER, np.int64)
        self.tries = 1
        for (left, right), i in pairs.items():
            key = left * size + right
            slot = int(self._slot(np.array([key], np.int64))[0])
            tries = 1
            while self.keys[slot] >= 0:
                slot, tries = (slot + 1) % slots, tries + 1
            self.keys[slot], self.merged_rank[slot] = key, self.rank[i]
            self.tries = max(self.tries, tries)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) & self.mask).astype(np.int64)

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merges one by one, the best score first, then from the left: the definition, used for single pieces."""
        symbols, last = [self.id.get(c, -1) for c in text], None
        while len(symbols) > 1:
            options = [(self.rank[m], k) for k in range(len(symbols) - 1) if (m := self.pairs.get((symbols[k], symbols[k + 1]))) is not None]
            if not options:
                break
            _, k = min(options)
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [self.pairs[last]]
        return symbols, last

    def _alphabet(self) -> None:
        """Numbers for the characters of pieces; 1 is any other character, 0 the end of a word."""
        signs = sorted({c for name in self.id for c in name})
        self.sign = np.ones(0x110000, np.uint16)
        self.sign[[ord(c) for c in signs]] = np.arange(2, len(signs) + 2)
        ids = sorted((i for i in self.id.values() if self.usable[i]), key=lambda i: self.names[i])
        self.searched = np.array(ids, np.int64)
        self.sizes = np.array([len(self.names[i]) for i in ids], np.int64)
        low = np.zeros((len(ids), self.longest), ">u2")
        high = np.full((len(ids), self.longest), 0xFFFF, ">u2")
        for row, i in enumerate(ids):
            codes = self.sign[[ord(c) for c in self.names[i]]]
            low[row, : len(codes)] = high[row, : len(codes)] = codes
        self.low, self.high = (x.view(f"S{2 * self.longest}").ravel() for x in (low, high))

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, NEVER if there is none."""
        keys = left * len(self.names) + right
        slot, found = self._slot(keys), np.full(len(keys), NEVER, np.int64)
        for _ in range(self.tries):
            hit = self.keys[slot] == keys
            found[hit] = self.merged_rank[slot[hit]]
            slot = (slot + 1) & int(self.mask)
        return found

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do the characters of two neighbouring pieces merge into just these two?

        Followed back in time: of the symbols at the boundary, the one merged
        later is split, until both are characters. At no time may the merge
        across the boundary have come before the one that took either symbol in.
        """
        x, y = left.copy(), right.copy()
        before_x, before_y = np.full(len(x), NEVER + 1, np.int64), np.full(len(x), NEVER + 1, np.int64)
        good, todo = np.ones(len(x), bool), np.arange(len(x))
        while len(todo):
            across = self._rank_of(x[todo], y[todo])
            bad = (across != NEVER) & (across < before_x[todo]) & (across <= before_y[todo])
            good[todo[bad]] = False
            todo = todo[~bad]
            rank_x, rank_y = self.rank[x[todo]], self.rank[y[todo]]
            split_x = rank_x > rank_y
            split_y = ~split_x & (rank_y >= 0)
            a, b = todo[split_x], todo[split_y]
            before_x[a], before_y[b] = self.rank[x[a]], self.rank[y[b]]
            x[a], y[b] = self.right[x[a]], self.left[y[b]]
            todo = todo[split_x | split_y]
        return good

    def _suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Places of the concatenated text in the order of the next `longest` characters: a suffix array by doubling.

        The first sort is by four characters, which fit into one number.
        """
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(4):
            key = (key << np.uint64(16)) | padded[i : n + i]
        order, length = np.argsort(key), 4
        while length < self.longest:
            rank = np.empty(n, np.int64)
            ordered = key[order]
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            later = np.zeros(n, np.int64)
            later[:-length] = rank[length:] + 1
            key = rank * (n + 2) + later
            order, length = np.argsort(key), 2 * length
        return order

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece."""
        order = self._suffixes(codes)
        padded = np.concatenate([codes, np.zeros(self.longest, codes.dtype)])
        low, high = np.zeros(len(self.searched), np.int64), np.zeros(len(self.searched), np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.longest)
        keys = np.ascontiguousarray(windows[order].astype(">u2")).view(f"S{2 * self.longest}").ravel()
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[low[which] + inside]
        return start, start + self.sizes[which], self.searched[which]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet, all together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum(sizes + 1) - 1
        first = ends - sizes
        codes = self.sign[points].copy()
        codes[ends] = 0
        start, end, piece = self._edges(codes)
        single = np.flatnonzero(codes)
        lone = single[self._unknown(points[single])]
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), -2, np.int64)])
        word_of = np.repeat(np.arange(len(words)), sizes + 1)
        depth = end - first[word_of[start]]
        # numbers of 16 bits are sorted by radix
        by_end = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        start, end, piece, depth = start[by_end], end[by_end], piece[by_end], depth[by_end]
        last = np.full(len(codes) + 1, -1, np.int64)
        back = np.full(len(codes) + 1, -1, np.int64)
        origin = np.zeros(len(codes) + 1, bool)
        origin[first] = True
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(depth)].astype(np.int64), strict=True):
            at, to, with_piece = start[a:b], end[a:b], piece[a:b]
            before = np.where(origin[at], -3, last[at])  # -3: nothing before, -2: a character without a piece
            fits = origin[at] | (before == -2) | (with_piece == -2)
            check = np.flatnonzero(~fits & (before >= 0))
            fits[check] = self.compatible(before[check], with_piece[check])
            fits &= before != -1
            last[to[fits]], back[to[fits]] = with_piece[fits], at[fits]
        self._remember(words, points, first, ends, last, back)

    def _unknown(self, points: np.ndarray) -> np.ndarray:
        """Which characters aren't pieces themselves?"""
        values, inverse = np.unique(points, return_inverse=True)
        return np.array([chr(v) not in self.id for v in values.tolist()], bool)[inverse]

    def _remember(self, words: list[str], points: np.ndarray, first: np.ndarray, ends: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """Follows the relaxed edges back from the end of every word at once."""
        at, owners, found = ends.copy(), [], []
        alive = np.arange(len(words))
        while len(alive):
            owners.append(alive)
            found.append(np.where(last[at[alive]] == -2, -2 - points[at[alive] - 1].astype(np.int64) - 1, last[at[alive]]))
            at[alive] = back[at[alive]]
            alive = alive[at[alive] > first[alive]]
        owner = np.concatenate(owners[::-1]) if owners else np.array([], np.int64)
        ids = np.concatenate(found[::-1]) if found else np.array([], np.int64)
        order = np.argsort(owner, kind="stable")
        ids, counts = ids[order], np.bincount(owner, minlength=len(words))
        stops = np.cumsum(counts).tolist()
        odd = set(np.unique(owner[order][ids < 0]).tolist())
        data, start = ids.astype("<u4", casting="unsafe").tobytes(), 0
        for place, (word, stop) in enumerate(zip(words, stops, strict=True)):
            if place in odd:
                each = [[i] if i >= 0 else [self.byte[b] for b in chr(-i - 3).encode()] for i in ids[start:stop].tolist()]
                self.known[word] = np.array([x for some in each for x in some], "<u4").tobytes()
            else:
                self.known[word] = data[4 * start : 4 * stop]
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; an empty text has none."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            if len(self.known) > self.REMEMBERED:
                self.known.clear()
            stop, chars, parts, new = start, 0, [], {}
            while stop < len(texts) and (stop == start or chars < self.BATCH):
                text = texts[stop]
                words = self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []
                parts.append(words)
                for word in words:
                    if word not in self.known:
                        new[word] = None
                chars, stop = chars + len(text), stop + 1
            if new:
                self._learn(list(new))
            out += [b"".join([self.known[word] for word in words]) for words in parts]
            start = stop
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes joined, the space in front taken off. Broken bytes become replacement signs."""
        data = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if self.special[i] else self.names[i].encode() for i in ids.tolist())
        return data.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The worker's vocabulary, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of whole texts. Null and empty texts have none; rows are neither dropped nor shuffled."""
    own = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                some = batch.slice(part, 2000)
                encoded = pieces.encode([x or "" for x in some.column(1).to_pylist()])
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in encoded])].astype(np.int32)
                flat = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""
    own = renamed(encoded, doc_id=doc_id, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): checksum of the ids and whether they decode to the text.

    A text that holds the vocabulary's sign for a space decodes to a space there.
    """
    own = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        names = [b"" if special else name.encode() for name, special in zip(pieces.names, pieces.special, strict=True)]
        for i, b in pieces.byte_of.items():
            names[i] = bytes([b])
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                some = batch.slice(part, 2000)
                texts = [x or "" for x in some.column(1).to_pylist()]
                encoded = pieces.encode(texts)
                same = []
                for own_text, data in zip(texts, encoded, strict=True):
                    joined = b"".join(map(names.__getitem__, np.frombuffer(data, "<u4").tolist()))
                    same.append(joined.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") == own_text.replace(SPACE, " "))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(x) // 4 for x in encoded]), pa.array([zlib.crc32(x) for x in encoded], pa.int64()), pa.array(same)],
                    ["doc_id", "n_ids", "ids_crc32", "round_trip"],
                )

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")
