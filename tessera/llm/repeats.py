"""Repeated passages: words of windows that also start earlier are removed.

Anchors are eight-word windows at positions 0, 1, 3 and 9 modulo 13. Every
difference modulo 13 is one of two of these positions, so of any two equal
windows of 20 words one shift of at most 12 words puts an anchor into both, at
the same place. So 4 of 13 windows are hashed and dealt by hash, and only
anchors that come more than once are extended: first to the 12 words on either
side, all that a window around the anchor can hold. Of anchors with equal
surroundings the first stays and the windows around the others are repeats, with
nothing more to look at. The firsts of different surroundings are extended to each
of the windows around them, whose words are dealt by hash once more; a window is
a repeat unless it is the first of its words.

Before rows are dealt, each slice of a task keeps one of equal ones and lets the
others pass on by themselves, so that a passage that a third of all documents
hold is dealt once a slice. Of an anchor with more than two surroundings in a
slice, two are dealt: they show that there are several, so the others need
no look at each other and pass on to be extended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed, written_alone
from tessera.llm.words import Ranges, chunks, mixed, split

#: Words of a window.
WINDOW = 20
#: Positions of anchors, a difference cover modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)

#: key, side: two hashes of what is compared; doc_id, at: where it is, the later it comes the larger.
#: Rows that pass on have a key of their own and at < 0, and side says what they are.
DEALT = "key long, side long, doc_id long, at long"
FOUND = "doc_id long, at long, whole boolean"
REPEAT, EXTEND = np.uint64(0), np.uint64(1)
NO_ID = -(1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _located(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, tag) of each row, the tag moved up to where `at` has it."""
    ids, tags = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "tag"))
    return ids, tags.astype(np.int64) << 32


def _thinned(key: np.ndarray, side: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row of equal ones, the first by (doc_id, at), and two of a key; the others pass on."""
    order = np.lexsort((at, doc, side, key))
    key, side, doc, at = key[order], side[order], doc[order], at[order]
    head = np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])] if len(key) else np.array([], bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    later = (doc != doc[first]) | (at != at[first])
    new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else head
    heads = np.cumsum(head)
    third = head & (heads - heads[np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))] > 1)
    spread = mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ at.view(np.uint64))
    passes = later | third
    side = np.where(passes, np.where(later, REPEAT, EXTEND), side)
    key, at = np.where(passes, spread, key), np.where(passes, -1 - at, at)
    stays = head | later  # a row that comes twice is the same row
    return pa.RecordBatch.from_arrays([_signed(key[stays]), _signed(side[stays]), pa.array(doc[stays]), pa.array(at[stays])], ["key", "side", "doc_id", "at"])


def _anchors(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tag, text) to the anchors of every text, with their surroundings as the side."""
    anchor, reach = window - PERIOD + 1, PERIOD - 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 2):
                words, (ids, tags) = split(batch.column("text")), _located(batch)
                lengths = np.diff(words.ends)
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(row)) - words.ends[row]
                here = np.flatnonzero(covered[place % PERIOD] & (place + anchor <= lengths[row]) & (lengths[row] >= window))
                row, place, ranges = row[here], place[here], Ranges(words.hashes())
                left = here - np.minimum(place, reach)
                right = np.minimum(here + anchor + reach, words.ends[row + 1])
                # where the anchor lies in its surroundings is a part of them
                side = mixed(ranges.of(left, right, 1) ^ (here - left).astype(np.uint64))
                yield _thinned(ranges.of(here, here + anchor, 0), side, ids[row], tags[row] + place)

    return run


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tag, text, at: places of anchors) to all windows around these anchors."""
    reach = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 2):
                words, (ids, tags) = split(batch.column("text")), _located(batch)
                counts = np.diff(batch.column("at").offsets.to_numpy())
                row = np.repeat(np.arange(len(counts)), counts)
                place = batch.column("at").flatten().to_numpy(zero_copy_only=False) & 0xFFFFFFFF
                marked = np.zeros(len(words.codes) + 1, np.int64)
                base, last = words.ends[row], words.ends[row + 1] - window
                np.add.at(marked, base + np.maximum(place - reach, 0), 1)
                np.add.at(marked, np.minimum(base + place, last) + 1, -1)
                here = np.flatnonzero(np.cumsum(marked)[:-1] > 0)
                row = np.searchsorted(words.ends, here, "right") - 1
                ranges = Ranges(words.hashes())
                one, other = (ranges.of(here, here + window, i) for i in (0, 1))
                yield _thinned(one, other, ids[row], tags[row] + here - words.ends[row])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, side, doc_id and at: what isn't the first of its key and side is a repeat as a whole.

    The firsts of different sides of one key follow with whole = false.
    """
    last = None  # key, side, doc_id, at of the last first, and whether it has been returned
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        passed = columns[3] < 0
        yield _found(columns[2][passed], -1 - columns[3][passed], columns[1][passed] == REPEAT.view(np.int64))
        key, side, doc, at = (x[~passed] for x in columns)
        if not len(key):
            continue
        if last is not None:  # the row that the last batch ended with goes before
            key, side, doc, at = (np.r_[x, y] for x, y in zip(last[:4], (key, side, doc, at), strict=True))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_side = new_key | np.r_[True, side[1:] != side[:-1]]
        first = np.maximum.accumulate(np.where(new_side, np.arange(len(key)), 0))
        later = (doc != doc[first]) | (at != at[first])
        yield _found(doc[later], at[later], True)
        heads, run = np.flatnonzero(new_side), np.cumsum(new_key)[new_side] - 1
        several = np.bincount(run)[run] > 1
        if last is not None and last[4]:
            several[run == 0] = True
        shown = several.copy()
        if last is not None and last[4]:
            shown[0] = False
        yield _found(doc[heads[shown]], at[heads[shown]], False)
        end = heads[-1]
        last = key[end], side[end], doc[end], at[end], bool(several[-1])


def _found(doc: np.ndarray, at: np.ndarray, whole: bool | np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc), pa.array(at), pa.array(np.broadcast_to(whole, len(doc)))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "whole"])


def _dealt(rows: DataFrame) -> DataFrame:
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "side", "doc_id", "at")
    return sorted_rows.mapInArrow(_judged, FOUND)


def _listed(found: DataFrame) -> DataFrame:
    """The places of each text: doc_id, tag, at."""
    tag = F.shiftright("at", 32).cast("int").alias("tag")
    return found.groupBy("doc_id", tag).agg(F.collect_set("at").alias("at"))


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, anchors, windows) to the text without the words of these windows."""
    reach = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 1):
                n_words, n_removed, texts = [], [], []
                for text, *places in zip(*(batch.column(x) for x in ("text", "anchors", "windows")), strict=True):
                    words = (text.as_py() or b"").split()
                    n_words.append(len(words))
                    starts = []
                    for at, back in zip(places, (reach, 0), strict=True):
                        if at.is_valid:
                            place = at.values.to_numpy(zero_copy_only=False) & 0xFFFFFFFF
                            starts.append((np.maximum(place - back, 0), np.minimum(place, len(words) - window)))
                    if starts:
                        first, last = (np.concatenate(x) for x in zip(*starts, strict=True))
                        marked = np.zeros(len(words) + 1, np.int64)
                        np.add.at(marked, first, 1)
                        np.add.at(marked, last + window, -1)
                        stays = np.cumsum(marked)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stays).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    texts.append(b" ".join(words))
                columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row: its words without those of repeated windows.

    Words are runs of `[^\\x20\\x09-\\x0D]`, unchanged. A word goes if a window of
    so many words that covers it has the words of a window that starts earlier:
    in a smaller doc_id, or before it in the same document. Windows are judged on
    the texts as given. The kept words are joined by one space. Texts without a
    window (null, empty, blank, short) stay; very long ones are judged whole. A
    missing doc_id comes before all others. Rows that share a doc_id are told
    apart by their text: of equal windows at the same place the one whose text
    has the smaller checksum comes first, and a row that comes twice is
    judged as one and returned twice. An empty table gives an empty one. doc_id is
    a whole number; other columns are neither read nor returned.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    rows = renamed(docs, given=docs[doc_id], text=docs[text].cast("binary"))
    kind = rows.schema["given"].dataType.simpleString()
    ids = rows.groupBy("given").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    # tags are 0 where ids tell the rows apart, and so take no room
    tag = F.crc32(F.coalesce("text", F.lit(b""))).bitwiseAND(0x7FFFFFFF).cast("int") if ids else F.lit(0)
    rows = rows.select(F.coalesce(F.col("given").cast("long"), F.lit(NO_ID)).alias("doc_id"), tag.alias("tag"), "text", "given")

    long_enough = rows.where(F.length("text") >= 2 * window - 1).select("doc_id", "tag", "text")
    anchors = written_alone(_dealt(long_enough.mapInArrow(_anchors(window), DEALT)))
    again = long_enough.join(_listed(anchors.where("not whole")), ["doc_id", "tag"]).select("doc_id", "tag", "text", "at")
    windows = written_alone(_dealt(again.mapInArrow(_windows(window), DEALT)).where("whole"))

    whole = _listed(anchors.where("whole")).withColumnRenamed("at", "anchors")
    single = _listed(windows).withColumnRenamed("at", "windows")
    places = whole.join(single, ["doc_id", "tag"], "full").withColumnRenamed("doc_id", "_doc").withColumnRenamed("tag", "_tag")
    met = rows.join(places, (rows["doc_id"] == places["_doc"]) & (rows["tag"] == places["_tag"]), "left")
    return met.select(F.col("given").alias("doc_id"), "text", "anchors", "windows").mapInArrow(
        _kept(window), f"doc_id {kind}, n_words long, n_removed long, text string"
    )
