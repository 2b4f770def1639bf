"""Packing of tokenised documents into sequences by minimum bin slack.

Documents give whole windows first; what remains of each is shorter than a
window. The counts of those lengths are all that the plan needs: at most one
number per length, whatever the size of the corpus. A bitset subset-sum over
the counts finds, for the longest length left, the multiset that fills its
window closest to capacity; it is used as often as the counts allow, so the
plan has about as many patterns as there are lengths. Spark numbers the pieces
of each length and a lookup turns the number into a window and an offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import renamed, written
from tessera.llm.word_ids import WordIds, encoder
from tessera.llm.words import chunks

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 2048, 1
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 20


def fill_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over a multiset of lengths: (times, {length: how many in the window}).

    Every piece is in exactly one window. The longest length left opens a
    window; bit s of a Python integer says that the pieces looked at so far can
    add up to s.
    """
    if any(not 0 < length <= capacity or n < 0 for length, n in counts.items()):
        raise ValueError("lengths must lie between 1 and the capacity, counts must not be negative")
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = _closest(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[length] // n for length, n in window.items())
        for length, n in window.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
        plan.append((times, dict(sorted(window.items(), reverse=True))))
    return plan


def _closest(left: dict[int, int], room: int) -> dict[int, int]:
    """The pieces whose lengths add up closest to the room from below, longer lengths first."""
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        stages.append((length, reach))
        usable, step = min(left[length], room // length), 1
        while usable:  # 1, 2, 4, ... pieces at once reach every number of them
            taken = min(step, usable)
            reach |= (reach << (taken * length)) & mask
            usable -= taken
            step *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def _cut(batches: Iterator[pa.RecordBatch], known: WordIds, task: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's (doc_id, text); the words it has met are forgotten with it."""
    yield from _coded(batches, known, task, capacity, with_ids)
    known.forget()


def _coded(batches: Iterator[pa.RecordBatch], known: WordIds, task: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for some in chunks(batch, 1, CHUNK):
            rows = []
            ids, ends = known.encode(some.column(1))
            ids = np.insert(ids, ends[1:], END).astype("<u4")  # the ending id after each text
            ends = ends + np.arange(len(ends))
            for row, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                for start in range(first, last, capacity):
                    data = ids[start : min(start + capacity, last)]
                    length = len(data)
                    rows.append((row, start - first, length, zlib.crc32(data), last - first, seen[length], data.tobytes() if with_ids else None))
                    seen[length] += 1
            if not rows:
                continue
            row, start, length, crc, total, number, data = zip(*rows, strict=True)
            columns = [some.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            columns += [pa.array([task] * len(row), pa.int32()), pa.array(number, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_number", "ids"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents cut into whole windows and a rest: one row per piece, numbered among equal lengths of its task."""
    own = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, encoder(tokenizer), TaskContext.get().partitionId(), capacity, with_ids)

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _task int, _number long, ids binary"
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and, if wanted, the ids as bytes.

    A null or empty text is the ending id alone. Repeated rows and rows with a
    null doc_id are packed like others; very long texts are cut into as many
    pieces as they need. An empty table gives an empty one; other columns are
    neither read nor returned.
    """
    cut = written(pieces(docs, tokenizer, capacity, doc_id, text, with_ids))
    by_task = cut.groupBy("length", "_task").agg(F.count("*").alias("_rows"))
    # at most one row per length, so at most `capacity` rows, whatever the corpus
    counts = {length: n for length, n in by_task.groupBy("length").agg(F.sum("_rows")).collect()}
    lookup = _lookup(fill_windows(counts, capacity))
    # one row per task and length: a task's pieces of one length are numbered from where the earlier tasks end
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(starts, ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_number")).drop("_before", "_task", "_number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                first, window, a_window, at = lookup[int(value)]
                entry = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[entry]
                sequence[rows] = window[entry] + inside // a_window[entry]
                offset[rows] = at[entry] + inside % a_window[entry] * value
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
                [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*order, *(["ids"] if with_ids else []))


def _lookup(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number of each of its patterns, that pattern's first window, pieces a window, offset."""
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for times, content in plan:
        at = 0
        for length, n in content.items():
            entries.setdefault(length, []).append((used.get(length, 0), window, n, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        window += times
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in entries.items()}


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens): packed rows with ids put together, padded unless they fill a power of two.

    A group holds at most `capacity` tokens.
    """
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("tokens")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for row, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(b"".join(x["ids"] for x in row), "<u4").astype(np.int32)
                width = tokens if tokens & (tokens - 1) == 0 else capacity
                ids.append(np.r_[data, np.full(width - tokens, pad, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], ["sequence_id", "ids", "tokens"])

    return parts.mapInArrow(join, "sequence_id long, ids array<int>, tokens long")
