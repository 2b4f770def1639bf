"""Vectors as short codes: each part of a vector is replaced by the number of a codebook's nearest entry.

Components become whole numbers first, so that distances, sums and means are exact
and the same in any order of rows and tasks. Codebooks are trained in rounds over
all rows; a round is one pass that adds up every entry's parts in the tasks, and
only sums per entry reach the driver. The nearest entry is found by the tree of
`gnat`, one per part, which travels with the tasks (its size is that of the
codebooks, whatever the number of rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import gnat
from tessera.llm.common import renamed, small_side, written

#: Parts of a vector, entries of a codebook, rounds of training, steps of one unit.
PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Vectors that a task works on at a time.
SLICE = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries[part]: rows of whole numbers, in their order."""

    entries: tuple[np.ndarray, ...]

    def text(self) -> str:
        """All components by part, entry and position, in decimal digits with commas between."""
        return ",".join(str(x) for part in self.entries for x in part.ravel().tolist())

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def whole_numbers(vector: Column, steps: int) -> Column:
    """floor(steps * x) of every component; null for a vector that is null, empty or holds null, NaN or infinite ones."""
    infinite = F.lit(float("inf"))
    valid = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.when(valid, F.transform(vector, lambda x: F.floor(x.cast("double") * steps)))


def prepared(vectors: DataFrame, vec_id: str, embedding: str, steps: int, **others: str) -> DataFrame:
    """(vec_id, x, others) of the rows with a vector; x is an array of ints of one width, else an error is raised."""
    own = renamed(vectors, vec_id=vec_id, x=whole_numbers(vectors[embedding], steps), **others).where("x is not null")
    size = own.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(F.expr("greatest(array_max(x), -array_min(x))")).alias("far")).first()
    if size["least"] != size["most"]:
        raise ValueError(f"vectors have from {size['least']} to {size['most']} components")
    if (size["far"] or 0) >= gnat.MOST:
        raise ValueError(f"components of {gnat.MOST // steps} or more")
    return own.withColumn("x", F.col("x").cast("array<int>"))


def _parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices with their vectors as [row, part, component]."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, flat.reshape(batch.num_rows, parts, -1)


def _sums(books: Codebooks):
    """(part, entry, place, total): sums of the parts that each entry is nearest to, and their number at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [gnat.Tree(entries) for entries in books.entries]
        shape = len(trees), len(books.entries[0]), books.entries[0].shape[1] + 1
        total = np.zeros(shape, np.int64)
        for _, x in _parts(batches, len(trees)):
            for part, tree in enumerate(trees):
                nearest, _ = tree.search(x[:, part])
                order = np.argsort(nearest, kind="stable")
                used, starts = np.unique(nearest[order], return_index=True)
                total[part, used, 1:] += np.add.reduceat(x[order, part], starts, axis=0)
                total[part, used, 0] += np.diff(np.r_[starts, len(order)])
        part, entry, place = np.indices(shape).reshape(3, -1)
        columns = [pa.array(v.astype(np.int32)) for v in (part, entry, place - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total.ravel())], ["part", "entry", "place", "total"])

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the rows (vec_id, x) that `prepared` returns; they should be written already.

    The first entries are the parts of the rows with the smallest vec_ids, null
    last; of rows that share a vec_id, those of the smallest vector. With fewer ids
    there are fewer entries, without rows none. Nearest is by squared
    distance, the lower number of equally near ones; then each entry moves to the
    floor of its parts' mean, and one that no part is nearest to stays.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    first = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    met = rows.join(F.broadcast(first.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id")), "left_semi")
    starts = met.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    if not starts:
        return Codebooks(())
    if len(starts[0]["x"]) % parts:
        raise ValueError(f"{len(starts[0]['x'])} components can't be cut into {parts} equal parts")
    x = np.array([row["x"] for row in starts], np.int64).reshape(len(starts), parts, -1)
    books = Codebooks(tuple(x[:, part].copy() for part in range(parts)))
    for _ in range(rounds):
        sums = rows.select("x").mapInArrow(_sums(books), "part int, entry int, place int, total long")
        total = np.zeros((parts, len(starts), x.shape[2] + 1), np.int64)
        for row in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
            total[row["part"], row["entry"], row["place"] + 1] = row["total"]
        moved = []
        for old, new in zip(books.entries, total, strict=True):
            count = new[:, :1]
            moved.append(np.where(count > 0, new[:, 1:] // np.maximum(count, 1), old))
        books = Codebooks(tuple(moved))
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with (codes, error) instead of x: numbers of the nearest entries by part, and their squared distances added up."""
    others = [c for c in rows.columns if c != "x"]
    if not books.entries:
        return rows.where("false").select(*others, F.expr("cast(null as array<int>)").alias("codes"), F.lit(0).cast("long").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [gnat.Tree(entries) for entries in books.entries]
        for batch, x in _parts(batches, len(trees)):
            codes, error = np.empty((len(x), len(trees)), np.int32), np.zeros(len(x), np.int64)
            for part, tree in enumerate(trees):
                codes[:, part], squared = tree.search(x[:, part])
                error += squared
            listed = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, len(trees), dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), listed, pa.array(error)], [*others, "codes", "error"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{schema}, codes array<int>, error long")


def decode(books: Codebooks, codes: np.ndarray) -> np.ndarray:
    """The vectors that codes (a row each) stand for, as whole numbers."""
    return np.concatenate([entries[codes[:, part]] for part, entries in enumerate(books.entries)], axis=1)


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, steps: int = STEPS,
) -> DataFrame:
    """(vec_id, codes, error, label_error, codebooks) of every row with a vector.

    Rows whose vector is null, empty or holds null, NaN or infinite components
    are left out. Repeated rows are coded as often as they come and count as
    often; how ties are broken is said at `train`. label_error is the error added
    up over the rows of the row's label, those without a label together.
    codebooks is the text of all entries, the same in every row. Vectors of
    different widths, widths that can't be cut into the parts, and components of
    2^28 / steps or more raise a ValueError. An empty table gives an empty one;
    other columns are neither read nor returned.
    """
    rows = written(prepared(vectors, vec_id, embedding, steps, label=label))
    books = train(rows, parts, entries, rounds)
    coded = written(encode(rows, books))
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    # a label may hold any share of the rows: beyond the broadcast bound its rows are dealt by salt too
    side, salt = small_side(by_label, 8 << 20, 32), F.lit(0)
    if by_label.count() * 32 > 8 << 20:
        side, salt = by_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), F.pmod(F.xxhash64("vec_id"), F.lit(32))
    else:
        side = side.withColumn("_salt", F.lit(0))
    met = coded.withColumn("salt", salt.cast("int")).join(side, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return met.select("vec_id", "codes", "error", "label_error", F.lit(books.text()).alias("codebooks"))
