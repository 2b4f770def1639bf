"""Near-duplicate documents: 64-bit SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits share a variant that is at
most two bit flips from either. Emitting all 2,081 variants of every
fingerprint finds those pairs without any verification, but shuffles 2,081 rows
a fingerprint. So the fingerprint is cut into halves first: of at most four
differing bits, at most two are in one of the halves, and there the balls of
half that radius, one flip, meet. That is 66 variants of 32 bits, after which
colliding pairs are verified over all 64 bits. A variant that more than
`DENSE` fingerprints share isn't verified pair by pair: its fingerprints emit
their whole balls, where a shared variant is a proof, and are linked to the
smallest of each variant. Both ways are exact, and neither emits all pairs of
a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed, written
from tessera.llm.components import components

#: Words of a shingle, bits that may differ, seed of the hash.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one variant that are compared with each other; beyond that they emit whole balls.
DENSE = 256

ONE = np.uint64(1)
FLIPS_32 = np.array([0, *(1 << i for i in range(32))], np.uint64)
FLIPS_64 = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], np.uint64)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: ASCII lower case, word shingles with repeats, XXH64.

    A null, empty or blank text has no word and the fingerprint zero.
    """
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()  # ASCII letters, ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
        some = hashes[part : part + (1 << 16)]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): one row per document, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    own = renamed(docs, doc_id=doc_id, text=docs[text].cast("binary"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, bits long")


def _variants(flips: np.ndarray, halves: bool):
    """Every fingerprint with each of its variants: (variant, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(0, len(every), 4096 if halves else 256):
                bits = every[part : part + (4096 if halves else 256)]
                if halves:
                    low = (bits & np.uint64(0xFFFFFFFF))[:, None] ^ flips
                    high = (bits >> np.uint64(32))[:, None] ^ flips | np.uint64(1 << 32)
                    made = np.concatenate([low, high], axis=1)
                else:
                    made = bits[:, None] ^ flips
                source = np.repeat(bits, made.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made.ravel().view(np.int64)), pa.array(source.view(np.int64))], ["variant", "bits"]
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(variant, fingerprints, more): sorted rows by variant, in parts of at most DENSE + 1.

    more says that the variant goes on; variants of one fingerprint are left out.
    """
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        bits = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
        ends = np.r_[starts[1:], len(keys)]
        # the first run may go on from the last batch, the last one into the next; of the others only those of two or more count
        inner = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for a, b in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True):
            if keys[a] != key:
                if len(held) > 1:
                    yield key, np.array(held, np.uint64), False
                key, held = keys[a], []
            for part in range(a, b, DENSE):
                held.extend(bits[part : min(b, part + DENSE)])
                while len(held) > DENSE:
                    yield key, np.array(held[: DENSE + 1], np.uint64), True
                    held = held[DENSE:]  # the last one stays, so that parts of a long run overlap
    if len(held) > 1:
        yield key, np.array(held, np.uint64), False


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, dense): links of fingerprints that share a variant, or the fingerprints of a dense variant in a."""
    dense_key = None
    made: list[tuple[int, int, bool]] = []
    for key, bits, more in _runs(batches):
        if more or key == dense_key:
            dense_key = key
            made += [(int(x), int(x), True) for x in bits.view(np.int64)]
        else:
            made += [(int(a), int(b), False) for a, b in _tree(bits)]
        if len(made) > 20_000:
            yield _batch(made)
            made = []
    if made:
        yield _batch(made)


def _batch(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "dense": [r[2] for r in rows]})


def _tree(bits: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that connect what all verified links connect: at most one less than there are fingerprints."""
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
    signed, unseen, found = bits.view(np.int64), np.ones(len(bits), bool), []
    for first in range(len(bits)):
        todo = [first] if unseen[first] else []
        unseen[first] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & unseen)
            unseen[new] = False
            found += [(signed[i], signed[j]) for j in new]
            todo += new.tolist()
    return found


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints within half the radius of one variant are linked to the first of them."""
    key, first = None, 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        bits = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        fresh = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
        heads = np.where(fresh, bits, 0)
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        root = np.where(at >= 0, heads[np.maximum(at, 0)], first)
        key, first = keys[-1], root[-1]
        other = root != bits
        yield pa.RecordBatch.from_arrays([pa.array(bits[other]), pa.array(root[other])], ["a", "b"])


def ball_links(bits: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius, by whole balls of half the radius."""
    variants = bits.select("bits").distinct().mapInArrow(_variants(FLIPS_64, False), "variant long, bits long")
    dealt = variants.repartition("variant").sortWithinPartitions("variant", "bits")
    return dealt.mapInArrow(_stars, "a long, b long").distinct()


def links(bits: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within the radius, by balls of the halves."""
    variants = bits.select("bits").mapInArrow(_variants(FLIPS_32, True), "variant long, bits long")
    dealt = variants.repartition("variant").sortWithinPartitions("variant", "bits")
    found = written(dealt.mapInArrow(_verify, "a long, b long, dense boolean"))
    pairs = found.where("not dense").select("a", "b").distinct()
    dense = found.where("dense").select(F.col("a").alias("bits")).distinct()
    return pairs.union(ball_links(dense)) if dense.head(1) else pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, none dropped.

    component_id is the smallest doc_id reachable over links, the row's own
    included. Null, empty and blank texts have fingerprint zero and are linked
    like others. Rows with a null doc_id are compared and get the component of
    what they are linked to, null if that has no doc_id either. Repeated rows
    are returned as often as they come; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs, doc_id, text))
    classes = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes)).withColumnRenamed("node", "bits")
    rooted = classes.join(roots, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = rooted.join(smallest, "root").select("bits", "component_id")
    return rows.join(owners, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group, with all columns, as `smallest` states."""
    return smallest(docs, near_duplicates(docs, doc_id, text), doc_id)


def smallest(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group in (doc_id, component_id), with all columns.

    Of repeated rows of such a doc_id the smallest row stays. Rows without a
    doc_id can't be named by a group and stay as they are.
    """
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.where(docs[doc_id].isNotNull())
    chosen = named.join(kept, named[doc_id] == kept["_kept_id"], "left_semi")
    row = F.struct(*(chosen[c] for c in docs.columns))
    # the join has dealt the rows by doc_id already: no second shuffle
    one = chosen.groupBy(chosen[doc_id].alias("_id")).agg(F.min(row).alias("_row")).select("_row.*")
    return one.union(docs.where(docs[doc_id].isNull()))
