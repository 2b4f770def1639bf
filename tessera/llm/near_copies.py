"""Near copies by the share of word shingles two texts have in common, for the pipeline.

Texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Pairs are proposed in two ways and verified over the
shingles themselves: by ball hashing of the sets' SimHash fingerprints, as in
`simhash`, and, as pairs at 0.8 differ in 4 to 14 of 64 bits, by MinHash bands as
well. A pair at exactly 0.8 shares none of the `BANDS`
bands once in 13,000 times, a closer one less often. Texts with equal sets are
one class from the start.

A bucket of n classes proposes a forest of at most n - 1 pairs, not all of its
pairs. The classes carry odd sketches, one bit per hash value that says whether
an odd number of the set's hashes have it; sketches of two sets differ in no more
bits than the sets differ in elements, so that pairs whose sketches differ in too
many bits are out for certain, and the others are joined closest first. Proposed
pairs are verified over whole sets. In a bucket with a pair that fails, each
class outside of the bucket's largest group of connected classes then proposes
its closest ones of every other group, without the failed ones: few, and four
times as many in each further round if some are left. When none are left, every
pair of a bucket that is similar enough is connected. Crowded buckets are cut
into blocks: first every block is worked on alone, then the classes outside of
the bucket's largest group meet all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import renamed, written, written_alone
from tessera.llm.components import components

#: Words of a shingle, seed of the hashes, MinHash bands and the values that a band joins.
SHINGLE, SEED, BANDS, ROWS = 5, 42, 24, 5
#: Least similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
#: Classes of a bucket that are worked on together, and pairs that a class proposes with a group after the first round.
BLOCK, CLOSEST = 1024, 8

SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: ASCII lower case; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)}), np.uint64)


def class_of(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band, which two sets share if their least values in the band are the same."""
    least = np.full(len(SALTS), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 2048):
        mixed = hashes[part : part + 2048, None] ^ SALTS
        for factor in MIX[:2]:
            mixed *= factor
            mixed ^= mixed >> MIX[2]
        np.minimum(least, mixed.min(axis=0), out=least)
    return [
        xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.astype("<u8").reshape(BANDS, ROWS))
    ]


def sketch(hashes: np.ndarray) -> bytes:
    """An odd sketch with four bits and more a shingle, a power of two in all."""
    size = 1 << max(8, (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, cid, size, bits, keys, sketch): each text's class, its number of shingles, its fingerprint, bands and sketch."""
    for batch in batches:
        made = []
        for text in batch.column(1):
            hashes = shingles(text.as_py())
            made.append((class_of(hashes), len(hashes), simhash.majority(hashes), bands(hashes), sketch(hashes)))
        cid, size, bits, keys, sketches = zip(*made, strict=True) if made else ((), (), (), (), ())
        signed = pa.array(np.array(bits, np.uint64).view(np.int64))
        columns = [batch.column(0), pa.array(cid, pa.binary()), pa.array(size, pa.int64()), signed, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cid", "size", "bits", "keys", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingles) of each text, in small batches."""
    for whole in batches:
        for part in range(0, whole.num_rows, 500):
            hashes = [shingles(text.as_py()) for text in whole.column(1).slice(part, 500)]
            columns = [pa.array(map(class_of, hashes), pa.binary()), pa.array([x.view(np.int64) for x in hashes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared whole."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("mine"))
    other = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("its"))
    both = pairs.join(one, "a").join(other, "b")
    # |A n B| / |A u B| >= OVER / UNDER, in whole numbers
    common = F.size(F.array_intersect("mine", "its"))
    return both.where((OVER + UNDER) * common >= OVER * (F.size("mine") + F.size("its"))).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the root that their cid is connected to, itself if with none."""
    return nodes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


class Sketched:
    """Sets of a cell by their sizes and sketches; pairs that failed are no longer near each other."""

    def __init__(self, size: np.ndarray, sketches: list[bytes], failed: list[set[int]]):
        self.size, self.failed = size, failed
        self.words = [np.frombuffer(x, np.uint64) for x in sketches]
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(w) for w in self.words}:
            members = np.array([i for i, w in enumerate(self.words) if len(w) == width])
            self.groups[width] = members, np.stack([self.words[i] for i in members])

    def far(self, x: int) -> np.ndarray:
        """The share of bits that differ from set x, infinite where the sets can't be similar enough."""
        out = np.full(len(self.size), np.inf)
        for width, (members, matrix) in self.groups.items():
            mine = self.words[x]
            if 2 * width == len(mine):
                mine = mine[:width] ^ mine[width:]
            elif width == 2 * len(mine):
                matrix = matrix[:, : len(mine)] ^ matrix[:, len(mine) :]
            elif width != len(mine):
                continue  # the sizes are too different
            differ, sizes = np.bitwise_count(matrix ^ mine).sum(axis=1, dtype=np.int64), self.size[x] + self.size[members]
            near = (UNDER + OVER) * np.maximum(differ, np.abs(self.size[x] - self.size[members])) <= (UNDER - OVER) * sizes
            out[members[near]] = differ[near] / sizes[near]
        out[[x, *self.failed[x]]] = np.inf
        return out


def forest(sets: Sketched, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that join all sets that may be similar, closest first, where sets of one root are joined already.

    This is Prim's algorithm with a row of distances at a time.
    """
    n = len(root)
    cost, via, todo, found = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        x = int(np.where(todo, cost, np.inf).argmin())
        if not todo[x]:  # nothing is near what has been joined: go on elsewhere
            x = int(todo.argmax())
        elif 0 <= cost[x] < np.inf:
            found.append((int(via[x]), x))
        todo[x] = False
        far = sets.far(x)
        closer = far < cost
        cost[closer], via[closer] = far[closer], x
        cost[root == root[x]] = -1
    return found


def closest(sets: Sketched, root: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """For each set outside of the largest root, its closest ones of every other root, and whether there are more."""
    found, more = [], False
    for x in np.flatnonzero(root != np.bincount(root).argmax()).tolist():
        far = np.where(root == root[x], np.inf, sets.far(x))
        near = np.flatnonzero(far < np.inf)
        order = near[np.lexsort((far[near], root[near]))]
        rank = np.arange(len(order)) - np.searchsorted(root[order], root[order])
        found += [(x, int(y)) for y in order[rank < most]]
        more |= bool((rank >= most).any())
    return found, more


def _proposed(most: int):
    """(key, a, b, more): pairs of each (key, block), over rows sorted by them: forests, or so many of the closest."""

    def of_block(rows: dict[str, list]) -> list[tuple[int, bytes, bytes, bool]]:
        place = {c: i for i, c in enumerate(dict.fromkeys(rows["cid"]))}
        once = list({c: i for i, c in enumerate(rows["cid"])}.values())  # a class may come as both of a cell's sides
        cid, size, roots, sketches, known = ([rows[name][i] for i in once] for name in ("cid", "size", "root", "sketch", "failed"))
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        if len(number) < 2:
            return []
        sets = Sketched(np.array(size), sketches, [{place[c] for c in some or () if c in place} for some in known])
        root = np.array([number[r] for r in roots])
        pairs, more = closest(sets, root, most) if most else (forest(sets, root), False)
        return [(rows["key"][0], min(cid[i], cid[j]), max(cid[i], cid[j]), more) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([both.column(x).to_numpy() for x in ("key", "block")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if both.num_rows else np.array([], int)
            rows = both.slice(0, int(starts[-1])).to_pydict() if len(starts) > 1 else {}
            made = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                made += of_block({name: column[a:b] for name, column in rows.items()})
            held = both.slice(int(starts[-1])) if len(starts) else None
            yield _pairs(made)
        if held is not None:
            yield _pairs(of_block(held.to_pydict()))

    return run


def _pairs(made: list[tuple[int, bytes, bytes, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)], ["key", "a", "b", "more"])


def _propose(placed: DataFrame, classes: DataFrame, most: int = 0) -> DataFrame:
    """Pairs of the cells (key, block, cid, root, failed)."""
    cells = placed.join(classes.select("cid", "size", "sketch"), "cid").select("key", "block", "cid", "size", "root", "sketch", "failed")
    dealt = cells.repartition("key", "block").sortWithinPartitions("key", "block", "cid")
    return written_alone(dealt.mapInArrow(_proposed(most), "key long, a binary, b binary, more boolean"))


def _cells(rooted: DataFrame, block: int) -> DataFrame:
    """(key, block, cid, root): every class with every one outside of the bucket's largest group, in cells of about two blocks.

    The classes outside are cut into blocks of their own, and each of these
    meets each block of the bucket.
    """
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    outside = F.greatest(F.lit(1), F.ceil((F.sum("n") - F.max("n")) / block)).cast("int")
    known = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), outside.alias("parts"))
    rows = rooted.join(known, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("parts", F.when(F.col("blocks") > 1, F.col("parts")).otherwise(1))
    columns = ["key", (F.col("part") * F.col("blocks") + F.col("own")).alias("block"), "cid", "root"]
    inside = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns)
    minor = rows.where("root <> major and blocks > 1").withColumn("part", F.pmod(F.hash("cid"), F.col("parts")))
    return inside.union(minor.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns))


def _ball_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes of linked fingerprints, the least class of each, and each class with the least one of its fingerprint."""
    first = written(classes.groupBy("bits").agg(F.min("cid").alias("first")))
    ends = [first.select(F.col("bits").alias(x), F.col("first").alias(f"first_{x}")) for x in ("a", "b")]
    linked = simhash.links(first).join(ends[0], "a").join(ends[1], "b").select("first_a", "first_b")
    equal = classes.select("bits", "cid").join(first, "bits").where("cid <> first").select("cid", "first")
    both = linked.union(equal).toDF("a", "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _roots(docs: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cid, root) of all classes that are connected over classes that are linked by ball hashing or share a band and are similar enough."""
    ball = written_alone(_ball_pairs(classes))
    placed = classes.select("cid", "least", F.explode("keys").alias("key"))
    counts = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    shared = written_alone(placed.join(counts, "key").select("key", "cid", "least", blocks))
    met = ball.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    involved = shared.select("cid", "least").union(classes.join(met, "cid", "left_semi").select("cid", "least")).distinct()
    named = docs.join(involved.select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    texts = named.union(docs.where("doc_id is null")).mapInArrow(_sets, "cid binary, shingles array<long>")
    sets = texts.join(involved.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.any_value("shingles").alias("shingles"))
    sets = written_alone(sets)

    own_block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")
    none = F.lit(None).cast("array<binary>").alias("failed")
    proposed = _propose(shared.select("key", own_block, "cid", F.col("cid").alias("root"), none), classes)
    found = written_alone(_verified(proposed.select("a", "b").union(ball).distinct(), sets))
    roots = written(components(found).withColumnRenamed("node", "cid"))
    failed = written(proposed.join(found, ["a", "b"], "left_anti").select("key", "a", "b"))
    again, most = written(failed.select("key").union(shared.where("blocks > 1").select("key")).distinct()), CLOSEST
    while again.head(1):
        both = failed.select(F.col("a").alias("cid"), F.col("b").alias("other")).union(failed.select("b", "a")).distinct()
        known = both.groupBy("cid").agg(F.collect_set("other").alias("failed"))
        cells = _cells(_rooted(shared.join(again, "key", "left_semi"), roots), block)
        proposed = _propose(cells.join(known, "cid", "left").select("key", "block", "cid", "root", "failed"), classes, most)
        more = written_alone(_verified(proposed.select("a", "b").distinct(), sets))
        again, most = written(proposed.where("more").select("key").distinct()), 4 * most
        if again.head(1):
            failed = written(failed.union(proposed.join(more, ["a", "b"], "left_anti").select("key", "a", "b")))
        if more.head(1):  # else nothing new is connected
            found = written(found.union(more))
            roots = written(components(found).withColumnRenamed("node", "cid"))
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for every row of docs, none dropped.

    component_id is the smallest doc_id reachable over links of similarity 0.8
    or more, the row's own included. Null, empty and blank texts are equal. Rows
    with a null doc_id are compared and get the component of what they are
    linked to, null if that has no doc_id either. Repeated rows are returned as
    often as they come; an empty table gives an empty one. Very long texts are
    compared by all of their shingles; other columns are not read. A bucket of
    more than `block` classes is worked on in blocks.
    """
    own = renamed(docs, doc_id=doc_id, text=docs[text].cast("binary"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = written(own.mapInArrow(_classed, f"doc_id {kind}, cid binary, size long, bits long, keys array<long>, sketch binary"))
    same = rows.groupBy("cid").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("size", "bits", "keys", "sketch")))
    classes = written_alone(same)
    rooted = _rooted(classes.select("cid", "least"), _roots(own, classes, block))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = rooted.join(smallest, "root").select("cid", "component_id")
    return rows.select("doc_id", "cid").join(owners, "cid").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group, with all columns, as `simhash.smallest` states."""
    return simhash.smallest(docs, near_duplicates(docs, doc_id, text), doc_id)
