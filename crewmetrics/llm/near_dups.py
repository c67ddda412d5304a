"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes its set of shingles of ``words`` words and a signature of 128 minima. Equal sets are one
   node, so copies never meet each other again.
2. The forest holds 25 orders. In each the nodes are sorted by the signature's columns, taken in another
   sequence with other leading columns. A range shuffle sorts them, so a region of any size spans many tasks.
3. Candidates are neighbours by longest common prefix. Regions are as deep as they need be: all nodes of a region
   meet if it has up to ``REGION`` nodes, a larger one is split by one more column, again and again, and nodes
   that are next to each other meet in any region. A shared prefix has ``DEPTH`` columns at least.
4. Candidates are confirmed on the full sets: first those with the smallest neighbours of each node, then those
   between components. Components come from alternating large-star and small-star steps over the links.
5. Nodes of regions that were split are sorted once more, each with its component. Wider regions are looked at, and
   only nodes of different components meet, so a group of near copies costs rows in proportion to its size. Here rows
   carry a byte of each column in place of a bit, as most pairs of a dense region lie just below the threshold.
6. Nodes of regions that were split even then meet by a prefix filter on their rarest shingles, which misses no pair.

At the threshold itself a pair shares five leading columns in one of 25 orders with probability 1 - 5e-5.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch

COLUMNS, ORDERS, DEPTH, KEY = 128, 25, 5, 20
REGION, NEAR = 8, 2
WIDE_REGION, WIDE_NEAR = 64, 16
#: Pairs of a node that are confirmed before it is asked which others still lie between components.
ROUNDS, WIDE_ROUNDS = (2, 16), ()
#: Differing single bits of two signatures with 0.8 of the columns equal: 12.8 expected, 28 is 4.5 deviations off.
BITS = 28
#: The same for bytes: 25.5 expected, 46 is 4.5 deviations off.
BYTES = 46
WORDS_KEPT = 200_000
#: Buckets of shingles, a power of two, whose counts every task knows as a byte each.
BUCKETS = 1 << 22

_rng = random.Random(1)
_odd = lambda: _rng.getrandbits(64) | 1
_A = np.array([_odd() for _ in range(COLUMNS)], dtype=np.uint64)
_B = np.array([_rng.getrandbits(64) for _ in range(COLUMNS)], dtype=np.uint64)
_MIX, _ONE = np.uint64(_odd()), np.uint64(_odd())


def _sequences() -> np.ndarray:
    """For each order its columns: five of its own, then others."""
    made = []
    for t in range(ORDERS):
        own = list(range(t * DEPTH, (t + 1) * DEPTH))
        made.append(own + _rng.sample([c for c in range(COLUMNS) if c not in own], KEY - DEPTH))
    return np.array(made)


_ORDER = _sequences()


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: dict[bytes, int], width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    width = min(width, n)
    if width < 2:
        return np.unique(h * _ONE)
    value = h[: n - width + 1]
    for j in range(1, width):
        after = h[j : n - width + 1 + j]
        value = value * _MIX + (after ^ (after >> np.uint64(29))) * _ONE
    return np.unique(value ^ (value >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit minima for each set, none of them empty."""
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    made, buffer = np.empty((len(sets), COLUMNS), dtype=np.uint64), np.empty_like(x)
    for j in range(COLUMNS):
        np.multiply(x, _A[j], out=buffer)
        np.add(buffer, _B[j], out=buffer)
        made[:, j] = np.minimum.reduceat(buffer, begin)
    return ((made * _MIX) >> np.uint64(48)).astype(">u2")


def _sign(batches: Iterator[pa.RecordBatch], width: int = 2) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [shingles(t, known, width) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "signature"],
            )


def _orders(fine: bool):
    """A row for each node and order: its key there, its size, a bit (a byte if ``fine``) of each column and its component so far."""

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=">u2").reshape(n, COLUMNS)
                sketch = (sig & 255).astype(np.uint8) if fine else np.packbits((sig & 1).astype(np.uint8), axis=1)
                sketch = [b.tobytes() for b in sketch]
                for t in range(ORDERS):
                    keys = np.ascontiguousarray(sig[:, _ORDER[t]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, t, dtype=np.int32)),
                            pa.array([k.tobytes() for k in keys], pa.binary()),
                            part.column(0),
                            part.column(1),
                            pa.array(sketch, pa.binary()),
                            part.column(3),
                        ],
                        names=_NAMES,
                    )

    return orders


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """If signatures may be of pairs at the threshold, by their bits or their bytes."""
    if x.shape[1] < COLUMNS:
        return np.bitwise_count(x ^ y).sum(axis=1) <= BITS
    return (x != y).sum(axis=1) <= BYTES


def neighbours(
    t: np.ndarray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, component: np.ndarray, most: int, near: int
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among sorted rows, smaller ids first, and the ids in regions of over ``most`` rows.

    ``keys`` is (n, KEY), ``bits`` (n, bytes), a bit or a byte a column. Rows of one component are no pair.
    """
    n, none = len(ids), np.empty((0, 2), dtype=np.int64)
    if n < 2:
        return none, ids[:0]
    common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    common = np.where(t[1:] == t[:-1], common, -1)
    region = np.empty((KEY + 1, n), dtype=np.int64)  # by depth, rows in the region of each row
    for depth in range(DEPTH, KEY + 1):
        number = np.concatenate([[0], np.cumsum(common < depth)])
        region[depth] = np.bincount(number)[number]
    found = [none]
    at, shared = np.flatnonzero(common >= DEPTH), common[common >= DEPTH]
    for k in range(1, most):
        if not len(at):
            break
        ok = (region[shared, at] <= most) | (k <= near)
        a, b = at[ok], at[ok] + k
        other = component[a] != component[b]
        a, b = a[other], b[other]
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        alike = (100 * small >= 80 * large) & _close(bits[a], bits[b])
        found.append(np.stack([np.minimum(ids[a], ids[b])[alike], np.maximum(ids[a], ids[b])[alike]], axis=1))
        more = at + k < n - 1
        at, shared = at[more], shared[more]
        shared = np.minimum(shared, common[at + k])
        at, shared = at[shared >= DEPTH], shared[shared >= DEPTH]
    return np.unique(np.concatenate(found), axis=0), np.unique(ids[region[DEPTH] > most])


def _rows(t, key, ids, sizes, bits, component):
    return (
        np.asarray(t),
        np.frombuffer(b"".join(key), dtype=">u2").reshape(-1, KEY),
        np.asarray(ids),
        np.asarray(sizes),
        np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), len(bits[0]) if len(bits) else COLUMNS // 8),
        np.asarray(component),
    )


_ROW = "t int, key binary, id long, size long, bits binary, component long"
_NAMES = ["t", "key", "id", "size", "bits", "component"]


def _walk(most: int, near: int):
    """Of a sorted partition the pairs (a, b), the nodes of split regions (a, null), and its first and last rows,
    which may have neighbours in other partitions."""

    def found(table: pa.Table) -> pa.RecordBatch:
        pairs, split = neighbours(*_rows(*(table.column(c).to_pylist() for c in range(6))), most, near)
        n = len(pairs) + len(split)
        a = pa.array(np.concatenate([pairs[:, 0], split]))
        b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(split), pa.int64())])
        rest = [pa.nulls(n, kind) for kind in (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        return pa.RecordBatch.from_arrays([a, b, *rest], names=["a", "b", *_NAMES])

    def seam(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in table.combine_chunks().to_batches():
            gap = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([gap, gap, *part.columns], names=["a", "b", *_NAMES])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, 0
        for batch in batches:
            more = pa.Table.from_batches([batch])
            if first < most:
                begin = more.slice(0, most - first)
                first += begin.num_rows
                yield from seam(begin)
            table = more if held is None else pa.concat_tables([held, more])
            yield found(table)
            held = table.slice(max(0, table.num_rows - most))
        if held is not None:
            yield from seam(held)

    return walk


def _seams(most: int, near: int):
    """The same for one order's first and last rows of all partitions; no pair is (a, a)."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values(["key", "id"])
        pairs, split = neighbours(*_rows(*(rows[c] for c in _NAMES)), most, near)
        return pd.DataFrame({"a": np.concatenate([pairs[:, 0], split]), "b": np.concatenate([pairs[:, 1], split])})

    return walk


def candidates(
    nodes: DataFrame, scratch: Scratch, most: int = REGION, near: int = NEAR, fine: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (id, size, signature, component) distinct pairs a < b of different components, and the ids of
    nodes whose regions were split; both saved. ``fine`` compares signatures by bytes and not by bits."""
    n_tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("id", "size", "signature", "component").mapInArrow(_orders(fine), _ROW)
    ordered = rows.repartitionByRange(n_tasks, "t", "key", "id").sortWithinPartitions("t", "key", "id")
    walked = scratch.save(ordered.mapInArrow(_walk(most, near), f"a long, b long, {_ROW}"))
    # Each task's first and last rows, at most ``most`` of either, by order.
    seams = walked.where("id is not null").select(*_NAMES).groupBy("t").applyInPandas(_seams(most, near), "a long, b long")
    inner = walked.where("a is not null").select("a", F.coalesce("b", "a").alias("b"))
    found = scratch.save(inner.unionByName(seams).distinct())
    return found.where("a < b"), found.where("a = b").select(F.col("a").alias("id"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the smallest id reachable) of the ids in ``links`` (a, b) but the smallest themselves; saved."""

    def star(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
        )
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up = 1 and root = 1)").isEmpty():  # every node hangs on its root
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours move to the smallest neighbour, then smaller ones do.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.save(star(both.where("v > u"), least))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = star(large, least).unionByName(least.select("u", F.col("m").alias("v")))
        small = scratch.save(small.distinct())
        scratch.drop(edges)
        scratch.drop(large)
        edges = small


def _sets(batches: Iterator[pa.RecordBatch], width: int = 2) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [shingles(t, known, width).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= 80 * union."""
    sides = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    both = F.size(F.array_intersect("x", "y"))
    return sides.select("a", "b", both.alias("both"), F.size("x").alias("nx"), F.size("y").alias("ny")).where(
        "100 * both >= 80 * (nx + ny - both)"
    ).select("a", "b")


def link(pairs: DataFrame, sets: DataFrame, scratch: Scratch, labels: DataFrame | None = None, rounds: tuple[int, ...] = ()) -> DataFrame:
    """id, component after the confirmed ones of ``pairs`` and, if given, ``labels``.

    Each of the ``rounds`` confirms so many pairs of a node, those with its smallest neighbours, so that most of the others lie
    within one component when the last one confirms all that do not. A node has a bounded number of pairs.
    """
    rank = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    remaining = scratch.save(pairs.withColumn("rank", rank)) if rounds else pairs
    for most in (*rounds, None):
        chosen = remaining if most is None else remaining.where(F.col("rank") <= most)
        if labels is not None and remaining.isEmpty():
            break
        links = confirm(chosen.select("a", "b"), sets)
        if labels is not None:
            links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = components(links, scratch)
        if most is not None:
            side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731, B023
            remaining = scratch.save(
                remaining.where(F.col("rank") > most)
                .join(side("a"), "a", "left")
                .join(side("b"), "b", "left")
                .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
                .select("a", "b", "rank")
            )
    return labels


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that a task's sets (component, items) have shingles in: how many, one component, and if there are others."""
    n, first, shared = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            bucket = part.column(1).flatten().to_numpy(zero_copy_only=False) & (BUCKETS - 1)
            component = np.repeat(part.column(0).to_numpy(), part.column(1).value_lengths().to_numpy())
            new = n[bucket] == 0
            first[bucket[new]] = component[new]
            shared[bucket[first[bucket] != component]] = True
            np.add.at(n, bucket, 1)
    held = np.flatnonzero(n)
    for i in range(0, len(held), 1 << 16):
        at = held[i : i + (1 << 16)]
        columns = [pa.array(at, pa.int32()), pa.array(n[at]), pa.array(first[at]), pa.array(shared[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "component", "shared"])


def _prefixes(codes):
    """A row for each shingle of a set's prefix that components share, with its place in the set's order."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found, places, sizes = [], [], []
                for items in part.column(2):
                    items = items.values.to_numpy(zero_copy_only=False)
                    of = code[items & (BUCKETS - 1)]
                    order = np.lexsort((items, of))[: len(items) - (4 * len(items) + 4) // 5 + 1]
                    at = np.flatnonzero(of[order])
                    found.append(items[order[at]])
                    places.append(at + 1)
                    sizes.append(len(items))
                n = [len(x) for x in found]
                columns = [np.concatenate(found), *(np.repeat(part.column(c).to_numpy(), n) for c in (0, 1)), np.repeat(sizes, n), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "id", "component", "size", "at"])

    return prefixes


def blocked(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``sets`` (id, items, component), read twice, pairs a < b of different components, among them all at the threshold.

    Shingles are ordered by how many sets hold them, rare ones first. The first one that two sets share has at least the
    overlap behind it, so it is among the first 1/5 of the larger set and the first 1/9 of the smaller one. That holds in
    any order that is the same for all sets, so shingles are counted by ``BUCKETS`` buckets of their hashes, first within
    each task: every task then knows the counts, to an eighth of an octave, and only prefixes become rows. Those that one
    component holds alone come first.
    """
    counted = sets.select("component", "items").mapInArrow(_counts, "bucket int, n long, component long, shared boolean")
    held = counted.groupBy("bucket").agg(
        F.least(F.lit(255), F.floor(8 * F.log2(F.sum("n")))).cast("short").alias("code"),
        (F.max("shared") | (F.min("component") < F.max("component"))).alias("shared"),
    )
    held = held.where("shared").select("bucket", "code").toArrow()
    codes = np.zeros(BUCKETS, dtype=np.uint8)  # 0: not shared
    codes[held["bucket"].to_numpy()] = held["code"].to_numpy()
    known = sets.sparkSession.sparkContext.broadcast(codes)
    rows = sets.select("id", "component", "items").mapInArrow(
        _prefixes(known), "item long, id long, component long, size long, at long"
    )
    placed = scratch.save(rows)
    columns = ("id", "component", "size", "at")
    small = placed.where("at <= size - (8 * size + 8) div 9 + 1").select("item", *(F.col(c).alias(f"{c}_a") for c in columns))
    large = placed.select("item", *(F.col(c).alias(f"{c}_b") for c in columns))
    # A stored table of prefixes is many times larger in memory than its files, so it is never broadcast.
    met = small.join(large.hint("merge"), "item").where(
        "component_a <> component_b and (size_a < size_b or size_a = size_b and id_a < id_b) and 5 * size_a >= 4 * size_b "
        "and 9 * least(size_a - at_a + 1, size_b - at_b + 1) >= 4 * (size_a + size_b)"
    )
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text), on shingles of so many ``words``.

    Words are split at white space, A-Z are lower-cased. A null text or one without words has no
    shingles and is linked with nothing, not even its copies. Rows with one doc_id are one node. Rows without
    a doc_id take the component of equal texts but link nothing; alone they have a null component
    and are kept. Links to the smallest doc_id decide ties. No documents give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = scratch.save(
        docs.mapInArrow(lambda batches: _sign(batches, words), docs.select("doc_id").schema.add("n_shingles", "long").add("set_id", "binary").add("signature", "binary"))
    )
    filled = signed.where("set_id is not null")
    copies = scratch.save(
        filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    rows = signed.select("doc_id", "n_shingles", "set_id").join(copies, "set_id", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    nodes = filled.join(copies, "set_id", "left").where(F.coalesce("rep", "doc_id") == F.col("doc_id"))
    nodes = nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "signature")

    pairs, split = candidates(nodes.withColumn("component", F.col("id")), scratch)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(split)
    sets = scratch.save(
        docs.join(scratch.save(ids.distinct()).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("id"), "text")
        .mapInArrow(lambda batches: _sets(batches, words), "id long, items array<long>")
    )
    labels = link(pairs, sets, scratch, rounds=ROUNDS)
    if not split.isEmpty():
        again = nodes.join(split, "id", "left_semi").join(labels, "id", "left")
        again = again.select("id", "size", "signature", F.coalesce("component", "id").alias("component"))
        wide, still = candidates(again, scratch, WIDE_REGION, WIDE_NEAR, fine=True)
        labels = link(wide, sets, scratch, labels, WIDE_ROUNDS)
        if not still.isEmpty():
            hot = sets.join(still, "id", "left_semi").join(labels, "id", "left")
            hot = scratch.save(hot.select("id", "items", F.coalesce("component", "id").alias("component")))
            labels = link(scratch.save(blocked(hot, scratch)), sets, scratch, labels, ROUNDS)
    component = F.coalesce("component", "rep")
    return rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame, words: int = 2) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps: one doc_id of each component.

    Only the ids of rows to be dropped are joined. Rows without a doc_id stay unless their text belongs to a named row.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs, words).where(~F.col("kept")).select("doc_id").distinct()
    gone = scratch.save(found)
    into = "gone"
    while into in docs.columns:
        into += "_"
    return docs.join(gone.withColumnRenamed("doc_id", into), docs["doc_id"].eqNullSafe(F.col(into)), "left_anti")


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[p] || ' ' || ws[p + 1] end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as p from d where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), sn as (
  select s.doc_id, g, n from s join n using (doc_id)
), l as (
  select a.doc_id as a, b.doc_id as b from sn a join sn b on a.g = b.g and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e as (
  select a, b from l union select b, a from l
), r as (
  select a, b from e union select r.a, e.b from r join e on r.b = e.a
), c as (
  select a as doc_id, min(b) as m from r group by a
)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from d left join n using (doc_id) left join c using (doc_id)
"""
