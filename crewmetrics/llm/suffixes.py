"""Benchmark passages in documents, by suffix arrays over shards of the documents.

Every task cuts its documents into shards of about ``SHARD`` words, sorts all suffixes of a
shard by their first 13 words and looks up every test suffix by binary search. A hit is a window of
13 words that stands in both; neighbouring hits make up the longest verbatim passages.
No document leaves its task; the benchmark goes to all tasks in blocks of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 13
SHARD = 400_000
#: Bytes of benchmark text in one block; the driver and a task hold one block at a time.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z; what is no word character becomes a space. Bytes above ASCII are word characters.
_FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])),
        ),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
    ]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The distinct windows of a block of test items, as rows of indexes into its vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]]):
        vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words(text))
            for i in range(max(len(ids) - WINDOW, 0) + 1 if ids else 0):
                rows.setdefault(ids[i : i + WINDOW], set()).add(item_id)
        self.vocabulary = list(vocabulary)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.rows = np.array([r + (0,) * (WINDOW - len(r)) for r in rows], dtype=np.int64).reshape(-1, WINDOW)
        self.items = [sorted(ids) for ids in rows.values()]


class SuffixArray:
    """All suffixes of a shard, sorted by their first ``WINDOW`` words; number 0 ends each document."""

    def __init__(self, ids: np.ndarray, n_numbers: int):
        self.n = len(ids)
        self.bits = max(1, int(n_numbers).bit_length())
        self.packed = max(1, 63 // self.bits)  # words in one key
        self.ids = np.concatenate([ids, np.zeros(WINDOW + self.packed, dtype=np.int64)])
        self.order, group = self._first()
        depth = self.packed
        while depth < WINDOW and (tied := self._tied(group)).size:
            key = self._key(self.order[tied] + depth)
            again = np.lexsort((key, group[tied]))
            self.order[tied] = self.order[tied][again]
            key, old = key[again], group[tied]
            new = np.flatnonzero((key[1:] != key[:-1]) & (old[1:] == old[:-1])) + 1
            split = np.zeros(len(group), dtype=bool)
            split[1:] = group[1:] != group[:-1]
            split[tied[new]] = True
            group = np.cumsum(split)
            depth += self.packed

    def _key(self, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.int64)
        for j in range(self.packed):
            key = (key << self.bits) | self.ids[np.minimum(at + j, self.n)]
        return key

    def _first(self) -> tuple[np.ndarray, np.ndarray]:
        key = self._key(np.arange(self.n))
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        return order, np.cumsum(np.concatenate([[False], self.keys[1:] != self.keys[:-1]]))

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        same = group[1:] == group[:-1]
        return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, where its run of suffixes begins and ends; equal where it doesn't occur."""
        low_key, high_key = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for j in range(self.packed):
            in_row = (j < lengths) & (j < WINDOW)
            number = rows[:, min(j, WINDOW - 1)]
            low_key = (low_key << self.bits) | np.where(in_row, number, 0)
            high_key = (high_key << self.bits) | np.where(in_row, number, (1 << self.bits) - 1)
        low = np.searchsorted(self.keys, low_key, "left")
        high = np.searchsorted(self.keys, high_key, "right")
        for depth in range(self.packed, WINDOW):
            live = np.flatnonzero((low < high) & (depth < lengths))
            number = rows[live, depth]
            new_low = self._bound(low[live], high[live], depth, number)
            high[live] = self._bound(new_low, high[live], depth, number + 1)
            low[live] = new_low
        return low, high

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, number: np.ndarray) -> np.ndarray:
        """The first place in [low, high) whose suffix has at ``depth`` a word of at least ``number``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = self.ids[np.minimum(self.order[np.minimum(mid, self.n - 1)] + depth, self.n)] < number
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def scan_shard(texts: list[list[bytes]], blocks: Iterator[Windows]) -> pa.StructArray:
    """For each text, as words: its number of words, those hit, the items found and the hit passages."""
    numbers: dict[bytes, int] = {}
    ends = np.cumsum([len(t) + 1 for t in texts])
    ids = np.zeros(int(ends[-1]) if len(texts) else 0, dtype=np.int64)
    for text, end in zip(texts, ends):
        ids[end - 1 - len(text) : end - 1] = [numbers.setdefault(w, len(numbers) + 1) for w in text]
    hits = np.zeros(len(ids) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    array = SuffixArray(ids, len(numbers)) if len(ids) else None
    for block in blocks if array else ():
        known = np.array([numbers.get(w, 0) for w in block.vocabulary] or [0], dtype=np.int64)
        rows = known[block.rows]
        inside = np.arange(WINDOW) < block.lengths[:, None]
        live = np.flatnonzero(((rows > 0) | ~inside).all(axis=1))
        low, high = array.search(rows[live], block.lengths[live])
        for w, a, b in zip(live, low, high):
            if a < b:
                at = array.order[a:b]
                np.add.at(hits, at, 1)
                np.add.at(hits, at + block.lengths[w], -1)
                for text in np.unique(np.searchsorted(ends, at, "right")):
                    items[text].update(block.items[w])
    hit = np.cumsum(hits[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    first, after = edges[::2], edges[1::2]  # a document's end is never hit, so no run crosses it
    owner = np.searchsorted(ends, first, "right")
    found = []
    for i, (text, end) in enumerate(zip(texts, ends)):
        a, b = np.searchsorted(owner, [i, i + 1]) if items[i] else (0, 0)
        begin = end - 1 - len(text)
        spans = [{"first": int(x - begin), "n": int(y - x)} for x, y in zip(first[a:b], after[a:b])]
        found.append({"n_words": len(text), "n_hit": sum(s["n"] for s in spans), "items": sorted(items[i]), "spans": spans})
    return pa.array(found, type=_ARROW)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcast windows of the benchmark, block by block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    made = []
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        windows = Windows([(r.item_id, r.text) for r in block.toLocalIterator()])
        made.append(benchmark.sparkSession.sparkContext.broadcast(windows))
    return made


def scan(docs: DataFrame, benchmark: DataFrame, into: str = "found", shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, and any other columns, all kept) with one more column ``into``.

    It holds n_words, n_hit (words inside any occurrence of a window), items (ids of the items with
    occurring windows, as sorted strings) and spans (first word and length of each hit passage).
    ``benchmark`` has item_id and text; an item of fewer than 13 words is one window, one without
    words none. A null text has no words, a null item_id counts as an empty string, items
    that repeat an id or a text count by their ids. Repeated documents are all returned; no documents give
    no rows, no benchmark gives rows without hits.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}; name another one")
    blocks = _blocks(benchmark, block_bytes)
    at = docs.columns.index("text")

    def each_block() -> Iterator[Windows]:
        for block in blocks:
            yield block.value
            if len(blocks) > 1:
                del block._value  # a task holds one block; the next shard reads it again from disk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, begin = scan_shard(texts, each_block()), 0
            for batch in held:
                more = found.slice(begin, batch.num_rows)
                begin += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, more], names=[*batch.schema.names, into])

        for batch in _slices(batches):
            held.append(batch)
            more = [words(t) for t in batch.column(at).to_pylist()]
            texts += more
            size += sum(map(len, more))
            if size >= shard:
                yield from flush()
                held, texts, size = [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def _slices(batches: Iterator[pa.RecordBatch], n: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs`` (see ``scan``)."""
    found = scan(docs.select("doc_id", "text"), benchmark, "found", **options)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated(F.col("found.n_hit"), F.col("found.n_words")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which fewer than one word in twenty stands in a benchmark passage."""
    into = "found"
    while into in docs.columns:
        into += "_"
    found = scan(docs, benchmark, into, **options)
    return found.where(~contaminated(F.col(f"`{into}`.n_hit"), F.col(f"`{into}`.n_words"))).drop(into)


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), iw as (
  select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[p : p + 12], ' ') as w
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as p from b where len(ws) > 0)
), dw as (
  select doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') as w
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from iw) where len(ws) >= n)
), m as (
  select distinct doc_id, p, dw.n, item_id from dw join iw on dw.w = iw.w and dw.n = iw.n
), h as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from m) group by doc_id
), i as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from m) group by doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""
