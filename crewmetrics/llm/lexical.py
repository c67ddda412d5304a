"""Ranked search of every document for many queries at once, with their common subexpressions shared.

A query is a sum over terms. Terms that the same queries hold make up one set; sets, and sums of sets, that
two or more queries hold together become nodes of a query-sharing DAG. A task scores its documents
shard by shard: it materialises the documents' accumulators of every node once and each query adds
up the few nodes that are left of it. All of it is whole numbers, so the way of adding changes nothing.

Only the best rows of a task leave it. The queries go to all tasks in blocks of a bounded number of
terms; the documents' statistics (how many, how long, how many hold a term) cover all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch

#: Fixed value of the contract: what a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Lower-cases A-Z; what is in no term becomes a space. Bytes above ASCII are in terms.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (query, term) pairs in one block of queries; the driver and a task hold one block at a time.
BLOCK_PAIRS = 8_192
#: A shard of documents ends at either; a longer document is a shard of its own.
SHARD_DOCS, SHARD_WORDS = 512, 1 << 20
#: Accumulators that are held at once.
CELLS = 1 << 22
#: Symbols of a query are paired with so many that follow them, most shared first.
NEAR = 32
#: First round of the last ranking: so many groups a query.
SALT = 16


def share(queries: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, int]], list[list[int]]]:
    """Sets of terms, sums of two symbols, and each query as symbols.

    Symbols count the sets first, then the sums in the order in which they can be computed. Each query's
    symbols stand for each of its terms exactly once.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in terms:
            holders[t].append(q)
    by_holders: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, qs in holders.items():
        by_holders[tuple(qs)].append(t)
    sets = sorted(by_holders.items(), key=lambda x: (-len(x[0]), x[1]))
    symbols: list[list[int]] = [[] for _ in queries]
    for s, (qs, _) in enumerate(sets):
        for q in qs:
            symbols[q].append(s)

    together: dict[tuple[int, int], set[int]] = defaultdict(set)

    def note(q: int, row: list[int], i: int) -> None:
        for other in row[max(i - NEAR, 0) : i] + row[i + 1 : i + 1 + NEAR]:
            together[min(row[i], other), max(row[i], other)].add(q)

    for q, row in enumerate(symbols):
        for i in range(len(row)):
            note(q, row, i)
    queue = [(-len(qs), pair) for pair, qs in together.items() if len(qs) > 1]
    heapq.heapify(queue)
    sums: list[tuple[int, int]] = []
    while queue:
        n, pair = heapq.heappop(queue)
        both = {q for q in together[pair] if pair[0] in symbols[q] and pair[1] in symbols[q]}
        if len(both) < 2:
            continue
        if len(both) < -n:  # others took some of them: not the most shared any more
            together[pair] = both
            heapq.heappush(queue, (-len(both), pair))
            continue
        new = len(sets) + len(sums)
        sums.append(pair)
        for q in sorted(both):
            row = [s for s in symbols[q] if s not in pair]
            symbols[q] = row = [new, *row]
            note(q, row, 0)
        for s in {s for q in both for s in symbols[q][1 : 1 + NEAR]}:
            qs = together[min(s, new), max(s, new)]
            if len(qs) > 1:
                heapq.heappush(queue, (-len(qs), (min(s, new), max(s, new))))
    return [terms for _, terms in sets], sums, symbols


class Plan:
    """The query-sharing DAG of one block as index arrays, and what its terms weigh."""

    def __init__(self, queries: list[tuple[object, dict[bytes, int]]]):
        self.ids = [i for i, _ in queries]
        words = sorted(set(chain.from_iterable(terms for _, terms in queries)))
        self.vocabulary = {w: i for i, w in enumerate(words)}
        weights = {w: n for _, terms in queries for w, n in terms.items()}
        self.weights = np.array([weights[w] for w in words], dtype=np.int64)
        sets, sums, rows = share([sorted(self.vocabulary[w] for w in terms) for _, terms in queries])
        self.set_terms, self.set_at = self._flat(sets)
        self.n_sets, self.n_nodes = len(sets), len(sets) + len(sums)
        level = [0] * self.n_nodes
        for i, (a, b) in enumerate(sums):
            level[len(sets) + i] = 1 + max(level[a], level[b])
        self.levels = []
        for depth in range(1, max(level, default=0) + 1):
            nodes = [n for n in range(len(sets), self.n_nodes) if level[n] == depth]
            self.levels.append((np.array(nodes), *np.array([sums[n - len(sets)] for n in nodes]).T))
        self.query_nodes, self.query_at = self._flat(rows)

    @staticmethod
    def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([0, *map(len, rows)])
        return np.array(list(chain.from_iterable(rows)), dtype=np.int64), ends[:-1]

    def scores(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores [query, document] from what each (document, term) adds."""
        leaves = np.zeros((len(self.weights), n_docs), dtype=np.int64)
        leaves[term, doc] = gain
        nodes = np.empty((self.n_nodes, n_docs), dtype=np.int64)
        nodes[: self.n_sets] = np.add.reduceat(leaves[self.set_terms], self.set_at, axis=0)
        for into, a, b in self.levels:
            nodes[into] = nodes[a] + nodes[b]
        return np.add.reduceat(nodes[self.query_nodes], self.query_at, axis=0)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """doc_ids, the terms of all documents in order, and how many each has; without those that have none."""
    ids, words, sizes = [], [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = (text.as_py() or b"").translate(FOLD).split()
            if found:
                ids.append(doc_id)
                words += found
                sizes.append(len(found))
            if len(ids) >= SHARD_DOCS or len(words) >= SHARD_WORDS:
                yield ids, words, np.array(sizes)
                ids, words, sizes = [], [], []
    if ids:
        yield ids, words, np.array(sizes)


def _occurrences(words: list[bytes], sizes: np.ndarray, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Document, term and how often, of the terms in ``vocabulary``."""
    number = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    at = np.flatnonzero(number >= 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)[at]
    key, tf = np.unique(doc * len(vocabulary) + number[at], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), tf


def _each(blocks: list) -> Iterator[tuple[int, object]]:
    for b, block in enumerate(blocks):
        yield b, block.value
        if len(blocks) > 1:
            del block._value  # a task holds one block; the next shard reads it again from disk


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text"))


def statistics(docs: DataFrame, blocks: list) -> DataFrame:
    """term, df of each term of the blocks' vocabularies (broadcast) that some document holds; under a null
    term how many documents have terms, with ``terms``, all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n_docs, n_terms = 0, 0
        for ids, words, sizes in _shards(batches):
            n_docs += len(ids)
            n_terms += len(words)
            for b, vocabulary in _each(blocks):
                _, term, _ = _occurrences(words, sizes, vocabulary)
                held[b] = held.get(b, 0) + np.bincount(term, minlength=len(vocabulary))
        names: list[bytes | None] = [None]
        df = [n_docs]
        for b, vocabulary in _each(blocks):
            for word, i in vocabulary.items():
                if b in held and held[b][i]:
                    names.append(word)
                    df.append(int(held[b][i]))
        terms = [n_terms] + [0] * (len(names) - 1)
        columns = [pa.array(names, pa.binary()), pa.array(df, pa.int64()), pa.array(terms, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "df", "terms"])

    found = _texts(docs).mapInArrow(count, "term binary, df long, terms long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))


def _search(plans: list, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, words, sizes in _shards(batches):
            norm = np.array([10 + 90 * n * n_docs // n_terms for n in sizes.tolist()], dtype=np.int64)
            # A null id is smaller than any other, as in Spark's order.
            number = np.array([-(1 << 63) if i is None else i for i in ids], dtype=np.int64)
            for b, plan in _each(plans):
                doc, term, tf = _occurrences(words, sizes, plan.vocabulary)
                gain = plan.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
                step = max(1, CELLS // (plan.n_nodes + len(plan.weights)))
                for a in range(0, len(ids), step):
                    here = slice(*np.searchsorted(doc, [a, a + step]))
                    n = min(step, len(ids) - a)
                    scores = plan.scores(doc[here] - a, term[here], gain[here], n)
                    who = np.broadcast_to(number[a : a + n], scores.shape)
                    if b in best:  # a document below the k best of every query is done with
                        hopeful = (scores >= best[b][0][:, -1:]).any(axis=0) if best[b][0].shape[1] == k else slice(None)
                        scores, who = scores[:, hopeful], who[:, hopeful]
                        scores, who = np.hstack([best[b][0], scores]), np.hstack([best[b][1], who])
                    order = np.argsort(who, axis=1, kind="stable")  # equal scores go by id
                    scores, who = np.take_along_axis(scores, order, 1), np.take_along_axis(who, order, 1)
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    best[b] = np.take_along_axis(scores, order, 1), np.take_along_axis(who, order, 1)
        for b, plan in _each(plans):
            if b not in best:
                continue
            scores, who = best[b]
            query, place = np.nonzero(scores > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([plan.ids[q] for q in query], pa.string()),
                    pa.array([None if i == -(1 << 63) else int(i) for i in who[query, place]], pa.int64()),
                    pa.array(scores[query, place], pa.int64()),
                ],
                ["item", "doc_id", "score"],
            )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``k`` best documents with a score above 0.

    ``docs`` has doc_id (long) and text, ``items`` item_id and text; other columns are not read. A null text has
    no terms; an item or a document without terms is in no result. Rows of ``items`` that repeat an
    item_id, or have none, are one item with the terms of them all. Repeated documents are ranked
    each; equal scores stand by ascending doc_id, null first. Ranks are unique from 1. Empty tables give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    terms = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = items.select(F.col("item_id").cast("string").alias("item"), F.explode(terms).alias("term")).distinct()
    pairs = scratch.save(pairs.withColumn("term", F.encode("term", "UTF-8")))
    n_blocks = max(1, math.ceil(pairs.count() / block_pairs))
    in_block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))

    words = []  # blocks of terms, each term in one of them
    for b in range(n_blocks):
        here = F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == b
        rows = pairs.where(here).select("term").distinct().toLocalIterator()
        words.append(spark.sparkContext.broadcast({bytes(r.term): i for i, r in enumerate(rows)}))
    counts = scratch.save(statistics(docs, words))
    whole = counts.where("term is null").first()
    n_docs, n_terms = (whole.df, whole.terms) if whole and whole.df else (0, 0)
    weighed = pairs.join(counts.where("term is not null"), "term")  # a term of no document adds nothing

    plans = []
    for b in range(n_blocks if n_docs else 0):
        queries: dict[object, dict[bytes, int]] = defaultdict(dict)
        for r in weighed.where(in_block == b).toLocalIterator():
            queries[r.item][bytes(r.term)] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        if queries:
            order = sorted(queries.items(), key=lambda x: (x[0] is not None, x[0]))
            plans.append(spark.sparkContext.broadcast(Plan(order)))
    found = _texts(docs).mapInArrow(_search(plans, n_docs, n_terms, k), "item string, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= k)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


ORACLE = r"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), s as (
  select count(*) as n_docs, sum(len(ws))::bigint as n_terms from d where len(ws) > 0
), q as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), o as (
  select row, doc_id, len(ws) as n, term, count(*) as tf
  from (select row, doc_id, ws, unnest(ws) as term from d) where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from o group by term), s
), r as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
  from q join o using (term) join w using (term), s group by all
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0
) where rank <= 10
"""
