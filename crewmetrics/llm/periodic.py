"""Runs of words that repeat with a period, by suffix trees of a text and of its reversal.

The longest Lyndon word that begins at a position, under the order of words or under its inverse, is
the root of a run or of none, and every run has such a root. With constant-time longest common
extensions to both sides each root is extended as far as it goes. The extensions come from Ukkonen's
tree of the words and that of the words reversed: a leaf pair's lowest common ancestor is a range
minimum over the Euler tour.

Trees are grown only where a run can stand. In a run of at least ``POWER`` periods all words behind the first
period, (POWER - 1) periods of them, stand within one period of their equal; a stretch of n words
of which one is further than n / (POWER - 1) from its equal is cut there, until nothing is to be cut.
What is left, with its first period before it, holds every run whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs have at least so many words, and so many times their period.
LEAST, POWER = 6, 4
#: Texts are looked at together up to so many words; a longer text alone.
BATCH_WORDS = 200_000
#: Cutting ends after so many rounds at the latest: what is left is then larger, not other.
ROUNDS = 64
#: Euler tours are cut into blocks of so many places.
BLOCK = 16

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (at least 1 each), which a 0 ends; nodes are numbers, 0 the root."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, 0]
        self.begin, self.end, self.child = begin, end, child = [0], [0], [{}]
        self.suffix = suffix = [-1]  # the suffix that a leaf stands for
        link = [0]
        size = len(text)
        node = edge = length = open_ = 0

        def new(a: int, b: int, leaf: int) -> int:
            begin.append(a)
            end.append(b)
            child.append(None if leaf >= 0 else {})
            suffix.append(leaf)
            link.append(0)
            return len(begin) - 1

        for i, c in enumerate(text):
            open_ += 1
            waits = 0  # an inner node of this step whose link is still to be set
            while open_:
                if not length:
                    edge = i
                below = child[node].get(text[edge])
                if below is None:
                    child[node][text[edge]] = new(i, size, i - open_ + 1)
                    if waits:
                        link[waits], waits = node, 0
                else:
                    whole = (end[below] if end[below] <= i else i + 1) - begin[below]
                    if length >= whole:
                        edge, length, node = edge + whole, length - whole, below
                        continue
                    at = begin[below] + length
                    if text[at] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    inner = new(begin[below], at, -1)
                    child[node][text[edge]] = inner
                    begin[below] = at
                    child[inner][text[at]] = below
                    child[inner][c] = new(i, size, i - open_ + 1)
                    if waits:
                        link[waits] = inner
                    waits = inner
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_ + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, children in order, and each suffix's place in it."""
        depths, place = [], [0] * len(self.text)
        stack = [(0, 0)]  # a node still to be entered, or ~node's depth to be met again
        begin, end, child, suffix = self.begin, self.end, self.child, self.suffix
        while stack:
            node, above = stack.pop()
            if node < 0:
                depths.append(above)
                continue
            depth = above + end[node] - begin[node]
            if suffix[node] >= 0:
                place[suffix[node]] = len(depths)
                depths.append(depth)
                continue
            depths.append(depth)
            for symbol in sorted(child[node], reverse=True):
                stack.append((-1, depth))
                stack.append((child[node][symbol], depth))
        return np.array(depths, dtype=np.int64), np.array(place, dtype=np.int64)

    def order(self, descending: bool = False) -> list[int]:
        """Suffixes from the least, words in ascending or descending order; an end comes before any word."""
        found, stack = [], [0]
        child, suffix = self.child, self.suffix
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                found.append(suffix[node])
                continue
            below = child[node]
            names = sorted(below, reverse=not descending)
            if descending and names[0] == 0:  # taken from the end of the stack
                names = [*names[1:], 0]
            stack += [below[s] for s in names]
        return found


class Extensions:
    """Longest common extensions of pairs of suffixes, in constant time each."""

    def __init__(self, tree: SuffixTree):
        depths, self.place = tree.tour()
        n = -(-len(depths) // BLOCK)
        padded = np.full((n, BLOCK), np.iinfo(np.int64).max)
        padded.ravel()[: len(depths)] = depths
        self.flat = padded.ravel()
        self.from_left = np.minimum.accumulate(padded, axis=1).ravel()
        self.from_right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [padded.min(axis=1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.place[a], self.place[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // BLOCK, b // BLOCK
        found = np.minimum(self.from_right[a], self.from_left[b])
        inner = right - left - 1
        for k in range(len(self.table)):
            at = np.flatnonzero((inner >= 1 << k) & (inner < 2 << k))
            if len(at):
                table = self.table[k]
                found[at] = np.minimum(found[at], np.minimum(table[left[at] + 1], table[right[at] - (1 << k)]))
        same = np.flatnonzero(left == right)
        if len(same):
            window = a[same, None] + np.arange(BLOCK)
            inside = window <= b[same, None]
            values = self.flat[np.where(inside, window, a[same, None])]
            found[same] = values.min(axis=1)
        return found


def _next_smaller(order: list[int]) -> np.ndarray:
    """For each position the next one whose suffix is smaller, or the end."""
    n = len(order) - 1  # the first is the empty suffix
    rank = [0] * (n + 1)
    for r, i in enumerate(order):
        rank[i] = r
    found, stack = [n] * n, []
    for i in range(n):
        while stack and rank[stack[-1]] > rank[i]:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, dtype=np.int64)


def runs_of(symbols: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``symbols``, by start and period."""
    n = len(symbols)
    if n < max(least, power):
        return []
    tree = SuffixTree(symbols)
    root = np.tile(np.arange(n), 2)
    period = np.concatenate([_next_smaller(tree.order()), _next_smaller(tree.order(True))]) - root
    short = power * period <= n
    root, period = root[short], period[short]
    right = Extensions(tree)(root, root + period)
    del tree
    back = Extensions(SuffixTree(symbols[::-1]))
    left = np.where(root > 0, back(n - root, n - root - period), 0)  # a reversed suffix at n is empty
    length = period + left + right
    long = (length >= least) & (length >= power * period)
    return sorted(set(zip((root - left)[long].tolist(), length[long].tolist(), period[long].tolist())))


def _regions(ids: np.ndarray, owner: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """(first, begin, end): stretches [begin, end) that may hold a run behind its first period, which may
    begin at ``first``. ``ids`` are words, ``owner`` the text of each, ascending."""
    n = len(ids)
    order = np.argsort(owner * (int(ids.max()) + 1) + ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    back = np.full(n, n, dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(back < n)  # a text's first word is never among them, so texts stay apart
    gap = back[at]
    for _ in range(ROUNDS):
        if not len(at):
            return []
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
        size = np.repeat(np.diff(cut), np.diff(cut))
        keep = ((power - 1) * gap <= size) & (size >= least - 1 - max(0, least // power - 1))
        if keep.all():
            break
        at, gap = at[keep], gap[keep]
    if not len(at):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
    begin, end = at[cut[:-1]], at[cut[1:] - 1] + 1
    text_begin = np.searchsorted(owner, owner[begin], "left")
    first = np.maximum(text_begin, begin - (end - begin) // (power - 1))
    return list(zip(first.tolist(), begin.tolist(), end.tolist()))


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for t in texts for w in t], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begins = np.cumsum([0, *map(len, texts)])
    for first, _, end in _regions(ids, owner, least, power) if len(ids) else []:
        text = int(owner[first])
        low, high = int(begins[text]), int(begins[text + 1])
        for start, length, period in runs_of(ids[first:end].tolist(), least, power):
            a, b = first + start, first + start + length
            # One that goes on outside is part of a run which another stretch holds whole.
            if a > low and ids[a - 1] == ids[a - 1 + period] or b < high and ids[b] == ids[b - period]:
                continue
            found[text].add((a - low, length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist()) if not d]


def find_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` (text, and any other columns, all kept) with two more columns.

    ``runs`` holds start (number of the first word), length and period, all in words, of every
    run: a stretch with this smallest period and at least ``least`` words and ``power`` (2 or more) periods, that
    can't be made longer. They stand by start, then period. ``collapsed`` is the text without the
    words that any run has after its first period, words joined by one space. A null or blank text has
    no words, so no runs and an empty ``collapsed``. Repeated rows are returned each, no rows give none. A
    text is held by one task; a stretch in which runs may stand takes some 400 bytes a word.
    """
    if taken := {runs, collapsed} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(taken)}; name other ones")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size, end = [], 0, begin
                while end < batch.num_rows and size < BATCH_WORDS:
                    texts.append((batch.column(at)[end].as_py() or "").encode("utf-8", "surrogatepass").split())
                    size += len(texts[-1])
                    end += 1
                found = runs_of_texts(texts, least, power)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in text] for text in found]
                left = [b" ".join(collapse(words, text)).decode("utf-8", "surrogatepass") for words, text in zip(texts, found)]
                columns = [*batch.slice(begin, end - begin).columns, pa.array(rows, _RUNS), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, runs, collapsed])
                begin = end

    fields = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def repeat_some(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the contract lets one text in ten repeat its words from some place on.

    A text without words, or of a null doc_id, stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                h = crc32(str(doc_id).encode())
                if doc_id is None or h % 10:
                    continue
                words, g = (texts[row] or "").encode("utf-8", "surrogatepass").split(), h // 10
                if words:
                    a = g % len(words)
                    period = 1 + (len(words) - a) // (3 + g % 8)
                    tail = (words[a : a + period] * (len(words) // period + 1))[: len(words) - a]
                    texts[row] = b" ".join(words[:a] + tail).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256 of every
    row of ``docs`` as ``repeat_some`` leaves it."""
    found = find_runs(repeat_some(docs))
    # Greatest length, then least start, then least period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("longest"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("longest.s")).alias("start"),
        F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.n div -longest.p").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


ORACLE = r"""
with recursive crc(n, step, c) as (
  select n, 0, n::ubigint from range(256) t(n)
  union all
  select n, step + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from crc where step < 8
), tab as (
  select list(c order by n) as tab from crc where step = 8
), d as (
  select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    xor(list_reduce(list_prepend(4294967295::ubigint, [ord(x)::ubigint for x in string_split(cast(doc_id as varchar), '')]),
      lambda c, x: xor(c // 256, tab[(xor(c, x) % 256)::bigint + 1])), 4294967295::ubigint)::bigint as h
  from documents, tab
), p as (
  select row, doc_id, ws, len(ws) as n, h // 10 as g, h % 10 = 0 and len(ws) > 0 as changed from d
), a as (
  select *, case when changed then g % n end as a, case when changed then 1 + (n - g % n) // (3 + g % 8) end as step from p
), t as (
  select row, n, i, ws[1 + case when changed and i >= a then a + (i - a) % step else i end] as w
  from (select *, unnest(range(n)) as i from a)
), e as (
  select x.row, x.n, x.i, y.i - x.i as q from t x join t y on x.row = y.row and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n
), s as (
  select row, q, min(i) as start, count(*) + q as length from (
    select *, i - row_number() over (partition by row, q order by i) as island from e
  ) group by row, q, island
), r as (
  select row, start, length, min(q) as period from s where length >= 6 and length >= 4 * q group by row, start, length
), lost as (
  select distinct row, unnest(range(start + period, start + length)) as i from r
), kept as (
  select row, string_agg(w, ' ' order by i) as words from t anti join lost using (row, i) group by row
), b as (
  select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    first({'start': start, 'length': length, 'period': period} order by length desc, start, period) as x from r group by row
)
select doc_id, coalesce(n_runs, 0) as n_runs, x.start as start, x.length as length, x.period as period,
  1000 * x.length // x.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from a left join b using (row) left join kept using (row)
"""
