"""Log-likelihood of whole texts under a gated recurrent language model trained on the corpus itself.

Words are counted over all training texts. The commonest ``SHORT_LIST`` and the end of a text are
symbols of their own in the network's output; every other word is the symbol OTHER there and then drawn by its
smoothed share of the other words, so that the probabilities of all words, unseen ones included, add up to one.
The output softmax is factored: first the class, then the symbol within its class.

Training covers each training text once. Every task trains a copy of the network on its texts by
truncated backpropagation and the copies are averaged, weighted by tokens, after each of ``ROUNDS``
rounds; a round takes the texts that a hash deals to it. Texts run side by side in streams; the
state is carried from window to window and cleared where a text (in training, a piece of one) begins,
so a score is that of the complete text, however long, whatever its neighbours.

Counts of words beyond the ``HEAD`` commonest never meet in one place: the words of texts join
them by a shuffle.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch

#: Words whose counts go to all tasks, of at most LONGEST bytes each; all others are joined.
HEAD, LONGEST = 131_072, 64
#: Symbols of the network: the end of a text, the commonest words, all others.
SHORT_LIST = 1_022
CLASS = 32  # symbols in a class
INPUT, HIDDEN = 16, 16
WINDOW = 16  # steps of backpropagation
SCORED = 64  # steps of a window in which texts are only scored
STREAMS = 256
#: Training learns from longer texts in pieces of so many tokens, so that all streams go on to the end.
PIECE = 2_048
ROUNDS = 2
#: Step of Adagrad, in each round smaller by as much, and the squares of gradients that it begins with.
RATE, SQUARES = 0.05, 1e-7
#: Logits up to here need no shift before they are raised.
STEEP = 60.0
#: Texts are packed into streams together up to so many tokens; a longer text alone.
PACK = 4_000_000
#: The same where texts are only scored: a task holds several numbers and the words not in the head for each token. A
#: pack takes as many steps as its longest text has tokens, so small ones leave most streams empty.
SCORED_PACK = 2_000_000
#: Distinct words that a task counts before it sends them on.
COUNTED = 400_000
#: Numbers in one row where weights are averaged.
SLICE = 16_384

END = b""  # no word is empty
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and where its weights stand in one vector."""

    symbols: int
    size: int = CLASS
    inputs: int = INPUT
    hidden: int = HIDDEN

    @property
    def classes(self) -> int:
        return -(-self.symbols // self.size)

    def parts(self) -> dict[str, tuple[int, ...]]:
        c, s, h = self.classes, self.size, self.hidden
        return {
            "embed": (self.symbols, self.inputs),
            "inner": (self.inputs, 3 * h),
            "bias": (3 * h,),
            "gates": (h, 2 * h),  # update and reset
            "news": (h, h),
            "classes": (c, h),
            "class_bias": (c,),
            "within": (c, s, h),
            "within_bias": (c, s),
        }

    def cut(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """The weights as views of ``vector``."""
        found, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            found[name] = vector[at : at + n].reshape(shape)
            at += n
        return found

    def start(self, counts: np.ndarray, seed: int = 17) -> np.ndarray:
        """Weights before training: the output says how common symbols are, whatever the state."""
        rng = np.random.default_rng(seed)
        vector = np.zeros(sum(int(np.prod(s)) for s in self.parts().values()), dtype=np.float32)
        w = self.cut(vector)
        w["embed"][:] = rng.normal(0, 0.3, w["embed"].shape)
        w["inner"][:] = rng.normal(0, self.inputs**-0.5, w["inner"].shape)
        w["gates"][:] = rng.normal(0, self.hidden**-0.5, w["gates"].shape)
        w["news"][:] = rng.normal(0, self.hidden**-0.5, w["news"].shape)
        mass = np.zeros(self.classes * self.size)
        mass[: self.symbols] = counts + 0.5
        mass = mass.reshape(self.classes, self.size)
        w["class_bias"][:] = np.log(mass.sum(axis=1) / mass.sum())
        w["within_bias"][:] = np.log(np.where(mass > 0, mass, 1e-30) / mass.sum(axis=1, keepdims=True))
        return vector


def _order(symbols: np.ndarray) -> np.ndarray:
    """Places by symbol; small numbers are sorted digit by digit."""
    return np.argsort(symbols.astype(np.uint16) if len(symbols) and symbols.max() < 1 << 16 else symbols, kind="stable")


class Network:
    def __init__(self, shape: Shape, vector: np.ndarray):
        self.shape, self.vector = shape, vector
        self.w = shape.cut(vector)

    def windows(self, tokens: np.ndarray, first: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int):
        """(places in ``tokens``, which of them are real, symbols before, states kept) for each window of
        the streams [begin, begin + size), which stand longest first; ``width`` steps each."""
        for t in range(0, int(sizes[0]) if len(sizes) else 0, width):
            live = int(np.searchsorted(-sizes, -t, "left"))
            steps = min(width, int(sizes[0]) - t)
            step = t + np.arange(steps)[:, None]
            real = step < sizes[:live]
            at = begins[:live] + np.where(real, step, 0)
            fresh = first[at]
            before = np.where(fresh, 0, tokens[np.maximum(at - 1, 0)])
            yield at, real, before, (~fresh).astype(np.float32)[:, :, None]

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol sends to the gates (negated, see ``forward``) and, twice, to the new state."""
        x, h = self.w["embed"] @ self.w["inner"] + self.w["bias"], self.shape.hidden
        return -x[:, : 2 * h], x[:, 2 * h :] * np.float32(2)

    def forward(self, before: np.ndarray, kept: np.ndarray, state: np.ndarray, given: tuple[np.ndarray, np.ndarray]) -> tuple:
        """States after each step of a window, and what backpropagation needs."""
        h = self.shape.hidden
        to_gates, to_news = given
        gates_by, news_by = -self.w["gates"], self.w["news"] * np.float32(2)
        steps, n = before.shape
        states, old, inner, news = (np.empty((steps, n, h), dtype=state.dtype) for _ in range(4))
        gates = to_gates[before]
        x = to_news[before]
        for t in range(steps):
            np.multiply(state, kept[t], out=old[t])
            gate = gates[t]
            gate += old[t] @ gates_by
            np.minimum(gate, STEEP, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.matmul(old[t], news_by, out=inner[t])
            new = news[t]
            np.multiply(gate[:, h:], inner[t], out=new)
            new += x[t]
            np.minimum(new, STEEP, out=new)  # its tangent, from the exponential function of twice its argument
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            state = states[t]
            np.subtract(old[t], new, out=state)
            state *= gate[:, :h]
            state += new
        return states, (old, gates, news, inner)

    def states(self, before: np.ndarray, kept: np.ndarray, state: np.ndarray, given: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The states of ``forward`` where nothing is learnt: each step writes over what the last one needed."""
        h = self.shape.hidden
        to_gates, to_news = given
        gates_by, news_by = -self.w["gates"], self.w["news"] * np.float32(2)
        steps, n = before.shape
        states = np.empty((steps, n, h), dtype=state.dtype)
        old, inner, new, x = (np.empty((n, h), dtype=state.dtype) for _ in range(4))
        gate, by = (np.empty((n, 2 * h), dtype=state.dtype) for _ in range(2))
        update, reset = gate[:, :h], gate[:, h:]
        for t in range(steps):
            np.multiply(state, kept[t], out=old)
            np.take(to_gates, before[t], axis=0, out=gate, mode="clip")
            np.take(to_news, before[t], axis=0, out=x, mode="clip")
            gate += np.matmul(old, gates_by, out=by)
            np.minimum(gate, STEEP, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.matmul(old, news_by, out=inner)
            np.multiply(reset, inner, out=new)
            new += x
            np.minimum(new, STEEP, out=new)
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            state = states[t]
            np.subtract(old, new, out=state)
            state *= update
            state += new
        return states

    def _raised(self, logits: np.ndarray, chosen: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the chosen columns, and all probabilities (in place of ``logits``)."""
        if steep:
            logits -= logits.max(axis=1, keepdims=True)
        found = logits[np.arange(len(logits)), chosen]
        p = np.exp(logits, out=logits)
        total = p @ np.ones(p.shape[1], p.dtype)
        found -= np.log(total)
        return found, total

    def output(self, states: np.ndarray, symbols: np.ndarray, grad: dict[str, np.ndarray] | None = None, steep: bool | None = None):
        """Log probability of each symbol after each state; with ``grad`` also the gradient of their
        negated sum, by weights (added to ``grad``) and by states. ``steep``: if logits may be large."""
        w, size = self.w, self.shape.size
        steep = self.steep() if steep is None else steep
        order = _order(symbols)
        symbols, states = symbols[order], states[order]
        group = symbols // size
        p = states @ w["classes"].T
        p += w["class_bias"]
        found, total = self._raised(p, group, steep)
        if grad is not None:
            p /= total[:, None]
            p[np.arange(len(group)), group] -= 1
            grad["classes"] += p.T @ states
            grad["class_bias"] += np.ones(len(p), p.dtype) @ p
            by_states = p @ w["classes"]
        cut = np.searchsorted(group, np.arange(self.shape.classes + 1))
        for c in range(self.shape.classes):
            at = slice(cut[c], cut[c + 1])
            here = states[at]
            if not len(here):
                continue
            place = symbols[at] - c * size
            p = here @ w["within"][c].T
            p += w["within_bias"][c]
            more, total = self._raised(p, place, steep)
            found[at] += more
            if grad is not None:
                p /= total[:, None]
                p[np.arange(len(place)), place] -= 1
                grad["within"][c] += p.T @ here
                grad["within_bias"][c] += np.ones(len(p), p.dtype) @ p
                by_states[at] += p @ w["within"][c]
        placed = np.empty_like(found)
        placed[order] = found
        if grad is None:
            return placed
        by_placed = np.empty_like(by_states)
        by_placed[order] = by_states
        return placed, by_placed

    def steep(self) -> bool:
        """If a state, none of whose numbers is beyond 1, could make a logit that overflows when raised."""
        w = self.w
        most = [np.abs(w[m]).sum(axis=-1) + np.maximum(w[b], 0) for m, b in (("classes", "class_bias"), ("within", "within_bias"))]
        low = min(float((w["class_bias"] - np.abs(w["classes"]).sum(axis=-1)).max()), float((w["within_bias"] - np.abs(w["within"]).sum(axis=-1)).max(axis=-1).min()))
        return max(float(m.max()) for m in most) > STEEP or low < -STEEP

    def backward(self, before: np.ndarray, kept: np.ndarray, saved: tuple, by_states: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Adds to ``grad`` what the window's steps contribute, from the gradient by its states."""
        w, h = self.w, self.shape.hidden
        old, gates, news, inner = saved
        slope = gates * (1 - gates)
        by_gates, by_news, by_inner = np.empty_like(gates), np.empty_like(news), np.empty_like(news)
        new_slope, moved = 1 - news * news, old - news
        half_inner = inner * np.float32(0.5)  # it was kept twofold
        gates_back, news_back = w["gates"].T, w["news"].T
        carried = np.zeros_like(old[0])
        for t in range(len(before) - 1, -1, -1):
            d = by_states[t] + carried
            z, r = gates[t, :, :h], gates[t, :, h:]
            d_old = d * z
            d_new = np.subtract(d, d_old, out=by_news[t])
            d_new *= new_slope[t]
            np.multiply(d, moved[t], out=by_gates[t, :, :h])
            np.multiply(d_new, half_inner[t], out=by_gates[t, :, h:])
            by_gates[t] *= slope[t]
            np.multiply(d_new, r, out=by_inner[t])
            d_old += by_gates[t] @ gates_back
            d_old += by_inner[t] @ news_back
            d_old *= kept[t]
            carried = d_old
        flat_old = old.reshape(-1, h).T
        grad["gates"] += flat_old @ by_gates.reshape(-1, 2 * h)
        grad["news"] += flat_old @ by_inner.reshape(-1, h)
        by_x = np.concatenate([by_gates.reshape(-1, 2 * h), by_news.reshape(-1, h)], axis=1)
        grad["bias"] += np.ones(len(by_x), by_x.dtype) @ by_x
        before = before.ravel()
        grad["inner"] += w["embed"][before].T @ by_x
        order = _order(before)
        symbol = before[order]
        at = np.flatnonzero(np.diff(symbol, prepend=-1))
        grad["embed"][symbol[at]] += np.add.reduceat((by_x @ w["inner"].T)[order], at, axis=0)

    def log_probabilities(self, tokens: np.ndarray, first: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each token, given those before it in its text; natural logarithms."""
        found = np.zeros(len(tokens))
        given, steep = self.inputs(), self.steep()
        state = np.zeros((len(sizes), self.shape.hidden), dtype=self.vector.dtype)
        for at, real, before, kept in self.windows(tokens, first, begins, sizes, SCORED):
            states = self.states(before, kept, state[: at.shape[1]], given)
            state = states[-1]
            if real.all():
                found[at.ravel()] = self.output(states.reshape(-1, states.shape[-1]), tokens[at.ravel()], steep=steep)
            else:
                at = at[real]
                found[at] = self.output(states[real], tokens[at], steep=steep)
        return found

    def train(self, packs: Iterator[tuple], rate: float = RATE) -> int:
        """Adagrad over the windows of ``packs``, each once; how many tokens they hold."""
        seen = 0
        squares = np.full_like(self.vector, SQUARES)
        gradient, step = np.zeros_like(self.vector), np.empty_like(self.vector)
        grad = self.shape.cut(gradient)
        for tokens, first, begins, sizes in packs:
            state = np.zeros((len(sizes), self.shape.hidden), dtype=self.vector.dtype)
            for at, real, before, kept in self.windows(tokens, first, begins, sizes, WINDOW):
                states, saved = self.forward(before, kept, state[: at.shape[1]], self.inputs())
                state = states[-1]
                gradient[:] = 0
                if real.all():
                    _, by_states = self.output(states.reshape(-1, states.shape[-1]), tokens[at.ravel()], grad)
                    by_states = by_states.reshape(states.shape)
                else:
                    by_states = np.zeros_like(states)
                    _, by_states[real] = self.output(states[real], tokens[at[real]], grad)
                self.backward(before, kept, saved, by_states, grad)
                gradient /= WINDOW * len(sizes)  # a window of few streams weighs less
                np.multiply(gradient, gradient, out=step)
                squares += step
                np.sqrt(squares, out=step)
                np.divide(gradient, step, out=step)
                step *= rate
                self.vector -= step
                seen += int(real.sum())
        return seen


def pack(texts: list[np.ndarray]) -> tuple[tuple, np.ndarray]:
    """Streams of texts (symbols, each ended): ((tokens, which begin a text, begins, sizes), order); ``order`` has the
    texts as they follow each other in tokens. Streams are about equally long, the longest first."""
    lengths = np.array([len(t) for t in texts])
    n = int(np.clip(lengths.sum() // max(1, lengths.max()), 16, STREAMS))
    held: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, s) for s in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, s = heapq.heappop(heap)
        held[s].append(i)
        heapq.heappush(heap, (size + int(lengths[i]), s))
    rng = np.random.default_rng(n)
    for stream in held:  # long and short texts in turn
        rng.shuffle(stream)
    held.sort(key=lambda stream: -sum(lengths[i] for i in stream))
    order = [i for stream in held for i in stream]
    tokens = np.concatenate([texts[i] for i in order])
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum([0, *lengths[order][:-1]])] = True
    sizes = np.array([sum(int(lengths[i]) for i in stream) for stream in held if stream])
    return (tokens, first, np.cumsum([0, *sizes[:-1]]), sizes), np.array(order)


class Vocabulary:
    """The commonest words: what the network and the counts know of them."""

    def __init__(self, head: list[tuple[bytes, int]], n_texts: int, n_tokens: int, n_distinct: int, short: int = SHORT_LIST):
        self.at = {END: 0} | {w: i for i, (w, _) in enumerate(head, 1)}
        counts = np.array([n_texts, *(n for _, n in head)], dtype=np.float64)
        known = min(short, len(head)) + 1
        self.symbol = np.minimum(np.arange(len(counts)), known)  # ``known`` is OTHER
        self.listed = {w: i for w, i in self.at.items() if i < known}
        self.other = known
        self.n_tokens, self.n_distinct = n_tokens, n_distinct
        self.log_count = np.log10(counts + 0.5)
        self.known = counts > 0
        listed = counts[:known].sum()
        self.symbol_counts = np.array([*counts[:known], n_tokens - listed])
        #: What the other words' smoothed counts add up to, one unseen word among them.
        n_others = n_distinct - int(self.known[:known].sum())
        self.log_others = float(np.log10(n_tokens - listed + 0.5 * (n_others + 1)))
        self.log_all = float(np.log10(n_tokens + 0.5 * (n_distinct + 1)))

    def places(self, ws: list[bytes]) -> np.ndarray:
        """Of a text's words and its end; -1 where only the table of counts knows."""
        found = np.zeros(len(ws) + 1, dtype=np.int32)
        found[:-1] = np.fromiter(map(self.at.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
        return found

    def heard(self, ws: list[bytes]) -> np.ndarray:
        """The symbols of a text's words and its end."""
        found = np.fromiter(map(self.listed.get, ws, repeat(self.other)), dtype=np.int64, count=len(ws))
        return np.append(found, 0)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < 0, self.other, self.symbol[places])


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all of ``texts`` (text, as bytes); the empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                held[END] += 1
                if len(held) > COUNTED:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The commonest words of ``counts`` (word, n), up to ``most``, with their counts, most first.

    Words are taken by classes of counts (eight in each power of two), each whole or not at all, so that nothing is
    sorted and the driver gets no more than it keeps.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    words = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST)).withColumn("level", level)
    least, room = None, most
    for row in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        if row["count"] > room:
            break
        least, room = row.level, room - row["count"]
    if least is None:
        return []
    rows = words.where(F.col("level") >= least).select("word", "n").collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def _average(parts: DataFrame, n_tasks: int) -> np.ndarray:
    """The weights of all tasks, weighted by their tokens. Rows are added up as they come, first in
    any task, then by slice, so that no task holds more than one vector of weights."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for slice_, weight, values in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(values) * 1.0
                if slice_ in held:
                    held[slice_][0] += weight
                    held[slice_][1] += values
                else:
                    held[slice_] = [weight, values]
        rows = [(s, w, v.tobytes()) for s, (w, v) in held.items()]
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["slice", "weight", "vector"])

    schema = "slice long, weight long, vector binary"
    sums = parts.repartition(n_tasks).mapInArrow(add, schema).repartition(n_tasks, "slice").mapInArrow(add, schema)
    rows = sorted(sums.collect())  # one vector of weights
    return np.concatenate([np.frombuffer(r.vector) / r.weight for r in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)


def train(texts: DataFrame, vocabulary, shape: Shape, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all of ``texts`` (key, text as bytes), each learnt from once; ``vocabulary`` is broadcast."""
    spark = texts.sparkSession
    weights = shape.start(vocabulary.value.symbol_counts)
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        given = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network = Network(shape, given.value.copy())

            def packs() -> Iterator[tuple]:
                held, size = [], 0
                for batch in batches:
                    for text in batch.column(0):
                        heard = vocabulary.value.heard(words(text.as_py()))
                        held += [heard[i : i + PIECE] for i in range(0, len(heard), PIECE)]
                        size += len(heard)
                        if size >= PACK:
                            yield pack(held)[0]
                            held, size = [], 0
                if held:
                    yield pack(held)[0]

            seen = network.train(packs(), RATE / (1 + r))
            vector = network.vector.astype(np.float64) * seen
            cut = range(0, len(vector) if seen else 0, SLICE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a // SLICE for a in cut], pa.int64()),
                    pa.array([seen] * len(cut), pa.int64()),
                    pa.array([vector[a : a + SLICE].tobytes() for a in cut], pa.binary()),
                ],
                ["slice", "weight", "vector"],
            )

        dealt = texts.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).select("text")
        found = _average(dealt.mapInArrow(run, "slice long, weight long, vector binary"), n_tasks)
        weights = found if len(found) else weights
        given.unpersist()
    return weights


def score(texts: DataFrame, counts: DataFrame, vocabulary, shape: Shape, weights: np.ndarray) -> DataFrame:
    """``texts`` (text as bytes, and any columns) without text, with n_tokens, n_known, base_score and score."""
    spark, scratch = texts.sparkSession, Scratch(texts.sparkSession)
    given = spark.sparkContext.broadcast(weights)
    rest = [c for c in texts.columns if c != "text"]
    texts = texts.select("text", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, v = Network(shape, given.value), vocabulary.value

        def flush(batch: pa.RecordBatch, places: list[np.ndarray], tail: list[dict]) -> pa.RecordBatch:
            (tokens, first, begins, sizes), order = pack([v.symbols(p) for p in places])
            lengths = np.array([len(p) for p in places])
            model = np.empty(len(places))
            model[order] = np.add.reduceat(network.log_probabilities(tokens, first, begins, sizes), np.flatnonzero(first))
            flat, begin = np.concatenate(places), np.cumsum([0, *lengths[:-1]])
            head = flat >= 0
            log_count = np.where(head, v.log_count[flat], 0.0)
            other = np.add.reduceat(np.where(head & (v.symbol[flat] == v.other), log_count, 0.0), begin)
            n_other = np.add.reduceat((v.symbols(flat) == v.other).astype(np.int64), begin)
            known = np.add.reduceat((head & v.known[flat]).astype(np.int64), begin)
            base = np.add.reduceat(log_count, begin) - lengths * v.log_all
            columns = [
                *batch.columns,
                pa.array(lengths, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(base),
                pa.array(model / np.log(10) + other - n_other * v.log_others),
                pa.array([list(t.items()) for t in tail], pa.map_(pa.binary(), pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[*rest, "n_tokens", "n_known", "base_score", "score", "tail"])

        held, places, tail, size = [], [], [], 0
        for whole in batches:
            kept, begin = whole.select(rest), 0  # the texts need not be held
            for i, text in enumerate(whole.column(0)):
                ws = words(text.as_py())
                places.append(v.places(ws))
                unknown = np.flatnonzero(places[-1] < 0)
                tail.append(Counter([ws[j] for j in unknown.tolist()]))
                size += len(places[-1])
                if size >= SCORED_PACK:
                    yield flush(_joined([*held, kept.slice(begin, i + 1 - begin)]), places, tail)
                    held, places, tail, size, begin = [], [], [], 0, i + 1
            if begin < whole.num_rows:
                held.append(kept.slice(begin))
        if places:
            yield flush(_joined(held), places, tail)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(rest).schema.fields]
    schema = ", ".join([*fields, "n_tokens long, n_known long, base_score double, score double, tail map<binary,long>"])
    scored = texts.mapInArrow(run, schema)
    # Rows get a number once, when they are written: it is the same whenever they are read.
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()))
    joined = scored.select("row", F.explode("tail").alias("word", "times")).join(counts, "word", "left")
    log_count = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) * F.col("times")
    more = joined.groupBy("row").agg(
        F.sum(log_count).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(more, "row", "left").select(
        *rest,
        "n_tokens",
        (F.col("n_known") + zero("tail_known")).alias("n_known"),
        (F.col("base_score") + zero("tail_score")).alias("base_score"),
        (F.col("score") + zero("tail_score")).alias("score"),
    )


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def held_out(doc_id) -> F.Column:
    """Every fifth text by the checksum of its id; a null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def report(docs: DataFrame, head: int = HEAD, short: int = SHORT_LIST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    A null or blank text is its end alone. Rows that repeat are trained on and returned each; a null doc_id is
    trained on. Without training texts every word is unknown and the network says so; no rows give no
    rows. Scores are finite, in log10; ties need no order. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.encode("text", "UTF-8").alias("text"))
    training = docs.where("not held_out")
    counts = scratch.save(count_words(training.select("text")))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v")).first()
    n_texts = counts.where(F.col("word") == F.lit(END)).first()
    found = Vocabulary(commonest(counts, head), n_texts.n if n_texts else 0, whole.n, whole.v, short)
    shape = Shape(found.other + 1)
    vocabulary = spark.sparkContext.broadcast(found)
    weights = train(training.select(F.col("doc_id").alias("key"), "text"), vocabulary, shape, rounds)
    scored = score(docs, counts, vocabulary, shape, weights).withColumn("train_tokens", F.lit(whole.n).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
