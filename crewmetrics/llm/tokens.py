"""Token counts by a public tokenizer, huge texts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole. A longer one is cut into chunks that
overlap by ``overlap`` characters; chunks are spread over tasks and encoded with offsets.
Neighbours are spliced at a token that both produced at the same place inside their overlap.

Why that is exact: the model merges pairs of neighbouring symbols by the rank of what they
form, so a sequence of pieces is the encoding of its text if and only if each two neighbours
in it are the encoding of their own text. Left of the shared token every two neighbours stand
in the left encoding, right of it in the right one. Where no token is shared, the overlap widens over
the whole next chunk, which the left one then takes in: only the chunks beside such a seam are encoded again, up to
eight of them as one, and spliced anew with what stands around them, until no seam is left without a shared token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch

CHUNK = 16_384
OVERLAP = 512
#: Chunks that become one where neighbours share no token.
WIDER = 8
#: Pieces of at most so many characters; an offset and a length share one number.
LONGEST = 1 << 10


@cache
def _model(path: str):
    """The processor, and by id the characters that a piece covers and if it may be an anchor."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    covers, anchor = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):  # bytes of one character: the first covers it
            covers.append(int(not 0x80 <= int(piece[3:5], 16) <= 0xBF))
        else:
            covers.append(1 if model.is_unknown(i) else len(piece))
        anchor.append(not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i)))
    return model, np.array(covers), np.array(anchor)


def count_texts(texts: list[str], path: str) -> list[int]:
    model = _model(path)[0]
    return [len(ids) for i in range(0, len(texts), 64) for ids in model.encode(texts[i : i + 64], num_threads=1)]


def spans(text: str, at: int, path: str) -> np.ndarray:
    """For each token of a chunk that begins at ``at``: offset * LONGEST + length, or -1 if it can't be an anchor."""
    model, covers, anchor = _model(path)
    ids = np.array(model.encode(text, num_threads=1), dtype=np.int64)
    length = covers[ids]
    begin = at - 1 + np.cumsum(length) - length  # the model puts a space before any text
    return np.where(anchor[ids], begin * LONGEST + length, -1)


def _inside(codes: np.ndarray, low: int, high: int) -> tuple[int, np.ndarray]:
    """The run of tokens that lie within [low, high): how many stand before it, and their codes."""
    ok = np.flatnonzero((codes >= low * LONGEST) & (codes // LONGEST + codes % LONGEST <= high))
    return (0, codes[:0]) if not len(ok) else (int(ok[0]), codes[ok[0] : ok[-1] + 1])


def _cut(size: int, overlap: int):
    """All chunks of a text: number of the first unit of ``size`` characters, how many units, if it ends the text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                starts = range(0, len(text), size)
                yield pd.DataFrame(
                    {
                        "key": key,
                        "k": range(len(starts)),
                        "units": 1,
                        "last": [at + size >= len(text) for at in starts],
                        "chunk": [text[at : at + size + overlap] for at in starts],
                    }
                )

    return cut


def widened(seams: Iterable[tuple[int, int, int]], most: int = WIDER) -> list[tuple[int, int]]:
    """Of seams without a shared token (first unit of the left chunk, of the right one, end of the right one) the ranges
    of units that become one chunk, made of ``most`` chunks at most."""
    merged: list[list[int]] = []
    for left, right, end in sorted(seams):
        if merged and merged[-1][1] == right and merged[-1][2] < most:
            merged[-1][1:] = [end, merged[-1][2] + 1]
        elif not merged or merged[-1][1] <= left:
            merged.append([left, end, 2])
    return [(begin, end) for begin, end, _ in merged]


def _cut_wider(size: int, overlap: int):
    """The chunks that take the place of those beside the seams in ``failed``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, failed in zip(batch["key"], batch["text"], batch["failed"]):
                made = widened((f["left"], f["seam"], f["end"]) for f in failed)
                yield pd.DataFrame(
                    {
                        "key": key,
                        "k": [begin for begin, _ in made],
                        "units": [end - begin for begin, end in made],
                        "last": [end * size >= len(text) for _, end in made],
                        "chunk": [text[begin * size : end * size + overlap] for begin, end in made],
                    }
                )

    return cut


def _encode(size: int, overlap: int, path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, k, units, last, chunk in zip(*(batch[c] for c in ("key", "k", "units", "last", "chunk"))):
                at, after = k * size, (k + units) * size
                codes = spans(chunk, at, path)
                before_head, head = _inside(codes, at, at + overlap)
                before_tail, tail = _inside(codes, after, after + overlap)
                # No two codes of different sides are equal where a token is no anchor.
                rows.append(
                    (key, k, units, last, len(codes), before_head, np.where(head < 0, -1, head), before_tail, np.where(tail < 0, -2, tail))
                )
            yield pd.DataFrame(rows, columns=_ENCODED_NAMES)

    return run


_CHUNK = "key string, k long, units long, last boolean, chunk string"
_ENCODED = (
    "key string, k long, units long, last boolean, n long, before_head long, head array<long>, before_tail long, tail array<long>"
)
_ENCODED_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


def _seams(encoded: DataFrame) -> DataFrame:
    """key, left, seam, end, part: what the tokens of a text gain by each seam, null if nothing is shared there.

    The end of a text is a seam too, whose part is the last chunk's tokens; so the parts of a text make up its count.
    Equal rows of ``encoded`` count once. Only two chunks meet, however many a text has.
    """
    ends = encoded.select(
        "key",
        (F.col("k") + F.col("units")).alias("seam"),
        F.struct(F.col("k").alias("first"), "last", "n", F.col("before_tail").alias("before"), F.col("tail").alias("codes")).alias("left"),
    )
    begins = encoded.where("k > 0").select(
        "key",
        F.col("k").alias("seam"),
        F.struct((F.col("k") + F.col("units")).alias("end"), F.col("before_head").alias("before"), F.col("head").alias("codes")).alias("right"),
    )
    met = ends.unionByName(begins, allowMissingColumns=True).groupBy("key", "seam").agg(
        F.first("left", ignorenulls=True).alias("l"), F.first("right", ignorenulls=True).alias("r")
    )
    anchor = F.get(F.array_intersect("l.codes", "r.codes"), F.lit(0))
    met = met.select("*", anchor.alias("anchor"))
    gained = F.col("l.before") + F.array_position("l.codes", F.col("anchor")) - F.col("r.before") - F.array_position("r.codes", F.col("anchor"))
    part = F.when(F.col("l.last"), F.col("l.n")).otherwise(gained)
    return met.select("key", F.col("l.first").alias("left"), "seam", F.col("r.end").alias("end"), part.alias("part"))


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_tokens of ``texts`` (key, text); spread by chunk, not by text. Equal rows count once.

    Texts move once, as chunks. Where seams fail, their texts are kept, and from then on only chunks beside such seams move.
    """
    scratch = Scratch(texts.sparkSession)
    n_tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(cut: DataFrame) -> DataFrame:
        return scratch.save(cut.repartition(n_tasks, "key", "k").mapInPandas(_encode(chunk, overlap, path), _ENCODED))

    encoded = encode(texts.mapInPandas(_cut(chunk, overlap), _CHUNK))
    found, kept = [], None
    while True:
        seams = scratch.save(_seams(encoded))
        whole = F.count("part") == F.count(F.lit(1))
        found.append(seams.groupBy("key").agg(F.sum("part").alias("n_tokens"), whole.alias("whole")).where("whole").drop("whole"))
        failed = seams.where("part is null")
        if failed.isEmpty():
            break
        # A text's list is as long as the text has chunks at most, and stands beside that text.
        failed = scratch.save(failed.groupBy("key").agg(F.collect_list(F.struct("left", "seam", "end")).alias("failed")))
        if kept is None:
            kept = scratch.save(texts.join(failed.select("key"), "key", "left_semi").dropDuplicates(["key"]))
        wider = encode(kept.join(failed, "key").mapInPandas(_cut_wider(chunk, overlap), _CHUNK))
        taken_in = wider.select("key", F.explode(F.sequence("k", F.col("k") + F.col("units") - 1)).alias("k"))
        others = encoded.join(failed.select("key"), "key", "left_semi").join(taken_in, ["key", "k"], "left_anti")
        encoded = scratch.save(others.unionByName(wider))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    A null text counts as empty and has no tokens; other columns are not read; a row that
    stands there twice is returned twice, a null doc_id stays null; no rows give no rows.
    ``path`` names a BPE model of sentencepiece that leaves texts as they are but for the
    space before them. Texts of over ``chunk`` characters are counted once for all their copies.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_texts(texts.tolist(), path), dtype="int64")

    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    small = docs.where(F.char_length("text") <= chunk).select("doc_id", size, count("text").alias("n_tokens"))
    huge = docs.where(F.char_length("text") > chunk).select("doc_id", size, F.sha2("text", 256).alias("key"), "text")
    # Ids and keys are grouped, texts stay where they are read: of copies those with the smallest id are cut.
    ids = scratch.save(huge.drop("text"))
    copies = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = scratch.save(copies.where("n > 1").select("key", "rep"))
    cut_ids = huge.join(copies, "key", "left").where("rep is null or doc_id = rep")
    counted = ids.join(count_huge(cut_ids.select("key", "text"), path, chunk, overlap), "key")
    counted = counted.select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
