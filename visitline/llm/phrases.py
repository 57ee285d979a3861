r"""Phrase collocations by streamed counts in prefix and suffix order.

Counts of word sequences are streams, one per length. A stream in prefix order (by all words but the last) runs
in lockstep with the next shorter stream: each shorter sequence meets its extensions to the right, gives
them its count as that of their first words, and takes their highest count. In suffix order (by all words but the
first) the same step gives the counts of their last words and the highest extension to the left. The steps are Spark's
sort-merge joins, so streams are sorted outside memory and no count is held in a hash table of a join.

Texts are read four times: for words, for keys of pairs of frequent words, for keys of triples of frequent pairs, then
for the sequences of two and more words whose pairs or triples have a frequent key. What is frequent goes to the tasks
as bitmaps of fixed size. Keys and bitmaps let some rare sequences pass; their exact count drops them. Only
sequences that reach the least count are ever needed: every part of a frequent sequence is frequent, and so is every
sequence between two frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visitline.llm import words
from visitline.llm.bitmaps import bitmap_of, passing
from visitline.session import materialize, release, ship_package

LONGEST = 4  # words of a phrase
BITS = 27  # of a bitmap: 16 MB in a task
KEY_BITS = 40  # of a key of two or three words; sequences that share one are counted together at first
PIECE_BYTES = 1 << 20  # text bytes counted at a time; arrays over them take about seventy times as much
_BLANK, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True
_BLANK[[0x20, 0x09]] = True
_BLANK |= _BREAK
_COUNTED = "lang string, phrase string, n bigint"


def _spelled(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs as strings."""
    sizes = end - begin
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())


class Pieces:
    """Words of a batch, joined by one blank each, so that every sequence of words is one run of bytes."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = words.text_bytes(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        data = words._LOWER[data]
        inside = ~_BLANK[data]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = _BREAK[data].astype(np.int32)
        breaks[heads] += 1
        piece = np.cumsum(breaks)[begin]
        owner = np.searchsorted(offsets, begin, side="right") - 1
        self.lang = langs.indices.to_numpy()[owner] if len(begin) else np.zeros(0, np.int64)
        sizes = end - begin
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        self.data = np.full(int(self.end[-1]) + 1 if len(begin) else 0, 0x20, dtype=np.uint8)
        source = np.flatnonzero(inside)
        self.data[np.arange(len(source)) + np.repeat(np.arange(len(begin)), sizes)] = data[source]
        # words that stand in the piece from here on, this one included
        edge = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(begin) else np.zeros(0, np.int64)
        self.left = edge[np.searchsorted(edge, np.arange(len(begin)))] - np.arange(len(begin)) + 1
        self.salt = _salts(self.langs)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the sequences of ``n`` words that start at the words ``at``, with their language."""
        return words.mix(words.hash_runs(self.data, self.begin[at], self.end[at + n - 1]) ^ self.salt[self.lang[at]])

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """Each distinct sequence with its number; sequences of one 64-bit hash must agree in size and language."""
        hashed = self.hashes(at, n)
        order = np.argsort(hashed, kind="stable")
        at, hashed = at[order], hashed[order]
        new = np.append(True, hashed[1:] != hashed[:-1])[: len(at)]
        sizes = self.end[at + n - 1] - self.begin[at]
        same = np.flatnonzero(~new)
        if len(same) and ((sizes[same] != sizes[same - 1]) | (self.lang[at[same]] != self.lang[at[same - 1]])).any():
            new = np.ones(len(at), dtype=bool)  # a clash: the sequences go one by one and are summed by their text
        heads = np.flatnonzero(new)
        which = at[heads]
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[which])), _spelled(self.data, self.begin[which], self.end[which + n - 1]), pa.array(np.diff(np.append(heads, len(at))).astype(np.int64))],
            names=["lang", "phrase", "n"],
        )


def _salts(langs: pa.Array) -> np.ndarray:
    data, offsets = words.text_bytes(langs)
    return words.hash_runs(data, offsets[:-1], offsets[1:]) * words._STEP


def _starts(found: Pieces, n: int, parts: int, bitmap) -> np.ndarray:
    """Words at which a sequence of ``n`` words begins whose parts of so many words all pass."""
    at = np.arange(len(found.begin))
    here = at[found.left >= n]
    if bitmap is not None:
        good = np.zeros(len(at) + n, dtype=bool)
        starts = at[found.left >= parts]
        good[starts] = passing(bitmap.value, found.hashes(starts, parts))
        for j in range(n - parts + 1):
            here = here[good[here + j]]
    return here


def _counts(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], bitmaps: dict) -> Iterator[pa.RecordBatch]:
    """Counts of the sequences of these lengths whose longest parts with a bitmap pass."""
    for batch in batches:
        for piece in words.pieces(batch, limit=PIECE_BYTES):
            found = Pieces(piece)
            for n in lengths:
                parts = max((p for p in bitmaps if p <= n), default=1)
                here = _starts(found, n, parts, bitmaps.get(parts))
                if len(here):
                    yield found.counted(here, n)


def _keys(batches: Iterator[pa.RecordBatch], n: int, bitmap) -> Iterator[pa.RecordBatch]:
    """How often each key of ``n`` words occurs whose parts of one word less pass."""
    for batch in batches:
        for piece in words.pieces(batch, limit=PIECE_BYTES):
            found = Pieces(piece)
            keys, times = np.unique(found.hashes(_starts(found, n, n - 1, bitmap), n) & np.uint64((1 << KEY_BITS) - 1), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(times.astype(np.int64))})


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every (lang, phrase) row, as a ``Pieces`` has it."""
    for batch in batches:
        data, offsets = words.text_bytes(batch.column("phrase"))
        langs = batch.column("lang").dictionary_encode()
        hashed = words.mix(words.hash_runs(data, offsets[:-1], offsets[1:]) ^ _salts(langs.dictionary)[langs.indices.to_numpy()])
        yield pa.RecordBatch.from_pydict({"mark": pa.array(hashed.view(np.int64))})


def count_streams(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language ``(lang, n)``, and per length the written stream ``(lang, phrase, a)`` with ``a >= least``."""
    ship_package(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def stream(lengths: tuple[int, ...], bitmaps: dict) -> DataFrame:
        return texts.mapInArrow(lambda it: _counts(it, lengths, bitmaps), _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))

    every = materialize(stream((1,), {}), "words")
    totals = materialize(every.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    streams = [materialize(every.where(F.col("a") >= least), "stream")]
    release(every)
    common = {1: context.broadcast(bitmap_of(streams[0].mapInArrow(_marks, "mark bigint"), "mark", BITS))}
    for n in (2, 3):
        keys = texts.mapInArrow(lambda it, n=n, shorter=common[n - 1]: _keys(it, n, shorter), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        common[n] = context.broadcast(bitmap_of(keys.where(F.col("n") >= least), "key", BITS))
    del common[1]
    longer = materialize(stream(tuple(range(2, LONGEST + 1)), common).where(F.col("a") >= least), "stream")
    blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return totals, [*streams, *(longer.where(blanks == n - 1) for n in range(2, LONGEST + 1))]


def _prefix(n: int) -> Column:
    return F.substring_index("phrase", " ", n - 1)


def _suffix(n: int) -> Column:
    return F.substring_index("phrase", " ", 1 - n)


def collocations(docs: DataFrame, *, least: int = 30, scale: int = 2_000_000, absorbed: tuple[int, int] = (80, 100)) -> DataFrame:
    """Phrases of 2 to 4 words that occur ``least`` times or more in their language and in no longer phrase nearly as often.

    ``docs`` needs ``text`` and ``lang``; other columns aren't read. Words and pieces are those of the bytes: ``A-Z`` in lower
    case, pieces end at ``.,;:!?`` and ``\\x0A-\\x0D``, words at blanks and tabs; a phrase stays inside a piece. Returns ``lang,
    phrase, a, l, r, n, score``: ``a`` occurrences, ``l`` and ``r`` those of the parts of the worst cut (lowest ``score =
    floor(scale * a / (l + r))``, then the shortest first part), ``n`` words of the language. A phrase goes if
    a longer one that holds it has ``absorbed`` (numerator, denominator) of its count or more.

    Null text is empty, null lang is ``und``; texts without words add nothing; rows that repeat count each time; no
    documents, no phrases.
    """
    totals, streams = count_streams(docs, least)
    shorter = streams[0].select("lang", "phrase", "a", F.array().cast("array<bigint>").alias("lefts"), F.array().cast("array<bigint>").alias("rights"))
    kept = None
    for n in range(2, LONGEST + 1):
        stream = streams[n - 1].withColumns({"prefix": _prefix(n), "suffix": _suffix(n)})
        part = lambda side: shorter.select(
            F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("_a"), F.col("lefts" if side == "prefix" else "rights").alias("_rest")
        ).hint("merge")
        on = lambda side: (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))
        from_left = stream.join(part("prefix"), on("prefix")).select("lang", "phrase", "suffix", "a", F.concat("_rest", F.array("_a")).alias("lefts"))
        both = from_left.join(part("suffix"), on("suffix")).select("lang", "phrase", "a", "lefts", F.concat(F.array("_a"), "_rest").alias("rights"))
        both = materialize(both, "counts")
        if n > 2:
            # the highest count among the extensions of each shorter phrase, from both orders
            ways = [stream.groupBy("lang", F.col(side).alias("phrase")).agg(F.max("a").alias("top")) for side in ("prefix", "suffix")]
            above = ways[0].union(ways[1]).groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("top").alias("_top")).hint("merge")
            part_of = shorter.join(above, on("phrase"), "left")
            own = part_of.where(F.col("_top").isNull() | (F.col("_top").cast("decimal(30,0)") * absorbed[1] < F.col("a").cast("decimal(30,0)") * absorbed[0]))
            kept = own.select("lang", "phrase", "a", "lefts", "rights") if kept is None else kept.union(own.select("lang", "phrase", "a", "lefts", "rights"))
        shorter = both
    kept = shorter if kept is None else kept.union(shorter)
    cut = F.transform(
        F.sequence(F.lit(1), F.size("lefts")),
        lambda k: F.struct(F.call_function("div", F.lit(scale).cast("decimal(18,0)") * F.col("a").cast("decimal(20,0)"),
                           F.get("lefts", k - 1).cast("decimal(20,0)") + F.get("rights", k - 1).cast("decimal(20,0)")).alias("score"), k.alias("k")),
    )
    scored = kept.withColumn("_cut", F.array_min(cut)).join(totals, "lang")
    return scored.select(
        "lang", "phrase", "a", F.get("lefts", F.col("_cut.k") - 1).alias("l"), F.get("rights", F.col("_cut.k") - 1).alias("r"), "n", F.col("_cut.score").cast("bigint").alias("score")
    )


def best_phrases(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and spelling, with their ``rank``."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).select(
        "lang", F.col("_rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
