"""Benchmark decontamination by SimHash windows of the size of the items.

For every item length, windows of that many words slide over each text. A window that could reach the
similarity holds few words that no item has; all others are skipped by that exact bound. The rest get
64-bit SimHashes of their weighted words. The items' fingerprints are indexed in four blocks of 16 bits:
within ``RADIUS`` bits at least one block differs in at most a quarter of them, and the index lists every
such block value, so all items within the radius are found. Candidates are verified by the weighted
Jaccard similarity of five-word shingles, rare shingles of the benchmark weighing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitline.llm import words
from visitline.session import ship_package

RADIUS = 15
BLOCKS = 4
SHINGLE = 5
SIMILARITY = 0.8
BLOCK_ITEMS = 1000  # items that are searched for in one pass over the documents


def simhash(signed_sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 signed sums; a sum of 0 gives bit 0."""
    return np.packbits(signed_sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def signed_bits(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weights[:, None].astype(np.int32)


class Index:
    """Items ready for lookup: words, weights, fingerprints by length and their block values."""

    def __init__(self, ids: list[int], texts: list[str]):
        found = words.find_words(pa.array(texts, pa.string()))
        hashed, counts = found.hashes(), np.diff(found.bounds)
        self.ids, self.lengths = np.array(ids), counts
        owner = found.owner()
        n = len(ids)
        seen = np.unique(np.stack([hashed, owner.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(hashed) else hashed
        self.vocabulary, df = np.unique(seen, return_counts=True)
        self.word_weight = np.maximum(1, np.round(8 * np.log1p(n / df) / np.log1p(n))).astype(np.int32)
        shingles, bounds = words.shingle_hashes(hashed, found.bounds, SHINGLE)
        self.sets = [np.unique(shingles[a:b]) for a, b in zip(bounds, bounds[1:])]
        self.shingles, df = np.unique(np.concatenate(self.sets) if self.sets else shingles, return_counts=True)
        self.shingle_weight = np.log1p(n / df)
        self.strange_weight = float(np.log1p(n))  # of shingles and words that no item has
        self.totals = np.array([self.weigh(s).sum() for s in self.sets])
        weight = self.word_weight[np.searchsorted(self.vocabulary, hashed)] if len(hashed) else np.zeros(0, np.int32)
        sums = np.zeros((n, 64), dtype=np.int64)
        np.add.at(sums, owner, signed_bits(hashed, weight))
        self.prints = simhash(sums) if n else np.zeros(0, np.uint64)
        # every value that a block of a fingerprint within the radius can have, by item length and block
        near = np.array([sum(1 << b for b in flips) for k in range(RADIUS // BLOCKS + 1) for flips in combinations(range(16), k)], dtype=np.uint64)
        keys, items = [], []
        for i in np.flatnonzero(counts > 0).tolist():
            for block in range(BLOCKS):
                value = (self.prints[i] >> np.uint64(16 * block)) & np.uint64(0xFFFF)
                keys.append((near ^ value) | np.uint64((int(counts[i]) << 18) | (block << 16)))
                items.append(np.full(len(near), i, dtype=np.int32))
        keys, items = (np.concatenate(keys), np.concatenate(items)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.items, self.first = items[order], np.append(first, len(keys))

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.strange_weight)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.shingle_weight[at], self.strange_weight)

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in ``prints``, item of ``length`` words) within ``RADIUS`` bits."""
        where, item = [], []
        for block in range(BLOCKS):
            key = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)) | np.uint64((length << 18) | (block << 16))
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, np.int64)
            sizes = self.first[at[hit] + 1] - self.first[at[hit]]
            start = np.repeat(self.first[at[hit]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(hit) else hit, sizes)
            who = np.repeat(hit, sizes)
            what = self.items[start + np.arange(len(start))]
            close = np.bitwise_count(prints[who] ^ self.prints[what]) <= RADIUS
            where.append(who[close]), item.append(what[close])
        both = np.unique(np.stack([np.concatenate(where), np.concatenate(item)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        own = np.unique(shingles)
        common = float(self.weigh(np.intersect1d(own, self.sets[item], assume_unique=True)).sum())
        return common / (float(self.weigh(own).sum()) + self.totals[item] - common)


def search(found: words.Words, index: Index) -> Iterator[tuple[int, int, float, int, int]]:
    """``(text, item, similarity, first word, number of words)``: the best window of each text and item."""
    hashed, bounds = found.hashes(), found.bounds
    if not len(hashed) or not len(index.vocabulary):
        return
    at = np.minimum(np.searchsorted(index.vocabulary, hashed), len(index.vocabulary) - 1)
    known = index.vocabulary[at] == hashed
    strange = np.concatenate([[0], np.cumsum(~known)]).astype(np.int32)
    weight = np.where(known, index.word_weight[at], 8)
    ends = np.repeat(bounds[1:], np.diff(bounds)).astype(np.int32)  # of the text of each word
    starts = np.arange(len(hashed), dtype=np.int32)
    windows = []
    for length in np.unique(index.lengths[index.lengths > 0]).tolist():
        # every strange word costs a shingle of the greatest weight, and (1 - s) / s of the item's may be lost
        most = int(max(length - SHINGLE + 1, 1) * (1 - SIMILARITY) / SIMILARITY + 1e-9)
        fit = np.flatnonzero((starts[: len(hashed) - length + 1] + length <= ends[: len(hashed) - length + 1]) & (strange[length:] - strange[: len(strange) - length] <= most))
        if len(fit):
            windows.append((length, fit))
    if not windows:
        return
    mark = np.zeros(len(hashed) + 1, dtype=np.int32)  # words under any window
    for length, fit in windows:
        np.add.at(mark, fit, 1)
        np.add.at(mark, fit + length, -1)
    under = np.cumsum(mark[:-1]) > 0
    place = np.concatenate([[0], np.cumsum(under)])
    sums = np.zeros((int(place[-1]) + 1, 64), dtype=np.int32)
    np.cumsum(signed_bits(hashed[under], weight[under]), axis=0, out=sums[1:])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for length, fit in windows:
        for part in np.array_split(fit, len(fit) // 65536 + 1):
            prints = simhash(sums[place[part] + length] - sums[place[part]])
            who, what = index.near(prints, length)
            for w, item in zip(part[who].tolist(), what.tolist()):
                shingles, _ = words.shingle_hashes(hashed[w : w + length], np.array([0, length]), SHINGLE)
                score = index.similarity(item, shingles)
                if score >= SIMILARITY:
                    text = int(np.searchsorted(bounds, w, side="right")) - 1
                    if score > best.get((text, item), (0.0, 0, 0))[0]:
                        best[text, item] = (score, w - int(bounds[text]), length)
    for (text, item), (score, start, length) in sorted(best.items()):
        yield text, item, score, start, length


def find_contamination(docs: DataFrame, items: DataFrame, *, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: texts that hold a near copy of an item.

    One row per row of ``docs`` (``doc_id``, ``text``) and item (``item_id``, ``text``) with a window of the
    item's number of words whose weighted shingle similarity is at least 0.8; the best window, the first
    of equally good ones. An item shorter than a shingle has one shingle, its whole sequence. Null or empty
    texts and items match nothing; a null ``doc_id`` or ``item_id`` is carried as null. Items are searched
    for in blocks of about ``block_items``, which bounds what each task holds; every block reads all documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(r"text rlike '[^\\x20\\x09-\\x0D]'")
    blocks = max(1, -(-wanted.count() // block_items))
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    out = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toPandas()
        ids = [None if pd.isna(i) else int(i) for i in part["item_id"]]
        shared = spark.sparkContext.broadcast(Index(list(range(len(ids))), part["text"].tolist()))

        def match(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in words.pieces(batch, limit=words.PIECE_BYTES // 2):
                    hits = list(search(words.find_words(piece.column("text")), shared.value))
                    if hits:
                        text, item, score, start, length = zip(*hits)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": piece.column("doc_id").take(pa.array(text, pa.int64())), "item_id": pa.array([ids[i] for i in item], pa.int64()),
                                "similarity": pa.array(score, pa.float64()), "first_word": pa.array(start, pa.int64()), "n_words": pa.array(length, pa.int64()),
                            }
                        )

        found = rows.mapInArrow(match, schema)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a near copy of an item; rows without an id stay."""
    hits = find_contamination(docs, items).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti")
