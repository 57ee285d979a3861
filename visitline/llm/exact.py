"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has zero top bits, so equal stretches are cut
alike wherever they stand. Chunk bytes move once, already reduced to distinct ones per task; a chunk's
hash becomes its identifier only after the bytes behind it proved to be one and the same, and hashes
that stand for several contents are numbered apart. Documents are then compared by their ordered
identifier lists (8 bytes per chunk), so long texts aren't moved again and a hot text costs no more
than a short row per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from visitline.llm import words
from visitline.session import ship_package

WINDOW = 32
_GEAR = words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[0x09:0x0E] = 0x20


def normalized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with every run of white space as one space."""
    data, offsets = words.text_bytes(texts)
    data = _BLANK[data]
    blank = data == 0x20
    again = np.zeros(len(data), dtype=bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return data[~again], kept[offsets]


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """Chunk borders of each text, its start and end included; an empty text is one empty chunk."""
    rolled = _GEAR[data]
    width = 1
    while width < WINDOW:
        older = rolled.copy()
        rolled[width:] += older[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1
    lows, highs = np.searchsorted(marks, offsets[:-1]), np.searchsorted(marks, offsets[1:])
    out = []
    for start, end, low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lows.tolist(), highs.tolist()):
        cuts = [start]
        for mark in [*marks[low:high].tolist(), end]:
            while mark - cuts[-1] > most:
                cuts.append(cuts[-1] + most)
            if mark - cuts[-1] >= least and mark < end:
                cuts.append(mark)
        cuts.append(end)
        out.append(cuts)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], spec: dict, content: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    keep = (1 << spec["hash_bits"]) - 1
    for batch in batches:
        for piece in words.pieces(batch):
            data, offsets = normalized(piece.column("text"))
            raw, ids = data.tobytes(), piece.column("doc_id")
            cuts = cut_points(data, offsets, spec["bits"], spec["least"], spec["most"])
            if content:
                seen, owner, seq, hashes, blobs = set(), [], [], [], []
                for i, borders in enumerate(cuts):
                    for j, (a, b) in enumerate(zip(borders, borders[1:])):
                        blob = raw[a:b]
                        if not positions:
                            if blob in seen:
                                continue
                            seen.add(blob)
                        owner.append(i), seq.append(j), hashes.append(xxhash.xxh3_64_intdigest(blob) & keep), blobs.append(blob)
                columns = {"hash": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), "chunk": pa.array(blobs, pa.binary())}
                if positions:
                    columns = {"doc_id": ids.take(pa.array(owner, pa.int64())), "seq": pa.array(seq, pa.int32()), **columns}
                yield pa.RecordBatch.from_pydict(columns)
                continue
            recipes, digests = [], []
            for borders in cuts:
                recipes.append(b"".join((xxhash.xxh3_64_intdigest(raw[a:b]) & keep).to_bytes(8, "big") for a, b in zip(borders, borders[1:])))
                digests.append(hashlib.sha256(raw[borders[0] : borders[-1]]).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "recipe": pa.array(recipes, pa.binary()), "text_sha256": pa.array(digests)})


def chunk_recipes(docs: DataFrame, *, bits: int = 11, least: int = 512, most: int = 65536, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, recipe, numbers, text_sha256)``: the verified ordered identifier list of every row.

    ``recipe`` holds one 8-byte chunk hash after the other. ``numbers`` is null, but where a hash of the
    recipe stands for several contents in the corpus: there it lists ``(seq, number of the content)``.
    ``bits``: the mean chunk is ``2 ** bits`` bytes; ``least``/``most``: bounds of a chunk that isn't the
    last; ``hash_bits`` below 64 only serves tests of clashes.
    """
    ship_package(docs.sparkSession)
    spec = {"bits": bits, "least": max(least, WINDOW), "most": most, "hash_bits": hash_bits}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = rows.mapInArrow(lambda it: _chunks(it, spec, False, False), "doc_id bigint, recipe binary, text_sha256 string")
    contents = rows.mapInArrow(lambda it: _chunks(it, spec, True, False), "hash bigint, chunk binary").groupBy("hash", "chunk").agg(F.count("*").alias("n"))
    clashes = contents.groupBy("hash").agg(F.count("*").alias("contents")).where("contents > 1").select("hash")
    if clashes.isEmpty():  # every hash stands for one content
        return recipes.withColumn("numbers", F.lit(None).cast("array<struct<seq:int,number:int>>"))
    numbered = contents.join(clashes, "hash").select("hash", "chunk", F.row_number().over(W.partitionBy("hash").orderBy("chunk")).alias("number"))
    placed = rows.mapInArrow(lambda it: _chunks(it, spec, True, True), "doc_id bigint, seq int, hash bigint, chunk binary")
    numbers = (
        placed.join(numbered, ["hash", "chunk"])
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.sort_array(F.collect_set(F.struct("seq", "number"))).alias("numbers"))
    )
    return recipes.join(numbers, recipes.doc_id.eqNullSafe(F.col("_id")), "left").drop("_id")


def exact_duplicates(docs: DataFrame, **chunking: int) -> DataFrame:
    """Groups of texts that are equal after replacing each white-space run by one space.

    One row per row of ``docs`` (columns ``doc_id``, ``text``; others aren't read): ``doc_id``,
    ``keep_id`` (smallest id of the group), ``group_size``, ``kept``, ``text_sha256`` and ``n_chunks``.
    Null text counts as empty and empty texts are one group; no row is dropped. A null ``doc_id`` loses
    against any other; where a group has no other, ``keep_id`` is null and the rows stay. Rows that
    repeat both id and text are one document: each returns, all with the same ``kept``. No rows in, none out.
    """
    recipes = chunk_recipes(docs, **chunking)
    groups = recipes.groupBy("recipe", "numbers").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumnsRenamed({"recipe": "_recipe", "numbers": "_numbers"})
    same = (F.col("recipe") == F.col("_recipe")) & F.col("numbers").eqNullSafe(F.col("_numbers"))
    return recipes.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        (F.length("recipe") / 8).cast("bigint").alias("n_chunks"),
    )
