"""Language-model scores by prediction by partial matching over byte contexts.

A text is its lower-cased words, each followed by a space, with a line feed in place of the last space:
the line feed is the end token and also stands before the text. Counts of (context, byte) pairs are
gathered from all training texts, and the trie keeps every one, so it grows with the corpus. The symbols
of a context are a subset of its suffix's symbols, so after an escape exactly the longer context's symbols
are excluded and all exclusion sums can be tabulated per context.

No task holds the whole trie. Every task gets the answers for the most frequent full-order pairs, which
settle most positions. What is left is dealt by its nearest ``GROUP`` context bytes: all longer contexts
with these bytes meet in one bucket, whose tables are complete beside those of the lower orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from visitline.llm import words
from visitline.session import materialize, ship_package

ORDER = 6
TRIE_SHARE = 2.0**-22  # at most 2 ** 22 full-order pairs have their answer in every task
GROUP = 3  # nearest context bytes that deal the orders from here up; lower orders have 2 ** 24 pairs at most
BUCKET_PAIRS = 100_000  # trie pairs of a bucket, about
COUNT_BYTES = 2 << 20  # training bytes to a bucket in which pairs are counted, about
CHUNK_PAIRS = 3_000_000  # distinct pairs of pieces that a counting task holds
CHUNK_KEYS, CHUNK_TEXTS = 1_000_000, 20_000  # open positions and texts that a task gathers before it deals them
WORD_SHARE = 2.0**-18  # at most 2 ** 18 words are looked up in the tasks, the rest by a join
END, SPACE = 0x0A, 0x20


def streams(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as scored, and their ``n + 1`` bounds."""
    counts = np.diff(found.bounds)
    begin, end = found.begin, found.end
    if not counts.all():
        at = found.bounds[:-1][counts == 0]
        begin, end = np.insert(begin, at, 0), np.insert(end, at, 0)  # an empty word before the end
    sizes = end - begin + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.append(found.data, np.uint8(SPACE))[np.arange(total) + np.repeat(begin - ends + sizes, sizes)]
    out[ends - 1] = SPACE
    last = np.cumsum(np.maximum(counts, 1)) - 1
    out[ends[last] - 1] = END
    return out, np.concatenate([[0], ends[last]])


def pair_keys(stream: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """``context << 8 | byte`` of every position; the nearest byte of a context is its lowest."""
    padded = np.concatenate([np.full(7, END, np.uint8), stream])
    last_eight = np.ndarray(len(stream), ">u8", padded, strides=(1,))  # each position's byte and the seven before it
    keys = last_eight.astype(np.uint64) & np.uint64((1 << (8 * (order + 1))) - 1)
    for depth in range(order):  # what stands before a text is all ends
        at = bounds[:-1][np.diff(bounds) > depth] + depth
        before = int.from_bytes([END] * (order - depth), "little") << (8 * (depth + 1))
        keys[at] = keys[at] & np.uint64((1 << (8 * (depth + 1))) - 1) | np.uint64(before)
    return keys


class Table:
    """Open-addressing map of uint64 keys to positions, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.where = np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[slot] == np.iinfo(np.uint64).max
            self.slots[slot[free]] = keys[left[free]]
            won = self.slots[slot] == keys[left]
            self.where[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it isn't in the table."""
        slot = self._slot(keys)
        seen = self.slots[slot]
        out = np.where(seen == keys, self.where[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.slots[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.where[slot[open_[hit]]]
            open_ = open_[~hit & (seen != np.iinfo(np.uint64).max)]
        return out


class Model:
    """Tabulated log10 probabilities of a byte trie with escape estimates and symbol exclusion.

    A context that was met ``t`` times, with ``k`` kept symbols that make up ``m`` of these, gives a kept
    symbol met ``n`` times ``n / (t + k)`` and the escape ``(k + t - m) / (t + k)``: method C, in which what
    was pruned counts as escaped.
    """

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        """``pairs[j]``, ``contexts[j]``: sorted keys and counts of the kept pairs and contexts of order ``j``."""
        self.order = len(pairs) - 1
        self.pair, self.context, self.log_n, self.log_own = [], [], [], []
        self.escape = []  # of a context that is the longest seen
        self.log_rest, self.escape_rest = [], []  # one order below, after this context's symbols are excluded
        log = lambda x: np.log10(np.maximum(x, 1))
        low_kinds = low_kept = low_total = np.zeros(0)
        for j, (keys, counts) in enumerate(pairs):
            own, first = np.unique(keys >> np.uint64(8), return_index=True)
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            kept = np.add.reduceat(counts, first).astype(float) if len(keys) else np.zeros(0)
            total = contexts[j][1][np.searchsorted(contexts[j][0], own)].astype(float) if len(own) else np.zeros(0)
            self.pair.append(Table(keys))
            self.context.append(Table(own))
            self.log_n.append(np.log10(np.maximum(counts, 1)))
            self.log_own.append(self.log_n[-1] - np.repeat(np.log10(total + kinds), kinds.astype(np.int64)))
            self.escape.append(np.log10(kinds + total - kept) - np.log10(total + kinds))
            if j == 0:
                self.log_rest.append(log(256 - kinds))
                self.escape_rest.append(np.zeros(len(own)))
            else:
                below = pairs[j - 1][1][np.searchsorted(pairs[j - 1][0], keys & np.uint64((1 << (8 * j)) - 1))]
                excluded = np.add.reduceat(below, first).astype(float) if len(keys) else np.zeros(0)
                up = self.context[j - 1].find(own & np.uint64((1 << (8 * (j - 1))) - 1))
                rest_kinds, pruned = low_kinds[up] - kinds, low_total[up] - low_kept[up]
                size = low_total[up] - excluded + rest_kinds
                self.log_rest.append(log(size))
                self.escape_rest.append(np.where(rest_kinds + pruned > 0, log(rest_kinds + pruned) - log(size), 0.0))
            low_kinds, low_kept, low_total = kinds, kept, total

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each full-order pair key, given its context."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))  # positions without an answer yet
        above = np.full(len(keys), -1)  # index of the next longer context if it was seen
        for j in range(self.order, -1, -1):
            own = keys[left] & np.uint64((1 << (8 * (j + 1))) - 1)
            at = self.pair[j].find(own)
            hit, longer = at >= 0, above >= 0
            plain, reduced = hit & ~longer, hit & longer
            out[left[plain]] += self.log_own[j][at[plain]]
            if j < self.order:
                out[left[reduced]] += self.log_n[j][at[reduced]] - self.log_rest[j + 1][above[reduced]]
            here = self.context[j].find(own[~hit] >> np.uint64(8))
            left, above, longer = left[~hit], above[~hit], longer[~hit]
            if j < self.order:
                out[left[longer]] += self.escape_rest[j + 1][above[longer]]
            first = ~longer & (here >= 0)
            out[left[first]] += self.escape[j][here[first]]
            above = here
        if len(left):  # never seen in any context: even over the other bytes
            out[left] -= self.log_rest[0][0] if len(self.log_rest[0]) else math.log10(256)
        return out


def count_pairs(training: DataFrame, order: int) -> DataFrame:
    """``key, n`` of every distinct pair of the ``text`` column of all ``training`` rows, written once.

    Every task reduces its texts to distinct pairs, which are dealt by their contexts to buckets and summed there.
    """
    ship_package(training.sparkSession)
    texts = training.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // COUNT_BYTES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in words.pieces(batch):
                keys = pair_keys(*streams(words.find_words(piece.column("text"))), order)
                held.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held) > CHUNK_PAIRS:
                    held[:] = [_summed(_taken(held, 0), _taken(held, 1))]
                    if len(held[0][0]) > CHUNK_PAIRS // 2:
                        yield _dealt(_split(*held.pop(), _PAIRS, 0, order, buckets))
        if held:
            yield _dealt(_split(*_summed(_taken(held, 0), _taken(held, 1)), _PAIRS, 0, order, buckets))

    ordered = texts.mapInArrow(dealt, _DEALT).select("bucket", "keys", "rest").repartition("bucket").sortWithinPartitions("bucket")
    return materialize(ordered.mapInArrow(_counted, "key bigint, n bigint"), "pairs")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each bucket with the sums of their counts; rows come by bucket."""
    here, held = None, []

    def summed() -> pa.RecordBatch:
        keys, counts = _summed(_taken(held, 0), _taken(held, 1))
        held.clear()
        return pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    for batch in batches:
        for bucket, keys, rest in zip(batch.column("bucket").to_pylist(), _cells(batch, "keys"), _cells(batch, "rest")):
            if bucket != here and held:
                yield summed()
            here = bucket
            held.append((np.cumsum(np.frombuffer(keys, np.uint64), dtype=np.uint64), np.frombuffer(rest, np.int64).copy()))
    if held:
        yield summed()


def _sorted(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by = np.argsort(keys)
    return keys[by], counts[by]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[by], first) if len(keys) else counts[:0]


def fit_trie(training: DataFrame, *, order: int = ORDER, share: float = TRIE_SHARE) -> Model | None:
    """A model of bounded size of the ``text`` column of all ``training`` rows; None without rows.

    It keeps what makes up at least ``share`` of all positions; ``score_texts`` uses the whole trie.
    """
    pairs = count_pairs(training, order)
    total = pairs.agg(F.sum("n")).first()[0]
    if not total:
        return None

    def often(key: Column) -> tuple[np.ndarray, np.ndarray]:
        return _sorted(pairs.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(total * share)).toArrow())

    masked = [F.col("key").bitwiseAND(F.lit((1 << (8 * (j + 1))) - 1)) for j in range(order + 1)]
    return Model([often(m) for m in masked], [often(F.shiftright(m, 8)) for m in masked])


def whole_model(keys: np.ndarray, counts: np.ndarray, order: int, low: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Unpruned model of full-order pairs, sorted by key; ``low``: the pairs of the orders below, over all texts."""
    pairs, top = [], (keys, counts)
    for j in range(order, len(low) - 1, -1):
        pairs.insert(0, top)
        top = _summed(top[0] & np.uint64((1 << (8 * j)) - 1), top[1])
    pairs = [*low, *pairs]
    return Model(pairs, [_summed(k >> np.uint64(8), c) for k, c in pairs])


class Frequent:
    """log10 probabilities of the full-order pairs that make up at least ``share`` of all positions."""

    def __init__(self, pairs: DataFrame, least: float, order: int):
        keys, counts = _sorted(pairs.where(F.col("n") >= F.lit(least)).toArrow())
        own = pairs.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        found = own.where(F.col("n") >= F.lit(least)).toArrow()
        contexts, size = _sorted(found.select(["key", "n"]))
        kinds = found["kinds"].to_numpy()[np.argsort(found["key"].to_numpy().view(np.uint64))]
        at = np.searchsorted(contexts, keys >> np.uint64(8))
        self.order, self.table = order, Table(keys)
        self.answer = np.log10(counts) - np.log10((size + kinds)[at]) if len(keys) else np.zeros(0)


def _bucket(keys: np.ndarray, group: int, n: int) -> np.ndarray:
    """Bucket of each key, found for a block of keys at a time."""
    out = np.empty(len(keys), np.min_scalar_type(n))
    for a in range(0, len(keys), 1 << 18):
        near = (keys[a : a + (1 << 18)] >> np.uint64(8)) & np.uint64((1 << (8 * group)) - 1)
        out[a : a + (1 << 18)] = words.mix(near + np.uint64(1)) % np.uint64(n)
    return out


# Rows that are dealt: pairs of the trie, open positions of a chunk of texts, the chunk's other columns.
_PAIRS, _OPEN, _TEXTS = 0, 1, 2
_DEALT = "bucket bigint, kind int, chunk bigint, keys binary, rest binary"
_SCORED = "doc_id bigint, trained boolean, text_hash bigint, n_tokens bigint, known bigint, base double, score double"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "kind", "chunk", "keys", "rest"])


def _split(keys: np.ndarray, rest: np.ndarray, kind: int, chunk: int, group: int, n: int) -> list[tuple]:
    """A row per bucket with its keys, sorted, as differences, and what belongs to them."""
    by = np.argsort(keys)
    keys, rest = keys[by], rest[by]
    del by
    bucket = _bucket(keys, group, n)
    again = np.argsort(bucket, kind="stable")
    keys, rest, bucket = keys[again], rest[again], bucket[again]
    del again
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    heads, numbers = keys[first], bucket[first].tolist()
    keys[1:] -= keys[:-1].copy()
    keys[first] = heads
    return [
        (number, kind, chunk, keys[a:b].tobytes(), rest[a:b].tobytes())
        for number, a, b in zip(numbers, first.tolist(), [*first[1:].tolist(), len(keys)])
    ]


def _taken(held: list[tuple[np.ndarray, ...]], column: int) -> np.ndarray:
    """One array of a column of all held ones, which are let go."""
    out = np.concatenate([h[column] for h in held])
    held[:] = [(*h[:column], None, *h[column + 1 :]) for h in held]
    return out


def _cells(batch: pa.RecordBatch, column: str) -> Iterator[pa.Buffer]:
    """Values of a binary column, not copied."""
    return (cell.as_buffer() for cell in batch.column(column))


def _pair_rows(batches: Iterator[pa.RecordBatch], group: int, n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        out = _split(_taken(held, 0), _taken(held, 1), _PAIRS, 0, group, n)
        held.clear()
        return _dealt(out)

    for batch in batches:
        if len(batch):
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        if sum(len(k) for k, _ in held) >= CHUNK_KEYS:
            yield flush()
    if held:
        yield flush()


def _bucket_scores(batches: Iterator[pa.RecordBatch], order: int, low: list) -> Iterator[pa.RecordBatch]:
    """Sums of each chunk's texts over a bucket's positions; rows come by bucket, the trie's pairs first."""
    here, model = None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        out = []
        plain = (batch.column(c).to_pylist() for c in ("bucket", "kind", "chunk"))
        for bucket, kind, chunk, keys, rest in zip(*plain, _cells(batch, "keys"), _cells(batch, "rest")):
            if bucket != here:
                here, model = bucket, None
                held.clear()
            if kind == _TEXTS:
                out.append((bucket, kind, chunk, keys.to_pybytes(), rest.to_pybytes()))
                continue
            found = np.cumsum(np.frombuffer(keys, np.uint64), dtype=np.uint64)
            if kind == _PAIRS:
                held.append((found, np.frombuffer(rest, np.int64).copy()))
                continue
            if model is None:
                none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                model = whole_model(*_summed(*(np.concatenate(x) for x in zip(none, *held))), order, low)
                held.clear()
            owner = np.frombuffer(rest, np.uint32)
            head = np.flatnonzero(np.append(True, found[1:] != found[:-1]))  # equal keys lie side by side
            answer = np.repeat(model.log10(found[head]), np.diff(np.append(head, len(found))))
            each = np.flatnonzero(np.bincount(owner)).astype(np.uint32)
            out.append((bucket, kind, chunk, each.tobytes(), np.bincount(owner, weights=answer)[each].tobytes()))
        if out:
            yield _dealt(out)


def _texts_scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each chunk with the sums of all buckets; they come by chunk, its texts last."""
    here, more = None, []
    for batch in batches:
        for kind, chunk, keys, rest in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "keys", "rest"))):
            if chunk != here:
                here, more = chunk, []
            if kind == _OPEN:
                more.append((np.frombuffer(keys, np.uint32), np.frombuffer(rest, np.float64)))
                continue
            texts = pa.ipc.open_stream(rest).read_all().combine_chunks()
            score = texts["score"].to_numpy().copy()
            for at, sums in more:
                score[at] += sums  # a text once per row
            texts = texts.set_column(texts.schema.get_field_index("score"), "score", pa.array(score))
            yield from texts.to_batches()


def score_texts(docs: DataFrame, training: Column, *, order: int = ORDER, share: float = TRIE_SHARE, word_share: float = WORD_SHARE) -> DataFrame:
    """Base and model score of every whole text, learned from the rows where ``training`` holds.

    ``docs`` has ``doc_id`` and ``text`` (null: empty). ``share`` and ``word_share`` bound what goes to every
    task and have no part in the result. Returns ``doc_id, trained, n_tokens, n_known,
    train_tokens, base_score, score`` for every row. ``score`` is the log10 probability, under the
    pretrained trie, of the token sequence the base scores too: words in lower case and one end. The base
    is the smoothed unigram score of these tokens; without training rows its counts and ``base_score`` are
    over nothing (``train_tokens`` 0, every token equally unlikely), and the trie is even over all bytes.
    Rows that repeat id and text each return with the same scores; a null id is an id of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("trained")
    )
    learned = rows.where("trained")
    pairs = count_pairs(learned, order)
    met = pairs.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    group = min(order, GROUP)
    buckets = max(16, -(-met["kinds"] // BUCKET_PAIRS))
    frequent, low = None, []
    if met["n"]:
        frequent = Frequent(pairs, max(1.0, met["n"] * share), order)
        if group:
            key = F.col("key").bitwiseAND(F.lit((1 << (8 * group)) - 1))
            low.append(_sorted(pairs.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toArrow()))
            for j in range(group - 1, 0, -1):
                low.insert(0, _summed(low[0][0] & np.uint64((1 << (8 * j)) - 1), low[0][1]))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch):
                found = words.find_words(piece.column("text"))
                hashed = found.hashes()
                by = np.argsort(hashed)
                hashed = hashed[by]
                head = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(by) else by
                yield pa.RecordBatch.from_pydict({"word": found.string_array(by[head]), "c": pa.array(np.diff(np.append(head, len(by))))})

    known = materialize(learned.mapInArrow(tally, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    totals = known.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = learned.count()
    n = (totals["n"] or 0) + ends  # every training text has one end
    size = (totals["v"] or 0) + (1 if ends else 0)
    scale = math.log10(n + 0.1 * (size + 1))
    common = known.where(F.col("c") >= F.lit(max(1.0, n * word_share))).toArrow()
    hashes = _hash_words(common["word"].combine_chunks() if len(common) else pa.array([], pa.string()))
    shared = spark.sparkContext.broadcast((frequent, Table(hashes), common["c"].to_numpy().astype(np.float64)))
    lower = spark.sparkContext.broadcast(low)
    end_score, end_known = math.log10(ends + 0.1) - scale, int(ends > 0)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        _, table, _ = shared.value
        for batch in batches:
            for piece in words.pieces(batch):
                found = words.find_words(piece.column("text"))
                hashed = found.hashes()
                yield piece, found, hashed, table.find(hashed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, _, c = shared.value
        held: list[pa.RecordBatch] = []
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for batch in held:
                    out.write_batch(batch)
            rows = [(chunk % buckets, _TEXTS, chunk, b"", sink.getvalue().to_pybytes())]
            if open_:
                rows += _split(_taken(open_, 0), _taken(open_, 1), _OPEN, chunk, group, buckets)
            held.clear()
            open_.clear()
            return _dealt(rows)

        for piece, found, _, at in words_of(batches):
            owner, many = found.owner(), len(piece)
            hit = at >= 0
            stream, bounds = streams(found)
            if often:
                keys = pair_keys(stream, bounds, order)
                answer = often.table.find(keys)
                settled = answer >= 0
                by_byte = np.zeros(len(keys))
                by_byte[settled] = often.answer[answer[settled]]
                left = np.flatnonzero(~settled)
                before = sum(map(len, held))
                open_.append((keys[left], (before + np.repeat(np.arange(many, dtype=np.uint32), np.diff(bounds))[left]).astype(np.uint32)))
            else:
                by_byte = np.full(len(stream), -math.log10(256))
            sums = np.concatenate([[0.0], np.cumsum(by_byte)])
            held.append(pa.RecordBatch.from_pydict(
                {
                    "doc_id": piece.column("doc_id"), "trained": piece.column("trained"), "text_hash": piece.column("text_hash"),
                    "n_tokens": pa.array(np.diff(found.bounds) + 1),
                    "known": pa.array(np.bincount(owner[hit], minlength=many).astype(np.int64) + end_known),
                    "base": pa.array(np.bincount(owner[hit], weights=np.log10(c[at[hit]] + 0.1) - scale, minlength=many).astype(float) + end_score),
                    "score": pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
                }
            ))
            if sum(map(len, held)) >= CHUNK_TEXTS or sum(len(k) for k, _ in open_) >= CHUNK_KEYS:
                yield flush()
                chunk += 1
        if held:
            yield flush()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found, hashed, at in words_of(batches):
            miss = np.flatnonzero(at < 0)
            if not len(miss):
                continue
            # one row per text and word; the empty word counts the rows of a text
            owner = found.owner()[miss].astype(np.min_scalar_type(len(piece)))
            order_ = np.argsort(hashed[miss])
            order_ = order_[np.argsort(owner[order_], kind="stable")]
            o, h = owner[order_], hashed[miss][order_]
            head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
            tf = np.diff(np.append(head, len(o)))
            docs_with = o[np.flatnonzero(np.append(True, o[1:] != o[:-1]))]
            index = pa.array(np.concatenate([o[head], docs_with]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": piece.column("doc_id").take(index), "text_hash": piece.column("text_hash").take(index),
                    "word": pa.concat_arrays([found.string_array(miss[order_[head]]), pa.array([""] * len(docs_with), pa.string())]), "tf": pa.array(np.concatenate([tf, np.ones(len(docs_with), np.int64)])),
                }
            )

    source = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt = pairs.mapInArrow(lambda it: _pair_rows(it, group, buckets), _DEALT).union(source.mapInArrow(score, _DEALT))
    by_bucket = dealt.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", "kind")
    by_chunk = by_bucket.mapInArrow(lambda it: _bucket_scores(it, order, lower.value), _DEALT).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    scored = by_chunk.mapInArrow(_texts_scored, _SCORED)
    others = source.mapInArrow(rare, "doc_id bigint, text_hash bigint, word string, tf bigint").join(known, "word", "left")
    is_word = F.col("word") != ""
    sums = others.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sum(F.when(~is_word, F.col("tf"))).alias("copies"),
        F.sum(F.when(is_word, F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(scale)))).alias("rare_base"),
        F.sum(F.when(is_word & F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    joined = scored.join(sums, scored.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id", "trained", "n_tokens",
        (F.col("known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score",
    )


def _hash_words(column: pa.Array) -> np.ndarray:
    found = words.find_words(column)
    return found.hashes()
