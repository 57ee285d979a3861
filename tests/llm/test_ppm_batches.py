"""The array steps of ``op4`` next to plain ones."""

import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from visitline.llm import ppm, words


def odd_texts(rng, n):
    return [rng.choice([None, "", " ", "a", "w\n\nq"]) if rng.random() < 0.4 else "".join(rng.choice("aB é\n") for _ in range(rng.randrange(30))) for _ in range(n)]


def plain_pairs(texts, order):
    out = []
    for text in texts:
        low = (text or "").replace("B", "b").split()
        stream = " ".join(low).encode() + b"\n"
        padded = b"\n" * order + stream
        out += [int.from_bytes(padded[i : i + order + 1], "big") for i in range(len(stream))]
    return out


def test_pair_keys_of_short_and_empty_texts():
    rng = random.Random(3)
    for _ in range(200):
        texts = odd_texts(rng, rng.randrange(6))
        stream, bounds = ppm.streams(words.find_words(pa.array(texts, pa.string())))
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(stream)
        for order in (0, 1, 3, 6, 7):  # orders above the length of all texts as well
            assert ppm.pair_keys(stream, bounds, order).tolist() == plain_pairs(texts, order)


def test_words_are_copied_as_one_array():
    found = words.find_words(pa.array(["Ab é x", None, "", "yy　z  q"]))
    for which in ([], [0], [3, 1, 1, 0], range(len(found.begin))):
        which = np.array(which, dtype=np.int64)
        got = found.string_array(which)
        got.validate(full=True)
        assert got.to_pylist() == found.strings(which)


def test_pairs_are_dealt_to_buckets_whole():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    mixed = rng.permutation(len(keys))
    for n in (1, 16, 70_000):
        rows = ppm._split(keys[mixed], counts[mixed], ppm._PAIRS, 5, 3, n)
        assert len({r[0] for r in rows}) == len(rows) and {r[2] for r in rows} == {5}
        got = {}
        for bucket, _, _, steps, rest in rows:
            own = np.cumsum(np.frombuffer(steps, np.uint64), dtype=np.uint64)
            assert (np.diff(own.astype(np.int64)) > 0).all() and set(ppm._bucket(own, 3, n).tolist()) == {bucket}
            got.update(zip(own.tolist(), np.frombuffer(rest, np.int64).tolist()))
        assert got == dict(zip(keys.tolist(), counts.tolist()))
    assert ppm._split(keys[:0], counts[:0], ppm._PAIRS, 0, 3, 16) == []


def test_pairs_are_counted_over_all_tasks(spark):
    rng = random.Random(5)
    texts = odd_texts(rng, 60)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = ppm.count_pairs(docs, 6)
    got = {r["key"]: r["n"] for r in counted.collect()}
    assert got == dict(collections.Counter(plain_pairs(texts, 6))) and counted.count() == len(got)
    assert ppm.count_pairs(docs.where(F.lit(False)), 6).count() == 0


def test_buckets_sum_rows_of_several_batches():
    rows = [(3, [5, 9], [1, 2]), (3, [9], [4]), (3, [2, 5], [1, 1]), (8, [5], [7])]
    dealt = [(b, np.diff(np.array(k, np.uint64), prepend=np.uint64(0)).tobytes(), np.array(n, np.int64).tobytes()) for b, k, n in rows]
    for size in (1, 2, 4):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*dealt[i : i + size])], names=["bucket", "keys", "rest"]) for i in range(0, 4, size)]
        got = [tuple(r.values()) for b in ppm._counted(iter(batches)) for r in b.to_pylist()]
        assert got == [(2, 1), (5, 2), (9, 6), (5, 7)]


def test_equal_positions_of_a_bucket_are_scored_once(monkeypatch):
    keys = np.array([7 << 8 | 1, 7 << 8 | 1, 7 << 8 | 1, 7 << 8 | 2], np.uint64)
    owner, asked = np.array([4, 0, 4, 0], np.uint32), []
    pairs = ppm._split(keys[[0, 3]], np.array([3, 1]), ppm._PAIRS, 0, 1, 1)
    open_ = ppm._split(keys, owner, ppm._OPEN, 0, 1, 1)
    plain = ppm.Model.log10
    monkeypatch.setattr(ppm.Model, "log10", lambda self, k: asked.append(len(k)) or plain(self, k))
    (batch,) = ppm._bucket_scores(iter([ppm._dealt([*pairs, *open_])]), 1, [])
    row = batch.to_pylist()[0]
    model = ppm.whole_model(keys[[0, 3]], np.array([3, 1]), 1, [])
    one, two = plain(model, keys[[0, 3]])
    assert np.frombuffer(row["keys"], np.uint32).tolist() == [0, 4]
    np.testing.assert_allclose(np.frombuffer(row["rest"], np.float64), [one + two, 2 * one])
    assert asked == [2]
