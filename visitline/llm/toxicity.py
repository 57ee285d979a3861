"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so token labels are derived first: in toxic training texts those words are
toxic that show a form (word, or its first 4, 5, 6 bytes) which training texts without the label almost
never show. The chain has two states; a token's evidence is a sum of hashed form weights. A text is cut
into stretches of ``STRETCH`` words; forward-backward gives each word's marginal. The document score is a
logistic function of the largest marginal's log-odds; words of at least one half are the offending spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from visitline.llm import words
from visitline.session import ship_package

STRETCH = 64
HASH_BITS = 18
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 5000  # at most so many labelled texts of each kind are fitted
SAMPLE_CHARS = 6_000  # stretches of about so many characters are fitted of a longer labelled text; every text is scored whole
TEXT_BLOCK, STRETCH_BLOCK = 64, 4096  # texts and stretches that a step of fitting holds whole
_EDGE = np.ones(256, dtype=bool)  # bytes stripped from both ends of a word
_EDGE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def forms(found: words.Words) -> np.ndarray:
    """Five hashed forms per word, a column each: the stripped word, its first 4, 5, 6 bytes, its last 4."""
    begin, end = found.begin.copy(), found.end.copy()
    while True:  # a word of signs only keeps its last byte
        move = (begin < end - 1) & _EDGE[found.data[begin]] if len(begin) else np.zeros(0, bool)
        if not move.any():
            break
        begin[move] += 1
    while True:
        move = (end > begin + 1) & _EDGE[found.data[end - 1]] if len(end) else np.zeros(0, bool)
        if not move.any():
            break
        end[move] -= 1
    runs = [(begin, end)] + [(begin, np.minimum(begin + n, end)) for n in (4, 5, 6)] + [(np.maximum(end - 4, begin), end)]
    return np.stack([words.hash_runs(found.data, b, e) + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1)) for i, (b, e) in enumerate(runs)], axis=1)


def _stretches(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every word in the matrix of stretches; lengths of the rows."""
    counts = np.diff(bounds)
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    rows_of = (counts + STRETCH - 1) // STRETCH
    row = np.repeat(np.concatenate([[0], np.cumsum(rows_of)])[:-1], counts) + inside // STRETCH
    place = inside % STRETCH
    lengths = np.bincount(row, minlength=int(rows_of.sum()))
    return row, place, lengths


def marginals(evidence: np.ndarray, bounds: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the toxic state of every word, and the summed marginal transitions ``(2, 2)``.

    ``chain``: log weights of the four transitions, then of starting toxic.
    """
    row, place, lengths = _stretches(bounds)
    n = len(lengths)
    step = np.exp(chain[:4].reshape(2, 2))
    local = np.ones((STRETCH, n))
    local[place, row] = np.exp(np.clip(evidence, -30, 30))
    real = np.zeros((STRETCH, n), dtype=bool)
    real[place, row] = True
    forward, backward = np.ones((STRETCH, 2, n)), np.ones((STRETCH, 2, n))
    for t in range(STRETCH):
        a = np.stack([np.ones(n), np.full(n, np.exp(chain[4]))]) if t == 0 else step.T @ forward[t - 1]
        a[1] *= local[t]
        forward[t] = a / a.sum(axis=0)
    for t in range(STRETCH - 2, -1, -1):
        b = backward[t + 1] * np.stack([np.ones(n), local[t + 1]])
        b = step @ b
        b /= b.sum(axis=0)
        backward[t] = np.where(real[t + 1], b, 1.0)  # nothing follows the last word
    joint = forward * backward
    odds = np.log(np.maximum(joint[:, 1], 1e-300)) - np.log(np.maximum(joint[:, 0], 1e-300))
    moves = np.zeros((2, 2))
    for t in range(STRETCH - 1):
        on = real[t + 1]
        if on.any():
            pair = forward[t][:, None, on] * step[:, :, None] * (backward[t + 1][:, on] * np.stack([np.ones(int(on.sum())), local[t + 1, on]]))[None]
            moves += (pair / pair.sum(axis=(0, 1))).sum(axis=2)
    return odds[place, row], moves


class Marks:
    """Forms that toxic texts show and clean ones hardly do, counted over blocks of texts.

    A form counts if a text with it is toxic in 9 of 10 cases at least, and if that many toxic texts by
    chance have odds below about ``exp(-10)``. Only distinct forms are held from one block to the next.
    """

    def __init__(self):
        self.counts = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)) for _ in range(4)]

    def add(self, hashed: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> None:
        for c, (known, bad, every) in enumerate(self.counts):
            column = hashed[:, c]
            _, once = np.unique(words.mix(column + words.mix(owner.astype(np.uint64))), return_index=True)  # a text counts once
            form, index = np.unique(np.concatenate([known, column[once]]), return_inverse=True)
            bad = np.bincount(index, weights=np.concatenate([bad, toxic[owner[once]]]), minlength=len(form))
            self.counts[c] = form, bad, np.bincount(index, weights=np.concatenate([every, np.ones(len(once))]), minlength=len(form))

    def close(self, share: float) -> None:
        share = max(share, 1e-9)
        self.marked = []
        for form, bad, every in self.counts:
            rate = bad / np.maximum(every, 1.0)
            self.marked.append(form[(rate >= 0.9) & (bad * np.log(np.maximum(rate, 1e-9) / share) >= 10)])
        self.counts = []

    def label(self, hashed: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Whether each word is taken as toxic: only in toxic texts."""
        out = np.zeros(len(hashed), dtype=bool)
        for c, marked in enumerate(self.marked):
            out |= np.isin(hashed[:, c], marked)
        return out & toxic[owner].astype(bool)


def some_stretches(text: str, limit: int) -> str:
    """A text of at most ``limit`` characters as it is; of a longer one stretches from anywhere, in order, up to that."""
    if len(text) <= limit:
        return text
    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    cuts = [0, *ends[STRETCH - 1 : -1 : STRETCH], len(text)]
    order = list(range(len(cuts) - 1))
    random.Random(xxhash.xxh3_64_intdigest(text)).shuffle(order)
    taken, size = [], 0
    for i in order:
        if size + cuts[i + 1] - cuts[i] <= limit:
            taken.append(i)
            size += cuts[i + 1] - cuts[i]
    if not taken:  # every stretch is longer than that by itself
        return text[cuts[order[0]] :][:limit]
    return "".join(text[cuts[i] : cuts[i + 1]] for i in sorted(taken))


def _blocks(texts: pa.Array) -> Iterator[tuple[slice, words.Words, np.ndarray]]:
    """Runs of texts with their words and the forms of these."""
    for start in range(0, len(texts), TEXT_BLOCK):
        found = words.find_words(texts.slice(start, TEXT_BLOCK))
        yield slice(start, start + TEXT_BLOCK), found, forms(found)


def fit_chain(texts: pa.Array, toxic: np.ndarray, rounds: int = 40, l2: float = 1e-3, cut: np.ndarray | None = None) -> dict:
    """Form weights, chain weights and the score's logistic map, by adaptive gradient steps on the likelihood.

    Toxic stretches are fitted with as many others as there are, and at least four times as many; the map
    is fitted on texts, without the toxic ones that are ``cut`` to stretches of which none has a toxic word.
    Texts are read and the chain is run in blocks; of all words only the weights' places are held, 20 bytes each.
    """
    mask = np.uint64((1 << HASH_BITS) - 1)
    marks = Marks()
    for part, found, hashed in _blocks(texts):
        marks.add(hashed, found.owner(), toxic[part])
    marks.close(float(toxic.mean()))
    parts, hot = [], []
    marked = np.zeros(len(toxic), dtype=bool)
    for part, found, hashed in _blocks(texts):
        owner = found.owner()
        truth = marks.label(hashed, owner, toxic[part])
        row, _, lengths = _stretches(found.bounds)
        marked[part] |= np.bincount(owner, weights=truth, minlength=len(found.bounds) - 1) > 0
        hot.append(np.bincount(row, weights=truth, minlength=len(lengths)) > 0)
        parts.append(((words.mix(hashed) & mask).astype(np.int32), truth, row, found.bounds))
    cold = np.flatnonzero(~np.concatenate(hot))
    take = np.concatenate(hot)
    take[cold[:: max(1, len(cold) // max(1, 4 * int(take.sum()) + 500))]] = True
    chosen, before = [], 0
    for (slots, truth, row, _), own in zip(parts, hot):
        for start in range(0, len(own), STRETCH_BLOCK):
            these = np.zeros(len(own), dtype=bool)
            these[start : start + STRETCH_BLOCK] = take[before + start : before + min(start + STRETCH_BLOCK, len(own))]
            on = these[row]
            kept = np.bincount(row[on], minlength=len(own))[these]
            if len(kept):
                same = np.flatnonzero(np.diff(row[on]) == 0)
                chosen.append((slots[on], truth[on].astype(float), np.concatenate([[0], np.cumsum(kept)]), same))
        before += len(own)
    chosen = _joined(chosen)
    weights, chain = np.zeros(1 << HASH_BITS), np.zeros(5)
    chain[4] = -2.0
    grown, grown_chain = np.full(1 << HASH_BITS, 1e-6), np.full(5, 1e-6)
    scale = max(sum(float(y.sum()) for _, y, _, _ in chosen), 1.0)
    for _ in range(rounds):
        slope, slope_chain = -l2 * weights, -l2 * chain
        for x, y, bounds, same in chosen:
            odds, moves = marginals(_evidence(weights, x), bounds, chain)
            p = 1 / (1 + np.exp(-odds))
            gap = (y - p) / scale
            slope += np.bincount(x.ravel(), weights=np.repeat(gap, x.shape[1]), minlength=len(weights))
            firsts = bounds[:-1][np.diff(bounds) > 0]
            seen = np.bincount((2 * y[same] + y[same + 1]).astype(int), minlength=4)
            slope_chain = slope_chain + np.append((seen - moves.ravel()) / scale, (y[firsts] - p[firsts]).sum() / scale)
        grown += slope**2
        grown_chain += slope_chain**2
        weights += 0.5 * slope / np.sqrt(grown)
        chain += 0.2 * slope_chain / np.sqrt(grown_chain)
    model = {"weights": weights.astype(np.float32), "chain": chain, "map": (1.0, 0.0)}
    best = np.concatenate([peak(marginals(_evidence(model["weights"], x), bounds, chain)[0], bounds) for x, _, _, bounds in parts])
    a, b = 1.0, 0.0
    z = np.clip(best, -20, 20)
    if cut is not None:
        shown = ~(cut & (toxic > 0) & ~marked)
        z, toxic = z[shown], toxic[shown]
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a += 0.02 * float(((toxic - p) * z).mean())
        b += 0.2 * float((toxic - p).mean())
    model["map"] = (a, b)
    return model


def _joined(blocks: list[tuple]) -> list[tuple]:
    """Blocks of stretches joined to such of about ``STRETCH_BLOCK`` stretches."""
    out, held, size = [], [], 0
    for i, block in enumerate(blocks):
        held.append(block)
        size += len(block[2]) - 1
        if size >= STRETCH_BLOCK or i == len(blocks) - 1:
            before = np.cumsum([0, *(len(y) for _, y, _, _ in held)])
            bounds = np.concatenate([[0], *(b[1:] + n for (_, _, b, _), n in zip(held, before))])
            out.append((np.concatenate([x for x, *_ in held]), np.concatenate([y for _, y, *_ in held]), bounds, np.concatenate([s + n for (*_, s), n in zip(held, before)])))
            held, size = [], 0
    return out


def _evidence(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    out = np.zeros(len(slots))
    for c in range(slots.shape[1]):
        out += weights[slots[:, c]]
    return out


def peak(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest log-odds of each text; -20 for a text without words."""
    out = np.full(len(bounds) - 1, -20.0)
    full = np.diff(bounds) > 0
    if len(odds):
        out[full] = np.maximum.reduceat(odds, bounds[:-1][full])
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN), chars: int = SAMPLE_CHARS) -> dict | None:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    At most ``sample`` documents of each kind that have a text, by md5 of the id, with at most ``chars``
    characters of each, in stretches from anywhere in it: the bound of the one task that fits. A document with several labels counts as toxic if one says so; rows
    without a label or text are not used. None if either kind is missing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    whole = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.join(whole.select("_id"), "_id", "left_semi")
    chosen = [
        marks.where(F.col("toxic") == kind).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most)
        for kind, most in zip((1, 0), sample)
    ]
    ids = chosen[0].union(chosen[1])  # at most sum(sample) rows

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [some_stretches(t, chars) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {"_id": batch.column("_id"), "text": pa.array(parts, pa.string()), "toxic": batch.column("toxic"), "cut": pa.array([len(t) > chars for t in texts], pa.bool_())}
            )

    named = whole.join(F.broadcast(ids), "_id").select(F.col("_id").cast("bigint").alias("_id"), "text", "toxic")
    texts = named.mapInArrow(bounded, "_id bigint, text string, toxic int, cut boolean")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "text"])
        toxic = pdf["toxic"].to_numpy().astype(float)
        if not 0 < toxic.mean() < 1:
            return pd.DataFrame({"weights": [b""], "rest": [[0.0]]})
        model = fit_chain(pa.array(pdf["text"], pa.string()), toxic, cut=pdf["cut"].to_numpy().astype(bool))
        return pd.DataFrame({"weights": [model["weights"].tobytes()], "rest": [[*model["chain"], *model["map"]]]})

    found = texts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "weights binary, rest array<double>").first()
    if found is None or not found["weights"]:
        return None
    rest = np.array(found["rest"])
    return {"weights": np.frombuffer(found["weights"], dtype=np.float32), "chain": rest[:5], "map": tuple(rest[5:])}


def score_toxicity(docs: DataFrame, model: dict | None, *, held_out: Column) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans, n_words`` of every row's whole text.

    ``spans`` lists ``start:end`` of the offending words in code points, end exclusive, comma-joined. Null
    or empty text has the score of no evidence and no spans. Without a model every score is 0. Rows that
    repeat return side by side.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS weights
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for piece in words.pieces(batch, limit=words.PIECE_BYTES // 2):
                found = words.find_words(piece.column("text"))
                spans = [""] * len(piece)
                scores = np.zeros(len(piece))
                if fitted is not None:
                    slots = (words.mix(forms(found)) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
                    odds, _ = marginals(fitted["weights"][slots].sum(axis=1), found.bounds, fitted["chain"])
                    a, b = fitted["map"]
                    scores = 1 / (1 + np.exp(-(a * np.clip(peak(odds, found.bounds), -20, 20) + b)))
                    _, offsets = words.text_bytes(piece.column("text"))
                    for i in np.unique(np.searchsorted(found.bounds, np.flatnonzero(odds >= 0), side="right") - 1).tolist():
                        raw = found.data[offsets[i] : offsets[i + 1]]
                        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        own = np.flatnonzero(odds[found.bounds[i] : found.bounds[i + 1]] >= 0) + found.bounds[i]
                        spans[i] = ",".join(f"{at[found.begin[w] - offsets[i]]}:{at[found.end[w] - offsets[i]]}" for w in own.tolist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(scores, pa.float64()),
                        "predicted": pa.array((scores >= 0.5).astype(np.int32)), "spans": pa.array(spans, pa.string()), "n_words": pa.array(np.diff(found.bounds).astype(np.int64)),
                    }
                )

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int, spans string, n_words bigint")
