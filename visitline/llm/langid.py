"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of plus and minus ones. One linear classifier per bit is trained to tell
the languages with plus from those with minus, on hashed byte n-grams of 1 to 3 bytes. A text is given
to the language whose codeword has the least summed logistic loss under the bit margins (loss-weighted
decoding); if the runner-up is nearly as near, the row is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visitline.llm import words
from visitline.session import ship_package

BUCKET_BITS = 12
SAMPLE_ROWS = 3000  # at most so many labelled texts are fitted, all languages together
SAMPLE_CHARS = 20_000  # of each sampled text, from anywhere; predictions read whole texts
UNKNOWN = "und"
LETTER = r"\p{L}"  # Unicode categories L*, in fitting and predicting alike
_FOLD = words._LOWER.copy()
_FOLD[[*range(0x00, 0x21), *range(0x30, 0x3A)]] = 0x20  # controls and digits are blanks


def features(texts: pa.Array, bits: int = BUCKET_BITS) -> np.ndarray:
    """One row per text: square roots of n-gram shares in ``2 ** bits`` buckets, scaled to length one."""
    data, offsets = words.text_bytes(texts)
    folded = _FOLD[data].astype(np.uint32)
    size = 1 << bits
    out = np.zeros((len(offsets) - 1, size), dtype=np.float32)
    codes = [folded * np.uint32(0x9E3779B1) + np.uint32(7)]
    for n in (2, 3):
        longer = codes[-1].copy()
        longer[n - 1 :] = (codes[-1][: len(folded) - n + 1] ^ folded[n - 1 :]) * np.uint32(0x85EBCA6B) + np.uint32(n)
        codes.append(longer)
    codes = [c >> np.uint32(32 - bits) for c in codes]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for n, code in enumerate(codes):  # grams that lie inside this text
            if b - a > n:
                out[i] += np.bincount(code[a + n : b], minlength=size)
    np.sqrt(out, out=out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of distinct bits: exhaustive up to 7 languages, else rows of a Hadamard matrix.

    The exhaustive code has ``2 ** (n - 1) - 1`` bits and distance ``2 ** (n - 2)``; the Hadamard code of
    order ``m`` (a power of two above ``n``) has ``m - 1`` bits and distance ``m / 2``.
    """
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        columns = [[1] + [1 if (c >> j) & 1 else -1 for j in range(n - 1)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, dtype=np.int8).T
    order = 1 << n.bit_length()
    index = np.arange(order)
    parity = np.array([[bin(i & j).count("1") & 1 for j in index] for i in index])
    matrix = 1 - 2 * parity
    return matrix[1 : n + 1, 1:].astype(np.int8)


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 200, l2: float = 1e-5, scale: float = 10.0) -> np.ndarray:
    """Weights ``(buckets + 1, bits)`` of one logistic classifier per bit, by accelerated gradient steps.

    Languages weigh alike however many texts each has.
    """
    x = np.hstack([x * scale, np.ones((len(x), 1), dtype=np.float32)])
    target = code[y].astype(np.float32)
    counts = np.bincount(y, minlength=len(code))
    weight = (1.0 / np.maximum(counts, 1))[y].astype(np.float32)
    weight /= weight.sum()
    step = 4.0 / (scale * scale + 1)
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        margin = (x @ ahead) * target
        slope = -target / (1 + np.exp(np.clip(margin, -30, 30)))
        new = ahead - step * (x.T @ (slope * weight[:, None]) + l2 * ahead)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    w[:-1] *= scale
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score in 0..1 and the runner-up's score, by summed logistic losses."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(axis=2) * (2.0 / max(code.shape[1], 1))
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    score = share[np.arange(len(share)), best]
    share[np.arange(len(share)), best] = -1
    return best, score, np.maximum(share.max(axis=1), 0) if share.shape[1] > 1 else np.zeros(len(share))


def _stretch(text: Column, key: Column, chars: int) -> Column:
    """Up to ``chars`` characters from a place that ``key``'s hash chooses; from the first letter if there is none in them."""
    start = F.pmod(F.xxhash64(key), F.greatest(F.length(text) - chars + 1, F.lit(1))).cast("int") + 1
    anywhere = F.substr(text, start, F.lit(chars))
    return F.when(anywhere.rlike(LETTER), anywhere).otherwise(F.substr(F.regexp_replace(text, r"^\P{L}++", ""), F.lit(1), F.lit(chars)))


def fit_language_codes(
    labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, bits: int = BUCKET_BITS, sample_chars: int = SAMPLE_CHARS
) -> dict:
    """A model from ``doc_id, text, lang``: at most ``sample_rows`` rows, as many of each language as possible.

    Rows are taken in the order of md5(doc_id) per language; rows without lang or without a letter are
    not used. Texts above ``sample_chars`` characters give a stretch of that size from anywhere. Fitting runs in
    one task, whose input is bounded by ``sample_rows * sample_chars`` characters. Without
    labelled rows the model knows no language and everything is ``und``.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    rows = rows.withColumn("text", _stretch(F.col("text"), F.coalesce("id", F.lit("")), sample_chars))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # one row per language
    if not langs:
        return {"langs": [], "code": codewords(0), "weights": None, "bits": bits}
    each = max(1, sample_rows // len(langs))
    # the share of each language that is taken is chosen by hash before anything is shuffled
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    shares = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, 1.5 * each / counts[lang] + 20 / counts[lang]))])
    place = F.conv(F.substring(F.md5(F.coalesce("id", F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sample = rows.where(place < shares[F.col("lang")])
    code = codewords(len(langs))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=pd.util.hash_array(pdf["id"].fillna("").to_numpy(dtype=object))).sort_values(["lang", "key", "text"])
        pdf = pdf.groupby("lang").head(each)
        y = pdf["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
        w = fit_bits(features(pa.array(pdf["text"], pa.string()), bits), y, code)
        return pd.DataFrame({"weights": [w.tobytes()]})

    blob = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "weights binary").first()[0]
    weights = np.frombuffer(blob, dtype=np.float32).reshape((1 << bits) + 1, code.shape[1])
    return {"langs": langs, "code": code, "weights": weights, "bits": bits}


def predict_language(docs: DataFrame, model: dict, *, keep: Sequence[str | Column] = ("doc_id",), margin: float = 0.05) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``ambiguous`` of every row's whole text.

    ``und`` with score 0 where the text is null, empty or without a letter. ``score`` is the share of the
    chosen language in a soft minimum of the codeword losses; ``ambiguous`` where the runner-up's share
    is less than ``margin`` below. Ties go to the language first in order. Rows are kept as they are.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(*keep)
    text = F.col("text").cast("string")
    source = docs.select(F.struct(*keep).alias("kept"), text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("known"))
    names = np.array([*model["langs"], UNKNOWN], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["code"]))  # buckets x bits floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, code = shared.value
        for batch in batches:
            for large in words.pieces(batch):
                for at in range(0, len(large), 256):
                    piece = large.slice(at, 256)
                    texts = piece.column("text")
                    known = piece.column("known").to_numpy(zero_copy_only=False).astype(bool)
                    if weights is None:
                        known[:] = False
                        best, score, second = (np.zeros(len(piece)),) * 3
                    else:
                        best, score, second = decode(features(texts, model["bits"]) @ weights[:-1] + weights[-1], code)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "kept": piece.column("kept"),
                            "lang_pred": pa.array(names[np.where(known, best, len(names) - 1).astype(int)], pa.string()),
                            "score": pa.array(np.where(known, score, 0.0).astype(np.float64)),
                            "ambiguous": pa.array(known & (score - second < margin)),
                        }
                    )

    schema = f"kept {source.schema['kept'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"
    return source.mapInArrow(predict, schema).select(*[F.col("kept")[c].alias(c) for c in kept.columns], "lang_pred", "score", "ambiguous")
