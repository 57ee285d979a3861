r"""Alignment of two tokenizers' tokens over the bytes of a text.

The character offsets of the first tokenizer and the spans of the second one's proto are coarse cuts: where a token ends and
the next begins there, the byte offset is known. Tokens that share a character, and byte-fallback tokens, have no
such cut; theirs follow from the bytes that each stands for. Offsets where tokens of both end part a text into groups.

A text is encoded in stretches that neither tokenizer looks across, each distinct one once per worker: before a single
blank between characters that aren't white space, and before a single line break there. That holds for byte-level
pairs split by the usual expression, and for pieces of which none has a blank behind another character or a line
break; it is checked when the files are read, and a text is one stretch otherwise.

Two tokens that end together are suffixes of one another, so the distinct pairs are bounded by the
vocabularies (by the sum of their tokens' lengths), however many documents there are. Their counts alone go to every task.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from visitline.llm import words
from visitline.session import ship_package

BLANK = "▁"  # stands for a space in pieces
_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
_CUT = re.compile(r"(?<=[^\s\x00-\x20])(?=[ \n][^\s\x00-\x20])")
_PLAIN = re.compile(r"[ \n][^\s\x00-\x20]+")
_ODD = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f]|[ \n][ \n]|^[ \n]|[ \n]\Z")  # white space other than single blanks and line breaks inside
CHAINED = 256  # stretches encoded in one call
HELD_STRETCHES, HELD_CHARACTERS = 1 << 19, 1 << 24  # kept by a worker from one run of rows to the next


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the code points from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers and what the stretches met so far give."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(first)
        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        symbols = _byte_of_symbol()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.single = np.array([self.b.is_byte(i) for i in range(size)])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(BLANK, " ").encode() for p, one in zip(pieces, self.single)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in known], dtype=np.int64) for known in (self.a_bytes, self.b_bytes))
        self.width = size
        probe = self.b.encode("é a", return_type="proto").pieces
        self.spans_count_bytes = probe[len(probe) - 1].end == 4
        plain = [p for p, one in zip(pieces, self.single) if not one]
        split = spec.get("pre_tokenizer") or {}
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
            and all(t.get("special") for t in spec.get("added_tokens", []))
            and not any(BLANK in p.lstrip(BLANK) or "\n" in p or p.startswith(BLANK + "\n") for p in plain)
            and self._keeps_text(" a  é  b\n ")
        )
        self.clear()

    def _keeps_text(self, text: str) -> bool:
        """Whether the pieces are the text with the blank before it: no other spelling, no white space taken out."""
        return b"".join(self.b_bytes[i] for i in self.b.encode(text)) == f" {text}".encode()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.shown: list[str | None] = []  # groups of a stretch as text; None where the bytes aren't the text's
        self.sizes = array("q")  # tokens of both, groups and links of each stretch
        self.links = array("q")
        self.characters = 0

    def stretches(self, text: str) -> list:
        """Keys of the stretches of blank + text: the stretch without its blank, or from its line break on; any other one as a tuple."""
        if not self.cuts:
            return [(f" {text}",)]
        if not _ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if _PLAIN.fullmatch(s) and s[0] == " " else s if _PLAIN.fullmatch(s) else (s,) for s in _CUT.split(f" {text}")]

    def learn(self, found: set) -> None:
        plain = [s for s in found if isinstance(s, str)]
        for i in range(0, len(plain), CHAINED):
            some = plain[i : i + CHAINED]
            # stretches one after the other are a text that is cut between them; the first one holds its place only
            joined = [" a", *(s if s[0] == "\n" else f" {s}" for s in some)]
            if not self._align(joined, ["", *some]):
                for text, key in zip(joined[1:], some):
                    self._alone(text, key)
        for key in found.difference(plain):
            self._alone(key[0], key)

    def _alone(self, text: str, key) -> None:
        joined, keys = ([" a", text], ["", key]) if text[0] == "\n" else ([text], [key])
        if not self._align(joined, keys):
            self._keep(key, None, 0, 0, [])

    def _align(self, joined: list[str], keys: list) -> bool:
        """Keep the groups of each of the stretches; False where the tokens' bytes aren't those of the whole."""
        text = "".join(joined)
        raw = text.encode()
        first = self.a.encode(text, add_special_tokens=False)
        pieces = self.b.encode(text[1:], return_type="proto").pieces  # puts the blank back
        ids_a, ids_b = np.array(first.ids, dtype=np.int64), np.array([p.id for p in pieces], dtype=np.int64)
        if b"".join([self.a_bytes[i] for i in ids_a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in ids_b.tolist()]) != raw:
            return False
        spans = np.array(first.offsets, dtype=np.int64).reshape(-1, 2)
        at = np.append(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80), len(raw))  # bytes before each character
        after = np.append(spans[1:, 0], len(text))
        ends_a = np.where(after >= spans[:, 1], at[spans[:, 1]], np.cumsum(self.a_sizes[ids_a]))  # a shared character: own bytes
        cuts = np.array([p.end for p in pieces], dtype=np.int64) + 1
        cuts = cuts if self.spans_count_bytes else at[cuts]
        byte = self.single[ids_b]
        ends_b = np.where(byte | np.append(byte[1:], False), np.cumsum(self.b_sizes[ids_b]), cuts)  # byte fallback: own bytes
        shared = np.intersect1d(ends_a, ends_b)
        to_a, to_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
        borders = np.cumsum([len(s.encode()) for s in joined])
        to = np.searchsorted(shared, borders) + 1
        if to[-1] > len(shared) or (shared[to - 1] != borders).any():
            return False
        links = (ids_a[to_a - 1] * self.width + ids_b[to_b - 1]).tolist()
        shown_a, shown_b = [*map(str, ids_a.tolist())], [*map(str, ids_b.tolist())]
        to_a, to_b = [0, *to_a.tolist()], [0, *to_b.tolist()]
        groups = [f"{','.join(shown_a[i:j])}|{','.join(shown_b[k:l])}" for i, j, k, l in zip(to_a, to_a[1:], to_b, to_b[1:])]
        start = 0
        for key, stop in zip(keys, to.tolist()):
            if key != "":
                self._keep(key, ";".join(groups[start:stop]), to_a[stop] - to_a[start], to_b[stop] - to_b[start], links[start:stop])
            start = stop
        return True

    def _keep(self, key, shown: str | None, n_a: int, n_b: int, links: list[int]) -> None:
        """Every token has bytes, so each shared cut ends one token of either side: as many links as groups."""
        self.place[key] = len(self.shown)
        self.characters += len(key)
        self.shown.append(shown)
        self.sizes.extend((n_a, n_b, len(links)))
        self.links.extend(links)

    def shrink(self, wanted: set) -> None:
        """Forget all but the wanted stretches."""
        kept = {k: i for k, i in self.place.items() if k in wanted}
        shown, sizes, links = self.shown, np.array(self.sizes).reshape(-1, 3), np.array(self.links)
        begins = np.cumsum(sizes[:, 2]) - sizes[:, 2]
        self.clear()
        for key, i in kept.items():
            self._keep(key, shown[i], int(sizes[i, 0]), int(sizes[i, 1]), links[begins[i] : begins[i] + sizes[i, 2]].tolist())


_loaded: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    if files.id not in _loaded:
        _loaded.clear()
        _loaded[files.id] = Aligner(*files.value)
    return _loaded[files.id]


class Files:
    """The two files' bytes as a broadcast, told apart in the workers by number."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __reduce__(self):
        return _files, (self.broadcast, self.id)

    @property
    def value(self):
        return self.broadcast.value


def _files(broadcast, number) -> Files:
    out = Files.__new__(Files)
    out.broadcast, out.id = broadcast, number
    return out


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(codes, kind="stable")
    codes, times = codes[by], times[by]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(times, heads) if len(heads) else times


def _aligned(batches: Iterator[pa.RecordBatch], files: Files) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(files)
    for batch in batches:
        for piece in words.pieces(batch, limit=words.PIECE_BYTES // 2):
            parts = [aligner.stretches(t) if t else [] for t in piece.column("text").to_pylist()]
            every = [*chain.from_iterable(parts)]
            if len(aligner.shown) > HELD_STRETCHES or aligner.characters > HELD_CHARACTERS:
                aligner.shrink(set(every))
            met = np.fromiter(map(aligner.place.get, every, repeat(-1)), dtype=np.int64, count=len(every))
            new = np.flatnonzero(met < 0).tolist()
            aligner.learn({every[i] for i in new})
            met[new] = [aligner.place[every[i]] for i in new]
            known = np.array(aligner.sizes, dtype=np.int64).reshape(-1, 3)
            begins, flat = np.cumsum(known[:, 2]) - known[:, 2], np.array(aligner.links, dtype=np.int64)
            stops = np.cumsum([len(x) for x in parts])
            owner = np.repeat(np.arange(len(parts)), np.diff(stops, prepend=0))
            groups, refused = [], np.zeros(len(parts), dtype=bool)
            for i, (start, stop) in enumerate(zip([0, *stops.tolist()], stops.tolist())):
                shown = [*map(aligner.shown.__getitem__, met[start:stop].tolist())]
                refused[i] = None in shown
                groups.append("" if refused[i] else ";".join(shown))
            good = ~refused[owner]
            met, owner = met[good], owner[good]
            totals = np.zeros((len(parts), 3), dtype=np.int64)
            np.add.at(totals, owner, known[met])
            n = known[met, 2]
            codes = flat[np.repeat(begins[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            space = len(aligner.a_bytes) * aligner.width
            found, times = _summed(np.repeat(owner, n) * space + codes, np.ones(len(codes), dtype=np.int64))
            bounds = np.searchsorted(found, np.arange(len(parts) + 1) * space)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), *(pa.array(totals[:, k]) for k in (0, 1, 2, 2)), pa.array(groups, pa.string()),
                    words.list_column(found % space, bounds, pa.int64()), words.list_column(times, bounds, pa.int64()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )


def align_tokens(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Tokens of both tokenizers over every text, grouped where tokens of both end at one byte.

    ``docs`` needs ``doc_id`` and ``text``. ``first`` is a tokenizers file of a byte-level vocabulary, which encodes blank + text;
    ``second`` a sentencepiece model, which adds that blank itself. One row per row: ``doc_id``, tokens ``n_a`` and
    ``n_b``, ``n_groups``, ``n_links`` (occurrences of two tokens that end together), ``groups`` as ``a1,a2|b1;a3|b2``, and the
    document's distinct linked pairs (first id * number of pieces + second id) with their ``times``.

    Null and empty texts, and texts whose tokens' bytes aren't blank + text, have no tokens: zeros, ``''`` and empty arrays.
    Rows that repeat return each; no rows in, none out.
    """
    ship_package(docs.sparkSession)
    files = Files(docs.sparkSession.sparkContext.broadcast((Path(first).read_bytes(), Path(second).read_bytes())))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _aligned(it, files), _ALIGNED)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's own sums; there are no more of them than pairs that can end together."""
    codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more = [batch.column(c).flatten().to_numpy() for c in ("pairs", "times")]
        codes, times = _summed(np.concatenate([codes, more[0]]), np.concatenate([times, more[1]]))
    yield pa.RecordBatch.from_pydict({"pair": codes, "n": times})


def _scored(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    codes, often, best = counts.value
    for batch in batches:
        pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        at = np.searchsorted(codes, pairs.flatten().to_numpy())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64))])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")}
        yield pa.RecordBatch.from_pydict({**columns, "n_best": pa.array(sums(times * best[at]), pa.int64()), "count_sum": pa.array(sums(times * often[at]), pa.int64())})


def score_links(aligned: DataFrame, pieces: int) -> DataFrame:
    """``aligned`` (written before: it is read twice) with ``n_best`` and ``count_sum`` for its ``pairs`` and ``times``.

    A pair's count is the number of links of all documents that have it. ``n_best``: links whose count no other pair with
    the same second id exceeds; ``count_sum``: the counts summed over the links. ``pieces`` is the size of the second vocabulary.
    """
    tallied = aligned.select("pairs", "times").mapInArrow(_tallied, "pair bigint, n bigint")
    found = tallied.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # bounded by the vocabularies
    codes, often = found["pair"].to_numpy(), found["n"].to_numpy()
    by = np.argsort(codes)
    codes, often = codes[by], often[by]
    highest = np.zeros(pieces, dtype=np.int64)
    np.maximum.at(highest, codes % pieces, often)
    counts = aligned.sparkSession.sparkContext.broadcast((codes, often, (often == highest[codes % pieces]).astype(np.int64)))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_best bigint", "count_sum bigint"])
    return aligned.mapInArrow(lambda it: _scored(it, counts), schema)


def piece_count(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
