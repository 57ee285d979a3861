"""Near duplicates by a parity-sketch join on sets of word shingles.

Sets of similar size meet in a size band. In a band, every set's shingles are dealt to blocks by hash
and XOR-ed per block. Two sets that reach the similarity differ in at most ``d`` shingles, so of
``d + 1 + g`` blocks at least ``g + 1`` hold no difference and have equal XORs (one of them with shingles,
as at most ``g`` may be empty): equal blocks are join keys, no linked pair is lost. A second sketch XORs
one bit per shingle; its Hamming distance never exceeds the symmetric difference and so refutes most
candidates before any set is moved. The rest is verified on the sets.

Equal sets are one node. In a block's group every node is compared with the group's best-connected
node first. Groups that are still in several components are compared in tiles of bounded size, by
sketches, without a row per pair, and only links that connect components leave a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from visitline.llm import words
from visitline.llm.bitmaps import bitmap_of, passing
from visitline.llm.components import component_labels
from visitline.session import materialize, release, ship_package

BAND_RATIO = 1.6
TILE_NODES, TILE_ELEMENTS = 512, 1 << 20  # of a group that one task holds, about, twice over
COUNT_BITS = 44  # of a block's key when blocks are counted; the filter reads fewer of its low bits
KEY_FILTER_BITS, NODE_FILTER_BITS = 27, 24  # sizes of the filters at any corpus size


class Bands:
    """Size bands ``[low, top]`` with the number of blocks and the spare blocks ``g`` of each."""

    def __init__(self, numerator: int, denominator: int):
        self.num, self.den = numerator, denominator
        self.low, self.top, self.blocks, self.spare = [], [], [], []

    def upto(self, size: int) -> None:
        while not self.top or self.top[-1] < size:
            low = self.top[-1] + 1 if self.top else 1
            top = max(low, int(low * BAND_RATIO))
            d = 2 * top * (self.den - self.num) // (self.den + self.num)
            least = low * self.num / self.den  # partners from the band below
            empty = (d + 2) * np.exp(-least / (d + 2))  # expected empty blocks of the smallest set
            spare = 1 + int(np.ceil(empty + 3 * np.sqrt(empty)))
            self.low.append(low), self.top.append(top), self.blocks.append(d + 1 + spare if d else 0), self.spare.append(spare)

    def of(self, size: int) -> list[int]:
        """The band of a set, and the next one if a linked partner may be there."""
        largest = size * self.den // self.num
        self.upto(largest)
        band = int(np.searchsorted(self.top, size))
        return [b for b in range(band, len(self.top)) if self.low[b] <= max(largest, size)]


def unique_sets(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(hashes[a:b])


def node_id(elements: np.ndarray) -> int:
    """64-bit identity of a set: mixed sum and XOR of its elements and its size."""
    both = np.array([elements.sum(dtype=np.uint64), np.bitwise_xor.reduce(elements) if len(elements) else 0, len(elements)], dtype=np.uint64)
    return int(words.mix(words.mix(both[:1] + both[2:] * words._STEP) ^ both[1:2])[0])


def block_keys(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: band, block and XOR of the block, mixed into 64 bits.

    Blocks without shingles are left out, unless the set has so many that a pair could agree in none but
    those.
    """
    keys = []
    for band in bands.of(len(elements)):
        m = bands.blocks[band]
        if not m:  # such sets are linked only if equal, and equal sets are one node
            continue
        at = np.searchsorted(elements >> np.uint64(32), (np.arange(m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
        sizes = np.diff(np.append(at, len(elements)))
        full = np.flatnonzero(sizes)
        xor = np.zeros(m, dtype=np.uint64)
        xor[full] = np.bitwise_xor.reduceat(elements, at[full])
        which = full if m - len(full) <= bands.spare[band] else np.arange(m)
        keys.append(words.mix(xor[which] ^ words.mix(np.uint64(band << 32) + which.astype(np.uint64))))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def bit_sketch(elements: np.ndarray) -> bytes:
    """Parity bits, one toggled per shingle: the least power of two of at least 4 bits a shingle, 64 at least."""
    width = 1 << max(6, int(4 * len(elements) - 1).bit_length())
    bits = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer one is folded, which only loses differences."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in words.pieces(batch):
            found = words.find_words(piece.column("text"))
            yield piece, list(unique_sets(*words.shingle_hashes(found.hashes(), found.bounds, k)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 3, similarity: tuple[int, int] = (90, 100), carry_sets: bool = True, with_row_hash: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``; others aren't read).

    Rows are linked if the Jaccard similarity of their sets of distinct word shingles is at least
    ``similarity`` (numerator, denominator, above one half); the component is the smallest ``doc_id``
    that links reach. Fewer words than a shingle make one shingle; null text or no word makes an empty
    set, linked with nothing, so its component is its own id. Rows with equal sets are linked. A null
    ``doc_id`` gets its group's component, null if no row there has an id. Shingles are compared by
    64-bit hashes. No rows in, none out.

    ``with_row_hash`` adds ``row_hash``, Spark's ``xxhash64`` of the text, which tells rows of one id apart, and ``group``,
    which tells components apart whose smallest ids are equal.
    ``carry_sets`` tells how tiles verify: with the sets at hand, or by sketches only, sixteen times smaller,
    after which the presumed links are verified by joins and, if one fails, all that remain possible.
    """
    num, den = similarity
    if not den < 2 * num <= 2 * den:
        raise ValueError("similarity must be above one half and at most one")
    spark = docs.sparkSession
    ship_package(spark)
    k = words_per_shingle
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.withColumn("row_hash", F.xxhash64("text") if with_row_hash else F.lit(0).cast("bigint"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _sets(batches, k):
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "row_hash": piece.column("row_hash"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": _longs([node_id(s) for s in sets])})

    def keyed(batches: Iterator[pa.RecordBatch], wanted: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
        bands, done = Bands(num, den), set()
        for _, sets in _sets(batches, k):
            done.clear()  # copies inside a piece need no second set of keys
            keys, owners = [], []
            for s in sets:
                if len(s) and (node := node_id(s)) not in done:
                    done.add(node)
                    keys.append(block_keys(s, bands))
                    owners.append(np.full(len(keys[-1]), node, dtype=np.uint64))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            if wanted is not None:
                passed = passing(wanted.value, key)
                key, owner = key[passed], owner[passed]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "node": pa.array(owner.view(np.int64))})

    nodes = materialize(named.mapInArrow(describe, "doc_id bigint, row_hash bigint, n_shingles bigint, node bigint"), "nodes")
    # Most blocks are unlike all others. Blocks met more than once (if only in copies) are found by counts of
    # shortened keys, which at most lets more of them pass; only they, and what their filter lets pass, are shuffled together with their nodes.
    short = F.col("key").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).alias("key")
    often = rows.mapInArrow(keyed, "key bigint, node bigint").groupBy(short).agg(F.count("*").alias("n")).where("n > 1")
    wanted = spark.sparkContext.broadcast(bitmap_of(often, "key", KEY_FILTER_BITS))
    all_keys = rows.mapInArrow(lambda it: keyed(it, wanted), "key bigint, node bigint")
    groups = all_keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    shared = materialize(all_keys.join(groups, "key").distinct(), "keys")  # only blocks that several nodes have
    columns = ("sketch", "elements") if carry_sets else ("sketch",)
    both = _candidate_table(rows, shared, k, columns)
    sets_of = (lambda nodes: both) if carry_sets else (lambda nodes: _candidate_table(rows, nodes, k, ("elements",)))
    links, spent = _linked(shared, _verifier(both, sets_of, num, den), both, num, den, carry_sets)
    labels = component_labels(links, "a", "b").withColumnsRenamed({"vertex": "node", "component": "root"})
    release(*spent)
    labelled = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(lowest, "root").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["row_hash", F.col("root").alias("group")] if with_row_hash else []),
    )


def _candidate_table(rows: DataFrame, shared: DataFrame, k: int, columns: tuple[str, ...]) -> DataFrame:
    """Sketch or set, or both, of each ``node`` of ``shared``, found again by a filter of fixed size.

    The filter is a bitmap of hashed nodes. However full it gets it lets every candidate pass; nodes that
    pass wrongly join with no pair.
    """
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap_of(shared, "node", NODE_FILTER_BITS))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, k):
            passed = passing(wanted.value, np.array([node_id(s) for s in sets], dtype=np.uint64))
            out = {node_id(s): s for s, p in zip(sets, passed.tolist()) if p and len(s)}
            if out:
                made = {"sketch": lambda s: bit_sketch(s), "elements": lambda s: s.tobytes()}
                yield pa.RecordBatch.from_pydict(
                    {"node": _longs(list(out)), "n": pa.array([len(s) for s in out.values()], pa.int64()), **{c: pa.array([made[c](s) for s in out.values()], pa.binary()) for c in columns}}
                )

    schema = ", ".join(["node bigint, n bigint", *(f"{c} binary" for c in columns)])
    return materialize(rows.mapInArrow(tables, schema).dropDuplicates(["node"]), "sets")


def _verifier(sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left = table.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("x"))
        right = table.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("y"))
        return pairs.join(left, "a").join(right.hint("merge"), "b").where((F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num))

    def run(test: Callable[[int, int, bytes, bytes], bool]) -> Callable:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "x", "y")]
                yield batch.select(["a", "b"]).filter(pa.array([test(*r) for r in zip(*cols)], pa.bool_()))

        return step

    def possible(n: int, m: int, x: bytes, y: bytes) -> bool:
        return hamming(x, y) * (den + num) <= (n + m) * (den - num)

    def exact(n: int, m: int, x: bytes, y: bytes) -> bool:
        common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return common * den >= num * (n + m - common)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The written links among the pairs; sets are only made for pairs that their sketches don't refute."""
        alike = materialize(both(pairs, sketches, "sketch").mapInArrow(run(possible), "a bigint, b bigint"), "alike")
        sets = sets_of(alike.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        links = materialize(both(alike, sets, "elements").mapInArrow(run(exact), "a bigint, b bigint"), name)
        release(alike)
        if sets is not sketches:
            release(sets)
        return links

    return verify


def _linked(
    shared: DataFrame, verify: Callable[[DataFrame, str], DataFrame], both: DataFrame, num: int, den: int, carry_sets: bool
) -> tuple[DataFrame, list[DataFrame]]:
    """Links whose components are those of all links between nodes that share a block, and the tables to release after them."""
    # Stars: the most widely shared node of each block's group against the others.
    sizes = shared.groupBy("key").agg(F.count("*").alias("members"))
    weights = shared.join(sizes, "key").groupBy("node").agg(F.sum("members").alias("weight"))
    centres = shared.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    groups = materialize(shared.join(centres, "key").select("centre", "node").distinct(), "groups")
    stars = groups.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    release(shared)
    links = verify(stars, "stars")
    spent = [groups, both, links]
    if carry_sets:
        dealt = _dealt(groups, links, both)
        spent.append(materialize(dealt.mapInArrow(lambda it: _crossing(it, num, den, "sets"), "a bigint, b bigint"), "crossing"))
        return links.union(spent[-1]), spent
    for how in ("presumed", "possible"):
        dealt = _dealt(groups, links, both)
        pairs = materialize(dealt.mapInArrow(lambda it, how=how: _crossing(it, num, den, how), "a bigint, b bigint").distinct(), "pairs")
        found = verify(pairs, "crossing")
        links = links.union(found)
        spent += [pairs, found]
        if found.count() == pairs.count():  # what was presumed holds, so nothing was passed over wrongly
            break
    return links, spent


def _dealt(groups: DataFrame, links: DataFrame, both: DataFrame) -> DataFrame:
    """Nodes of the groups that lie in several components, dealt to pairs of tiles and sorted by these.

    Two nodes of a block stand in the group of its centre, so no other pair can be linked.
    """
    labels = component_labels(links, "a", "b").withColumnRenamed("vertex", "node")
    placed = groups.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        placed.join(both.select("node", "n"), "node").groupBy("centre")
        .agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("centre", F.greatest(F.ceil(F.col("members") / TILE_NODES), F.ceil(F.col("elements") / TILE_ELEMENTS)).cast("int").alias("tiles"))
    )
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = placed.join(mixed, "centre").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("centre", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "component")
    return tiled.join(both, "node").repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high", "node")


def _crossing(batches: Iterator[pa.RecordBatch], num: int, den: int, how: str) -> Iterator[pa.RecordBatch]:
    """Links that join components inside each pair of tiles; rows come sorted, one pair of tiles is held."""
    held: list[dict] = []
    group = None

    def flush() -> pa.RecordBatch | None:
        found = _tile_links(held, num, den, how) if len(held) > 1 else []
        held.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}) if found else None

    for batch in batches:
        for start in range(0, len(batch), 256):
            for row in batch.slice(start, 256).to_pylist():
                if (row["centre"], row["low"], row["high"]) != group:
                    if (out := flush()) is not None:
                        yield out
                    group = (row["centre"], row["low"], row["high"])
                held.append(row)
    if (out := flush()) is not None:
        yield out


def _tile_links(rows: list[dict], num: int, den: int, how: str) -> list[tuple[int, int]]:
    """A link for every two components that the nodes of two tiles (or of one) connect.

    All nodes of different components are compared by folded sketches; what these don't refute is
    verified, nearest first, unless links found before connect it already. ``how`` "presumed" takes it for
    a link instead, "possible" returns all of it.
    """
    width = min(len(r["sketch"]) for r in rows)
    sketches = np.zeros((len(rows), width), dtype=np.uint8)
    for i, r in enumerate(rows):
        bits = np.frombuffer(r["sketch"], np.uint8)
        while len(bits) > width:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        sketches[i] = bits
    sketches = sketches.view(np.uint64)
    n, component, tile = (np.array([r[c] for r in rows]) for c in ("n", "component", "tile"))
    across = rows[0]["low"] != rows[0]["high"]
    close: list[tuple[int, int, int]] = []
    for i in range(len(rows) - 1):
        later = slice(i + 1, None)
        fits = (component[later] != component[i]) & (n[later] * den >= n[i] * num) & (n[i] * den >= n[later] * num)
        if across:
            fits &= tile[later] != tile[i]
        at = np.flatnonzero(fits) + i + 1
        distance = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        near = distance * (den + num) <= (n[at] + n[i]) * (den - num)
        close += [(int(d), i, int(j)) for d, j in zip(distance[near], at[near])]
    if how == "possible":
        return [(rows[i]["node"], rows[j]["node"]) for _, i, j in close]
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for _, i, j in sorted(close):
        x, y = find(int(component[i])), find(int(component[j]))
        if x == y:
            continue
        common = int(n[i])
        if how == "sets":
            common = len(np.intersect1d(np.frombuffer(rows[i]["elements"], np.uint64), np.frombuffer(rows[j]["elements"], np.uint64), assume_unique=True))
        if how == "presumed" or common * den >= num * (int(n[i]) + int(n[j]) - common):
            up[max(x, y)] = min(x, y)
            out.append((rows[i]["node"], rows[j]["node"]))
    return out
