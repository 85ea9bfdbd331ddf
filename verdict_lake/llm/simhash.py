"""SimHash near-dedup: fingerprints of word shingles and a tiled exact comparison of the distinct ones.

Equal fingerprints are one node. The nodes are tiled by population counts: two fingerprints that differ in at most r bits
have counts that differ by at most r in all, so all other pairs of tiles are skipped, exactly. Tiles are cut into chunks
of bounded size; pairs of chunks are listed first, without their fingerprints, and dealt by both names, so that a large
tile is many rows; a task compares two chunks by numpy exclusive-or and bit counts.

near_groups links 64-bit fingerprints within a radius. near_dedup asks for a Jaccard similarity of the shingle sets: there
longer fingerprints propose pairs, sets too different in size are not compared, and the sets themselves decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontam import shingle_hashes
from .graph import components
from .rolling import BASE, U, scattered
from .store import BROADCAST_BYTES, drop, packed, python_ready, small_or_not, stored, unpacked

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints in a chunk of a tile, and those of a chunk that are compared with another chunk at once.
CHUNK, STRIP = 8192, 32
#: near_dedup: words of a shingle, the least similarity, and the 64-bit words of a fingerprint. At similarity 0.8 at most
#: 16 % of the bits differ, 10.3 of 64 (deviation 2.9) and 41.2 of 256 (5.9); of sets of 4 and 5 shingles 19 %, 12.0 and
#: 48.0; of unrelated texts half.
WIDTH, LEAST, WORDS = 5, 0.8, 4
#: Most differing bits of the first word and of all words of a proposed pair: of all sets, and of sets of size class
#: SMALL_CLASS or less (5 shingles). By the binomial tails the worst sizes miss 2 pairs in 10,000.
RADII, SMALL_RADII, SMALL_CLASS = (22, 64), (24, 80), 7
#: Population counts in one tile of near_dedup.
BAND = 8
#: Groups among which the partners of one node are dealt when they are verified.
SALTS = 64
#: Shingle hashes of one side of a group that is verified in a task, and values of a matrix there.
BLOCK, CELLS = 200_000, 1 << 22
FLIPS = np.concatenate([np.zeros(1, U), scattered(np.arange(1, WORDS, dtype=U) * U(BASE))])
#: Shingles whose bits are summed at once.
STEP = 1 << 16
TOP = (1 << 63) - 1


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set if it is in over half of the shingles' XXH64."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(width, len(w)) - 1 :].tolist()
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), STEP):
        h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])), dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t or "") for t in texts], dtype="int64")


def counts_of(fp: Column, parts: int, band: int = 1) -> list[Column]:
    """Bands of population counts of the fingerprint's equal parts."""
    bits = 64 // parts
    part = lambda k: F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) if parts > 1 else fp
    return [F.floor(F.bit_count(part(k)) / band).cast("int") for k in range(parts)]


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that join what earlier pairs have not."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def near(a: list[np.ndarray], b: list[np.ndarray], first: int, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in two chunks (one if same) of the pairs that differ in first bits of the first word and radius of all at most."""
    left, right = [], []
    for at in range(0, len(a[0]), STRIP):
        i, j = np.nonzero(np.bitwise_count(a[0][at : at + STRIP, None] ^ b[0][None, :]) <= first)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        if len(a) > 1:
            bits = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, b))
            i, j = i[bits <= radius], j[bits <= radius]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def stars(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a row each in (a, b) in which every node of them occurs: nodes of many partners first, with all that none
    before them has taken."""
    near_to: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        near_to.setdefault(x, []).append(y)
        near_to.setdefault(y, []).append(x)
    out, taken = [], set()
    for x in sorted(near_to, key=lambda n: (-len(near_to[n]), n)):
        if x not in taken:
            mine = [y for y in near_to[x] if y not in taken] or near_to[x][:1]
            taken.update((x, *mine))
            out += [(x, y) for y in mine]
    return out


#: a, b: a pair of nodes. Where a is null: a pair of chunks that has more pairs than were returned; where b is null: a node
#: of one side of that pair of chunks.
PAIR = "a long, b long, side int, tile_a array<int>, chunk_a int, tile array<int>, chunk int"


def compared(words: int, radii: tuple[int, int], small: tuple[int, int] | None, mode: str):
    """Compares pairs of chunks by radii, or by small where a side's size class (the last of its tile) is SMALL_CLASS or less. mode "links": pairs that join what nothing else there does, for links that need no check.
    "some": all pairs if they are few for their nodes, else stars of them and the chunks' names. "nodes": the nodes of
    each side that meet one of another root, with the chunks' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            sides = batch.column("rows_a"), batch.column("rows")
            least = [min(a[-1], b[-1]) for a, b in zip(batch.column("tile_a").to_pylist(), batch.column("tile").to_pylist())]
            for k, same in enumerate(batch.column("same").to_pylist()):
                structs = [side[k].values for side in sides]
                first, radius = small if small and least[k] <= SMALL_CLASS else radii
                i, j = near(*([np.asarray(x.field(f"w{w}")).view(U) for w in range(words)] for x in structs), first, radius, same)
                na, nb = (np.asarray(x.field("node"))[at] for x, at in zip(structs, (i, j)))
                if mode == "links":
                    rows += [(x, y, None, None) for x, y in forest(zip(na.tolist(), nb.tolist()))]
                elif mode == "nodes":
                    ra, rb = (np.asarray(x.field("root"))[at] for x, at in zip(structs, (i, j)))
                    rows += [(x, None, side, k) for side, nodes in enumerate((na, nb)) for x in np.unique(nodes[ra != rb]).tolist()]
                elif len(na) <= 2 * len(np.union1d(na, nb)):
                    rows += [(x, y, None, None) for x, y in zip(na.tolist(), nb.tolist())]
                else:
                    rows += [(x, y, None, None) for x, y in stars(na, nb)]
                    rows.append((None, None, None, k))
            left, right, side, places = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64())))
            names = ["tile_a", "chunk_a", "tile", "chunk"]
            yield pa.RecordBatch.from_arrays([left, right, side, *(batch.column(n).take(places) for n in names)], ["a", "b", "side", *names])
        pa.default_memory_pool().release_unused()

    return run


class Tiles:
    """Nodes (node, w0, w1, ...: words of the fingerprint, distinct each) in tiles cut into chunks of about CHUNK nodes.

    The tile is a list: bands of population counts of the parts of w0, then the column size_class if there is one; of
    classes only neighbours are compared.
    """

    def __init__(self, nodes: DataFrame, words: int, radii: tuple[int, int], parts: int, band: int, small: tuple[int, int] | None = None):
        self.words, self.radii, self.small = words, radii, small
        first = max(radii[0], small[0] if small else 0)
        sized = "size_class" in nodes.columns
        tile = F.array(*counts_of(F.col("w0"), parts, band), *([F.col("size_class").cast("int")] if sized else []))
        keyed = nodes.withColumn("tile", tile)
        # a tile is one of 17^4 lists of counts, or of 9 for each class of sizes: at most 83,521 rows
        sizes = F.broadcast(keyed.groupBy("tile").agg(F.count("*").alias("n")))
        chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)).cast("int")
        self.fields = ["node", *(f"w{k}" for k in range(words))]
        chunked = keyed.join(sizes, "tile").withColumn("chunk", chunk)
        self.tiles = stored(chunked.groupBy("tile", "chunk").agg(F.collect_list(F.struct(*self.fields)).alias("rows")))
        gap = lambda d: max(0, (abs(d) - 1) * band + 1) if d else 0
        reach = next(d for d in itertools.count(1) if gap(d) > first)
        steps = [d for d in itertools.product(range(1 - reach, reach), repeat=parts) if sum(map(gap, d)) <= first]
        steps = [d + c for d in steps for c in (((-1,), (0,), (1,)) if sized else ((),))]
        self.steps = [d for d in steps if d >= (0,) * len(d)]

    def chunk_pairs(self) -> DataFrame:
        """The names of all pairs of chunks to compare, each once."""
        names = stored(self.tiles.select("tile", "chunk"))
        shifts = F.array(*(F.array(*map(F.lit, d)) for d in self.steps))
        moved = names.select(F.col("tile").alias("tile_a"), F.col("chunk").alias("chunk_a"), F.explode(shifts).alias("d"))
        moved = moved.withColumn("tile", F.zip_with("tile_a", "d", lambda x, y: x + y))
        own = F.forall("d", lambda x: x == 0)
        return moved.join(names, "tile").filter(~own | (F.col("chunk_a") <= F.col("chunk"))).select("tile_a", "chunk_a", "tile", "chunk")

    def compare(self, chunk_pairs: DataFrame, mode: str, tiles: DataFrame | None = None) -> DataFrame:
        tiles = self.tiles if tiles is None else tiles
        left = tiles.select(F.col("tile").alias("tile_a"), F.col("chunk").alias("chunk_a"), F.col("rows").alias("rows_a"))
        both = chunk_pairs.join(left, ["tile_a", "chunk_a"]).join(tiles, ["tile", "chunk"])
        both = both.withColumn("same", (F.col("tile_a") == F.col("tile")) & (F.col("chunk_a") == F.col("chunk")))
        return both.mapInArrow(compared(self.words, self.radii, self.small, mode), PAIR)

    def rooted(self, chunk_pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """The tiles of some chunk pairs with the nodes' components (node, component) as roots."""
        wanted = chunk_pairs.select(F.explode(F.array(F.struct(F.col("tile_a").alias("tile"), F.col("chunk_a").alias("chunk")), F.struct("tile", "chunk"))).alias("x")).select("x.*").distinct()
        rows = self.tiles.join(wanted, ["tile", "chunk"]).select("tile", "chunk", F.explode("rows").alias("r")).select("tile", "chunk", *(f"r.{f}" for f in self.fields))
        rows = rows.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
        return stored(rows.groupBy("tile", "chunk").agg(F.collect_list(F.struct(*self.fields, "root")).alias("rows")))


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes: fp, node (distinct each). Returns a, b: enough links for the components of all pairs within radius bits."""
    tiles = Tiles(nodes.withColumnRenamed("fp", "w0"), 1, (radius, radius), 4, 1)
    return tiles.compare(tiles.chunk_pairs(), "links").select("a", "b")


def grouped(docs: DataFrame, radius: int) -> DataFrame:
    """id (doc_id, null as the largest), body (a hash of the text), fp, first (the smallest id of the row's component)
    and root, a name of the component."""
    python_ready(docs.sparkSession)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP))
    prints = stored(docs.select(ids.alias("id"), F.xxhash64("text").alias("body"), simhash_of("text").alias("fp")))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(stored(near_links(nodes.select("fp", F.col("fp").alias("node")), radius)))
    rooted = stored(nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return prints.join(rooted.join(firsts, "root").select("fp", "root", "first"), "fp")


def near_groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id: a row for each row of docs.

    A null text is empty; empty texts have fingerprint 0 and are linked. A null doc_id counts as the largest: it names a
    component only where no other id is in it, and then the component_id is null. Repeated rows share a component. Of a
    text of any length all shingles count.
    """
    shown = lambda c: F.nullif(F.col(c), F.lit(TOP))
    return grouped(docs, radius).select(shown("id").alias("doc_id"), "fp", shown("first").alias("component_id"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; ASCII letters count as lower-case, a short text is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    parts = [h for h, _, _ in shingle_hashes(b" ".join(w), min(width, len(w)))] if w else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=U)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS signed 64-bit words of the SimHash of a set of shingle hashes; a bit is set if it is in over half of them."""
    total = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(shingles), STEP // WORDS):
        words = shingles[at : at + STEP // WORDS, None] ^ FLIPS
        words[:, 1:] = scattered(words[:, 1:])
        total += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(shingles), bitorder="little").view(np.int64)


def signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            nodes = np.fromiter((s.sum(dtype=U) for s in sets), dtype=U, count=len(sets))
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            words = np.array([fingerprint(s) for s in sets], dtype=np.int64).reshape(len(sets), WORDS)
            columns = [scattered(nodes + sizes.astype(U)).view(np.int64), sizes, *(np.ascontiguousarray(words[:, k]) for k in range(WORDS))]
            names = ["node", "size", *(f"w{k}" for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *map(pa.array, columns)], ["id", "body", *names])

    return run


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in two lists of sets of the pairs of that Jaccard similarity, both sets not empty."""
    sizes = [np.array(list(map(len, x)), dtype=np.int64) for x in (a, b)]
    _, which, counts = np.unique(np.concatenate([np.zeros(0, U), *a, *b]), return_inverse=True, return_counts=True)
    # only what several sets hold can be shared
    column = np.cumsum(counts > 1) - 1
    keep = counts[which] > 1
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))[keep]
    column = column[which[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(a), len(b)), dtype=np.float32)
    width = max(1, CELLS // (len(a) + len(b)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        held = np.zeros((len(a) + len(b), width), dtype=np.float32)
        held[owner[part], column[part] - at] = 1
        shared += held[: len(a)] @ held[len(a) :].T
    return np.nonzero((shared > 0) & (shared >= least * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-3))


def links_in_groups(least: float):
    """a, b: enough links for the components of all similar pairs between the sides of each group of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for members in batch.column("members"):
                rows = members.values
                side, nodes = np.asarray(rows.field("side")), np.asarray(rows.field("node"))
                sets = [x.values.to_numpy().view(U) for x in rows.field("shingles")]
                left, right = ([int(k) for k in np.flatnonzero(side == x)] for x in (0, 1))
                i, j = similar([sets[k] for k in left], [sets[k] for k in right], least)
                na, nb = nodes[left][i], nodes[right][j]
                found += forest(zip(na[na != nb].tolist(), nb[na != nb].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        pa.default_memory_pool().release_unused()

    return run


def with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("groups"), shingles], ["node", "groups", "shingles"])

    return run


def verified(groups: DataFrame, owners: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) of the similar pairs between the sides of each group. groups: key, side (0 or 1), node; distinct rows.
    owners: node, size and (id, body), a row of texts. A set is made where its text is, and sent once to each group."""
    sized = stored(groups.join(owners, "node"))
    # groups whose sets are too many for one task are cut on both sides, and all pairs of parts are compared
    totals = sized.groupBy("key").agg(*(F.ceil(F.sum(F.when(F.col("side") == k, F.col("size"))) / BLOCK).alias(f"parts{k}") for k in (0, 1)))
    dealt = sized.join(totals.select("key", *(F.greatest(F.coalesce(f"parts{k}", F.lit(1)), F.lit(1)).alias(f"parts{k}") for k in (0, 1))), "key")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1)
    split = dealt.select("node", "id", "body", "key", "side", own.alias("own"), F.explode(others).alias("other"))
    first, second = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("other")) for k in (0, 1))
    wanted = split.select("node", "id", "body", F.struct("key", first.alias("first"), second.alias("second"), "side").alias("group"))
    wanted = stored(wanted.groupBy("node", "id", "body").agg(F.collect_list("group").alias("groups")))
    small = wanted.count() * 100 <= BROADCAST_BYTES and sized.count() * 40 <= BROADCAST_BYTES
    found = texts.join(F.broadcast(wanted) if small else wanted, ["id", "body"]).select("node", "groups", "text")
    sets = found.mapInArrow(with_sets(width), "node long, groups array<struct<key:bigint,first:bigint,second:bigint,side:int>>, shingles array<long>")
    members = sets.select("node", "shingles", F.explode("groups").alias("g"))
    grouped = members.groupBy("g.key", "g.first", "g.second").agg(F.collect_list(F.struct("g.side", "node", "shingles")).alias("members"))
    return stored(grouped.select("members").mapInArrow(links_in_groups(least), "a long, b long"))


def once_each(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """texts with one row for each id and body; only repeated ones are shuffled."""
    repeats = stored(prints.groupBy("id", "body").agg(F.count("*").alias("n")).filter("n > 1").select("id", "body"))
    if repeats.isEmpty():
        return texts
    keys = small_or_not(repeats)
    many = texts.join(keys, ["id", "body"], "left_semi").groupBy("id", "body").agg(F.any_value("text").alias("text"))
    return texts.join(keys, ["id", "body"], "left_anti").unionByName(many)


def similar_groups(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """id (doc_id, null as the largest), body (a hash of the text), first (the smallest id of the row's component)
    and root, a name of the component; links are pairs of texts whose shingle sets have the Jaccard similarity least."""
    python_ready(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)).alias("id"), F.xxhash64("text").alias("body"), "text")
    words = ", ".join(f"w{k} long" for k in range(WORDS))
    prints = stored(texts.mapInArrow(signed(width), f"id long, body long, node long, size long, {words}"))
    # a set's node is named by the sum of its hashes and its size
    nodes = stored(prints.groupBy("node").agg(F.min("size").alias("size"), F.min(F.struct("id", "body")).alias("own"), *(F.min(f"w{k}").alias(f"w{k}") for k in range(WORDS))))
    # sets of this similarity are in the same class of sizes or in neighbouring ones
    size_class = F.when(F.col("size") > 0, F.floor(F.ln("size") / F.ln(F.lit(1 / least)) + 1e-9)).otherwise(-2)
    tiles = Tiles(nodes.withColumn("size_class", size_class), WORDS, RADII, 1, BAND, SMALL_RADII)
    owners, single = nodes.select("node", "size", "own.*"), once_each(texts, prints)
    met = stored(tiles.compare(tiles.chunk_pairs(), "some"))
    pairs = met.filter("b is not null").withColumn("key", F.xxhash64("a", F.pmod("b", F.lit(SALTS))))
    both = pairs.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("x"))
    links = verified(both.select("key", "x.*").distinct(), owners, single, width, least)
    joined = stored(components(links))
    dense = met.filter("a is null").select("tile_a", "chunk_a", "tile", "chunk")
    if not dense.isEmpty():
        # what the stars' links have not joined there is compared in full, by tasks that return links alone
        apart = tiles.compare(dense, "nodes", tiles.rooted(dense, joined))
        rows = stored(apart.select(F.xxhash64("tile_a", "chunk_a", "tile", "chunk").alias("key"), "side", F.col("a").alias("node")))
        if not rows.isEmpty():
            joined = stored(components(links.unionByName(verified(rows, owners, single, width, least))))
    rooted = stored(prints.select("id", "body", "node").join(small_or_not(joined), "node", "left").select("id", "body", F.coalesce("component", "node").alias("root")))
    drop(prints)
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("first")), "root")


def near_dedup(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies: one of the smallest doc_id; of several texts under it, one; of
    repeats, one.

    Two texts are near copies if the Jaccard similarity of their sets of shingles of width words is least or more; a group
    is all that links reach, so a chain may join texts that are less similar. Empty and null texts are one group. A
    null doc_id counts as the largest. Texts of any length are compared by all their shingles. A pair is missed only if its
    fingerprints differ far more than its sets.
    """
    return first_rows(docs, similar_groups(docs, width, least))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that near_dedup keeps of groups (id, body, root, first)."""
    own = groups.filter("id = first").groupBy("root", "id", "body").agg(F.count("*").alias("n"))
    keep = stored(own.groupBy("root", "id").agg(F.min(F.struct("body", "n")).alias("x")).select(F.col("id").alias("_id"), F.col("x.body").alias("_body"), F.col("x.n").alias("_n")))
    rows = packed(docs, "doc_id", "text")
    kept = rows.join(small_or_not(keep), (F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)) == F.col("_id")) & (F.xxhash64("text") == F.col("_body")))
    once = unpacked(kept.filter("_n = 1"), docs, "doc_id", "text")
    if keep.filter("_n > 1").isEmpty():
        return once
    repeated = kept.filter("_n > 1").dropDuplicates(["doc_id", "text"])
    return once.unionByName(unpacked(repeated, docs, "doc_id", "text"))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
