"""N-gram Jaccard self join: size-banded tiles, hashed bitmap signatures, exact intersection.

Documents become sets of hashed word n-grams. Equal sets are one node. The hash space is cut
into parts, more than two sets of a size band can differ in while they still pass the
threshold; so two such sets agree on at least one part, whole. A tile is the sets of a band
(and of the edge of the band below) that agree on a part. Unlike a prefix of frequent
n-grams, a passage that many documents share makes no large tiles, for each of its parts
also holds the rest of the document.

Parity bitmaps bound the overlap of a tile's sets from above (each differing bit is an
element in one set only). Sets that sizes and bitmaps let pass fall into one candidate class;
within a task, what earlier tiles have put into one class isn't compared again. Only each
set's class leaves a tile, never its pairs. The candidate classes, joined over all tiles, hold
both ends of every link. Inside a class, sets meet in blocks of bounded size, where exact
overlaps are counted as products of membership matrices: a block gives each set's number of
links and its component in the block, so that all links are found and counted, each pair of
sets being in exactly one block, and rows leave in proportion to the sets that came in.

Node ids are 64-bit hashes of the sorted sets.

Defined cases: null and empty texts have empty sets and are linked with nothing; a text of
fewer words than n is one n-gram; repeated rows are linked (equal sets); a null key stands
for itself and never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, lower_words_of, mix, parts_of, staged, texts_of, window_hashes
from .graphs import components
from .members import bitmap, holds


def band_of(n: int) -> int:
    """Band b holds sizes in (2^b, 2^(b+1)]; sets of one n-gram are in band -1."""
    return max(n - 1, 0).bit_length() - 1


def most_apart(n: int, num: int, den: int) -> int:
    """Greatest symmetric difference of a set of ``n`` and any set that reaches the threshold num/den with it."""
    # the other has at most n * den / num elements, and then holds all n
    return n * (den - num) // num


def tile_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles of a set (its sorted distinct hashes).

    In each of its bands the set gives the first ``most_apart + 1`` parts that aren't empty.
    Of two sets that pass, take the one whose run of parts ends first: at most ``most_apart``
    of its parts differ, so one that isn't empty agrees, and the other one's run holds it too.
    A set with fewer parts than that gives its empty ones as well.
    """
    n = len(s)
    apart = most_apart(n, num, den)
    if not apart:
        return np.zeros(0, np.int64)
    b = band_of(n)
    out = []
    for band in (b, b + 1):
        least = (1 << band) + 1
        if band > b and n * den < num * least:
            continue
        parts = math.ceil(most_apart(1 << (band + 1), num, den) * 1.12) + 4
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        start = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        content = np.add.reduceat(mix(s), start)
        which = part[start]
        if len(start) <= apart:
            full = np.arange(parts, dtype=np.uint64)
            value = np.zeros(parts, np.uint64)
            value[which.astype(np.int64)] = content
            which, content = full, value
        else:
            which, content = which[: apart + 1], content[: apart + 1]
        out.append(mix(content ^ mix(which + np.uint64(band << 40))))
    return np.concatenate(out).view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap: bit ``h mod size`` flips with each element; the size is a power of two, twice to four times the set's, 256 at least.

    With fewer bits than elements the bitmaps of unrelated sets differ in hardly more places than
    a threshold of 0.8 allows, and the bound would tell nothing.
    """
    bits = max(256, 2 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """Lower bound of two sets' symmetric difference: the larger bitmap is folded to the smaller one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shingle_set(text: str | None, k: int, words: WordHash) -> np.ndarray:
    return np.unique(window_hashes(words.array(lower_words_of(text)), k))


def set_id(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _shingled(df: DataFrame, key: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """One row per document; signature and tile keys only with the first of equal sets in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHash(), set()
        for b in parts_of(batches):
            n, ids, sigs, keys = [], [], [], []
            for t in texts_of(b.column(1)):
                s = shingle_set(t, k, words)
                i = set_id(s)
                n.append(len(s))
                ids.append(i)
                new = len(s) > 0 and i not in seen
                sigs.append(signature(s) if new else None)
                keys.append(tile_keys(s, num, den) if new else None)
                if len(seen) < 2_000_000:
                    seen.add(i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["key", "n", "sid", "sig", "keys"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, n bigint, sid bigint, sig binary, keys array<bigint>")


def _arrays(df: DataFrame, text: str, k: int, wanted: np.ndarray) -> DataFrame:
    """(sid, arr) of the sets in ``wanted``, once for each task that meets one."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHash(), set()
        for b in parts_of(batches):
            ids, arrays = [], []
            for t in texts_of(b.column(0)):
                s = shingle_set(t, k, words)
                i = set_id(s)
                if len(s) and i not in seen and holds(shared.value, np.array([i]))[0]:
                    ids.append(i)
                    arrays.append(s.tobytes())
                    if len(seen) < 2_000_000:
                        seen.add(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(arrays, pa.binary())], ["sid", "arr"])

    return df.select(F.col(text).alias("text")).mapInArrow(work, "sid bigint, arr binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of sorted rows, and the groups' borders; the first ``keys`` columns tell groups apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        key = np.column_stack([table[c].to_numpy() for c in range(keys)])
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield table.slice(0, last), [0, *cuts.tolist()]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, [0, len(table)]


class Classes:
    """Union-find over ids; the least id stands for a class."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def candidate_links(n: np.ndarray, bits: np.ndarray, group: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between places that join all members which sizes and bitmaps let pass; members of one ``group`` are joined already."""
    todo = np.ones(len(n), bool)
    for r in range(len(n)):
        if not todo[r]:
            continue
        front = np.flatnonzero(todo & (group == group[r])).tolist()
        todo[front] = False
        while front:
            q = front.pop()
            at = np.flatnonzero(todo)
            at = at[np.minimum(n[at], n[q]) * 100 >= percent * np.maximum(n[at], n[q])]
            # overlap <= (n + n - differing bits) / 2, and the threshold asks 100 * overlap >= percent * (n + n - overlap)
            bound = (n[q] + n[at] - np.bitwise_count(bits[at] ^ bits[q]).sum(axis=1, dtype=np.int64)) // 2
            at = at[100 * bound >= percent * (n[q] + n[at] - bound)]
            if len(at):
                yield from ((q, int(x)) for x in at)
                new = np.flatnonzero(todo & np.isin(group, group[at]))
                todo[new] = False
                front += new.tolist()


def _candidates(members: DataFrame, percent: int, most: int = 1_000_000) -> DataFrame:
    """Edges (a, b) that connect all sets of each candidate class: at most one for each set that a task meets.

    ``members`` are (tile, blocks, sid, n, sig). A tile's members are dealt to ``blocks`` by hash, and
    each two blocks meet in one cell.
    """
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    cell = members.withColumn("own", own).withColumn("other", F.explode(other))
    cell = cell.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n", "sig")
    cell = cell.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "sid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()

        def out() -> pa.RecordBatch:
            nodes = list(classes.up)
            got = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([classes.of(x) for x in nodes], pa.int64())], ["a", "b"])
            classes.up.clear()
            return got

        for table, cuts in _grouped(batches, 3):
            sids, n, sigs = table["sid"].to_pylist(), table["n"].to_numpy(), table["sig"].combine_chunks()
            for s, e in pairwise(cuts):
                roots = [classes.of(x) for x in sids[s:e]]
                if len(set(roots)) == 1:
                    continue
                if e - s == 2:  # most tiles
                    both = (n[s] + n[s + 1] - apart_at_least(sigs[s].as_py(), sigs[s + 1].as_py())) // 2
                    if 100 * both >= percent * (n[s] + n[s + 1] - both):
                        classes.join(sids[s], sids[s + 1])
                    continue
                raw = [np.frombuffer(sigs[x].as_py(), np.uint8) for x in range(s, e)]
                least = min(map(len, raw))
                bits = np.empty((e - s, least), np.uint8)
                for r, y in enumerate(raw):
                    while len(y) > least:
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                    bits[r] = y
                for x, y in candidate_links(n[s:e], bits.view(np.uint64), np.array(roots, np.int64), percent):
                    classes.join(sids[s + x], sids[s + y])
            if len(classes.up) > most:
                yield out()
        yield out()

    return cell.mapInArrow(work, "a bigint, b bigint").where("a <> b")


def jaccard_components(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, block: int = 2048, with_links: bool = True) -> DataFrame:
    """Return (key, n_shingles, component_id, n_links): n_links counts the other rows that the row is linked with, equal sets included."""
    docs = staged(_shingled(df, key, text, k, percent, 100), "sets")
    meta = docs.where(F.col("sig").isNotNull()).groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    spread = docs.where(F.size("keys") > 0).select(F.explode("keys").alias("tile"), "sid")
    tiles = spread.groupBy("tile").agg(F.min("sid").alias("least"), F.max("sid").alias("last"), F.count("*").alias("members")).where("least < last")
    tiles = staged(tiles.select("tile", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "tiles")
    wanted = df.sparkSession.sparkContext.broadcast(bitmap(tiles, "tile"))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy()
            hit = holds(wanted.value, flat)
            sid = np.repeat(b.column(0).to_numpy(), lengths.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), pa.array(sid[hit])], ["tile", "sid"])

    held = docs.where(F.size("keys") > 0).select("sid", "keys").mapInArrow(shared_only, "tile bigint, sid bigint")
    inside = held.join(tiles, "tile").distinct()
    edges = staged(_candidates(inside.join(meta, "sid"), percent), "candidates")
    classes = staged(components(edges), "candidate-classes")
    found = staged(_linked_in_classes(docs, classes, _arrays(df, text, k, bitmap(classes, "node")), percent), "links")
    comps = staged(components(found.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))), "components")
    out = _labelled(docs, comps, key, found.groupBy("sid").agg(F.sum("n_links").alias("n_links")) if with_links else None)
    return out if with_links else out.drop("n_links")


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int, step: int = 2048) -> np.ndarray:
    """Matrix of which sets of ``a`` and ``b`` pass; columns of the membership matrices are taken ``step`` at a time."""
    sizes = np.array([len(x) for x in [*a, *b]], np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    values, col, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    # an element of one set only adds to no overlap
    keep = times > 1
    rows, col = rows[keep[col]], (np.cumsum(keep) - 1)[col[keep[col]]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(keep.sum()), step):
        lo, hi = np.searchsorted(col, [at, at + step])
        m = np.zeros((len(sizes), step), np.float32)
        m[rows[lo:hi], col[lo:hi] - at] = 1
        both += m[: len(a)] @ m[len(a) :].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[: len(a), None] + sizes[None, len(a) :] - both)


def first_of_component(ok: np.ndarray) -> np.ndarray:
    """For each place the first place of its component in a symmetric matrix of links."""
    first = np.full(len(ok), -1)
    for r in range(len(ok)):
        if first[r] >= 0:
            continue
        first[r], front = r, [r]
        while front:
            new = np.flatnonzero(ok[front.pop()] & (first < 0))
            first[new] = r
            front += new.tolist()
    return first


def _linked_in_classes(docs: DataFrame, classes: DataFrame, arrays: DataFrame, percent: int, block: int = 1024, elements: int = 500_000) -> DataFrame:
    """(sid, n_links, root): for each set and block, the rows with another set that it passes with, and its component's first set.

    A class's sets are dealt to blocks bounded in sets and elements, and each two blocks meet
    in one cell; the pairs inside a block are compared where it meets itself.
    """
    arrays = staged(arrays.groupBy("sid").agg(F.first("arr").alias("arr")), "arrays")
    copies = docs.where("n > 0").groupBy("sid").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    of = staged(classes.select(F.col("node").alias("sid"), "comp").join(copies, "sid"), "classes")
    blocks = of.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / elements)).cast("int").alias("blocks"))
    cell = of.select("sid", "comp", "copies").join(blocks, "comp").join(arrays, "sid").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = cell.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "copies", "arr")
    cell = cell.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sid, own, copies = (g[c].to_numpy() for c in ("sid", "own", "copies"))
            sets = [np.frombuffer(x, np.uint64) for x in g["arr"].to_pylist()]
            m = int((own == g["i"][0].as_py()).sum())
            if m == len(sid):
                ok = linked(sets, sets, percent)
                np.fill_diagonal(ok, False)
            else:
                ok = np.zeros((len(sid), len(sid)), bool)
                ok[:m, m:] = linked(sets[:m], sets[m:], percent)
                ok[m:, :m] = ok[:m, m:].T
            return sid, ok @ copies, sid[first_of_component(ok)]

        for table, cuts in _grouped(batches, 3):
            for s, e in pairwise(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)) for z in compare(table.slice(s, e - s))], ["sid", "n_links", "root"])

    return cell.mapInArrow(work, "sid bigint, n_links bigint, root bigint").where("n_links > 0")


def _labelled(docs: DataFrame, comps: DataFrame, key: str, degree: DataFrame | None) -> DataFrame:
    """``degree`` counts links between sets; rows of equal sets are added here."""
    sets = docs.where("n > 0").groupBy("sid").agg(F.min("key").alias("least"), (F.count("*") - 1).alias("equal")).join(comps.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    names = sets.groupBy("comp").agg(F.min("least").alias("component_id"))
    if degree is None:
        degree = comps.select(F.col("node").alias("sid"), F.lit(0).cast("bigint").alias("n_links"))
    of = staged(sets.join(names, "comp").join(degree, "sid", "left").select("sid", "component_id", (F.col("equal") + F.coalesce("n_links", F.lit(0))).alias("n_links")), "classes")
    out = docs.select("key", "n", "sid").join(of, "sid", "left")
    own = F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.coalesce("component_id", "key")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
