"""SentencePiece encoding and decoding as a relational lattice.

Text turns into units: blanks become the blank mark, and a text is cut wherever no piece can
span the place (found from hashed bitmaps of the pieces and of their four-character runs, so
that a cut is always exact). Distinct units are exploded to substrings of bounded length, those
that can't be pieces left out by the same bitmaps, and equi-joined to the piece table; the edges
found are grouped by unit and folded with Spark's higher-order ``aggregate``. For a unigram
model the fold is Viterbi's: best score of a path to each place. The scores of a merge (BPE)
model are merge priorities, whose best path is not the model's encoding; for it the fold takes
the edges by priority and merges where an edge spans exactly two current symbols, over a bitmap
of borders. Characters that no edge covers are their own pieces, or byte pieces.

The most frequent units (``head`` of them, a bounded table) are encoded first and broadcast; a
document is spelt with them, and the lattice of its rarer units is made next to it, so that after
the count of units no text and no id is shuffled.

Defined cases: a null or empty text has no pieces; repeated rows encode alike, each with its
own row; a unit of more than ``LONG`` characters doesn't fit the bitmap and is encoded whole in
Python, by the same merges or path; very long texts are cut in blocks, which end at exact cuts.
A text that holds the blank mark itself decodes to blanks in its place.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_of, release, staged, texts_of

MARK = "▁"
LONG = 61
#: Bits of a place in the bitmaps: of pieces of two and three characters, of longer ones, of runs inside them.
BITS, LONG_BITS, RUN_BITS = 22, 20, 24
BLOCK = 1 << 16
_TURN = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x85EBCA77)
_BASE = 0xD6E8FEB86659FD93
UNKNOWN = -100.0


def _slots(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return ((h * _TURN) >> np.uint32(32 - bits)).astype(np.int64)


def _rolled(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of character numbers."""
    h = codes[:, 0]
    for n in range(1, codes.shape[1]):
        h = h * _STEP + codes[:, n]
    return h


@dataclass(frozen=True)
class PieceModel:
    """Normal pieces (text, id, score), the id of byte piece 0 and the texts of all ids; ``kind`` is ``bpe`` or ``unigram``."""

    rows: tuple[tuple[str, int, float], ...]
    byte0: int
    kind: str = "bpe"

    @functools.cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @functools.cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.rows}

    @functools.cached_property
    def number(self) -> np.ndarray:
        """Number of each character that pieces have; 0 for all others."""
        chars = sorted({ord(c) for p, _, _ in self.rows for c in p})
        out = np.zeros(0x110000, np.uint32)
        out[chars] = np.arange(1, len(chars) + 1)
        return out

    def _hashes(self, text: str) -> np.ndarray:
        return self.number.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    @functools.cached_property
    def bitmaps(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashed bitmaps of the pieces of each length, and of the runs of four characters inside longer ones."""
        whole, runs = [np.zeros(1 << (BITS if n < 4 else LONG_BITS), bool) for n in range(self.longest + 1)], np.zeros(1 << RUN_BITS, bool)
        for n in range(1, self.longest + 1):
            if same := [p for p, _, _ in self.rows if len(p) == n]:
                c = self._hashes("".join(same)).reshape(-1, n)
                whole[n][_slots(_rolled(c), BITS if n < 4 else LONG_BITS)] = True
                for s in range(n - 3):
                    runs[_slots(_rolled(c[:, s : s + 4]), RUN_BITS)] = True
        return whole, runs

    def units(self, text: str | None) -> list[str]:
        """Parts of a text that no piece spans the borders of."""
        if not text:
            return []
        marked = (MARK + text).replace(" ", MARK)
        places = self.cuts(marked).tolist()
        return list(map(marked.__getitem__, map(slice, places, places[1:])))

    def cuts(self, marked: str) -> np.ndarray:
        """Places of a marked text that no piece spans, its ends among them."""
        codes, (whole, runs) = self._hashes(marked), self.bitmaps
        two = whole[2] if self.longest > 1 else np.zeros(1 << BITS, bool)
        three = whole[3] if self.longest > 2 else np.zeros(1 << BITS, bool)
        out = [np.zeros(1, np.int64)]
        start, size = 0, BLOCK
        while start < len(codes):
            c = codes[start : start + size]
            last, n = start + size >= len(codes), len(c)
            cross = np.zeros(n + 1, bool)
            h = c[:-1] * _STEP + c[1:]
            hit = two.take(_slots(h))
            cross[1:n] |= hit
            if n > 2:
                h = h[:-1] * _STEP + c[2:]
                hit = three.take(_slots(h))
                cross[1 : n - 1] |= hit
                cross[2:n] |= hit
            if n > 3:
                h = h[:-1] * _STEP + c[3:]
                hit = runs.take(_slots(h, RUN_BITS))
                cross[1 : n - 2] |= hit
                cross[2 : n - 1] |= hit
                cross[3:n] |= hit
            cuts = np.flatnonzero(~cross)
            if not last:  # what follows the block can span its last places
                cuts = cuts[cuts < n - 4]
                if len(cuts) < 2:
                    size *= 2
                    continue
            out.append(cuts[1:] + start)
            start, size = start + int(cuts[-1]), BLOCK
        return np.concatenate(out)

    def spans(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, start, length) of the substrings that can be pieces of two characters and more (of one, too, in a unigram model)."""
        codes = self._hashes("".join(units))
        length = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), length)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        room = np.repeat(length, length) - place
        at, size, h = [], [], codes
        if self.kind == "unigram":
            at.append(np.arange(len(codes)))
            size.append(np.ones(len(codes), np.int64))
        for n in range(2, self.longest + 1):
            h = h[:-1] * _STEP + codes[n - 1 :]
            if not len(h):
                break
            hit = np.flatnonzero((room[: len(h)] >= n) & self.bitmaps[0][n].take(_slots(h, BITS if n < 4 else LONG_BITS)))
            at.append(hit)
            size.append(np.full(len(hit), n))
        packed = np.sort((np.concatenate(at) << 8) | np.concatenate(size)) if at else np.zeros(0, np.int64)
        at, size = packed >> 8, packed & 255
        return owner[at], place[at], size

    def single(self, char: str) -> list[int]:
        got = self.table.get(char)
        return [got[0]] if got else [self.byte0 + b for b in char.encode("utf-8", "surrogatepass")]

    def whole_ids(self, unit: str) -> list[int]:
        """Ids of a unit too long for the bitmap."""
        parts = _merged(unit, self.table) if self.kind == "bpe" else _best_path(unit, self.table, self.longest)
        return [i for p in parts for i in ([self.table[p][0]] if p in self.table else self.single(p))]

    @functools.cached_property
    def ranks(self) -> dict[float, int]:
        """Place of each score, the greatest first."""
        return {s: r for r, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}

    @functools.cached_property
    def scores(self) -> np.ndarray:
        """Score by rank; a last one for characters without a piece."""
        return np.array([*self.ranks, UNKNOWN])

    @functools.cached_property
    def width(self) -> str:
        """Type of the numbers that ids travel as."""
        return "<u2" if max(max((i for _, i, _ in self.rows), default=0), self.byte0 + 255) < 1 << 16 else "<u4"

    def spelt(self, units: list[str], masks: np.ndarray) -> list[bytes]:
        """Each unit's ids as little-endian numbers of :attr:`width`, from the bitmap of its borders; 0 for a unit too long."""
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner, place = np.nonzero(bits)
        length = np.fromiter(map(len, units), np.int64, len(units))
        at = (np.cumsum(length) - length)[owner] + place
        inside = owner[1:] == owner[:-1]
        whole = "".join(units)
        parts = [whole[a:b] for a, b in zip(at[:-1][inside].tolist(), at[1:][inside].tolist(), strict=True)]
        pieces = self.pieces
        ids = np.fromiter((pieces.get(p, -1) for p in parts), np.int64, len(parts))
        owner = owner[1:][inside]
        if len(odd := np.flatnonzero(ids < 0)):
            said = [parts[i].encode("utf-8", "surrogatepass") for i in odd.tolist()]
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(x) for x in said]
            ids, owner, spread = np.repeat(ids, count), np.repeat(owner, count), np.repeat(ids < 0, count)
            ids[spread] = np.frombuffer(b"".join(said), np.uint8).astype(np.int64) + self.byte0
        data = ids.astype(self.width).tobytes()
        step = np.dtype(self.width).itemsize
        cuts = (np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))]) * step).tolist()
        return [data[a:b] if m else np.array(self.whole_ids(u), self.width).tobytes() for a, b, m, u in zip(cuts[:-1], cuts[1:], masks.tolist(), units, strict=True)]

    @functools.cached_property
    def pieces(self) -> dict[str, int]:
        return {p: i for p, i, _ in self.rows}

    @functools.cached_property
    def sounds(self) -> list[bytes]:
        """UTF-8 of each id, marks as blanks."""
        out = [b""] * (max([self.byte0 + 255, *(i for _, i, _ in self.rows)]) + 1)
        out[self.byte0 : self.byte0 + 256] = [bytes([b]) for b in range(256)]
        for p, i, _ in self.rows:
            out[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that the ids spell."""
        return b"".join(map(self.sounds.__getitem__, ids))[1:]


@functools.cache
def load(path: str, kind: str = "bpe") -> PieceModel:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return PieceModel(tuple(rows), m.piece_to_id("<0x00>"), kind)


def _merged(word: str, table: dict[str, tuple[int, float]]) -> list[str]:
    """Symbols of a word after all merges, best priority first, then leftmost."""
    at, after, before = list(word), [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (got := table.get(at[i] + at[j])):
            heapq.heappush(heap, (-got[1], i, len(at[i]), len(at[j])))

    for i in range(len(word) - 1):
        offer(i, i + 1)
    while heap:
        _, i, n, m = heapq.heappop(heap)
        j = after[i]
        if len(at[i]) != n or j < 0 or len(at[j]) != m:
            continue
        at[i], at[j], after[i] = at[i] + at[j], "", after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [x for x in at if x]


def _best_path(word: str, table: dict[str, tuple[int, float]], longest: int) -> list[str]:
    """Symbols of the path of greatest score; a character without a piece counts ``UNKNOWN``."""
    best, back = [0.0], [0]
    for e in range(1, len(word) + 1):
        ways = [(best[s] + (table[p][1] if (p := word[s:e]) in table else UNKNOWN), s) for s in range(max(0, e - longest), e) if s == e - 1 or word[s:e] in table]
        score, start = max(ways)
        best.append(score)
        back.append(start)
    out, e = [], len(word)
    while e:
        out.append(word[back[e] : e])
        e = back[e]
    return out[::-1]


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _unit_hashes(marked: str, cuts: np.ndarray) -> np.ndarray:
    """Hash of each unit between two cuts; the same wherever it stands, unless it crosses a block's end."""
    points, (up, down) = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32), _powers()
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * (up[: len(points)] if len(points) <= BLOCK else np.resize(up, len(points))), out=total[1:])
    at = total[cuts]
    return (at[1:] - at[:-1]) * down[cuts[:-1] & (BLOCK - 1)]


def count_units(df: DataFrame, text: str, model: PieceModel, most: int = 120_000) -> DataFrame:
    """(unit, c): distinct units and how often they come, summed in the task first.

    Within a task units are told apart by 64-bit hashes. The counts only choose which units are
    encoded ahead, so two units of one hash could move that choice, never an encoding.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, count, names = shared.value, {}, []
        held: list[tuple[str, np.ndarray, np.ndarray]] = []

        def add() -> None:
            if not held:
                return
            hashes, first, n = np.unique(np.concatenate([h for _, _, h in held]), return_index=True, return_counts=True)
            ends = np.cumsum([len(h) for _, _, h in held])
            of = np.searchsorted(ends, first, "right")
            place = first - np.concatenate([[0], ends])[of]
            for h, c, o, k in zip(hashes.tolist(), n.tolist(), of.tolist(), place.tolist(), strict=True):
                if h in count:
                    count[h] += c
                else:
                    count[h] = c
                    marked, cuts, _ = held[o]
                    names.append(marked[cuts[k] : cuts[k + 1]])
            held.clear()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(count.values()), pa.int64())], ["unit", "c"])
            count.clear()
            names.clear()
            release()
            return got

        size = 0
        for b in batches:
            for t in texts_of(b.column(0)):
                if not t:
                    continue
                marked = (MARK + t).replace(" ", MARK)
                cuts = m.cuts(marked)
                held.append((marked, cuts, _unit_hashes(marked, cuts)))
                size += len(marked)
                if size >= 1 << 20:
                    add()
                    size = 0
                    if len(count) > most:
                        yield out()
        add()
        yield out()

    return df.select(F.col(text).alias("_m_text")).mapInArrow(work, "unit string, c bigint").groupBy("unit").agg(F.sum("c").alias("c"))


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    return spark.createDataFrame([(p, i, model.ranks[s]) for p, i, s in model.rows], "piece string, id int, rank int")


def _spans(model: PieceModel, units: list[str]) -> pa.ListArray:
    """For each unit 0, which opens its list, and the spans (start * 256 + length) that can be pieces."""
    owner, start, size = model.spans([u if len(u) <= LONG else "" for u in units])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))])
    packed = np.insert(start * 256 + size, cuts[:-1], 0)
    return pa.ListArray.from_arrays(pa.array((cuts + np.arange(len(cuts))).astype(np.int32)), pa.array(packed.astype(np.int32)))


def lattice(rows: DataFrame, model: PieceModel, keep: str, kind: str) -> DataFrame:
    """(keep, load, unit, edges) from rows (keep, load, unit, spans), in their order; a unit too long for the bitmap has no edges.

    Edges of a merge model are the bitmaps of their two ends, best priority first, then leftmost;
    of a unigram model (start, length, score). The piece table (as large as the vocabulary, which
    the model fixes) is broadcast, so a unit's rows stay next to each other and are grouped as they
    come; a row with the unit itself and its binary ``load`` opens each group.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = rows.select(keep, "load", "unit", F.explode("spans").alias("e")).select(keep, "load", "unit", "e", F.expr("substring(unit, shiftright(e, 8) + 1, e & 255)").alias("piece"))
    joined = rows.join(F.broadcast(piece_table(spark, model)), "piece", "left").where("e = 0 or rank is not null or (e & 255) = 1")
    first = F.col("e") == 0
    # empty and not null: batches with null strings take far longer to make
    joined = joined.select(keep, F.when(first, F.col("load")).otherwise(F.lit("").cast("binary")).alias("load"), F.when(first, F.col("unit")).otherwise("").alias("unit"), "e", F.coalesce("rank", F.lit(-1)).alias("rank"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(t: pa.Table) -> pa.RecordBatch:
            e = t["e"].to_numpy().astype(np.int64)
            opens = e == 0
            owner = np.cumsum(opens) - 1
            heads = t.filter(pa.array(opens)).combine_chunks()
            owner, e, rank = owner[~opens], e[~opens], t["rank"].to_numpy()[~opens].astype(np.int64)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(heads)))]).astype(np.int32))
            if m.kind == "unigram":
                fields = {"s": (e >> 8).astype(np.int32), "n": (e & 255).astype(np.int32), "score": m.scores[rank]}
                edges = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))
            else:
                e = np.sort((owner << 38) | (rank << 14) | e) & 0x3FFF
                low = np.int64(1) << (e >> 8)
                edges = pa.array(low | (low << (e & 255)))
            return pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() for c in (keep, "load", "unit")), pa.ListArray.from_arrays(cuts, edges)], [keep, "load", "unit", "edges"])

        m, held = shared.value, []
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            opens = np.flatnonzero(t["e"].to_numpy() == 0)
            cut = int(opens[-1]) if len(opens) else 0
            if cut:
                yield lists(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield lists(pa.Table.from_batches(held).combine_chunks())

    edge = "struct<s:int, n:int, score:double>" if model.kind == "unigram" else "bigint"
    return joined.mapInArrow(group, f"`{keep}` {kind}, load binary, unit string, edges array<{edge}>")


def merged_borders(edges: Column, length: Column) -> Column:
    """Fold for merge models: bitmap of borders left after all merges; ``edges`` come best priority first, then leftmost."""
    one = F.lit(1).cast("bigint")

    def step(mask: Column, ends: Column) -> Column:
        inner = mask.bitwiseAND(ends - ends.bitwiseAND(-ends) * 3)  # the places between the two ends
        return F.when((mask.bitwiseAND(ends) == ends) & (F.bit_count(inner) == 1), mask - inner).otherwise(mask)

    return F.aggregate(edges, F.call_function("shiftleft", one, length + 1) - one, step)


def viterbi_borders(edges: Column, length: Column) -> Column:
    """Fold for unigram models: borders of the path of greatest score. State: best (score, borders) at each place."""
    one = F.lit(1).cast("bigint")

    def step(best: Column, i: Column) -> Column:
        into = F.filter(edges, lambda e: e["s"] + e["n"] == i)
        ways = F.transform(into, lambda e: F.struct((F.get(best, e["s"])["score"] + e["score"]).alias("score"), F.get(best, e["s"])["mask"].bitwiseOR(F.call_function("shiftleft", one, i)).alias("mask")))
        return F.concat(best, F.array(F.array_max(ways)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), one.alias("mask")))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), length), start, step), -1)["mask"]


def borders(rows: DataFrame, model: PieceModel, keep: str, kind: str) -> DataFrame:
    """(keep, load, unit, mask): bitmap of the borders that the fold leaves; 1 for an empty unit, 0 for one too long."""
    fold, n = merged_borders if model.kind == "bpe" else viterbi_borders, F.length("unit")
    mask = F.when(n.between(1, LONG), fold(F.col("edges"), n)).when(n == 0, 1).otherwise(0)
    return lattice(rows, model, keep, kind).select(keep, "load", "unit", mask.alias("mask"))


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, ids): each unit's ids as :meth:`PieceModel.spelt` writes them."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            none = np.zeros(len(b), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(none), pa.array([b""] * len(b), pa.binary()), b.column(0), _spans(shared.value, b.column(0).to_pylist())], ["_m_key", "load", "unit", "spans"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            ids = shared.value.spelt(b.column(2).to_pylist(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids, pa.binary())], ["unit", "ids"])

    rows = units.select("unit").mapInArrow(explode, "_m_key int, load binary, unit string, spans array<int>")
    return borders(rows, model, "_m_key", "int").mapInArrow(spell, "unit string, ids binary")


def frequent_units(counts: DataFrame, head: int) -> DataFrame:
    """Units above the least count that at most ``head`` units exceed; counts are told apart in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("c") * 16).cast("int").alias("step")
    sizes = dict(counts.groupBy(step).count().collect())  # at most 1,024 rows
    least, held = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > head:
            break
        least = k
    return counts.where(step >= least).select("unit")


def encode_documents(df: DataFrame, model: PieceModel, *, key: str = "doc_id", text: str = "text", head: int = 1 << 19) -> DataFrame:
    """(key, ids, n_pieces, id_sum, ids_crc32, decodes) of each whole text.

    ``ids_crc32`` is of the ids as little-endian 32-bit numbers; ``decodes`` tells whether the ids,
    decoded again, give the text's UTF-8.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    counts = staged(count_units(df, text, model), "units")
    top = encode_units(frequent_units(counts, head).repartition(64, "unit"), model).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["unit"].to_pylist(), top["ids"].to_pylist(), strict=True)))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("_m_key"), F.octet_length(body).cast("bigint").alias("_m_size"), F.crc32(body).alias("_m_crc"), F.col(text).alias("_m_text"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, known.value
        for part in parts_of(batches, 256):
            row, load, rare = [], [], []

            def out() -> Iterator[pa.RecordBatch]:
                for at in range(0, len(row), 4096):
                    to = at + 4096
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at:to], pa.int32())), pa.array(load[at:to], pa.binary()), pa.array(rare[at:to], pa.string()), _spans(m, rare[at:to])], ["_m_key", "load", "unit", "spans"])
                del row[:], load[:], rare[:]

            for i, t in enumerate(texts_of(part.column(3))):
                words = m.units(t)
                got = list(map(table.get, words))
                holes, of = [], []
                n = last = 0
                for _ in range(got.count(None)):
                    k = got.index(None, last)
                    n += sum(map(len, got[last:k]))
                    holes.append(n)
                    of.append(words[k])
                    got[k], last = b"", k
                start = np.array([part.column(1)[i].as_py(), part.column(2)[i].as_py(), len(holes), *holes], "<i8").tobytes()
                row += [i] * max(1, len(of))
                load += [start + b"".join(got), *[b""] * (len(of) - 1)]
                rare += of or [""]
                if len(row) >= 4096:
                    yield from out()
            yield from out()

    # a document is the row with its load and the rows of its further rare units
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        done: list[tuple] = []

        def finish(k: object, load: bytes, units: list[bytes]) -> None:
            size, check, n = np.frombuffer(load, "<i8", 3).tolist()
            parts, upto, ids = [], 0, load[24 + 8 * n :]
            for h, u in zip(np.frombuffer(load, "<i8", n, 24).tolist(), units):
                parts += (ids[upto:h], u)
                upto = h
            a = np.frombuffer(b"".join([*parts, ids[upto:]]), m.width).astype("<u4")
            back = m.decode(a.tolist())
            done.append((k, a.astype(np.int32), len(a), int(a.sum(dtype=np.int64)), zlib.crc32(a.tobytes()), len(back) == size and zlib.crc32(back) == check))

        def out() -> pa.RecordBatch:
            keys, ids, n, *more = zip(*done, strict=True)
            done.clear()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array(keys, type_), lists, *(pa.array(x, pa.int64()) for x in (n, *more[:2])), pa.array(more[2], pa.bool_())], [key, "ids", "n_pieces", "id_sum", "ids_crc32", "decodes"])

        now, type_ = None, None
        for b in parts_of(batches, 4096):
            type_ = b.column(0).type
            loads = b.column(1).to_pylist()
            keys = iter(b.column(0).take(pa.array([i for i, x in enumerate(loads) if x], pa.int32())).to_pylist())
            for load, unit in zip(loads, m.spelt(b.column(2).to_pylist(), b.column(3).to_numpy()), strict=True):
                if load:
                    if now:
                        finish(*now)
                    now = (next(keys), load, [unit])
                    if len(done) >= 128:
                        yield out()
                else:
                    now[2].append(unit)
        if now:
            finish(*now)
            yield out()

    kind = df.schema[key].dataType.simpleString()
    spelt = rows.mapInArrow(spell, f"_m_key {kind}, load binary, unit string, spans array<int>")
    return borders(spelt, model, "_m_key", kind).mapInArrow(fill, f"`{key}` {kind}, ids array<int>, n_pieces bigint, id_sum bigint, ids_crc32 bigint, decodes boolean")
