"""Best-fit packing by exact-complement hashing.

Sequences hold at most ``room`` tokens, so a corpus of any size has at most ``room`` different piece lengths. The plan is
made on the counts of these lengths: single, pair and triple sums are indexed, combinations that exactly fill what a
longer piece leaves are consumed as often as the counts allow, and what is left is packed best-fit in decreasing order.
Pieces are then numbered within their length by many tasks and look their place up in the plan.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.common import keep, slices, substring_hashes, text_buffers
from lemmata.shipping import map_arrow

ROOM = 2048
#: Rows that one task numbers of a length; bytes of text tokenised at once; parts encoded in one call.
RANK_ROWS, TEXT_BYTES, LINES = 4096, 2 << 20, 4096
#: Bytes that a worker keeps from slice to slice, and what a part takes of them besides its ids. When they are reached, what
#: was not used since the last time goes; so a worker holds at most these and the parts of one slice.
CACHE_BYTES, ENTRY = 64 << 20, 29


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, as one array for many texts.

    The tokenizer cuts a text into words and signs before it merges, and at some places it does so whatever surrounds them.
    A slice of texts is cut there into parts, each distinct part is encoded once, and the ids of the texts are gathered
    from those of their parts. Parts without white space inside are encoded many at a time, one to a line: a line end
    between such parts is a token of its own. Texts with a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.encoded(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        """Forget all parts. They are kept in order of ``key``, with the place and number of their ids in ``flat``."""
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, "<u4")

    def shrink(self) -> None:
        """Keep the parts that were used since the last time, if they are few enough."""
        if not 2 * self.used.sum() < len(self.used):
            self.clear()
            return
        u = self.used
        self.key, self.check, first, self.size = self.key[u], self.check[u], self.first[u], self.size[u]
        ends = np.cumsum(self.size, dtype=np.int64)
        self.flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - self.size), self.size)]
        self.first, self.used = ends - self.size, np.zeros(len(first), bool)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some parts one after another, and where each part's begin and how many there are."""
        words, lone = new.to_pylist(), spaced(*text_buffers(new)) if self.line is not None else np.ones(len(new), bool)
        first, size, flat, done = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        lines, rest = np.flatnonzero(~lone), np.flatnonzero(lone)
        for at in range(0, len(lines), LINES):
            own = lines[at : at + LINES]
            ids = self.encoded([b"\n".join(map(words.__getitem__, own.tolist())).decode()])[0]
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(own):  # not a tokenizer that keeps lines apart
                rest = np.concatenate([rest, own])
                continue
            begin = np.concatenate([[0], ends[:-1] + 1])
            first[own], size[own] = begin + done, ends - begin
            flat.append(ids)
            done += len(ids)
        for at in range(0, len(rest), LINES):
            own = rest[at : at + LINES].tolist()
            for i, ids in zip(own, self.encoded([words[i].decode() for i in own]), strict=True):
                first[i], size[i] = done, len(ids)
                flat.append(ids)
                done += len(ids)
        return np.concatenate([np.zeros(0, "<u4"), *flat]), first, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and n + 1 offsets into them; null counts as empty."""
        data, offsets = text_buffers(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        begin = part_starts(data, offsets)
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:  # the text that holds it is one part
                i = int(np.searchsorted(offsets, at, "right")) - 1
                begin[offsets[i] + 1 : offsets[i + 1]] = False
                at = raw.find(s, int(offsets[i + 1]))
        start = np.flatnonzero(begin)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, first, size = np.asarray(parts.indices), *self.places(parts.dictionary)
        each = size[which]
        ends = np.cumsum(each)
        out = self.flat[np.arange(int(ends[-1])) + np.repeat(first[which] - (ends - each), each)]
        return out, np.concatenate([[0], ends])[np.searchsorted(start, offsets)]

    def places(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each part begin, and how many there are; parts that are not known are learned."""
        if len(self.key) * ENTRY + self.flat.nbytes > CACHE_BYTES:
            self.shrink()
        data, offsets = text_buffers(distinct)
        key, check = (substring_hashes(data, offsets, base) for base in _BASES)
        at = np.searchsorted(self.key, key)
        hit = at < len(self.key)
        hit[hit] = (self.key[at[hit]] == key[hit]) & (self.check[at[hit]] == check[hit])
        self.used[at[hit]] = True
        first, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        first[hit], size[hit] = self.first[at[hit]], self.size[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            flat, begin, size[miss] = self.learn(distinct.take(pa.array(miss)))
            first[miss] = len(self.flat) + begin
            self.flat = np.concatenate([self.flat, flat])
            one, which = np.unique(key[miss], return_index=True)
            where = np.searchsorted(self.key, one)
            free = (where == len(self.key)) | (self.key[np.minimum(where, len(self.key) - 1)] != one) if len(self.key) else np.ones(len(one), bool)
            where, own = where[free], miss[which[free]]
            for name, value in (("key", key), ("check", check), ("first", first), ("size", size), ("used", np.ones(len(key), bool))):
                setattr(self, name, np.insert(getattr(self, name), where, value[own]))
        return first, size


#: Two odd numbers: parts count as equal if polynomials of their bytes in both, modulo 2**64, are equal; long ones by a digest.
_BASES = (np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15))


_space = np.zeros(256, bool)
_space[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Bytes that may begin a white space character beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
_may_begin = np.zeros(256, bool)
_may_begin[[0xC2, 0xE1, 0xE2, 0xE3]] = True


_letter = np.zeros(256, bool)
_letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_times_divide = (0x97, 0xB7)  # second bytes of the signs among the letters U+00C0 to U+00FF


def spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each of the parts may hold white space but for a space at its beginning."""
    bad = _space[data] | (_may_begin[data] & (data != 0xC2))
    two = np.flatnonzero(data[:-1] == 0xC2)
    bad[two] = np.isin(data[two + 1], (0x85, 0xA0))
    size = np.diff(offsets)
    some = offsets[:-1][size > 1]
    bad[some[data[some] == 0x20]] = False
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offsets[1:]] > total[offsets[:-1]]


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space beyond ASCII."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (one >= 0x80) & _may_begin[three] & (three != 0xC2)


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a part begins at each byte.

    Where the tokenizer cuts whatever is around: at the start of a text, before a single space between characters that are
    no space, between a Latin letter and an ASCII character that is none and no space, and between a line end and such a
    letter.
    """
    n = len(data)
    begin = np.zeros(n, bool)
    inner = np.flatnonzero(data == 0x20)
    inner = inner[(inner > 0) & (inner < n - 1)]
    before, after = data[inner - 1], data[inner + 1]
    begin[inner[~(_space[before] | _space[after] | _may_begin[after] | _wide_space(data, inner))]] = True
    ends = _letter[data]  # the last byte of a Latin letter
    two = np.flatnonzero(data == 0xC3) + 1
    two = two[two < n]
    two = two[~np.isin(data[two], _times_divide)]
    ends[two] = True
    starts = _letter[data]
    starts[two - 1] = True
    begin[1:] |= ends[:-1] & (data[1:] < 0x80) & ~_letter[data[1:]] & ~(data[1:] == 0x20)
    line = np.flatnonzero((data[:-1] == 0x0A) & starts[1:])
    line = line[(line > 0) & ~_space[data[np.maximum(line - 1, 0)]] & ~_wide_space(data, line)]  # a line end by itself
    begin[line + 1] = True
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = True
    last = offsets[1:][np.diff(offsets) > 0] - 1  # a space at a text's end has no character after it
    begin[last[(data[last] == 0x20) & ~np.isin(last, edges)]] = False
    return begin


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


END = b"\0\0\0\0"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text is empty and has the end token alone.

    A document that fits is one piece; a longer one is cut into pieces of ``room`` tokens but for a shorter first one.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                ids, offsets = encode(batch.column("text"))
                n = batch.num_rows
                total = np.diff(offsets) + 1  # and the end token
                first = np.where(total <= room, total, (total - 1) % room + 1)
                count = 1 + (total - first) // room
                whose = np.repeat(np.arange(n), count)
                piece = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[whose] + (piece - 1) * room)
                length = np.where(piece == 0, first[whose], room)
                last = piece == count[whose] - 1
                begin = offsets[whose] + start
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(END, zlib.crc32(raw[4 * a : 4 * (a + k - 1)])) if e else zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k, e in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(whose)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, _PIECES)


class _Sums:
    """The lengths that are left, and an index of how many singles, pairs and triples of them make each sum.

    A combination may name a length more than once; whether there are enough pieces of it shows when it is consumed.
    """

    def __init__(self, counts: np.ndarray, room: int):
        self.counts, self.room = counts, room
        size = 3 * room + 1
        self.singles, self.pairs, self.triples = (np.zeros(size, np.int64) for _ in range(3))
        for x in np.flatnonzero(counts > 0):
            self._count(int(x), 1)

    def _count(self, x: int, by: int) -> None:
        """Put a length into the index or take it out: what holds x is x and one combination that is shorter by a piece."""
        shorter = ((self.triples, self.pairs), (self.pairs, self.singles))
        if by > 0:
            self.singles[x] += 1
            shorter = shorter[::-1]
        for longer, rest in shorter:
            longer[x:] += by * rest[: len(rest) - x]
        if by < 0:
            self.singles[x] -= 1

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume the combination as often as the counts allow."""
        need = Counter(lengths)
        times = min(int(self.counts[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                self.counts[x] -= n * times
                if not self.counts[x]:
                    self._count(x, -1)
        return times

    def pair(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs a >= b of lengths that are left with a + b = total and a <= most, the largest a first."""
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        if len(a):
            for x in a[(self.singles[a] > 0) & (self.singles[total - a] > 0)]:
                yield int(x), int(total - x)

    def fills(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Single lengths, then pairs, then triples that sum to ``gap``, each looked up in the index."""
        if self.singles[gap]:
            yield (gap,)
        if self.pairs[gap]:
            yield from self.pair(gap, gap - 1)
        if self.triples[gap]:
            a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
            for x in a[(self.singles[a] > 0) & (self.pairs[gap - a] > 0)]:
                for y, z in self.pair(gap - int(x), int(x)):
                    yield int(x), y, z


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences) that together use every piece once."""
    left = np.zeros(room + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if left[room]:
        out.append(((room,), int(left[room])))
        left[room] = 0
    sums = _Sums(left, room)
    for longest in range(room - 1, room // 4 - 1, -1):
        while left[longest]:
            for fill in sums.fills(room - longest):
                if times := sums.take((longest, *fill)):
                    out.append(((longest, *fill), times))
                    break
            else:
                break
    # what is left: decreasing lengths into the sequence with the least room that holds them
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(room + 1)]  # by room left
    for n in range(room, 0, -1):
        k = int(left[n])
        while k:
            gap = next((g for g in range(n, room) if open_[g]), None)
            if gap is None:
                each = room // n
                full, rest = divmod(k, each)
                for times, size in ((full, each), (1, rest)):
                    if times and size:
                        key = (n,) * size
                        open_[room - n * size][key] = open_[room - n * size].get(key, 0) + times
                break
            key, times = open_[gap].popitem()
            used = min(k, times)
            if times > used:
                open_[gap][key] = times - used
            grown = (*key, n)
            open_[gap - n][grown] = open_[gap - n].get(grown, 0) + used
            k -= used
    return out + [(key, times) for bins in open_ for key, times in bins.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length an array of (first rank, first sequence, offset): the ranks from one row to the next fill one slot."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


_PACKED = _PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, *, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) with its sequence and its place there.

    Rows that repeat an id are packed each by itself; a null id stays null; a null text is empty. Extra columns are
    ignored. An empty table gives an empty table. The counts and the plan have at most ``room`` lengths, and the plan at
    most a few slots for each: that is all that the driver holds and sends.
    """
    # the number of a row is written down with it, so that rows which are equal are told apart in every reading
    cut_ = keep(pieces(docs, tokenizer, room).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = places(plan(counts, room))
    parts = 1 << max(0, math.ceil(math.log2(max(1, sum(counts.values())) / RANK_ROWS)))
    wide = 1 << (parts.bit_length() // 2)  # parts that are summed by one task, and at most twice as many such sums
    dealt = cut_.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sums = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("far", F.floor(F.col("part") / wide))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = sums.groupBy("length", "far").agg(F.sum("n").alias("n")).select("length", "far", F.coalesce(F.sum("n").over(before(["length"], "far")), F.lit(0)).alias("far_first"))
    near = sums.withColumn("near_first", F.coalesce(F.sum("n").over(before(["length", "far"], "part")), F.lit(0)))
    starts = near.join(far, ["length", "far"]).select("length", "part", (F.col("far_first") + F.col("near_first")).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("row")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("inside")).alias("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    slot = slots[int(length[own[0]])]
                    row = slot[np.searchsorted(slot[:, 0], rank[own], "right") - 1]
                    sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.transform(map_arrow, look_up, _PACKED)
