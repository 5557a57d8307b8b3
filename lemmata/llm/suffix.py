"""Removing repeated byte strings by threshold-bounded interval expansion.

A byte goes if a ``least``-byte string that covers it also starts earlier. The corpus is brought into pieces that one task
can index: every ``least``-byte window has a minimizer, the least hashed K-gram in it (an anchor), and equal windows have
equal anchors at equal places. Only anchors that occur again are followed, each with the bytes around it that its windows
can reach (its context). Equal contexts are one; where an anchor has different contexts, they meet in one task. There a
Burrows-Wheeler transform is made of many such contexts, and breadth-first backward extension from the empty string
(Beller, Gog, Ohlebusch and Schnattinger, 2013) yields the common prefixes of neighbouring suffixes by increasing value
and stops at ``least``: boundaries that are not reached by then lie between equal windows. In each class of equal windows
all but the earliest are repeats.

An anchor with more than GROUP different contexts (the edge of a passage that very many documents share) is not given to
one task: its windows are compared by 128-bit digests, dealt out by these. The result is the same.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.common import forget, keep, mix64, powers, slices, text_buffers
from lemmata.llm.common import _BASE, _INVERSE
from lemmata.shipping import map_arrow

LEAST, K = 100, 32
#: Symbols in one transform, as many as a processor's cache holds (any number gives the same result), and contexts of one
#: anchor that are given to one task.
SYMBOLS, GROUP = 300_000, 8_000
#: Bytes of texts that are hashed together; whole texts, so one that is longer stands alone.
PIECE = 1 << 16


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


@lru_cache(2)
def _few_powers(base: np.uint64, n: int) -> np.ndarray:
    return powers(base, n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64; those of buffers of usual size are kept."""
    return _few_powers(base, PIECE)[: n + 1] if n <= PIECE else powers(base, n)


class Hashes:
    """Hashes of any substring of a buffer in constant time, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[: len(data)], out=self.sums[1:])
        self.inverse = _powers(_INVERSE, len(data))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, text number, hash of the k-gram and hash of the context of every anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = least - k + 1
    h = Hashes(data)
    gram = mix64((h.sums[k:] - h.sums[:-k]) * h.inverse[: len(data) - k + 1])
    low = _slide(gram, width, np.minimum)
    low[np.arange(len(low)) + least > np.repeat(offsets[1:], np.diff(offsets))[: len(low)]] = 0  # windows over a text's end
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    place = np.flatnonzero(_slide(padded, width, np.maximum)[: len(gram)] == gram)
    text = np.searchsorted(offsets, place, "right") - 1
    start, end = np.maximum(place - (least - k), offsets[text]), np.minimum(place + least, offsets[text + 1])
    around = mix64(h(start, end) + ((place - start) * (2 * least) + (end - place)).astype(np.uint64), 5)
    return place, text, gram[place], around


def anchors_by_piece(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors``, found in pieces that a processor's cache holds."""
    found, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        place, text, gram, around = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least, k)
        found.append((place + offsets[i], text + i, gram, around))
        i = j
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else anchors(data, offsets, least, k)


def _dense(code: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each of some small numbers among the different ones, and how many there are."""
    used = np.bincount(code) > 0
    return (np.cumsum(used) - 1)[code], int(np.count_nonzero(used))


def _ahead(rank: np.ndarray, step: int) -> np.ndarray:
    """The ranks ``step`` places further on, going round."""
    step %= len(rank)
    return np.concatenate([rank[step:], rank[:step]]) if step else rank


def _sorted_suffixes(rank: np.ndarray, count: int, least: int) -> np.ndarray:
    """Suffixes in order of their first ``least`` symbols. ``rank`` are the symbols, all numbers below ``count``.

    Ranks by some symbols are joined to ranks by several times as many: by counting while there are few pairs, then by sorting
    keys that have the suffix's number in their lower bits.
    """
    n, have = len(rank), 1
    wide = max(1, int(n - 1).bit_length())
    while 2 * have <= least and count * count <= 4 * n:
        rank, count = _dense(rank * count + _ahead(rank, have))
        have *= 2
    while True:
        bits = max(1, (count - 1).bit_length())
        parts = min((63 - wide) // bits, -(-least // have))
        apart = parts < min(2, -(-least // have))  # too many suffixes for their numbers to fit
        if apart:
            parts = 2
        reach = min(parts * have, least)
        key = rank
        for j in range(1, parts):
            key = (key << bits) | _ahead(rank, min(j * have, reach - have))
        if apart:
            order = np.argsort(key)
            key = key[order]
        else:
            key = np.sort((key << wide) | np.arange(n))
            order = key & ((1 << wide) - 1)
            key >>= wide
        have = reach
        if have >= least:
            return order
        ranked = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=ranked[1:])
        count = int(ranked[-1]) + 1
        rank = np.empty(n, np.int64)
        rank[order] = ranked


def transform_classes(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``least`` symbols, and whether each begins a new class of equal prefixes.

    ``symbols`` are small integers; prefixes that meet the end go round, which callers exclude. Intervals are extended over
    the runs of the transform: in an interval the first place of a symbol is the interval's start or a run's.
    """
    n = len(symbols)
    dense, count = _dense(symbols)
    order = _sorted_suffixes(dense, count, least)
    before = dense[order - 1]  # the transform: the symbol before each suffix
    turn = np.concatenate([[True], before[1:] != before[:-1]])
    head = np.flatnonzero(turn)
    run_of = np.cumsum(turn) - 1
    size = np.diff(np.append(head, n))
    tail = head + size - 1
    symbol = before[head]
    by_symbol = np.argsort(symbol.astype(np.uint16), kind="stable")
    # how far from a suffix of a run the suffix stands that is one symbol longer
    away = np.empty(len(head), np.int64)
    away[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
    away -= head
    left, right = by_symbol[:-1], by_symbol[1:]
    same = symbol[left] == symbol[right]
    last_seen, next_seen = np.full(len(head), -1), np.full(len(head), len(head))
    last_seen[right[same]] = left[same]
    next_seen[left[same]] = right[same]
    open_ = np.ones(n + 1, bool)  # boundaries whose common prefix is not known yet
    open_[[0, n]] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        one, end = run_of.take(low), run_of.take(high)
        several = one != end
        lone = np.flatnonzero(~several)  # one symbol comes before all of such an interval
        far = away.take(one.take(lone))
        lone_low, lone_high = low.take(lone) + far, high.take(lone) + far
        several = np.flatnonzero(several)
        low, high, one, end = (x.take(several) for x in (low, high, one, end))
        width = end - one + 1
        stop = np.cumsum(width)
        whose = np.repeat(np.arange(len(low)), width)
        run = np.arange(len(whose)) + (one - stop + width).take(whose)
        # each different symbol before an interval: its first place gives the longer interval's start, its last the end
        into = np.flatnonzero(last_seen.take(run) < one.take(whose))
        r = run.take(into)
        start = np.sort(away.take(r) + np.maximum(low.take(whose.take(into)), head.take(r)))
        into = np.flatnonzero(next_seen.take(run) > end.take(whose))
        r = run.take(into)
        end = np.sort(away.take(r) + np.minimum(high.take(whose.take(into)), tail.take(r)))
        low, high = np.concatenate([start, lone_low]), np.concatenate([end, lone_high])
        new = np.flatnonzero(open_.take(high + 1))
        low, high = low.take(new), high.take(new)
        open_[high + 1] = False
        if not len(low):
            break
    first = ~open_[:-1]
    first[0] = True
    return order, first


def repeats(contexts: list[bytes], order_key: np.ndarray, start: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Context number and offset of every window that starts earlier in another place.

    A context lies at ``start`` in the text with rank ``order_key``; the same window of a text may be in several contexts.
    """
    size = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(size + 1) - 1
    joined[ends] = 0
    order, first = transform_classes(joined, least)
    owner = np.repeat(np.arange(len(size)), size + 1)
    wanted = (np.arange(len(joined)) + least <= ends[owner])[order]
    group = np.cumsum(first)[wanted]
    order = order[wanted]
    whose = owner[order]
    offset = order - (ends - size)[whose]
    if not len(whose):
        return whose, offset
    place = (order_key[whose] << 32) + start[whose] + offset
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least_place = np.repeat(np.minimum.reduceat(place, lead), np.diff(np.append(lead, len(place))))
    later = place > least_place
    return whose[later], offset[later]


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges, text by text."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    shift = (text - text.min()) << 33  # so that one running maximum serves all texts
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    lead = np.flatnonzero(new)
    return text[lead], start[lead], np.append(reach[lead[1:] - 1], reach[-1]) - shift[lead]


_ANCHORS = "h long, s long, doc_id long, at long, sure boolean"


def _later(h: np.ndarray, s: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which anchors have the context of another one at an earlier place."""
    out = np.zeros(len(h), bool)
    order = np.argsort(s)
    same = s[order[1:]] == s[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # the others are alone with their context
    if not len(order):
        return out
    order = order[np.lexsort((at[order], doc[order], s[order], h[order]))]
    h, s, doc, at = h[order], s[order], doc[order], at[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
    lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(h))))
    out[order] = (doc != doc[lead]) | (at != at[lead])
    return out


def _find(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """Anchors (hash, context, text, place) and ranges that are surely repeats (``s`` is the end) of each text.

    Of equal texts that this task sees, all but those of smaller ids than any before are such a range; of equal contexts
    in a slice, all but that at the earliest place make such ranges. So one task has few rows of a passage, however many
    texts share it.
    """
    best: dict[bytes, tuple] = {}

    def rows(h, s, doc_id, at, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc_id), pa.array(at), pa.array(np.full(len(h), sure))], names=["h", "s", "doc_id", "at", "sure"])

    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            data, offsets = text_buffers(batch.column("text"))
            ids, tag = np.asarray(batch.column("doc_id")), np.asarray(batch.column("tag"))
            fresh, gone = np.zeros(len(ids), bool), []
            for i in np.flatnonzero(np.diff(offsets) >= least):
                digest = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
                own, other = (int(ids[i]), int(tag[i])), best.get(digest)
                if other is None or own[0] < other[0]:
                    fresh[i] = True
                    best[digest] = own
                if other is not None and own[0] != other[0]:
                    gone.append((*max(own, other), int(offsets[i + 1] - offsets[i])))
                elif other is not None:  # the same row again is judged as the first is
                    fresh[i] = True
            if gone:
                doc, t, size = (np.array(x, np.int64) for x in zip(*gone, strict=True))
                yield rows(mix64(doc.view(np.uint64)), size, doc, t << 32, True)
            place, text, h, s = anchors_by_piece(data, offsets, least, k)
            mine = fresh[text]
            place, text, h, s = place[mine], text[mine], h[mine], s[mine]
            if not len(place):
                continue
            at = (tag[text] << 32) | (place - offsets[text])
            later = _later(h, s, ids[text], at)
            t, own = text[later], place[later]
            t, a, b = merged(t, np.maximum(own - (least - k), offsets[t]), np.minimum(own + least, offsets[t + 1]))
            if len(t):
                yield rows(mix64((ids[t] + a).view(np.uint64)), b - offsets[t], ids[t], (tag[t] << 32) | (a - offsets[t]), True)
            yield rows(h[~later], s[~later], ids[text[~later]], at[~later], False)


_PARTS = "key long, more long, kind int, doc_id long, tag long, start long, stop long, context binary"


def _part(**cols) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "more": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "context": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in kinds.items()], names=list(kinds))


#: What becomes of an anchor: its context is a repeat, goes to the transform, or its windows go by digests; and a range
#: that is surely a repeat.
_COVER, _CONTEXT, _DIGEST, _RANGE = 0, 1, 2, 3
_PLACE = 0xFFFFFFFF


def _cut(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """What a text's repeated anchors come to: ranges that are surely repeats, contexts, or digests of windows."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            data, offsets = text_buffers(batch.column("text"))
            lists = batch.column("found")
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = lists.flatten()
            at, h, kind = (np.asarray(flat.field(i)) for i in range(3))
            text = np.repeat(np.arange(batch.num_rows), size)
            ids, tag = np.asarray(batch.column("doc_id")), np.asarray(batch.column("tag"))
            base, end_of = offsets[:-1][text], offsets[1:][text]
            ranged = kind == _RANGE
            place = base + (at & _PLACE)
            start = np.where(ranged, place, np.maximum(place - (least - k), base))
            stop = np.where(ranged, base + h, np.minimum(place + least, end_of))
            sure = (kind == _COVER) | ranged
            t, a, b = merged(text[sure], start[sure], stop[sure])
            if len(t):
                yield _part(key=mix64((ids[t] + a).view(np.uint64)).view(np.int64), more=np.zeros(len(t), np.int64), kind=np.full(len(t), _COVER), doc_id=ids[t], tag=tag[t], start=a - offsets[t], stop=b - offsets[t], context=[None] * len(t))
            c = np.flatnonzero(~sure & (kind == _CONTEXT))
            if len(c):
                t = text[c]
                raw = data.tobytes()
                yield _part(key=h[c], more=np.zeros(len(c), np.int64), kind=np.full(len(c), _CONTEXT), doc_id=ids[t], tag=tag[t], start=start[c] - base[c], stop=stop[c] - base[c], context=[raw[a:b] for a, b in zip(start[c].tolist(), stop[c].tolist(), strict=True)])
            d = np.flatnonzero(~sure & (kind == _DIGEST))
            if len(d):
                n = stop[d] - start[d] - least + 1
                t = np.repeat(text[d], n)
                w = np.repeat(start[d], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                w, one = np.unique(w, return_index=True)  # a window may be near several anchors
                t = t[one]
                raw = Hashes(data)(w, w + least)
                yield _part(key=mix64(raw, 9).view(np.int64), more=_second(data, w, least), kind=np.full(len(w), _DIGEST), doc_id=ids[t], tag=tag[t], start=w - offsets[t], stop=w - offsets[t] + least, context=[None] * len(w))


def _second(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Another hash of windows, of their halves turned round."""
    h = Hashes(np.ascontiguousarray(data[::-1]))
    n = len(data)
    return mix64(h(n - start - size, n - start), 21).view(np.int64)


_RANGES = "doc_id long, tag long, start long, stop long"


def _judge(batches: Iterator[pa.RecordBatch], least: int, symbols: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeats from rows in order of (key, more, kind, doc_id, tag, start, stop); equal rows are one."""

    def out(doc_id, tag, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, tag, start, stop)], names=["doc_id", "tag", "start", "stop"])

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        ids, tag, start = (np.asarray(rows.column(c)) for c in ("doc_id", "tag", "start"))
        pairs, rank = np.unique(np.stack([ids, tag], axis=1), axis=0, return_inverse=True)
        rank = rank.reshape(-1)
        which, offset = repeats(rows.column("context").to_pylist(), rank, start, least)
        t, a, b = merged(rank[which], start[which] + offset, start[which] + offset + least)
        if len(t):
            yield out(pairs[t, 0], pairs[t, 1], a, b)

    held, size, last, last_key, last_row = [], 0, (None, None), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        row = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "more", "kind", "doc_id", "tag", "start", "stop")], axis=1)
        same = np.concatenate([[last_row is not None and bool((row[0] == last_row).all())], (row[1:] == row[:-1]).all(axis=1)])
        last_row = row[-1]
        if same.any():
            batch = batch.filter(pa.array(~same))
        kind = np.asarray(batch.column("kind"))
        cover = batch.filter(pa.array(kind == _COVER))
        if cover.num_rows:
            yield out(*(np.asarray(cover.column(c)) for c in ("doc_id", "tag", "start", "stop")))
        digest = batch.filter(pa.array(kind == _DIGEST))
        if digest.num_rows:
            key, more = np.asarray(digest.column("key")), np.asarray(digest.column("more"))
            again = np.concatenate([[(key[0], more[0]) == last], (key[1:] == key[:-1]) & (more[1:] == more[:-1])])
            last = (key[-1], more[-1])
            if again.any():
                yield out(*(np.asarray(digest.column(c))[again] for c in ("doc_id", "tag", "start", "stop")))
        context = batch.filter(pa.array(kind == _CONTEXT))
        if context.num_rows:
            key = np.asarray(context.column("key"))
            total = np.cumsum(np.asarray(context.column("stop")) - np.asarray(context.column("start")) + 1)
            done = 0
            # what is held is cut only between keys; the last key of a batch may go on in the next
            for end in [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]:
                if end == 0 and key[0] == last_key:
                    continue
                new = int((total[end - 1] if end else 0) - (total[done - 1] if done else 0))
                if size + new >= symbols:
                    yield from work([*held, context.slice(done, end - done)])
                    held, size, done = [], 0, end
            held.append(context.slice(done))
            size += int(total[-1] - (total[done - 1] if done else 0))
            last_key = key[-1]
    if held:
        yield from work(held)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_ranges(size: int, start: list[int], stop: list[int]) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, maximal removed runs, and the ranges that stay."""
    removed = spans = at = 0
    stay = []
    reach = -1
    for a, b in sorted(zip(start, stop, strict=True)):
        if a > reach:
            spans += 1
            if a > at:
                stay.append((at, a))
            removed += b - a
            reach = at = b
        elif b > reach:
            removed += b - reach
            reach = at = b
    if at < size:
        stay.append((at, size))
    return removed, spans, stay


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(4)]
        for text, ranges in zip(batch.column("text").cast(pa.large_binary()), batch.column("ranges").to_pylist(), strict=True):
            raw = text.as_py() or b""
            removed, spans, stay = kept_ranges(len(raw), [r["start"] for r in ranges or ()], [r["stop"] for r in ranges or ()])
            digest = hashlib.sha256()
            for a, b in stay:
                digest.update(memoryview(raw)[a:b])
            for c, v in zip(cols, (len(raw), removed, spans, digest.hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(spark) -> None:
    """Let Spark drop the shuffle files of steps that are written down."""
    gc.collect()
    spark._jvm.System.gc()


def repeat_ranges(docs: DataFrame, least: int = LEAST, k: int = K, group: int = GROUP, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, tag, start, stop: ranges of bytes to remove, some of them several times. ``docs`` has doc_id, tag, text."""
    found = docs.transform(map_arrow, lambda batches: _find(batches, least, k), _ANCHORS)
    own = Window.partitionBy("h")
    ordered = own.orderBy("s", "doc_id", "at")
    found = found.withColumn("first", F.coalesce(F.col("s") != F.lag("s").over(ordered), F.lit(True)))
    again = F.lit(True)  # the same place of a row that is there several times
    for c in ("s", "doc_id", "at"):
        again &= F.col(c) == F.lag(c).over(ordered)
    found = found.withColumn("again", F.coalesce(again, F.lit(False)))
    found = found.withColumn("contexts", F.sum(F.col("first").cast("int")).over(own))
    # a later row of a context is a repeat; a first one matters if the anchor has other contexts
    kind = F.when(F.col("sure"), _RANGE).when(~F.col("first"), _COVER).when(F.col("contexts") > group, _DIGEST).otherwise(_CONTEXT)
    found = found.filter(F.col("sure") | ~F.col("again") & (~F.col("first") | (F.col("contexts") > 1)))
    found = found.select("doc_id", F.shiftright("at", 32).alias("tag"), "at", F.when(F.col("sure"), F.col("s")).otherwise(F.col("h")).alias("h"), kind.alias("kind"))
    marked = keep(found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "h", "kind")).alias("found")), "anchors")
    _clean(docs.sparkSession)
    texts = docs.join(marked.withColumnRenamed("doc_id", "m_doc").withColumnRenamed("tag", "m_tag"), (F.col("doc_id") == F.col("m_doc")) & (F.col("tag") == F.col("m_tag")))
    parts = texts.select("doc_id", "tag", "text", "found").transform(map_arrow, lambda batches: _cut(batches, least, k), _PARTS)
    parts = parts.repartition("key").sortWithinPartitions("key", "more", "kind", "doc_id", "tag", "start", "stop")
    ranges = keep(parts.transform(map_arrow, lambda batches: _judge(batches, least, symbols), _RANGES), "ranges")
    forget(marked)
    _clean(docs.sparkSession)
    return ranges


def remove_repeats(docs: DataFrame, *, least: int = LEAST, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text counts as empty; a null id as the largest. Of rows that repeat an id, those with the same text are judged
    as one row, and others count as earlier and later in an order of their texts' hashes. Extra columns are ignored. An
    empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col("doc_id").cast("long").alias("own_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("tag"))
    docs = docs.withColumn("tag", F.col("tag").bitwiseAND(0x7FFFFFFF))
    ranges = repeat_ranges(docs.select("doc_id", "tag", "text"), least, **how)
    by_text = ranges.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    out = docs.join(by_text, ["doc_id", "tag"], "left").select(F.col("own_id").alias("doc_id"), "text", "ranges")
    return out.transform(map_arrow, _remove, _RESULT)
