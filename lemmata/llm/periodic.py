"""Periodic runs of words, found by aligned power-of-two blocks and an Aho-Corasick automaton over word numbers.

A run with period q and at least 4q words holds, whatever its start, an aligned block of B words, B the power of two with
B <= q < 2B, that occurs again q words later. So for each B the aligned blocks are keys of an automaton, the document is
searched for them, and occurrences at distances from B to 2B seed an exact extension in both directions. Three facts keep
the work near n log n:

* a block can only seed if its rarest word occurs again at such a distance; others are no keys, and only the stretches in
  which keys can occur are searched;
* a seed within a known run of a period below B says nothing new (Fine and Wilf);
* if a block lies in a run of period up to B/4, then in a longer run that holds it the ends of that shorter run repeat too:
  only the distances that map its start or its end to those of the run at the occurrence are tried. Other blocks have a
  smallest period above B/4, hence at most five occurrences in reach.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import WORD, slices
from lemmata.shipping import map_arrow

#: Words that a run must have, and how often its period, both at least; the method needs three periods and more.
LEAST, POWER = 6, 4
#: Word numbers are searched as digits of so many bits, each digit place with symbols of its own: the automaton looks through
#: a node's edges one after another, and matches can only begin and end with words.
BITS = 5
#: Bytes of text that a worker takes at once.
TEXT_BYTES = 4 << 20


def numbered_words(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, exact."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _live(w: np.ndarray, key: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Starts of the aligned blocks of ``size`` words whose rarest word occurs again ``size`` to 2 * ``size`` - 1 words later."""
    n = len(w)
    blocks = (n - size) // size  # the last has room for another occurrence
    if blocks <= 0:
        return np.zeros(0, np.int64)
    rare = count[: blocks * size].reshape(blocks, size)
    at = np.arange(blocks) * size + (np.argmin(rare, axis=1) if size > 1 else 0)
    after = np.searchsorted(key, w[at] * (n + 1) + at + size)
    found = (after < n) & (key[np.minimum(after, n - 1)] < w[at] * (n + 1) + np.minimum(at + 2 * size, n))
    return np.flatnonzero(found) * size


def _occurrences(w: np.ndarray, digits: np.ndarray, starts: np.ndarray, size: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """The key of the block at each of ``starts``, and for each key where it occurs, ascending, as far as blocks reach."""
    places = digits.shape[1]
    flat = digits.ravel()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key: dict[int, int] = {}
    for s in starts.tolist():
        block = tuple(flat[s * places : (s + size) * places].tolist())
        key[s] = automaton.get(block, -1)
        if key[s] < 0:
            key[s] = s  # the first block that is alike names it
            automaton.add_word(block, s)
    automaton.make_automaton()
    at: dict[int, list[int]] = {}
    # occurrences start size .. 2 * size - 1 behind a block's start: stretches that overlap are searched once
    edge = np.flatnonzero(np.diff(starts) > 2 * size)
    for first, last in zip(np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(starts) - 1]]), strict=True):
        lo, hi = int(starts[first]) + size, min(len(w), int(starts[last]) + 3 * size - 1)
        for end, k in automaton.iter(tuple(flat[lo * places : hi * places].tolist())):
            at.setdefault(k, []).append(lo + (end + 1) // places - size)
    return key, at


def _same(w: np.ndarray, i: int, j: int, forward: bool) -> int:
    """How many words from i and j > i on are equal, onwards or (before both) backwards."""
    most, done, step = (len(w) - j if forward else i), 0, 32
    while done < most:
        step = min(step * 2, most - done)
        a, b = (w[i + done : i + done + step], w[j + done : j + done + step]) if forward else (w[i - done - step : i - done][::-1], w[j - done - step : j - done][::-1])
        differ = a != b
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done += step
    return done


class _Known:
    """Runs whose periods are between one power of two and the next, by their start.

    A run that reaches as far as another that starts later holds what lies between, so few are looked at.
    """

    def __init__(self, runs: list[tuple[int, int, int]], size: int):
        self.size, self.runs = size, sorted(runs)
        self.starts, self.reach = [r[0] for r in self.runs], list(accumulate((r[1] for r in self.runs), max))

    def holding(self, start: int, end: int) -> tuple[int, int, int] | None:
        k = bisect_right(self.starts, start)
        while k and self.reach[k - 1] >= end:
            k -= 1
            if self.runs[k][1] >= end:
                return self.runs[k]
        return None


def _holding(known: list[_Known], start: int, end: int, below: int) -> tuple[int, int, int] | None:
    """A known run (start, end, period) with a period below ``below``, a power of two, that holds all words from start to end."""
    return next((r for k in known if k.size < below and (r := k.holding(start, end))), None)


def _seeds(known: list[_Known], starts: np.ndarray, blocks: dict[int, int], at: dict[int, list[int]], size: int) -> list[tuple[int, int]]:
    """Distance and start of each block that occurs again in reach, by distance."""
    seeds = []
    for s in starts.tolist():
        where = at.get(blocks[s], ())
        lo, hi = bisect_right(where, s + size - 1), bisect_right(where, s + 2 * size - 1)
        short = _holding(known, s, s + size, size // 4 + 1) if lo < hi else None
        while lo < hi:
            t = where[lo]
            there = _holding(known, t, t + size, size // 4 + 1) if short else None
            if there is None:
                seeds.append((t - s, s))
                lo += 1
                continue
            if there != short:  # only what maps a start to a start or an end to an end
                ways = {there[0] - short[0], there[1] - short[1]}
                seeds += [(d, s) for d in ways if size <= d < 2 * size and (s + d - t) % short[2] == 0 and there[0] <= s + d <= there[1] - size]
            lo = max(lo + 1, bisect_right(where, there[1] - size))
    return sorted(seeds)


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run of equal word numbers, by start, then period."""
    n = len(w)
    if n < LEAST:
        return []
    spans: dict[tuple[int, int], int] = {}  # of a run: its smallest period
    known: list[_Known] = []
    order = np.argsort(w, kind="stable")
    key, count = w[order] * (n + 1) + order, np.bincount(w)[w]
    places = max(1, -(-int(w.max()).bit_length() // BITS))
    digits = np.stack([(w >> (BITS * p) & ((1 << BITS) - 1)) + (p << BITS) for p in range(places)], axis=1)
    size = 1
    while POWER * size <= n:
        starts = _live(w, key, count, size)
        if known:  # all that a block can seed lies within a known run
            starts = starts[[not _holding(known, s, min(n, s + 3 * size - 1), size) for s in starts.tolist()]]
        seeds = _seeds(known, starts, *_occurrences(w, digits, starts, size), size) if len(starts) else []
        tried: dict[int, tuple[int, int]] = {}  # of a distance: the last stretch that was extended
        found = []
        for d, s in seeds:
            lo, hi = tried.get(d, (0, 0))
            if POWER * d > n or lo <= s and s + size + d <= hi or _holding(known, s, s + size + d, size):
                continue
            tried[d] = lo, hi = s - _same(w, s, s + d, False), s + size + d + _same(w, s + size, s + size + d, True)
            if hi - lo >= max(LEAST, POWER * d) and (lo, hi) not in spans:
                spans[lo, hi] = d
                found.append((lo, hi, d))
        if found:
            known.append(_Known(found, size))
        size *= 2
    return sorted((lo, hi - lo, q) for (lo, hi), q in spans.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


SCHEMA = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``runs`` (start, length, period of each, by start, then period) and ``collapsed``.

    Words are those between spaces and the controls 9 to 13. A run is a stretch of words with smallest period q that no
    neighbouring word extends, of at least max(6, 4q) words; ``collapsed`` holds the words that no run holds behind its
    first q, joined by one space. Nulls and texts without words have no runs and an empty collapsed text. Rows are judged
    one by one, whatever they repeat, so extra columns do not matter; only doc_id comes back with the two. An empty table
    gives an empty one. A worker holds one batch, and of a text its words and their numbers.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                found, texts = [], []
                for text in part.column("text"):
                    words = (text.as_py() or "").encode().split()
                    runs = find_runs(numbered_words(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    if runs:
                        words = [w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k]
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth id by checksum the words from a place on repeat with a period; others are as they are.

    With h the checksum of the id as text (null: of the empty text), g = h / 10 and n words: if h % 10 = 0 and n > 0, word i
    from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    n = F.when(F.col("h") % 10 == 0, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).otherwise(F.lit(0)).cast("long")
    x = docs.select("doc_id", "text", h.alias("h")).withColumn("n", n)
    x = x.withColumn("a", F.expr("if(n > 0, (h div 10) % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    x = x.withColumn("times", F.expr("cast((n - a + p - 1) div p as int)"))
    unit = F.slice(words, (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.concat(F.slice(words, 1, F.col("a").cast("int")), F.flatten(F.array_repeat(unit, F.col("times"))))
    again = F.array_join(F.slice(again, 1, F.col("n").cast("int")), " ")
    return x.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
