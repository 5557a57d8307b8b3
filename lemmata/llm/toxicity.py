"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Characters enter under the words: filters slide over the embedded bytes of each word, and the largest answer of each filter
is the word's, so a word that was never seen is read letter by letter; a table of hashed character n-grams gives a second
reading. Words that the training sample holds often enough have a row of their own besides. Overlapping windows of words go
through a GRU in each direction, attention pools the states, and a logistic unit scores the window. A text's score is that
of its highest window, and all windows of all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import fold, mix64, runs, slices, text_buffers
from lemmata.shipping import map_arrow

WINDOW, STRIDE, INPUT, HIDDEN, ATTENTION = 48, 16, 16, 8, 8
#: Numbers to an embedded byte, bytes that a filter sees, and words that are read letter by letter at once.
BYTE, FILTER, WORDS = 6, 3, 8192
GRAMS, GRAM_ROWS, LEAST_DOCS, MOST_WORDS = (3, 4), 1 << 13, 3, 20_000
#: The bounded sample that is learned from: toxic and other labelled documents, and windows of each. Of a text with more
#: windows, runs of RUN windows that are evenly spread over it teach.
SAMPLE_TOXIC, SAMPLE_CLEAN, TOXIC_WINDOWS, CLEAN_WINDOWS, RUN = 2000, 4500, 256, 64, 8
STEPS, BATCH, RATE = 450, 96, 8e-3

_word_byte = np.zeros(256, bool)
for _a, _b in (("a", "z"), ("A", "Z"), ("0", "9")):
    _word_byte[ord(_a) : ord(_b) + 1] = True
_word_byte[0x80:] = True
_word_byte[ord("_")] = _word_byte[ord("'")] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of a batch of texts: which distinct word each is, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray  # of each distinct word's first place in data
    length: np.ndarray
    hashed: np.ndarray  # of each distinct word
    which: np.ndarray  # of each word in order
    offsets: np.ndarray  # texts + 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = _lower[data]
    start, end, hashed = runs(data, offsets, _word_byte[data])
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    return Words(data, start[first], (end - start)[first], hashed[first], which.astype(np.int64), np.searchsorted(start, offsets))


def words_of(texts: list[bytes], most: int = 1 << 20) -> Words:
    """The words of many texts, read in slices of about ``most`` bytes, as a slice takes some forty times its own size."""
    size = np.array([len(t) for t in texts], np.int64)
    group = np.cumsum(size) // most
    parts, base = [], 0
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1) if len(texts) else []:
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
        w = words(data, np.concatenate([[0], np.cumsum(size[own])]))
        parts.append((w, base))
        base += len(data)
    if not parts:
        return words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    hashed = np.concatenate([w.hashed for w, _ in parts])
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    at = np.cumsum([len(w.hashed) for w, _ in parts]) - [len(w.hashed) for w, _ in parts]
    before = np.cumsum([w.offsets[-1] for w, _ in parts]) - [w.offsets[-1] for w, _ in parts]
    start, length = (np.concatenate(x)[first] for x in ([w.start + b for w, b in parts], [w.length for w, _ in parts]))
    offsets = np.concatenate([[0], *(w.offsets[1:] + n for (w, _), n in zip(parts, before, strict=True))])
    return Words(np.concatenate([w.data for w, _ in parts]), start, length, hashed[first], which[np.concatenate([w.which + a for (w, _), a in zip(parts, at, strict=True)])], offsets)


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for each distinct word, one after another, and how many each has (one at least)."""
    counts = [np.maximum(w.length - n + 1, 1 if n == GRAMS[0] else 0) for n in GRAMS]
    total = np.sum(counts, axis=0)
    out = np.zeros(int(total.sum()), np.int64)
    base = np.cumsum(total) - total
    for n, c in zip(GRAMS, counts, strict=True):
        whose = np.repeat(np.arange(len(c)), c)
        k = np.arange(len(whose)) - np.repeat(np.cumsum(c) - c, c)
        code = np.full(len(whose), n, np.uint64)
        for j in range(n):
            inside = k + j < w.length[whose]
            place = np.minimum(w.start[whose] + k + j, max(0, len(w.data) - 1))
            code = code * np.uint64(257) + np.where(inside, w.data[place], 0).astype(np.uint64)
        out[base[whose] + k] = (mix64(code) & np.uint64(GRAM_ROWS - 1)).astype(np.int64)
        base = base + c
    return out, total


def characters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a filter sees at each place of each distinct word, 0 beyond the word, and where the words begin."""
    size = w.length
    whose = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(whose), FILTER), np.uint8)
    for j in range(FILTER):
        at = k + j - FILTER // 2
        inside = (at >= 0) & (at < size[whose])
        out[inside, j] = w.data[(w.start[whose] + at)[inside]]
    return out, np.cumsum(size) - size


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-word numbers by step and window (-1: none), and the text of each window."""
    n = np.diff(w.offsets)
    each = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    whose = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(whose)) - np.repeat(np.cumsum(each) - each, each)
    first, end, step = w.offsets[:-1][whose] + k * STRIDE, w.offsets[1:][whose], np.full((WINDOW, len(whose)), -1, np.int32)
    for t in range(WINDOW if len(whose) else 0):
        inside = first + t < end
        step[t, inside] = w.which[first[inside] + t]
    return step, whose


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the words in the word table
    p: dict[str, np.ndarray]

    def rows(self, w: Words) -> np.ndarray:
        """Row of the word table of each distinct word; 0 for one that it lacks."""
        if not len(self.known):
            return np.zeros(len(w.hashed), np.int64)
        at = np.minimum(np.searchsorted(self.known, w.hashed), len(self.known) - 1)
        return np.where(self.known[at] == w.hashed, at + 1, 0)

    def inputs(self, rows: np.ndarray, gram: np.ndarray, count: np.ndarray, seen: np.ndarray, begin: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """What each distinct word gives to the network; ``seen`` and ``begin`` as from ``characters``."""
        if not len(rows):
            return np.zeros((0, INPUT), np.float32)
        by_gram = np.add.reduceat(self.p["gram"][gram], np.cumsum(count) - count) / count[:, None].astype(np.float32)
        by_letter = np.empty((len(rows), INPUT), self.p["filter"].dtype)
        ends = np.append(begin[1:], len(seen))
        for a in range(0, len(rows), WORDS):  # so that no more than these words' letters are unfolded at once
            at, z = slice(a, a + WORDS), begin[a]
            letters = seen[z : ends[min(a + WORDS, len(rows)) - 1]]
            by_place = self.p["byte"][letters].reshape(len(letters), -1) @ self.p["filter"]
            by_letter[at] = np.maximum.reduceat(by_place, begin[at] - z)
            if keep is not None:
                place = np.where(by_place == np.repeat(by_letter[at], (ends - begin)[at], axis=0), np.arange(len(letters))[:, None], len(letters))
                keep.setdefault("places", []).append(np.minimum.reduceat(place, begin[at] - z) + z)
        if keep is not None:
            keep["place"] = np.concatenate(keep.pop("places"))  # of each word and filter, the place that answers most
        return self.p["word"][rows] + by_gram + by_letter

    def into(self, x: np.ndarray) -> np.ndarray:
        """What each input gives to the gates, by direction; the last row, of no word, closes the gate: the state stays."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        for d in (0, 1):
            np.matmul(x, self.p["in"][d], out=out[d, :-1])
            out[d, :-1] += self.p["bias"][d]
        out[:, -1, :HIDDEN] = 40
        return out

    def run(self, into: np.ndarray, step: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows (WINDOW x B numbers of words, -1: none). ``keep`` gets what the gradients need."""
        p, (t_all, b) = self.p, step.shape
        h = np.zeros((2, b, HIDDEN), np.float32)
        states = np.zeros((t_all, 2, b, HIDDEN), np.float32)
        kept = []
        for t in range(t_all):
            a = np.stack([into[0].take(step[t], axis=0, mode="wrap"), into[1].take(step[t_all - 1 - t], axis=0, mode="wrap")])
            u = h @ p["own"]
            zr = a[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(a[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                kept.append((h, z, r, n, u[..., 2 * HIDDEN :]))
            h = new
            states[t, 0] = h[0]
            states[t_all - 1 - t, 1] = h[1]
        s = states.transpose(0, 2, 1, 3).reshape(t_all, b, 2 * HIDDEN)
        mid = np.tanh(s @ p["look"])
        score = np.where(step >= 0, mid @ p["weigh"], -1e9)
        w = np.exp(score - score.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[..., None] * s).sum(axis=0)
        if keep is not None:
            keep.update(kept=kept, s=s, mid=mid, w=w, pooled=pooled)
        return pooled @ p["out"] + p["out_bias"]

    def logits(self, w: Words, step: np.ndarray) -> np.ndarray:
        gram, count = grams(w)
        into = self.into(self.inputs(self.rows(w), gram, count, *characters(w)))
        return np.concatenate([np.zeros(0, np.float32), *(self.run(into, step[:, a : a + 1024]) for a in range(0, step.shape[1], 1024))])

    def gradients(self, x: np.ndarray, step: np.ndarray, k: dict, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p, g, (t_all, b), s, w, mid = self.p, {}, step.shape, k["s"], k["w"], k["mid"]
        g["out"], g["out_bias"] = k["pooled"].T @ d_out, d_out.sum(keepdims=True)
        d_pool = d_out[:, None] * p["out"][None]
        d_s = w[..., None] * d_pool[None]
        d_w = (s * d_pool[None]).sum(axis=2)
        d_score = w * (d_w - (w * d_w).sum(axis=0))
        g["weigh"] = (mid * d_score[..., None]).sum(axis=(0, 1))
        d_mid = d_score[..., None] * p["weigh"] * (1 - mid * mid)
        g["look"] = np.einsum("tbi,tbj->ij", s, d_mid)
        d_s = (d_s + d_mid @ p["look"].T).reshape(t_all, b, 2, HIDDEN).transpose(0, 2, 1, 3)
        d_h, g["own"] = np.zeros((2, b, HIDDEN), np.float32), np.zeros_like(p["own"])
        d_gates = np.zeros((2, t_all, b, 3 * HIDDEN), np.float32)
        for t in range(t_all - 1, -1, -1):
            h, z, r, n, un = k["kept"][t]
            d_h = d_h + np.stack([d_s[t, 0], d_s[t_all - 1 - t, 1]])
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=2)
            d_a = np.concatenate([d_z, d_r, d_n], axis=2)
            g["own"] += h.transpose(0, 2, 1) @ d_u
            d_h = d_h * z + d_u @ p["own"].transpose(0, 2, 1)
            d_gates[0, t], d_gates[1, t_all - 1 - t] = d_a
        d_into = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        order = np.argsort(step, axis=None, kind="stable")  # the gates' gradients summed by word
        own, lead = np.unique(step.reshape(-1)[order], return_index=True)
        for d in (0, 1):
            d_into[d, own] = np.add.reduceat(d_gates[d].reshape(-1, 3 * HIDDEN)[order], lead)
        d_into = d_into[:, :-1]
        g["bias"] = d_into.sum(axis=1)
        g["in"] = np.einsum("ui,duj->dij", x, d_into)
        return g, np.einsum("duj,dij->ui", d_into, p["in"])


    def letter_gradients(self, seen: np.ndarray, place: np.ndarray, d_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the filters and the embedded bytes: each filter learns at the place of each word that answered most."""
        at = seen[place]  # words x filters x bytes
        g_filter = np.einsum("wf,wfi->if", d_x, self.p["byte"][at].reshape(*place.shape, -1))
        d_byte = (d_x[:, :, None] * self.p["filter"].T[None]).reshape(*at.shape, BYTE)
        g_byte = np.stack([np.bincount(at.reshape(-1), d_byte[..., j].reshape(-1), 256) for j in range(BYTE)], axis=1)
        return g_filter, g_byte.astype(np.float32)


def _start(rng: np.random.Generator, n_words: int) -> dict[str, np.ndarray]:
    f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    word = f(0.1, n_words + 1, INPUT)
    word[0] = 0
    bias = np.zeros((2, 3 * HIDDEN), np.float32)
    return {"word": word, "gram": f(0.3, GRAM_ROWS, INPUT), "byte": f(0.3, 256, BYTE), "filter": f(0.08, FILTER * BYTE, INPUT), "in": f(0.35, 2, INPUT, 3 * HIDDEN), "bias": bias, "own": f(0.3, 2, HIDDEN, 3 * HIDDEN), "look": f(0.35, 2 * HIDDEN, ATTENTION), "weigh": f(0.5, ATTENTION), "out": f(0.5, 2 * HIDDEN), "out_bias": np.full(1, -1.0, np.float32)}


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 11) -> Model:
    """Fit the network to labelled texts.

    A label is of a text, not of a window: after a first pass over all windows, a toxic text teaches with those of its
    windows that score highest, and half of the other windows are those that are mistaken most.
    """
    rng = np.random.default_rng(seed)
    w = words_of(texts)
    whose_word = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
    seen = np.bincount(np.unique(whose_word * max(1, len(w.hashed)) + w.which) % max(1, len(w.hashed)), minlength=len(w.hashed)) if len(w.which) else np.zeros(0, np.int64)
    often = np.flatnonzero(seen >= LEAST_DOCS)
    often = often[np.argsort(-seen[often], kind="stable")[:MOST_WORDS]]
    m = Model(np.sort(w.hashed[often]), {})
    m.p = _start(rng, len(m.known))
    step, whose = windows(w)
    if not (toxic[whose] == 1).any() or not (toxic[whose] == 0).any():  # one class, or the other has no word
        m.p["out"][:] = 0
        m.p["out_bias"][:] = 20.0 if (toxic[whose] == 1).any() else -20.0
        return m
    gram, count = grams(w)
    gram_at, rows = np.cumsum(count) - count, m.rows(w)
    seen, seen_at = characters(w)
    ragged = lambda first, n: np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    bad, good = np.flatnonzero(toxic[whose] == 1), np.flatnonzero(toxic[whose] == 0)
    first, second = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}
    pool_bad, pool_hard = bad, good
    for i in range(1, STEPS + 1):
        if i in (STEPS // 4, STEPS * 5 // 8):
            z = m.logits(w, step)
            best = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(best, whose, z)
            pool_bad = bad[z[bad] >= best[whose[bad]] - 0.5]
            pool_hard = good[np.argsort(-z[good], kind="stable")[: max(BATCH, len(good) // 20)]]
        pick = np.concatenate([rng.choice(pool_bad, BATCH // 2), rng.choice(good, BATCH // 4), rng.choice(pool_hard, BATCH - BATCH // 2 - BATCH // 4)])
        y = toxic[whose[pick]].astype(np.float32)
        own, local = np.unique(step[:, pick], return_inverse=True)
        local = local.reshape(WINDOW, len(pick)) - (own[0] < 0)
        own = own[own >= 0]
        n = count[own]
        mine = gram[ragged(gram_at[own], n)]
        long = w.length[own]
        letters = seen[ragged(seen_at[own], long)]
        row = np.where(rng.random(len(own)) < 0.3, 0, rows[own])  # sometimes a word is read by its letters alone
        k: dict = {}
        x = m.inputs(row, mine, n, letters, np.cumsum(long) - long, k)
        prob = 1 / (1 + np.exp(-m.run(m.into(x), local, k)))
        g, d_x = m.gradients(x, local, k, ((prob - y) / len(pick)).astype(np.float32))
        g["word"] = np.zeros_like(m.p["word"])
        np.add.at(g["word"], row, d_x)
        g["word"][0] = 0
        g["gram"] = np.zeros_like(m.p["gram"])
        np.add.at(g["gram"], mine, np.repeat(d_x / n[:, None].astype(np.float32), n, axis=0))
        g["filter"], g["byte"] = m.letter_gradients(letters, k["place"], d_x)
        rate = RATE * min(1.0, 2.05 - 2.0 * i / STEPS)
        for name, q in m.p.items():
            first[name] += 0.1 * (g[name] - first[name])
            second[name] += 0.005 * (g[name] * g[name] - second[name])
            q -= (rate * (first[name] / (1 - 0.9**i)) / (np.sqrt(second[name] / (1 - 0.995**i)) + 1e-7)).astype(np.float32)
    return m


def scores(m: Model | None, texts: pa.Array) -> np.ndarray:
    """The highest window's probability of each text; 0 where a text has no word."""
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    out = np.zeros(n)
    if m is None or not n:
        return out
    w = words(data, offsets)
    step, whose = windows(w)
    if len(whose):
        np.maximum.at(out, whose, 1 / (1 + np.exp(-np.clip(m.logits(w, step).astype(np.float64), -40, 40))))
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic and the text, or runs of windows evenly spread over it where it has more than may teach."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            data, offsets = text_buffers(batch.column("text"))
            start, end, _ = runs(_lower[data], offsets, _word_byte[data])
            at = np.searchsorted(start, offsets)
            out = []
            for i, label in enumerate(batch.column("toxic").to_pylist()):
                a, n, most = int(at[i]), int(at[i + 1] - at[i]), TOXIC_WINDOWS if label else CLEAN_WINDOWS
                if n <= most * STRIDE:
                    out.append(data[offsets[i] : offsets[i + 1]].tobytes())
                    continue
                pieces = most // RUN
                first = a + (np.arange(pieces) * (n - RUN * STRIDE) // max(1, pieces - 1))
                out.append(b" ".join(data[start[f] : end[f + RUN * STRIDE - 1]].tobytes() for f in first.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "taught"])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """taught (bytes of text), toxic of the documents to learn from; the labels of both classes that come first by a hash.

    The labels are chosen first; at most SAMPLE_TOXIC + SAMPLE_CLEAN of them are sent to the scan of the texts. Of rows that
    repeat an id one teaches; an id that is labelled both ways teaches nothing.
    """
    learn = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    learn = learn.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    learn = learn.select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")).alias("place"))
    part = lambda label, n: learn.filter(F.col("toxic") == label).orderBy("place", "doc_id").limit(n)
    chosen = part(1, SAMPLE_TOXIC).unionByName(part(0, SAMPLE_CLEAN)).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") > 0)
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    return texts.transform(map_arrow, _spread, "doc_id long, toxic int, taught binary").groupBy("doc_id").agg(F.min("taught").alias("taught"), F.min("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model | None:
    rows = sorted((bytes(r["taught"]), r["toxic"]) for r in sample(docs, labels).select("taught", "toxic").collect())
    return train([t for t, _ in rows], np.array([y for _, y in rows]), seed) if rows else None


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), over its whole text.

    Without a model, one is fitted to the rows of ``labels`` (doc_id, toxic) that are not held out; where there is none to
    learn from, every score is 0. A text that is null or has no word scores 0. Null ids stay null; repeated rows give
    repeated results; extra columns are ignored. An empty table gives an empty table.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(model, batch.column("text")), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
