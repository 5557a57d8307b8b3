"""Language identification by a byte convolutional network, trained in numpy.

Windows of fixed length cut from a text's UTF-8 bytes go through an embedding, filters of several widths, max pooling over
the window and a softmax. A text's probabilities are those of all its windows, weighted by the letter bytes in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lemmata.llm.common import fold, fresh, slices, text_buffers
from lemmata.shipping import map_arrow

WINDOW, EMBED, WIDTHS, FILTERS = 160, 8, (2, 3, 4), 16
#: The bounded sample that is learned from: documents of a language, windows of each (spread over the whole text), and
#: languages beyond which each has fewer documents and the network more steps.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_LANGS = 500, 16, 64
STEPS, BATCH, RATE = 500, 128, 4e-3
UNKNOWN = "und"

_letters = np.zeros(256, bool)
_letters[ord("a") : ord("z") + 1] = _letters[ord("A") : ord("Z") + 1] = True
_letters[0x80:] = True
#: ASCII capitals as small letters; byte 0 is padding.
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with 0, and the text that each is of."""
    n = np.diff(offsets)
    each = -(-n // size)
    whose = np.repeat(np.arange(len(n)), each)
    first = np.cumsum(each) - each
    out = np.zeros((len(whose), size), np.uint8)
    # a byte's place: its text's first window times the size, then on
    out.reshape(-1)[np.arange(len(data)) + np.repeat(first * size - offsets[:-1], n)] = _fold[data]
    return out, whose


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x all filters; narrower ones are zero at the end
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Windows as rows of the bytes that a filter sees at each place."""
        wide = max(WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, wide - 1)))]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (x.shape[0], x.shape[1], wide * EMBED), (s[0], s[1], s[2])).reshape(-1, wide * EMBED)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            top = (self.columns(part) @ self.filters).reshape(len(part), WINDOW, -1).max(axis=1)
            out[a : a + 512] = softmax(np.maximum(top + self.bias, 0) @ self.dense + self.dense_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, langs: list[str], seed: int = 7) -> Model | None:
    """Fit the network to labelled windows: cross entropy, Adam, windows drawn evenly over the languages.

    Windows with fewer than 8 letters teach only a language that has no others. None where no window has a letter.
    """
    rng = np.random.default_rng(seed)
    y = np.unique(langs, return_inverse=True)[1] if langs else np.zeros(0, np.int64)
    letters = _letters[x].sum(axis=1)
    most = np.zeros(len(set(langs)), np.int64)
    np.maximum.at(most, y, letters)
    enough = letters >= np.clip(most, 1, 8)[y]
    if not enough.any():
        return None
    names = sorted({langs[i] for i in np.flatnonzero(enough)})
    x, y = x[enough], np.searchsorted(names, [langs[i] for i in np.flatnonzero(enough)])
    wide, n = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat([[1.0]] * w * EMBED + [[0.0]] * (wide - w) * EMBED, FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)
    m = Model(names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.25, (wide * EMBED, n)) * mask).astype(np.float32), np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return m
    params = [m.embed, m.filters, m.bias, m.dense, m.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    steps = STEPS * -(-len(names) // SAMPLE_LANGS)
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(by_lang), BATCH)])
        bx, by = x[pick].copy(), y[pick]
        # some windows lose their end, so that short texts are known too
        short = rng.random(BATCH) < 0.3
        keep = rng.integers(12, WINDOW, BATCH)
        bx[short[:, None] & (np.arange(WINDOW) >= keep[:, None])] = 0
        cols = m.columns(bx)
        conv = (cols @ m.filters).reshape(BATCH, WINDOW, n)
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + m.bias
        act = np.maximum(top, 0)
        p = softmax(act @ m.dense + m.dense_bias)
        p[np.arange(BATCH), by] -= 1
        p /= BATCH
        d_top = (p @ m.dense.T) * (top > 0)
        seen = cols.reshape(BATCH, WINDOW, -1)[np.arange(BATCH)[:, None], at]  # batch x filters x inputs
        d_filters = np.einsum("bf,bfi->if", d_top, seen) * mask
        d_in = d_top[:, :, None] * m.filters.T[None]
        d_embed = np.zeros_like(m.embed)
        padded = np.pad(bx, ((0, 0), (0, wide - 1)))
        for k in range(wide):
            np.add.at(d_embed, padded[np.arange(BATCH)[:, None], at + k], d_in[:, :, k * EMBED : (k + 1) * EMBED])
        grads = [d_embed, d_filters, d_top.sum(axis=0), act.T @ p, p.sum(axis=0)]
        rate = RATE * min(1.0, 2.0 - 2.0 * step / steps + 0.05)
        for q, g, v, s in zip(params, grads, first, second, strict=True):
            v += 0.1 * (g - v)
            s += 0.001 * (g * g - s)
            q -= (rate * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang and at most SAMPLE_WINDOWS windows of each text, evenly spread over it."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            x, whose = windows(*text_buffers(batch.column("text")))
            n = np.bincount(whose, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            picked = [x[f + np.unique((np.arange(SAMPLE_WINDOWS) + 0.5) * k / SAMPLE_WINDOWS // 1).astype(np.int64)].reshape(-1).tobytes() for f, k in zip(first.tolist(), n.tolist(), strict=True) if k]
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(some), batch.column("lang").filter(some), pa.array(picked, pa.binary())], names=["doc_id", "lang", "windows"])


def sample(docs: DataFrame) -> DataFrame:
    """lang and windows of the documents to learn from, of every language: those of each that come first by a hash of the id.

    At most SAMPLE_DOCS of a language; with more than SAMPLE_LANGS languages an equal share of SAMPLE_DOCS * SAMPLE_LANGS,
    one at least. Ids are chosen first: the hash leaves about three times as many as are wanted, whatever a language holds,
    and these are ordered. Windows are then cut where the texts are read; of rows that repeat an id one teaches. What comes
    to the driver is a number for each language, as in the model itself, and the sample.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0) & (F.length("text") > 0))
    sizes = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()]
    each = max(1, SAMPLE_DOCS * SAMPLE_LANGS // max(SAMPLE_LANGS, len(sizes)))
    below = docs.sparkSession.createDataFrame([(k, float(min(1.0, (3 * each + 100) / max(1, n)))) for k, n in sizes], "lang string, below double")
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid"))
    ids = known.select("doc_id", "lang").join(F.broadcast(below), "lang").filter(F.pmod(place, F.lit(1 << 30)) < F.col("below") * (1 << 30))
    ids = ids.select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("doc_id", "lang")
    picked = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    return picked.transform(map_arrow, _spread_windows, "doc_id long, lang string, windows binary").groupBy("doc_id", "lang").agg(F.min("windows").alias("windows"))


def fit(docs: DataFrame, seed: int = 7) -> Model | None:
    """The model, or None where no document with a letter has a label to learn from."""
    rows = sorted((r["lang"], bytes(r["windows"])) for r in sample(docs).collect())
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, [k for k, w in rows for _ in range(len(w) // WINDOW)], seed)


def predict(model: Model | None, texts: pa.Array, least: float = 0.35) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its probability, and the share of letters in windows that have any language with ``least``, of each text.

    ``und``, 0 and 0 where a text is null or has no letter.
    """
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    if model is None or not n:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    x, whose = windows(data, offsets)
    p = model.predict(x).astype(np.float64) if len(x) else np.zeros((0, len(model.langs)))
    weight = _letters[x].sum(axis=1).astype(np.float64)
    total = np.bincount(whose, weight, n)
    sums = np.stack([np.bincount(whose, weight * p[:, k], n) for k in range(len(model.langs))], axis=1)
    best = sums.argmax(axis=1)
    score = np.where(total > 0, sums[np.arange(n), best] / np.maximum(total, 1), 0.0)
    known = np.bincount(whose, weight * (p.max(axis=1) >= least), n) / np.maximum(total, 1)
    ascii_letters = np.bincount(whose, _letters[:128][np.minimum(x, 127)].sum(axis=1) if len(x) else None, n) > 0
    langs = [model.langs[k] for k in best]
    for i in np.flatnonzero(~ascii_letters):
        if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
            langs[i], score[i], known[i] = UNKNOWN, 0.0, 0.0
    return langs, np.clip(score, 0, 1), known


def _runner(model: Model | None, *names: str, least: float = 0.35):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                langs, *shares = predict(model, batch.column("text"), least)
                cols = [pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in shares)][: len(names)]
                yield pa.RecordBatch.from_arrays(batch.columns + cols, names=[*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang), over its whole text.

    Without a model, one is fitted to the rows that are not held out. With no labelled row there is none, and every
    answer is ``und``. Null ids stay null; repeated rows give repeated results; extra columns are ignored. An
    empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = model or fit(docs)
    out = docs.select("doc_id", "text").transform(map_arrow, _runner(model, "lang_pred", "score"), "doc_id long, text string, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is recognised.

    Either one language has a probability of at least ``least`` over the text, or at least half of its letters are in
    windows that each have one, whichever languages these are.
    Rows that repeat stay or go together; other columns are as they were, whatever their names. An empty table gives an
    empty table.
    """
    model = fit(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    lang, score, known = (fresh(docs.columns, x) for x in ("lang_pred", "score", "known"))
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType()), StructField(known, DoubleType())])
    out = docs.transform(map_arrow, _runner(model, lang, score, known, least=least), schema)
    return out.filter((F.col(lang) != UNKNOWN) & ((F.col(score) >= least) | (F.col(known) >= 0.5))).select(*docs.columns)
