"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector is rotated into CODE_FACTOR times its dimensions and only the signs are kept, with one correction scalar
f = <code, rotated vector>. For a rotated query q, <code, q> / f estimates their cosine without bias, and it is off by
less than EPSILON * sqrt((1 - f^2) / f^2 / (bits - 1)) but for a tiny probability. The query is rounded to a few bits, so
the sums are population counts over packed words. Vectors whose upper bound reaches the k-th best lower bound are ranked
again by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.shipping import map_arrow, ship

CODE_FACTOR, QUERY_BITS, EPSILON, SEED = 4, 6, 3.0, 20240
#: Vectors that a block of the index holds on average, and queries of a query block.
BLOCK, QUERIES = 8192, 1024


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """bits x dim: the first columns of a random orthogonal matrix."""
    bits = max(64, -(-CODE_FACTOR * dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


_ROTATIONS: dict[int, np.ndarray] = {}


def rotated(unit: np.ndarray) -> np.ndarray:
    dim = unit.shape[1]
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return unit @ _ROTATIONS[dim].T


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (n x words of 64) and the correction scalars of double vectors that are not zero."""
    r = rotated(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    codes = np.packbits(r > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, np.abs(r).sum(axis=1) / math.sqrt(r.shape[1])


def estimates(query: np.ndarray, codes: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of one rotated unit query with coded vectors, and their error bounds."""
    bits = len(query)
    low = query.min()
    step = max((query.max() - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    levels = np.rint((query - low) / step).astype(np.int64)
    total = np.zeros(len(codes), np.int64)
    for b in range(QUERY_BITS):
        plane = np.packbits((levels >> b) & 1 == 1, bitorder="little").view(np.uint64)
        total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # sum of +q where the bit is set and -q elsewhere, over sqrt(bits)
    dot = (2 * (step * total + low * ones) - (step * levels.sum() + low * bits)) / math.sqrt(bits)
    return dot / f, (EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (bits - 1)) + step) / f


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, summed in order of the components."""
    dot, a, b = np.zeros(len(vectors)), 0.0, np.zeros(len(vectors))
    for i in range(len(query)):
        dot += query[i] * vectors[:, i]
        a += query[i] * query[i]
        b += vectors[:, i] * vectors[:, i]
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, f: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(place of the query, id, cosine) of each query's k nearest of one block, ties to the smaller id."""
    out = []
    turned = rotated(queries / np.linalg.norm(queries, axis=1, keepdims=True))
    for i, own in enumerate(query_ids):
        about, off = estimates(turned[i], codes, f)
        other = ids != own
        n = int(other.sum())
        if not n:
            continue
        lower = np.where(other, about - off, -np.inf)
        floor = np.partition(lower, len(lower) - k)[len(lower) - k] if n > k else -np.inf
        pick = np.flatnonzero(other & (about + off >= floor))
        exact = cosines(queries[i], vectors[pick])
        best = np.lexsort((ids[pick], -exact))[:k]
        out += [(i, int(ids[pick[j]]), float(exact[j])) for j in best]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double), dim of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def _matrix(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("vector").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)


def _blocks(k: int, code: bool):
    def pack(table: pa.Table) -> pa.Table:
        ids, v = np.asarray(table.column("vec_id"), np.int64), _matrix(table)
        order = np.lexsort((*v.T[::-1], ids)) if not code else np.lexsort((ids, *v.T[::-1]))
        ids, v = ids[order], v[order]
        if code and len(ids) > 1:
            # of equal vectors only the k + 1 smallest ids, and k rows of each, can be among the k nearest of any other
            at = np.arange(len(ids))
            new = np.concatenate([[True], (v[1:] != v[:-1]).any(axis=1)])
            other = new | np.concatenate([[True], ids[1:] != ids[:-1]])
            start, own = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, other))
            nth = np.cumsum(other)
            few = (nth - nth[start] <= k) & (at - own < k)
            ids, v = ids[few], v[few]
        codes, f = encode(v) if code else (np.zeros(0, np.uint64), np.zeros(0))
        row = {"dim": [v.shape[1]], "g": [table.column("g")[0].as_py()], "ids": [ids.tobytes()], "vectors": [np.ascontiguousarray(v).tobytes()], "codes": [codes.tobytes()], "f": [f.tobytes()]}
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("g", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("f", pa.binary())]))

    return pack


_BLOCK = "dim int, g long, ids binary, vectors binary, codes binary, f binary"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: B023, E731
                ids, f = get("ids", np.int64), get("f", np.float64)
                n, query_ids = len(ids), get("query_ids", np.int64)
                found = nearest(ids, get("vectors", np.float64).reshape(n, -1), get("codes", np.uint64).reshape(n, -1), f, query_ids, get("queries", np.float64).reshape(len(query_ids), -1), k)
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                place = np.array(cols[0], np.int64)
                block = batch.column("block")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(place), pa.int64()), pa.array(place), pa.array(query_ids[place] if len(place) else place), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["block", "place", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` to each row of ``queries`` (both vec_id, embedding).

    Rows whose id is null, and vectors that are null, empty, zero or hold a null or non-finite component, take no part.
    A query meets vectors of its own length only, and none with its own id. A repeated query row is answered each time;
    repeated vectors count each. Extra columns are ignored; an empty
    table on either side gives an empty table. Index and queries are dealt into blocks of bounded size, and every query block meets
    every index block of its length; what is dealt is one row for each such pair.
    """
    ship(vectors.sparkSession)
    v, q = usable(vectors), usable(queries)
    sizes = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(sizes.values(), default=1)
    shards, blocks = -(-n // BLOCK), max(1, -(-q.count() // QUERIES))
    pack = lambda df, m, code: df.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("long")).groupBy("dim", "g").applyInArrow(_blocks(k, code), _BLOCK)
    index = pack(v, shards, True)
    asked = pack(q, blocks, False).select("dim", F.col("g").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    # a row holds whole blocks, which no estimate of its size knows: neither side is for broadcasting
    met = asked.join(index.hint("merge"), ["dim", "g"]).select("block", "query_ids", "queries", "ids", "vectors", "codes", "f")
    found = met.transform(map_arrow, _search(k), "block long, place long, query_id long, vec_id long, score double")
    order = Window.partitionBy("block", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
