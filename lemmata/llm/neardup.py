"""MinHash near-duplicates by fast similarity sketching.

A sketch has BINS coordinates. In round i every element of a set hashes to one bin and a value that is above all of the
rounds before; in rounds BINS .. 2 BINS - 1 every element goes to bin i - BINS. So every coordinate fills, in one or few
rounds for all but tiny sets, and agreeing coordinates concentrate as those of independent MinHash do. Bands of the sketch
give buckets, and every link is confirmed on the full sets.

Equal sets are one class from the start. In a bucket of many classes no list of all pairs is made. First, STARS times, the
class that shares most buckets is the bucket's centre and is compared with the members that are not yet in its component;
a group of m near copies becomes one component with about m comparisons. What then lies between different components in a
bucket is compared in blocks of bounded rows and bytes, in the first bucket that two classes share, on the full sets. Pairs
that cannot be links are left out before by sizes and bitmaps: where two bitmaps differ in more bits than the sets of a link
can differ in shingles, there is no link, whatever the sketches say. A block gives links between components that it does
not know to be connected yet, so no more of them than it has components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lemmata.llm.common import forget, keep, mix64, runs, slices, text_buffers
from lemmata.shipping import map_arrow, ship

#: Coordinates of a sketch and of a band. A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7.
BINS, BAND = 128, 4
#: Rounds of centres; rows and bytes of shingles of a bucket in one block; rows of a bucket that are joined by one key; words
#: of 64 bits in a bitmap.
STARS, BLOCK, BLOCK_BYTES, SALT, WORDS = 2, 2048, 16 << 20, 512, 32
_SHIFT = np.uint64(64 - 7)
_is_word = np.ones(256, bool)
_is_word[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, one text after another, and n + 1 offsets.

    With fewer than ``width`` words, the whole sequence is the one shingle; without words there is none.
    """
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = _lower[data]
    start, _, word = runs(data, offsets, _is_word[data])
    at = np.searchsorted(start, offsets)
    count = np.diff(at)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    whose = np.repeat(np.arange(n), each)
    first = at[:-1][whose] + np.arange(len(whose)) - np.repeat(np.cumsum(each) - each, each)
    size = np.minimum(width, count[whose])
    code = size.astype(np.uint64)
    for j in range(width):
        more = mix64(code * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(first + j, max(0, len(word) - 1))]) if len(word) else code
        code = np.where(j < size, more, code)
    order = np.lexsort((code, whose))
    code, whose = code[order], whose[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])
    code, whose = code[new], whose[new]
    return code, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int64)


def sketches(code: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """n x bins sketches of the sets; those of empty sets are zero and mean nothing."""
    n = len(offsets) - 1
    out, filled = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    filled[np.diff(offsets) == 0] = True
    whose = np.repeat(np.arange(n), np.diff(offsets))
    shift = np.uint64(64 - (bins.bit_length() - 1))
    for i in range(2 * bins):
        open_ = ~filled.all(axis=1)
        if not open_.any():
            break
        if i:
            mine = open_[whose]
            code, whose = code[mine], whose[mine]
        h = mix64(code, i + 1)
        order = np.lexsort((h, whose))
        h, w = h[order], whose[order]
        b = (h >> shift).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        lead = np.ones(len(h), bool)  # the least hash of each set and bin: sorted, the bin is its top bits
        lead[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
        w, b, h = w[lead], b[lead], h[lead]
        new = ~filled[w, b]
        out[w[new], b[new]] = mix64(h[new], 1000 + i)
        filled[w[new], b[new]] = True
    return out


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """n x bands 64-bit keys; a key tells its band too."""
    n, bins = sketch.shape
    key = np.broadcast_to(np.arange(bins // band, dtype=np.uint64), (n, bins // band)).copy()
    for j in range(band):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j::band], j)
    return key


def _class(code: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set; None for an empty one."""
    n = np.diff(offsets)
    full = n > 0
    out = np.zeros((len(n), 2), np.uint64)
    if full.any():
        out[full, 0] = mix64(np.add.reduceat(mix64(code, 77), offsets[:-1][full]) + n[full].astype(np.uint64))
        out[full, 1] = mix64(np.add.reduceat(mix64(code, 78), offsets[:-1][full]) ^ n[full].astype(np.uint64))
    return [out[i].tobytes() if full[i] else None for i in range(len(n))]


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                code, offsets = shingle_sets(batch.column("text"), width)
                keys = band_keys(sketches(code, offsets))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(_class(code, offsets), pa.binary()), bands], names=["doc_id", "n", "class", "bands"])

    return run


def bitmaps(code: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """n x words of bits; a bit is set where an odd number of a set's shingles hash to it.

    Sets that differ in d shingles have bitmaps that differ in d bits at most.
    """
    n = len(offsets) - 1
    whose = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix64(code, 501) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = np.bincount(whose * (64 * words) + bit, minlength=n * 64 * words).reshape(n, -1) & 1
    return np.packbits(odd.astype(bool), axis=1, bitorder="little").view(np.uint64)


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                code, offsets = shingle_sets(batch.column("text"), width)
                raw = memoryview(code).cast("B")
                sets = [bytes(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] if len(code) else [b""] * (len(offsets) - 1)
                bits, keys = (np.concatenate([f(code, offsets[a : a + 257]) for a in range(0, len(offsets) - 1, 256)]) for f in (_bits_of, _keys_of))
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(_class(code, offsets), pa.binary()), pa.array(sets, pa.binary()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (bits, keys))], names=["class", "is", "shingles", "bits", "keys"])

    return run


def _bits_of(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return bitmaps(code[offsets[0] : offsets[-1]], offsets - offsets[0])


def _keys_of(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return band_keys(sketches(code[offsets[0] : offsets[-1]], offsets - offsets[0]))


def _confirm(similarity: int):
    """Linked pairs from rows in order of (center, block, member): a centre's own row, which has no member, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for c, m, x in zip(batch.column("center").to_pylist(), batch.column("member").to_pylist(), batch.column("shingles"), strict=True):
                other = np.frombuffer(x.as_py(), np.uint64)
                if m is None:
                    center, own = c, other
                elif c != center:
                    raise ValueError("a member without its centre")
                elif _linked(own, other, similarity):
                    a.append(min(c, m))
                    b.append(max(c, m))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the table ``edges`` (a, b): the least node that it reaches.

    Each round takes the least label among a node's neighbours, then the label of its label, so chains halve.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        new = keep(step.join(jump, step["label"] == jump["j_node"], "left").select("node", "old", F.least("label", F.coalesce("j_label", "label")).alias("label")), "labels")
        changed = new.filter("old <> label").limit(1).count()
        forget(labels)
        labels = new.select("node", "label")
        labels._lemmata_path = new._lemmata_path
        if not changed:
            forget(both)
            return labels


def _linked(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def _compare(similarity: int):
    """Links between different components in one block of a bucket, of pairs whose first common band is the bucket's."""

    def run(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks"))
        read = lambda name: np.frombuffer(b"".join(block.column(name).to_pylist()), np.uint64).reshape(block.num_rows, -1)
        bits, keys = read("bits"), read("keys")
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("shingles")]
        size = np.array([len(x) for x in sets])
        names, label = block.column("class").to_pylist(), np.unique(block.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        band = int(block.column("band")[0].as_py())
        all_ = np.flatnonzero(~asks)
        out_a, out_b = [], []
        for i in np.flatnonzero(asks):
            other = all_[label[all_] != label[i]]
            other = other[100 * np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i])]
            near, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in np.array_split(other, max(1, len(other) // 1024)):
                differ = np.bitwise_count(bits[part] ^ bits[i]).sum(axis=1, dtype=np.int64)
                # 100 * common >= similarity * union, both written with the number of shingles that are in one set only
                may = np.flatnonzero((100 + similarity) * differ <= (100 - similarity) * (size[part] + size[i]))
                if not len(may):
                    continue
                may = may[(keys[part[may]] == keys[i]).argmax(axis=1) == band]
                near.append(part[may])
                apart.append(differ[may])
            near, apart = np.concatenate(near), np.concatenate(apart)
            for j in near[np.argsort(apart, kind="stable")]:
                if label[j] != label[i] and _linked(sets[i], sets[j], similarity):
                    label[label == label[j]] = label[i]
                    out_a.append(min(names[i], names[j]))
                    out_b.append(max(names[i], names[j]))
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def _many(rows: str, shingles: str):
    """In how many blocks so many rows with so many shingles go."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) * 8 / BLOCK_BYTES)).cast("int")


def _spread(blocks: str):
    return F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int")


def _each(blocks: str):
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (center, class, n) of classes that are linked, as (a, b) in order; n is the size of the class's set.

    A centre's members are dealt into blocks, and its own set is sent once to each block.
    """
    pairs = keep(pairs, "pairs")
    blocks = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("center", _many("m", "s").alias("blocks"))
    members = pairs.join(blocks, "center").select("center", _spread("blocks").alias("block"), F.col("class").alias("member"))
    members = members.join(sets.select(F.col("class").alias("member"), "shingles"), "member").select("center", "block", "member", "shingles")
    centers = blocks.join(sets.select(F.col("class").alias("center"), "shingles"), "center").select("center", _each("blocks").alias("block"), F.lit(None).cast("binary").alias("member"), "shingles")
    rows = members.unionByName(centers).repartition("center", "block").sortWithinPartitions("center", "block", F.col("member").asc_nulls_first())
    linked = keep(rows.transform(map_arrow, _confirm(similarity), "a binary, b binary"), "linked")
    forget(pairs)
    return linked


def links(docs: DataFrame, sketched: DataFrame, width: int, similarity: int) -> DataFrame | None:
    """(class, label) of the classes that are linked with another; None if there is none."""
    classes = sketched.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    # one row of each class gives the bands: equal sets have equal bands
    bands = sketched.filter("class is not null").join(classes.select(F.col("class").alias("c"), "rep"), (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("class", "n", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # a class whose id is on several rows comes several times here; distinct takes it once
    held = keep(bands.join(shared, "key").select("key", "band", "class", "n", "m").distinct(), "buckets")
    weight = held.groupBy("class").agg(F.sum("m").alias("w"))
    # a bucket's rows are dealt by their classes too, so that a large one is not read by one task
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("m") / SALT)).cast("int").alias("salt")
    bucket = keep(held.join(weight, "class").select("key", salt, "band", "class", "n", "w", F.col("class").alias("label"), F.ceil(F.col("m") / SALT).cast("int").alias("salts")), "buckets")
    forget(held)
    if bucket.isEmpty():
        return None
    wanted = bucket.select("class").distinct().join(classes, "class").select("class", "rep")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("class", "text")
    sets = texts.transform(map_arrow, _setter(width), "class binary, is binary, shingles binary, bits binary, keys binary").filter("class = is").dropDuplicates(["class"]).select("class", "shingles", "bits", "keys")
    sets = keep(sets, "sets")
    found: DataFrame | None = None  # the links so far
    tables = []
    for _ in range(STARS):
        best = F.max(F.struct("w", "class", "label", "n")).alias("c")
        by_salt = bucket.groupBy("key", "salt", "salts").agg(best, F.min("label").alias("lo"), F.max("label").alias("hi"))
        top = by_salt.groupBy("key", "salts").agg(F.max("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
        top = top.select("key", _each("salts").alias("salt"), F.col("c.class").alias("center"), F.col("c.label").alias("c_label"), F.col("c.n").alias("c_n"))
        sized = (100 * F.least("n", "c_n")) >= similarity * F.greatest("n", "c_n")
        pairs = bucket.join(top, ["key", "salt"]).filter((F.col("label") != F.col("c_label")) & sized).select("center", "class", "n").distinct()
        linked = _confirmed(pairs, sets, similarity)
        tables.append(linked)
        found = linked if found is None else found.unionByName(linked)
        label = components(found)
        # the centre has been compared with all of its bucket, and leaves
        rest = bucket.join(top.select("key", "salt", "center"), ["key", "salt"]).filter("class <> center").drop("label", "center")
        new = keep(rest.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")), "buckets")
        forget(bucket)
        forget(label)
        bucket = new
    tables.append(keep(_apart(bucket, sets, similarity), "linked"))
    found = found.unionByName(tables[-1])
    out = None if found.isEmpty() else components(found).withColumnRenamed("node", "class")
    for t in (bucket, sets, *tables):
        forget(t)
    return out


def _apart(bucket: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of classes that share a bucket and lie in different components.

    The rows of a bucket's main component are asked by all others, in blocks of at most about BLOCK rows each.
    """
    by_label = bucket.groupBy("key", "label", "salts").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    split = by_label.groupBy("key", "salts").agg(F.max(F.struct("m", "label", "s")).alias("most"), F.sum("m").alias("m_all"), F.sum("s").alias("s_all"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    split = split.withColumn("m_ask", F.col("m_all") - F.col("most.m")).withColumn("s_ask", F.col("s_all") - F.col("most.s"))
    split = split.select("key", _each("salts").alias("salt"), F.col("most.label").alias("main"), _many("m_all", "s_all").alias("all_blocks"), _many("m_ask", "s_ask").alias("ask_blocks"))
    rows = bucket.join(split, ["key", "salt"]).join(sets, "class")
    own = ["key", "band", "class", "label", "bits", "keys", "shingles"]
    told = rows.select(*own, F.lit(False).alias("asks"), _spread("all_blocks").alias("x"), _each("ask_blocks").alias("y"))
    asking = rows.filter("label <> main").select(*own, F.lit(True).alias("asks"), _each("all_blocks").alias("x"), _spread("ask_blocks").alias("y"))
    ship(bucket.sparkSession)
    return told.unionByName(asking).groupBy("key", "x", "y").applyInArrow(_compare(similarity), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Sets of ``width``-word shingles (A-Z as small letters) are linked where 100 * intersection >= ``similarity`` * union.
    ``component_id`` is the smallest id that a document reaches over links, its own included; ``kept`` says that it is its
    own. A text without words, or null, is linked with nothing. A null id is never the smallest while there is another;
    rows that repeat an id share its component where their texts are linked. Extra columns are ignored. An empty table gives
    an empty table.
    """
    sketched, least = _components(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, similarity)
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "class").join(least, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _components(docs: DataFrame, width: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """The written sketches of the rows, and of each class its component (label) and the smallest id in it."""
    sketched = keep(docs.transform(map_arrow, _sketcher(width), "doc_id long, n long, class binary, bands array<long>"), "sketches")
    found = links(docs, sketched, width, similarity)
    least = sketched.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    if found is None:
        return sketched, least.select("class", F.col("class").alias("label"), F.col("rep").alias("component_id"))
    labelled = least.join(found, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label"))
    reached = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return sketched, labelled.join(reached, "label").select("class", "label", "component_id")


def _classes_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                own = pa.array(_class(*shingle_sets(batch.column("text"), width)), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "class"])

    return run


def deduplicated(docs: DataFrame, *, width: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, of the smallest id; other columns are as they were.

    Of rows that repeat an id, one stays of those that are linked, and those whose text is in another's group go. Rows
    without words, or with a null text, are nobody's duplicates and stay. A null id is never the smallest while there is
    another. An empty table gives an empty table.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched, least = _components(given, width, similarity)
    rows = sketched.select("doc_id", "class").join(least, "class", "left")
    kept = rows.filter(F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    # nearly always every id is on one row; rows of the others are told apart by their sets
    repeated = keep(sketched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        ids = kept.select(F.col("doc_id").alias("k")).distinct()
        return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["k"]), "left_semi")
    again = repeated.withColumnRenamed("doc_id", "r")
    once = kept.join(again, kept["doc_id"].eqNullSafe(again["r"]), "left_anti").select(F.col("doc_id").alias("k")).distinct()
    single = docs.join(once, docs["doc_id"].cast("long").eqNullSafe(once["k"]), "left_semi")
    own = F.struct(*(docs[c] for c in docs.columns)).alias("own")
    several = docs.join(again, docs["doc_id"].cast("long").eqNullSafe(again["r"]), "left_semi")
    several = several.select(own).select("own", F.col("own.doc_id").cast("long").alias("doc_id"), F.col("own.text").cast("string").alias("text"))
    schema = StructType([*several.schema.fields, StructField("class", BinaryType())])
    several = several.transform(map_arrow, _classes_of(width), schema)
    known = several.join(least.withColumnRenamed("class", "c"), F.col("class") == F.col("c"), "left")
    wordless = known.filter("class is null").select("own.*")
    one = known.filter(F.col("class").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "label").agg(F.first("own").alias("own")).select("own.*")
    return single.unionByName(wordless).unionByName(one)
