"""Suffix dedup, near-duplicates, toxicity and nearest neighbours against brute force, and every odd case."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmata.llm import ann, neardup, suffix, toxicity

EXTRA = "doc_id long, text string, class string, rep string, tag string, label string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "r", "t", "l") for r in rows], EXTRA)


def test_transform_classes():
    rng = random.Random(1)
    for n, kinds, least in ((300, 2, 5), (1000, 3, 7), (50, 1, 4), (2000, 2, 100)):
        s = np.array([rng.randrange(kinds) + 1 for _ in range(n)] + [0])
        if least == 100:
            s[1200:1900] = s[:700]
        order, first = suffix.transform_classes(s, least)
        twice = np.concatenate([s, s])
        prefixes = [tuple(twice[i : i + least]) for i in order]
        assert prefixes == sorted(prefixes)
        assert first[0] and all(bool(first[i]) == (prefixes[i] != prefixes[i - 1]) for i in range(1, len(prefixes)))


def test_transform_works_on_runs(monkeypatch):
    rng = random.Random(3)
    passage = [rng.randrange(60) + 1 for _ in range(400)]
    s = np.array([x for i in range(60) for x in (*passage[i % 7 : 200 + 3 * i], 0)])
    made = []
    repeat = np.repeat
    monkeypatch.setattr(suffix.np, "repeat", lambda *args: made.append(len(out := repeat(*args))) or out)
    order, first = suffix.transform_classes(s, 100)
    monkeypatch.undo()
    assert sum(made) < len(s)  # places looked at in all intervals together; place by place they are 6 times the symbols
    twice = np.concatenate([s, s])
    prefixes = [tuple(twice[i : i + 100]) for i in order]
    assert prefixes == sorted(prefixes) and [bool(f) for f in first] == [i == 0 or prefixes[i] != prefixes[i - 1] for i in range(len(s))]


def test_transform_of_very_many_suffixes():
    n, least = (1 << 21) + 50_000, 8  # ranks and the suffix's number do not fit one key
    s = np.random.default_rng(5).integers(0, 200, n)
    s[1_500_000:1_600_000] = s[:100_000]
    order, first = suffix.transform_classes(s, least)
    key = np.zeros(n, np.uint64)
    for i in range(least):
        key = (key << np.uint64(8)) | np.roll(s, -i).astype(np.uint64)
    key = key[order]
    assert (np.bincount(order, minlength=n) == 1).all() and (key[1:] >= key[:-1]).all()
    assert first[0] and (first[1:] == (key[1:] != key[:-1])).all()


def test_anchors_by_piece(monkeypatch):
    rng = random.Random(6)
    sizes = [0, 300, 20, 5000, 0, 99, 100, 700, 1200, 40, 0]
    data = np.array([rng.randrange(3) + 97 for _ in range(sum(sizes))], np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    want = suffix.anchors(data, offsets)
    whole, seen = suffix.anchors, []
    monkeypatch.setattr(suffix, "anchors", lambda part, *args: seen.append(len(part)) or whole(part, *args))
    monkeypatch.setattr(suffix, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(want, suffix.anchors_by_piece(data, offsets), strict=True))
    assert max(seen) == 5000 and sum(seen) == len(data) and sum(x > 1000 for x in seen) == 2  # single texts that are longer


def plain_removal(rows, least=100):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - least + 1):
            w = b[a : a + least]
            if w in seen:
                gone[a : a + least] = b"\1" * least
            else:
                seen.add(w)
        runs = sum(1 for j, x in enumerate(gone) if x and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(200)
    rows = [(i, text(30) + passage[rng.randrange(40) :] + text(20)) for i in range(60)]
    rows += [(100 + i, base) for i in range(20)] + [(200 + i, base[: 300 + i] + "X" + base[300 + i :]) for i in range(20)]
    rows += [(300, "ab" * 400), (301, "Of " * 300), (302, None), (303, ""), (304, "z" * 99), (305, "z" * 100), (306, "z" * 101), (307, "z" * 99), (308, base + base), (308, base + base), (-5, passage), (None, base)]
    want = plain_removal(rows)
    for how in ({}, {"group": 4}, {"symbols": 3000}):
        got = suffix.remove_repeats(table(spark, rows).repartition(5), **how).collect()
        assert len(got) == len(rows)
        assert [r for r in got if tuple(r)[1:] != want[r["doc_id"]]] == []
    assert suffix.remove_repeats(table(spark, [])).count() == 0
    assert suffix.remove_repeats(table(spark, [(1, None), (2, "short")])).count() == 2


def test_suffix_dedup_of_repeated_rows(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    passage, other = text(40), text(40)
    rows = [(1, text(80))] * 2 + [(2, text(80))] * 5 + [(None, text(80))] * 3  # nowhere else
    rows += 3 * [(10 + i, text(20) + passage + text(20)) for i in range(12)]  # in part elsewhere, in many contexts
    rows += [(40, other + text(9))] * 2 + [(41, other)] * 2 + [(39, "x" + other)] * 4 + [(50, "ab" * 300)] * 2
    want = plain_removal(rows)
    assert want[1][1] == want[2][1] == want[None][1] == 0 and want[41][1] == len(other)
    for parts in (1, 7):
        for how in ({}, {"group": 2}, {"symbols": 500}):
            got = suffix.remove_repeats(table(spark, rows).repartition(parts), **how).collect()
            assert len(got) == len(rows)
            assert [r for r in got if tuple(r)[1:] != want[r["doc_id"]]] == [], (parts, how)


def plain_components(rows, width, similarity):
    import re

    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] == rows[b][0] and sets[a] == sets[b]
            both = len(sets[a] & sets[b])
            if same or sets[a] and sets[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None and sets[i]:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return [(r[0], len(s), least.get(top(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(6)
    words = [f"W{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 14)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 % 211, " ".join(copy)))
    rows += [(500 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(30)]
    rows += [(600, "one"), (601, "ONE"), (602, None), (603, ""), (604, " \t"), (605, "one two"), (606, "One  two"), (None, rows[0][1]), (700, rows[3][1].upper()), (701, "Of " * 9000), (702, "of " * 50)]
    got = neardup.near_duplicates(table(spark, rows), width=width, similarity=80).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(plain_components(rows, width, 80), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_bucket(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):  # about as far from each other as from a link
        copy = list(base)
        for j in rng.sample(range(40), 6):
            copy[j] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = neardup.near_duplicates(table(spark, rows), width=1, similarity=80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, 1, 80))


def test_first_common_band_is_that_of_the_keys():
    full = np.random.default_rng(2).integers(0, 1 << 63, (1, neardup.BINS)).astype(np.uint64).repeat(2, axis=0)
    full[1, 0] ^= np.uint64(1 << 40)
    keys, words = neardup.band_keys(full), np.arange(50, dtype=np.uint64).tobytes()
    assert keys[0, 0] != keys[1, 0] and (keys[0, 1:] == keys[1, 1:]).all()
    linked = neardup._compare(80)
    rows = {"class": [b"a", b"b"], "label": [b"a", b"b"], "asks": [True, False], "bits": [np.zeros(neardup.WORDS, np.uint64).tobytes()] * 2, "keys": [x.tobytes() for x in keys], "shingles": [words, words]}
    assert [linked(pa.table({**rows, "band": [band] * 2})).num_rows for band in (1, 2)] == [1, 0]


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 30, 900, 20000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 9 :], rng.integers(0, 1 << 63, n // 7).astype(np.uint64)]))
        bits = neardup.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(a, b))


def test_one_of_identical_rows_stays(spark):
    text, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, text), (5, text), (5, other), (6, other), (9, text), (None, "k l m n o p"), (None, "k l m n o p"), (7, None), (7, None), (8, "x y z"), (5, text + " i")]
    got = neardup.deduplicated(table(spark, rows), width=5, similarity=80).collect()
    stay = sorted((r["doc_id"] or 0, (r["text"] or "")[:15]) for r in got)  # which of two linked rows stays is free
    assert stay == [(0, "k l m n o p"), (5, text), (5, other), (7, ""), (7, ""), (8, "x y z")]
    assert got[0]["label"] == "l" and len(got[0]) == 6


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.deduplicated(table(spark, [(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f")])).count() == 3


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100, 3000):
        both = np.unique(rng.integers(0, 1 << 63, n * 8).astype(np.uint64))
        cut = max(1, len(both) // 10)
        a, b = both[cut:] if len(both) > cut else both, both[:-cut] if len(both) > cut else both
        s = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != 0).all()
        assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 16)) + 3 * rng.normal(size=(8, 16))[np.arange(400) % 8]
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(400)] + [(1000 + i, [1.0] * 16) for i in range(30)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [float("inf")] * 16), (2250, [1.0, 2.0]), (None, [1.0] * 16), (50, [float(np.float32(x)) for x in v[50]])]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "vec_id long, embedding array<float>, dim string, g int")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.array(x)) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    for i, x in ok:
        if i % 50:
            continue
        near = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), j) for j, y in ok if j != i and len(y) == len(x))[:5]
        times = sum(j == i for j, _ in ok)
        found = sorted(got.get(i, []))
        assert [f[1] for f in found] == [j for _, j in near for _ in range(times)], i
        assert np.allclose([f[2] for f in found], [-s for s, _ in near for _ in range(times)])
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0


def test_blocks_are_not_broadcast(spark):
    rows = [(i, [float(i % 7 + 1), float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df, df.filter("vec_id % 50 = 0"), 5)
    assert found.count() == 20
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 64))
    codes, f = ann.encode(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(5):
        about, off = ann.estimates(ann.rotated(unit[i : i + 1])[0], codes, f)
        assert (np.abs(about - unit @ unit[i]) <= off).mean() > 0.995


def _toxic_rows(n, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("the", "on", "er", "in", "sh") for b in ("ed", "ly", "an", "or", "ti")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "vilemuck", "Vileness"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    import zlib

    rows, labels = _toxic_rows(500)
    odd = [(9000, None), (9001, ""), (9002, "... !"), (None, "theed only"), (3, rows[3][1])]
    lab = spark.createDataFrame([(*x, 1) for x in labels] + [(9000, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(table(spark, rows + odd), lab).collect()
    assert len(got) == len(rows) + len(odd)
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["score"] == 0 and by[i]["predicted"] == 0 for i in (9000, 9001, 9002))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1) for r in got)
    assert toxicity.score(table(spark, []), lab.limit(0)).count() == 0
    assert {r["score"] for r in toxicity.score(table(spark, odd), lab.limit(0)).collect()} == {0.0}


def test_gradients():
    rng = np.random.default_rng(0)
    m = toxicity.Model(np.zeros(0, np.uint64), {k: v.astype(np.float64) for k, v in toxicity._start(rng, 0).items()})
    x, step = rng.normal(size=(5, toxicity.INPUT)), rng.integers(-1, 5, (6, 3))
    step[0] = 1
    d_out = np.array([0.5, -0.3, 0.2])
    keep = {}
    m.run(m.into(x), step, keep)
    g, d_x = m.gradients(x, step, keep, d_out)
    loss = lambda: float((m.run(m.into(x), step) * d_out).sum())
    for name in ("in", "bias", "own", "look", "weigh", "out"):
        p = m.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])) + 2e-3, name


def test_letter_gradients():
    rng = np.random.default_rng(1)
    text = b"abc zebra a quiz"
    w = toxicity.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    m = toxicity.Model(np.zeros(0, np.uint64), {k: v.astype(np.float64) for k, v in toxicity._start(rng, 0).items()})
    (gram, count), (seen, begin) = toxicity.grams(w), toxicity.characters(w)
    assert [bytes(x) for x in seen[begin]] == [b"\0" + bytes(w.data[a : a + 2]) if n > 1 else b"\0" + bytes(w.data[a : a + 1]) + b"\0" for a, n in zip(w.start, w.length, strict=True)]
    d_x = rng.normal(size=(len(count), toxicity.INPUT))
    inputs = lambda keep=None: m.inputs(np.zeros(len(count), np.int64), gram, count, seen, begin, keep)
    keep = {}
    inputs(keep)
    found = dict(zip(("filter", "byte"), m.letter_gradients(seen, keep["place"], d_x), strict=True))
    for name, g in found.items():
        p = m.p[name]
        for at in [(0, 0), (3, 2)] if name == "filter" else [(0, 1), (ord("a"), 0), (ord("z"), 3), (ord("q"), 2)]:
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = float((inputs() * d_x).sum())
            p[at] = old - eps
            down = float((inputs() * d_x).sum())
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-3, (name, at)


def test_words_in_slices_are_the_words():
    rng = random.Random(2)
    texts = [b" ".join(rng.choice([b"Abc", b"x", b"", b"zebra'd", b"-", "é".encode()]) for _ in range(rng.randrange(30))) for _ in range(50)]
    whole = toxicity.words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for most in (40, 1 << 20):
        w = toxicity.words_of(texts, most)
        assert (w.hashed == whole.hashed).all() and (w.which == whole.which).all() and (w.offsets == whole.offsets).all()
        assert [bytes(w.data[a : a + n]) for a, n in zip(w.start, w.length, strict=True)] == [bytes(whole.data[a : a + n]) for a, n in zip(whole.start, whole.length, strict=True)]


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_where_a_class_has_no_words(spark, toxic):
    docs = [(i, "... !" if i % 2 == toxic else "some words here") for i in range(40)] + [(100, "... ?"), (101, "other words")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, docs), labels).collect()}
    assert got[100] == 0 and (got[101] > 0.99) == (toxic == 0) and (got[101] < 0.01) == (toxic == 1)


def test_toxicity_learns_once_from_repeated_rows_and_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CLEAN_WINDOWS", 16)
    long = " ".join(f"w{i}" for i in range(5000))
    labels = spark.createDataFrame([(2, 0), (2, 0), (3, 1), (3, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.sample(table(spark, [(2, long)] * 50 + [(3, "both ways"), (4, "bad words"), (4, None), (None, "x")]), labels).collect()
    taught = {r["toxic"]: bytes(r["taught"]).decode().split() for r in rows}
    folds = {i: __import__("zlib").crc32(str(i).encode()) % 3 != 1 for i in (2, 4)}
    assert len(rows) == sum(folds.values()) and set(taught) == {0 if i == 2 else 1 for i, f in folds.items() if f}
    if folds[2]:
        assert len(taught[0]) == 16 * toxicity.STRIDE and taught[0][0] == "w0" and taught[0][-1] == "w4999"


def test_windows_overlap_and_cover():
    w = toxicity.words(np.frombuffer(b" ".join(b"w%d" % i for i in range(130)), np.uint8), np.array([0, len(b" ".join(b"w%d" % i for i in range(130)))]))
    step, whose = toxicity.windows(w)
    assert step.shape == (toxicity.WINDOW, 1 + -(-(130 - toxicity.WINDOW) // toxicity.STRIDE)) and set(step[step >= 0].tolist()) == set(range(130))
