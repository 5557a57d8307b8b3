"""Periodic runs, the link graph and the filter audit against brute force and plain loops, with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lemmata.llm import lattice, linkgraph, periodic, queries

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 12)), max_size=8))
def test_runs_of_repeated_words(parts):
    w = [x for unit, times in parts for x in unit * times]
    assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_periods_and_of_runs_in_runs():
    rng = random.Random(5)
    for kinds, many in ((1, 5), (2, 60), (3, 60), (300, 30)):
        for _ in range(many):
            w = []
            while len(w) < 500:
                unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 60))]
                if rng.random() < 0.5:  # runs within the unit, so that blocks are periodic themselves
                    unit += unit[:2] * rng.randrange(3, 14)
                w += (unit * 9)[: rng.randrange(1, 9 * len(unit))] + [rng.randrange(kinds)] * rng.randrange(6)
            assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def plain_digests(i, text):
    w = [x for x in SPLIT.split(text or "") if x]
    n, h = len(w), zlib.crc32(b"" if i is None else str(i).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *told, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cé d\u00a0e f g".split(" ")) for _ in range(rng.randrange(90)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (303, "no no no no no no"), (304, "a b " * 2000), (305, "x\x85x " * 9), (306, "A a " * 9), (None, "of of of of of of of"), (303, "no no no no no no"), (-7, "la " * 30)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
    d = write(spark, tmp_path, documents=([(*r, 5, "h", "p") for r in rows], "doc_id long, text string, n long, runs string, words string"))
    got = queries.op11_periodic_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_digests(*r) for r in rows)


def test_no_documents(spark, tmp_path):
    d = write(spark, tmp_path, documents=([], "doc_id long, text string, source string"), labels=([], "doc_id long, quality int, toxic int"), pages=([], "page_id long, url string, html string"))
    for name in ("op11_periodic_runs", "op12_link_graph", "op13_filter_audit"):
        assert queries.queries()[name](spark, d).count() == 0


# links


def plain_verdicts(pages, rules, rounds=20):
    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]

    def told(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.host + r.path), default=None)

    seen, edges = Counter(), set()
    for _, url, html in pages:
        own = parse(url)
        targets = [parse(("http:" if x.startswith("//") else "") + x) for x in re.findall(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'>\s]+)""", html or "")]
        for host, path in [own, *targets]:
            if host:
                seen[host, getattr(told(host, path), "verdict", None)] += 1
        edges |= {(own[0], h) for h, _ in targets if own[0] and h and h != own[0]}
    score = {}
    for kind, way in (("allow", edges), ("block", {(b, a) for a, b in edges})):
        degree = Counter(a for a, _ in way)
        now = {h: 10**9 * seen[h, kind] // sum(n for (x, _), n in seen.items() if x == h) for h, _ in seen}
        total = Counter(now)
        for _ in range(rounds):
            step = Counter()
            for a, b in way:
                step[b] += now.get(a, 0) // (20 * degree[a]) * 17
            now = step
            total.update(now)
        score[kind] = total
    out = []
    for i, url, _ in pages:
        host, path = parse(url)
        rule = told(host, path)
        bad = bool(host) and score["block"][host] > score["allow"][host] and 2 * score["block"][host] >= 10**9
        out.append((i, host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if bad else "allow"))
    return out


def test_link_graph(spark):
    rng = random.Random(2)
    hosts = [f"{a}.{b}" for a in ("a", "b", "www.c", "d") for b in ("example.com", "example.org", "example.net", "site.io", "net", "org")]
    path = lambda: rng.choice(("", "/", "/de/x", "/en/x", "/fr/x", "/en", "/x?y=://z/de/", "/x#y"))
    link = lambda: rng.choice(('<a href="{}">', "<A HREF = '{}'>", "<a class=x href={}>", '<link href="{}"/>')).format(rng.choice(("http://", "HTTPS://", "//")) + rng.choice(hosts) + path())
    rows = [(i, "http://" + rng.choice(hosts) + path(), "<p>" + "".join(link() for _ in range(rng.randrange(3)))) for i in range(60)]
    # farms that link to what is blocked, a friend of what is allowed, a hub
    rows += [(100, "http://farm.io/1", '<a href="http://bad.net/">'), (101, "http://farm.io/2", '<a href="http://worse.net/q">'), (102, "http://far.io/", '<a href="//farm.io/"><a href="/near">'), (103, "http://x.org/fr/", '<a href="http://friend.io/">'), (104, "http://friend.io/", '<a href="http://bad.net/">')]
    rows += [(200 + i, "http://hub.io/", f'<a href="http://h{i}.io/">') for i in range(40)]
    rows += [(300, None, None), (301, "no url", "<a href=http://bad.net/>"), (302, "://", ""), (303, "http://", ""), (304, "HTTP://WWW.NET/", None), (305, "x://É.Org/fr/", ""), (306, "http://notnet/", ""), (307, "http://net", ""), (307, "http://net", ""), (None, "http://farm.io/3", ""), (308, "a://b\nc.net/x\ny", "")]
    df = spark.createDataFrame([(*r, "h", "v", 1) for r in rows], "page_id long, url string, html string, host string, verdict string, n int")
    got = Counter(map(tuple, linkgraph.judge(df.repartition(4)).collect()))
    want = plain_verdicts(rows, linkgraph.RULES)
    assert got == Counter(want)
    assert {r[4] for r in want if r[0] in (100, 101)} == {"block"} and [r[4] for r in want if r[0] == 104] == ["allow"]


def test_rules_of_one_length_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.bc/d/e", None)], "page_id long, url string, html string")
    rules = (linkgraph.Rule("block", "bc", "/d/e"), linkgraph.Rule("allow", "a.bc", "/d"))
    assert linkgraph.judge(df, rules).collect()[0]["rule"] == "a.bc/d"  # the longer host
    assert linkgraph.judge(df, ()).collect()[0]["verdict"] == "allow"


# audit


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    judged = []
    for i, t, source in docs:
        t = t or ""
        w = [x for x in SPLIT.split(t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((source or "", i, {f for f in fails if fails[f]}))
    out = []
    for part in {p for p, *_ in judged}:
        removed_in_all = Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in judged if p == part]
            gone = []
            for k, x in enumerate(order):
                away, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                rows.append((part, "".join(order), k + 1, len(left), len(away), sum(x in f for _, f in gone), sum(f == {x} for p, _, f in judged if p == part), sum(i in good for i, _ in away), sum(i in toxic for i, _ in away)))
                removed_in_all[x] += len(away)
                gone += away
        out += [(*r, removed_in_all[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(("aa", "Bb", "cc", "d%", "éé", "f", str(rng.randrange(500)))) for _ in range(rng.randrange(30, 110)))
    copies = [text() for _ in range(6)]
    docs = [(i, rng.choice(copies) if rng.random() < 0.4 else text(), rng.choice(("a", "b", None, ""))) for i in range(200)]
    docs += [(300, None, "n"), (301, "", "n"), (302, None, None), (None, copies[0], "a"), (None, "", "n"), (5, docs[5][1], docs[5][2]), (5, docs[5][1], "b"), (303, "word " * 5000, "a"), (304, "\u00a0" * 60, "a"), (-1, copies[1], "a")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 310, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, True) for r in docs], "doc_id long, text string, source string, part int, A boolean").repartition(5)
    got = lattice.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_of_other_filters(spark):
    judged = spark.createDataFrame([("p", True, None), ("p", False, True), ("p", True, True)], "part string, x boolean, y boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in lattice.audit(judged, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (0, 1, 1, 1, 3), ("yx", 1): (1, 2, 0, 1, 3), ("yx", 2): (0, 1, 1, 1, 3)}
