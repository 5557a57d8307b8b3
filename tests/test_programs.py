"""Programs as data against the bounded prover, which searches depth first, and odd programs."""

import random

import pytest
from pyspark.sql import functions as F

from lemmata.operators import programs, prover

START = ":- set_prolog_flag(unknown, fail).\n:- use_module(library(lists)).\n% --- context KB ---\n"


def some_program(rng, wild):
    """Facts of four predicates and rules of five, each over those before it, some of them negated."""
    constants, facts, heads = ["a", "b", "c", "'x y'", "7"], {"e": 2, "f": 1, "g": 2, "h": 0}, {"r0": 1, "r1": 2, "r2": 1}
    atom = lambda q, args: f"{q}({', '.join(args)})" if args else q
    lines = []
    for _ in range(rng.randrange(3, 12)):
        q = rng.choice(list(facts))
        lines.append(atom(q, [rng.choice(constants + ["_"] * wild) for _ in range(facts[q])]) + ".")
    for i, (head, n) in enumerate(heads.items()):
        below = facts | {k: v for k, v in heads.items() if int(k[1]) < i}
        full = [q for q in below if below[q]]
        for _ in range(rng.randrange(3)):
            own, body = ["X", "Y"][:n], []
            for v in own:
                q = rng.choice(full)
                args = [rng.choice(["X", "Y", "Z", "_", *constants]) for _ in range(below[q])]
                args[rng.randrange(len(args))] = v
                body.append(atom(q, args))
            if rng.random() < (0.1 if wild else 0.4):
                q = rng.choice(list(below))
                body.append("\\+ " + atom(q, [rng.choice([*own, "_", *constants]) for _ in range(below[q])]))
            lines.append(f"{atom(head, own)} :- {', '.join(body)}.")
    q = rng.choice([*heads, "e"])
    goal = atom(q, [rng.choice(["X", "Y", "_", *constants]) for _ in range((heads | facts)[q])])
    return START + "\n".join(lines), goal + (", f(X)" if rng.random() < 0.3 else "")


@pytest.mark.parametrize("wild", [False, True])
def test_random_programs(spark, wild):
    rng = random.Random(11 + wild)
    rows = [(i, *some_program(rng, wild)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, program string, goal string")
    assert df.filter(programs.is_flat(F.col("program"), F.col("goal"))).count() == 200
    got = {r["id"]: (r["entails"], r["values"], r["error"]) for r in programs.answered(df).collect()}
    wrong = [(p, g, got[i], want) for i, p, g in rows if got[i] != (want := prover.answer(p, g))]
    assert wrong == []
    assert sum(v[0] for v in got.values()) > 10 and any(len(set(v[1])) < len(v[1]) for v in got.values())


def test_odd_programs(spark):
    path = "e(a, b).\ne(b, c).\np(X, Y) :- p(X, Z), e(Z, Y).\np(X, Y) :- e(X, Y)."
    rows = [
        (1, path, "p(a, c)", (True, [], None)),  # left recursion ends
        (2, path, "?- p(a, X).", (True, ["c", "b"], None)),  # by the first rule first
        (3, "e(a, b).\ne(b, a).\np(X, Y) :- e(X, Y).\np(X, Y) :- e(X, Z), p(Z, Y).", "p(a, X)", (None, [], "timeout")),  # proofs without end
        (4, "p :- \\+ q.\nq :- \\+ p.", "p", (None, [], "a predicate depends on its own negation")),
        (5, "p :- \\+ q.\nq :- \\+ r.", "p", (False, [], None)),
        (6, None, "p", (False, [], None)),
        (7, "p.", "", (None, [], "empty goal")),
        (8, "p.", None, (None, [], "empty goal")),
        (9, "p(1).\np(X) :- X = 2.", "p(X)", (True, ["1", "2"], None)),  # not flat: the prover
        (10, "p('B c').  % said so\np('d').", "p(X)", (True, ["'B c'", "d"], None)),
        (11, "eq(X, X).", "eq(a, b)", (False, [], None)),  # relations cannot hold it
        (12, "p(X) :- \\+ q(X).\nq(b).", "p(a)", (True, [], None)),
        (13, "p(_).", "p(X)", (True, ["_"], None)),
        (14, "p(a).\np(a).", "p(X), p(Y)", (True, ["[a,a]"] * 4, None)),
        (15, "p(a).", "q(X)", (False, [], None)),
        (1, path, "p(a, c)", (True, [], None)),
        (None, "p(a", "p(X)", (False, [], None)),  # a broken clause is none
    ]
    df = spark.createDataFrame([(r[0], r[1], r[2], "k", 1) for r in rows], "id long, program string, goal string, kb string, flat int").repartition(3)
    got = programs.answered(df, most_rounds=5)
    assert got.columns == ["id", "program", "goal", "kb", "flat", "entails", "values", "error"]
    found = got.collect()
    assert len(found) == len(rows)
    want = {r[0]: r[3] for r in rows}
    assert [(r["id"], r["entails"], r["values"], r["error"]) for r in found if (r["entails"], r["values"], r["error"]) != want[r["id"]]] == []
    assert programs.answered(df.limit(0)).count() == 0


def test_no_job_for_each_rule(spark):
    """Many more rules and knowledge bases take as many jobs."""

    def jobs(n):
        rows = [(i, "\n".join(f"q{k}(c{k}).\np{k}(X) :- q{k}(X)." for k in range(i % n + 1)), f"p{i % n}(X)") for i in range(n)]
        df = spark.createDataFrame(rows, "id long, program string, goal string")
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert [r["values"] for r in programs.answered(df).orderBy("id").collect()] == [[f"c{i % n}"] for i in range(n)]
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30) <= jobs(2) + 15  # adaptive execution may start a job for an exchange more or less


def test_evaluation_broadcasts_nothing(spark, monkeypatch):
    """What is executed is dealt by the knowledge base, whatever the files' sizes say; settings are as before."""
    plans, keep = [], programs.keep

    def kept(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, **options)

    monkeypatch.setattr(programs, "keep", kept)
    names = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(x, None) for x in names]
    df = spark.createDataFrame([(1, "e(a, b).\nu(c).\np(X) :- e(X, Y), \\+ e(Y, X).", "p(X)")], "id long, program string, goal string")
    assert [tuple(r) for r in programs.answered(df).select("entails", "values").collect()] == [(True, ["a"])]
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)
    assert [spark.conf.get(x, None) for x in names] == before
