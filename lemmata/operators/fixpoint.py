"""Entailment by relations: facts are rows, rules are joins, recursion is a loop until nothing new is derived.

``fact`` tables are (kb, pred, arity, args array<string>); null in ``args`` is a wildcard that equals anything. Each rule
becomes one join per way in which a body literal can use a fact of the last round (semi-naive evaluation), on the
knowledge base and the shared variables. Negated literals are anti joins; a stratum is complete before it is negated.
Derived facts form a set, so answers are distinct and sorted; a bridge that leads back to itself ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.scratch import keep

#: Rounds of a recursion after which what is known is written as one table: plans stay short however many there are.
COMPACT = 64

FACT = "kb string, pred string, arity int, args array<string>"


@dataclass(frozen=True)
class Literal:
    """A predicate applied to arguments: names that begin with a capital are variables, ``_`` is anything."""

    pred: str
    args: tuple[str, ...] = ()
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...]


def _is_variable(x: str) -> bool:
    return x[:1].isupper() or x[:1] == "_"


def strata(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules in groups that can be evaluated one after another; ValueError if a predicate depends on its own negation."""
    level = {r.head.pred: 0 for r in rules}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            for b in r.body:
                if b.pred in level and level[r.head.pred] < level[b.pred] + b.negated:
                    level[r.head.pred] = level[b.pred] + b.negated
                    changed = True
        if not changed:
            return [[r for r in rules if level[r.head.pred] == k] for k in sorted(set(level.values()))]
    raise ValueError("a predicate depends on its own negation")


def _rows(facts: DataFrame, literal: Literal, tag: int) -> DataFrame:
    """kb and a column for each argument of the facts that a literal can match."""
    x = facts.filter((F.col("pred") == literal.pred) & (F.col("arity") == len(literal.args)))
    for i, a in enumerate(literal.args):
        if not _is_variable(a):
            x = x.filter(F.col("args")[i].isNull() | (F.col("args")[i] == a))
    return x.select("kb", *[F.col("args")[i].alias(f"_{tag}_{i}") for i in range(len(literal.args))])


def _extend(bound: DataFrame | None, facts: DataFrame, literal: Literal, tag: int) -> DataFrame:
    """Bindings so far joined with a literal; its new variables become columns."""
    rows = _rows(facts, literal, tag)
    mine: dict[str, str] = {}
    for i, a in enumerate(literal.args):
        if _is_variable(a) and not a.startswith("_"):
            col = f"_{tag}_{i}"
            if a in mine:  # repeated in one literal
                rows = rows.filter(F.col(col).isNull() | F.col(mine[a]).isNull() | (F.col(col) == F.col(mine[a]))).withColumn(mine[a], F.coalesce(mine[a], col))
            else:
                mine[a] = col
    if bound is None:
        return rows.select("kb", *[F.col(c).alias(v) for v, c in mine.items()])
    rows = rows.select(F.col("kb").alias("_kb"), *mine.values())
    shared = [v for v in mine if v in bound.columns]
    meet = lambda v: (F.col(v) == F.col(mine[v])) | F.col(v).isNull() | F.col(mine[v]).isNull()
    on = reduce(lambda a, b: a & b, [meet(v) for v in shared], F.col("kb") == F.col("_kb"))
    if literal.negated:
        return bound.join(rows, on, "left_anti")
    joined = bound.join(rows, on)
    return joined.select("kb", *[F.coalesce(v, mine[v]).alias(v) if v in mine else F.col(v) for v in bound.columns if v != "kb"], *[F.col(c).alias(v) for v, c in mine.items() if v not in bound.columns])


def _extend_exact(bound: DataFrame, facts: DataFrame, literal: Literal, tag: int) -> DataFrame:
    """As ``_extend`` where no wildcard is possible: an equi-join on the shared variables too."""
    rows = _extend(None, facts, Literal(literal.pred, literal.args), tag)
    keys = ["kb", *[c for c in rows.columns if c != "kb" and c in bound.columns]]
    return bound.join(rows, keys, "left_anti" if literal.negated else "inner")


def derive(rule: Rule, facts: DataFrame, latest: DataFrame | None = None, use_latest: int | None = None, exact: bool = True) -> DataFrame:
    """The facts that one rule gives; body literal ``use_latest`` is taken from ``latest`` only."""
    order = sorted(range(len(rule.body)), key=lambda i: (rule.body[i].negated, i != use_latest, i))
    bound: DataFrame | None = None
    for i in order:
        source = latest if i == use_latest and latest is not None else facts
        if bound is None:
            bound = _extend(None, source, rule.body[i], i)
        else:
            bound = (_extend_exact if exact else _extend)(bound, source, rule.body[i], i)
    values = [F.col(a) if _is_variable(a) and bound is not None and a in bound.columns else F.lit(None if _is_variable(a) else a).cast("string") for a in rule.head.args]
    return bound.select("kb", F.lit(rule.head.pred).alias("pred"), F.lit(len(rule.head.args)).alias("arity"), (F.array(*values) if values else F.array().cast("array<string>")).alias("args")).distinct()


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that a long loop has a short lineage."""
    return keep(df, "facts")


def _recursive(rules: Sequence[Rule]) -> bool:
    heads = {r.head.pred for r in rules}
    return any(b.pred in heads for r in rules for b in r.body)


def transitive(rules: Sequence[Rule]) -> tuple[str, str, bool] | None:
    """(relation, base, whether the base comes first) of rules that say no more than ``r`` is the transitive closure of ``e``."""
    if len(rules) != 2:
        return None
    one, two = sorted(rules, key=lambda r: len(r.body))
    heads = {(r.head.pred, len(r.head.args)) for r in rules}
    if len(heads) != 1 or len(one.body) != 1 or len(two.body) != 2 or any(b.negated or len(b.args) != 2 for r in rules for b in r.body):
        return None
    rel, base = one.head.pred, one.body[0].pred
    (a, c), (p, q) = two.head.args if len(two.head.args) == 2 else ("", ""), two.body
    names = {a, c, p.args[1]}
    chain = len(names) == 3 and all(_is_variable(x) and not x.startswith("_") for x in names) and p.args == (a, p.args[1]) and q.args == (p.args[1], c)
    plain = one.head.args == one.body[0].args and len(set(one.head.args)) == 2 and all(_is_variable(x) and not x.startswith("_") for x in one.head.args)
    if not chain or not plain or base == rel or {p.pred, q.pred} != {rel, base}:
        return None
    return rel, base, p.pred == base


def _doubled(facts: DataFrame, rel: str, base: str, base_first: bool, most_rounds: int | None) -> DataFrame:
    """The facts of a transitive closure, by paths of doubling length.

    ``known`` holds all paths of up to 2**k steps and ``power`` those of 2**k; a path of up to twice as many is one of the
    second and one of the first. So a chain of n steps takes about log n rounds, and each of its pairs is found once.
    """
    pairs = lambda pred: facts.filter((F.col("pred") == pred) & (F.col("arity") == 2)).select("kb", F.col("args")[0].alias("a"), F.col("args")[1].alias("b")).distinct()
    then = lambda x, y: x.select("kb", "a", F.col("b").alias("m")).join(y.select("kb", F.col("a").alias("m"), "b"), ["kb", "m"]).select("kb", "a", "b")
    known = power = _written(pairs(base))
    for done in count(1):
        new = _written(then(power, known).distinct().join(known, ["kb", "a", "b"], "left_anti"))
        if new.isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError(f"recursive rules still find facts in round {done}")
        known, power = known.unionByName(new), _written(then(power, power).distinct())
    given = pairs(rel)
    if not given.isEmpty():  # facts of the relation itself go on along the base
        known = known.unionByName(given).unionByName(then(known, given) if base_first else then(given, known)).distinct()
    return known.select("kb", F.lit(rel).alias("pred"), F.lit(2).alias("arity"), F.array("a", "b").alias("args"))


def closure(facts: DataFrame, rules: Sequence[Rule], *, wildcards: bool = False, most_rounds: int | None = None) -> DataFrame:
    """``facts`` and everything that the rules derive from them. Without recursion the whole is one plan.

    ``wildcards`` says that facts may hold nulls, which equal anything; joins are then on the knowledge base alone with
    the arguments as a condition. A recursive rule is followed until nothing is new; where ``most_rounds`` is given and
    does not suffice, that is an error. Rules that are a transitive closure are followed by paths of doubling length.
    """
    facts = facts.select("kb", "pred", "arity", "args")
    for group in strata(rules):
        if not _recursive(group):
            facts = reduce(DataFrame.unionByName, [derive(r, facts, exact=not wildcards) for r in group], facts).distinct()
            continue
        if not wildcards and (found := transitive(group)):
            own = (F.col("pred") == found[0]) & (F.col("arity") == 2)
            facts = facts.filter(~own).distinct().unionByName(_doubled(facts, *found, most_rounds))
            continue
        known = _written(facts.distinct())
        latest: DataFrame = known
        for done in count(1):
            heads = {r.head.pred for r in group}
            first = latest is known
            parts = []
            for r in group:
                uses = [i for i, b in enumerate(r.body) if b.pred in heads and not b.negated]
                if first:
                    parts.append(derive(r, known, exact=not wildcards))
                else:
                    parts += [derive(r, known, latest, i, exact=not wildcards) for i in uses]
            new = reduce(DataFrame.unionByName, parts).distinct()
            old = known.select(F.col("kb").alias("k"), F.col("pred").alias("p"), F.col("arity").alias("n"), F.col("args").alias("a"))
            latest = _written(new.join(old, (F.col("kb") == F.col("k")) & (F.col("pred") == F.col("p")) & (F.col("arity") == F.col("n")) & F.col("args").eqNullSafe(F.col("a")), "left_anti"))
            if latest.isEmpty():
                break
            if done == most_rounds:
                raise RuntimeError(f"recursive rules still find facts in round {done}")
            known = known.unionByName(latest)
            if done % COMPACT == 0:
                known = _written(known)
        facts = known
    return facts


def entailed(goals: DataFrame, facts: DataFrame, wildcards: bool = False) -> DataFrame:
    """``goals`` (kb, pred, arity, args without variables) with ``entails``; what no fact says is false."""
    right = facts.select(F.col("kb").alias("_kb"), F.col("pred").alias("_p"), F.col("arity").alias("_n"), F.col("args").alias("_a")).distinct()
    on = (F.col("kb") == F.col("_kb")) & (F.col("pred") == F.col("_p")) & (F.col("arity") == F.col("_n"))
    if not wildcards:
        joined = goals.join(right.withColumn("_hit", F.lit(True)), on & (F.col("args") == F.col("_a")), "left")
        return joined.select(*goals.columns, F.coalesce("_hit", F.lit(False)).alias("entails"))
    # goals and facts without wildcards meet by their arguments; only what holds one is compared within its predicate
    open_ = lambda c: F.exists(c, lambda x: x.isNull())
    same = F.forall(F.arrays_zip("args", "_a"), lambda x: x["args"].isNull() | x["_a"].isNull() | (x["args"] == x["_a"]))
    asked = goals.select("kb", "pred", "arity", "args").distinct()
    exact, some = right.filter(~open_("_a")), right.filter(open_("_a"))
    hits = asked.join(exact, on & (F.col("args") == F.col("_a")), "left_semi")
    hits = hits.unionByName(asked.filter(open_("args")).join(exact, on & same, "left_semi")).unionByName(asked.join(some, on & same, "left_semi")).distinct()
    hits = hits.select(F.col("kb").alias("_kb"), F.col("pred").alias("_p"), F.col("arity").alias("_n"), F.col("args").alias("_a"), F.lit(True).alias("_hit"))
    told = goals.join(hits, on & F.col("args").eqNullSafe(F.col("_a")), "left")
    return told.select(*goals.columns, F.coalesce("_hit", F.lit(False)).alias("entails"))


def bindings(facts: DataFrame, goal: Literal) -> DataFrame:
    """kb, values: for a goal with variables the distinct values of the first, sorted, in each knowledge base."""
    rows = _extend(None, facts, goal, 0)
    name = next(a for a in goal.args if _is_variable(a) and not a.startswith("_"))
    return rows.groupBy("kb").agg(F.sort_array(F.collect_set(name)).alias("values"))
