"""Programs as data: the clauses of all knowledge bases are rows of one table, and one step joins new facts with all rules.

Texts of flat clauses (no nested terms, no built-ins) are read by column expressions. A rule is a row: kb, clause (its place),
head and body as arrays of arguments that are a variable's number or a constant. A partial match is a row too: a rule, the
values of its variables so far and the literals that are left. One join extends the partial matches of all rules of all
knowledge bases by their next literal, on the knowledge base, the predicate and the arguments that are bound by then: facts
are indexed under each set of places that some literal has bound. So the number of jobs follows from the longest body and
the rounds until nothing is new, whatever the number of rules.

Facts may hold nulls, which equal anything. They are then dealt by which places are null, and matches by which values are,
and each pair of both meets on the places that both hold.

All tables of an evaluation are dealt by the knowledge base, once each in a round. Whatever joins them meets on the knowledge
base and more, so nothing is dealt again between the literals of a body, and nothing is broadcast: a table's file says little
about the size of its rows.

Negated literals wait for their stratum, and each knowledge base has strata of its own. With ``proofs`` a fact is one row for
each of its proofs, with the clauses that the proof uses in the order in which it chooses them: sorted by these, the answers
come in the order and number in which depth-first search finds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions.text import clean_goal
from lemmata.operators import prover
from lemmata.scratch import forget, keep

#: Rounds after which the proofs of a knowledge base count as endless.
ROUNDS = 64
ANSWER = "solution__"

# fixed values: the shape of flat clauses
_TERM = r"(?:[a-z]\w*|[A-Z_]\w*|0|[1-9]\d*|'[\w -]*')"
_ATOM = rf"[a-z]\w*(?:\(\s*{_TERM}(?:\s*,\s*{_TERM})*\s*\))?"
_LITERAL = rf"(?:\\\+\s*)?{_ATOM}"
_BODY = rf"{_LITERAL}(?:\s*,\s*{_LITERAL})*"
_CLAUSE = rf"^\s*{_ATOM}\s*(?::-\s*{_BODY}\s*)?\.\s*(?:%.*)?$"
_NO_CLAUSE = r"^\s*(?:%.*|:- set_prolog_flag\(unknown, fail\)\.|:- use_module\(library\(lists\)\)\.)?\s*$"

_ARGS = "array<struct<i:int,c:string>>"
_LIT = f"struct<at:int,neg:boolean,pred:string,args:{_ARGS},mask:string>"


@contextmanager
def _by_kb(spark: SparkSession) -> Iterator[None]:
    """What is executed inside joins tables that are ``_dealt`` as they lie, and broadcasts none."""
    ours = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("kb")


def _reserved() -> str:
    """A pattern for the names that mean something by themselves; texts that hold one are not flat."""
    own = {m.split("_", 2)[2] for m in dir(prover.Prover) if re.match(r"_\d_", m)} | set(prover._METHODS) | set(prover._TESTS) | set(prover._OF_LIST) | set(prover._COMPARE) | set(prover.UNSUPPORTED) | {"call", "is", "mod", "rem", "div"}
    return r"(?<!\w)(?:" + "|".join(sorted(x for x in own if re.fullmatch(r"[a-z]\w*", x))) + r")(?!\w)"


def flat_lines(program: Column) -> Column:
    """The clauses of a program, a line each; comments and the usual first lines go."""
    return F.filter(F.split(program, "\n"), lambda x: ~x.rlike(_NO_CLAUSE))


def is_flat(program: Column, goal: Column) -> Column:
    """Whether text and cleaned goal hold nothing but flat clauses, one a line, and literals."""
    lines = flat_lines(F.coalesce(program, F.lit("")))
    whole = F.concat_ws("\n", F.array_join(lines, "\n"), goal)
    return F.forall(lines, lambda x: x.rlike(_CLAUSE)) & goal.rlike(rf"^{_BODY}$") & ~whole.rlike(_reserved()) & ~whole.contains(ANSWER)


def _is_variable(x: Column) -> Column:
    return x.rlike("^[A-Z_]")


def _literal(text: Column, at: Column) -> Column:
    """at, neg, pred, args of a literal's text; an anonymous variable gets a name of its own, quotes go where none are needed."""
    atom = F.regexp_replace(text, r"^\\\+\s*", "")
    term = lambda x, k: F.when(x == "_", F.concat_ws("_", F.lit("_"), at.cast("string"), k.cast("string"), F.lit("#"))).otherwise(F.regexp_replace(x, r"^'([a-z]\w*)'$", "$1"))
    args = F.transform(F.regexp_extract_all(F.regexp_extract(atom, r"(?s)\((.*)\)", 1), F.lit(_TERM), F.lit(0)), term)
    return F.struct(at.cast("int").alias("at"), text.startswith("\\+").alias("neg"), F.regexp_extract(atom, r"^[a-z]\w*", 0).alias("pred"), args.alias("args"))


def read_clauses(texts: DataFrame) -> DataFrame:
    """kb, clause, head, body, size, safe from (kb, clause, text of a flat clause).

    ``size`` is the number of variables. A clause is not ``safe`` if a variable of a negated literal is bound only later, or
    one of its head is not bound by the body and stands there twice: relations cannot hold that.
    """
    plain = F.regexp_replace("text", r"%.*$", "")
    body = F.regexp_extract_all(F.regexp_extract(plain, r"(?s):-(.*)$", 1), F.lit(_LITERAL), F.lit(0))
    x = texts.select("kb", "clause", _literal(F.regexp_extract(plain, rf"^\s*({_ATOM})", 1), F.lit(-1)).alias("h"), F.transform(body, lambda t, k: _literal(t, k)).alias("b"))
    every = F.concat(F.array("h"), F.col("b"))
    names = F.filter(F.flatten(F.transform(every, lambda v: v["args"])), _is_variable)
    x = x.withColumn("all", names).withColumn("names", F.array_distinct("all"))
    bound = lambda before: F.flatten(F.transform(F.filter("b", lambda y: ~y["neg"] & (y["at"] < before)), lambda y: y["args"]))
    times = lambda v: F.size(F.filter("all", lambda y: y == v))
    late = F.exists("b", lambda y: y["neg"] & F.exists(y["args"], lambda v: _is_variable(v) & ~F.array_contains(bound(y["at"]), v) & (times(v) > 1)))
    twice = F.exists("h.args", lambda v: _is_variable(v) & ~F.array_contains(bound(F.lit(1 << 30)), v) & (F.size(F.filter("h.args", lambda y: y == v)) > 1))
    coded = lambda args: F.transform(args, lambda v: F.struct(F.when(_is_variable(v), F.array_position("names", v) - 1).cast("int").alias("i"), F.when(~_is_variable(v), v).alias("c")))
    lit = lambda y: F.struct(y["at"].alias("at"), y["neg"].alias("neg"), y["pred"].alias("pred"), coded(y["args"]).alias("args"), F.lit("").alias("mask"))
    return x.select("kb", "clause", F.struct(F.col("h.pred").alias("pred"), coded(F.col("h.args")).alias("args")).alias("head"), F.transform("b", lit).alias("body"), F.size("names").alias("size"), (~late & ~twice).alias("safe"))


def strata(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rules`` with ``level``, kb of those in which a predicate depends on its own negation).

    The dependencies of all knowledge bases are one table; levels rise along it until nothing changes. A level above the
    number of a knowledge base's predicates can only come from a cycle: that one is told and left out, the rest goes on.
    """
    if rules.filter(F.exists("body", lambda y: y["neg"])).isEmpty():
        return rules.withColumn("level", F.lit(0)), rules.select("kb").limit(0)
    needs = rules.select("kb", F.col("head.pred").alias("pred"), F.size("head.args").alias("n"), F.explode("body").alias("b")).select("kb", "pred", "n", F.col("b.pred").alias("p"), F.size("b.args").alias("m"), F.col("b.neg").cast("int").alias("neg")).distinct()
    needs = _dealt(needs)
    some = needs.groupBy("kb").agg(F.max("neg").alias("neg")).filter("neg = 1").select("kb")
    needs = keep(needs.join(some, "kb"), "needs")
    heads = _dealt(rules.select("kb", F.col("head.pred").alias("pred"), F.size("head.args").alias("n"))).distinct().join(_dealt(needs.select("kb")), "kb", "left_semi")
    level = keep(heads.join(heads.groupBy("kb").agg(F.count(F.lit(1)).alias("most")), "kb").withColumn("level", F.lit(0)).withColumn("rose", F.lit(True)), "levels")
    while not level.filter("rose and level <= most").isEmpty():
        here = _dealt(level)
        below = here.filter("level <= most").select("kb", F.col("pred").alias("p"), F.col("n").alias("m"), F.col("level").alias("under"))
        least = _dealt(needs).join(below, ["kb", "p", "m"]).groupBy("kb", "pred", "n").agg(F.max(F.col("under") + F.col("neg")).alias("least"))
        risen = here.join(least, ["kb", "pred", "n"], "left").select("kb", "pred", "n", "most", F.greatest("level", F.coalesce("least", F.lit(0))).alias("level"), (F.coalesce("least", F.lit(0)) > F.col("level")).alias("rose"))
        before, level = level, keep(risen, "levels")
        forget(before)
    forget(needs)
    rules, level = _dealt(rules), _dealt(level)
    bad = level.filter("level > most").select("kb").distinct()
    own = level.select("kb", F.col("pred").alias("p"), F.col("n").alias("m"), "level")
    on = [rules["kb"] == own["kb"], rules["head.pred"] == F.col("p"), F.size(rules["head.args"]) == F.col("m")]
    return rules.join(own, on, "left").select(*[rules[c] for c in rules.columns], F.coalesce("level", F.lit(0)).alias("level")).join(bad, "kb", "left_anti"), bad


def _masked(literals: Column, bound: Column) -> Column:
    """``literals`` in their order, each with which of its places are bound by then."""
    mask = lambda a, b: F.array_join(F.transform(a, lambda x: F.when(x["c"].isNotNull() | F.coalesce(F.array_contains(b, x["i"]), F.lit(False)), "1").otherwise("0")), "")
    empty = F.struct(bound.cast("array<int>").alias("b"), F.array().cast(f"array<{_LIT}>").alias("l"))

    def step(a, y):
        one = F.struct(y["at"].alias("at"), y["neg"].alias("neg"), y["pred"].alias("pred"), y["args"].alias("args"), mask(y["args"], a["b"]).alias("mask"))
        return F.struct(F.array_union(a["b"], F.transform(y["args"], lambda x: x["i"])).alias("b"), F.concat(a["l"], F.array(one)).alias("l"))

    return F.aggregate(literals, empty, step)["l"]


#: Expressions over a partial match (lit, subst, todo) and the fact that it meets (there).
_VALUES = "transform(lit.args, a -> coalesce(a.c, get(subst, a.i)))"
_PAIRS = "zip_with(lit.args, there, (a, v) -> struct(a.i as i, a.c as c, v as v))"
_FOUND = f"get(filter({_PAIRS}, z -> z.i = {{}} and z.v is not null), 0).v"
_AGREE = f"forall({_PAIRS}, y -> y.v is null or coalesce(coalesce(y.c, get(subst, y.i), {_FOUND.format('y.i')}) = y.v, true))"
_NEXT = {"lit": "get(todo, 0)", "todo": "if(size(todo) > 0, slice(todo, 2, size(todo)), todo)", "negs": "if(size(negs) > 0, slice(negs, 2, size(negs)), negs)"}


class _Step:
    """One kind of join for a whole evaluation: with or without wildcards, with or without proofs."""

    def __init__(self, needs: DataFrame, wildcards: bool, proofs: bool):
        self.needs, self.wildcards, self.proofs = needs, wildcards, proofs
        self.identity = ["kb", "pred", "n", "args", *(["key"] if proofs else [])]
        self.on = ["kb", "pred", "n", *(["holds"] if wildcards else []), "mask", "values"]
        self.scratch = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        out = keep(df, name)
        self.scratch.append(out)
        return out

    def indexed(self, facts: DataFrame) -> DataFrame:
        """Facts as they are met: under each set of places that a literal has bound; with wildcards, by the places they hold."""
        f = facts.select("kb", "pred", "n", F.col("args").alias("there"), *([F.col("key").alias("proof")] if self.proofs else []), F.lit(True).alias("hit"))
        if self.wildcards:
            return f.withColumn("holds", F.expr("array_join(transform(there, v -> if(v is null, '0', '1')), '')"))
        return f.join(self.needs, ["kb", "pred", "n"]).withColumn("values", F.expr("filter(there, (v, i) -> substring(mask, i + 1, 1) = '1')"))

    def _meeting(self, partial: DataFrame, f: DataFrame, lit: str) -> tuple[DataFrame, DataFrame]:
        """Partial matches and facts with the columns on which they meet."""
        own = [F.expr(f"{lit}.pred").alias("pred"), F.expr(f"size({lit}.args)").alias("n")]
        vals = _VALUES.replace("lit.", f"{lit}.")
        if not self.wildcards:
            return partial.select("*", *own, F.expr(f"{lit}.mask").alias("mask"), F.expr(f"filter({vals}, (v, i) -> substring({lit}.mask, i + 1, 1) = '1')").alias("values")), f
        # what is written here is read twice, and would else be made twice for each literal
        p = _dealt(self.kept(partial.select("*", *own, F.expr(vals).alias("vals"), F.expr(f"array_join(transform({vals}, v -> if(v is null, '0', '1')), '')").alias("bound")), "partial"))
        ways = f.select("kb", "pred", "n", "holds").distinct().join(p.select("kb", "pred", "n", "bound").distinct(), ["kb", "pred", "n"])
        both = "array_join(zip_with(split(holds, ''), split(bound, ''), (a, b) -> if(a = '1' and b = '1', '1', '0')), '')"
        ways = ways.withColumn("mask", F.expr(both))
        p = p.join(ways, ["kb", "pred", "n", "bound"], "left").withColumn("values", F.expr("filter(vals, (v, i) -> substring(mask, i + 1, 1) = '1')"))
        f = f.join(ways.select("kb", "pred", "n", "holds", "mask").distinct(), ["kb", "pred", "n", "holds"])
        return p, f.withColumn("values", F.expr("filter(there, (v, i) -> substring(mask, i + 1, 1) = '1')"))

    def extend(self, partial: DataFrame, f: DataFrame) -> DataFrame:
        """Partial matches joined with the facts of their next literal; those without one stay as they are."""
        p, f = self._meeting(partial, f, "lit")
        x = p.join(f, self.on, "left").filter(f"lit is null or hit and {_AGREE}")
        now = _NEXT | {"subst": f"if(lit is null, subst, transform(subst, (s, j) -> coalesce(s, {_FOUND.format('j')})))", "keys": "if(lit is null, keys, concat(keys, array(struct(lit.at as at, proof as key))))"}
        del now["negs"]
        return x.select(*[F.expr(now[c]).alias(c) if c in now else F.col(c) for c in partial.columns])

    def without(self, partial: DataFrame, f: DataFrame) -> DataFrame:
        """Partial matches whose next negated literal no fact meets."""
        p, f = self._meeting(partial, f, "get(negs, 0)")
        if self.wildcards:  # one match may meet facts of several kinds
            hit = p.join(f, self.on, "left_semi").select("kb", "clause", "subst").distinct()
            p = p.select(*partial.columns).distinct().join(hit, ["kb", "clause", "subst"], "left_anti")
        else:
            p = p.join(f, self.on, "left_anti")
        return p.select(*[F.expr(_NEXT["negs"]).alias(c) if c == "negs" else F.col(c) for c in partial.columns])

    def heads(self, done: DataFrame) -> DataFrame:
        key = [F.expr("concat(array(clause), flatten(transform(array_sort(keys), k -> k.key)))").alias("key")] if self.proofs else []
        return done.select("kb", F.col("head.pred").alias("pred"), F.size("head.args").alias("n"), F.expr("transform(head.args, a -> coalesce(a.c, get(subst, a.i)))").alias("args"), *key).distinct()


def closure(rules: DataFrame, facts: DataFrame, *, wildcards: bool = False, proofs: bool = False, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kb, pred, n, args of all that follows, kb of those that still found something in the last round).

    ``rules`` are those of ``strata``; ``facts`` (kb, pred, args). Without ``proofs`` each fact is one row and every
    evaluation ends; with it facts also have ``key``, and knowledge bases with endless proofs go on up to ``most_rounds``.
    """
    literals = lambda neg: F.filter("body", lambda y: y["neg"] == F.lit(neg))
    variables = lambda c: F.flatten(F.transform(c, lambda y: F.transform(y["args"], lambda a: a["i"])))
    none = F.array().cast("array<int>")
    base = rules.withColumn("positive", literals(False)).withColumn("negs", F.transform(literals(True), lambda y: _masked(F.array(y), variables(F.col("positive")))[0]))
    keys = [F.array().cast("array<struct<at:int,key:array<int>>>").alias("keys")] if proofs else []
    base = keep(base.select("kb", "clause", "level", "head", "positive", "negs", F.array_repeat(F.lit(None).cast("string"), F.col("size")).alias("subst"), *keys), "rules")
    begin = lambda x, whole: x.select("kb", "clause", "level", "head", "negs", "subst", *[k for k in base.columns if k == "keys"], F.lit(whole).alias("whole"), F.expr(_NEXT["lit"]).alias("lit"), F.expr(_NEXT["todo"]).alias("todo"))
    every = base.withColumn("todo", _masked(F.col("positive"), none))
    each = base.withColumn("d", F.explode("positive")).withColumn("todo", _masked(F.concat(F.array("d"), F.filter("positive", lambda y: y["at"] != F.col("d.at"))), none))
    plans = keep(begin(every, True).unionByName(begin(each, False)), "plans")
    asked = plans.select("kb", F.explode(F.concat(F.array("lit"), F.col("todo"), F.col("negs"))).alias("y")).filter("y is not null")
    needs = keep(_dealt(asked.select("kb", F.col("y.pred").alias("pred"), F.size("y.args").alias("n"), F.col("y.mask").alias("mask"))).distinct(), "bound-places")
    longest = plans.groupBy("level").agg(F.max(F.size("todo") + F.col("lit").isNotNull().cast("int")).alias("body"), F.max(F.size("negs")).alias("negs"))
    step = _Step(_dealt(needs), wildcards, proofs)
    given = facts.select("kb", "pred", F.size("args").alias("n"), "args", *(["key"] if proofs else []))
    known = step.kept(given if proofs else _dealt(given).distinct(), "facts")
    growing = known.select("kb").limit(0)
    for level, body, negs in sorted(map(tuple, longest.collect())):  # a row for each stratum
        here, latest = _dealt(plans.filter(F.col("level") == level)), None
        again = here.filter("not whole")
        for done in count(1):
            # none of these is null; said here, the optimizer adds no such filter to some of the uses, and all share one exchange
            so_far = _dealt(known.filter(" and ".join(f"{c} is not null" for c in step.identity)))
            all_known = step.indexed(so_far)
            p = (here.filter("whole") if latest is None else again).drop("whole", "level")
            for k in range(body):
                p = step.extend(p, step.indexed(_dealt(latest)) if k == 0 and latest is not None else all_known)
            for _ in range(negs):
                p = step.without(p, all_known)
            latest = step.kept(step.heads(p).join(so_far, step.identity, "left_anti"), "facts")
            known = known.unionByName(latest)
            first = again.select("kb", F.col("lit.pred").alias("pred"), F.expr("size(lit.args)").alias("n"))
            if _dealt(latest).join(first, ["kb", "pred", "n"], "left_semi").isEmpty():  # no rule of the stratum starts from what is new
                break
            if done == most_rounds:
                growing = growing.unionByName(latest.select("kb")).distinct()
                break
    out, growing = keep(known, "closure"), keep(growing, "growing")
    for x in (base, plans, needs, *step.scratch):
        forget(x)
    return out, growing


def _open() -> Column:
    """Whether a clause's head holds a variable that its body does not bind."""
    return F.exists("head.args", lambda a: a["i"].isNotNull() & ~F.exists("body", lambda y: ~y["neg"] & F.exists(y["args"], lambda b: b["i"] == a["i"])))


def flat_programs(df: DataFrame, program: str, goal: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, facts, kb of what relations cannot hold) of ``df`` (kb, program, goal): flat clauses, and the goal as a rule.

    The goal's rule has the head ``solution__`` with the goal's named variables in order of first use. Left to the prover are
    clauses that are not safe and, where something holds for anything, heads that repeat a variable and negated literals with
    variables: what is open by relations may be bound by the goal in a search.
    """
    named = F.array_distinct(F.regexp_extract_all(F.regexp_replace(goal, r"'[^']*'", ""), F.lit(r"(?<!\w)([A-Z]\w*)"), F.lit(1)))
    ask = F.concat(F.lit(ANSWER), F.when(F.size(named) > 0, F.concat(F.lit("("), F.array_join(named, ", "), F.lit(")"))).otherwise(""), F.lit(" :- "), F.col(goal), F.lit("."))
    lines = df.select("kb", F.posexplode(F.concat(flat_lines(F.coalesce(F.col(program), F.lit(""))), F.array(ask))).alias("clause", "text"))
    c = keep(read_clauses(lines), "clauses")
    denies = F.exists("body", lambda y: y["neg"] & F.exists(y["args"], lambda a: a["i"].isNotNull()))
    variables = F.filter(F.transform("head.args", lambda a: a["i"]), lambda i: i.isNotNull())
    of_heads = _dealt(c.select("kb", "safe", _open().alias("open"), (F.size(variables) > F.size(F.array_distinct(variables))).alias("repeats"), denies.alias("denies")))
    told = of_heads.groupBy("kb").agg(F.min("safe").alias("safe"), F.max("open").alias("open"), F.max("repeats").alias("repeats"), F.max("denies").alias("denies"))
    odd = keep(told.filter(~F.col("safe") | F.col("open") & (F.col("repeats") | F.col("denies"))).select("kb"), "odd")
    good = lambda x: _dealt(x).join(_dealt(odd), "kb", "left_anti")
    facts = c.filter(F.size("body") == 0).select("kb", F.col("head.pred").alias("pred"), F.transform("head.args", lambda a: a["c"]).alias("args"), F.array("clause").alias("key"))
    return good(c.filter(F.size("body") > 0)), good(facts), odd


def answered(df: DataFrame, program: str = "program", goal: str = "goal", *, steps: int = prover.STEPS, most_rounds: int = ROUNDS) -> DataFrame:
    """``df`` with entails, values, error of each row's goal against its program.

    Rows of flat text are evaluated together, by relations: a goal without variables has no values; else those of its
    variables, in the order and number in which depth-first search finds them, several as a list; an unbound one is ``_``.
    Recursion that leads back to itself ends for goals without variables; for others, proofs that go on after
    ``most_rounds`` rounds give null and ``timeout``. Negation through itself gives null and says so. Other text goes to the
    bounded prover. Rows are told apart by themselves, whatever they repeat.
    """
    names = {c.lower() for c in df.columns}
    clean = clean_goal(F.coalesce(F.col(goal), F.lit("")))
    row = "kb" if "kb" not in names else next(f"kb_{i}" for i in count() if f"kb_{i}" not in names)
    flat = next(x for x in (f"flat{'_' * i}" for i in count()) if x not in names)
    x = keep(df.withColumn(row, F.monotonically_increasing_id()).withColumn(flat, is_flat(F.col(program), clean)), "questions")
    asked = x.filter(flat).select(F.col(row).alias("kb"), F.col(program).alias("program"), clean.alias("goal"))
    with _by_kb(df.sparkSession):
        rules, facts, odd = flat_programs(asked, "program", "goal")
        rules, bad = strata(rules)
        rules = keep(rules, "rules")
        body = _dealt(rules.select("kb", F.explode("body").alias("b"))).select("kb", F.col("b.pred").alias("p"), F.size("b.args").alias("m"))
        asks = [facts["kb"] == body["kb"], F.col("pred") == F.col("p"), F.size("args") == F.col("m")]
        facts = keep(facts.join(body, asks, "left_semi"), "facts")  # no literal meets the others
        wild = not facts.filter(F.exists("args", lambda v: v.isNull())).isEmpty() or not rules.filter(_open()).isEmpty()
        all_, _ = closure(rules, facts, wildcards=wild)
        hit = _dealt(all_.filter(F.col("pred") == ANSWER).select("kb", "n")).distinct()
        with_values = hit.filter("n > 0").select("kb")
        proved, endless = closure(_dealt(rules).join(with_values, "kb", "left_semi"), _dealt(facts).join(with_values, "kb", "left_semi"), wildcards=wild, proofs=True, most_rounds=most_rounds)
        shown = F.transform("args", lambda v: F.coalesce(v, F.lit("_")))
        value = F.when(F.col("n") == 1, shown[0]).otherwise(F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")))
        values = _dealt(proved.filter(F.col("pred") == ANSWER)).groupBy("kb").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", value.alias("value")))), lambda v: v["value"]).alias("values"))
        found = _dealt(asked.select("kb")).join(_dealt(odd), "kb", "left_anti").join(hit.select("kb").withColumn("hit", F.lit(True)), "kb", "left").join(values, "kb", "left")
        found = found.join(_dealt(bad).withColumn("bad", F.lit(True)), "kb", "left").join(_dealt(endless).withColumn("endless", F.lit(True)), "kb", "left")
        error = F.when(F.col("bad"), F.lit("a predicate depends on its own negation")).when(F.col("endless"), F.lit("timeout"))
        none = F.array().cast("array<string>")
        found = keep(found.select(F.col("kb").alias("found_kb"), F.when(error.isNull(), F.coalesce("hit", F.lit(False))).alias("entails"), F.when(error.isNull(), F.coalesce("values", none)).otherwise(none).alias("values"), error.alias("error")), "found")
    told = x.join(found.hint("merge"), F.col(row) == F.col("found_kb"))
    rest = x.join(found.select("found_kb").hint("merge"), F.col(row) == F.col("found_kb"), "left_anti")
    out = prover.answered(rest, program, goal, steps)
    return told.select(*df.columns, "entails", "values", "error").unionByName(out.select(*df.columns, "entails", "values", "error"))
