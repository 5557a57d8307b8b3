"""Logic blocks as text: heads, goals, programs. Built-in expressions; one row is one knowledge base or question.

A block is struct<facts, rules, optional_rules: array<string>, hypothesis: string>. Predicates are read by shape: a name, and
arguments up to the first closing parenthesis; a name has one arity, the last that is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lemmata.functions.text import clean_goal, fol_goal, with_dot

PREDICATES = "array<struct<name:string,arity:int>>"
# fixed values: the head of a clause on a line, an atom in a goal, a flat fact, an atom whose constants are replaced, and the
# lines that begin the sections of a program
HEAD = r"(?m)^\s*([a-z][a-z0-9_]*)\s*(?:\(([^)]*)\))?\s*(?::-|\.)"
ATOM = r"([a-z][a-z0-9_]*)\s*\(([^)]*)\)"
FLAT_FACT = r"^(\s*[a-z][a-z0-9_]*\s*)\(([^)]+)\)(\s*\.?\s*)$"
TIGHT_ATOM = r"([a-z][a-z0-9_]*)\(([^)]*)\)"
CONTEXT_MARK, SCENARIO_MARK = "% --- context KB ---", "% --- scenario KB ---"


def top_level_commas(args: Column) -> Column:
    """Commas outside parentheses."""
    step = lambda a, c: F.struct((a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (a["n"] + ((c == ",") & (a["depth"] == 0)).cast("int")).alias("n"))
    return F.aggregate(F.split(args, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step, lambda a: a["n"])


def arity(args: Column) -> Column:
    return F.when(F.trim(args) == "", 0).otherwise(top_level_commas(args) + 1)


def last_of_each(preds: Column) -> Column:
    """Of predicates with one name the last arity, at the place of the first."""
    names = F.array_distinct(F.transform(preds, lambda p: p["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(preds, lambda p: p["name"] == n), -1)["arity"].alias("arity")))


def _found(text: Column, pattern: str) -> Column:
    names, args = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return last_of_each(F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), arity(F.coalesce(a, F.lit(""))).alias("arity"))))


def defined_predicates(program: Column) -> Column:
    return _found(program, HEAD)


def goal_predicates(goal: Column) -> Column:
    """Atoms of a goal; those without parentheses are not seen."""
    return _found(goal, ATOM)


def block_clauses(block: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(block["facts"], none), F.coalesce(block["rules"], none))


def block_predicates(block: Column) -> Column:
    """Heads of a block's facts and rules."""
    head = lambda c: F.rtrim(F.trim(F.substring_index(c, ":-", 1)), F.lit("."))
    whole, bare = "^" + ATOM, r"^([a-z][a-z0-9_]*)$"

    def one(c: Column) -> Column:
        h = head(c)
        atom = F.struct(F.regexp_extract(h, whole, 1).alias("name"), arity(F.regexp_extract(h, whole, 2)).alias("arity"))
        return F.when(h.rlike(whole), atom).when(h.rlike(bare), F.struct(h.alias("name"), F.lit(0).alias("arity")))

    return last_of_each(F.filter(F.transform(block_clauses(block), one), lambda p: p.isNotNull()))


def _block_lines(block: Column, label: str) -> Column:
    kept = lambda a: F.filter(a, lambda c: F.trim(c) != "")
    none = F.array().cast("array<string>")
    optional = F.transform(kept(F.coalesce(block["optional_rules"], none)), lambda c: F.concat(F.lit("% optional: "), with_dot(c)))
    return F.concat(F.array(F.lit(f"\n% --- {label} ---")), F.transform(kept(block_clauses(block)), with_dot), optional)


def program(context: Column, scenario: Column) -> Column:
    """One program of both blocks; undefined predicates fail; optional rules are comments; a null context is left out."""
    start = F.array(F.lit(":- set_prolog_flag(unknown, fail)."), F.lit(":- use_module(library(lists))."))
    none = F.array().cast("array<string>")
    ctx = F.when(context.isNull(), none).otherwise(_block_lines(context, "context KB"))
    return F.array_join(F.concat(start, ctx, _block_lines(scenario, "scenario KB")), "\n")


def goal_of(block: Column, fol: Column | None = None) -> Column:
    """The hypothesis of a block as a goal; where it is empty, the first-order one converted, if given."""
    own = clean_goal(F.coalesce(block["hypothesis"], F.lit("")))
    return own if fol is None else F.when(own != "", own).otherwise(fol_goal(F.coalesce(fol["hypothesis"], F.lit(""))))


def typed_constants(constants: Column, types=("person",)) -> Column:
    return F.transform(F.filter(constants, lambda c: c["type"].isin(*types)), lambda c: c["id"])


def _wild(args: Column, constants: Column) -> Column:
    parts = F.transform(F.split(args, ","), lambda a: F.trim(a))
    return F.array_join(F.transform(parts, lambda a: F.when(F.array_contains(constants, a), "_").otherwise(a)), ", ")


def fact_with_wildcards(clause: Column, constants: Column) -> Column:
    """A flat fact with the given constants as ``_``; rules and facts of another shape stay as they are."""
    shape = FLAT_FACT
    new = F.concat(F.regexp_extract(clause, shape, 1), F.lit("("), _wild(F.regexp_extract(clause, shape, 2), constants), F.lit(")"), F.regexp_extract(clause, shape, 3))
    return F.when(clause.contains(":-") | ~clause.rlike(shape), clause).otherwise(new)


def context_with_wildcards(text: Column, constants: Column) -> Column:
    """A program whose facts between the two markers have the given constants as ``_``."""
    lines = F.transform(F.split(text, "\n"), lambda x: x)
    place = lambda mark: F.array_position(F.transform(lines, lambda x: x.contains(mark)), True)
    a, b = place(CONTEXT_MARK), place(SCENARIO_MARK)
    inside = lambda i: (a > 0) & (i + 1 > a) & ((b == 0) | (i + 1 < b))
    return F.array_join(F.transform(lines, lambda x, i: F.when(inside(i) & (F.trim(x) != "") & ~F.trim(x).startswith("%"), fact_with_wildcards(x, constants)).otherwise(x)), "\n")


def goal_with_wildcards(goal: Column, constants: Column, only: Column) -> Column:
    """A goal whose atoms of the predicates ``only`` have the given constants as ``_``."""
    atom = TIGHT_ATOM
    atoms = F.regexp_extract_all(goal, F.lit(atom), F.lit(0))
    between = F.split(F.regexp_replace(goal, atom, "\u0001"), "\u0001")
    names = F.transform(only, lambda p: p["name"])

    def one(x: Column) -> Column:
        name = F.regexp_extract(x, atom, 1)
        return F.when(F.array_contains(names, name), F.concat(name, F.lit("("), _wild(F.regexp_extract(x, atom, 2), constants), F.lit(")"))).otherwise(x)

    return F.array_join(F.flatten(F.zip_with(between, F.transform(atoms, one), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def anonymous_arguments(n: Column) -> Column:
    """_A0, _A1, ... ; none for arity 0."""
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("_A"), i.cast("string"))))


def _atom(name: Column, n: Column) -> Column:
    return F.when(n <= 0, name).otherwise(F.concat(name, F.lit("("), F.array_join(anonymous_arguments(n), ", "), F.lit(")")))


def bridge_rule(head: Column, head_arity: Column, body: Column, body_arity: Column) -> Column:
    """``h(_A0, ..) :- c(_A0, ..).``; arguments are passed on by place as far as both have them."""
    return F.concat(_atom(head, head_arity), F.lit(" :- "), _atom(body, body_arity), F.lit("."))


def with_rules(text: Column, rules: Column, label: str) -> Column:
    """A program with labelled rules at its end; nothing changes without rules."""
    added = F.concat(text, F.lit(f"\n\n% --- {label} ---\n"), F.array_join(F.transform(rules, with_dot), "\n"))
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, added).otherwise(text)
