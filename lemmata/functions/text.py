"""String expressions: answers, markup, predicate names, goals, model output. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words without content in predicate names
STOP_TOKENS = (
    "a", "an", "the", "this", "that",
    "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did",
    "can", "could", "will", "would", "shall", "should", "may", "might",
    "to", "from", "with", "for", "in", "of", "at", "by", "on", "into", "about", "over", "under", "after", "before",
    "and", "or", "not", "if", "then", "else",
    "get", "give", "make", "take",
)

# fixed values: introductions of lists and rules, and exceptions in items
ANY_INTRO = r"\b(either of the following apply|any of the following apply|one of the following)\b"
ALL_INTRO = r"\b(all of the following apply|both of the following apply)\b"
ELIGIBLE = r"\b(you can (only )?make a new claim|you can claim|you can apply)\b"
NEGATIVE = r"\b(usually,\s*)?you will not|get .* if|cannot\b"
EXCEPTION = r"\b(unless|except)\b"


def collapsed(s: Column) -> Column:
    """White space of any kind, no-break space included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalized_answer(s: Column) -> Column:
    """Small letters, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(s), r"[!-/:-@\[-`{-~]", "")
    # boundaries as the scores of lists have them: a combining mark is no letter
    return collapsed(F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def answer_tokens(s: Column) -> Column:
    return F.filter(F.split(normalized_answer(F.coalesce(s, F.lit(""))), " "), lambda t: t != "")


def without_tags(s: Column) -> Column:
    return collapsed(F.regexp_replace(s, "<[^>]+>", " "))


def context_text(contents: Column, most: int = 3000) -> Column:
    """Paragraphs without markup, the empty ones left out, joined by a space and cut to ``most`` characters."""
    parts = F.filter(F.transform(contents, without_tags), lambda x: x != "")
    return F.substring(F.array_join(parts, " "), 1, most)


def is_row_line(line: Column) -> Column:
    """Whether a line is a bare table row."""
    return F.coalesce(line.rlike(r"(?i)^\s*<tr[\s>]"), F.lit(False))


def list_operator(intro: Column) -> Column:
    """ANY, ALL or null, from the sentence before a list."""
    return F.when(intro.rlike("(?i)" + ANY_INTRO), "ANY").when(intro.rlike("(?i)" + ALL_INTRO), "ALL")


def is_rule_intro(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + ELIGIBLE) | text.rlike("(?i)" + NEGATIVE), F.lit(False))


def outcome(intro: Column) -> Column:
    return F.when(intro.rlike("(?i)" + NEGATIVE), "NOT_ELIGIBLE").otherwise("ELIGIBLE")


def is_exception(item: Column) -> Column:
    return F.coalesce(item.rlike("(?i)" + EXCEPTION), F.lit(False))


# fixed values: where a camel-case name is cut, so that names agree with those that programs already use
_CAMEL = ("(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, _CAMEL[0], "$1_$2"), _CAMEL[1], "$1_$2"))


def content_tokens(name: Column, stop=STOP_TOKENS, fold: bool = True) -> Column:
    """The tokens of a name between underscores that are neither empty nor stop words."""
    words = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(F.split(name, "_"), lambda t: (t != "") & ~F.array_contains(words, F.lower(t) if fold else t))


def normalized_name(name: Column, stop=STOP_TOKENS) -> Column:
    """A predicate name without stop words; the name itself if nothing is left."""
    kept = content_tokens(name, stop)
    return F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise(name)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of tokens between underscores, empty ones and stop words included."""
    x, y = F.split(a, "_"), F.split(b, "_")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def clean_goal(goal: Column) -> Column:
    """A goal without a leading ``?-``, a comment at its end and final dots."""
    # fixed values: the mark before a goal, a comment behind it
    s = F.regexp_replace(F.regexp_replace(F.trim(goal), r"^\?-\s*", ""), r"\s*%.*$", "")
    return F.trim(F.rtrim(F.trim(s), F.lit(".")))


def goal_variables(goal: Column) -> Column:
    """Names that begin with a capital, in order of first use."""
    # fixed value: the shape of a variable
    return F.array_distinct(F.regexp_extract_all(goal, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))


# fixed values: the shape of a quantifier and of an atom in first-order text
_QUANTIFIER = r"(?i)(?<!\w)(?:exists|forall)\s*\(?\s*(\w+)\s*\)?"


def fol_goal(hypothesis: Column) -> Column:
    """A first-order hypothesis as a goal: quantifiers go, their variables become capitals, the predicate snake case."""
    h = F.trim(hypothesis)
    bound = F.transform(F.regexp_extract_all(h, F.lit(_QUANTIFIER), F.lit(1)), F.lower)
    h = F.trim(F.regexp_replace(h, _QUANTIFIER + r"\s*", ""))
    # fixed value: the shape of an atom in first-order text
    atom = r"(?s)^([A-Za-z_]\w*)\s*(?:\((.+)\))?\s*$"
    raw = F.regexp_extract(h, atom, 2)
    args = F.transform(F.split(raw, ","), lambda a: F.when(F.array_contains(bound, F.lower(F.trim(a))), F.upper(F.trim(a))).otherwise(F.trim(a)))
    name = snake_case(F.regexp_extract(h, atom, 1))
    whole = F.when(raw == "", name).otherwise(F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")")))
    return F.when(h.rlike(atom), whole).otherwise(snake_case(h))


def with_dot(clause: Column) -> Column:
    c = F.trim(clause)
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def parsed_answer(text: Column) -> Column:
    """yes, no or not answerable, from what a model wrote; how far it is read and the patterns are fixed values."""
    t = F.lower(F.trim(text))
    start, first = F.substring(t, 1, 60), F.regexp_extract(t, r"^\s*(\S*)", 1)
    return (
        F.when(t.rlike(r"(?U)\bnot[_\s]answerable\b"), "not answerable")
        .when(t.startswith("yes") | start.rlike(r"(?U)\byes\b"), "yes")
        .when(t.startswith("no") | start.rlike(r"(?U)\bno\b"), "no")
        .when(first.contains("yes"), "yes")
        .when(first.contains("no"), "no")
        .otherwise("not answerable")
    )


def percent(v: Column) -> Column:
    return F.format_string("%.1f%%", v * 100)
