"""Bridging two vocabularies: which predicate of a context stands for one that a goal uses.

``find`` operators work on tables (kb, name, arity, place), so a knowledge base of any size is joined on its tokens;
``align`` rewrites the programs of a table of questions with the rules they find.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions.text import STOP_TOKENS, content_tokens, normalized_name
from lemmata.operators import clauses as C


@dataclass(frozen=True)
class Alignment:
    """What to try. The order is constants, names, aliases, given rules, shared tokens, meaning."""

    normalize: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    bridge_rules: tuple[str, ...] = ()
    auto_bridge: bool = False
    auto_bridge_threshold: float = 0.2
    auto_bridge_top_k: int = 1
    semantic_bridge: bool = False
    semantic_bridge_threshold: float = 0.3
    semantic_bridge_max_depth: int = 4
    semantic_bridge_pos: str = "verb_noun"
    constant_align: bool = False
    constant_align_types: tuple[str, ...] = ("person",)
    stop_tokens: tuple[str, ...] = STOP_TOKENS


def parse_aliases(pairs: list[str]) -> tuple[dict[str, str], list[str]]:
    """``hyp=ctx`` strings, cut at the first sign, and those that are malformed."""
    good, bad = {}, []
    for p in pairs:
        a, sign, b = (x.strip() for x in p.partition("="))
        if sign and a and b:
            good[a] = b
        else:
            bad.append(p)
    return good, bad


def normalized_matches(hyp: DataFrame, ctx: DataFrame, stop=STOP_TOKENS) -> DataFrame:
    """kb, name, arity, ctx_name, ctx_arity: other names with the same normal form; of several in the context the last."""
    last = Window.partitionBy("kb", "norm").orderBy(F.desc("place"), F.desc("ctx_name"))
    c = ctx.select("kb", F.col("name").alias("ctx_name"), F.col("arity").alias("ctx_arity"), "place", normalized_name(F.col("name"), stop).alias("norm"))
    c = c.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "place")
    return hyp.withColumn("norm", normalized_name(F.col("name"), stop)).join(c, ["kb", "norm"]).filter("name <> ctx_name").select("kb", "name", "arity", "place", "ctx_name", "ctx_arity")


def jaccard_matches(hyp: DataFrame, ctx: DataFrame, threshold: float = 0.2, top_k: int = 1) -> DataFrame:
    """kb, name, arity, ctx_name, ctx_arity, score, rank: the ``top_k`` context predicates by Jaccard of name tokens.

    Candidates come from an inverted index of tokens: only pairs that share one are made. A threshold of 0 or less also
    admits pairs without a common token, within each knowledge base.
    """
    tokens = F.array_distinct(F.split("name", "_"))
    h = hyp.select("kb", "name", "arity", "place", F.size(tokens).alias("n"), tokens.alias("t"))
    c = ctx.select("kb", F.col("name").alias("ctx_name"), F.col("arity").alias("ctx_arity"), F.col("place").alias("ctx_place"), F.size(tokens).alias("m"), tokens.alias("t"))
    if threshold > 0:
        left = h.withColumn("token", F.explode("t")).drop("t")
        right = c.withColumn("token", F.explode("t")).drop("t")
        keys = ["kb", "name", "arity", "place", "n", "ctx_name", "ctx_arity", "ctx_place", "m"]
        pairs = left.join(right, ["kb", "token"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("both"))
    else:
        pairs = h.join(c.withColumnRenamed("t", "u"), "kb").withColumn("both", F.size(F.array_intersect("t", "u")))
    scored = pairs.withColumn("score", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).filter(F.col("score") >= threshold)
    best = Window.partitionBy("kb", "name").orderBy(F.desc("score"), "ctx_place", "ctx_name")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("kb", "name", "arity", "place", "ctx_name", "ctx_arity", "score", "rank")


def undefined(hyp: DataFrame, defined: DataFrame) -> DataFrame:
    """Goal predicates that a program does not define."""
    return hyp.join(defined.select("kb", "name"), ["kb", "name"], "left_anti")


# meaning


def synsets(words: DataFrame, lemma_synset: DataFrame, pos_mode: str = "verb_noun") -> DataFrame:
    """word, synset. ``verb`` and ``noun`` take that part of speech; ``verb_noun`` both, or any where neither has the word."""
    x = words.select("word").distinct().join(lemma_synset.withColumnRenamed("lemma", "word"), "word")
    if pos_mode == "verb_noun":
        both = F.col("pos").isin("verb", "noun")
        x = x.withColumn("has", F.max(both).over(Window.partitionBy("word"))).filter(both | ~F.col("has"))
    elif pos_mode == "verb_first":
        verb = F.col("pos") == "verb"
        x = x.withColumn("has", F.max(verb).over(Window.partitionBy("word"))).filter(verb | ~F.col("has"))
    else:
        x = x.filter(F.col("pos") == pos_mode)
    return x.select("word", "synset").distinct()


def ancestors(seeds: DataFrame, edges: DataFrame, max_depth: int = 4, kinds=("hypernym",)) -> DataFrame:
    """synset, ancestor, depth: the least number of steps up, 0 for the synset itself, up to ``max_depth``."""
    up = edges.filter(F.col("kind").isin(*kinds)).select(F.col("src").alias("ancestor"), "dst").distinct()
    step = seeds.select("synset", F.col("synset").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    every = step
    for depth in range(1, max_depth + 1):
        step = step.join(up, "ancestor").select("synset", F.col("dst").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        every = every.unionByName(step)
    return every.groupBy("synset", "ancestor").agg(F.min("depth").alias("depth"))


def hyponym_depths(pairs: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """``pairs`` (general, specific synsets) with ``depth``: the least number of steps down from the one to the other.

    0 for a synset itself, null where ``max_depth`` steps do not reach it.
    """
    down = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    below = ancestors(pairs.select(F.col("general").alias("synset")), down, max_depth).select(F.col("synset").alias("general"), F.col("ancestor").alias("specific"), "depth")
    return pairs.join(below, ["general", "specific"], "left")


def entailment_scores(pairs: DataFrame, lemma_synset: DataFrame, edges: DataFrame, *, max_depth: int = 4, pos_mode: str = "verb_noun", causal_transitive: bool = True) -> DataFrame:
    """general, specific, score of each distinct pair of words: how far the specific word implies the general one.

    Equal words 1; d steps up 1 - d / (D + 1); entailed or caused directly 0.9; caused by what lies k steps up
    0.9 (1 - k / (D + 1)), unless ``causal_transitive`` is off; the best of these, else 0.
    """
    pairs = pairs.select("general", "specific").distinct()
    found = entailing_words(pairs.select(F.col("general").alias("word")), pairs.select(F.col("specific").alias("word")), lemma_synset, edges, max_depth=max_depth, pos_mode=pos_mode, causal_transitive=causal_transitive)
    return pairs.join(found, ["general", "specific"], "left").select("general", "specific", F.coalesce("score", F.lit(0.0)).alias("score"))


def entailing_words(general: DataFrame, specific: DataFrame, lemma_synset: DataFrame, edges: DataFrame, *, max_depth: int = 4, pos_mode: str = "verb_noun", causal_transitive: bool = True) -> DataFrame:
    """general, specific, score of the words (word) of two vocabularies that have a score, as in ``entailment_scores``.

    The specific words are indexed by every synset that they imply, with the score; the general ones look theirs up. So a
    pair is made only where the one implies a synset of the other, or where the words are equal.
    """
    s = synsets(specific, lemma_synset, pos_mode)
    up = ancestors(s.select("synset"), edges, max_depth)
    scale = F.lit(float(max_depth + 1))
    reached = up.select("synset", F.col("ancestor").alias("to"), (1.0 - F.col("depth") / scale).alias("score"))
    entails = edges.filter("kind = 'entailment'").select(F.col("src").alias("synset"), F.col("dst").alias("to"), F.lit(0.9).alias("score"))
    cause = edges.filter("kind = 'cause'").select(F.col("src").alias("ancestor"), F.col("dst").alias("to"))
    caused = up.filter(F.lit(causal_transitive) | (F.col("depth") == 0)).join(cause, "ancestor").select("synset", "to", (0.9 * (1.0 - F.col("depth") / scale)).alias("score"))
    implied = s.withColumnRenamed("word", "specific").join(reached.unionByName(entails).unionByName(caused), "synset").groupBy("specific", "to").agg(F.max("score").alias("score"))
    g = synsets(general, lemma_synset, pos_mode).select(F.col("word").alias("general"), F.col("synset").alias("to"))
    met = g.join(implied, "to").select("general", "specific", "score")
    same = general.select("word").distinct().join(specific.select("word").distinct(), "word").select(F.col("word").alias("general"), F.col("word").alias("specific"), F.lit(1.0).alias("score"))
    return met.unionByName(same).groupBy("general", "specific").agg(F.max("score").alias("score"))


def semantic_matches(hyp: DataFrame, ctx: DataFrame, lemma_synset: DataFrame, edges: DataFrame, *, threshold: float = 0.3, max_depth: int = 4, stop=STOP_TOKENS, pos_mode: str = "verb_noun", causal_transitive: bool = True) -> DataFrame:
    """kb, name, arity, ctx_name, ctx_arity, score: the best other context predicate by meaning.

    A predicate's score is the mean over its content tokens of the best token of the other; ties go to the first. Words are
    scored once for all knowledge bases, and predicates meet on words that have a score: with a threshold above 0 no other
    pair can reach it. One of 0 or less also admits pairs without such words, within each knowledge base.
    """
    h = hyp.select("kb", "name", "arity", "place", content_tokens(F.col("name"), stop, fold=False).alias("t")).withColumn("n", F.size("t"))
    c = ctx.select("kb", F.col("name").alias("ctx_name"), F.col("arity").alias("ctx_arity"), F.col("place").alias("ctx_place"), content_tokens(F.col("name"), stop, fold=False).alias("u"))
    left, right = h.select("kb", "name", "arity", "place", "n", F.posexplode("t").alias("i", "general")), c.select("kb", "ctx_name", "ctx_arity", "ctx_place", F.explode("u").alias("specific"))
    scores = entailing_words(left.select(F.col("general").alias("word")), right.select(F.col("specific").alias("word")), lemma_synset, edges, max_depth=max_depth, pos_mode=pos_mode, causal_transitive=causal_transitive)
    keys = ["kb", "name", "arity", "place", "n", "ctx_name", "ctx_arity", "ctx_place"]
    best = left.join(scores, "general").join(right, ["kb", "specific"]).filter("name <> ctx_name").groupBy(*keys, "i").agg(F.max("score").alias("best"))
    scored = best.groupBy(*keys).agg((F.sum("best") / F.first("n")).alias("score"))
    if threshold <= 0:
        every = h.filter("n > 0").drop("t").join(c.filter(F.size("u") > 0).drop("u"), "kb").filter("name <> ctx_name")
        scored = every.join(scored, keys, "left").select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = scored.filter(F.col("score") >= threshold)
    first = Window.partitionBy("kb", "name").orderBy(F.desc("score"), "ctx_place", "ctx_name")
    return scored.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("kb", "name", "arity", "place", "ctx_name", "ctx_arity", "score")


# programs


def _table(df: DataFrame, preds: str) -> DataFrame:
    return df.select("kb", F.posexplode(preds).alias("place", "p")).select("kb", "place", "p.name", "p.arity")


def _rules(matches: DataFrame) -> DataFrame:
    rule = C.bridge_rule(F.col("name"), F.col("arity"), F.col("ctx_name"), F.col("ctx_arity"))
    rank = F.col("rank") if "rank" in matches.columns else F.lit(1)
    return matches.groupBy("kb").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", rank.alias("rank"), rule.alias("rule")))), lambda x: x["rule"]).alias("rules"))


def _inject(df: DataFrame, matches: DataFrame, label: str) -> DataFrame:
    return df.join(_rules(matches), "kb", "left").withColumn("program", C.with_rules(F.col("program"), F.col("rules"), label)).drop("rules")


def align(df: DataFrame, how: Alignment, lemma_synset: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``df`` (kb, program, goal, context, scenario, context_constants, scenario_constants) with program and goal rewritten.

    Which predicates are undefined is judged before any rule is added for shared tokens, and after all for meaning.
    """
    df = df.withColumn("ctx_preds", C.block_predicates(F.col("context"))).withColumn("goal_preds", C.goal_predicates(F.col("goal"))).withColumn("defined", C.defined_predicates(F.col("program")))
    df = df.withColumn("ctx_preds", F.coalesce("ctx_preds", F.array().cast(C.PREDICATES)))
    if how.constant_align:
        theirs, ours = (C.typed_constants(F.col(c), how.constant_align_types) for c in ("context_constants", "scenario_constants"))
        some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
        df = df.withColumn("program", F.when(some(theirs), C.context_with_wildcards(F.col("program"), theirs)).otherwise(F.col("program")))
        df = df.withColumn("goal", F.when(some(ours), C.goal_with_wildcards(F.col("goal"), ours, F.col("ctx_preds"))).otherwise(F.col("goal")))
    if how.normalize:
        df = _inject(df, normalized_matches(_table(df, "goal_preds"), _table(df, "ctx_preds"), how.stop_tokens), "normalize")
    if how.aliases:
        look = lambda preds, name: F.get(F.filter(F.col(preds), lambda p: p["name"] == name), F.lit(0))["arity"]
        rules = [C.bridge_rule(F.lit(h), F.coalesce(look("goal_preds", h), look("defined", h), F.lit(0)), F.lit(c), F.coalesce(look("defined", c), look("ctx_preds", c), F.lit(0))) for h, c in how.aliases.items()]
        df = df.withColumn("program", C.with_rules(F.col("program"), F.array(*rules), "aliases"))
    if how.bridge_rules:
        df = df.withColumn("program", C.with_rules(F.col("program"), F.array(*[F.lit(r) for r in how.bridge_rules]), "manual"))
    if how.auto_bridge:
        missing = undefined(_table(df, "goal_preds"), _table(df, "defined"))
        df = _inject(df, jaccard_matches(missing, _table(df, "ctx_preds"), how.auto_bridge_threshold, how.auto_bridge_top_k), "auto_bridge")
    if how.semantic_bridge:
        if lemma_synset is None or edges is None:
            raise ValueError("semantic_bridge needs lemma_synset and edges")
        now = df.withColumn("defined", C.defined_predicates(F.col("program")))
        missing = undefined(_table(now, "goal_preds"), _table(now, "defined"))
        found = semantic_matches(missing, _table(df, "ctx_preds"), lemma_synset, edges, threshold=how.semantic_bridge_threshold, max_depth=how.semantic_bridge_max_depth, stop=how.stop_tokens, pos_mode=how.semantic_bridge_pos)
        df = _inject(df, found, "semantic_bridge")
    return df.drop("ctx_preds", "goal_preds", "defined")
