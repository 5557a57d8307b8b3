"""Inputs of models: text of samples, context strings, job rows, prompt blocks and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.functions.text import context_text
from lemmata.sources.records import last_of_each, numbered

SYSTEM = "Read the text and write its constants, predicates, facts and rules, in first-order logic and as Prolog clauses."
SYSTEM_WITH_HYPOTHESIS = SYSTEM + " Also write the question as one hypothesis in both forms."
USER = "Formalise this text."
BATCH_HEAD = "Formalise each of the items below by itself, and reply with one record an item, in their order."
SYSTEM_ANSWER = "Decide from the policy text whether the answer to the question is yes or no. Reply with one of: yes, no, not answerable."
EXAMPLES = (
    ("A library lends to people who live in the town.", "I live in the town. May I borrow a book?", "yes"),
    ("Parking is free on Sundays only.", "Today is Monday. Is parking free?", "no"),
    ("The office opens at nine.", "I sold my car. Do I need a permit?", "not_answerable"),
)


def contents_text(contents: Column) -> Column:
    """Lines of a document joined; null where nothing is left, which callers may quarantine."""
    t = F.trim(F.array_join(contents, "\n"))
    return F.when(t != "", t)


def tree_text(tree: Column, contents: Column) -> Column:
    """The rendered tree without blank lines, else the lines of the document."""
    t = F.array_join(F.filter(F.split(tree, "\n"), lambda x: F.trim(x) != ""), "\n")
    return F.coalesce(F.when(t != "", t), contents_text(contents))


def question_text(scenario: Column, question: Column) -> Column:
    """Scenario and question; null unless both hold text."""
    a, b = F.trim(scenario), F.trim(question)
    return F.when((a != "") & (b != ""), F.concat_ws("\n\n", a, b))


def predicate_lines(predicates: Column) -> Column:
    return F.array_join(F.transform(predicates, lambda p: F.concat(F.lit("- "), p["name"], F.lit("/"), p["arity"].cast("string"), F.lit(" — "), F.coalesce(p["gloss"], F.lit("")))), "\n")


def constant_lines(constants: Column) -> Column:
    return F.array_join(F.transform(constants, lambda c: F.concat(F.lit("- "), c["id"], F.lit(" — "), F.coalesce(c["gloss"], F.lit("")), F.lit(" (type: "), F.coalesce(c["type"], F.lit("unknown")), F.lit(")"))), "\n")


def context_strings(kbs: DataFrame, value: Column, name: str) -> DataFrame:
    """url and the context string of the last record of each url that has one."""
    return last_of_each(kbs.withColumn(name, value).filter(F.coalesce(F.col(name), F.lit("")) != ""), "url", "ordinal").select("url", name)


#: What reads the text of a sample, by task and input field.
EXTRACTORS = {
    ("context", "contents"): lambda: contents_text(F.col("contents")),
    ("context", "semantic_tree"): lambda: tree_text(F.col("semantic_tree"), F.col("contents")),
    ("question", "scenario_question"): lambda: question_text(F.col("scenario"), F.col("question")),
}


def extractor(task: str, field: str) -> Column:
    """The input text of a task's samples; an unknown pair is an error that names the known ones."""
    if (task, field) not in EXTRACTORS:
        raise ValueError(f"no input {field!r} for task {task!r}; there are {', '.join(f'{t}/{f}' for t, f in EXTRACTORS)}")
    return EXTRACTORS[task, field]()


def user_prompt(text: Column, predicates: Column | None = None, constants: Column | None = None, rules: Column | None = None) -> Column:
    """The request for one sample, with what is known of its context."""
    known = [F.when(F.length(v) > 0, F.concat(F.lit(f"Known {k}:\n"), v)) for k, v in (("predicates", predicates), ("constants", constants), ("rules", rules)) if v is not None]
    return F.concat_ws("\n\n", F.lit(USER), *known, F.concat(F.lit("Text:\n"), text))


def batch_prompt(blocks: Column) -> Column:
    """The request for several samples at once, from their blocks in order."""
    return F.concat(F.lit(BATCH_HEAD), F.lit("\n\n"), F.array_join(blocks, "\n\n"))


def blank_samples(samples: DataFrame, text: Column) -> DataFrame:
    """The samples that give no text, so that a run can report them instead of losing them."""
    return samples.withColumn("input_text", text).filter(F.col("input_text").isNull()).drop("input_text")


def jobs(samples: DataFrame, text: Column, order: str, *contexts: DataFrame, where: Column | None = None) -> DataFrame:
    """index, id, url, input_text and each context string (empty where there is none).

    Samples that ``where`` does not take, and samples without text (see ``blank_samples``), are left out before the rest are
    numbered from 0.
    """
    x = (samples if where is None else samples.filter(where)).withColumn("input_text", text).filter(F.col("input_text").isNotNull())
    x = numbered(x, order)
    out = x.select("index", "id", "url", "input_text")
    for c in contexts:
        name = next(k for k in c.columns if k != "url")
        out = out.join(c, "url", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def prompt_block(index: Column, text: Column, **sections: Column) -> Column:
    """One item of a batch prompt; sections without text are left out."""
    parts = [F.concat(F.lit("### Item "), index.cast("string"))]
    parts += [F.when(F.length(v) > 0, F.concat(F.lit(f"Known {k}:\n"), v)) for k, v in sections.items()]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Text:\n"), text))


def chat_messages(context: Column, scenario: Column, question: Column, few_shot: bool = False) -> Column:
    """role, content: instruction, examples if wanted, and the question with its context."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ask = lambda c, q: F.concat(F.lit("Policy:\n"), c, F.lit("\n\nQuestion:\n"), q)
    turns = [message("system", F.lit(SYSTEM_ANSWER))]
    if few_shot:
        for c, q, a in EXAMPLES:
            turns += [message("user", ask(F.lit(c), F.lit(q))), message("assistant", F.lit(a))]
    return F.array(*turns, message("user", ask(context, F.concat_ws("\n", scenario, question))))


def answer_input(contents: Column, most: int = 3000) -> Column:
    return context_text(contents, most)
