from pyspark.sql import functions as F

from lemmata.functions import text as T
from lemmata.operators.scoring import _normal


def run(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalized_answer(spark):
    assert run(spark, T.normalized_answer, "The  Cat, an <b>owl</b>!", "the", "<p>yes</p>", None) == ["cat bowlb", "", "pyesp", None]


def test_normalized_answer_of_marks_and_letters(spark):
    texts = ["a\u0301 cat", "\u00e1 the\u0301", "na an_a 1a the2 \u00e9a a\u00e9", "a a\u00a0an the a", "x\u0308a \u0627\u0644 a", "a"]
    assert run(spark, T.normalized_answer, *texts) == [_normal(t) for t in texts]


def test_answer_tokens_of_null_and_text(spark):
    assert run(spark, T.answer_tokens, None, "a b b c") == [[], ["b", "b", "c"]]


def test_fol_goal(spark):
    got = run(spark, T.fol_goal, "Exists(t) CourtHearsBack(me, t)", "Exists(x) AdopterAgeReq(x, uk)", "CanClaimChildTaxCredit(you)", "", "IsOpen")
    assert got == ["court_hears_back(me, T)", "adopter_age_req(X, uk)", "can_claim_child_tax_credit(you)", "", "is_open"]


def test_normalized_name(spark):
    assert run(spark, T.normalized_name, "time_to_hear_back_from_court", "can_apply_special_guardian", "to_from") == ["time_hear_back_court", "apply_special_guardian", "to_from"]


def test_parsed_answer(spark):
    got = run(spark, T.parsed_answer, "Not sure", "I cannot tell", "cannot say", "Not_Answerable", "Well, yes", "", "No.")
    assert got == ["no", "not answerable", "no", "not answerable", "yes", "not answerable", "no"]


def test_goals(spark):
    assert run(spark, T.clean_goal, "?- p(me). % check", "p(a)..") == ["p(me)", "p(a)"]
    assert run(spark, T.goal_variables, "p(_A0, T, 'London', _)") == [["T", "London"]]


def test_jaccard(spark):
    df = spark.createDataFrame([("can_apply_x", "can_claim_x")], "a string, b string")
    assert df.select(T.token_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_collapsed_takes_no_break_space(spark):
    assert run(spark, T.collapsed, " a \n b ") == ["a b"]


def test_intros(spark):
    s = "You can get help if you are over 18:"
    assert run(spark, T.is_rule_intro, s, "Hello") == [True, False]
    assert run(spark, T.outcome, s, "You can claim") == ["NOT_ELIGIBLE", "ELIGIBLE"]
    assert run(spark, T.list_operator, "One of the following", "All of the following apply", "x") == ["ANY", "ALL", None]


def test_sql_functions_are_the_column_functions(spark):
    from lemmata.functions import sql
    from lemmata.operators import scoring as S

    sql.register(spark)
    sql.register(spark)
    rows = [("The cat, an owl!", "cat"), ("", ""), (None, "a"), (None, None), ("a a b b b", "b c b"), ("á thé", "x"), ("yes no", "no yes")]
    df = spark.createDataFrame(rows, "g string, p string")
    x, y, none = F.coalesce("g", F.lit("")), F.coalesce("p", F.lit("")), F.array().cast("array<string>").alias("conditions")
    m = S.pair_metrics(F.struct(y.alias("answer"), none), F.struct(x.alias("answer"), none))
    want = df.select("g", T.normalized_answer(F.col("g")), T.answer_tokens(F.col("g")), m["em"], S.answer_f1(F.col("g"), F.col("p"))).collect()
    got = df.selectExpr("g", "normalized_answer(g)", "answer_tokens(g)", "answer_em(g, p)", "answer_f1(g, p)").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
