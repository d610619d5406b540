import random

import pytest
from pyspark.sql import functions as F

from triagedeck.functions import prompts as px
from triagedeck.functions import text as tx
from triagedeck.functions.stem import STEP_2, STEP_3, STEP_4, porter, stem_tokens
from triagedeck.operators import labels as lb
from triagedeck.operators import reports as rp
from triagedeck.operators.splits import few_shot_block


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", " ", " \n ", "\t", " ", None])
def test_blank_text_is_empty(spark, text):
    assert one(spark, tx.has_text(F.lit(text).cast("string"))) is False


@pytest.mark.parametrize("text", ["\u2003\r\n", "the and of", "?!", "( . )", "It's \"not\" so..."])
def test_texts_without_content_are_dropped(spark, text):
    df = spark.createDataFrame(
        [(1, "major", 1, text), (2, "major", 1, "crash")],
        "bug_id long, bug_severity string, binary_severity int, description string",
    )
    kept = [r["bug_id"] for r in rp.preprocess_text(df).collect()]
    assert kept == [2]


def test_space_of_any_kind_goes_at_both_ends(spark):
    assert one(spark, tx.strip_space(F.lit("\r\n\u00a0build \t failed\u2003\n"))) == "build \t failed"


@pytest.mark.parametrize(
    "text, want",
    [
        ("crash log at http://logs.example.net/7 since noon", "crash log at URL since noon"),
        ("(see https://build.example.net/log?id=4#end) http", "(see URL http"),
        ("nothing here", "nothing here"),
        ("xhttp://a b", "xURL b"),
    ],
)
def test_urls(spark, text, want):
    assert one(spark, tx.replace_urls(F.lit(text))) == want


def test_code(spark):
    text = "a ```python\nx = `1`\n``` b ```js\ny``` c `inline` d"
    assert one(spark, tx.replace_code(F.lit(text))) == "a CODE b CODE c  d"


def test_long_fence_needs_no_stack(spark):
    text = F.concat(F.lit("a ```"), F.repeat(F.lit("x`y "), 100_000), F.lit("``` b"))
    assert one(spark, tx.replace_code(text)) == "a CODE b"


@pytest.mark.parametrize(
    "answer, want",
    [("SEVERE", 1), ("Not  severe", 0), ("0", 0), ("1", 1), ("0 or 1", -1), ("", -1), ("not severe 1", 0)],
)
def test_answers(spark, answer, want):
    assert one(spark, tx.classify_answer(F.lit(answer))) == want


def test_anchored_answer(spark):
    assert one(spark, tx.classify_answer(F.lit("it is severe"), anchored=True)) == -1


@pytest.mark.parametrize(
    "limit, want",
    [(6, ["t", "a", "b", "u", "v"]), (2, ["t", "u", "v"]), (-1, ["t", "a", "b", "c", "u", "v"])],
)
def test_prompt_budget(spark, limit, want):
    arr = lambda s: F.array(*[F.lit(c) for c in s])
    assert one(spark, px.splice(arr("stuv"), F.lit(2), arr("sabc"), limit)) == want


def test_template_is_filled_once(spark):
    got = one(spark, tx.fill_template("$a and $b", a=F.lit("$b"), b=F.lit("x")))
    assert got == "$b and x"


def test_severity_rules(spark):
    given = {7: "trivial", 21: "normal", 22: "blocker", 40: None, 41: "enhancement", 58: "minor"}
    df = spark.createDataFrame(list(given.items()), "bug_id long, bug_severity string").withColumn(
        "description", F.lit("x")
    )
    kept = {r["bug_id"] for r in lb.filter_severity(df).collect()}
    assert kept == {i for i, s in given.items() if s not in ("normal", "enhancement")}
    labels = {r["bug_id"]: r["binary_severity"] for r in lb.add_binary_label(df).collect()}
    assert {i for i, y in labels.items() if y == 1} == {22}


def test_nan_guard(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(ValueError):
        lb.nan_guard(df, ["x"])
    assert lb.nan_guard(df.limit(1), ["x"]).count() == 1


def test_few_shot_takes_both_examples_out(spark):
    rows = [(1, 0, "zero"), (2, 1, "one"), (3, 0, "more"), (4, 1, "x" * 300)]
    df = spark.createDataFrame(rows, "bug_id long, y int, text string")
    template = tx.fill_template(
        "$severe_descr/$non_severe_descr",
        severe_descr=F.col("severe_descr"),
        non_severe_descr=F.col("non_severe_descr"),
    )
    block, rest = few_shot_block(df, template, "bug_id", "y", "text")
    assert block.first()["examples"] == "one/zero"
    assert {r["bug_id"] for r in rest.collect()} == {3, 4}


def test_table_step_in_a_pipeline(spark):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(1, "major")], "bug_id long, bug_severity string")
    step = rp.TableStep(name="label", fn=lb.add_binary_label, kwargs={"severity": "bug_severity"})
    assert PipelineModel([step]).transform(df).first()["binary_severity"] == 1


# Word and stem pairs of the published algorithm description.
STEMS = """
caresses caress  ponies poni  ties ti  caress caress  cats cat  feed feed  agreed agre
plastered plaster  bled bled  motoring motor  sing sing  conflated conflat  troubled troubl
sized size  hopping hop  tanned tan  falling fall  hissing hiss  fizzed fizz  failing fail
filing file  happy happi  sky sky  relational relat  conditional condit  rational ration
valenci valenc  digitizer digit  conformabli conform  radicalli radic  differentli differ
vileli vile  analogousli analog  vietnamization vietnam  predication predic  operator oper
feudalism feudal  decisiveness decis  hopefulness hope  callousness callous  formaliti formal
sensitiviti sensit  sensibiliti sensibl  triplicate triplic  formative form  formalize formal
electriciti electr  electrical electr  hopeful hope  goodness good  revival reviv
allowance allow  inference infer  airliner airlin  gyroscopic gyroscop  adjustable adjust
defensible defens  irritant irrit  replacement replac  adjustment adjust  dependent depend
adoption adopt  homologou homolog  communism commun  activate activ  angulariti angular
homologous homolog  effective effect  bowdlerize bowdler  probate probat  rate rate  cease ceas
controll control  roll roll
""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, stem):
    assert porter(word) == stem


def test_stem_expressions_follow_the_rules(spark):
    rng = random.Random(3)
    ends = [*STEP_2, *STEP_3, *STEP_4, "ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "yy", ""]
    words = STEMS[::2] + ["", "Y", "yes", "Yed", "sYZYgy", "İs", "\u0085", "ab" * 20000 + "ing", "y" * 9000 + "ed"]
    for _ in range(6000):
        head = "".join(rng.choice("aeiouybctlszéß9_") for _ in range(rng.randint(0, 5)))
        words.append(head + "".join(rng.choice(ends) for _ in range(rng.randint(0, 2))))
    rows = [(words[i : i + 50],) for i in range(0, len(words), 50)]
    got = spark.createDataFrame(rows, "t array<string>").select("t", stem_tokens("t").alias("s")).collect()
    assert [s for r in got for s in r["s"]] == [porter(t) for r in got for t in r["t"]]


def test_stems_of_nothing(spark):
    df = spark.createDataFrame([(None,), ([],), ([None, "cats"],)], "t array<string>")
    assert [r["s"] for r in df.select(stem_tokens("t").alias("s")).collect()] == [None, [], [None, "cat"]]
