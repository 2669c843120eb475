"""Goldens of the column functions."""

import math
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from currikit.functions import margins as M
from currikit.functions import similarity as S
from currikit.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over one row of literals."""

    def of(make, schema="x string, y string", *row):
        df = spark.createDataFrame([row], schema)
        return df.select(make(*(F.col(c) for c in df.columns)).alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("  a  b\t c  ", "a b c"),
        ("```python\nx = 1\n```", "x = 1"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        (" \x1f wide 　", "wide"),
        ("``````é x", "x"),
    ],
)
def test_normalize_text(value, text, want):
    assert value(T.normalize_text, "x string", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/** Adds.\n * Two numbers.\n *\n * More. */", "Adds.\nTwo numbers.\nMore."),
        ("// # only the first mark", "# only the first mark"),
        ("### title\r\n\r\n  body \x85 end", "title\nbody\nend"),
        (" \n\t ", ""),
        (None, ""),
    ],
)
def test_clean_docstring(value, text, want):
    assert value(T.clean_docstring, "x string", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", "empty"),
        ("see <code>x</code> for more words", "code_block"),
        ("a = (b[c]); {d} == e", "code_like"),
        ("you may return x from here at any time", "contains_code"),
        ("Sorry, I cannot do what you want here", "assistant_refusal"),
        ("two words", "too_short"),
        ("a fine docstring of words", None),
        ("éreturn value is no keyword in this place", None),
    ],
)
def test_bad_docstring_reason(value, text, want):
    assert value(T.bad_docstring_reason, "x string", text) == want


@pytest.mark.parametrize("text", ["", "café_x 12 naïve", "a.b, c!", "日本 語", "x_1 _y 2z é"])
def test_tokens(value, text):
    assert value(T.token_len, "x string", text) == len(re.findall(r"\w+|[^\w\s]", text))
    assert value(T.word_tokens, "x string", text) == re.findall(r"[A-Za-z_]\w*", text.lower())


def test_special_and_english(value):
    assert [value(T.has_special_tokens, "x string", t) for t in ("see HTTP://x", "<img src>", "<imgs", "a < b > c", "</p>", "www.x")] == [True, True, False, False, True, True]
    assert [value(T.is_probably_english, "x string", t) for t in ("plain", "é", "123", "", "abcdefghijklé")] == [True, False, False, False, True]


def test_synthetic_candidates(value):
    assert value(T.synthetic_candidates, "x string", "Return the list of all users now") == ["validates the list of all users now", "Return the list of all now users"]
    assert value(T.synthetic_candidates, "x string", "It creates one, then CREATE two") == ["It deletes one, then CREATE two", "It creates one, then two CREATE"]
    assert value(T.synthetic_candidates, "x string", "returned createsx") == []


def test_truncation(value):
    tokens = [str(i) for i in range(100)]
    cut = lambda b: value(lambda x: T.truncate_middle(x, F.lit(b)), "x array<string>", tokens)
    assert cut(200) == tokens and cut(16) == tokens[:16]
    assert cut(40) == [*tokens[:26], T.TRUNCATED, *tokens[-14:]]
    assert cut(17) == [*tokens[:11], T.TRUNCATED, *tokens[-6:]]


def test_extract_text(value):
    kind = "x array<struct<role:string,content:string>>"
    assert value(lambda x: T.extract_text(messages=x), kind, [("system", "s"), ("user", " u "), ("user", "v")]) == "u"
    assert value(lambda x: T.extract_text(messages=x), kind, [("system", "s")]) == '[{"role":"system","content":"s"}]'
    assert value(T.extract_text, "x string", None) == ""


@pytest.mark.parametrize(("text", "want"), [("0.3", 0.3), ("true", None), ("nan", None), ("inf", None), (None, None), ("x", None), ("-1e2", -100.0)])
def test_safe_float(value, text, want):
    assert value(M.safe_float, "x string", text) == want


def test_safe_float_of_booleans(value):
    assert value(M.safe_float, "x boolean", True) == 1.0
    assert math.isnan(value(lambda x: M.safe_float(x, finite=False), "x string", "NaN"))


@pytest.mark.parametrize(("margin", "want"), [(-0.5, 1e-4), (0.0, 0.5), (0.5, 1 - 1e-4), (10.0, 1 - 1e-4), (-10.0, 1e-4), (None, None)])
def test_margin_to_probability(value, margin, want):
    assert value(M.margin_to_probability, "x double", margin) == want


def test_empty_range():
    with pytest.raises(ValueError):
        M.Pooling(0.5, 0.5)


@settings(max_examples=15, deadline=None)
@given(st.floats(0.0001, 0.9999), st.floats(0.0001, 0.9999))
def test_pooling(spark, p, q):
    one, both, twice = spark.range(1).select(M.bayes_pool([F.lit(p)]), M.bayes_pool([F.lit(p), F.lit(None).cast("double"), F.lit(q)]), M.bayes_pool([F.lit(p), F.lit(p)])).first()
    assert one == pytest.approx(p) and both == pytest.approx(p * q / (p * q + (1 - p) * (1 - q))) and twice == pytest.approx(p * p / (p * p + (1 - p) ** 2))


def test_no_source(value):
    none = F.lit(None).cast("double")
    assert value(lambda x: M.bayes_pool([none]), "x string", "") is None
    assert value(lambda x: M.score_margin(F.lit(0.1), none), "x string", "") == -math.inf
    assert value(lambda x: M.score_margin(F.lit(0.25), none, "boundary"), "x string", "") == pytest.approx(math.exp(-1))
    with pytest.raises(ValueError):
        M.score_margin(F.lit(0.1), none, "other")


@pytest.mark.parametrize(("a", "b"), [("tide", "diet"), ("diet", "tide"), ("abc" * 80, "abd" * 80), ("", ""), ("x", "")])
def test_char_similarity(spark, a, b):
    df = spark.createDataFrame([(a, b), (None, b)], "a string, b string")
    got = [r[0] for r in df.select(S.char_similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio(), None]


def test_bleu_forms_agree(spark):
    pairs = [("the cat sat on the mat", "the cat the cat sat"), ("a b c", ""), ("a", "a"), ("x y z x y z", "x y z x y z"), ("p q r s t", "t s r q p p p")]
    df = spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(pairs)], "id int, ref array<string>, pred array<string>")
    both = S.smoothed_bleu(df, "id", "ref", "pred").withColumn("one", S.bleu(F.col("ref"), F.col("pred"))).collect()
    assert {r.id for r in both} == set(range(len(pairs)))
    for r in both:
        assert r.one == pytest.approx(r.bleu)
        if r.ref == r.pred and len(r.ref) > 3:
            assert r.bleu == pytest.approx(100.0)


def test_hardness(spark):
    good, near = "Loads the user table from the given path and returns rows", "Loads the order table from a given file and drops rows"
    rows = [(0, good, near), (1, good, good), (2, good, "I cannot do this with what I know of it"), (3, good, "too short"), (4, None, near)]
    out = {r.id: r.hardness for r in S.with_hardness(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").collect()}
    assert [i for i, h in out.items() if h] == [0]
    h = out[0]
    assert h.sim_char == SequenceMatcher(None, good, near).ratio() and h.candidate == near and 0 < h.bleu < 70
    band = 1 - min(1, abs(h.bleu - 28) / 42)
    assert h.score == pytest.approx(1.2 * band + 0.8 - abs(h.sim_char - 0.48) + 0.65 - abs(h.sim_jacc - 0.22) + 0.35 * h.len_ratio)


def test_lists():
    assert T.language_list(None) == list(T.LANGUAGES) == T.language_list("all")
    assert T.language_list("go, php\truby") == ["go", "php", "ruby"]


def test_char_ratio_is_that_of_difflib():
    import random
    from difflib import SequenceMatcher

    draw = random.Random(3)
    for i in range(400):
        letters = ("ab", "abcdefgh .", "abcdefghijklmnopqrstuvwxyz   ABCDEFG.,é漢")[i % 3]
        a, b = ("".join(draw.choice(letters) for _ in range(draw.randrange(320))) for _ in range(2))
        b = b[:40] + a[50:150] + b[40:] if i % 4 else b
        assert S.char_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_hardness_work_is_dealt_out_and_done_once(spark):
    rows = spark.createDataFrame([("Returns the sum of a list of numbers.", "Returns the mean of a list of integers.")] * 64, "a string, b string").coalesce(1)
    out = S.with_hardness(rows, "a", "b").where("hardness IS NOT NULL")
    assert out.count() == 64
    assert out.rdd.getNumPartitions() > 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan  # BLEU by places of each n-gram took time by the square of the words
    assert "regexp" not in "".join(line for line in plan.splitlines() if "Filter" in line)  # nothing is cleaned again for a filter


def test_ngrams_stay_in_the_task_of_their_pair(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "a", "b", "a"]), (2, [], ["x"]), (3, ["x"], [])], "id int, ref array<string>, pred array<string>")
    out = S.ngram_overlap(df, "id", "ref", "pred", 2)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 4), (1, 2, 2, 3), (2, 1, 0, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1 and "Join" not in plan
