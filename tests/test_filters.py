import pytest
from hypothesis import given
from hypothesis import strategies as st

from galena.errors import FilterSyntaxError
from galena.functions import metadata as M
from galena.plans.filters import Condition, Filter, typed

HELD = {"category": "finance", "year": 2026, "score": 0.75, "note": None, "n": 5, "x": 5.0, "name": "banana", "mixed": "hello", "big": (1 << 53) + 1}

CASES = {
    "year == 2026": True, 'year == "2026"': False, "year = 2026": True, "year != 2026": False, "year >= 2026 and category == finance": True,
    "year > 2025 AND score < 0.8": True, "n == 5": True, "n == 5.0": True, "x == 5": True, "x >= 5": True, "n < 6": True, "n > 5": False, "x > 5": False,
    'name > "apple"': True, "name < cherry": True, 'name != "apple"': True, "absent == 5": False, "absent != 5": False, "absent > 0": False,
    "mixed == 5": False, "mixed > 5": False, "mixed != 5": False, "": True, "   ": True, "note == 5": False, "note != 5": False,
    "big == 9007199254740992": False, "big == 9007199254740993": True, "score == 75e-2": True,
}


def test_conditions_hold_as_documented(spark):
    df = spark.createDataFrame([(1, M.tagged(HELD))], f"id long, metadata {M.METADATA.simpleString()}")
    row = df.select(*[Filter.parse(t).compile(df.metadata).alias(f"c{i}") for i, t in enumerate(CASES)]).first()
    assert dict(zip(CASES, row, strict=True)) == CASES


def test_null_matches_null_only(spark):
    df = spark.createDataFrame([(M.tagged(HELD),), ({},), (None,)], f"metadata {M.METADATA.simpleString()}")
    got = df.select(Filter((Condition("note", "==", None),)).compile(df.metadata), Filter((Condition("year", "==", None),)).compile(df.metadata), Filter.parse("year == 1").compile(df.metadata)).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, False, False)]


@pytest.mark.parametrize("text", ["category ==", "== 5", "a ~ 5", "a == 1 or b == 2", 'a == "unterminated', "a == 1 and2 == 3", "a == 1 b == 2", "a == 1 and", "a == nan", "a == -inf"])
def test_errors_show_a_position(text):
    with pytest.raises(FilterSyntaxError, match="position"):
        Filter.parse(text)


def test_values():
    assert [typed(x) for x in ("-3", "0.125", "1e3", "+5", "9223372036854775808", "1_0", "abc")] == [-3, 0.125, 1000.0, 5.0, 9223372036854775808.0, "1_0", "abc"]
    assert Filter.parse(r"a == 'say \'hi\''").conditions[0].value == "say 'hi'"


@given(st.text(st.characters(codec="utf-8"), max_size=20), st.sampled_from(["==", "<", "!="]))
def test_text_survives_rendering(value, op):
    f = Filter((Condition("k.e-y_1", op, value), Condition("n", ">=", 3)))
    assert Filter.parse(str(f)) == f
