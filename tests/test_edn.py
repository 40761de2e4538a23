import uuid
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from eavspark.edn import BigInt, EdnError, Keyword, List, Set, Symbol, read, write


@pytest.mark.parametrize(
    "text, value",
    [
        ("nil", None), ("true", True), ("-12", -12), ("017", 15), ("0x1F", 31), ("36rZZ", 1295), ("12N", BigInt(12)), ("1.5e3", 1500.0), ("1e2", 100.0),
        ('"a\\n\\"b\\\\"', 'a\n"b\\'), (":a/b", Keyword("a/b")), ("?x", Symbol("?x")), ("[1,,2]", [1, 2]), ("(+ 1 2)", List((Symbol("+"), 1, 2))),
        ("#{1 2}", Set((1, 2))), ("{:a 1, :b [2]}", {Keyword("a"): 1, Keyword("b"): [2]}), ("; note\n 7 ", 7), ("#f +Infinity", float("inf")),
        ('#inst "1985-04-12T23:20:50.52+01:00"', datetime(1985, 4, 12, 22, 20, 50, 520000)), ("#instmillis 1000", datetime(1970, 1, 1, 0, 0, 1)),
        ('#uuid "550e8400-e29b-41d4-a716-446655440000"', uuid.UUID("550e8400-e29b-41d4-a716-446655440000")),
    ],
)
def test_read(text, value):
    assert read(text) == value


@pytest.mark.parametrize("text", ["[1 2", "1 2", ")", "{:a}", '"x', "9223372036854775808", '#inst "nope"', ""])
def test_refused(text):
    with pytest.raises(EdnError):
        read(text)


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.text() | st.floats(allow_nan=False) | st.uuids() | st.sampled_from([Keyword("a"), Keyword("x/y-z"), BigInt(10**30)]),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=3),
    max_leaves=8,
)


@given(values)
def test_round_trip(value):
    assert read(write(value)) == value
