import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.values import compare_values, extract_field, prefix_upper_bound, values_equal

scalars = st.one_of(st.none(), st.booleans(), st.integers(-(2**40), 2**40), st.floats(allow_nan=False), st.text(max_size=5))
values = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=2), x, max_size=3)), max_leaves=5)


def test_chain_increases():
    chain = [None, False, True, -7, 3.14, "a", [1], {"k": 1}]
    assert all(compare_values(a, b) < 0 for a, b in zip(chain, chain[1:], strict=False))


def test_numbers_strings_and_structures():
    for a, b in [(-5, 3), (-1, 0), (-1000000, -1), (-2.5, -1.5), (-0.1, 0.1), (4, 4.5), (4.5, 5)]:
        assert compare_values(a, b) < 0
    assert values_equal(5, 5.0) and compare_values("10", "9") < 0 and compare_values(10, 9) > 0
    assert compare_values([1, 2], [1, 3]) < 0 and compare_values([1], [1, 0]) < 0
    assert compare_values({"a": 1}, {"a": 2}) < 0 and values_equal({"b": 1, "a": 2}, {"a": 2, "b": 1})
    assert compare_values(-0.0, 0.0) < 0


@settings(max_examples=200, deadline=None)
@given(values, values, values)
def test_order_laws(a, b, c):
    assert compare_values(a, b) == -compare_values(b, a)
    if compare_values(a, b) <= 0 and compare_values(b, c) <= 0:
        assert compare_values(a, c) <= 0


def test_paths():
    doc = {"a": {"b": 1}, "x": [1]}
    assert extract_field(doc, "a.b") == 1 and extract_field(doc, "a.c") is None and extract_field(doc, "x.0") is None


def test_prefix_upper_bound():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("ab\U0010ffff퟿") for _ in range(rng.randint(1, 3)))
        bound = prefix_upper_bound(p)
        assert bound is None and set(p) == {"\U0010ffff"} or bound.encode() > (p + "\U0010ffff").encode()
