import itertools

import numpy as np
import pytest

from chronowave import Frame, Wave
from chronowave.operators import select, windows
from chronowave.plans.expression import evaluate


def frame(spark, **signals):
    widths = {n: max(1, max(v).bit_length()) for n, v in signals.items()}
    return Frame.from_arrays(spark, signals, widths)


def test_unsigned_arithmetic_wraps_at_64_bits(spark):
    a, b = [0, 1, 5, 255, 200], [3, 0, 7, 2, 9]
    f = Frame.from_arrays(spark, {"a": a, "b": b}, {"a": 8, "b": 8})
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    for op in ("__add__", "__sub__", "__mul__", "__and__", "__or__", "__xor__"):
        assert getattr(f["a"], op)(f["b"]).rows() == getattr(x, op)(y).tolist(), op
    assert (f["a"] // f["b"]).rows() == [p // q if q else 0 for p, q in zip(a, b)]
    assert (f["a"] % f["b"]).rows() == [p % q if q else 0 for p, q in zip(a, b)]
    assert ((f["a"] - f["b"]) * (f["a"] - f["b"])).rows() == ((x - y) * (x - y)).tolist()
    assert (f["a"] + f["b"]).width == 9 and (f["a"] * f["b"]).width == 16 and (f["a"] - 1).width == 8
    assert (f["a"] / f["b"]).rows()[1] == float("inf") and (f["a"] / f["b"]).width is None


def test_signed_division_is_floored(spark):
    f = Frame.from_arrays(spark, {"a": [-7, -8, 7, 0, -1]}, {"a": 8}, signed=("a",))
    for d in (2, -3, 0):
        assert (f["a"] // d).rows() == [v // d if d else 0 for v in (-7, -8, 7, 0, -1)]
        assert (f["a"] % d).rows() == [v % d if d else 0 for v in (-7, -8, 7, 0, -1)]


def test_bits(spark):
    v = [0b10110, 0b00001, 0b11111, 0]
    f = Frame.from_arrays(spark, {"v": v}, {"v": 5})
    assert f["v"][4:2].rows() == [x >> 2 for x in v] and f["v"][0].rows() == [x & 1 for x in v]
    assert (~f["v"]).rows() == [x ^ 31 for x in v] and f["v"].bit_count().rows() == [x.bit_count() for x in v]
    assert f["v"].as_signed().rows() == [x - 32 if x > 15 else x for x in v]
    assert f["v"].as_signed().as_unsigned().rows() == v
    parts = f["v"].split_bits([2, 3])
    assert Wave.concatenate(parts).rows() == v and [p.width for p in f["v"].split_bits(2, padding=True)] == [2, 2, 1]
    assert (f["v"] << 62).rows() == [x << 62 for x in v] and (f["v"] >> 70).rows() == [0] * 4
    with pytest.raises(ValueError):
        f["v"].split_bits(2)
    with pytest.raises(ValueError):
        f["v"] & 64
    with pytest.raises(TypeError):
        f["v"] & 1.5


def test_wide_values(spark):
    v = [(1 << 65) + 3, (1 << 80) + 3]
    f = Frame.from_arrays(spark, {"v": v}, {"v": 96})
    assert f["v"][66:60].rows() == [(x >> 60) & 127 for x in v] and f["v"].bit_count().rows() == [3, 3]
    with pytest.raises(ValueError):
        f["v"] + 1


def test_selection(spark):
    v = [5, 5, 7, 7, 7, 5]
    f = Frame.from_arrays(spark, {"v": v, "m": [1, 0, 1, 0, 0, 1]}, {"v": 4}, clock=[10, 11, 12, 20, 21, 22])
    values = lambda x, name="value": [r[name] for r in x.df.orderBy("idx").collect()]
    assert values(select.mask(f["v"], f["m"])) == [5, 7, 5]
    assert values(select.unique_consecutive(f["v"])) == [5, 7, 5]
    assert values(select.compress(f["m"]), "clock") == [10, 11, 12, 20, 22]
    assert values(select.cycle_slice(f, 11, 20), "v") == [5, 7] and values(select.cycle_slice(f, 11, 20, True), "v") == [5, 7, 7]
    assert values(select.time_slice(f, 110, 201), "v") == [5, 7, 7]
    assert values(select.index_slice(f, -3, -1), "clock") == [20, 21]
    assert values(select.take(f, [5, 0, 0, -2]), "clock") == [22, 10, 10, 21]
    with pytest.raises(TypeError):
        select.mask(f["v"], f["v"])
    with pytest.raises(TypeError):
        select.take(f, [True])


def test_windows(spark):
    b = [0, 1, 1, 0, 1, 0]
    f = Frame.from_arrays(spark, {"b": b, "v": [1, 2, 3, 4, 5, 6]}, {"v": 4})
    assert windows.rising_edge(f["b"]).rows() == [0, 1, 0, 0, 1, 0] and windows.falling_edge(f["b"]).rows() == [0, 0, 0, 1, 0, 1]
    assert windows.ahead(f["v"], 2).rows() == [3, 4, 5, 6, 6, 6] and windows.back(f["v"], 1).rows() == [1, 1, 2, 3, 4, 5]
    assert windows.relative(f["v"], 9).rows() == [6] * 6 and windows.relative(f["v"], -2, "value", 0).rows() == [0, 0, 1, 2, 3, 4]
    got = windows.downsample(f["v"], 4).orderBy("idx").collect()
    assert [(r["value"], r["clock"], r["time"]) for r in got] == [(2.5, 1.5, 15.0), (5.5, 4.5, 45.0)]
    assert [r["length"] for r in windows.run_lengths(f["b"]).orderBy("k").collect()] == [3, 2]


def test_expressions(spark):
    f = Frame.from_arrays(spark, {"a": [6, 7], "b": [2, 3]}, {"a": 4, "b": 4})
    names = {"a": f["a"], "b": f["b"]}
    assert evaluate("(a + b)[2:0] * 2", names).rows() == [((6 + 2) & 7) * 2, ((7 + 3) & 7) * 2]
    assert evaluate("~a & 3", names).rows() == [1, 0] and evaluate("a == 7", names).rows() == [0, 1]
    for bad in ("__import__('os')", "a.b", "f(a)", "a if b else a", "c + 1", "a +"):
        with pytest.raises(ValueError):
            evaluate(bad, names)


def test_random_products(spark):
    r = np.random.default_rng(1)
    a = [int(x) for x in r.integers(0, 1 << 63, 20)] + [0, (1 << 63) - 1]
    f = Frame.from_arrays(spark, {"a": a}, {"a": 63})
    assert (f["a"] * f["a"]).rows() == [x * x % (1 << 64) for x in a] and (f["a"] ** 3).rows() == [x**3 % (1 << 64) for x in a]
    for x, y in itertools.pairwise([f["a"], f["a"] + 1]):
        assert (x - y).rows() == [(1 << 64) - 1] * len(a)
