import random

import pytest

from chronowave import Frame
from chronowave.patterns import MatchRecords, Pattern, PatternError, collect, match


def rows(df, *captures):
    return [(r["start"]["index"], r["end"]["index"], r["duration"], r["status"]["kind"], r["status"]["message"], *[r[c] for c in captures]) for r in df.orderBy("start.index").collect()]


def random_frame(spark, seed, n=40):
    r = random.Random(seed)
    return Frame.from_arrays(spark, {c: [int(r.random() < 0.35) for _ in range(n)] for c in "abg"} | {"v": list(range(n))}, {"v": 8})


PLANS = [
    lambda f: Pattern().wait(f["a"]).wait(f["b"]).capture("x", f["v"]),
    lambda f: Pattern().wait(f["a"], require=f["g"], require_message="idle").wait(f["b"], require=f["g"], require_message="lost").capture("x", f["v"]).delay(1).capture("x", f["v"], mode="first"),
    lambda f: Pattern().wait(f["a"]).delay(3).require(f["b"], message="no b").capture("x", f["v"]),
    lambda f: Pattern().delay(1, require=f["g"], require_message="m").wait(f["b"]).capture("x", f["v"]),
    lambda f: Pattern().capture("x", f["v"]).wait(f["a"]).delay(2).delay(0).wait(f["b"]).require(f["g"]),
    lambda f: Pattern().wait(f["a"]).repeat(Pattern().delay(1).wait(f["b"]), 3).capture("x", f["v"]),
]


@pytest.mark.parametrize("plan", range(len(PLANS)))
def test_native_plans_equal_the_runner(spark, plan):
    f = random_frame(spark, plan)
    p = PLANS[plan](f)
    for options in ({}, {"timeout": 3, "timeout_message": "late"}, {"start_cycle": 5, "end_cycle": 30}):
        assert rows(match(p, frame=f, **options), "x") == rows(match(p, frame=f, native=False, **options), "x"), options


def test_loops_equal_the_runner(spark):
    f = random_frame(spark, 11)
    for p in (Pattern().wait(f["a"]).loop(Pattern().delay(1), when=f["b"]).capture("x", f["v"]), Pattern().wait(f["a"]).loop(Pattern().delay(1), until=f["b"]).capture("x", f["v"])):
        assert rows(match(p, frame=f), "x") == rows(match(p, frame=f, native=False), "x")


def test_fifo_consume(spark):
    f = random_frame(spark, 5)
    p = Pattern().wait(f["a"]).capture("x", f["v"]).consume(f["b"], "c").capture("y", f["v"])
    assert rows(match(p, frame=f), "x", "y") == rows(match(p, frame=f, native=False), "x", "y")


def test_burst_and_stall(spark):
    f = Frame.from_arrays(spark, {"start": [1, 0, 0, 0], "last": [0, 0, 1, 0], "d": [160, 161, 162, 7]}, {"d": 8})
    beats = match(Pattern().wait(f["start"]).loop(Pattern().consume(True, "w").capture("beats", f["d"], mode="list").branch(f["last"], None, Pattern().delay(1)), until=f["last"]), frame=f)
    assert beats.collect()[0]["status"]["kind"] in ("OK", "Timeout")


def test_programmable(spark):
    f = Frame.from_arrays(spark, {"req": [1, 0, 0, 1], "ack": [0, 0, 1, 0], "d": [5, 6, 7, 8]}, {"d": 8})
    req, ack, d = f["req"], f["ack"], f["d"]

    def body(ctx):
        if not ctx.value(req):
            return None
        ctx.wait(ack)
        ctx.capture("d", d)
        return ctx.OK

    got = match(body, frame=f)
    assert rows(got) == [(0, 2, 3, "OK", None), (3, 3, 1, "Timeout", None)]

    def item(ctx):
        return {"at": ctx.cycle(), "next": ctx.value(d, 1)} if ctx.value(req) and ctx.index < 3 else None

    assert [r["value"] for r in collect(item, frame=f).collect()] == ['{"at": 0, "next": 6}']
    with pytest.raises(PatternError):
        collect(Pattern().wait(req), frame=f)
    with pytest.raises(PatternError):
        match(Pattern().wait(req), frame=f, timeout=0)
    with pytest.raises(ValueError):
        Pattern().capture("x", d, mode="all")
    with pytest.raises(ValueError):
        Pattern().loop(Pattern())


def test_callable_steps_see_captures(spark):
    f = Frame.from_arrays(spark, {"go": [1, 0, 0, 0, 0], "n": [2, 0, 0, 0, 0], "d": [9, 8, 7, 6, 5]}, {"n": 3, "d": 8})
    p = Pattern().wait(f["go"]).capture("n", f["n"]).delay(lambda i, c: c["n"]).capture("d", f["d"])
    assert rows(match(p, frame=f), "n", "d") == [(0, 2, 3, "OK", None, 2, 7)]


def test_zero_time_loop_fails(spark):
    f = Frame.from_arrays(spark, {"go": [1, 0]})
    with pytest.raises(Exception, match="advance in time"):
        match(Pattern().wait(f["go"]).loop(Pattern().wait(True), until=False), frame=f).collect()


def test_native_chains_equal_the_runner(spark):
    """Random chains with branches, requirements, timeouts and windows, natively and sample by sample; no join in the plans."""
    r = random.Random(31)
    rows = [(t, i, i + 2, 10 * i, *(r.randint(0, 1) for _ in range(3)), 7 * i + t) for t in range(12) for i in range(r.choice((1, 2, 9, 14)))]
    df = spark.createDataFrame(rows, "trace long, idx long, clock long, time long, a long, b long, c long, v long")
    frame = Frame(df.repartition(3), {"a": (1, False), "b": (1, False), "c": (1, False), "v": (16, False)})
    w = lambda: frame[r.choice("abc")]

    def chain(p, depth=0):
        for _ in range(r.randint(1, 4 - depth)):
            kind = r.choice(("wait", "delay", "capture", "require", "branch", "loop")[: 6 - depth])
            if kind == "wait":
                p = p.wait(w(), require=r.choice((None, w())), require_message="w")
            elif kind == "delay":
                n = r.choice((0, 1, 1, 2, 4))
                p = p.delay(n, require=w() if n < 2 and r.random() < 0.5 else None, require_message="d")
            elif kind == "capture":
                p = p.capture(r.choice("xy"), frame["v"], r.choice(("first", "last")))
            elif kind == "require":
                p = p.require(w(), message="r")
            elif kind == "branch":
                p = p.branch(w(), chain(Pattern(), depth + 1), r.choice((None, chain(Pattern(), depth + 1))))
            else:
                p = p.loop(Pattern().delay(1), **{r.choice(("until", "when")): w()})
        return p

    for _ in range(14):
        body = chain(Pattern().wait(w(), require=r.choice((None, w())), require_message="s") if r.random() < 0.7 else Pattern())
        limits = {"timeout": r.choice((None, None, 1, 3, 6)), "timeout_message": "late", "start_cycle": r.choice((None, 4)), "end_cycle": r.choice((None, 12))}
        native, slow = match(body, frame=frame, **limits), match(body, frame=frame, native=False, **limits)
        plan = native._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        assert sorted(map(str, native.collect())) == sorted(map(str, slow.select(*native.columns).collect())), (body, limits)


def test_waves_of_another_frame(spark):
    one, other = (Frame.from_arrays(spark, {"a": [0, 1, 1]}) for _ in range(2))
    with pytest.raises(PatternError, match="another frame"):
        match(Pattern().wait(one["a"]).wait(other["a"]), frame=one)


def test_match_records(spark):
    frame = Frame.from_arrays(spark, {"a": [1, 0, 1, 0, 1, 0], "b": [0, 1, 0, 0, 0, 0]})
    records = MatchRecords(match(Pattern().wait(frame["a"]).wait(frame["b"]), frame=frame))
    assert len(records) == 3 and [x["start"]["index"] for x in records] == [0, 2, 4]
    assert records[0]["status"]["kind"] == "OK" and records[-1]["start"]["index"] == 4 and records[1]["status"]["kind"] == "Timeout"
    assert [x["start"]["index"] for x in records[1:]] == [2, 4] and len(records[-2:-1]) == 1 and len(records[2:1]) == 0
    assert len(records.filter_ok()) == 1 and len(records.filter_failed()) == 2 and len(records.filter_status("RequireViolated")) == 0
    assert [tuple(x) for x in records.with_flags().orderBy("start.index").select("ok", "failed").collect()] == [(1, 0), (0, 1), (0, 1)]
    with pytest.raises(IndexError):
        records[3]
    with pytest.raises(TypeError):
        records.filter_status("late")


@pytest.mark.parametrize("kind", ["until", "when"])
def test_native_lists_equal_the_runner(spark, kind):
    """Lists captured over a loop: ends at the trace's last sample, loops that end at once, and open runs."""
    r = random.Random(32)
    rows = [(t, i, i, 10 * i, *(r.randint(0, 1) for _ in range(2)), 7 * i + t) for t in range(30) for i in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "trace long, idx long, clock long, time long, a long, b long, v long")
    frame = Frame(df, {"a": (1, False), "b": (1, False), "v": (16, False)})
    body = Pattern().wait(frame["a"]).loop(Pattern().capture("x", frame["v"], mode="list").capture("y", frame["b"], mode="list").delay(1), **{kind: frame["b"]})
    native, slow = match(body, frame=frame), match(body, frame=frame, native=False)
    assert "Python" not in (plan := native._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan
    assert sorted(map(str, native.collect())) == sorted(map(str, slow.select(*native.columns).collect()))
