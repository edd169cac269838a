"""From patterns to plans.

Native: chains of wait, constant delay, capture, require and branch on waves (running windows over one sort per trace, without a
join), loops whose body is ``delay(1)``, small constant repeats, one FIFO consume (rank arithmetic, split by trace and channel), and
lists captured over a loop (one array for each run). Everything else runs in the runner, one trace per group.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frame import Frame, Wave
from .builder import Pattern, Step
from .runner import OK, PatternError, Scan, waves_in

POINT = "struct<index:bigint,cycle:bigint,time:bigint>"
FAR = 1 << 62


def _truth(x: Any, frame: Frame) -> Column | None:
    if isinstance(x, bool):
        return F.lit(x)
    if isinstance(x, Wave) and x.frame is frame:
        return x.column != 0
    return None


def _flatten(steps: tuple[Step, ...], frame: Frame) -> list[Step] | None:
    """Steps that all have a native form, repeats unrolled and loops over ``delay(1)`` made waits; or None."""
    out: list[Step] = []
    for s in steps:
        conds = [s.args[k] for k in ("cond", "require") if s.args.get(k) is not None]
        if any(_truth(c, frame) is None for c in conds) or callable(s.args.get("message")):
            return None
        if s.kind in ("wait", "require"):
            out.append(s)
        elif s.kind == "delay" and isinstance(s.n, int) and not isinstance(s.n, bool) and 0 <= s.n <= 1000 and (s.require is None or s.n <= 1):
            out += [s] * (s.n > 0)
        elif s.kind == "capture" and isinstance(s.signal, Wave) and s.signal.frame is frame and s.mode != "list":
            out.append(s)
        elif s.kind == "branch":
            ways = [_flatten(b.steps if b else (), frame) for b in (s.true_body, s.false_body)]
            if None in ways:
                return None
            out.append(Step("branch", {"cond": s.cond, "ways": ways}))
        elif s.kind == "repeat" and isinstance(s.n, int) and 0 <= s.n <= 8:
            body = _flatten(s.body.steps, frame)
            if body is None:
                return None
            out += body * s.n
        elif s.kind == "loop" and [b.kind for b in s.body.steps] == ["delay"] and s.body.steps[0].n == 1 and s.body.steps[0].require is None:
            until = s.until if s.until is not None else s.when
            if _truth(until, frame) is None:
                return None
            # until: one step, then wait; when: wait for the condition to end.
            if s.until is not None:
                out.append(Step("delay", {"n": 1, "require": None, "message": None}))
            out.append(Step("loop_wait", {"cond": until, "negate": s.until is None}))
        else:
            return None
    return out


def _every(steps: list[Step]) -> list[Step]:
    """All steps in program order, those inside branches too."""
    return [x for s in steps for x in ([y for way in s.ways for y in _every(way)] if s.kind == "branch" else [s])]


def match(body: Any, *, frame: Frame, timeout: int | None = None, timeout_message: str | None = None, start_cycle: int | None = None, end_cycle: int | None = None, native: bool = True) -> DataFrame:
    """trace, start, end (index, cycle, time), duration, status (kind, message) and one column per capture.

    Starts outside ``[start_cycle, end_cycle)`` are left out, and the end also ends all waiting. Order by trace and start.
    """
    if timeout is not None and (isinstance(timeout, bool) or not isinstance(timeout, int) or timeout <= 0):
        raise PatternError("a timeout is a positive integer")
    if native and isinstance(body, Pattern):
        if timeout is None and start_cycle is None and end_cycle is None and (out := _fifo(body, frame) or _burst(body, frame)) is not None:
            return out
        chain = _flatten(body.steps, frame)
        # A loop's own guard and zero-step ends under a timeout are left to the runner.
        if chain is not None and not (timeout is not None and any(s.kind == "loop_wait" for s in _every(chain))):
            return _chain(chain, frame, timeout, timeout_message, start_cycle, end_cycle)
    return _run(body, frame, timeout, timeout_message, start_cycle, end_cycle)


def _chain(steps: list[Step], frame: Frame, timeout: int | None, timeout_message: str | None, start_cycle: int | None, end_cycle: int | None) -> DataFrame:
    """Backwards over the program: at every sample, the outcome of the steps from the k-th on is a struct, made from that of the
    steps from the next on. A wait takes the outcome found at the next sample where it holds, a delay that of a later sample.

    Samples are read in falling order, so "next" is "last seen", a linear running window; one exchange and one sort serve all
    steps, and nothing is joined. An outcome holds the sample where each step began (``p``), which decides about a timeout at
    the end: positions only rise, so the first step whose guard meets ``start + timeout`` is where a match times out.
    """
    df = frame.df if end_cycle is None else frame.df.where(F.col("clock") < end_cycle)
    back = W.partitionBy("trace").orderBy(F.desc("idx"))
    seen = back.rowsBetween(W.unboundedPreceding, W.currentRow)
    selects = bool(steps) and steps[0].kind == "wait"
    body = steps[1 if selects else 0 :]
    ops = [Step(s.kind, {**s.args, "k": k}) for k, s in enumerate(_every(body))]
    caps = [s for s in ops if s.kind == "capture"]
    types = {s.k: df.select(s.signal.column.alias("x")).schema["x"].dataType for s in caps}
    names = list(dict.fromkeys(s.name for s in caps))
    numbered = iter(ops)

    def number(some: list[Step]) -> list[Step]:
        return [Step("branch", {**s.args, "ways": [number(way) for way in s.ways]}) if s.kind == "branch" else next(numbered) for s in some]

    def outcome(kind: str | None, text: str | None, at: Column | None = None, **fields: Column) -> Column:
        """An outcome at this sample, or at another one given as (idx, clock, time)."""
        point = [F.col(c).cast("bigint").alias(c) if at is None else at[c].cast("bigint").alias(c) for c in ("idx", "clock", "time")]
        own = [fields.get(f"p{s.k}", F.lit(None)).cast("bigint").alias(f"p{s.k}") for s in ops] + [fields.get(f"x{s.k}", F.lit(None)).cast(types[s.k]).alias(f"x{s.k}") for s in caps]
        return F.struct(*point, F.lit(kind).cast("string").alias("kind"), F.lit(text).cast("string").alias("text"), *own)

    here = F.struct("idx", "clock", "time")
    cells: list[dict[str, Column]] = []  # each level needs the columns of the one before

    def column(value: Column) -> Column:
        name = f"__{sum(map(len, cells))}"
        cells.append({name: value})
        return F.col(name)

    last = column(F.first(here).over(seen))

    def begun(s: Step, o: Column, **more: Column) -> Column:
        """``o`` with this step's own fields set."""
        o = o.withField(f"p{s.k}", F.col("idx").cast("bigint"))
        for name, value in more.items():
            o = o.withField(name, value)
        return o

    def build(some: list[Step], after: Column) -> Column:
        for s in reversed(some):
            if s.kind == "branch":
                yes, no = (build(way, after) for way in s.ways)
                after = column(F.when(_truth(s.cond, frame), yes).otherwise(no))
                continue
            if s.kind == "capture":
                after = column(begun(s, after, **{f"x{s.k}": s.signal.column.cast(types[s.k])}))
                continue
            late = outcome("Timeout", timeout_message, last)
            if s.kind == "require":
                found = F.when(_truth(s.cond, frame), after).otherwise(outcome("RequireViolated", s.message))
            elif s.kind == "delay":
                found = F.coalesce(column(F.lag(after, s.n).over(back)), late)
                if s.require is not None:
                    found = F.when(_truth(s.require, frame), found).otherwise(outcome("RequireViolated", s.message))
            else:
                cond = _truth(s.cond, frame)
                cond = ~cond if s.args.get("negate") else cond
                goal = column(F.last(F.when(cond, F.struct(F.col("idx").alias("at"), after.alias("o"))), True).over(seen))
                found = F.coalesce(goal["o"], late)
                if s.args.get("require") is not None:
                    broken = column(F.last(F.when(~cond & ~_truth(s.require, frame), here), True).over(seen))
                    found = F.when(broken.isNotNull() & (goal.isNull() | (broken["idx"] < goal["at"])), outcome("RequireViolated", s.message, broken)).otherwise(found)
            after = column(begun(s, found))
        return after

    result = build(number(body), outcome(None, None))
    rows = df
    if timeout is not None:
        cells.insert(0, {"__dc": F.lag("clock", timeout).over(back), "__dt": F.lag("time", timeout).over(back)})
    for level in cells:
        rows = rows.withColumns(level)
    rows = rows.withColumn("__o", result)
    if start_cycle is not None:
        rows = rows.where(F.col("clock") >= start_cycle)
    bad = F.lit(False)
    if selects:
        first = _truth(steps[0].cond, frame)
        if steps[0].require is not None:
            bad = ~first & ~_truth(steps[0].require, frame)
        rows = rows.where(first | bad)
    o, p = F.col("__o"), lambda s: F.col("__o")[f"p{s.k}"]
    deadline = F.col("idx") + timeout if timeout is not None else F.lit(FAR)
    timed = F.lit(False)
    for j, s in enumerate(ops):
        ends = F.coalesce(*[p(x) for x in ops[j + 1 :]], o["idx"])  # the next step that began, or the end
        meets = p(s) if s.kind in ("capture", "require") else F.least(p(s) + s.n - 1, ends) if s.kind == "delay" else ends
        timed = timed | F.coalesce(p(s).isNotNull() & (deadline <= meets), F.lit(False))
    values: dict[str, Column] = {}
    for s in caps:
        done, now = F.coalesce(p(s) < deadline, F.lit(False)) & ~bad, o[f"x{s.k}"]
        before = values.get(s.name)
        kept = F.lit(None).cast(types[s.k]) if before is None else before
        values[s.name] = F.when(done, F.coalesce(before, now) if s.mode == "first" and before is not None else now).otherwise(kept)
    end = lambda here, at, there: F.when(bad, F.col(here)).when(timed, at).otherwise(o[there])
    status = F.when(bad, F.lit("RequireViolated")).when(timed, F.lit("Timeout")).otherwise(o["kind"])
    text = F.when(bad, F.lit(steps[0].message if selects else None).cast("string")).when(timed, F.lit(timeout_message).cast("string")).otherwise(o["text"])
    dc, dt = (F.col("__dc"), F.col("__dt")) if timeout is not None else (F.lit(None), F.lit(None))
    live = rows.select(
        "trace", F.col("idx").alias("__s"), F.col("clock").alias("__sc"), F.col("time").alias("__st"),
        end("idx", deadline, "idx").alias("__i"), end("clock", dc, "clock").alias("__ec"), end("time", dt, "time").alias("__et"),
        status.alias("__status"), text.alias("__message"), *[v.alias(f"cap_{n}") for n, v in values.items()],
    )
    return _result(live, names)


def _point(i: str, c: str, t: str) -> Column:
    return F.struct(F.col(i).cast("bigint").alias("index"), F.col(c).cast("bigint").alias("cycle"), F.col(t).cast("bigint").alias("time"))


def _result(live: DataFrame, names: list[str]) -> DataFrame:
    status = F.struct(F.coalesce("__status", F.lit("OK")).alias("kind"), F.col("__message").alias("message"))
    return live.select("trace", _point("__s", "__sc", "__st").alias("start"), _point("__i", "__ec", "__et").alias("end"), (F.col("__i") - F.col("__s") + 1).alias("duration"), status.alias("status"), *[F.col(f"cap_{n}").alias(n) for n in names])


def _fifo(body: Pattern, frame: Frame) -> DataFrame | None:
    """wait, captures, consume on a channel, captures: the k-th start gets event ``k + max(f_j - j, j <= k)``, f_j being the
    events before start j. Native, and split by trace and channel."""
    kinds = [s.kind for s in body.steps]
    if kinds[:1] != ["wait"] or kinds.count("consume") != 1 or set(kinds) - {"wait", "consume", "capture"} or kinds.count("wait") != 1:
        return None
    head, at = body.steps[0], kinds.index("consume")
    take = body.steps[at]
    caps = [s for s in body.steps if s.kind == "capture"]
    if head.require is not None or take.require is not None or any(not isinstance(s.signal, Wave) or s.signal.frame is not frame or s.mode == "list" for s in caps):
        return None
    cond, event = _truth(head.cond, frame), _truth(take.cond, frame)
    if cond is None or event is None or len({s.name for s in caps}) < len(caps):
        return None
    if isinstance(take.channel, KeyChannel):
        start_key, event_key = take.channel.start.column, take.channel.event.column
    elif callable(take.channel) and not isinstance(take.channel, type):
        return None
    else:
        start_key = event_key = F.lit(0)
    before, after = [s for s in body.steps[:at] if s.kind == "capture"], [s for s in body.steps[at:] if s.kind == "capture"]
    payload = lambda caps: F.struct(F.lit(1).alias("one"), *[s.signal.column.alias(s.name) for s in caps])
    point = F.struct("idx", "clock", "time")
    starts = F.when(cond, F.struct(start_key.cast("string").alias("ch"), F.lit(1).alias("is_start")))
    events = F.when(event, F.struct(event_key.cast("string").alias("ch"), F.lit(0).alias("is_start")))
    last = F.max(point).over(W.partitionBy("trace")).alias("last")
    rows = frame.df.select("trace", point.alias("at"), last, payload(before).alias("b"), payload(after).alias("a"), F.array_compact(F.array(starts, events)).alias("roles"))
    both = rows.select("trace", "at", "last", "b", "a", F.inline("roles"))
    # At one sample the start comes first: events strictly before it are counted.
    lane = W.partitionBy("trace", "ch").orderBy("at.idx", F.desc("is_start"))
    counted = both.withColumns({"f": F.sum(1 - F.col("is_start")).over(lane), "k": F.sum("is_start").over(lane) - 1})
    best = F.col("k") + F.max(F.when(F.col("is_start") == 1, F.col("f") - F.col("k"))).over(lane)
    ranked = counted.withColumn("rank", F.when(F.col("is_start") == 1, best).otherwise(F.col("f") - 1))
    # A rank is one start's and one event's in its lane at most, so a group is their match.
    is_start = F.col("is_start") == 1
    pair = ranked.groupBy("trace", "ch", "rank").agg(F.max(F.when(is_start, F.struct("at", "last", "b"))).alias("s"), F.max(F.when(~is_start, F.struct("at", "a"))).alias("e")).where("s IS NOT NULL")
    end = F.coalesce("e.at", "s.last")
    live = pair.select(
        "trace", F.col("s.at.idx").alias("__s"), F.col("s.at.clock").alias("__sc"), F.col("s.at.time").alias("__st"),
        end["idx"].alias("__i"), end["clock"].alias("__ec"), end["time"].alias("__et"),
        F.when(F.col("e").isNull(), F.lit("Timeout")).alias("__status"), F.lit(None).cast("string").alias("__message"),
        *[F.col(f"s.b.{s.name}").alias(f"cap_{s.name}") for s in before], *[F.col(f"e.a.{s.name}").alias(f"cap_{s.name}") for s in after],
    )
    return _result(live, [s.name for s in caps])


def _burst(body: Pattern, frame: Frame) -> DataFrame | None:
    """wait, then a loop of captures and ``delay(1)``: lists of the samples up to the loop's end.

    Starts with one end share its run, an array made once by aggregation; each start takes its part. A run is as long as the
    longest list in it.
    """
    kinds = [s.kind for s in body.steps]
    if kinds != ["wait", "loop"] or body.steps[0].require is not None:
        return None
    head, loop = body.steps
    *caps, step = loop.body.steps or (None,)
    if step is None or step.kind != "delay" or step.n != 1 or isinstance(step.n, bool) or step.require is not None or not caps:
        return None
    if any(s.kind != "capture" or s.mode != "list" or not isinstance(s.signal, Wave) or s.signal.frame is not frame for s in caps) or len({s.name for s in caps}) < len(caps):
        return None
    cond, stop = _truth(head.cond, frame), _truth(loop.until if loop.until is not None else loop.when, frame)
    if cond is None or stop is None:
        return None
    point = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("idx", "clock", "time")])
    back = W.partitionBy("trace").orderBy(F.desc("idx"))
    seen = back.rowsBetween(W.unboundedPreceding, W.currentRow if loop.until is None else -1)
    ends = F.last(F.when(stop if loop.until is not None else ~stop, point), True).over(seen)
    last = F.first(point).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    values = F.struct(F.col("idx").alias("i"), *[s.signal.column.alias(s.name) for s in caps])
    rows = frame.df.select("trace", point.alias("at"), cond.alias("begins"), values.alias("v"), ends.alias("end"), last.alias("last"))
    rows = rows.withColumn("run", F.coalesce(F.col("end.idx"), F.lit(-1)))  # the trace's open run has no end
    # The end's own sample is captured only where the trace stops the loop.
    runs = rows.where(F.col("end").isNull() | (F.col("at.idx") < F.col("run"))).groupBy("trace", "run").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    starts = rows.where("begins").select("trace", "run", "at", "end", "last").join(runs, ["trace", "run"], "left")
    first = F.col("at.idx") - F.get("samples", F.lit(0))["i"]
    mine = F.when(F.col("samples").isNull() | (first < 0) | (first >= F.size("samples")), F.lit(None)).otherwise(F.slice("samples", (first + 1).cast("int"), F.size("samples")))
    end = F.coalesce("end", "last")
    live = starts.withColumn("mine", mine).select(
        "trace", F.col("at.idx").alias("__s"), F.col("at.clock").alias("__sc"), F.col("at.time").alias("__st"),
        end["idx"].alias("__i"), end["clock"].alias("__ec"), end["time"].alias("__et"),
        F.when(F.col("end").isNull(), F.lit("Timeout")).alias("__status"), F.lit(None).cast("string").alias("__message"),
        *[F.col(f"mine.{s.name}").alias(f"cap_{s.name}") for s in caps],
    )
    return _result(live, [s.name for s in caps])


class KeyChannel:
    """A channel per key: a start consumes events whose key equals its own. ``wait`` on the start's side reads ``start``, the
    event's side ``event``."""

    def __init__(self, start: Wave, event: Wave):
        self.start, self.event = start, event


def _schema_of(wave: Wave) -> str:
    return "double" if wave.width is None or wave.int is None else "bigint" if wave.int.narrow else "decimal(38,0)"


def _run(body: Any, frame: Frame, timeout: int | None, timeout_message: str | None, start_cycle: int | None, end_cycle: int | None, as_json: bool = False, waves: dict[str, Wave] | None = None, captures: dict[str, str] | None = None) -> DataFrame:
    import inspect

    if inspect.iscoroutinefunction(body):
        raise PatternError("a body is a plain function")
    found: dict[str, Wave] = dict(waves or {})
    waves_in(body, found)
    if strange := [w.name for w in found.values() if w.frame is not frame]:
        raise PatternError(f"waves of another frame ({', '.join(strange)}): join the frames with align() first")
    kinds: dict[str, str] = dict(captures or {})
    if isinstance(body, Pattern) and not captures:
        kinds = _capture_types(body)
    data = frame.df.select("trace", "idx", "clock", "time", *[w.column.alias(n) for n, w in found.items()])
    key = data.schema["trace"].dataType.simpleString()
    columns = ", ".join(f"`cap_{n}` {t}" for n, t in kinds.items())
    schema = f"trace {key}, __s bigint, __sc bigint, __st bigint, __i bigint, __ec bigint, __et bigint, __status string, __message string, __value string" + (", " + columns if columns else "")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        clock, time = pdf["clock"].to_numpy(), pdf["time"].to_numpy()
        scan = Scan({n: pdf[n].to_numpy() for n in found_names}, clock, time, body, timeout, timeout_message, start_cycle, end_cycle)
        rows = []
        for a, kind, message, value in scan.results():
            if not as_json and kind == "OK" and value is not OK:
                raise PatternError("a body must return ctx.OK or None")
            rows.append((pdf["trace"].iloc[0], a.start, clock[a.start], time[a.start], a.index, clock[a.index], time[a.index], kind, message, json.dumps(value) if as_json and kind == "OK" else None, *[a.captures.get(n) for n in names]))
        return pd.DataFrame(rows, columns=[*head, *[f"cap_{n}" for n in names]])

    found_names, names = list(found), list(kinds)
    head = ["trace", "__s", "__sc", "__st", "__i", "__ec", "__et", "__status", "__message", "__value"]
    raw = data.groupBy("trace").applyInPandas(run, schema)
    return raw if as_json else _result(raw.withColumn("__status", F.when(F.col("__status") != "OK", F.col("__status"))), names)


def _capture_types(pattern: Pattern) -> dict[str, str]:
    out: dict[str, str] = {}
    for s in pattern.steps:
        if s.kind == "capture":
            kind = _schema_of(s.signal) if isinstance(s.signal, Wave) else "bigint"
            out[s.name] = f"array<{kind}>" if s.mode == "list" else kind
        for part in ("body", "true_body", "false_body"):
            if isinstance(s.args.get(part), Pattern):
                out.update(_capture_types(s.args[part]))
    return out


def collect(body: Any, *, frame: Frame, timeout: int | None = None, start_cycle: int | None = None, end_cycle: int | None = None) -> DataFrame:
    """trace, start and ``value`` (JSON) of every start whose body returned something. Any failed match fails the job."""
    if isinstance(body, Pattern):
        raise PatternError("collect takes a function")
    raw = _run(body, frame, timeout, None, start_cycle, end_cycle, as_json=True)
    checked = F.when(F.col("__status") == "OK", F.col("__value")).otherwise(F.raise_error(F.concat(F.lit("a match failed: "), F.col("__status"))))
    return raw.select("trace", _point("__s", "__sc", "__st").alias("start"), checked.alias("value"))


def filter_status(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("status.kind") == kind)


def filter_ok(records: DataFrame) -> DataFrame:
    return filter_status(records, "OK")


def filter_failed(records: DataFrame) -> DataFrame:
    return records.where(F.col("status.kind") != "OK")
