"""The engine's operators over the ``events`` table, and the same in SQL.

A user is a trace, events are its samples in time order: v (the value in hundredths), k (props.k, 7 bits), and one-bit
signals per event type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, Wave
from ..operators import sampling, select, windows
from ..patterns import MatchRecords, Pattern, collect, match
from ..patterns.plan import KeyChannel
from ..session import configure
from . import dump_queries

KINDS = ("view", "purchase", "click", "error", "signup")


def events_frame(spark: SparkSession, sf_dir: str) -> Frame:
    configure(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    signals = {
        "v": (F.round(F.col("value") * 100).cast("bigint"), 40, False),
        "k": (F.get_json_object("props", "$.k").cast("bigint"), 7, False),
        "id": (F.col("event_id"), 40, False),
        **{n: ((F.col("event_type") == n).cast("bigint"), 1, False) for n in KINDS},
    }
    return Frame.from_table(e, "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), signals)


BASE = """w AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS clock,
epoch_us(ts) AS time, CAST(round(value * 100) AS BIGINT) AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS id, event_type AS et FROM events)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[Frame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(events_frame(spark, sf_dir))
    if sql:
        ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {BASE} {sql}"


def _long(w: Wave, name: str = "value") -> DataFrame:
    """trace, idx and a value as BIGINT (as text past 63 bits)."""
    c = w.column if w.int is None else w.column if w.int.narrow else w.column.cast("string")
    return w.frame.df.select("trace", "idx", c.alias(name))


def _wave(name: str, build: Callable[[Frame], Wave], sql: str) -> None:
    _add(name, lambda f: _long(build(f)), f"SELECT trace, idx, {sql} AS value FROM w")


def _many(name: str, build: Callable[[Frame], dict[str, Wave]], sql: dict[str, str]) -> None:
    _add(name, lambda f: f.df.select("trace", "idx", *[w.column.alias(n) for n, w in build(f).items()]), f"SELECT trace, idx, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM w")


# --- projections ------------------------------------------------------------------------------------------------------
_wave("wave_add", lambda f: f["v"] + f["k"], "v + k")
_wave("wave_add_const", lambda f: 5 + f["k"], "k + 5")
_wave("wave_sub", lambda f: f["k"] - 50, "CAST(CASE WHEN k >= 50 THEN CAST(k - 50 AS HUGEINT) ELSE CAST(k - 50 AS HUGEINT) + 18446744073709551616 END AS VARCHAR)")
_wave("wave_rsub", lambda f: 1000 - f["k"], "1000 - k")
_wave("wave_mul", lambda f: f["v"] * f["k"], "v * k")
_wave("wave_truediv", lambda f: f["v"] / f["k"], "CASE WHEN k = 0 THEN CASE WHEN v > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE CAST(v AS DOUBLE) / k END")
_wave("wave_rtruediv", lambda f: 1000 / (f["k"] + 1), "1000.0::DOUBLE / (k + 1)")
_wave("wave_floordiv", lambda f: f["v"] // f["k"], "CASE WHEN k = 0 THEN 0 ELSE v // k END")
_wave("wave_mod", lambda f: f["v"] % f["k"], "CASE WHEN k = 0 THEN 0 ELSE v % k END")
_many("wave_reflected_div", lambda f: {"q": 100000 // f["k"], "r": 100000 % f["k"]}, {"q": "CASE WHEN k = 0 THEN 0 ELSE 100000 // k END", "r": "CASE WHEN k = 0 THEN 0 ELSE 100000 % k END"})
_many("wave_signed_div", lambda f: {"q": f["k"].as_signed() // -7, "r": f["k"].as_signed() % -7}, {n: s.format(x="(CASE WHEN k >= 64 THEN k - 128 ELSE k END)") for n, s in {"q": "CAST(floor({x} / -7.0) AS BIGINT)", "r": "{x} + 7 * CAST(floor({x} / -7.0) AS BIGINT)"}.items()})
_wave("wave_pow", lambda f: f["k"] ** 3, "k * k * k")
_wave("wave_and", lambda f: f["v"] & 127, "v & 127")
_wave("wave_or", lambda f: f["v"] | 5, "v | 5")
_wave("wave_xor", lambda f: f["k"] ^ 85, "xor(k, 85)")
_wave("wave_invert", lambda f: ~f["k"], "127 - k")
_wave("wave_shl", lambda f: f["v"] << 3, "v << 3")
_wave("wave_shl_wave", lambda f: f["k"] << f["k"][1:0], "k << (k & 3)")
_wave("wave_shr", lambda f: f["v"] >> 2, "v >> 2")
_wave("wave_shr_wave", lambda f: f["k"] >> f["k"], "CASE WHEN k > 62 THEN 0 ELSE k >> k END")
_many("wave_eq_ne", lambda f: {"eq": f["k"] == 7, "ne": f["k"] != 7}, {"eq": "CAST(k = 7 AS BIGINT)", "ne": "CAST(k <> 7 AS BIGINT)"})
_many("wave_order", lambda f: {"lt": f["k"] < 7, "le": f["k"] <= 7, "gt": f["k"] > 7, "ge": f["k"] >= 7}, {n: f"CAST(k {o} 7 AS BIGINT)" for n, o in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))})
_many("wave_bitsel", lambda f: {"bit": f["v"][3], "bits": f["v"][9:4]}, {"bit": "(v >> 3) & 1", "bits": "(v >> 4) & 63"})
_many("as_signed_unsigned", lambda f: {"s": f["k"].as_signed(), "u": f["k"].as_signed().as_unsigned()}, {"s": "CASE WHEN k >= 64 THEN k - 128 ELSE k END", "u": "k"})
_wave("bit_count", lambda f: f["v"].bit_count(), "CAST(bit_count(v) AS BIGINT)")
_many("split_bits", lambda f: dict(zip("abc", f["k"].split_bits([2, 2, 3]), strict=True)), {"a": "k & 3", "b": "(k >> 2) & 3", "c": "k >> 4"})
_wave("concatenate", lambda f: Wave.concatenate([f["k"], f["view"], f["v"]]), "k + (CASE WHEN et = 'view' THEN 128 ELSE 0 END) + v * 256")
_wave("map_udf", lambda f: f["k"].map(lambda x: x * 2 + 1, width=8), "k * 2 + 1")
_wave("vectorized_map", lambda f: f["k"].vectorized_map(lambda a: a * a, width=14), "k * k")
_wave("merge_udf", lambda f: Wave.merge([f["v"], f["k"]], lambda a, b: max(a, b), width=40), "greatest(v, k)")
_wave("eval_single", lambda f: _eval("(v + k)[7:0] - 3", f), "CAST(CASE WHEN ((v + k) & 255) >= 3 THEN CAST(((v + k) & 255) - 3 AS HUGEINT) ELSE CAST(((v + k) & 255) - 3 AS HUGEINT) + 18446744073709551616 END AS VARCHAR)")


def _eval(text: str, f: Frame) -> Wave:
    from .expression import evaluate

    return evaluate(text, {n: f[n] for n in f.columns})


# --- selections -------------------------------------------------------------------------------------------------------
_cut = "trace, row_number() OVER (PARTITION BY trace ORDER BY idx) - 1 AS idx, clock, time, {v} AS value"


def _select(name: str, build: Callable[[Frame], Frame], where: str, value: str = "v", source: str = "w") -> None:
    def run(f: Frame) -> DataFrame:
        out = build(f)
        return out.df.select("trace", "idx", "clock", "time", F.col("value" if "value" in out.columns else value).alias("value"))

    _add(name, run, f"SELECT {_cut.format(v=value)} FROM {source} WHERE {where}")


_select("mask", lambda f: select.mask(f["v"], f["view"]), "et = 'view'")
_select("filter_values", lambda f: select.filter_values(f["v"], lambda c: c % 3 == 0), "v % 3 = 0")
_select("time_slice", lambda f: select.time_slice(f, 1704200000000000, 1705000000000000), "time >= 1704200000000000 AND time < 1705000000000000")
_select("cycle_slice", lambda f: select.cycle_slice(f, 3, 20, True), "clock >= 3 AND clock <= 20")
_select("index_slice", lambda f: select.index_slice(f, 5, -5), "idx >= 5 AND idx < n - 5", source="(SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM w)")
_add("take", lambda f: select.take(f, [4, 0, 4, -1]).df.select("trace", "idx", "clock", "v"), "SELECT trace, CAST(p AS BIGINT) AS idx, clock, v FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM w) w JOIN (VALUES (0, 4), (1, 0), (2, 4), (3, -1)) t(p, i) ON w.idx = CASE WHEN i < 0 THEN i + n ELSE i END")
_select("unique_consecutive", lambda f: select.unique_consecutive(f["view"]), "b IS NULL OR b <> x", "x", "(SELECT *, CAST(et = 'view' AS BIGINT) AS x, lag(CAST(et = 'view' AS BIGINT)) OVER (PARTITION BY trace ORDER BY idx) AS b FROM w)")
_select("compress", lambda f: select.compress(f["view"]), "b IS NULL OR b <> x OR a IS NULL", "x", "(SELECT *, CAST(et = 'view' AS BIGINT) AS x, lag(CAST(et = 'view' AS BIGINT)) OVER (PARTITION BY trace ORDER BY idx) AS b, lead(idx) OVER (PARTITION BY trace ORDER BY idx) AS a FROM w)")

# --- windows ----------------------------------------------------------------------------------------------------------
_o = "OVER (PARTITION BY trace ORDER BY idx)"
_all = "OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_wave("rising_edge", lambda f: windows.rising_edge(f["view"]), f"CAST(coalesce(et = 'view' AND lag(et) {_o} <> 'view', false) AS BIGINT)")
_wave("falling_edge", lambda f: windows.falling_edge(f["view"]), f"CAST(coalesce(et <> 'view' AND lag(et) {_o} = 'view', false) AS BIGINT)")
_wave("relative_ahead", lambda f: windows.ahead(f["v"], 3), f"coalesce(lead(v, 3) {_o}, last_value(v) {_all})")
_wave("relative_back", lambda f: windows.back(f["v"], 2), f"coalesce(lag(v, 2) {_o}, first_value(v) {_all})")
_wave("relative_padvalue", lambda f: windows.relative(f["v"], -4, "value", 9), f"coalesce(lag(v, 4) {_o}, 9)")
_add("downsample_mean", lambda f: windows.downsample(f["k"], 5), "SELECT trace, idx // 5 AS idx, avg(k) AS value, avg(clock) AS clock, avg(time) AS time FROM w GROUP BY trace, idx // 5")
_add("downsample_max", lambda f: windows.downsample(f["v"], 7, F.max).drop("time"), "SELECT trace, idx // 7 AS idx, max(v) AS value, avg(clock) AS clock FROM w GROUP BY trace, idx // 7")
_runs = f"e AS (SELECT trace, idx, et = 'view' AND lag(et) {_o} <> 'view' AS r, et <> 'view' AND lag(et) {_o} = 'view' AS f FROM w), a AS (SELECT trace, idx AS rise, row_number() OVER (PARTITION BY trace ORDER BY idx) AS k FROM e WHERE r), b AS (SELECT trace, idx AS fall, row_number() OVER (PARTITION BY trace ORDER BY idx) AS k FROM e WHERE f)"
_add("fifo_latency", lambda f: windows.run_lengths(f["view"]).withColumn("k", F.col("k").cast("bigint")), f"WITH {BASE}, {_runs} SELECT trace, k, rise, fall, fall - rise + 1 AS length FROM a JOIN b USING (trace, k)")
_add("fifo_occupancy", lambda f: _long((f["k"] + 128 - f["k"][5:0]) % 128).groupBy("trace").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"), F.count("*").alias("n")), "SELECT trace, avg((k + 128 - (k & 63)) % 128) AS mean, max((k + 128 - (k & 63)) % 128) AS most, min((k + 128 - (k & 63)) % 128) AS least, count(*) AS n FROM w GROUP BY trace")
_add("scoreboard", lambda f: windows.scoreboard(f, F.col("view") == 1, F.col("k"), F.col("purchase") == 1, F.col("k")).withColumn("k", F.col("k").cast("bigint")), f"WITH {BASE}, z AS (SELECT *, lead(k) {_o} AS y FROM w), a AS (SELECT trace, k AS x, row_number() {_o} AS n FROM z WHERE et = 'view'), b AS (SELECT trace, y, row_number() {_o} AS n FROM z WHERE et = 'purchase') SELECT trace, n AS k, x, y, x = y AS same FROM a JOIN b USING (trace, n)")

# --- sampling ---------------------------------------------------------------------------------------------------------


def _changes(f: Frame, kind: str) -> DataFrame:
    return f.df.where(F.col(kind) == 1).select("trace", "time", F.col("id").alias("seq"), F.col("v").alias("value"))


def _edges(f: Frame) -> DataFrame:
    return sampling.clock_edges(f.df.select("trace", "time", F.col("id").alias("seq"), F.col("error").alias("value")), posedge=True)


_sampled = "e AS (SELECT trace, time, row_number() OVER (PARTITION BY trace ORDER BY time, id) - 1 AS clock FROM w WHERE et = 'error'), c AS (SELECT trace, time, v FROM w WHERE et = 'purchase'), g AS (SELECT trace, arg_min(v, time) AS v0 FROM c GROUP BY trace)"
_asof = "SELECT e.trace, e.clock, e.time, coalesce(c.v, g.v0) AS value FROM e ASOF LEFT JOIN c ON e.trace = c.trace AND e.time >= c.time JOIN g ON e.trace = g.trace"
_add("sample_on_clock", lambda f: sampling.sample(_edges(f), _changes(f, "purchase")).drop("idx"), f"WITH {BASE}, {_sampled} {_asof}")
_add("sample_window_cycle", lambda f: sampling.sample(sampling.window_edges(_edges(f), begin_cycle=2, end_cycle=9), _changes(f, "purchase")).drop("idx"), f"WITH {BASE}, {_sampled} {_asof} WHERE e.clock >= 2 AND e.clock < 9")
_add("sample_window_time", lambda f: sampling.sample(sampling.window_edges(_edges(f), begin_time=1704200000000000, end_time=1705500000000000), _changes(f, "purchase")).drop("idx"), f"WITH {BASE}, {_sampled} {_asof} WHERE e.time >= 1704200000000000 AND e.time < 1705500000000000")


def _four():
    return F.concat(F.substring("bits", 1, 2), F.when(F.col("k") % 3 == 0, "x").when(F.col("k") % 3 == 1, "Z").otherwise("1"))


_add(
    "unknown_mask",
    lambda f: f.df.withColumn("bits", F.lpad(F.conv(F.col("k"), 10, 2), 7, "0")).select("trace", "idx", sampling.bits_value(sampling.unknown_bits(_four()), 3).alias("both"), sampling.bits_value(sampling.unknown_bits(_four(), include_z=False), 3).alias("x"), sampling.bits_value(sampling.known_bits(_four(), 1), 3).alias("known")),
    "SELECT trace, idx, CAST(k % 3 <> 2 AS BIGINT) AS both, CAST(k % 3 = 0 AS BIGINT) AS x, (k >> 5) * 2 + 1 AS known FROM w",
)

# --- patterns ---------------------------------------------------------------------------------------------------------


def _flat(m: DataFrame, *captures: str) -> DataFrame:
    return m.select("trace", F.col("start.index").alias("s"), F.col("end.index").alias("e"), F.col("end.time").alias("et"), "duration", F.col("status.kind").alias("status"), *captures)


def _pattern(name: str, build: Callable[[Frame], DataFrame], sql: str, *captures: str) -> None:
    _add(name, lambda f: _flat(build(f), *captures), f"WITH {BASE}, {sql}")


_fol = "OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_n = f"n AS (SELECT *, min(CASE WHEN et = 'purchase' THEN idx END) {_fol} AS c, min(CASE WHEN et <> 'purchase' AND et = 'error' THEN idx END) {_fol} AS g, max(idx) OVER (PARTITION BY trace) AS z FROM w)"
_end = "SELECT m.trace, s, m.en AS e, w.time AS et, m.en - s + 1 AS duration, st AS status{c} FROM m JOIN w ON w.trace = m.trace AND w.idx = m.en"
_capv = ", CASE WHEN st = 'OK' THEN w.v END AS val"
_pattern("match_two_wait", lambda f: match(Pattern().wait(f["view"]).wait(f["purchase"]).capture("val", f["v"]), frame=f), f"{_n}, m AS (SELECT trace, idx AS s, coalesce(c, z) AS en, CASE WHEN c IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM n WHERE et = 'view') " + _end.format(c=_capv), "val")
_best = "m AS (SELECT trace, idx AS s, b // 4 AS en, CASE b % 4 WHEN 1 THEN 'OK' WHEN 2 THEN 'RequireViolated' ELSE 'Timeout' END AS st FROM (SELECT *, least({t}4 * coalesce(c, 1000000000) + 1, 4 * coalesce(g, 1000000000) + 2, 4 * z + 3) AS b FROM n WHERE et = 'view'))"
_pattern("match_wait_require", lambda f: match(Pattern().wait(f["view"]).wait(f["purchase"], require=f["error"] == 0).capture("val", f["v"]), frame=f), f"{_n}, {_best.format(t='')} " + _end.format(c=_capv), "val")
_pattern("match_timeout", lambda f: match(Pattern().wait(f["view"]).wait(f["purchase"], require=f["error"] == 0).capture("val", f["v"]), frame=f, timeout=4), f"{_n}, {_best.format(t='4 * (idx + 4), ')} " + _end.format(c=_capv), "val")
_pattern("match_delay", lambda f: match(Pattern().wait(f["view"]).delay(3).capture("val", f["v"]), frame=f), f"{_n}, m AS (SELECT trace, idx AS s, least(idx + 3, z) AS en, CASE WHEN idx + 3 <= z THEN 'OK' ELSE 'Timeout' END AS st FROM n WHERE et = 'view') " + _end.format(c=_capv), "val")
_pattern("match_delay_require", lambda f: match(Pattern().wait(f["view"]).delay(1).require(f["error"] == 0).capture("val", f["v"]), frame=f), f"x AS (SELECT *, lead(et) {_o} AS e2 FROM w), m AS (SELECT trace, idx AS s, CASE WHEN e2 IS NULL THEN idx ELSE idx + 1 END AS en, CASE WHEN e2 IS NULL THEN 'Timeout' WHEN e2 = 'error' THEN 'RequireViolated' ELSE 'OK' END AS st FROM x WHERE et = 'view') " + _end.format(c=_capv), "val")
_pattern("match_every_cycle", lambda f: match(Pattern().delay(2).capture("val", f["v"]), frame=f), f"{_n}, m AS (SELECT trace, idx AS s, least(idx + 2, z) AS en, CASE WHEN idx + 2 <= z THEN 'OK' ELSE 'Timeout' END AS st FROM n) " + _end.format(c=_capv), "val")
_stall = f"n AS (SELECT *, min(CASE WHEN et NOT IN ('view', 'click') THEN idx END) {_fol} AS c, max(idx) OVER (PARTITION BY trace) AS z FROM w)"
_pattern("match_stall_loop_when", lambda f: match(Pattern().wait(f["view"]).loop(Pattern().delay(1), when=(f["view"] | f["click"])), frame=f), f"{_stall}, m AS (SELECT trace, idx AS s, coalesce(c, z) AS en, CASE WHEN c IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM n WHERE et = 'view') " + _end.format(c=""))
_until = f"n AS (SELECT *, min(CASE WHEN et = 'view' THEN idx END) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c, max(idx) OVER (PARTITION BY trace) AS z FROM w), m AS (SELECT trace, idx AS s, coalesce(c, z) AS en, CASE WHEN c IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM n WHERE et = 'view')"
_pattern("match_loop_until", lambda f: match(Pattern().wait(f["view"]).loop(Pattern().delay(1), until=f["view"]).capture("val", f["v"]), frame=f), f"{_until} " + _end.format(c=_capv), "val")
_pattern("match_repeat", lambda f: match(Pattern().wait(f["view"]).repeat(Pattern().delay(1).wait(f["view"]), 2), frame=f), f"r AS (SELECT *, lead(idx, 2) OVER (PARTITION BY trace ORDER BY idx) AS c FROM w WHERE et = 'view'), q AS (SELECT trace AS t, max(idx) AS z FROM w GROUP BY trace), m AS (SELECT trace, idx AS s, coalesce(c, z) AS en, CASE WHEN c IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM r JOIN q ON t = trace) " + _end.format(c=""))
_pattern("match_branch", lambda f: match(Pattern().wait(f["view"]).branch(f["k"] < 50, Pattern().delay(1), Pattern().delay(2)).capture("val", f["v"]), frame=f), f"{_n}, m AS (SELECT trace, idx AS s, least(idx + d, z) AS en, CASE WHEN idx + d <= z THEN 'OK' ELSE 'Timeout' END AS st FROM (SELECT *, CASE WHEN k < 50 THEN 1 ELSE 2 END AS d FROM n WHERE et = 'view')) " + _end.format(c=_capv), "val")
_pattern("match_first_require", lambda f: match(Pattern().wait(f["view"], require=f["error"] == 0).delay(1), frame=f), f"{_n}, m AS (SELECT trace, idx AS s, CASE WHEN et = 'error' THEN idx ELSE least(idx + 1, z) END AS en, CASE WHEN et = 'error' THEN 'RequireViolated' WHEN idx + 1 <= z THEN 'OK' ELSE 'Timeout' END AS st FROM n WHERE et IN ('view', 'error')) " + _end.format(c=""))
_pattern("match_window", lambda f: match(Pattern().wait(f["view"]).wait(f["purchase"]), frame=f, start_cycle=5, end_cycle=30), f"y AS (SELECT * FROM w WHERE clock < 30), n AS (SELECT *, min(CASE WHEN et = 'purchase' THEN idx END) {_fol} AS c, max(idx) OVER (PARTITION BY trace) AS z FROM y), m AS (SELECT trace, idx AS s, coalesce(c, z) AS en, CASE WHEN c IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM n WHERE et = 'view' AND clock >= 5) " + _end.format(c=""))
_fifo = f"""r AS (SELECT *, {{ch}} AS ch FROM w), f0 AS (SELECT *, sum(CASE WHEN et = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY trace, ch ORDER BY idx) AS f FROM r),
st AS (SELECT *, row_number() OVER (PARTITION BY trace, ch ORDER BY idx) - 1 AS kk FROM f0 WHERE et = 'view'), ev AS (SELECT *, row_number() OVER (PARTITION BY trace, ch ORDER BY idx) - 1 AS er FROM f0 WHERE et = 'purchase'),
a AS (SELECT trace, ch, idx, CAST(kk + max(f - kk) OVER (PARTITION BY trace, ch ORDER BY idx) AS BIGINT) AS rk FROM st), q AS (SELECT trace AS t, max(idx) AS z FROM w GROUP BY trace),
m AS (SELECT a.trace, a.idx AS s, coalesce(ev.idx, z) AS en, CASE WHEN ev.idx IS NULL THEN 'Timeout' ELSE 'OK' END AS st FROM a LEFT JOIN ev ON a.trace = ev.trace AND a.ch = ev.ch AND a.rk = ev.er JOIN q ON q.t = a.trace) """ + _end.format(c=_capv)
_pattern("match_consume_fifo", lambda f: match(Pattern().wait(f["view"]).consume(f["purchase"], "rsp").capture("val", f["v"]), frame=f), _fifo.format(ch="0"), "val")
_pattern("match_consume_by_id", lambda f: match(Pattern().wait(f["view"]).consume(f["purchase"], KeyChannel(f["k"][1:0], f["k"][1:0])).capture("val", f["v"]), frame=f), _fifo.format(ch="k & 3"), "val")
_pattern("match_consume_runner", lambda f: match(Pattern().wait(f["view"]).consume(f["purchase"], "rsp").capture("val", f["v"]), frame=f, native=False), _fifo.format(ch="0"), "val")
_add(
    "match_burst_list",
    lambda f: _flat(match(Pattern().wait(f["view"]).loop(Pattern().capture("beats", f["k"], mode="list").delay(1), until=f["view"]), frame=f), "beats").withColumn("beats", F.array_join(F.col("beats").cast("array<string>"), ",")),
    f"WITH {BASE}, {_until} SELECT m.trace, s, m.en AS e, w.time AS et, m.en - s + 1 AS duration, st AS status, (SELECT string_agg(CAST(x.k AS VARCHAR), ',' ORDER BY x.idx) FROM w x WHERE x.trace = m.trace AND x.idx >= m.s AND (x.idx < m.en OR (m.st = 'Timeout' AND x.idx <= m.en))) AS beats FROM m JOIN w ON w.trace = m.trace AND w.idx = m.en",
)


def _dma(f: Frame) -> DataFrame:
    view, click, k = f["view"], f["click"], f["k"]

    def body(ctx):
        if not ctx.value(view):
            return None
        op, beats = ctx.value(k) % 2, []
        for _ in range(2):
            if ctx.index + 1 >= ctx.scan.stop:
                return None
            ctx.delay(1)
            beats.append(ctx.value(k))
        return {"op": op, "beats": beats, "clicked": bool(ctx.value(click))}

    return collect(body, frame=f).select("trace", F.col("start.index").alias("s"), "value")


_add("collect_dma", _dma, f"""SELECT trace, idx AS s, '{{"op": ' || (k % 2) || ', "beats": [' || b1 || ', ' || b2 || '], "clicked": ' || CASE WHEN e2 = 'click' THEN 'true' ELSE 'false' END || '}}' AS value
FROM (SELECT *, lead(k, 1) {_o} AS b1, lead(k, 2) {_o} AS b2, lead(et, 2) {_o} AS e2 FROM w) WHERE et = 'view' AND b2 IS NOT NULL""")
_add(
    "status_summary",
    lambda f: match(Pattern().wait(f["view"]).wait(f["purchase"], require=f["error"] == 0), frame=f, timeout=4).groupBy(F.col("status.kind").alias("status")).agg(F.count("*").alias("n"), F.sum("duration").alias("cycles")),
    f"WITH {BASE}, {_n}, {_best.format(t='4 * (idx + 4), ')} SELECT st AS status, count(*) AS n, CAST(sum(en - s + 1) AS BIGINT) AS cycles FROM m GROUP BY st",
)
_add("records_slice", lambda f: _flat(MatchRecords(match(Pattern().wait(f["view"]).wait(f["purchase"], require=f["error"] == 0), frame=f, timeout=4)).filter_failed()[5:905].df), f"WITH {BASE}, {_n}, {_best.format(t='4 * (idx + 4), ')} " + _end.format(c="") + " WHERE st <> 'OK' ORDER BY m.trace, s LIMIT 900 OFFSET 5")
_add(
    "records_flags",
    lambda f: MatchRecords(match(Pattern().wait(f["view"]).wait(f["purchase"], require=f["error"] == 0), frame=f, timeout=4)).with_flags().select("trace", F.col("start.index").alias("s"), "duration", "ok", "failed"),
    f"WITH {BASE}, {_n}, {_best.format(t='4 * (idx + 4), ')} SELECT trace, s, en - s + 1 AS duration, CAST(st = 'OK' AS BIGINT) AS ok, CAST(st <> 'OK' AS BIGINT) AS failed FROM m",
)

# --- arrays and wide values -------------------------------------------------------------------------------------------
_select("vectorized_filter", lambda f: select.vectorized_filter(f["v"], lambda a: a % 7 == 2), "v % 7 = 2")
_add("downsample_by", lambda f: windows.downsample_by(f["k"], 5, lambda a: a[-1] - a[0]).drop("time"), "SELECT trace, idx // 5 AS idx, CAST(arg_max(k, idx) - arg_min(k, idx) AS DOUBLE) AS value, avg(clock) AS clock FROM w GROUP BY trace, idx // 5")
_wide = "(CAST(k AS HUGEINT) + CAST(v AS HUGEINT) * 128 + CAST(v AS HUGEINT) * 140737488355328)"
_wave("wave_wide_xor", lambda f: Wave.concatenate([f["k"], f["v"], f["v"]]) ^ Wave.concatenate([f["v"], f["k"], f["v"]]), f"CAST(xor({_wide}, CAST(v AS HUGEINT) + CAST(k AS HUGEINT) * 1099511627776 + CAST(v AS HUGEINT) * 140737488355328) AS VARCHAR)")
_wave("wave_wide_and", lambda f: Wave.concatenate([f["k"], f["v"], f["v"]]) & ((1 << 80) - 12345), f"CAST({_wide} & (CAST(1208925819614629174706176 AS HUGEINT) - 12345) AS VARCHAR)")
_wave("wave_pow_wave", lambda f: f["k"] ** f["k"][1:0], "CASE k & 3 WHEN 0 THEN 1 WHEN 1 THEN k WHEN 2 THEN k * k ELSE k * k * k END")
_add("head_tail", lambda f: f["v"].head_tail(5), "SELECT trace, idx, clock, time, v AS value FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM w) WHERE idx < 5 OR idx >= n - 5")

QUERIES |= dump_queries.QUERIES
ORACLES |= dump_queries.ORACLES
