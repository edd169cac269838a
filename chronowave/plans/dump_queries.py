"""Queries that read value-change dumps: ``events`` is written as one dump and read back, and the same in SQL.

Every distinct ``ts`` is a clock cycle: signals change at ``2 * epoch_us`` and ``clk`` rises there, and falls one unit later. Of
events at one ``ts`` the last by ``event_id`` counts, as the last change of a sample does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Wave
from ..session import configure, scratch
from ..sources.vcd import VcdReader, write_vcd

#: Full path -> (code, width). ``amount`` changes on purchases only, ``mix`` holds x and z, ``unit_b`` has a clock of its own.
SIGNALS = {
    "top.clk": ("!", 1),
    "top.core.view": ("a", 1),
    "top.core.v[39:0]": ("b", 40),
    "top.core.k[6:0]": ("c", 7),
    "top.core.amount[39:0]": ("d", 40),
    "top.core.mix[3:0]": ("e", 4),
    "top.unit_a.data[6:0]": ("f", 7),
    "top.unit_a.clk": ("!", 1),
    "top.unit_b.data[6:0]": ("g", 7),
    "top.unit_b.clk": ("$", 1),
    "top.bank0.q[7:4]": ("h", 4),
    "top.bank1.q[7:4]": ("i", 4),
}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, seq, code, bits of every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v, k, view = F.round(F.col("value") * 100).cast("bigint"), F.get_json_object("props", "$.k").cast("bigint"), (F.col("event_type") == "view").cast("bigint")
    at = 2 * F.unix_micros(F.col("ts").cast("timestamp"))
    number = lambda x, n: F.lpad(F.conv(x, 10, 2), n, "0")
    mix = F.concat(F.when(k % 5 == 0, "x").when(k % 5 == 1, "z").otherwise("0"), F.when(k % 3 == 0, "Z").otherwise("1"), number(k % 4, 2))
    values: dict[str, Column] = {"a": view.cast("string"), "b": number(v, 40), "c": number(k, 7), "e": mix, "f": number(k, 7), "g": number(127 - k, 7), "h": number(k % 16, 4), "i": number(k.bitwiseXOR(F.lit(5)) % 16, 4)}
    cells = [F.struct(F.lit(c).alias("code"), x.alias("bits")) for c, x in values.items()]
    purchase = F.when(F.col("event_type") == "purchase", F.struct(F.lit("d").alias("code"), number(v, 40).alias("bits")))
    sets = e.select(at.alias("time"), F.col("event_id").alias("seq"), F.explode(F.array_compact(F.array(*cells, purchase))).alias("c")).select("time", "seq", "c.code", "c.bits")
    ticks = e.select("ts").distinct().select(at.alias("time"))
    clock = lambda code, half: ticks.select((F.col("time") + (1 - half)).alias("time"), F.lit(1 << 62).alias("seq"), F.lit(code).alias("code"), F.lit(str(half)).alias("bits"))
    slow = clock("$", 1).where("time % 4 = 0").unionByName(clock("$", 0).where("(time - 1) % 4 = 0"))
    return sets.unionByName(clock("!", 1)).unionByName(clock("!", 0)).unionByName(slow)


_DUMPS: dict[tuple[str, str], str] = {}


def reader(spark: SparkSession, sf_dir: str) -> VcdReader:
    """A reader over the dump of a table, which is written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DUMPS:
        configure(spark)
        path = scratch(spark, "events.vcd")
        write_vcd(changes(spark, sf_dir), SIGNALS, path)
        _DUMPS[key] = path
    return VcdReader(spark, _DUMPS[key], chunk_bytes=1 << 18)


BASE = """e AS (SELECT 2 * epoch_us(ts) AS t, event_id AS id, event_type AS et, CAST(round(value * 100) AS BIGINT) AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT t, arg_max(v, id) AS v, arg_max(k, id) AS k, arg_max(et, id) AS et, row_number() OVER (ORDER BY t) - 1 AS clock FROM e GROUP BY t),
n AS (SELECT *, t + 1 AS time FROM c)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[VcdReader], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(reader(spark, sf_dir))
    ORACLES[name] = f"WITH {BASE} {sql}"


def _rows(w: Wave) -> DataFrame:
    return w.to_df().drop("trace")


def _keyed(waves: dict[tuple, Wave]) -> DataFrame:
    out = None
    for key, w in waves.items():
        one = w.to_df().select(F.lit(str(key)).alias("key"), "clock", "time", "value")
        out = one if out is None else out.unionByName(one)
    return out


def _wave(name: str, build: Callable[[VcdReader], Wave], value: str, time: str = "time", where: str = "true") -> None:
    _add(name, lambda r: _rows(build(r)), f"SELECT row_number() OVER (ORDER BY clock) - 1 AS idx, clock, {time} AS time, {value} AS value FROM n WHERE {where}")


_wave("vcd_waveform", lambda r: r.load_waveform("top.core.v[39:0]", "top.clk"), "v")
_wave("vcd_posedge", lambda r: r.load_waveform("top.core.k", "top.clk", sample_on_posedge=True), "k", "t")
_wave("vcd_signed", lambda r: r.load_waveform("top.core.k", "top.clk").as_signed(), "CASE WHEN k >= 64 THEN k - 128 ELSE k END")
_wave("vcd_bit_range", lambda r: r.load_waveform("top.core.v[7:4]", "top.clk"), "(v >> 4) & 15")
_wave("vcd_range_of_bank", lambda r: r.load_waveform("top.bank0.q[6:5]", "top.clk"), "((k % 16) >> 1) & 3")
_wave("vcd_window_cycle", lambda r: r.load_waveform("top.core.k", "top.clk", begin_cycle=10, end_cycle=500), "k", where="clock >= 10 AND clock < 500")
_wave("vcd_window_time", lambda r: r.load_waveform("top.core.k", "top.clk", begin_time=3408400000000000, end_time=3410000000000000), "k", where="time >= 3408400000000000 AND time < 3410000000000000")
_wave("vcd_unknown_mask", lambda r: r.load_unknown_mask("top.core.mix", "top.clk"), "CASE WHEN k % 5 < 2 THEN 8 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END")
_wave("vcd_unknown_mask_x", lambda r: r.load_unknown_mask("top.core.mix", "top.clk", include_z=False), "CASE WHEN k % 5 = 0 THEN 8 ELSE 0 END")
_wave("vcd_unknown_as_one", lambda r: r.load_waveform("top.core.mix", "top.clk", xz_value=1), "CASE WHEN k % 5 < 2 THEN 8 ELSE 0 END + 4 + k % 4")
_add("vcd_sparse_asof", lambda r: _rows(r.load_waveform("top.core.amount", "top.clk")), ", p AS (SELECT t, arg_max(v, id) AS a FROM e WHERE et = 'purchase' GROUP BY t) SELECT clock AS idx, clock, n.time, coalesce(p.a, (SELECT arg_min(a, t) FROM p)) AS value FROM n ASOF LEFT JOIN p ON n.time >= p.t")
_add("vcd_time_range", lambda r: r.changes().agg(F.min("time").alias("begin_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("changes")), "SELECT min(t) AS begin_time, max(t) + 1 AS end_time, (SELECT 8 * count(*) + count(*) FILTER (et = 'purchase') FROM e) + 2 * count(*) + 2 * count(*) FILTER (t % 4 = 0) AS changes FROM n")
_add("vcd_matched", lambda r: _keyed(r.load_matched_waveforms("top.bank{0,1}.q", "top.clk")), "SELECT '((''0'',),)' AS key, clock, time, k % 16 AS value FROM n UNION ALL SELECT '((''1'',),)', clock, time, xor(k, 5) % 16 FROM n")
_add("vcd_matched_masks", lambda r: _keyed(r.load_matched_unknown_masks("top.core.m*".replace("m*", "/mi(x)/"), "top.clk", include_x=False)), "SELECT '((''x'',),)' AS key, clock, time, CASE WHEN k % 5 = 1 THEN 8 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END AS value FROM n")
_add(
    "vcd_clock_pairing",
    lambda r: _keyed(r.load_matched_waveforms("top.unit_{a,b}.data", "top.unit_{a,b}.clk")),
    "SELECT '((''a'',),)' AS key, clock, time, k AS value FROM n UNION ALL SELECT '((''b'',),)', row_number() OVER (ORDER BY t) - 1, time, 127 - k FROM n WHERE t % 4 = 0",
)
_add("vcd_eval", lambda r: _rows(r.eval("top.core.v + top.core.k[6:0]", "top.clk")), "SELECT clock AS idx, clock, time, v + k AS value FROM n")
_add("vcd_eval_bits", lambda r: _rows(r.eval("(top.core.v[7:0] ^ top.core.v[15:8]) + top.bank0.q", "top.clk")), "SELECT clock AS idx, clock, time, xor(v & 255, (v >> 8) & 255) + k % 16 AS value FROM n")
_add("vcd_eval_zip", lambda r: _keyed(r.eval("top.bank{0,1}.q + top.core.k", "top.clk", mode="zip")), "SELECT '((''0'',),)' AS key, clock, time, k % 16 + k AS value FROM n UNION ALL SELECT '((''1'',),)', clock, time, xor(k, 5) % 16 + k FROM n")


# --- the hierarchy and path queries -----------------------------------------------------------------------------------
def _tree(r: VcdReader) -> DataFrame:
    rows = []

    def walk(node, depth: int) -> None:
        rows.append((depth, node.kind, node.full_name, node.width or 0))
        for c in node.children:
            walk(c, depth + 1)

    for top in r.top_scopes:
        walk(top, 0)
    return r.spark.createDataFrame(rows, "depth int, kind string, full_name string, width int")


def _listed(*rows: tuple) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


_scopes = [(0, "scope", "top", 0), *((1, "scope", f"top.{s}", 0) for s in ("core", "unit_a", "unit_b", "bank0", "bank1"))]
_add("vcd_hierarchy", _tree, f"SELECT CAST(d AS INT) AS depth, kind, full_name, CAST(w AS INT) AS width FROM (VALUES {_listed(*_scopes, *((p.count('.'), 'signal', p, w) for p, (_, w) in SIGNALS.items()))}) t(d, kind, full_name, w)")

#: Path, the kind asked for, and what it matches: (key, full name).
PATHS: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("top.core.v", "signal", [("()", "top.core.v[39:0]")]),
    ("top.core.v[7:4]", "signal", [("()", "top.core.v[7:4]")]),
    ("top.core.k[3]", "signal", [("()", "top.core.k[3]")]),
    ("top.bank{0..1}.q", "signal", [("(('0',),)", "top.bank0.q[7:4]"), ("(('1',),)", "top.bank1.q[7:4]")]),
    ("top.{unit_a,bank1}.{data,q}", "signal", [("(('unit_a',), ('data',))", "top.unit_a.data[6:0]"), ("(('bank1',), ('q',))", "top.bank1.q[7:4]")]),
    ("top./bank(\\d)/.q", "signal", [("(('0',),)", "top.bank0.q[7:4]"), ("(('1',),)", "top.bank1.q[7:4]")]),
    ("top.@unit_.*.clk", "signal", []),
    ("top.*.clk", "signal", [("('unit_a',)", "top.unit_a.clk"), ("('unit_b',)", "top.unit_b.clk")]),
    ("**.view", "signal", [("('top.core',)", "top.core.view")]),
    ("top.*", "scope", [(f"('{s}',)", f"top.{s}") for s in ("core", "unit_a", "unit_b", "bank0", "bank1")]),
    ("top.*", "node", [(f"('{s}',)", f"top.{s}") for s in ("core", "unit_a", "unit_b", "bank0", "bank1", "clk")]),
]


def _found(r: VcdReader) -> DataFrame:
    rows = []
    for path, kind, _ in PATHS:
        find = {"signal": r.get_matched_signals, "scope": r.get_matched_scopes, "node": r.get_matched_nodes}[kind]
        rows += [(path, kind, str(key), node.full_name) for key, node in find(path).items()]
    return r.spark.createDataFrame(rows, "path string, kind string, key string, full_name string")


_add("vcd_paths", _found, f"SELECT * FROM (VALUES {_listed(*((p, kind, key, name) for p, kind, found in PATHS for key, name in found))}) t(path, kind, key, full_name)")
