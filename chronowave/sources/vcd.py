"""Value-change dumps as a Spark data source, and the reader over them.

``spark.read.format("vcd").load(path)`` gives (time, seq, code, bits). The header is read once; the body is cut into byte
ranges that start at a time line, so tasks read independently; the option ``codes``, a JSON list, leaves other signals unread,
and ``until`` the changes from a time on: later byte ranges make no task.
(Filters aren't pushed down: Spark shares a Python reader among scans of one plan, with the filters of only one of them.)
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frame import Frame, Wave
from ..operators import sampling
from ..session import configure
from . import hierarchy
from .hierarchy import Key, Node, Range

CHUNK = 32 << 20


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + __import__("os").path.abspath(path))
    return system.open_input_file(name)


def read_header(path: str) -> tuple[list[Node], int]:
    """Top scopes, and where the body begins."""
    with _open(path) as file:
        text = b""
        while (end := text.find(b"$enddefinitions")) < 0:
            block = file.read(1 << 20)
            if not block:
                raise ValueError(f"{path}: no $enddefinitions")
            text += block
        while (stop := text.find(b"$end", end + 15)) < 0:
            block = file.read(1 << 16)
            if not block:
                raise ValueError(f"{path}: no $end after $enddefinitions")
            text += block
    tops: list[Node] = []
    stack: list[Node] = []
    for m in re.finditer(r"\$(scope|var|upscope)\b(.*?)\$end", text[:end].decode("utf-8", "replace"), re.S):
        words = m[2].split()
        if m[1] == "upscope":
            stack.pop()
            continue
        if m[1] == "scope":
            node = Node(words[1], "scope", stack[-1] if stack else None)
            known = next((n for n in (stack[-1].children if stack else tops) if n.kind == "scope" and n.base == node.base), None)
            if known is None:
                (stack[-1].children if stack else tops).append(node)
            stack.append(known or node)
            continue
        width, code, name = int(words[1]), words[2], "".join(words[3:])
        if not stack:
            raise ValueError(f"signal {name!r} is in no scope")
        base, native = hierarchy._tail(name)
        if native is not None and native.width != width:
            base, native = name, None  # an element of an array, such as mem[3]
        if native is None and width > 1:
            native = Range(width - 1, 0)
        node = Node(base, "signal", stack[-1], [], code, width, native, native)
        if not any(n.kind == "signal" and n.base == base for n in stack[-1].children):
            stack[-1].children.append(node)

    def scopes_first(node: Node) -> None:
        node.children.sort(key=lambda n: n.kind != "scope")
        for c in node.children:
            scopes_first(c)

    for t in tops:
        scopes_first(t)
    return tops, stop + 4


class _Part(InputPartition):
    def __init__(self, begin: int, end: int, number: int):
        self.begin, self.end, self.number = begin, end, number


class VcdDataReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, codes: set[str] | None = None, until: int | None = None):
        self.path, self.chunk, self.codes, self.until = path, chunk, codes, until

    def partitions(self) -> list[InputPartition]:
        _, start = read_header(self.path)
        with _open(self.path) as file:
            size = file.size()
            cuts = [start]
            while cuts[-1] + self.chunk < size:
                at = cuts[-1] + self.chunk
                found = -1
                while found < 0 and at < size:
                    block = file.read_at(1 << 20, at)
                    found = block.find(b"\n#")
                    at += found + 1 if found >= 0 else max(1, len(block) - 1)
                if found < 0:
                    break
                if self.until is not None and int(file.read_at(min(32, size - at), at).split()[0][1:]) >= self.until:
                    size = at  # this range and all after it are too late
                    break
                cuts.append(at)
        return [_Part(a, b, i) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], size], strict=True))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with _open(self.path) as file:
            text = file.read_at(partition.end - partition.begin, partition.begin).decode("ascii", "replace")
        time, seq, codes, words = 0, partition.number << 40, self.codes, iter(text.split())
        for w in words:
            first = w[0]
            if first == "#":
                time = int(w[1:])
                if self.until is not None and time >= self.until:
                    return
            elif first in "bBrR":
                code = next(words)
                seq += 1
                if first in "rR":
                    if codes is None or code in codes:
                        raise ValueError(f"real signal {code!r}: only bit vectors are read")
                elif codes is None or code in codes:
                    yield time, seq, code, w[1:].lower()
            elif first in "01xXzZ":
                seq += 1
                if codes is None or w[1:] in codes:
                    yield time, seq, w[1:], first.lower()
            elif w == "$comment":
                while next(words) != "$end":
                    pass


class VcdDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcd"

    def schema(self) -> str:
        return "time long, seq long, code string, bits string"

    def reader(self, schema) -> VcdDataReader:
        codes, until = self.options.get("codes"), self.options.get("until")
        return VcdDataReader(self.options["path"], int(self.options.get("chunkBytes", CHUNK)), set(json.loads(codes)) if codes else None, None if until is None else int(until))


def write_vcd(changes: DataFrame, signals: dict[str, tuple[str, int]], path: str, timescale: str = "1 ns") -> None:
    """A dump of ``changes`` (time, seq, code, bits). ``signals``: full path, such as ``top.core.data[7:0]``, to (code, width).

    A dump is one file in time order, so the sorted rows pass the driver one partition after the other; none is held.
    """
    from pyarrow import fs

    tree: dict[str, Any] = {}
    for full, (code, width) in signals.items():
        *scopes, name = full.split(".")
        here = tree
        for scope in scopes:
            here = here.setdefault(scope, {})
        here[name] = (code, width)

    def declared(node: dict[str, Any]) -> Iterator[str]:
        for name, value in node.items():
            if isinstance(value, dict):
                yield f"$scope module {name} $end"
                yield from declared(value)
                yield "$upscope $end"
            else:
                base, selected = hierarchy._tail(name)
                yield f"$var wire {value[1]} {value[0]} {base}{f' {selected}' if selected else ''} $end"

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + __import__("os").path.abspath(path))
    system.create_dir(name.rpartition("/")[0], recursive=True)
    single = {code for code, width in signals.values() if width == 1}
    with system.open_output_stream(name) as out:
        out.write("\n".join([f"$timescale {timescale} $end", *declared(tree), "$enddefinitions $end", ""]).encode())
        before = None
        for r in changes.orderBy("time", "seq").select("time", "code", "bits").toLocalIterator(prefetchPartitions=True):
            if r[0] != before:
                out.write(f"#{r[0]}\n".encode())
                before = r[0]
            out.write(f"{r[2]}{r[1]}\n".encode() if r[1] in single else f"b{r[2]} {r[1]}\n".encode())


def has_fsdb_support() -> bool:
    """FSDB needs a proprietary library that isn't part of this engine."""
    return False


class VcdReader:
    """A dump's hierarchy and its signals as frames."""

    def __init__(self, spark: SparkSession, path: str, chunk_bytes: int = CHUNK):
        configure(spark).dataSource.register(VcdDataSource)
        self.spark, self.path, self.chunk_bytes = spark, path, chunk_bytes
        self.top_scopes, _ = read_header(path)

    def changes(self, codes: list[str] | None = None, until: int | None = None) -> DataFrame:
        """(time, seq, code, bits) of some signals, or of all; with ``until`` those before a time."""
        source = self.spark.read.format("vcd").option("chunkBytes", self.chunk_bytes)
        source = source if until is None else source.option("until", until)
        return (source.option("codes", json.dumps(codes)) if codes else source).load(self.path)

    def __enter__(self) -> VcdReader:
        return self

    def __exit__(self, *error: Any) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def time_range(self) -> tuple[int, int]:
        r = self.changes().agg(F.min("time"), F.max("time")).first()
        return r[0], r[1]

    def get_matched_nodes(self, path: str, root: Node | None = None) -> dict[Key, Node]:
        return hierarchy.find(root.children if root else self.top_scopes, path)

    def get_matched_scopes(self, path: str, root: Node | None = None) -> dict[Key, Node]:
        return hierarchy.find(root.children if root else self.top_scopes, path, "scope")

    def get_matched_signals(self, path: str, root: Node | None = None) -> dict[Key, Node]:
        return hierarchy.find(root.children if root else self.top_scopes, path, "signal")

    def signal(self, path: str | Node, root: Node | None = None) -> Node:
        if isinstance(path, Node):
            return path
        found = list(self.get_matched_signals(path, root).values())
        if len(found) != 1:
            raise ValueError(f"signal {path!r} not found" if not found else f"{path!r} matches {len(found)} signals")
        return found[0]

    def _edges(self, clock: Node, posedge: bool, **window: int | None) -> DataFrame:
        rows = self.changes([clock.code])
        values = rows.select(F.lit(0).cast("bigint").alias("trace"), "time", "seq", sampling.known_bits(F.substring("bits", -1, 1)).cast("bigint").alias("value"))
        edges = sampling.clock_edges(values, posedge)
        n = edges.count()
        if not n:
            raise ValueError(f"no {'pos' if posedge else 'neg'}edges of {clock.full_name}")
        if (window.get("begin_cycle") or 0) >= n or (window.get("end_cycle") or 0) > n:
            raise ValueError(f"the clock has {n} cycles")
        return sampling.window_edges(edges, **window)

    def load_signals(self, signals: dict[str, Node], clock: Node, *, mask: tuple[bool, bool] | None = None, xz_value: int = 0, signed: bool = False, sample_on_posedge: bool = False, **window: int | None) -> Frame:
        """All signals sampled on one clock: one scan, one as-of window, one pivot."""
        if xz_value not in (0, 1):
            raise ValueError("xz_value is 0 or 1")
        edges = self._edges(clock, sample_on_posedge, **window)
        codes = sorted({n.code for n in signals.values()})
        rows = self.changes(codes, window.get("end_time")).select(F.lit(0).cast("bigint").alias("trace"), "code", "time", "seq", F.col("bits").alias("value"))
        have = {r["code"] for r in rows.select("code").distinct().collect()}
        for n in signals.values():
            if n.code not in have:
                raise ValueError(f"signal {n.full_name!r} has no value changes")
        sampled = sampling.sample(edges, rows, ["code"])
        wide = sampled.groupBy("trace", "idx", "clock", "time").pivot("code", codes).agg(F.first("value"))
        columns = []
        for name, n in signals.items():
            bits = sampling.extend_bits(F.col(f"`{n.code}`"), n.width)
            if n.range and n.native:
                bits = F.substring(bits, n.native.offset(n.range) + 1, n.selected_width)
            bits = sampling.unknown_bits(bits, *mask) if mask else sampling.known_bits(bits, xz_value)
            columns.append(sampling.bits_value(bits, n.selected_width).alias(name))
        kinds = {name: (n.selected_width, signed and mask is None) for name, n in signals.items()}
        return Frame(wide.select("trace", "idx", "clock", "time", *columns), kinds)

    def load_waveform(self, signal: str | Node, clock: str | Node, **options: Any) -> Wave:
        """The signal at each clock edge; the falling edge unless told otherwise."""
        return self.load_signals({"value": self.signal(signal)}, self.signal(clock), **options)["value"]

    def load_unknown_mask(self, signal: str | Node, clock: str | Node, include_x: bool = True, include_z: bool = True, **options: Any) -> Wave:
        return self.load_waveform(signal, clock, mask=(include_x, include_z), **options)

    def load_matched_waveforms(self, signal_path: str, clock_path: str, root: Node | None = None, **options: Any) -> dict[Key, Wave]:
        signals, clocks = self.get_matched_signals(signal_path, root), self.get_matched_signals(clock_path, root)
        pairs = hierarchy.pair_clocks(list(signals), list(clocks))
        out: dict[Key, Wave] = {}
        for c, clock in clocks.items():
            mine = [k for k in signals if pairs[k] == c]
            if mine:
                frame = self.load_signals({f"s{i}": signals[k] for i, k in enumerate(mine)}, clock, **options)
                out |= {k: frame[f"s{i}"] for i, k in enumerate(mine)}
        return out

    def load_matched_unknown_masks(self, signal_path: str, clock_path: str, include_x: bool = True, include_z: bool = True, **options: Any) -> dict[Key, Wave]:
        return self.load_matched_waveforms(signal_path, clock_path, mask=(include_x, include_z), **options)

    def eval(self, expression: str, clock: str | Node, mode: str = "single", root: Node | None = None, **options: Any):
        """An expression with signal paths in it: one wave, or with ``zip`` one per key of the paths that match several."""
        from ..plans.expression import evaluate

        if mode not in ("single", "zip"):
            raise ValueError(f"unknown mode {mode!r}")
        text, paths = extract_paths(expression)
        matched = {name: self.get_matched_signals(path, root) for name, path in paths.items()}
        for name, found in matched.items():
            if not found or (mode == "single" and len(found) > 1):
                raise ValueError(f"{paths[name]!r} matches {len(found)} signals; mode='single' takes exactly one each")
        several = {n: f for n, f in matched.items() if len(f) > 1}
        keys = list(next(iter(several.values()))) if several else [()]
        if any(set(f) != set(keys) for f in several.values()):
            raise ValueError("the paths match different sets of keys")
        chosen = {f"{n}_{i}": (f[k] if n in several else next(iter(f.values()))) for n, f in matched.items() for i, k in enumerate(keys)}
        frame = self.load_signals(chosen, self.signal(clock), **options)
        out = {k: evaluate(text, {n: frame[f"{n}_{i}"] for n in matched}) for i, k in enumerate(keys)}
        return out[keys[0]] if mode == "single" else out


_PATH = re.compile(r"(?<![\w.])((?:[A-Za-z_]|\{[^}]*\})(?:[\w$]|\{[^}]*\})*(?:\.(?:[\w$]|\{[^}]*\})+)+(?:\[\d+(?::\d+)?\])?)")


def extract_paths(expression: str) -> tuple[str, dict[str, str]]:
    """The expression with each distinct path replaced by a name, and the names' paths. The first bracket after a path is
    part of it; a second one selects bits of the value."""
    names: dict[str, str] = {}

    def swap(m: re.Match) -> str:
        return names.setdefault(m[1], f"__wave_{len(names)}__")

    text = _PATH.sub(swap, expression)
    return text, {n: p for p, n in names.items()}
