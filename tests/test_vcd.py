import pytest

from chronowave.sources.hierarchy import parse_path
from chronowave.sources.vcd import VcdReader, extract_paths, has_fsdb_support

DUMP = """$timescale 1ns $end
$scope module tb $end
$var wire 1 ! clk $end
$scope module u0 $end
$var wire 4 " s [3:0] $end
$var wire 4 # asc [0:3] $end
$upscope $end
$scope module u1 $end
$var wire 4 $ s [3:0] $end
$upscope $end
$upscope $end
$enddefinitions $end
$dumpvars
0!
bx "
b0011 #
b101 $
$end
#5
1!
b1 "
#10
0!
b1010 "
#15
1!
#20
0!
bz10 "
b1000 #
#25
1!
#30
0!
"""


@pytest.fixture(scope="module")
def reader(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vcd") / "a.vcd"
    path.write_text(DUMP)
    return VcdReader(spark, str(path), chunk_bytes=40)


def test_sampling(reader):
    assert reader.load_waveform("tb.u0.s[3:0]", "tb.clk").rows() == [0, 10, 2, 2]
    assert reader.load_waveform("tb.u0.s", "tb.clk", xz_value=1).rows() == [15, 10, 14, 14]
    assert reader.load_unknown_mask("tb.u0.s", "tb.clk").rows() == [15, 0, 12, 12]
    assert reader.load_unknown_mask("tb.u0.s", "tb.clk", include_x=False).rows() == [0, 0, 12, 12]
    assert reader.load_waveform("tb.u0.s", "tb.clk", sample_on_posedge=True).rows() == [1, 10, 2]
    assert reader.load_waveform("tb.u0.asc[2:3]", "tb.clk").rows() == [3, 3, 0, 0]
    assert reader.load_waveform("tb.u0.s[3:2]", "tb.clk", begin_cycle=1, end_cycle=3).rows() == [2, 0]
    assert reader.time_range() == (0, 30)
    with pytest.raises(ValueError):
        reader.load_waveform("tb.u0.s", "tb.clk", begin_cycle=9)
    with pytest.raises(ValueError):
        reader.load_waveform("tb.u0.s", "tb.clk", begin_time=1, begin_cycle=1)
    with pytest.raises(ValueError):
        reader.load_waveform("tb.u0.none", "tb.clk")


def test_paths(reader):
    assert list(reader.get_matched_signals("tb.u{0..1}.s")) == [(("0",),), (("1",),)]
    assert list(reader.get_matched_signals("tb./u(.)/.s[1:0]")) == [(("0",),), (("1",),)]
    assert [n.full_name for n in reader.get_matched_signals("tb.*.s").values()] == ["tb.u0.s[3:0]", "tb.u1.s[3:0]"]
    assert len(reader.get_matched_signals("**.s")) == 2 and list(reader.get_matched_scopes("tb.u0")) == [()]
    with pytest.raises(ValueError):
        reader.get_matched_signals("tb.$Mod.s")
    with pytest.raises(ValueError):
        parse_path("tb./u")
    with pytest.raises(ValueError):
        parse_path("tb.{a")
    with pytest.raises(ValueError):
        reader.get_matched_signals("tb.u0.s[7:0]")


def test_matched_and_eval(reader):
    got = reader.load_matched_waveforms("tb.u{0,1}.s", "tb.clk")
    assert got[(("1",),)].rows() == [5] * 4
    assert reader.eval("tb.u0.s[3:0] + tb.u1.s", "tb.clk").rows() == [5, 15, 7, 7]
    both = reader.eval("tb.u{0,1}.s[3:0][1:0] + tb.u1.s", "tb.clk", mode="zip")
    assert both[(("0",),)].rows() == [5, 7, 7, 7] and both[(("1",),)].rows() == [6] * 4
    with pytest.raises(ValueError, match="mode='single'"):
        reader.eval("tb.u{0,1}.s + 1", "tb.clk")
    assert extract_paths("a.b[3:0][1] + 1.5 * a.b[3:0]")[1] == {"__wave_0__": "a.b[3:0]"}
    assert not has_fsdb_support()


def test_written_dumps_read_back(spark, tmp_path):
    from chronowave.sources.vcd import write_vcd

    rows = [(0, 1, "a", "0"), (0, 2, "b", "xz01"), (5, 3, "a", "1"), (5, 4, "b", "1"), (7, 5, "a", "0")]
    write_vcd(spark.createDataFrame(rows, "time long, seq long, code string, bits string"), {"top.clk": ("a", 1), "top.u.bus[3:0]": ("b", 4)}, f"{tmp_path}/x/w.vcd")
    reader = VcdReader(spark, f"{tmp_path}/x/w.vcd")
    assert sorted((r["time"], r["code"], r["bits"]) for r in reader.changes().collect()) == sorted((t, c, b) for t, _, c, b in rows)
    assert reader.signal("top.u.bus[2:1]").selected_width == 2
    assert reader.load_waveform("top.u.bus", "top.clk").rows() == [1, 1] and reader.load_unknown_mask("top.u.bus", "top.clk").rows() == [12, 0]


def test_headers_that_never_end(spark, tmp_path):
    for text in ("$scope module a $end\n$enddefinitions", "$scope module a $end\n"):
        (tmp_path / "cut.vcd").write_text(text)
        with pytest.raises(ValueError, match="enddefinitions"):
            VcdReader(spark, f"{tmp_path}/cut.vcd")


def test_changes_before_a_time(spark, tmp_path):
    from chronowave.sources.vcd import VcdDataReader, write_vcd

    rows = [(t, t, "a", str(t // 5 % 2)) for t in range(0, 4000, 5)]
    write_vcd(spark.createDataFrame(rows, "time long, seq long, code string, bits string"), {"top.clk": ("a", 1)}, f"{tmp_path}/w.vcd")
    reader = VcdReader(spark, f"{tmp_path}/w.vcd", chunk_bytes=500)
    for until in (0, 1, 995, 1000, 9999):
        assert sorted(r["time"] for r in reader.changes(until=until).collect()) == [t for t, *_ in rows if t < until]
    whole, part = (len(VcdDataReader(f"{tmp_path}/w.vcd", 500, None, until).partitions()) for until in (None, 1000))
    assert part < whole / 2
    assert reader.load_waveform("top.clk", "top.clk", end_time=100).rows() == [0] * 10
