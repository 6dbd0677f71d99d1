from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import ids as I
from orrery.functions.time import doy_range, nearest_week, period_seconds
from orrery.sources import binary as B
from orrery.sources import files as X
from orrery.sources import text as T
from orrery.sources import writers as W


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def head(label, text=""):
    return f"{text:60}{label}\n"


OBS3 = (
    head("RINEX VERSION / TYPE", "     3.04           OBSERVATION DATA    M") + head("MARKER NAME", "ALIC") + head("SYS / # / OBS TYPES", "G    4 C1C L1C D1C S1C") + head("SYS / # / OBS TYPES", "R    2 C1C L1C") + head("END OF HEADER")
    + "> 2019 07 18 00 00 30.0000000  0  2\n"
    + "G05" + f"{20000000.123:14.3f} 7" + f"{105000000.456:14.3f}17" + f"{-1234.5:14.3f}  " + f"{45.0:14.3f}  \n"
    + "R 7" + f"{19000000.0:14.3f}  " + f"{0.0:14.3f}  \n"
    + "> 2019 07 18 00 01  0.0000000  4  1\ncomment line\n"
    + "> 2019 07 18 00 01 30.0000000  0  1\nG05" + " " * 16 + f"{105000001.0:14.3f}  \n"
)
OBS2 = (
    head("RINEX VERSION / TYPE", "     2.11           OBSERVATION DATA    G (GPS)") + head("MARKER NAME", "OLD1") + head("# / TYPES OF OBSERV", "     6    L1    L2    C1    P2    S1    S2") + head("END OF HEADER")
    + " 19  7 18  0  0  0.0000000  0  2G01G12\n"
    + "".join(f"{v:14.3f}  " for v in (1.0, 2.0, 3.0, 4.0, 5.0)) + "\n" + f"{6.0:14.3f}  \n" + "".join(f"{v:14.3f}  " for v in (11.0, 0.0, 13.0, 14.0, 15.0)) + "\n\n"
)
NAV = head("RINEX VERSION / TYPE", "     3.04           N: GNSS NAV DATA    M") + head("END OF HEADER") + "G01 2019 07 18 02 00 00-1.0D-04 0.000000000000D+00 1.000000000000D+00".replace("-1.0D-04", "-1.000000000000D-04") + "\n" + "".join("    " + "".join(f"{v:19.12E}" for v in range(4 * k, 4 * k + 4)) + "\n" for k in range(7))
SP3 = "#dP2019  7 18  0  0  0.00000000       2\n*  2019  7 18  0  0  0.00000000\nPG01  15000.000001 -20000.000000   5000.500000    -12.345678\nPR02      0.000000      0.000000      0.000000 999999.999999\n*  2019  7 18  0 15  0.00000000\nPG01  15001.000000 -20000.000000   5000.500000    -12.345678\nEOF\n"
ANTEX = (
    head("ANTEX VERSION / SYST", "     1.4            M") + head("START OF ANTENNA") + head("TYPE / SERIAL NO", "BLOCK IIA           G01") + head("ZEN1 / ZEN2 / DZEN", "     0.0  10.0   5.0") + head("VALID FROM", "  1992    11    22     0     0    0.0000000")
    + head("START OF FREQUENCY", "   G01") + head("NORTH / EAST / UP", "    279.00      0.00   2319.50") + "   NOAZI   -0.80   -0.90   -0.70\n     0.0   -0.10   -0.20   -0.30\n" + head("END OF FREQUENCY") + head("END OF ANTENNA")
)
IONEX = head("IONEX VERSION / TYPE", "     1.0            IONOSPHERE MAPS     GNSS") + head("EXPONENT", "    -1") + head("START OF TEC MAP", "     1") + head("EPOCH OF CURRENT MAP", "  2019     7    18     0     0     0") + head("LAT/LON1/LON2/DLON/H", "    87.5-180.0-160.0  10.0 450.0") + "   10 9999   30\n" + head("END OF TEC MAP", "     1")
ORBEX = "%=ORBEX  0.09\n## 2019 07 18 00 00 0.000000000 2\n ATT G01              4  0.5  0.5  0.5  0.5\n ATT R02              4  1.0  0.0  0.0  0.0\n"
BLQ = "$$ header\n  ALIC\n$$ complete\n" + "".join("  " + " ".join(f"{0.001 * (k + 1):.5f}" for _ in range(11)) + "\n" for k in range(3)) + "".join("  " + " ".join(f"{10.0 * (k + 1):.1f}" for _ in range(11)) + "\n" for k in range(3))
CRD = "H1 CRD 2 2019 7 18 0\nH2 YARL 7090 5 13 4\nH3 lageos1 7603901 1155 8820 0 1\nH4 1 2019 7 18 23 50 0 2019 7 19 0 10 0 0 0 0 0 1 0 2 0\n11 86390.5 0.045 std 2 120.0 15 1 1 1 0 0\n11 10.25 0.046 std 2 120.0 12 1 1 1 0 0\nH8\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    X.register(spark)
    d = tmp_path_factory.mktemp("gnss")
    for kind, text in {"rinex_obs": OBS3, "rinex_nav": NAV, "sp3": SP3, "antex": ANTEX, "ionex": IONEX, "orbex": ORBEX, "blq": BLQ, "crd": CRD}.items():
        (d / kind).mkdir()
        (d / kind / f"one.{kind}").write_text(text)
    (d / "rinex_obs" / "two.rinex_obs").write_text(OBS2)
    return d


def load(spark, folder, kind):
    return spark.read.format("gnss").option("kind", kind).load(str(folder / kind))


def test_rinex_observations(spark, folder):
    rows = load(spark, folder, "rinex_obs").collect()
    new = [r for r in rows if r.marker == "ALIC"]
    assert {(r.sat, r.code): (r.value, r.lli) for r in new if r.epoch == datetime(2019, 7, 18, 0, 0, 30)} == {("G05", "C1C"): (20000000.123, 0), ("G05", "L1C"): (105000000.456, 1), ("G05", "D1C"): (-1234.5, 0), ("G05", "S1C"): (45.0, 0), ("R07", "C1C"): (19000000.0, 0)}
    assert [(r.code, r.value) for r in new if r.epoch.minute == 1] == [("L1C", 105000001.0)]
    old = {(r.sat, r.code): r.value for r in rows if r.marker == "OLD1"}
    assert old[("G01", "S2")] == 6.0 and ("G12", "L2") not in old and old[("G12", "S1")] == 15.0 and len(old) == 10


def test_rinex_navigation(spark, folder):
    r = load(spark, folder, "rinex_nav").first()
    assert r.sat == "G01" and r.toc == datetime(2019, 7, 18, 2) and r.f0 == -1e-4 and r.orbit == [float(k) for k in range(28)]


def test_sp3(spark, folder):
    rows = {(r.sat, r.epoch.minute): r for r in load(spark, folder, "sp3").collect()}
    assert rows["G01", 0].x == pytest.approx(15000000.001) and rows["G01", 0].clk == pytest.approx(-12.345678e-6) and rows["R02", 0].x is None and rows["R02", 0].clk is None and len(rows) == 3


def test_antex_ionex_orbex_blq_crd(spark, folder):
    a = load(spark, folder, "antex").collect()
    assert len(a) == 2 and a[0].azimuth is None and a[0].pcv == pytest.approx([-0.0008, -0.0009, -0.0007]) and a[0].up == pytest.approx(2.3195) and a[1].azimuth == 0.0 and a[0].valid_from == datetime(1992, 11, 22)
    i = {r.lon: r.value for r in load(spark, folder, "ionex").collect()}
    assert i == {-180.0: 1.0, -170.0: None, -160.0: 3.0}
    assert {r.sat: r.q0 for r in load(spark, folder, "orbex").collect()} == {"G01": 0.5, "R02": 1.0}
    b = load(spark, folder, "blq").collect()
    assert len(b) == 33 and {(r.axis, r.amplitude, r.phase) for r in b} == {("up", 0.001, 10.0), ("west", 0.002, 20.0), ("south", 0.003, 30.0)}
    c = [(r.station, r.satellite, r.epoch, r.n) for r in load(spark, folder, "crd").orderBy("epoch").collect()]
    assert c == [("YARL", "lageos1", datetime(2019, 7, 18, 23, 59, 50, 500000), 15), ("YARL", "lageos1", datetime(2019, 7, 19, 0, 0, 10, 250000), 12)]


def test_detect():
    for kind, text in {"rinex_obs": OBS3, "rinex_nav": NAV, "sp3": SP3, "antex": ANTEX, "ionex": IONEX, "orbex": ORBEX, "blq": BLQ, "crd": CRD}.items():
        assert X.detect(text.splitlines()) == kind
    assert X.detect([]) is None


def test_trace_lines(spark):
    ok = "% -1 2021-03-04 00:01:00.00 PHAS_MEAS G20 ALIC L1C 0.1 -2.5E-3 0.01 KF-1"
    rows = T.trace(lines(spark, ok, ok.replace("KF-1", "1.5 2.5 KF-2"), "% short", "no trace", ok.replace("0.1 ", "nan? "))).collect()
    assert [(r.iter, r.prefit, r.prefit_ratio, r.label) for r in rows] == [(-1, 0.1, None, "KF-1"), (-1, 0.1, 1.5, "KF-2"), (-1, None, None, "KF-1")]


def test_errors_and_resets(spark):
    e = T.large_errors(lines(spark, "2021-03-04 05:06:30.00  LARGE MEAS  ERROR OF : 12.5 AT 3 : CODE_MEAS E11 ALIC L1C", "2021-03-04 05:06:30.00 LARGE STATE ERROR OF: 2.5 AT 30 : TROP ALIC 1", "x")).collect()
    assert [(r.kind, r.value, r.sat, r.recv, r.param, r.comp) for r in e] == [("MEAS", 12.5, "E11", "ALIC", None, None), ("STATE", 2.5, None, "ALIC", "TROP", "1")]
    a = T.ambiguity_resets(lines(spark, "2021-03-04 05:06:30.00  Ambiguity Removed      - PREPROC  AMBIGUITY  E11  ALIC  L1C  - GF  - SCDIA - GF", "2021-03-04 05:06:30.00  Ambiguity Removed      -  REJECT  AMBIGUITY  R05  YARR  L2W")).collect()
    assert [(r.action, r.reasons) for r in a] == [("PREPROC", ["GF", "SCDIA"]), ("REJECT", ["KF"])]


def test_bias_clock_erp_and_tables(spark):
    b = " OSB  G063 G01           C1C       2019:199:00000 2019:200:00000 ns                10.0000      0.0100"
    r = T.bias_sinex(lines(spark, b, "+BIAS/SOLUTION", b.replace("2019:200:00000", "0000:000:00000"))).collect()
    assert r[0].prn == "G01" and r[0].cod1 == "C1C" and r[0].bias == pytest.approx(2.99792458) and r[0].tini == datetime(2019, 7, 18) and r[1].tfin is None
    c = T.rinex_clock(lines(spark, "AS G01  2019 07 18 00 00  0.000000  2   -0.123456789012E-03  0.1D-10", "AR ALIC 2019 07 18 00 00 30.000000  1    0.5E-06", "X")).collect()
    assert [(x.type, x.id, x.clk, x.clk_std) for x in c] == [("AS", "G01", -0.123456789012e-3, 1e-11), ("AR", "ALIC", 0.5e-6, None)]
    e = T.erp(lines(spark, "version 2", "58682.00 123456 -654321 -1234567 12345 1 2 3", "2019   7  18  58682   0.123456   0.654321  -0.1234567   0.0012")).collect()
    assert [(x.mjd, x.xp, x.ut1_utc) for x in e] == [(58682.0, pytest.approx(0.123456), pytest.approx(-0.1234567)), (58682.0, 0.123456, -0.1234567)]
    g = T.gravity_field(lines(spark, "head", "gfc  2  0 -0.484165D-03 0.0", "gfc 70 1 1.0 2.0"), 10).collect()
    assert [(x.n, x.c) for x in g] == [(2, -0.484165e-3)]
    v = T.vmf3_grid(lines(spark, "! comment", "  89.5    0.5 0.00116046 0.00060234  2.3015  0.0100", "bad")).collect()
    assert len(v) == 1 and v[0].zhd == 2.3015
    m = T.igrf(lines(spark, "# c", "g/h n m 1900.0 1905.0 2020-25", "g 1 0 -31543 -31464 5.7")).collect()
    assert [(x.epoch, x.value) for x in m] == [(1900.0, -31543.0), (1905.0, -31464.0), (None, 5.7)]


def test_sinex_block(spark):
    est = "     1 STAX   ALIC  A    1 19:199:43200 m    2 -.405205216852374E+07  .10000E-02"
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(["%=SNX", "+SOLUTION/ESTIMATE", "*INDEX", est, "-SOLUTION/ESTIMATE", est])], "file string, n int, value string")
    r = T.sinex_estimates(T.sinex_block(df, "file", "n", "SOLUTION/ESTIMATE")).collect()
    assert len(r) == 1 and r[0].site == "ALIC" and r[0].param == "STAX" and r[0].estimate == pytest.approx(-4052052.16852374) and r[0].epoch == datetime(2019, 7, 18, 12)


def test_written_files_come_back(spark, tmp_path):
    o = spark.createDataFrame([("G01", datetime(2019, 7, 18, 0, 15), 1.5e7, -2e7, 5e6, 1e-6), ("R02", datetime(2019, 7, 18), 1.5e7, None, 5e6, None)], "sat string, epoch timestamp, x double, y double, z double, clk double")
    W.write_lines(W.sp3_lines(o, F.lit("day")), str(tmp_path / "sp3"), 2)
    X.register(spark)
    back = {r.sat: r for r in spark.read.format("gnss").option("kind", "sp3").load(str(tmp_path / "sp3")).collect()}
    assert back["G01"].x == 1.5e7 and back["G01"].clk == pytest.approx(1e-6) and back["R02"].y is None and back["R02"].clk is None
    m = spark.createDataFrame([(datetime(2019, 7, 18), 87.5, -180.0 + 10 * k, 450.0, float(k)) for k in range(3)], "epoch timestamp, lat double, lon double, height double, value double")
    text = [r.value for r in W.ionex_lines(m, F.lit("x")).orderBy("seq").collect()]
    got = list(X.ionex(iter([head("START OF TEC MAP").rstrip(), head("EPOCH OF CURRENT MAP", "  2019     7    18     0     0     0").rstrip(), *text]), "f"))
    assert [g[4] for g in got] == [-180.0, -170.0, -160.0] and [g[6] for g in got] == pytest.approx([0.0, 1.0, 2.0])


def test_frames_and_messages(spark):
    cells = [(5, 2, 2.2e7 + 0.1234, 2.2e7 + 0.4321, -512.3456, 77, 45.5), (5, 10, 2.2e7 + 5.5, 2.2e7 + 4.25, -512.9, 3, 30.0), (31, 2, 2.5e7, 2.5e7 + 1, 100.0, 0, 50.0)]
    data = b"junk\xd3\x00" + B.encode_msm7("G", 12, 345_600_000, cells) + b"\xd3" + B.encode_station(9, 1.0, -2.0, 3.5, 0.1234) + B.encode_ssr_clock(100, 3, [(7, 0.1234, 1e-4, 0.0)]) + B.encode_msm7("G", 1, 0, cells)[:-1] + b"\x00"
    df = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(b""),)], "data binary")
    m = {(r.sat, r.code): r for r in B.msm_observations(df).collect()}
    assert len(m) == 3 and m["G05", "1C"].P == pytest.approx(cells[0][2], abs=1e-3) and m["G05", "2W"].L == pytest.approx(cells[1][3], abs=1e-3) and m["G05", "1C"].D == pytest.approx(-512.3456, abs=1e-4) and m["G31", "1C"].cnr == 50.0
    s = B.stations(df).first()
    assert (s.station, s.x, s.y, s.z) == (9, pytest.approx(1.0), pytest.approx(-2.0), pytest.approx(3.5)) and s.antenna_height == pytest.approx(0.1234)
    c = B.ssr_corrections(df).first()
    assert c.sat == "G07" and c.kind == "clock" and c.v0 == pytest.approx(0.1234) and c.iod == 3
    assert {r.number: r.frames for r in B.message_counts(df).collect()} == {1077: 1, 1006: 1, 1058: 1}


def test_ubx(spark):
    good = B.encode_rawx(345600.5, 2036, [(0, 5, 0, 2.2e7, 1.1e8, -500.5, 1000, 45), (6, 3, 2, 0.0, 1.0, 1.0, 0, 20)])
    bad = bytearray(good)
    bad[30] ^= 1
    rows = B.ubx_observations(spark.createDataFrame([(bytearray(b"\xb5" + good),), (bad,)], "data binary")).collect()
    assert [(r.sat, r.P, r.D, r.week) for r in rows] == [("G05", 2.2e7, -500.5, 2036), ("R03", None, 1.0, 2036)]


def test_checksum_and_columns(spark):
    assert B.crc24q_bytes(b"123456789") == 0xCDE703
    r = spark.range(1).select(
        I.fixed_number(F.lit("ab  1.5D+02 "), 2, 9).alias("n"), I.cospar_to_ilrs(F.lit("1992-053A")).alias("c"), I.radome_none(F.lit("TRM59800.00     SCIT")).alias("r"), I.ura_metres(F.lit(15)).alias("u"), I.bits_sign_magnitude(F.lit(0b1101), 60, 4).alias("b"),
        doy_range(F.lit("17-19")).alias("d"), period_seconds(F.lit(2.0), F.lit("Hours")).alias("p"), nearest_week(F.lit(1012), F.lit(2036)).alias("w"),
    ).first()
    assert (r.n, r.c, r.r, r.u, r.b, r.d, r.p, r.w) == (150.0, "9205301", "TRM59800.00     NONE", None, -5, [17, 18, 19], 7200.0, 2036)


def test_trace_lines_of_nulls_round_trip(spark):
    t = datetime(2019, 7, 18, 1, 2, 3)
    names = ["iter", "datetime", "meas", "sat", "recv", "sig", "prefit", "postfit", "sigma", "prefit_ratio", "postfit_ratio", "label"]
    rows = [
        (1, t, "CODE_MEAS", "G01", "ALIC", "L1C", 0.5, 0.25, 0.125, None, None, None),
        (2, t, "CODE_MEAS", "G01", "ALIC", "L1C", 0.5, 0.25, None, 1.5, 2.5, None),
        (3, t, "CODE_MEAS", None, "ALIC", None, None, None, None, None, 2.5, "KF-1"),
        (4, None, "CODE_MEAS", "G01", "ALIC", "L1C", 0.5, 0.25, 0.125, None, None, "KF-2"),
    ]
    kinds = ["int", "timestamp_ntz", *["string"] * 4, *["double"] * 5, "string"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    assert sorted(map(tuple, T.trace(W.trace_lines(df, F.lit("x"))).select(*names).collect())) == rows


def test_kind_is_told_by_the_head(spark, tmp_path):
    from orrery.sources import files

    files.register(spark)
    (tmp_path / "x.blq").write_text("$$ Ocean loading displacement\n$$\n  ALIC\n$$ a note\n" + "".join("  .001 .002 .003 .004 .005 .006 .007 .008 .009 .010 .011\n" for _ in range(6)))
    told = spark.read.format("gnss").option("kind", "blq").load(str(tmp_path)).collect()
    assert told and spark.read.format("gnss").load(str(tmp_path)).collect() == told
