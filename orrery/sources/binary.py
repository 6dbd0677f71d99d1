"""Binary streams: RTCM 3 and UBX frames out of raw bytes, and the messages in them, as rows.

Raw bytes come as rows (stream, seq, data), for instance from files read with format binaryFile or a landed socket. Frames are found within a row;
a reader that lands a socket cuts its rows at frame boundaries. Decoders map rows, so they run without a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.ids import crc24q_bytes

CLIGHT = 299792458.0
MS = CLIGHT / 1000

# Constellation by the tens of an MSM number, and signal codes by mask position.
MSM_SYSTEM = {107: "G", 108: "R", 109: "E", 110: "S", 111: "J", 112: "C"}
MSM_SIGNALS = {
    "G": {2: "1C", 3: "1P", 4: "1W", 8: "2C", 9: "2P", 10: "2W", 15: "2S", 16: "2L", 17: "2X", 22: "5I", 23: "5Q", 24: "5X", 30: "1S", 31: "1L", 32: "1X"},
    "R": {2: "1C", 3: "1P", 8: "2C", 9: "2P"},
    "E": {2: "1C", 3: "1A", 4: "1B", 5: "1X", 6: "1Z", 8: "6C", 9: "6A", 10: "6B", 11: "6X", 12: "6Z", 14: "7I", 15: "7Q", 16: "7X", 18: "8I", 19: "8Q", 20: "8X", 22: "5I", 23: "5Q", 24: "5X"},
    "S": {2: "1C", 22: "5I", 23: "5Q", 24: "5X"},
    "J": {2: "1C", 9: "6S", 10: "6L", 11: "6X", 15: "2S", 16: "2L", 17: "2X", 22: "5I", 23: "5Q", 24: "5X", 30: "1S", 31: "1L", 32: "1X"},
    "C": {2: "2I", 3: "2Q", 4: "2X", 8: "6I", 9: "6Q", 10: "6X", 14: "7I", 15: "7Q", 16: "7X", 22: "5D", 23: "5P", 24: "5X"},
}
UBX_SYSTEM = {0: "G", 1: "S", 2: "E", 3: "C", 5: "J", 6: "R"}


class Bits:
    """Big-endian bits of a message."""

    def __init__(self, data: bytes):
        self.word, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise EOFError("message too short")
        return (self.word >> (self.size - self.at)) & ((1 << n) - 1)

    def s(self, n: int) -> int:
        v = self.u(n)
        return v - (1 << n) if v >> (n - 1) else v


class Put:
    """Bits being written, for encoders."""

    def __init__(self) -> None:
        self.word, self.size = 0, 0

    def u(self, v: int, n: int) -> Put:
        self.word, self.size = (self.word << n) | (v & ((1 << n) - 1)), self.size + n
        return self

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.word << pad).to_bytes((self.size + pad) // 8, "big")


def rtcm_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(message number, payload) of each intact frame; bytes outside frames and frames with a bad check sum are passed over."""
    i = 0
    while True:
        i = data.find(b"\xd3", i)
        if i < 0 or i + 6 > len(data):
            return
        n = ((data[i + 1] & 3) << 8) | data[i + 2]
        end = i + 3 + n + 3
        if data[i + 1] & 0xFC or end > len(data) or crc24q_bytes(data[i : end - 3]) != int.from_bytes(data[end - 3 : end], "big"):
            i += 1
            continue
        body = data[i + 3 : end - 3]
        yield (int.from_bytes(body[:2], "big") >> 4 if n >= 2 else 0), body
        i = end


def rtcm_frame(body: bytes) -> bytes:
    head = b"\xd3" + len(body).to_bytes(2, "big") + body
    return head + crc24q_bytes(head).to_bytes(3, "big")


def decode_msm(body: bytes) -> Iterator[tuple]:
    """(number, station, epoch_ms, sat, code, P, L_cycles_m, D, lock, half, cnr): metres, metres a second, dB-Hz; invalid cells are null. MSM 4 to 7."""
    b = Bits(body)
    number = b.u(12)
    kind, system = number % 10, MSM_SYSTEM.get(number // 10)
    if system is None or kind not in (4, 5, 6, 7):
        return
    station, epoch = b.u(12), b.u(30)
    if system == "R":
        epoch &= (1 << 27) - 1
    b.u(1 + 3 + 7 + 2 + 2 + 1 + 3)
    sats = [k + 1 for k, m in enumerate(f"{b.u(64):064b}") if m == "1"]
    sigs = [k + 1 for k, m in enumerate(f"{b.u(32):032b}") if m == "1"]
    cells = [(s, g) for s in sats for g in sigs if b.u(1)]
    whole = [b.u(8) for _ in sats]
    if kind in (5, 7):
        for _ in sats:
            b.u(4)
    frac = [b.u(10) for _ in sats]
    rate = [b.s(14) for _ in sats] if kind in (5, 7) else [None] * len(sats)
    rough = {s: None if w == 255 else w + f / 1024 for s, w, f in zip(sats, whole, frac, strict=True)}
    rates = dict(zip(sats, rate, strict=True))
    n = len(cells)
    wide = kind >= 6
    pr = [b.s(20 if wide else 15) for _ in range(n)]
    cp = [b.s(24 if wide else 22) for _ in range(n)]
    lock = [b.u(10 if wide else 4) for _ in range(n)]
    half = [b.u(1) for _ in range(n)]
    cnr = [b.u(10 if wide else 6) for _ in range(n)]
    dop = [b.s(15) for _ in range(n)] if kind in (5, 7) else [None] * n
    codes = MSM_SIGNALS[system]
    for k, (s, g) in enumerate(cells):
        r = rough[s]
        p = None if r is None or pr[k] == -(1 << (19 if wide else 14)) else (r + pr[k] * 2.0 ** (-29 if wide else -24)) * MS
        ph = None if r is None or cp[k] == -(1 << (23 if wide else 21)) else (r + cp[k] * 2.0 ** (-31 if wide else -29)) * MS
        d = None if dop[k] is None or dop[k] == -(1 << 14) or rates[s] == -(1 << 13) else rates[s] + dop[k] * 1e-4
        yield number, station, epoch, f"{system}{s:02d}", codes.get(g, str(g)), p, ph, d, lock[k], half[k], cnr[k] * (2.0**-4 if wide else 1.0)


def encode_msm7(system: str, station: int, epoch_ms: int, cells: Sequence[tuple[int, int, float, float, float, int, float]]) -> bytes:
    """A frame of (prn, signal position, P, L in metres, rate, lock, cnr) cells."""
    base = {v: k for k, v in MSM_SYSTEM.items()}[system]
    sats, sigs = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    by = {(c[0], c[1]): c for c in cells}
    p = Put().u(base * 10 + 7, 12).u(station, 12).u(epoch_ms, 30).u(0, 1 + 3 + 7 + 2 + 2 + 1 + 3)
    p.u(sum(1 << (64 - s) for s in sats), 64).u(sum(1 << (32 - g) for g in sigs), 32)
    for s in sats:
        for g in sigs:
            p.u((s, g) in by, 1)
    first = {s: next(c for c in cells if c[0] == s) for s in sats}
    rough = {s: round(first[s][2] / MS * 1024) for s in sats}
    rates = {s: round(first[s][4]) for s in sats}
    for s in sats:
        p.u(rough[s] // 1024, 8)
    for _ in sats:
        p.u(0, 4)
    for s in sats:
        p.u(rough[s] % 1024, 10)
    for s in sats:
        p.u(rates[s], 14)
    order = [by[s, g] for s in sats for g in sigs if (s, g) in by]
    for c in order:
        p.u(round((c[2] / MS - rough[c[0]] / 1024) * 2**29), 20)
    for c in order:
        p.u(round((c[3] / MS - rough[c[0]] / 1024) * 2**31), 24)
    for c in order:
        p.u(c[5], 10)
    for _ in order:
        p.u(0, 1)
    for c in order:
        p.u(round(c[6] * 16), 10)
    for c in order:
        p.u(round((c[4] - rates[c[0]]) * 1e4), 15)
    return rtcm_frame(p.bytes())


def decode_station(body: bytes) -> tuple | None:
    """(station, x, y, z, antenna_height) of messages 1005 and 1006, metres."""
    b = Bits(body)
    number, station = b.u(12), b.u(12)
    if number not in (1005, 1006):
        return None
    b.u(6 + 4)
    x = b.s(38) * 1e-4
    b.u(2)
    y = b.s(38) * 1e-4
    b.u(2)
    z = b.s(38) * 1e-4
    return station, x, y, z, b.u(16) * 1e-4 if number == 1006 else None


def encode_station(station: int, x: float, y: float, z: float, height: float | None = None) -> bytes:
    p = Put().u(1005 if height is None else 1006, 12).u(station, 12).u(0, 10).u(round(x * 1e4), 38).u(0, 2).u(round(y * 1e4), 38).u(0, 2).u(round(z * 1e4), 38)
    return rtcm_frame((p if height is None else p.u(round(height * 1e4), 16)).bytes())


def decode_ssr(body: bytes) -> Iterator[tuple]:
    """(number, epoch_s, udi, iod, sat, kind, code, v0, v1, v2, d0, d1, d2, iode) of GPS orbit 1057, clock 1058, code bias 1059 and combined 1060, metres and seconds."""
    udis = (1, 2, 5, 10, 15, 30, 60, 120, 240, 300, 600, 900, 1800, 3600, 7200, 10800)
    b = Bits(body)
    number = b.u(12)
    if number not in (1057, 1058, 1059, 1060):
        return
    epoch, udi = b.u(20), udis[b.u(4)]
    b.u(1)
    if number in (1057, 1060):
        b.u(1)
    iod = b.u(4)
    b.u(16 + 4)
    for _ in range(b.u(6)):
        sat = f"G{b.u(6):02d}"
        if number in (1057, 1060):
            iode = b.u(8)
            pos = (b.s(22) * 1e-4, b.s(20) * 4e-4, b.s(20) * 4e-4)
            vel = (b.s(21) * 1e-6, b.s(19) * 4e-6, b.s(19) * 4e-6)
            yield number, epoch, udi, iod, sat, "orbit", None, *pos, *vel, iode
        if number in (1058, 1060):
            yield number, epoch, udi, iod, sat, "clock", None, b.s(22) * 1e-4, b.s(21) * 1e-6, b.s(27) * 2e-8, None, None, None, None
        if number == 1059:
            for _ in range(b.u(5)):
                mode = b.u(5)
                yield number, epoch, udi, iod, sat, "bias", mode, b.s(14) * 0.01, None, None, None, None, None, None


def encode_ssr_clock(epoch: int, iod: int, rows: Sequence[tuple[int, float, float, float]]) -> bytes:
    p = Put().u(1058, 12).u(epoch, 20).u(2, 4).u(0, 1).u(iod, 4).u(0, 20).u(len(rows), 6)
    for prn, c0, c1, c2 in rows:
        p.u(prn, 6).u(round(c0 * 1e4), 22).u(round(c1 * 1e6), 21).u(round(c2 / 2e-8), 27)
    return rtcm_frame(p.bytes())


def decode_gps_ephemeris(body: bytes) -> dict | None:
    """Message 1019 in SI units (angles in radians)."""
    b = Bits(body)
    if b.u(12) != 1019:
        return None
    pi = 3.1415926535898
    out: dict = {"sat": f"G{b.u(6):02d}", "week": b.u(10), "ura": b.u(4), "code": b.u(2)}
    out["idot"] = b.s(14) * 2.0**-43 * pi
    out["iode"], out["toc"] = b.u(8), b.u(16) * 16
    out["f2"], out["f1"], out["f0"] = b.s(8) * 2.0**-55, b.s(16) * 2.0**-43, b.s(22) * 2.0**-31
    out["iodc"] = b.u(10)
    for name, n, scale, signed in (
        ("crs", 16, 2.0**-5, 1), ("deln", 16, 2.0**-43 * pi, 1), ("M0", 32, 2.0**-31 * pi, 1), ("cuc", 16, 2.0**-29, 1), ("e", 32, 2.0**-33, 0), ("cus", 16, 2.0**-29, 1), ("sqrtA", 32, 2.0**-19, 0),
        ("toe", 16, 16, 0), ("cic", 16, 2.0**-29, 1), ("OMG0", 32, 2.0**-31 * pi, 1), ("cis", 16, 2.0**-29, 1), ("i0", 32, 2.0**-31 * pi, 1), ("crc", 16, 2.0**-5, 1), ("omg", 32, 2.0**-31 * pi, 1), ("OMGd", 24, 2.0**-43 * pi, 1),
    ):
        out[name] = (b.s(n) if signed else b.u(n)) * scale
    out["tgd"], out["svh"] = b.s(8) * 2.0**-31, b.u(6)
    return out


def ubx_frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(class, id, payload) of intact UBX frames."""
    i = 0
    while True:
        i = data.find(b"\xb5\x62", i)
        if i < 0 or i + 8 > len(data):
            return
        n = int.from_bytes(data[i + 4 : i + 6], "little")
        end = i + 6 + n
        if end + 2 > len(data):
            return
        a = c = 0
        for x in data[i + 2 : end]:
            a = (a + x) & 255
            c = (c + a) & 255
        if (a, c) != (data[end], data[end + 1]):
            i += 2
            continue
        yield data[i + 2], data[i + 3], data[i + 6 : end]
        i = end + 2


def decode_rawx(payload: bytes) -> Iterator[tuple]:
    """(tow, week, sat, signal, P, L_cycles, D_hz, cnr, lock_ms) of a UBX raw measurement message."""
    tow, week, _, n = struct.unpack_from("<dHbB", payload, 0)
    for k in range(n):
        pr, cp, do, gnss, sv, sig, _, lock, cno = struct.unpack_from("<ddfBBBBHB", payload, 16 + 32 * k)
        if gnss in UBX_SYSTEM:
            yield tow, week, f"{UBX_SYSTEM[gnss]}{sv:02d}", sig, pr or None, cp or None, float(do), float(cno), lock


def encode_rawx(tow: float, week: int, rows: Sequence[tuple[int, int, int, float, float, float, int, int]]) -> bytes:
    p = struct.pack("<dHbBBBH", tow, week, 18, len(rows), 0, 1, 0)
    for gnss, sv, sig, pr, cp, do, lock, cno in rows:
        p += struct.pack("<ddfBBBBHBBBBBB", pr, cp, do, gnss, sv, sig, 0, lock, cno, 0, 0, 0, 0, 0)
    head = b"\x02\x15" + len(p).to_bytes(2, "little") + p
    a = c = 0
    for x in head:
        a = (a + x) & 255
        c = (c + a) & 255
    return b"\xb5\x62" + head + bytes((a, c))


def _mapped(df: DataFrame, data: str, decode, names: list[str], ddl: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [r for d in pdf[data] if d is not None for r in decode(bytes(d))]
            yield pd.DataFrame(rows, columns=names)

    return df.select(data).mapInPandas(run, schema=ddl)


def msm_observations(df: DataFrame, data: str = "data") -> DataFrame:
    """All MSM cells of raw byte rows."""
    ddl = "number int, station int, epoch_ms bigint, sat string, code string, P double, L double, D double, lock int, half int, cnr double"
    return _mapped(df, data, lambda d: (r for _, body in rtcm_frames(d) for r in decode_msm(body)), [c.split()[0] for c in ddl.split(", ")], ddl)


def stations(df: DataFrame, data: str = "data") -> DataFrame:
    ddl = "station int, x double, y double, z double, antenna_height double"
    return _mapped(df, data, lambda d: (r for _, body in rtcm_frames(d) if (r := decode_station(body)) is not None), [c.split()[0] for c in ddl.split(", ")], ddl)


def ssr_corrections(df: DataFrame, data: str = "data") -> DataFrame:
    ddl = "number int, epoch_s int, udi int, iod int, sat string, kind string, code int, v0 double, v1 double, v2 double, d0 double, d1 double, d2 double, iode int"
    return _mapped(df, data, lambda d: (r for _, body in rtcm_frames(d) for r in decode_ssr(body)), [c.split()[0] for c in ddl.split(", ")], ddl)


def ubx_observations(df: DataFrame, data: str = "data") -> DataFrame:
    ddl = "tow double, week int, sat string, signal int, P double, L double, D double, cnr double, lock_ms int"
    return _mapped(df, data, lambda d: (r for c, i, p in ubx_frames(d) if (c, i) == (2, 0x15) for r in decode_rawx(p)), [c.split()[0] for c in ddl.split(", ")], ddl)


def message_counts(df: DataFrame, data: str = "data") -> DataFrame:
    """(number, frames, bytes) over raw rows."""
    one = _mapped(df, data, lambda d: ((n, len(b)) for n, b in rtcm_frames(d)), ["number", "size"], "number int, size bigint")
    return one.groupBy("number").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))
