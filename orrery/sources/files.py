"""Multi-line formats as a Python data source: spark.read.format("gnss").option("kind", ...).load(path).

A file is a partition; its reader streams lines and yields rows, so memory holds one record. Paths may be globs or URIs of any
file system pyarrow knows. Kinds: rinex_obs (versions 2, 3, 4), rinex_nav, sp3, antex, ionex, orbex, blq, crd.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import itertools
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _num(s: str) -> float | None:
    s = s.strip().replace("D", "E").replace("d", "e")
    if not s:
        return None
    try:
        return float(s)
    except ValueError:
        return None


def _nonzero(s: str) -> float | None:
    v = _num(s)
    return None if not v else v


def _time(y: int, mo: int, d: int, h: int, mi: int, s: float) -> dt.datetime:
    whole = int(s)
    return dt.datetime(y, mo, d, h, mi) + dt.timedelta(seconds=whole, microseconds=round((s - whole) * 1e6))


def _year(y: int) -> int:
    return y if y > 99 else y + (1900 if y > 50 else 2000)


def rinex_obs(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, marker, epoch, sat, code, value, lli, snr, flag), one row per observation; blanks and zeros are no observations."""
    version, marker, types, order, scale = 3.0, None, {}, [], {}
    system = None
    for line in lines:
        label = line[60:].strip()
        if label == "RINEX VERSION / TYPE":
            version = _num(line[:9]) or 3.0
            system = line[40:41].strip() or "G"
        elif label == "MARKER NAME":
            marker = line[:60].strip()
        elif label == "SYS / # / OBS TYPES":
            if line[0] != " ":
                order = types.setdefault(line[0], [])
            order += line[7:60].split()
        elif label == "# / TYPES OF OBSERV":
            types.setdefault("*", []).extend(line[6:60].split())
        elif label == "SYS / SCALE FACTOR" and line[0] != " ":
            f = _num(line[2:6]) or 1.0
            for c in line[10:58].split() or types.get(line[0], []):
                scale[line[0], c] = f
        elif label == "END OF HEADER":
            break
    if version >= 3:
        epoch, flag = None, 0
        for line in lines:
            if line.startswith(">"):
                flag = int(line[31:32].strip() or 0)
                epoch = _time(int(line[2:6]), int(line[7:9]), int(line[10:12]), int(line[13:15]), int(line[16:18]), float(line[18:29])) if line[2:6].strip() else None
                if flag > 1:
                    for _ in range(int(line[32:35].strip() or 0)):
                        next(lines, "")
                continue
            if epoch is None or len(line) < 3:
                continue
            sat = line[0] + line[1:3].replace(" ", "0")
            for i, code in enumerate(types.get(line[0], [])):
                cell = line[3 + 16 * i : 19 + 16 * i]
                v = _nonzero(cell[:14])
                if v is not None:
                    yield file, marker, epoch, sat, code, v / scale.get((line[0], code), 1.0), int(cell[14:15].strip() or 0), _num(cell[15:16]), flag
        return
    codes = types.get("*", [])
    per = -(-len(codes) // 5)
    for line in lines:
        if len(line) < 32 or not line[1:3].strip():
            continue
        flag, n = int(line[28:29].strip() or 0), int(line[29:32].strip() or 0)
        if flag > 1:
            for _ in range(n):
                next(lines, "")
            continue
        epoch = _time(_year(int(line[1:3])), int(line[4:6]), int(line[7:9]), int(line[10:12]), int(line[13:15]), float(line[15:26]))
        sats = [line[32 + 3 * k : 35 + 3 * k] for k in range(min(n, 12))]
        while len(sats) < n:
            more = next(lines, "")
            sats += [more[32 + 3 * k : 35 + 3 * k] for k in range(min(n - len(sats), 12))]
        for s in sats:
            sat = (s[0] if s[0] != " " else (system if system != "M" else "G")) + s[1:3].replace(" ", "0")
            text = "".join(next(lines, "").rstrip("\r\n").ljust(80)[:80] for _ in range(per))
            for i, code in enumerate(codes):
                cell = text[16 * i : 16 * i + 16]
                v = _nonzero(cell[:14])
                if v is not None:
                    yield file, marker, epoch, sat, code, v, int(cell[14:15].strip() or 0), _num(cell[15:16]), flag


def rinex_nav(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, sat, toc, f0, f1, f2, orbit array): broadcast ephemerides of version 3 and 4, the orbit lines' numbers in order."""
    rows = {"G": 7, "E": 7, "C": 7, "J": 7, "I": 7, "R": 3, "S": 3}
    for line in lines:
        if line[60:].strip() == "END OF HEADER":
            break
    for line in lines:
        if line.startswith("> EPH") or not line[:1].strip() or line[0] not in rows:
            continue
        sat = line[0] + line[1:3].replace(" ", "0")
        toc = _time(int(line[4:8]), int(line[9:11]), int(line[12:14]), int(line[15:17]), int(line[18:20]), float(line[21:23]))
        clock = [_num(line[23 + 19 * k : 42 + 19 * k]) for k in range(3)]
        orbit: list[float | None] = []
        for _ in range(rows[line[0]]):
            more = next(lines, "")
            orbit += [_num(more[4 + 19 * k : 23 + 19 * k]) for k in range(4)]
        yield file, sat, toc, *clock, orbit


def sp3(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, sat, epoch, x, y, z, clk, vx, vy, vz, predicted): metres, seconds, metres a second; zero positions and clocks of 999999.999999 are null."""
    epoch, row = None, None
    for line in lines:
        if line.startswith("*"):
            if row:
                yield tuple(row)
                row = None
            epoch = _time(int(line[3:7]), int(line[8:10]), int(line[11:13]), int(line[14:16]), int(line[17:19]), float(line[20:31]))
        elif line.startswith("P") and epoch:
            if row:
                yield tuple(row)
            pos = [_nonzero(line[4 + 14 * k : 18 + 14 * k]) for k in range(3)]
            clk = _num(line[46:60])
            row = [file, line[1] + line[2:4].replace(" ", "0"), epoch, *[None if v is None else v * 1000 for v in pos], None if clk is None or abs(clk) >= 999999.0 else clk * 1e-6, None, None, None, len(line) >= 80 and line[79:80] == "P"]
        elif line.startswith("V") and row:
            row[7:10] = [None if v is None else v * 0.1 for v in (_num(line[4 + 14 * k : 18 + 14 * k]) for k in range(3))]
    if row:
        yield tuple(row)


def antex(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, antenna, serial, valid_from, valid_until, frequency, north, east, up, zen1, zen2, dzen, azimuth, pcv array): metres; azimuth null is the independent pattern."""
    head: dict = {}
    freq, pco = None, (None, None, None)
    for line in lines:
        label = line[60:].strip()
        if label == "START OF ANTENNA":
            head, freq = {}, None
        elif label == "TYPE / SERIAL NO":
            head["type"], head["serial"] = line[:20].rstrip(), line[20:40].strip()
        elif label in ("VALID FROM", "VALID UNTIL"):
            p = line[:43].split()
            head[label] = _time(*map(int, p[:5]), float(p[5]))
        elif label == "ZEN1 / ZEN2 / DZEN":
            head["zen"] = [_num(x) for x in line[:20].split()]
        elif label == "START OF FREQUENCY":
            freq = line[3:6].strip()
        elif label == "END OF FREQUENCY":
            freq = None
        elif label == "NORTH / EAST / UP" and freq:
            pco = tuple((_num(x) or 0.0) / 1000 for x in line[:30].split())
        elif freq and head.get("zen"):
            p = line.split()
            az = None if p[:1] == ["NOAZI"] else _num(p[0])
            if p[:1] == ["NOAZI"] or az is not None:
                yield file, head.get("type"), head.get("serial"), head.get("VALID FROM"), head.get("VALID UNTIL"), freq, *pco, *head["zen"], az, [(_num(x) or 0.0) / 1000 for x in p[1:]]


def ionex(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, kind TEC or RMS, epoch, lat, lon, height, value in TECU); 9999 is no value."""
    exponent, kind, epoch = -1.0, None, None
    lat = lon1 = dlon = hgt = None
    vals: list[float] = []
    want = 0
    for line in lines:
        label = line[60:].strip()
        if label == "EXPONENT":
            exponent = _num(line[:6]) or -1.0
        elif label in ("START OF TEC MAP", "START OF RMS MAP"):
            kind = label[9:12]
        elif label.startswith("END OF") and label.endswith("MAP"):
            kind = None
        elif label == "EPOCH OF CURRENT MAP":
            p = [int(x) for x in line[:60].split()]
            epoch = _time(*p[:6])
        elif label == "LAT/LON1/LON2/DLON/H":
            lat, lon1, lon2, dlon, hgt = (_num(line[2 + 6 * k : 8 + 6 * k]) for k in range(5))
            want, vals = int(round((lon2 - lon1) / dlon)) + 1, []
        elif kind and want:
            vals += [float(x) for x in line.split()]
            if len(vals) >= want:
                for k, v in enumerate(vals[:want]):
                    yield file, kind, epoch, lat, lon1 + dlon * k, hgt, None if v == 9999 else v * 10**exponent
                want = 0


def orbex(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, sat, epoch, q0, q1, q2, q3): attitude quaternions."""
    epoch = None
    for line in lines:
        if line.startswith("##"):
            p = line[2:].split()
            epoch = _time(*map(int, p[:5]), float(p[5]))
        elif line.startswith(" ATT") and epoch:
            p = line.split()
            q = [float(x) for x in p[-4:]]
            yield file, p[1], epoch, *q


def blq(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, site, axis, constituent, amplitude, phase): ocean or atmosphere loading, eleven constituents."""
    waves = ("M2", "S2", "N2", "K2", "K1", "O1", "P1", "Q1", "MF", "MM", "SSA")
    site, rows = None, []
    for line in lines:
        if line.startswith("$$") or not line.strip():
            continue
        p = line.split()
        if all(_num(x) is not None for x in p) and len(p) == len(waves) and site:
            rows.append([float(x) for x in p])
            if len(rows) == 6:
                for a, axis in enumerate(("up", "west", "south")):
                    for k, w in enumerate(waves):
                        yield file, site, axis, w, rows[a][k], rows[a + 3][k]
                site, rows = None, []
        else:
            site, rows = line.strip().split()[0], []


def crd(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """(file, station, satellite, epoch, flight_s, window_s, n): normal points of laser ranging, versions 1 and 2."""
    station = sat = None
    day = prev = None
    for line in lines:
        p = line.split()
        if not p:
            continue
        k = p[0].upper()
        if k == "H2":
            station = p[1]
        elif k == "H3":
            sat = p[1]
        elif k == "H4":
            day, prev = dt.datetime(int(p[2]), int(p[3]), int(p[4])), None
        elif k == "11" and day:
            sod = float(p[1])
            if prev is not None and sod < prev - 43_200:
                day += dt.timedelta(days=1)
            prev = sod
            yield file, station, sat, day + dt.timedelta(microseconds=round(sod * 1e6)), float(p[2]), _num(p[5]), int(float(p[6])) if len(p) > 6 else None


KINDS: dict[str, tuple[Callable, str]] = {
    "rinex_obs": (rinex_obs, "file string, marker string, epoch timestamp, sat string, code string, value double, lli int, snr double, flag int"),
    "rinex_nav": (rinex_nav, "file string, sat string, toc timestamp, f0 double, f1 double, f2 double, orbit array<double>"),
    "sp3": (sp3, "file string, sat string, epoch timestamp, x double, y double, z double, clk double, vx double, vy double, vz double, predicted boolean"),
    "antex": (antex, "file string, antenna string, serial string, valid_from timestamp, valid_until timestamp, frequency string, north double, east double, up double, zen1 double, zen2 double, dzen double, azimuth double, pcv array<double>"),
    "ionex": (ionex, "file string, kind string, epoch timestamp, lat double, lon double, height double, value double"),
    "orbex": (orbex, "file string, sat string, epoch timestamp, q0 double, q1 double, q2 double, q3 double"),
    "blq": (blq, "file string, site string, axis string, constituent string, amplitude double, phase double"),
    "crd": (crd, "file string, station string, satellite string, epoch timestamp, flight_s double, window_s double, n int"),
}


def detect(lines: list[str]) -> str | None:
    """The kind of a file by its first lines."""
    head = lines[0] if lines else ""
    if head[60:].strip() == "RINEX VERSION / TYPE":
        return {"O": "rinex_obs", "N": "rinex_nav"}.get(head[20:21])
    if head[60:].strip() == "IONEX VERSION / TYPE":
        return "ionex"
    if head[60:].strip() == "ANTEX VERSION / SYST":
        return "antex"
    if head.startswith("%=ORBEX"):
        return "orbex"
    if head[:2] in ("#a", "#b", "#c", "#d"):
        return "sp3"
    if head[:2].upper() == "H1":
        return "crd"
    return "blq" if head.startswith("$$") else None


def _lines(path: str) -> Iterator[str]:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None) as raw:
        yield from (x.rstrip("\r\n") for x in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"))


def kind_of(path: str) -> str:
    """The kind of the first file of a path that tells one by its head; all files of one load are of one kind."""
    for f in _expand(path):
        kind = detect(list(itertools.islice(_lines(f), 1)))
        if kind in KINDS:
            return kind
    raise ValueError(f"no file under {path} tells its kind; give the option kind")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _expand(path: str) -> list[str]:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    base = inner if not any(c in inner for c in "*?[") else inner[: min(inner.index(c) for c in "*?[" if c in inner)].rpartition("/")[0]
    info = where.get_file_info(base)
    if info.type == fs.FileType.File:
        return [path]
    files = [f.path for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    pattern = inner if base != inner else inner.rstrip("/") + "/*"
    return sorted((scheme + f) if scheme and not scheme.startswith("file") else f for f in files if fnmatch.fnmatch(f, pattern) and not os.path.basename(f).startswith(("_", ".")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("kind") or kind_of(self.path)

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _expand(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from KINDS[self.kind][0](_lines(partition.path), partition.path)


class GnssSource(DataSource):
    """The data source; option ``kind`` names the format, ``path`` a file, folder or glob. Without a kind the files' heads tell it."""

    @classmethod
    def name(cls) -> str:
        return "gnss"

    def schema(self) -> str:
        return KINDS[self.options.get("kind") or kind_of(self.options["path"])][1]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GnssSource)

