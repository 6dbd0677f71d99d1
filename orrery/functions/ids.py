"""Identifiers, fixed-width cells, bits and index tables as column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# User range accuracy in metres by broadcast index.
URA_METRES = (2.4, 3.4, 4.85, 6.85, 9.65, 13.65, 24.0, 48.0, 96.0, 192.0, 384.0, 768.0, 1536.0, 3072.0, 6144.0)


def sat_system(sat: Column) -> Column:
    return F.substring(sat, 1, 1)


def sat_prn(sat: Column) -> Column:
    return F.substring(sat, 2, 9).try_cast("int")


def sat_id(system: Column, prn: Column) -> Column:
    return F.concat(system, F.lpad(prn.cast("string"), 2, "0"))


def fixed_number(text: Column, start: int, width: int) -> Column:
    """The number in a fixed-width cell (0-based start); a Fortran D exponent counts as E, blanks as null."""
    return F.regexp_replace(F.trim(F.substring(text, start + 1, width)), "[dD]", "E").try_cast("double")


def cospar_to_ilrs(cospar: Column) -> Column:
    """'1992-053A' to '9205301': year, launch number and the piece's letter as a number."""
    y, n, p = F.substring(cospar, 3, 2), F.substring(cospar, 6, 3), F.ascii(F.substring(cospar, 9, 1)) - 64
    return F.concat(y, n, F.lpad(p.cast("string"), 2, "0"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def radome_none(antenna: Column) -> Column:
    """An antenna's name with its radome (last four characters) replaced by NONE."""
    return F.overlay(F.rpad(antenna, 20, " "), F.lit("NONE"), 17, 4)


def replace_times(template: Column, ts: Column) -> Column:
    """A file name template's <YYYY>, <YY>, <MM>, <DD>, <DDD>, <HH>, <H>, <mm> filled from a time."""
    hour_letter = F.element_at(F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwx"]), F.hour(ts) + 1)
    out = template
    for name, v in (("<YYYY>", F.date_format(ts, "yyyy")), ("<YY>", F.date_format(ts, "yy")), ("<MM>", F.date_format(ts, "MM")), ("<DDD>", F.date_format(ts, "DDD")), ("<DD>", F.date_format(ts, "dd")), ("<HH>", F.date_format(ts, "HH")), ("<H>", hour_letter), ("<mm>", F.date_format(ts, "mm"))):
        out = F.replace(out, F.lit(name), v)
    return out


def bits_unsigned(word: Column, pos: int, n: int, total: int = 64) -> Column:
    """n bits from bit pos (0 the most significant of ``total``) of a long."""
    return F.shiftrightunsigned(word.cast("long"), total - pos - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def bits_signed(word: Column, pos: int, n: int, total: int = 64) -> Column:
    u = bits_unsigned(word, pos, n, total)
    return F.when(u >= (1 << (n - 1)), u - (1 << n)).otherwise(u)


def bits_sign_magnitude(word: Column, pos: int, n: int, total: int = 64) -> Column:
    u = bits_unsigned(word, pos, n, total)
    m = u.bitwiseAND(F.lit((1 << (n - 1)) - 1).cast("long"))
    return F.when(u >= (1 << (n - 1)), -m).otherwise(m)


def ura_metres(index: Column) -> Column:
    """Metres of a URA index; outside the table null."""
    return F.get(F.array(*[F.lit(x) for x in URA_METRES]), index.cast("int"))


@lru_cache(maxsize=1)
def _crc_steps() -> list[int]:
    """What each leading byte adds to CRC-24Q (polynomial 0x1864CFB)."""
    out = []
    for b in range(256):
        x = b << 16
        for _ in range(8):
            x = (x << 1) ^ (0x1864CFB if x & 0x800000 else 0)
        out.append(x & 0xFFFFFF)
    return out


def crc24q_bytes(data: bytes) -> int:
    """CRC-24Q (no reflection, zero start)."""
    steps, crc = _crc_steps(), 0
    for b in data:
        crc = ((crc << 8) & 0xFFFFFF) ^ steps[crc >> 16 ^ b]
    return crc


@F.pandas_udf(IntegerType())
def crc24q(data: pd.Series) -> pd.Series:
    """CRC-24Q of binary values, null for null."""
    return data.map(lambda b: None if b is None else crc24q_bytes(bytes(b))).astype("Int32")
