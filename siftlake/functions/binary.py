"""Little-endian binary decoding with built-in expressions. Offsets are zero-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 100 ns ticks from 1601-01-01 to 1970-01-01, and the upper-word factor.
FILETIME_UNIX_TICKS = 116444736000000000
WORD = 4294967296

_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SHIFTED = _PLAIN[13:26] + _PLAIN[:13] + _PLAIN[39:] + _PLAIN[26:39]


def _offset(offset: Column | int) -> Column:
    return (F.lit(offset) if isinstance(offset, int) else offset.cast("int")) + F.lit(1)


def slice_bytes(blob: Column, offset: Column | int, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length.cast("int")
    return F.substring(blob, _offset(offset), length)


def _swapped(blob: Column, offset: Column | int, width: int) -> Column:
    """Hex digits of `width` bytes, last byte first; empty when the blob is too short."""
    groups = "(..)" * width
    back = "".join(f"${i}" for i in range(width, 0, -1))
    return F.regexp_replace(F.hex(slice_bytes(blob, offset, width)), f"^(?:{groups}|.*)$", back)


def uint_le(blob: Column, offset: Column | int, width: int) -> Column:
    """Unsigned integer of 1, 2 or 4 bytes as BIGINT; null when the blob is too short."""
    return F.conv(_swapped(blob, offset, width), 16, 10).cast("bigint")


def uint16(blob: Column, offset: Column | int = 0) -> Column:
    return uint_le(blob, offset, 2)


def uint32(blob: Column, offset: Column | int = 0) -> Column:
    return uint_le(blob, offset, 4)


def int64(blob: Column, offset: int = 0) -> Column:
    # a negative target base makes conv read the digits as two's complement
    return F.conv(_swapped(blob, offset, 8), 16, -10).cast("bigint")


def uint64(blob: Column, offset: int = 0) -> Column:
    """Unsigned 64-bit value as DECIMAL(20,0)."""
    return F.conv(_swapped(blob, offset, 8), 16, 10).cast("decimal(20,0)")


def filetime(ticks: Column) -> Column:
    """Windows file time (BIGINT, 100 ns since 1601) as a timestamp, rounded down to micros; null
    where the ticks are out of range."""
    shifted = F.try_subtract(ticks, F.lit(FILETIME_UNIX_TICKS))
    return F.timestamp_micros(F.call_function("div", shifted - F.pmod(shifted, F.lit(10)), F.lit(10)))


def filetime_words(high: Column, low: Column) -> Column:
    """File time from two 32-bit words; null when the high word is missing or zero."""
    return F.when(F.coalesce(high, F.lit(0)) != 0, filetime(F.try_add(F.try_multiply(high, F.lit(WORD)), low)))


def flag_names(flags: Column, names: list[str]) -> Column:
    """Names of the set bits, lowest bit first."""
    picked = F.array(*[F.when(F.getbit(flags, F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names)])
    return F.array_compact(picked)


def choice(value: Column, choices: dict[int, str]) -> Column:
    """Name of an enumerated value; an unknown value keeps its number."""
    out = value.cast("string")
    for number, name in choices.items():
        out = F.when(value == number, F.lit(name)).otherwise(out)
    return out


def _decoded(blob: Column) -> Column:
    """UTF-16LE text; null for an odd length or a surrogate without its other half. In the hex
    digits of a unit the third and fourth are those of its high byte."""
    digits = F.hex(blob)
    # Without a byte from D8 to DF there is no surrogate; only texts that may have one are looked at unit by unit.
    broken = digits.rlike("D[89A-F]") & (digits.rlike("^(?:....)*?..D[89AB](?!..D[C-F])") | digits.rlike("^(?:(?:....)*?..(?:[0-9A-CEF].|D[0-7C-F]))?..D[C-F]"))
    return F.when((F.length(blob) % 2 == 0) & ~broken, F.decode(blob, "UTF-16LE"))


def utf16(blob: Column, offset: Column | int, length: Column | int) -> Column:
    return _decoded(slice_bytes(blob, offset, length))


def utf16_cstring(blob: Column) -> Column:
    """UTF-16 text from the start of the blob up to the first NUL; what follows may be anything."""
    digits = F.hex(blob)
    # Four zero digits may begin inside a unit; then the unit after that is the first that can be NUL.
    zeros = F.instr(digits, "0000")
    unit = (F.ceil((zeros - 1) / 4) * 4).cast("int")
    before = F.length(F.regexp_extract(digits, "^((?:....)*?)0000", 1))
    end = F.when(zeros == 0, F.lit(-1)).when(F.substring(digits, unit + 1, F.lit(4)) == "0000", unit).when(
        F.regexp_instr(digits, F.lit("^(?:....)*?0000")) > 0, before).otherwise(F.lit(-1))
    return _decoded(F.when(end >= 0, F.substring(blob, F.lit(1), (end / 2).cast("int"))).otherwise(blob))


def uint32_list(blob: Column, drop: int | None = None) -> Column:
    """Array of the 32-bit values of a blob, optionally without one marker value."""
    count = F.floor(F.length(blob) / 4).cast("int")
    offsets = F.when(count > 0, F.sequence(F.lit(0), (count - 1) * 4, F.lit(4))).otherwise(
        F.array().cast("array<int>")
    )
    values = F.transform(offsets, lambda o: uint32(blob, o))
    return values if drop is None else F.filter(values, lambda v: v != drop)


def hex_text(blob: Column) -> Column:
    return F.lower(F.hex(blob))


def rot13(text: Column) -> Column:
    return F.translate(text, _PLAIN, _SHIFTED)


# Encoders: the inverse expressions, used to build evidence for tests and stand-in views.


def pack_le(value: Column, width: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    back = "".join(f"${i}" for i in range(width, 0, -1))
    return F.unhex(F.regexp_replace(digits, "(..)" * width, back))


def pack_utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def filetime_ticks(ts: Column) -> Column:
    return F.unix_micros(ts) * 10 + FILETIME_UNIX_TICKS
