"""Display text, keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def fixed(value: Column, digits: int, half_even: bool = True) -> Column:
    """Number as text with a fixed number of decimals."""
    exact = value.cast("decimal(38,14)")
    rounded = F.bround(exact, digits) if half_even else F.round(exact, digits)
    return rounded.cast(f"decimal(38,{digits})").cast("string")


def _size_case(size: Column, units: list[str], render) -> Column:
    out = None
    for i, unit in enumerate(units):
        text = F.concat(render(size / F.lit(float(1024**i)), i), F.lit(" " + unit))
        last = i == len(units) - 1
        if out is None:
            out = F.when(size < 1024, text)
        elif last:
            out = out.when(size.isNotNull(), text)
        else:
            out = out.when(size < 1024 ** (i + 1), text)
    return out


def size_text(size: Column) -> Column:
    """Report form: whole bytes, otherwise two decimals; stays at TB beyond that."""
    return _size_case(
        size, SIZE_UNITS, lambda v, i: size.cast("string") if i == 0 else fixed(v, 2)
    )


def size_text_short(size: Column, units: int = 5) -> Column:
    """Dashboard form: one decimal, `-` for nothing or zero."""
    text = _size_case(
        size, SIZE_UNITS[:units], lambda v, i: size.cast("string") if i == 0 else fixed(v, 1, half_even=False)
    )
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("-")).otherwise(text)


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def duration_hms(seconds: Column) -> Column:
    """`1h 2m 3s`, all three parts always present."""
    s = F.floor(seconds).cast("bigint")
    return F.concat(_div(s, 3600), F.lit("h "), _div(s, 60) % 60, F.lit("m "), s % 60, F.lit("s"))


def duration_ms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.concat(_div(s, 60), F.lit("m "), s % 60, F.lit("s"))


def duration_clock(seconds: Column) -> Column:
    """`m:ss`, or `h:mm:ss` from one hour on."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = _div(s, 3600), _div(s, 60) % 60, s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h, F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(
        F.concat(m, F.lit(":"), two(r))
    )


def seconds_text(seconds: Column) -> Column:
    return F.concat(fixed(seconds, 2), F.lit(" seconds"))


def display_bool(value: Column) -> Column:
    return F.when(value.isNull(), "-").when(value, "Yes").otherwise("No")


def display_text(value: Column) -> Column:
    return F.when(value.isNull() | (value.cast("string") == ""), "-").otherwise(value.cast("string"))


def short_key(name: Column) -> Column:
    """Eight hex digits of a name, for display; join on the full name instead."""
    return F.substring(F.md5(name), 1, 8)


def run_id(package: Column, session: Column) -> Column:
    """Repeatable upload id, so that a re-run of the same work is recognised. 64 bits, since
    ids are joined on and must not collide over many runs."""
    return F.concat(F.lit("id"), F.substring(F.md5(F.concat_ws("|", package, session)), 1, 16))


def account_display_name(name: Column) -> Column:
    return F.when(name == "systemprofile", "SYSTEM").otherwise(name)


def null_safe_concat(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def upload_name(prefix: Column, host: Column, stamp: Column) -> Column:
    """`prefix/host-stamp.zip`, or `host-stamp.zip` without a prefix."""
    plain = F.concat(host, F.lit("-"), stamp, F.lit(".zip"))
    return F.when(
        F.coalesce(prefix, F.lit("")) != "", F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/"), plain)
    ).otherwise(plain)


def flow_export_name(host: Column, flow: Column, stamp: Column, per_flow_folder: bool = False) -> Column:
    name = F.concat(F.lit("Host "), host, F.lit(" "), flow, F.lit(" "), stamp, F.lit(".zip"))
    return F.concat(flow, F.lit("/"), name) if per_flow_folder else name
