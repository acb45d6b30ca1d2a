"""Formatting functions: sizes, shares, dates, times, names and nested values as text.  All are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def _fixed(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many decimals, half up, in whole numbers: any long, as only what is left over of unit is multiplied."""
    power, wide = 10**digits, lambda x: F.lit(x).cast("long")
    halves = (n % unit) * (2 * power) + unit
    scaled = F.call_function("div", n, wide(unit)) * power + F.call_function("div", halves, wide(2 * unit))
    if not digits:
        return scaled.cast("string")
    return F.concat(F.call_function("div", scaled, wide(power)).cast("string"), F.lit("."), F.lpad((scaled % power).cast("string"), digits, "0"))


def format_bytes(n: Column) -> Column:
    n = n.cast("long")
    kb = F.when(n < 10 * KB, _fixed(n, KB, 1)).otherwise(_fixed(n, KB, 0))
    mb = F.when(n < 100 * MB, _fixed(n, MB, 1)).otherwise(_fixed(n, MB, 0))
    return F.when(n < KB, F.concat(n.cast("string"), F.lit(" B"))).when(n < MB, F.concat(kb, F.lit(" KB"))).when(n < GB, F.concat(mb, F.lit(" MB"))).otherwise(F.concat(_fixed(n, GB, 2), F.lit(" GB")))


def format_number(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def percent(part: Column, whole: Column) -> Column:
    """Two decimals under 0.1%, else one; <0.01% for what would round to nothing; 0.0% of nothing."""
    part, whole = part.cast("decimal(25,0)"), whole.cast("decimal(25,0)")  # room for the factors below
    exact = lambda digits: F.floor((part * (200 * 10**digits) + whole) / (whole * 2)).cast("decimal(25,0)")
    shown = lambda digits: F.concat(F.floor(exact(digits) / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((exact(digits) % 10**digits).cast("string"), digits, "0"), F.lit("%"))
    tiny, small = part * 10_000 < whole, part * 1000 < whole
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "0.0%").when((part > 0) & tiny, "<0.01%").when(small, shown(2)).otherwise(shown(1))


def row_range(first: Column, n: Column) -> Column:
    return F.concat(format_number(first), F.lit(" – "), format_number(first + n - 1))


def plural(n: Column, what: str) -> Column:
    return F.concat(format_number(n), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def quote_literal(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_name(x: Column) -> Column:
    """An identifier, quoted unless it is a plain lower-case one."""
    return F.when(x.rlike("^[a-z_][a-z0-9_]*$"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))


def date_text(days: Column) -> Column:
    """Days from 1970 as a date; the two infinities; years before 1 as BC, by whole-number civil calendar."""
    whole = lambda x, by: F.floor(x / F.lit(by)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def of_year(era: Column, doe: Column, yoe: Column) -> Column:
        doy = doe - (365 * yoe + whole(yoe, 4) - whole(yoe, 100))
        return let(doy, lambda d: let(whole(5 * d + 2, 153), lambda mp: shown(era, yoe, d, mp)))

    def shown(era: Column, yoe: Column, doy: Column, mp: Column) -> Column:
        month = F.when(mp < 10, mp + 3).otherwise(mp - 9)
        year = yoe + era * 400 + F.when(mp >= 10, 1).otherwise(0)
        return let(year, lambda y: spelt(y, month, doy - whole(153 * mp + 2, 5) + 1))

    def spelt(year: Column, month: Column, day: Column) -> Column:
        number = F.when(year > 0, year).otherwise(1 - year).cast("string")
        padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
        return F.concat(padded, F.lit("-"), two(month), F.lit("-"), two(day), F.when(year > 0, "").otherwise(" (BC)"))

    def of_era(z: Column, era: Column) -> Column:
        doe = z - era * 146_097
        return let(doe, lambda d: let(whole(d - whole(d, 1460) + whole(d, 36_524) - whole(d, 146_096), 365), lambda yoe: of_year(era, d, yoe)))

    out = let(days.cast("long") + 719_468, lambda z: let(whole(z, 146_097), lambda era: of_era(z, era)))
    return F.when(days == 2_147_483_647, "infinity").when(days == -2_147_483_647, "-infinity").otherwise(out)


def time_text(ticks: Column, digits: int) -> Column:
    """HH:MM:SS and the fraction without its trailing zeros, of ticks of 10 ** -digits seconds."""
    per = 10**digits
    s = F.floor(ticks / F.lit(per)).cast("long")
    two = lambda x: F.lpad(F.floor(x).cast("long").cast("string"), 2, "0")
    rest = F.rtrim(F.lpad(F.pmod(ticks, F.lit(per)).cast("string"), digits, "0"), F.lit("0")) if digits else F.lit("")
    return F.concat(two(s / F.lit(3600)), F.lit(":"), two((s / F.lit(60)) % 60), F.lit(":"), two(s % 60), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))


def timestamp_text(ticks: Column, digits: int, zone: str = "") -> Column:
    per = 86_400 * 10**digits
    end = (1 << 63) - 1
    day = F.floor(ticks / F.lit(per)).cast("long")
    out = F.concat(date_text(day), F.lit(" "), time_text(F.pmod(ticks, F.lit(per)), digits), F.lit(zone))
    return F.when(ticks == end, "infinity").when(ticks == -end, "-infinity").otherwise(out)


def decimal_text(unscaled: Column, scale: int) -> Column:
    if not scale:
        return unscaled.cast("string")
    power = 10**scale
    size = F.abs(unscaled)
    return F.concat(F.when(unscaled < 0, "-").otherwise(""), F.floor(size / F.lit(power)).cast("string"), F.lit("."), F.lpad((size % power).cast("string"), scale, "0"))


def interval_text(months: Column, days: Column, micros: Column) -> Column:
    """Years, months and days with plurals, and the time unless it is zero and not alone; years truncate toward zero."""
    part = lambda n, what: F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {what}"), F.when(F.abs(n) == 1, "").otherwise("s")))
    years = F.when(months < 0, -F.floor(-months / F.lit(12))).otherwise(F.floor(months / F.lit(12))).cast("long")
    time = F.concat(F.when(micros < 0, "-").otherwise(""), time_text(F.abs(micros), 6))
    alone = (months == 0) & (days == 0)
    return F.concat_ws(" ", part(years, "year"), part(months - years * 12, "month"), part(days, "day"), F.when((micros != 0) | alone, time))


def uuid_text(hex32: Column) -> Column:
    """A 128-bit number as 32 hex digits, its top bit flipped, in the usual groups."""
    top = F.lower(F.hex((F.conv(F.substring(hex32, 1, 1), 16, 10).cast("int")).bitwiseXOR(F.lit(8))))
    flipped = F.concat(top, F.lower(F.substring(hex32, 2, 31)))
    return F.concat_ws("-", *(F.substring(flipped, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def blob_text(data: Column) -> Column:
    """Printable ASCII but the backslash as it is, any other byte as \\xHH."""
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.hex(F.substring(data, i, F.lit(1))))
    shown = lambda h: F.when((h >= "20") & (h <= "7E") & (h != "5C"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), h))
    return F.when(F.octet_length(data) > 0, F.array_join(F.transform(pairs, shown), "")).otherwise(F.when(data.isNotNull(), ""))


def hex_lines(data: Column, limit: int = 512) -> Column:
    """array<struct<offset, hex, text>>: 16 bytes a line of the first limit; a dot for what doesn't print."""

    def line(head: Column, at: Column) -> Column:
        part = F.substring(head, at + 1, F.lit(16))
        pairs = F.rtrim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", "·")
        return F.struct(F.lower(F.lpad(F.hex(at.cast("long")), 8, "0")).alias("offset"), pairs.alias("hex"), shown.alias("text"))

    def lines(head: Column) -> Column:  # the head is cut once a row, and only the head is read for its lines
        return F.transform(F.sequence(F.lit(0), F.octet_length(head) - 1, F.lit(16)), lambda at: line(head, at))

    none = F.array().cast("array<struct<offset:string,hex:string,text:string>>")
    return let(F.substring(data, F.lit(1), F.lit(limit)), lambda head: F.when(F.octet_length(head) > 0, lines(head)).otherwise(none))


#: Fixed values of the output format: characters of joined names, names listed.
JOINED, LISTED = 32, 8


def summarize_names(names: Column, n: Column | None = None) -> Column:
    """Up to two short names as they are, else the first and how many more; n, if names are only the first of them."""
    joined, n = F.array_join(names, ", "), F.size(names) if n is None else n
    return F.when((n <= 2) & (F.length(joined) <= JOINED), joined).otherwise(F.concat(F.get(names, 0), F.lit(" +"), (n - 1).cast("string")))


def list_names(names: Column, n: Column | None = None) -> Column:
    """The first names, and how many more there are; n, if names are only the first of them."""
    rest = (F.size(names) if n is None else n) - LISTED
    return F.concat(F.array_join(F.slice(names, 1, LISTED), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))


def name_parts(name: Column, longest: int = 32, tail: int = 26) -> Column:
    """struct<head, tail>: a long name's last characters apart, so that they stay visible."""
    cut = F.length(name) > longest
    return F.struct(F.when(cut, F.substring(name, F.lit(1), F.length(name) - tail)).otherwise(name).alias("head"), F.when(cut, F.right(name, F.lit(tail))).otherwise("").alias("tail"))


def _digits(value: Column, n: int) -> Column:
    """A number with n significant digits, without trailing zeros; with an exponent under 1e-6 and from 1e21 on."""

    def shown(e: Column) -> Column:
        mantissa, power = F.regexp_extract(e, "^(.*)e", 1), F.regexp_extract(e, "e(.*)$", 1).try_cast("int")
        clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        plain = clean(e.try_cast("decimal(38,16)").cast("string"))
        return F.when((power >= -6) & (power < 21), plain).otherwise(F.concat(clean(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string")))

    return let(F.format_string(f"%.{n - 1}e", value), shown)


#: Fixed value of the output format: characters of a text shown.
SHOWN = 60


def format_value(value: Column, kind: Column) -> Column:
    """A value given as text, for display by its kind: null as a dash, whole numbers grouped, floats with six digits, times
    without empty seconds, text quoted and cut, the rest as it is."""
    cut = F.when(F.length(value) > SHOWN, F.concat(F.substring(value, 1, SHOWN), F.lit("…"))).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(cut, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    grouped = F.when(value.rlike("^-?0+$"), "0").otherwise(F.format_number(value.try_cast("decimal(38,0)"), 0))
    number = value.try_cast("double")
    real = F.when(number == 0, "0").when(number == F.rint(number), F.format_number(value.try_cast("decimal(38,0)"), 0)).otherwise(_digits(number, 6))
    time = F.regexp_replace(value, r"(:00)?\.000$", "")
    return F.when(value.isNull(), "–").when(kind == "integer", grouped).when(kind == "float", F.coalesce(real, value)).when(kind == "time", time).when(kind == "text", quoted).otherwise(value)


#: Fixed value of the format: the offset that a time with zone counts down from, in seconds.
MAX_OFFSET = 16 * 3600 - 1


def time_tz_text(bits: Column) -> Column:
    """A time with zone: microseconds above 24 bits of an offset; minutes of the offset where it has any."""
    offset = F.lit(MAX_OFFSET).cast("long") - bits.bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    two = lambda x: F.lpad(F.floor(x).cast("long").cast("string"), 2, "0")
    size = F.abs(offset)
    minutes = F.when(size % 3600 != 0, F.concat(F.lit(":"), two((size / F.lit(60)) % 60))).otherwise("")
    return F.concat(time_text(F.shiftright(bits, 24), 6), F.when(offset < 0, "-").otherwise("+"), two(size / F.lit(3600)), minutes)


#: Type names by what their values are shown and compared as.
NUMERIC = "^(U?(TINY|SMALL|BIG|HUGE)INT|U?INTEGER|FLOAT|DOUBLE|DECIMAL.*)$"
TEMPORAL = "^(DATE|TIMESTAMP.*)$"
TEXT = "^(VARCHAR|UUID|ENUM.*)$"


def value_kind(type_: Column) -> Column:
    """How format_value shows a type's values."""
    return F.when(type_.rlike("^(FLOAT|DOUBLE|DECIMAL.*)$"), "float").when(type_.rlike(NUMERIC), "integer").when(type_.rlike(TEMPORAL), "time").when(type_.rlike(TEXT), "text").otherwise("other")


def typed_value(raw: Column, type_: Column) -> Column:
    """struct<number, micros, raw>: a statistics text as a number or as microseconds of UTC, by its type; raw if it is neither."""
    number = F.when(type_.rlike(NUMERIC), raw.try_cast("double"))
    iso = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("T")), r"([+-]\d\d)$", "$1:00")
    zoned = F.when(F.length(raw) == 10, F.concat(raw, F.lit("T00:00:00Z"))).when(iso.rlike(r"[zZ]$|T.*[+-]\d\d:\d\d$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    micros = F.when(type_.rlike(TEMPORAL), F.unix_micros(zoned.try_cast("timestamp")))
    return F.struct(F.when(~F.isnan(number), number).alias("number"), micros.alias("micros"), F.when((number.isNull() | F.isnan(number)) & micros.isNull(), raw).alias("raw"))


def shown_value(raw: Column, type_: Column) -> Column:
    """A decoded value as text by its type: floats with seven digits, times of day and bytes aside the same as they are."""
    return F.when(type_ == "FLOAT", F.coalesce(_digits(raw.try_cast("double"), 7), raw)).when(type_ == "BOOLEAN", F.when(raw.isin("1", "true"), "true").otherwise("false")).otherwise(raw)


def list_text(items: Column) -> Column:
    """[a, b]: an array of texts, NULL for null items."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit("NULL"))), ", "), F.lit("]"))


def pairs_text(pairs: Column, struct: bool) -> Column:
    """{'k': v, ...} of a struct's or {k=v, ...} of a map's (key, value) pairs of texts, NULL for null values."""
    one = lambda p: F.concat(F.lit("'"), p["key"], F.lit("': "), F.coalesce(p["value"], F.lit("NULL"))) if struct else F.concat(p["key"], F.lit("="), F.coalesce(p["value"], F.lit("NULL")))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, one), ", "), F.lit("}"))


def qualified(*names: Column) -> Column:
    """Names quoted as they need it, joined by dots."""
    return F.concat_ws(".", *map(quote_name, names))


def to_query(**values: Column) -> Column:
    """A URL's query text of the values that aren't null, in the order given."""
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in values.items()))


def query_value(search: Column, name: str) -> Column:
    """The first value of a name in a URL's query text; null without one."""
    at = rf"(?:^|[?&]){name}=([^&]*)"
    return F.when(search.rlike(at), F.try_url_decode(F.regexp_extract(search, at, 1)))


def from_query(search: Column) -> Column:
    """struct<db, table, rg, col>; null without a database; rg only if it is a whole number."""
    rg = query_value(search, "rg")
    parts = F.struct(query_value(search, "db").alias("db"), query_value(search, "table").alias("table"), F.when(rg.rlike("^[0-9]+$"), rg.try_cast("long")).alias("rg"), query_value(search, "col").alias("col"))
    return F.when(F.coalesce(query_value(search, "db"), F.lit("")) != "", parts)


def parse_stats(stats: Column) -> Column:
    """struct<low, high, has_null> of a segment's statistics text; nested ones have no range, unknown nulls stay null."""
    range_ = r"^\[Min: (.*?), Max: (.*?)(, Has Unicode[^\]]*)?\]"
    found = stats.rlike(range_) & ~stats.startswith("[[")
    null = F.regexp_extract(stats, "Has Null: (true|false)", 1)
    return F.struct(F.when(found, F.regexp_extract(stats, range_, 1)).alias("low"), F.when(found, F.regexp_extract(stats, range_, 2)).alias("high"), F.when(null != "", null == "true").alias("has_null"))


def segment_label(path: Column, validity: Column) -> Column:
    """values, validity, or which child; the path's first element is the column."""
    n = F.size(path)
    inner = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ".")
    deep = F.concat(F.lit("child "), inner(F.slice(path, F.lit(2), F.greatest(F.lit(0), n - 2))), F.lit(" validity"))
    child = F.concat(F.lit("child "), inner(F.slice(path, F.lit(2), F.greatest(F.lit(0), n - 1))))
    return F.when(n == 1, "values").when(validity & (n == 2), "validity").when(validity, deep).otherwise(child)


def wal_path(path: Column) -> Column:
    """The log beside a database file; a query string stays behind it."""
    return F.regexp_replace(path, r"^([^?#]*)", "$1.wal")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), -1)
