"""Date and time texts: their shapes, the formats behind them, and one zone for all.

A text is prepared (upper case, no weekday, offsets spelled alike) and reduced to a
shape, in which every run of digits and every name is one letter. The shapes of a
column and what its numbers can be decide on its formats. Parsing goes through UTC, so
no result depends on the zone of the session.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.values import col, strip_text
from tabsieve.plans.tall import tall

# English names of months and days.
MONTHS = (
    "JANUARY",
    "FEBRUARY",
    "MARCH",
    "APRIL",
    "MAY",
    "JUNE",
    "JULY",
    "AUGUST",
    "SEPTEMBER",
    "OCTOBER",
    "NOVEMBER",
    "DECEMBER",
)
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")
# Two-digit years from this one on belong to the century before.
PIVOT_YEAR = 69

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_SHORT = "|".join(m[:3] for m in MONTHS)
_WEEKDAY = "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + "|TUES|THUR|THURS"
_CLOCK = r":[0-9]{1,2}(?:\.[0-9]+)?(?: ?[AP]M)?"

# White space that is stripped: that of Unicode, and the separators of files to units.
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Longer texts are counted by their shapes, shorter ones by their skeletons.
SKELETON_LENGTH = 64

# Shapes: y year of four digits, d one or two digits, b eight, h six, q fourteen digits, l month
# name, m short month name, f fraction, p half of the day, t the letter T, z offset.
# The marks in a date are groups 2 to 5 of the whole pattern.
_DATE = r"(?:y([-/. ])d\2d|d([-/. ])d\3[yd]|[lm] d,? ?[yd]|[lm] y|d([- ])[lm],?\4[yd]|y([- ])[lm]\5d|b|y|y-d)"
_TIME = r"d:d(?::d(?:\.f)?)?(?: ?p)?z?"
_SHAPE = re.compile(rf"^(?P<date>{_DATE})(?:(?P<gap>t| |, )(?P<time>{_TIME}))?$")
_PACKED = {"q": "yyyyMMddHHmmss", "bh": "yyyyMMddHHmmss", "bth": "yyyyMMdd'T'HHmmss", "b h": "yyyyMMdd HHmmss"}
# A field of the offset in a format, outside of quotes.
_ZONE_FIELD = re.compile(r"^(?:[^']|'[^']*')*?[XxZzVO]")


def prepared(text: Column) -> Column:
    """Upper case without weekday, ordinal endings and marks after short names; an offset
    is Z or +hh:mm right behind the time."""
    t = F.upper(strip_text(text))
    for part, _ in _preparations():
        t = _replaced(t, part)
    return t


def prepared_columns(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """The rows with prepared texts by the names given, which no column has.

    Replacements that a text has no sign of are left out: each stage is one projection,
    in which finding the sign costs less than the expressions that replace.
    """
    out = df.withColumns({n: F.upper(F.btrim(t, F.lit(_SPACES))) for n, t in texts.items()})
    for part, signs in _preparations():
        out = out.withColumns({n: F.when(signs(F.col(n)), _replaced(F.col(n), part)).otherwise(F.col(n)) for n in texts})
    return out


def _replaced(text: Column, part: Sequence[tuple[str, str]]) -> Column:
    for pattern, put in part:
        text = F.regexp_replace(text, pattern, put)
    return text


def _any(text: Column, *marks: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def _preparations() -> list[tuple[list[tuple[str, str]], Callable[[Column], Column]]]:
    """Replacements in their order, some at a time, each with a condition that holds for
    every text that they change."""
    return [
        (
            [
                (rf"^(?:{_WEEKDAY})[.,]* +", ""),
                (r"(?<=[0-9])(?:ST|ND|RD|TH)\b", ""),
                (r"\bSEPT\b", "SEP"),
                (rf"\b({_SHORT})\.", "$1"),
            ],
            # Weekdays, endings and SEPT have three letters or two in a row from these.
            lambda t: reduce(lambda a, b: a | b, [t.startswith(d[:3]) for d in WEEKDAYS])
            | _any(t, "ST", "ND", "RD", "TH", "SEPT")
            | (t.contains(".") & _any(t, *[m[:3] + "." for m in MONTHS])),
        ),
        (
            [(r"(:[0-9]{1,2})[.,]([0-9]{1,9})[0-9]*", "$1.$2"), (r"\b([AP])\.M\.", "$1M")],
            lambda t: _any(t, ".M.") | (t.contains(":") & _any(t, ".", ",")),
        ),
        (
            [
                (rf"({_CLOCK}) ?(?:UTC|GMT|Z)$", "$1Z"),
                (rf"({_CLOCK}) ?(?:UTC|GMT)?([+-][0-9]{{2}})(?::?([0-9]{{2}}))?$", "$1$2:$3"),
                (r"([+-][0-9]{2}):$", "$1:00"),
            ],
            # A line end may stand behind what is at the end of a text.
            lambda t: t.contains(":") & (_any(F.right(t, F.lit(8)), "+", "-", "Z", "UTC", "GMT")),
        ),
        ([(r"\s+", " ")], lambda t: _any(t, "  ", "\t", "\n", "\x0b", "\f", "\r")),
    ]


def shape(text: Column) -> Column:
    """The shape of a prepared text; NULL for texts that are no date."""
    s = text
    for pattern, put in (
        (rf"\b(?:{'|'.join(MONTHS)})\b", "l"),
        (rf"\b(?:{_SHORT})\b", "m"),
        (r"(?<=[0-9 ])[AP]M(?![A-Z])", "p"),
        (r"(?<=[0-9])T(?=[0-9])", "t"),
        (r"(:[0-9]{1,2}(?:\.[0-9]+)?(?: ?p)?)(?:Z|[+-][0-9]{2}:[0-9]{2})$", "$1z"),
        (r"(:[0-9]{1,2})\.[0-9]{1,9}", "$1.f"),
        (r"(?<![0-9])[0-9]{14}(?![0-9])", "q"),
        (r"(?<![0-9])[0-9]{8}(?![0-9])", "b"),
        (r"(?<![0-9])[0-9]{6}(?![0-9])", "h"),
        (r"(?<![0-9])[0-9]{4}(?![0-9])", "y"),
        (r"(?<![0-9])[0-9]{1,2}(?![0-9])", "d"),
    ):
        s = F.regexp_replace(s, pattern, put)
    packed = s.isin(*_PACKED)
    return F.when(packed | s.rlike(_SHAPE.pattern.replace("?P<", "?<")), s)


def shape_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """``(shape, n, md, dm, ymd, ydm)`` of each text column: how many values have a shape, and
    in how many of them the first three numbers can be read in an order.

    All columns go through one aggregate. The result is bounded: there are a few hundred
    shapes of dates, and all other texts are counted as one.

    No pattern tells one digit from another, so texts are counted by what is left when every
    digit is 0, with what the numbers can be, and shapes are taken of those.
    """
    raw = tall(df, [[F.upper(F.btrim(col(c), F.lit(_SPACES)))] for c in columns], ["text"]).where(F.col("text").isNotNull())
    short = F.char_length("text") <= SKELETON_LENGTH
    skeleton = F.when(short, F.translate("text", "123456789", "000000000"))
    # Before any offset is spelled otherwise; dates and times have three numbers in front of it.
    three = r"^[^0-9]*([0-9]+)[^0-9]*([0-9]*)[^0-9]*([0-9]*)"
    numbers = [F.regexp_extract("text", three, k + 1).try_cast("long").alias(f"g{k}") for k in range(3)]
    found = raw.select("idx", skeleton.alias("skeleton"), F.when(~short, shape(prepared(F.col("text")))).alias("long_shape"), *numbers)

    def order(month: str, day: str) -> Column:
        return F.count_if(F.col(month).between(1, 12) & F.col(day).between(1, 31))

    orders = {"md": order("g0", "g1"), "dm": order("g1", "g0"), "ymd": order("g1", "g2"), "ydm": order("g2", "g1")}
    by_skeleton = found.groupBy("idx", "skeleton", "long_shape").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in orders.items()])
    shapes = F.when(F.col("skeleton").isNull(), F.col("long_shape")).otherwise(shape(prepared(F.col("skeleton"))))
    counted = by_skeleton.withColumn("shape", shapes).groupBy("idx", "shape").agg(*[F.sum(k).alias(k) for k in ("n", *orders)])
    out: dict[str, list] = {c: [] for c in columns}
    for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["shape"] or "")):
        out[columns[r["idx"]]].append(r)
    return out


def _date_format(date: str, row) -> str:
    if date == "b":
        return "yyyyMMdd"
    named = date.replace("l", "MMMM").replace("m", "MMM") if set("lm") & set(date) else None
    if named is not None:
        if "y" not in date:
            # Of two numbers the second one is the year.
            first, last = named.index("d"), named.rindex("d")
            return named[:last] + "yy" + named[last + 1 :] if first < last else named
        return named.replace("y", "yyyy")
    if date in ("y", "y-d"):
        return date.replace("d", "M").replace("y", "yyyy")
    mark = date[1]
    if date.startswith("y"):
        return mark.join(("yyyy", "M", "d") if row["ymd"] >= row["ydm"] else ("yyyy", "d", "M"))
    # Of orders that fit as many values: the month first, but the day before a dot.
    orders = [("d", "M"), ("M", "d")] if mark == "." else [("M", "d"), ("d", "M")]
    fits = {("M", "d"): row["md"], ("d", "M"): row["dm"]}
    best = max(orders, key=lambda o: fits[o])
    if date.endswith("y"):
        return mark.join((*best, "yyyy"))
    return mark.join(("yy", "M", "d") if row["ymd"] > fits[best] else (*best, "yy"))


def format_of(row) -> str | None:
    """The format of a row of ``shape_counts``."""
    if row["shape"] in _PACKED:
        return _PACKED[row["shape"]]
    found = _SHAPE.match(row["shape"] or "")
    if not found:
        return None
    out = _date_format(found["date"], row)
    if found["time"]:
        half = "p" in found["time"]
        hour, *rest = found["time"].split(":")
        clock = ":".join(["h" if half else "H", *[part.replace("d", letter) for part, letter in zip(rest, "ms")]])
        clock = clock.replace("f", "S" * 9).replace("p", "a").replace("z", "XXX")
        out += {"t": "'T'"}.get(found["gap"], found["gap"]) + clock
    return out


def has_zone(fmt: str) -> bool:
    return bool(_ZONE_FIELD.match(fmt))


# What the letters of a format can stand for; all else stands for itself, in either case.
_FIELDS = {"y": "[+-]?[0-9]+", "M": "[0-9]+", "MMM": "[A-Za-z]+", "MMMM": "[A-Za-z]+", "S": "[0-9]*", "a": "[A-Za-z]+", "XXX": "(?:[Zz]|[+-][0-9:]+)"}
_FIELDS |= dict.fromkeys("dHhms", "[0-9]+")
_PLAIN_FORMAT = re.compile(r"(?:y{2}|y{4}|M{1,4}|d{1,2}|H{1,2}|h{1,2}|m{1,2}|s{1,2}|S{9}|a|XXX|'T'|[-/.,: ])+")


def _may_fit(text: Column, fmt: str) -> Column | None:
    """A condition that holds for all texts that fit a format of the kinds found by shapes,
    and is cheaper than a failure to parse; None for other formats."""
    if not _PLAIN_FORMAT.fullmatch(fmt):
        return None
    parts = re.findall(r"y+|M+|d+|H+|h+|m+|s+|S+|a|XXX|'T'|.", fmt)
    known = ["[Tt]" if p == "'T'" else _FIELDS.get(p) or _FIELDS.get(p[0]) or re.escape(p) for p in parts]
    # Neighbouring numbers are one, so that a long text is not tried in all its divisions.
    pattern = re.sub(r"(?:\[0-9\]\+)+", "[0-9]+", "".join(known))
    return text.rlike(f"^{pattern}$")


def parsed(text: Column, fmt: str) -> Column:
    """The text by one format as a time without zone: UTC where it names an offset, else
    as it is written. NULL where it does not fit."""
    fits = _may_fit(text, fmt)
    return _parsed(text, fmt) if fits is None else F.when(fits, _parsed(text, fmt))


def _parsed(text: Column, fmt: str) -> Column:
    zoned = has_zone(fmt)
    instant = F.try_to_timestamp(text if zoned else F.concat(text, F.lit("Z")), F.lit(fmt if zoned else fmt + "XXX"))
    if "yy" in fmt.replace("yyyy", ""):
        late = F.year(in_utc(instant)) >= 2000 + PIVOT_YEAR
        return F.when(late, in_utc(instant) - F.expr("INTERVAL 100 YEARS")).otherwise(in_utc(instant))
    return in_utc(instant)


def in_utc(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def parse_timestamp(text: Column, formats: Sequence[str] | None = None) -> Column:
    """First format that fits wins; without formats, ISO dates and times. Texts with an
    offset are moved to UTC."""
    if formats:
        return F.coalesce(*[parsed(text, f) for f in formats])
    zoned = text.rlike(r":[0-9]{1,2}([.][0-9]+)? *([+-][0-9]|[A-Za-z])")
    return F.when(zoned, in_utc(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))
