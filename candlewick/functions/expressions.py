"""Column expressions: all of them native, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MS = 253402300799999


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bucket_start(ms: Column, seconds: int) -> Column:
    """Start, in epoch seconds, of the bucket of ``seconds`` that a time in milliseconds falls in."""
    return F.floor(F.floor(ms / 1000) / seconds).cast("long") * seconds


def at_second(seconds: Column) -> Column:
    """Epoch seconds as a timestamp without time zone (UTC)."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_symbol(symbol: Column) -> Column:
    # \z, not $: $ would accept a line feed at the end
    return symbol.isNotNull() & symbol.rlike(r"^[A-Z0-9]{1,20}\z")


def valid_trade(symbol: Column, trade_id: Column, price: Column, quantity: Column, ms: Column) -> Column:
    """The trade contract; never null."""
    good = valid_symbol(symbol) & (trade_id >= 0) & finite(price) & (price > 0) & finite(quantity) & (quantity > 0) & ms.between(1, MAX_MS)
    return F.coalesce(good, F.lit(False))


def stripped(text: Column) -> Column:
    """Without white space of any kind, Unicode's and control characters' too, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space; never null."""
    return F.coalesce(stripped(text) == "", F.lit(True))


def normalized_url(url: Column) -> Column:
    """Without white space around, tabs and line ends inside, query, fragment and trailing slashes; an empty path becomes ``/``, the scheme lower case."""
    bare = F.regexp_replace(F.regexp_replace(stripped(url), r"^[\x00-\x20]+|[\t\r\n]", ""), r"(?s)[?#].*\z", "")
    return once(bare, _rebuilt)


def _rebuilt(bare: Column) -> Column:
    named = r"^([A-Za-z][A-Za-z0-9+.-]*):"
    scheme, rest = F.lower(F.regexp_extract(bare, named, 1)), F.regexp_replace(bare, named, "")
    host, path = F.regexp_extract(rest, r"^//([^/]*)", 1), F.regexp_replace(F.regexp_replace(rest, r"^//[^/]*", ""), r"/+\z", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when((host != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    before = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    slashes = F.when((host != "") | (scheme.isin("http", "https", "ftp") & path.startswith("/")), F.lit("//")).otherwise(F.lit(""))
    return F.concat(before, slashes, host, path)


# fixed values: month names, and zone names of mail dates with their hours from UTC
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s*)?"
_MONTH = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\.?"
_CLOCK = r"(\d{1,2}):([0-5]\d)(?::([0-5]\d)(?:[.,](\d+))?)?(?:\s*([AP]M))?"
_ZONE = r"(?:\s*((?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}))?(?:\s*\(.*\))?"
_ISO_CLOCK = r"(?:[T ](\d{2})(?::?([0-5]\d)(?::?([0-5]\d)(?:[.,](\d+))?)?)?\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?"
#: Grammar of each kind of date, and where kind, year, month, day, hour, minute, second, fraction, half of the day and zone stand in it.
DATES = [
    (r"^(\d{4})-(\d{2})(?:-(\d{2}))?" + _ISO_CLOCK + r"\z", "d|$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})" + _ISO_CLOCK + r"\z", "d|$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})-?W([0-5]\d)(?:-?([1-7]))?" + _ISO_CLOCK + r"\z", "w|$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})-?(\d{3})" + _ISO_CLOCK + r"\z", "o|$1||$2|$3|$4|$5|$6||$7"),
    (r"(?i)^" + _WEEKDAY + r"(\d{1,2})[\s-]+" + _MONTH + r",?[\s-]+(\d{4}|\d{2})(?:,?\s+" + _CLOCK + _ZONE + r")?\z", "d|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"(?i)^" + _WEEKDAY + _MONTH + r"\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+" + _CLOCK + _ZONE + r")?\z", "d|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"(?i)^" + _WEEKDAY + _MONTH + r"\s+(\d{1,2})\s+" + _CLOCK + _ZONE.replace("[A-Za-z]{1,5}", "[A-Za-z]{3,5}") + r"\s+(\d{4})\z", "d|$9|$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"(?i)^(\d{4})/(\d{1,2})/(\d{1,2})(?:\s+" + _CLOCK + _ZONE + r")?\z", "d|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
]


def parsed_published(text: Column) -> Column:
    """The moment that a date in ISO 8601 or in a mail's, C's or a common American form names, else null.

    ISO: calendar, week and ordinal dates, with or without separators, to the month, day, hour, minute, second or a fraction.
    Mail: weekday, seconds and zone may be missing; years of two digits are 1990 to 2089. Without a zone, and with
    the name of an unknown one, it is UTC. A missing day is the first; what no calendar has is null.
    """

    def ordered(at: Column) -> Column:
        fields = F.lit(None).cast("string")
        for pattern, order in reversed(DATES):
            fields = F.when(at.rlike(pattern), F.regexp_replace(at, pattern, order)).otherwise(fields)
        return F.split(fields, r"\|", -1)

    return once(once(stripped(text), ordered), _moment)


def _moment(f: Column) -> Column:
    """The moment of the ten fields of a date."""
    kind, year, month, day, hour, minute, second, fraction, half, zone = (F.get(f, F.lit(i)) for i in range(10))
    number = lambda c, missing=0: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(missing))
    year = F.when(F.length(year) > 2, number(year)).when(number(year) < 90, number(year) + 2000).otherwise(number(year) + 1900)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3))).cast("int")
    h = number(hour)
    h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("int")
    clock = h * 3600 + number(minute) * 60 + number(second)
    date = F.try_make_timestamp(year, F.when(named > 0, named).otherwise(number(month, 1)), number(day, 1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    first = F.unix_date(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1)))
    monday = first + 3 - F.pmod(first + 6, F.lit(7))  # of the week that holds 4 January
    weeks = F.when(F.pmod(first + 3, F.lit(7)).isin(3) | ((F.pmod(first + 3, F.lit(7)) == 2) & _leap(year)), 53).otherwise(52)
    in_week = F.when(number(month).between(1, weeks), monday + (number(month) - 1) * 7 + number(day, 1) - 1)
    in_year = F.when(number(day).between(1, F.when(_leap(year), 366).otherwise(365)), first + number(day) - 1)
    seconds = F.when(kind == "d", F.unix_seconds(date)).when(kind == "w", in_week.cast("long") * 86400).otherwise(in_year.cast("long") * 86400)
    digits = r"(?i)^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?\z"
    by_digits = (F.regexp_extract(zone, digits, 2).try_cast("int") * 3600 + number(F.regexp_extract(zone, digits, 3)) * 60) * F.when(F.regexp_extract(zone, digits, 1) == "-", -1).otherwise(1)
    by_name = F.try_element_at(F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair]), F.lower(zone)) * 3600
    offset = F.coalesce(F.when(zone.rlike(digits), by_digits), by_name, F.lit(0))
    found = F.timestamp_micros((seconds + clock - offset) * 1_000_000 + F.coalesce(micros, F.lit(0)))
    return F.when((h < 24) | (clock == 86400), found)


def _leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def sanitized_feed(xml: Column) -> Column:
    """A feed without empty ``<x:encoded/>`` elements, which would hide the description."""
    return F.regexp_replace(xml, r"(?i)<([a-z]+:)?encoded\s*/>|<([a-z]+:)?encoded\s*>\s*</\2?encoded\s*>", "")


#: The entities that the native unescape knows; every other one is left to ``functions.text.unescaped``.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def untagged(text: Column) -> Column:
    """Tags to spaces, white space (Unicode's too) collapsed, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"(?U)\s+", " "), r"^ | $", "")


def clean_text(text: Column) -> Column:
    """Native cleaning: the common entities, then tags and white space."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return untagged(text)


def tokens(*texts: Column) -> Column:
    """Distinct lower-case runs of ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z]+"), 0))


def symbols_in(words: Column, dictionary: dict[str, str]) -> Column:
    """Sorted distinct symbols of the words that the dictionary knows."""
    known = F.create_map(*[F.lit(x) for pair in dictionary.items() for x in pair])
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda s: s.isNotNull())))


def sentiment_of(words: Column, positive: list[str], negative: list[str]) -> Column:
    """Which of two word lists has more members among the words; a tie is neutral."""
    up, down = (F.size(F.array_intersect(words, F.array(*map(F.lit, side)))) for side in (positive, negative))
    return F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
