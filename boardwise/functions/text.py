"""Text expressions: masterpoint limits, ids, dates, pages and addresses."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Labels of strata and their buckets; other labels mean open, and All sets no filter.
STRATA = {
    "Open (unlimited)": "open", "0-299": "0-299", "0-499 / NLM": "0-499-nlm", "0-749": "0-749",
    "0-1500": "0-1500", "Other restricted": "other-restricted", "All": None,
}
#: Fixed values. Masterpoint bands start here; the last has no end.
BANDS = [0, 5, 20, 50, 100, 200, 300, 500, 750, 1000, 1500, 2500, 3500, 5000, 7500, 10000]
#: Fixed values. Formats that dates come in.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd"]


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, as a timestamp without zone; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats or DATE_FORMATS]).cast("timestamp_ntz")


def day(c: Column) -> Column:
    return F.substring(c, 1, 10)


def day_within(c: Column) -> Column:
    """The first date in a text, as in 2026-01-22T00:00:00+01:00; null without one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def is_recent(c: Column, now: dt.datetime, days: int = 30) -> Column:
    """Whether the date in a text starts no more than `days` before now; false without a date."""
    return F.coalesce(day_within(c).cast("timestamp_ntz") >= F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz"), F.lit(False))


def series_key(c: Column) -> Column:
    """A series id as text, however it came: 3, 3.0 as a number and ' 03 ' are 3; other texts stay as they are."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("decimal(38,0)").cast("string")).otherwise(c)


def number_key(c: Column) -> Column:
    """series_key for a column of numbers: whole ones without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def holds_text(c: Column, token: str) -> Column:
    """Whether a text holds token, taken literally, in any case."""
    return c.rlike("(?i)" + re.escape(token))


def first_number(c: Column) -> Column:
    """Digits with thousands commas as an integer, else null."""
    return F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9,]*)", 1), ",", "").try_cast("int")


def club_top_limit(raw: Column) -> Column:
    """Limit of the first of several strata, as in `MP Limits: 1,500/750`; null if it is open."""
    return first_number(F.split(F.regexp_replace(F.trim(raw), r"(?i)^MP\s*Limits:\s*", ""), "/")[0])


def tournament_is_nlm(raw: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(F.trim(raw)), F.lit("NLM")), F.lit(False))


def tournament_top_limit(raw: Column) -> Column:
    """Limit of the last part that has one or starts with `0-`, of `0-1500/NLM` or `2500`; a lone NLM stands for 500; else null."""
    text = F.upper(F.trim(raw))
    tops = F.transform(F.reverse(F.split(text, "/")), lambda x: F.struct(first_number(F.regexp_replace(x, "^0-", "")).alias("top"), x.startswith("0-").alias("ends"), (x == "NLM").alias("nlm")))
    first = F.get(F.filter(tops, lambda x: ~x["nlm"] & (x["ends"] | x["top"].isNotNull())), F.lit(0))["top"]
    return F.when(text == "NLM", F.lit(500)).otherwise(first)


def strata_bucket(top: Column, nlm: Column | None = None) -> Column:
    nlm = F.lit(False) if nlm is None else nlm
    out = F.when(top.isNull() & ~nlm, "open").when(nlm & (top.isNull() | (top <= 500)), "0-499-nlm")
    return out.when(top <= 300, "0-299").when(top <= 500, "0-499-nlm").when(top <= 750, "0-749").when(top <= 1500, "0-1500").otherwise("other-restricted")


def label_bucket(label: str) -> str | None:
    return STRATA[label] if label in STRATA else label if label in STRATA.values() else "open"


def masterpoint_band(c: Column, low: float, high: float | None) -> Column:
    return (c >= low) if high is None else (c >= low) & (c < high)


def without_leading_zeros(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def is_digits(text: str) -> bool:
    return bool(text.strip()) and text.strip().isascii() and text.strip().isdigit()


def name_or_number(token: str, id_col: str, name_col: str, pair: bool = False) -> Column:
    """Digits find an id (or either side of a pair's); other text is looked for in the name, in any case."""
    token = token.strip()
    if not is_digits(token):
        return F.contains(F.lower(name_col), F.lit(token.lower()))
    if not pair:
        return F.col(id_col).cast("string") == token
    sides = F.split(F.translate(F.col(id_col), "_", "-"), "-")
    return (F.get(sides, F.lit(0)) == token) | (F.get(sides, F.lit(1)) == token)


def html_text(html: Column) -> Column:
    """A page's text without scripts, styles and tags, with single spaces."""
    out = html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", r"[ \t\n\r\f\x0B]+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def is_url(c: Column) -> Column:
    return c.rlike("^https?://")


def key_part(c: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "_"), 1, most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's body computes for each element what isn't its variable."""
    return F.transform(F.array(value), body)[0]


def surnames(pair: Column) -> Column:
    """Last words of both names of `First LAST - First LAST`."""
    two = F.split(pair, F.when(F.contains(pair, F.lit(" - ")), F.lit(" - ")).otherwise(F.lit("-")), 2)
    return F.transform(two, lambda x: F.element_at(F.split(F.trim(x), " +"), -1))


def nearest_percentage(page: Column, first: Column, second: Column, ahead: int = 100, behind: int = 20) -> Column:
    """Of a page's percentages such as 57.30%, the one closest behind two names, in any case; null without one.

    A name counts where it last stands in the characters around a percentage, `ahead` before it to `behind` after it. The
    distance is from the farther name; of equal distances the first percentage wins.
    """
    percent, least = r"[0-9]{1,2}\.[0-9]{2}%", 5  # characters of a percentage
    text, names = F.upper(page), [F.upper(F.trim(x)) for x in (first, second)]

    def pieces(page: Column) -> Column:
        """Each percentage with what is ahead of it, back to the one before, and the characters behind it."""
        found, between, heads = page["found"], page["between"], page["heads"]
        after = lambda i: F.flatten(F.transform(F.sequence(i + 1, i + 1 + behind // least), lambda k: F.array(F.coalesce(F.get(heads, k), F.lit("")), F.coalesce(F.get(found, k), F.lit("")))))
        return F.transform(found, lambda value, i: F.struct(i.alias("place"), F.get(between, i).alias("before"), value.alias("value"), F.left(F.array_join(after(i), ""), F.lit(behind)).alias("after")))

    def step(state: Column, piece: Column) -> Column:
        """One sweep: the last characters so far, and the best percentage."""
        tail = F.right(F.concat(state["tail"], piece["before"]), F.lit(ahead))
        around = F.concat(tail, piece["value"], piece["after"])
        back = [F.instr(F.reverse(around), F.reverse(name)) + F.length(name) - 1 for name in names]  # from the end to the name's start
        seen = F.least(*[F.instr(around, name) for name in names]) > 0
        own = F.struct((F.greatest(*back) - F.length(around) + F.length(tail)).alias("distance"), piece["place"].alias("place"), F.rtrim(piece["value"], F.lit("%")).cast("double").alias("value"))
        return F.struct(F.concat(tail, piece["value"]).alias("tail"), F.least(state["best"], F.when(seen, own)).alias("best"))

    parted = let(text, lambda t: F.struct(F.regexp_extract_all(t, F.lit(percent), F.lit(0)).alias("found"), F.split(t, percent, -1).alias("between")))
    parted = let(parted, lambda x: F.struct(x["found"], x["between"], F.transform(x["between"], lambda b: F.left(b, F.lit(behind))).alias("heads")))
    none = F.struct(F.lit("").alias("tail"), F.lit(None).cast("struct<distance:int,place:int,value:double>").alias("best"))
    best = F.aggregate(let(parted, pieces), none, step, lambda state: state["best"])
    return F.when((F.length(names[0]) > 0) & (F.length(names[1]) > 0), best["value"])


def dated_page(day_col: Column, templates: dict[int, str]) -> Column:
    """Address of a day's page: templates by weekday (Monday 0), with {day} for yymmdd; null on other days."""
    out = F.lit(None).cast("string")
    for weekday, template in templates.items():
        out = F.when(F.weekday(day_col) == weekday, F.replace(F.lit(template), F.lit("{day}"), F.date_format(day_col, "yyMMdd"))).otherwise(out)
    return out


def filled(template: str, *parts: Column) -> Column:
    """template with trimmed parts; null if one is null or empty."""
    bare = [F.trim(p.cast("string")) for p in parts]
    known = F.forall(F.array(*bare), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(known, F.format_string(template, *bare))


def date_bounds(choice: str, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a named range; None where it is open."""
    start = dt.date(today.year if (today.month, today.day) >= (7, 1) else today.year - 1, 7, 1)
    if choice == "Current season":
        return start, today
    if choice == "Previous season":
        return start.replace(year=start.year - 1), dt.date(start.year, 5, 31)
    days = {"Last 3 months": 90, "Last 6 months": 182, **{f"Last {k} year{'s' * (k > 1)}": 365 * k for k in range(1, 6)}}
    return (today - dt.timedelta(days=days[choice]), None) if choice in days else (None, None)


def next_refresh(day_: dt.date) -> dt.date:
    """The 15th of this month or the next, whichever is still to come."""
    if day_.day < 15:
        return day_.replace(day=15)
    return dt.date(day_.year + day_.month // 12, day_.month % 12 + 1, 15)


def numeric_by_name(columns: list[str], suffixes: tuple[str, ...], exact: set[str]) -> dict[str, Column]:
    """Columns whose names mark them as numbers, cast to double; what is no number becomes null."""
    return {c: F.col(c).try_cast("double") for c in columns if c in exact or c.endswith(suffixes)}
