"""Signature times in page text and titles of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.scalars import matches, placed_matches

# Month names as wikis write them, in calendar order, other spellings after a bar.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "jan|januar feb|februar mär|märz apr|april mai jun|juni jul|juli aug|august sep|september okt|oktober nov|november dez|dezember".split(),
    "es": "ene|enero feb|febrero mar|marzo abr|abril may|mayo jun|junio jul|julio ago|agosto sep|septiembre oct|octubre nov|noviembre dic|diciembre".split(),
}
# Signature patterns and the order of their groups.
FORMATS = [
    ("en", r"(\p{Nd}{2}):(\p{Nd}{2}), (\p{Nd}{1,2}) (\p{L}+) (\p{Nd}{4}) \(UTC\)", "hidMy"),
    ("en", r"(\p{Nd}{2}):(\p{Nd}{2}), (\p{L}+) (\p{Nd}{1,2}), (\p{Nd}{4}) \(UTC\)", "hiMdy"),
    ("fr", r"(\p{Nd}{1,2}) (\p{L}+) (\p{Nd}{4}) à (\p{Nd}{2}):(\p{Nd}{2}) \(\p{L}+\)", "dMyhi"),
    ("de", r"(\p{Nd}{2}):(\p{Nd}{2}), (\p{Nd}{1,2})\. (\p{L}+)\.? (\p{Nd}{4}) \(\p{L}+\)", "hidMy"),
    ("es", r"(\p{Nd}{2}):(\p{Nd}{2}) (\p{Nd}{1,2}) (\p{L}+) (\p{Nd}{4}) \(UTC\)", "hidMy"),
]


def _month(all_names: list[str], name: Column) -> Column:
    pairs = [F.lit(x) for i, names in enumerate(all_names, 1) for n in names.split("|") for x in (n, i)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.rtrim(name, F.lit("."))))


def without_comments(text: Column) -> Column:
    """Comments become as many blanks, so that places stay; an unclosed one runs to the end."""
    comment = r"(?s)<!--.*?(?:-->|\z)"
    blanks = F.transform(F.regexp_extract_all(text, F.lit(comment), 0), lambda c: F.repeat(F.lit(" "), F.char_length(c)))
    return F.array_join(F.flatten(F.zip_with(F.split(text, comment), blanks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _int(text: Column) -> Column:
    """A number in any script's digits."""
    zeros = "٠۰०০੦૦୦௦౦೦൦๐໐"
    digits = "".join(chr(ord(z) + i) for z in zeros for i in range(10))
    return F.translate(text, digits, "0123456789" * len(zeros)).try_cast("int")


def signatures(text: Column, languages: list[str] | None = None, zone: str = "UTC", formats: list[tuple[str, str, str]] | None = None, months: dict[str, list[str]] | None = None) -> Column:
    """array<struct<start, end, ts, text, language>> of all signature times in order of place; unknown months and impossible dates are left out.

    Times are wall clock in zone; start and end count code points. formats are (language, pattern, order of
    its groups) as in FORMATS, and months the names of languages that MONTHS lacks. Hits at one place
    are in order of formats.
    """
    masked = without_comments(F.coalesce(text, F.lit("")))
    own = [f for f in (FORMATS if formats is None else formats) if not languages or f[0] in languages]
    return _in_order([_of_format(masked, zone, i, MONTHS | (months or {}), *f) for i, f in enumerate(own)])


def _in_order(found: list[Column]) -> Column:
    order = lambda s: F.struct(s["start"], s["rank"])
    placed = F.array_sort(F.concat(*found), lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0))
    return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["ts"].alias("ts"), s["text"].alias("text"), s["language"].alias("language")))


def _of_format(masked: Column, zone: str, rank: int, months: dict[str, list[str]], language: str, pattern: str, order: str, hits: Column | None = None) -> Column:
    def read(hit: Column) -> Column:
        part = {k: F.regexp_extract(hit["text"], pattern, i + 1) for i, k in enumerate(order)}
        at = F.try_make_timestamp(_int(part["y"]), _month(months[language], part["M"]), _int(part["d"]), _int(part["h"]), _int(part["i"]), F.lit(0))
        end = hit["start"] + F.char_length(hit["text"])
        return F.struct(hit["start"].alias("start"), end.alias("end"), F.to_utc_timestamp(at, zone).alias("ts"), hit["text"].alias("text"), F.lit(language).alias("language"), F.lit(rank).alias("rank"))

    placed = placed_matches(masked, pattern, hits)
    return F.filter(F.transform(placed, read), lambda s: s["ts"].isNotNull())


def latest(signed: Column) -> Column:
    """The latest signature, the one that stands first among equal times."""
    best = F.array_max(F.transform(signed, lambda s, i: F.struct(s["ts"].alias("ts"), (-i).alias("place"))))
    return F.get(signed, -best["place"])


def earliest(signed: Column) -> Column:
    best = F.array_min(F.transform(signed, lambda s, i: F.struct(s["ts"].alias("ts"), i.alias("place"))))
    return F.get(signed, best["place"])


def exploded(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each signature time of a text.

    The text without comments, and each format's hits in it, are columns of their own on the way: in one
    expression they would be made again wherever they stand.
    """
    end = "_" * (1 + max(len(c) for c in df.columns))
    masked, hits = f"masked{end}", [f"hits{i}{end}" for i in range(len(FORMATS))]
    rows = df.withColumn(masked, without_comments(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumns({h: matches(F.col(masked), f[1]) for h, f in zip(hits, FORMATS)})
    found = [_of_format(F.col(masked), "UTC", i, MONTHS, *f, hits=F.col(h)) for i, (h, f) in enumerate(zip(hits, FORMATS))]
    return rows.withColumn("signature", F.explode(_in_order(found))).drop(masked, *hits)


# How languages title the page of a day; M is the month's name, d the day.
DAY_TITLES = {"en": "M d", "fr": "d M", "de": "d. M", "es": "d de M"}


def day_title(month: Column, day: Column, language: str = "en") -> Column:
    """The title of a day's page; null for a day that no year has."""
    names = [n.split("|")[-1] for n in MONTHS[language]]
    name = F.get(F.array(*[F.lit(n.capitalize() if language in ("en", "de") else n) for n in names]), month - 1)
    out = F.concat(*[name if c == "M" else day.cast("string") if c == "d" else F.lit(c) for c in _cut(DAY_TITLES[language])])
    return F.when(day.between(1, days_in(month)), out)


def _cut(form: str) -> list[str]:
    """The form's fields, and what lies between."""
    import re

    return [x for x in re.split(r"(M|\bd\b(?! de)|\bd(?= de))", form) if x]


def days_in(month: Column) -> Column:
    """February has 29."""
    return F.get(F.array(*map(F.lit, [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])), month - 1)


def parse_day_title(title: Column, language: str = "en") -> Column:
    """struct<month, day> of a day page's title; null for all else."""
    name = F.regexp_extract(title, r"(\p{L}{3,})", 1)
    month = _month(MONTHS[language], name)
    day = _int(F.regexp_extract(F.replace(title, name, F.lit("")), r"(\p{Nd}{1,2})", 1))
    ok = month.isNotNull() & day.between(1, days_in(month)) & day_title(month, day, language).eqNullSafe(title)
    return F.when(ok, F.struct(month.alias("month"), day.alias("day")))
