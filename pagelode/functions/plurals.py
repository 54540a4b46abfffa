"""Plural forms: a compiler from rule text to columns.

A rule is what the Unicode plural rules have: relations `operand [% modulus] (= | !=) values and ranges`,
joined by `and`, alternatives by `or`. Operands: n the number, i its whole part, v and f the count and value
of its fraction digits, w and t the same without zeros at the end, c and e the exponent, which is 0.
The form of a number is the place of the first of its language's rules that holds, or else their count.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RELATION = re.compile(r"([nivwftce])\s*(?:%\s*(\d+))?\s*(!=|=)\s*([\d.,]+)")

_MILLION = "e = 0 and i != 0 and i % 1000000 = 0 and v = 0 or e != 0..5"
_SOUTH_ONE = "v = 0 and i % 10 = 1 and i % 100 != 11 or f % 10 = 1 and f % 100 != 11"
# The Unicode plural rules for cardinal numbers, by the languages that share them; in the order zero, one, two, few, many.
RULES: dict[str, tuple[str, ...]] = {
    "bm bo dz hnj id ig ii in ja jbo jv jw kde kea km ko lkt lo ms my nqo osa sah ses sg su th to tpi vi wo yo yue zh": (),
    "am as bn doi fa gu hi kn pcm zu": ("i = 0 or n = 1",),
    "ff hy kab": ("i = 0,1",),
    "ast de en et fi fy ia ie io ji lij nl sc sv sw ur yi": ("i = 1 and v = 0",),
    "si": ("n = 0,1 or i = 0 and f = 1",),
    "ak bho csw guw ln mg nso pa ti wa": ("n = 0..1",),
    "tzm": ("n = 0..1 or n = 11..99",),
    "af an asa az bal bem bez bg brx ce cgg chr ckb dv ee el eo eu fo fur gsw ha haw hu jgo jmc ka kaj kcg kk kkj kl kok ks ksb ku ky lb lg mas mgo ml mn mr nah nb nd ne nn nnh no nr ny nyn om or os pap ps rm rof rwk saq sd sdh seh sn so sq ss ssy st syr ta te teo tig tk tn tr ts ug uz ve vo vun wae xh xog": ("n = 1",),
    "da": ("n = 1 or t != 0 and i = 0,1",),
    "is": ("t = 0 and i % 10 = 1 and i % 100 != 11 or t % 10 = 1 and t % 100 != 11",),
    "mk": (_SOUTH_ONE,),
    "ceb fil tl": ("v = 0 and i = 1,2,3 or v = 0 and i % 10 != 4,6,9 or v != 0 and f % 10 != 4,6,9",),
    "lv prg": ("n % 10 = 0 or n % 100 = 11..19 or v = 2 and f % 100 = 11..19", "n % 10 = 1 and n % 100 != 11 or v = 2 and f % 10 = 1 and f % 100 != 11 or v != 2 and f % 10 = 1"),
    "lag": ("n = 0", "i = 0,1 and n != 0"),
    "blo ksh": ("n = 0", "n = 1"),
    "he iw": ("i = 1 and v = 0 or i = 0 and v != 0", "i = 2 and v = 0"),
    "iu naq sat se sma smi smj smn sms": ("n = 1", "n = 2"),
    "shi": ("i = 0 or n = 1", "n = 2..10"),
    "mo ro": ("i = 1 and v = 0", "v != 0 or n = 0 or n != 1 and n % 100 = 1..19"),
    "bs hr sh sr": (_SOUTH_ONE, "v = 0 and i % 10 = 2..4 and i % 100 != 12..14 or f % 10 = 2..4 and f % 100 != 12..14"),
    "fr": ("i = 0,1", _MILLION),
    "pt": ("i = 0..1", _MILLION),
    "ca gl it lld scn vec": ("i = 1 and v = 0", _MILLION),
    "es": ("n = 1", _MILLION),
    "gd": ("n = 1,11", "n = 2,12", "n = 3..10,13..19"),
    "sl": ("v = 0 and i % 100 = 1", "v = 0 and i % 100 = 2", "v = 0 and i % 100 = 3..4 or v != 0"),
    "dsb hsb": ("v = 0 and i % 100 = 1 or f % 100 = 1", "v = 0 and i % 100 = 2 or f % 100 = 2", "v = 0 and i % 100 = 3..4 or f % 100 = 3..4"),
    "cs sk": ("i = 1 and v = 0", "i = 2..4 and v = 0", "v != 0"),
    "pl": ("i = 1 and v = 0", "v = 0 and i % 10 = 2..4 and i % 100 != 12..14", "v = 0 and i != 1 and i % 10 = 0..1 or v = 0 and i % 10 = 5..9 or v = 0 and i % 100 = 12..14"),
    "be": ("n % 10 = 1 and n % 100 != 11", "n % 10 = 2..4 and n % 100 != 12..14", "n % 10 = 0 or n % 10 = 5..9 or n % 100 = 11..14"),
    "lt": ("n % 10 = 1 and n % 100 != 11..19", "n % 10 = 2..9 and n % 100 != 11..19", "f != 0"),
    "ru uk": ("v = 0 and i % 10 = 1 and i % 100 != 11", "v = 0 and i % 10 = 2..4 and i % 100 != 12..14", "v = 0 and i % 10 = 0 or v = 0 and i % 10 = 5..9 or v = 0 and i % 100 = 11..14"),
    "br": ("n % 10 = 1 and n % 100 != 11,71,91", "n % 10 = 2 and n % 100 != 12,72,92", "n % 10 = 3..4,9 and n % 100 != 10..19,70..79,90..99", "n != 0 and n % 1000000 = 0"),
    "mt": ("n = 1", "n = 2", "n = 0 or n % 100 = 3..10", "n % 100 = 11..19"),
    "ga": ("n = 1", "n = 2", "n = 3..6", "n = 7..10"),
    "gv": ("v = 0 and i % 10 = 1", "v = 0 and i % 10 = 2", "v = 0 and i % 100 = 0,20,40,60,80", "v != 0"),
    "kw": ("n = 0", "n = 1", "n % 100 = 2,22,42,62,82 or n % 1000 = 0 and n % 100000 = 1000..20000,40000,60000,80000 or n != 0 and n % 1000000 = 100000", "n % 100 = 3,23,43,63,83", "n != 1 and n % 100 = 1,21,41,61,81"),
    "ar ars": ("n = 0", "n = 1", "n = 2", "n % 100 = 3..10", "n % 100 = 11..99"),
    "cy": ("n = 0", "n = 1", "n = 2", "n = 3", "n = 6"),
}
# Codes that take another language's rules.
RULE_OF = {"bh": "bho", "isv-cyrl": "sr", "isv-latn": "sr"}


def operands(number: Column) -> dict[str, Column]:
    """The operands of a whole number, or of a decimal written as a string, whose fraction digits count."""
    text = F.regexp_replace(number.cast("string"), r"^[+-]", "")
    digits = F.coalesce(F.regexp_extract(text, r"\.(\d*)$", 1), F.lit(""))
    short = F.regexp_replace(digits, "0+$", "")
    value = lambda d: F.when(d == "", 0).otherwise(d.cast("long"))
    whole = F.regexp_extract(text, r"^(\d*)", 1).try_cast("decimal(38,0)")
    zero = F.lit(0)
    return {"n": text.try_cast("decimal(38,10)"), "i": whole, "v": F.length(digits), "w": F.length(short), "f": value(digits), "t": value(short), "c": zero, "e": zero}


def condition(rule: str, of: Mapping[str, Column]) -> Column:
    """The predicate of one rule's text over operands; raises for text that isn't a rule."""

    def relation(text: str) -> Column:
        m = _RELATION.fullmatch(text.strip())
        if not m:
            raise ValueError(f"not a plural relation: {text}")
        operand = of[m[1]] % int(m[2]) if m[2] else of[m[1]]
        bounds = [r.split("..") for r in m[4].split(",")]
        # a range holds whole numbers only
        held = reduce(Column.__or__, [(operand.between(int(b[0]), int(b[1])) & (operand == F.floor(operand))) if len(b) > 1 else operand == int(b[0]) for b in bounds])
        return held if m[3] == "=" else ~held

    return reduce(Column.__or__, [reduce(Column.__and__, map(relation, part.split(" and "))) for part in rule.split(" or ")])


def index(number: Column, language: Column | str, rules: Mapping[str, tuple[str, ...]] = RULES) -> Column:
    """Which plural form a number takes, from 0; null for null and for languages without rules. A variant after a hyphen takes its language's."""
    of = operands(number)

    def form(texts: tuple[str, ...]) -> Column:
        out = F
        for place, text in enumerate(texts):
            out = out.when(condition(text, of), place)
        return out.otherwise(len(texts)) if texts else F.lit(0)

    if isinstance(language, str):
        code = RULE_OF.get(language, language.split("-")[0])
        found = [texts for languages, texts in rules.items() if code in languages.split()]
        return F.when(number.isNotNull(), form(found[0]) if found else F.lit(None)).cast("int")
    own = F.when(language.isin(*RULE_OF), F.create_map(*[F.lit(x) for p in RULE_OF.items() for x in p])[language]).otherwise(F.substring_index(language, "-", 1))
    out = F
    for languages, texts in rules.items():
        out = out.when(own.isin(languages.split()), form(texts))
    return F.when(number.isNotNull(), out.otherwise(None)).cast("int")
