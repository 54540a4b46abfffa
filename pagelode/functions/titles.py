"""Titles: parsing, validation and prefixes, in an Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical namespaces, their other prefixes after a bar.
NAMESPACES = {
    "media": -2, "special": -1, "talk": 1, "user": 2, "user talk": 3, "project": 4, "project talk": 5, "file": 6, "image": 6, "file talk": 7,
    "image talk": 7, "mediawiki": 8, "mediawiki talk": 9, "template": 10, "template talk": 11, "help": 12, "help talk": 13, "category": 14, "category talk": 15,
}
# The named entities that titles decode.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014"}
ILLEGAL = set("#<>[]{}|")
SCHEMA = "kind string, ns int, text string, fragment string, prefix string, rest string, reason string"


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return ENTITIES.get(name, m[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _tidy(text: str) -> str:
    return re.sub(r"[\s_]+", " ", text).strip()


def _wrong(text: str) -> str | None:
    if any(c in ILLEGAL or ord(c) < 32 or ord(c) == 127 or c == "\ufffd" for c in text):
        return "illegal_character"
    if re.search(r"%[0-9A-Fa-f]{2}", text):
        return "percent_escape"
    if "~~~" in text:
        return "signature"
    if text in (".", "..") or text.startswith(("./", "../")) or "/./" in text or "/../" in text or text.endswith(("/.", "/..")):
        return "relative_path"
    return "too_long" if len(text.encode()) > 255 else None


def parse_one(raw: str, namespaces: Mapping[str, int], interwiki: frozenset[str], own: frozenset[str], first_letter: bool, default_ns: int) -> dict:
    """One title: entities, spaces, a leading colon, the fragment, prefixes, validation, the first letter's case."""
    text = _tidy(re.sub(r"&(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);", _entity, raw))
    text = text[1:].strip() if text.startswith(":") else text
    text, hash_, fragment = text.partition("#")
    out = dict.fromkeys(["kind", "ns", "text", "fragment", "prefix", "rest", "reason"])
    if hash_ and _tidy(fragment):
        out["fragment"] = _tidy(fragment)
    text, ns = _tidy(text), default_ns
    reason = None if text else "empty"
    while not reason:
        prefix, colon, rest = text.partition(":")
        name = prefix.strip().lower()
        if not colon or not prefix:
            break
        rest = rest.strip()
        if name in namespaces:
            ns = namespaces[name]
            other, colon, _ = rest.partition(":")
            if not rest:
                reason = "empty"
            elif ns == 1 and colon and other.strip().lower() in namespaces:
                reason = "talk_of_non_main"
            text = rest
            break
        if name in own:
            reason, text = (None if rest else "empty"), rest
            continue
        if name in interwiki:
            return out | {"kind": "interwiki", "prefix": prefix.strip(), "rest": rest}
        break
    reason = reason or _wrong(text)
    if reason:
        return out | {"kind": "invalid", "reason": reason, "fragment": None}
    upper = text[0].upper()
    if first_letter and len(upper) == 1:
        text = upper + text[1:]
    return out | {"kind": "local", "ns": ns, "text": text}


def parse(title: Column, namespaces: Mapping[str, int] | None = None, interwiki: frozenset[str] = frozenset(), own: frozenset[str] = frozenset(), first_letter: bool = True, default_ns: int = 0) -> Column:
    """struct<kind, ns, text, fragment, prefix, rest, reason> of a title column; null for null."""
    known = {k.lower(): v for k, v in (namespaces or NAMESPACES).items()}

    @F.pandas_udf(SCHEMA)
    def run(raw: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(["kind", "ns", "text", "fragment", "prefix", "rest", "reason"])
        rows = [empty if t is None else parse_one(t, known, interwiki, own, first_letter, default_ns) for t in raw]
        return pd.DataFrame(rows, columns=list(empty)).astype({"ns": "Int32"})

    return F.when(title.isNotNull(), run(title))


def template_key(name: Column) -> Column:
    """The key by which template names agree: spaces for underscores, a substitution prefix cut, the first letter upper."""
    t = F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " "))
    t = F.regexp_replace(t, r"^(?i)(?:(?:safe)?subst|msg|msgnw|raw)\s*:\s*", "")
    t = F.regexp_replace(t, r"^:?(?i)template\s*:\s*", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
