"""Wikitext as a node table.

nodes() gives a text's nodes as an array, which is exploded and then queried by ordinary DataFrame
operations. It covers comments, raw tags (nowiki, pre, math, source, syntaxhighlight), templates,
arguments, wiki links, bracketed links, headings, HTML entities and text; other HTML tags count as
text. It never fails, scans in linear time without recursion, and its leaves are the text:
concatenated, they give it back. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW = "nowiki|pre|math|source|syntaxhighlight"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^<>]*?(?:/>|>)|\{{{{2,}}|\}}{{2,}}|\[\[|\]\]|\||(?m:^={{1,6}}[^\n]*?={{1,6}}[ \t]*$)"
    r"|\[(?:https?:|ftp:|mailto:)?//[^\s\[\]<>\"]+[^\]\n]*\]|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]+);",
    re.S,
)
MARK = r"\{\{|\[|<|&|(?m)^="
SCHEMA = "array<struct<id:int, parent:int, depth:int, kind:string, start:int, end:int, name:string, level:int, params:array<struct<name:string, value:string, start:int, end:int>>, slots:array<struct<role:string, start:int, end:int>>, raw:string>>"
#: Kinds of nodes that hold others; all others are leaves.
CONTAINERS = ("template", "argument", "wikilink", "heading")
ATTRIBUTE = re.compile(r"""=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+))""")


def scan(text: str) -> list[tuple]:
    """(start, end, kind, name, level, bars) of all nodes but text."""
    out: list[tuple] = []
    stack: list[list] = []  # [kind, start, bars, braces left]
    ends = {m.lower(): -1 for m in RAW.split("|")}
    pos = 0
    while m := TOKEN.search(text, pos):
        at, pos, t = m.start(), m.end(), m[0]
        if t.startswith("<!--"):
            out.append((at, pos, "comment", None, None, ()))
        elif m["raw"]:
            name = m["raw"].lower()
            if not t.endswith("/>"):
                if ends[name] < pos:  # found once, and looked for again only beyond it
                    close = re.compile(rf"</{name}\s*>", re.I).search(text, pos)
                    ends[name] = close.end() if close else len(text) + 1
                if ends[name] > len(text):
                    continue
                pos = ends[name]
            out.append((at, pos, "tag", name, None, ()))
        elif t[0] == "{":
            stack.append(["brace", at, [], len(t)])
        elif t == "[[":
            stack.append(["link", at, [], 0])
        elif t == "|":
            if stack:
                stack[-1][2].append(at)
        elif t == "]]":
            if stack and stack[-1][0] == "link":
                _, start, bars, _ = stack.pop()
                out.append((start, pos, "wikilink", text[start + 2 : bars[0] if bars else at].strip(), None, tuple(bars)))
        elif t[0] == "}":
            left, here = len(t), at
            while left >= 2 and stack:
                while stack and stack[-1][0] == "link":
                    stack.pop()  # a link that a template's end cuts off is text
                if not stack:
                    break
                top = stack[-1]
                n = 3 if top[3] >= 3 and left >= 3 else 2
                start, here, left = top[1] + top[3] - n, here + n, left - n
                bars = tuple(top[2])
                name = text[start + n : bars[0] if bars else here - n].strip()
                out.append((start, here, "argument" if n == 3 else "template", name, None, bars))
                top[3] -= n
                top[2] = []
                if top[3] < 2:
                    stack.pop()
            pos = max(here, at + len(t)) if left < 2 or not stack else at + len(t)
        elif t[0] == "=":
            mark = t.rstrip()
            level = min(len(mark) - len(mark.lstrip("=")), len(mark) - len(mark.rstrip("=")), (len(mark) - 1) // 2)
            if level and not stack:
                out.append((at, at + len(mark), "heading", mark[level:-level].strip(), level, ()))
                pos = at + level  # what stands in the heading is scanned too
        elif t[0] == "[":
            out.append((at, pos, "extlink", t[1:-1].split(None, 1)[0], None, ()))
        else:
            out.append((at, pos, "entity", t[1:-1], None, ()))
    return sorted(out, key=lambda n: (n[0], -n[1]))


def params_of(text: str, end: int, bars: tuple[int, ...]) -> list[dict]:
    """Named and numbered parameters in order, with their spans; the last of a name counts, which is for queries to choose."""
    out, number = [], 0
    for a, b in zip(bars, (*bars[1:], end - 2)):
        value = text[a + 1 : b]
        name, eq, rest = value.partition("=")
        if eq and not re.search(r"[\[{]", name):
            out.append({"name": name.strip(), "value": rest.strip(), "start": a + 1, "end": b})
        else:
            number += 1
            out.append({"name": str(number), "value": value, "start": a + 1, "end": b})
    return out


def slots_of(text: str, start: int, end: int, kind: str, level: int | None, bars: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """The spans inside a node that are text and not markup, each with its role, in order; empty ones are left out."""
    out: list[tuple[str, int, int]] = []
    if kind == "template":
        out.append(("name", start + 2, bars[0] if bars else end - 2))
        for a, b in zip(bars, (*bars[1:], end - 2)):
            name, eq, _ = text[a + 1 : b].partition("=")
            if eq and not re.search(r"[\[{]", name):
                out += [("key", a + 1, a + 1 + len(name)), ("value", a + 2 + len(name), b)]
            else:
                out.append(("value", a + 1, b))
    elif kind == "wikilink":
        out.append(("target", start + 2, bars[0] if bars else end - 2))
        if bars:
            out.append(("label", bars[0] + 1, end - 2))
    elif kind == "argument":
        out.append(("name", start + 3, bars[0] if bars else end - 3))
        if bars:
            out.append(("default", bars[0] + 1, end - 3))
    elif kind == "heading":
        out.append(("title", start + level, end - level))
    elif kind == "comment":
        out.append(("contents", start + 4, end - 3 if text.endswith("-->", start + 4, end) else end))
    elif kind == "extlink":
        if m := re.search(r"\s+", text[start:end]):
            out.append(("title", start + m.end(), end - 1))
    elif kind == "tag":
        head = text.index(">", start) + 1
        out += [("attribute", m.start(k), m.end(k)) for m in ATTRIBUTE.finditer(text, start, head - 1) if (k := m.lastindex)]
        if head < end:
            out.append(("contents", head, text.rindex("</", start, end)))
    return [x for x in out if x[1] < x[2]]


def flat(text: str) -> list[dict]:
    """The node table of one text, in order, with text for all that lies between."""
    out: list[dict] = []
    # id, end, where its next text begins, its slots, and the first of them that isn't past
    open_: list[list] = [[-1, len(text), 0, [("body", 0, len(text))], 0]]

    def put(kind: str, start: int, end: int, name: str | None, level: int | None, params: list | None, slots: list) -> None:
        own = [{"role": r, "start": a, "end": b} for r, a, b in slots]
        out.append({"id": len(out), "parent": open_[-1][0], "depth": len(open_) - 1, "kind": kind, "start": start, "end": end, "name": name, "level": level, "params": params, "slots": own, "raw": text[start:end]})

    def text_to(end: int) -> None:
        top = open_[-1]
        start = top[2]
        if start < end:
            slots, k = top[3], top[4]
            while k < len(slots) and slots[k][2] <= start:
                k += 1
            top[4] = k
            own = []
            while k < len(slots) and slots[k][1] < end:
                role, a, b = slots[k]
                own.append((role, max(a, start), min(b, end)))
                k += 1
            put("text", start, end, None, None, None, own)
        top[2] = end

    for start, end, kind, name, level, bars in scan(text):
        while start >= open_[-1][1]:
            text_to(open_[-1][1])
            done = open_.pop()[1]
            open_[-1][2] = done
        if end > open_[-1][1]:
            continue  # crosses the end of what it stands in
        text_to(start)
        params = params_of(text, end, bars) if kind in ("template", "wikilink") else None
        slots = slots_of(text, start, end, kind, level, bars)
        put(kind, start, end, name, level, params, slots)
        if kind in CONTAINERS:
            open_.append([len(out) - 1, end, start, slots, 0])
        else:
            open_[-1][2] = end
    while open_:
        text_to(open_[-1][1])
        done = open_.pop()[1]
        if open_:
            open_[-1][2] = done
    return out


def nodes(text: Column) -> Column:
    """The node array of a text column; null for null. Parse once, keep the column, query it often."""
    return rewriter(flat, SCHEMA)(text)


def node_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each node. Texts without any mark are not sent to the parser and have no rows."""
    marked = F.when(F.col(text_col).rlike(MARK), nodes(F.col(text_col)))
    return df.select(id_col, F.explode(marked).alias("n")).select(id_col, "n.*")


def whole_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """node_table() with the one text node of texts without any mark too; null and empty texts have no rows."""
    size = F.char_length(text_col)
    body = F.struct(F.lit("body").alias("role"), F.lit(0).alias("start"), size.alias("end"))
    one = {"id": F.lit(0), "parent": F.lit(-1), "depth": F.lit(0), "kind": F.lit("text"), "start": F.lit(0), "end": size, "name": F.lit(None), "level": F.lit(None), "params": F.lit(None), "slots": F.array(body), "raw": F.col(text_col)}
    plain = F.array(F.struct(*[c.alias(k) for k, c in one.items()])).cast(SCHEMA)
    found = F.when(F.col(text_col) == "", None).when(F.col(text_col).rlike(MARK), nodes(F.col(text_col))).otherwise(plain)
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(found).alias("n")).select(id_col, "n.*")


def serialized(node_array: Column) -> Column:
    """The source, from the leaves."""
    leaves = F.filter(node_array, lambda n: ~n["kind"].isin(*CONTAINERS))
    return F.array_join(F.transform(leaves, lambda n: n["raw"]), "")


def params_map(params: Column) -> Column:
    """map<name, value> in which the last of a name counts."""
    entries = F.transform(params, lambda p, i: F.struct(p["name"].alias("name"), p["value"].alias("value"), i.alias("i")))
    last = F.filter(entries, lambda p: ~F.exists(entries, lambda q: (q["name"] == p["name"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], F.trim(p["value"]))))


# The core's names of parser functions and variables, by whether their case counts.
_PAGES = "ARTICLEPAGENAME ARTICLESPACE BASEPAGENAME FULLPAGENAME NAMESPACE PAGENAME ROOTPAGENAME SUBJECTPAGENAME SUBJECTSPACE SUBPAGENAME TALKPAGENAME TALKSPACE".split()
_BOTH = "#bcp47 #contentmodel #dir #isbn CASCADINGSOURCES NAMESPACENUMBER NUMBEROFACTIVEUSERS NUMBEROFADMINS NUMBEROFARTICLES NUMBEROFEDITS NUMBEROFFILES NUMBEROFPAGES NUMBEROFUSERS REVISIONDAY REVISIONDAY2 REVISIONID REVISIONMONTH REVISIONMONTH1 REVISIONTIMESTAMP REVISIONUSER REVISIONYEAR".split()
_FUNCTIONS = "#FORMAL #interlanguagelink #interwikilink CATEGORYSORT DEFAULTCATEGORYSORT DEFAULTSORT DEFAULTSORTKEY DISPLAYTITLE NUMBERINGROUP NUMINGROUP PAGESINCAT PAGESINCATEGORY PAGESIZE PROTECTIONEXPIRY PROTECTIONLEVEL".split()
_FUNCTIONS_ANY_CASE = "#language anchorencode bidi canonicalurl canonicalurle filepath formatnum fullurl fullurle gender grammar int lc lcfirst localurl localurle ns nse padleft padright pageid plural uc ucfirst urlencode".split()
_VARIABLES = "! = CONTENTLANG CONTENTLANGUAGE CURRENTVERSION DIRECTIONMARK DIRMARK PAGELANGUAGE REVISIONSIZE SITENAME USERLANGUAGE".split()
_TIMES = "DAY DAY2 DAYNAME DOW HOUR MONTH MONTH1 MONTH2 MONTHABBREV MONTHNAME MONTHNAMEGEN TIME TIMESTAMP WEEK YEAR".split()
_VARIABLES_ANY_CASE = "#language articlepath pageid scriptpath server servername stylepath".split()
#: Page names come with an E behind too, times with CURRENT and LOCAL before.
_SHARED = [*_BOTH, *_PAGES, *(f"{n}E" for n in _PAGES)]


@dataclass(frozen=True)
class MagicWords:
    """Names of parser functions and variables; a wiki's own are given in place of the core's. Any name with a leading # is a function too."""

    functions: tuple[str, ...] = (*_SHARED, *_FUNCTIONS)
    functions_any_case: tuple[str, ...] = tuple(_FUNCTIONS_ANY_CASE)
    variables: tuple[str, ...] = (*_SHARED, *_VARIABLES, *(f"{when}{n}" for when in ("CURRENT", "LOCAL") for n in _TIMES))
    variables_any_case: tuple[str, ...] = tuple(_VARIABLES_ANY_CASE)


CORE = MagicWords()


def _named(name: Column, exact: tuple[str, ...], any_case: tuple[str, ...]) -> Column:
    return name.isin(*exact) | F.lower(name).isin(*any_case)


def _called(words: MagicWords) -> tuple[Column, Column]:
    """The name of the parser function or variable that a template node calls, null for a template, and what follows its colon.

    One substitution prefix goes, then two modifiers at most; their colons follow them directly. A
    variable is one without parameters only. A colon may be full-width.
    """
    title = F.trim(F.regexp_replace(F.trim("name"), r"^(?i)(?:safe)?subst:", ""))
    variable = (F.coalesce(F.size("params"), F.lit(0)) <= 0) & _named(title, words.variables, words.variables_any_case)
    bare = F.regexp_replace(title, r"^(?i)(?:(?:msg|msgnw|raw):){1,2}", "")
    head, colon = F.regexp_extract(bare, r"^([^:\uFF1A]+)[:\uFF1A]", 1), F.regexp_instr(bare, F.lit(r"[:\uFF1A]"))
    function = bare.startswith("#") | _named(head, words.functions, words.functions_any_case)
    name = F.when(function | variable, F.trim(F.when(colon > 0, F.substr(bare, F.lit(1), colon - 1)).otherwise(bare)))
    return name, F.when(name.isNotNull() & (colon > 0), F.trim(F.substr(bare, colon + F.lit(1), F.char_length(bare))))


def parser_functions(table: DataFrame, words: MagicWords = CORE) -> DataFrame:
    """Template nodes that call a parser function or a variable, with function and argument (null without a colon).

    A variable's name with parameters and no colon is a template. Null names call nothing.
    """
    name, argument = _called(words)
    return table.where("kind = 'template'").withColumns({"function": name, "argument": argument}).where("function is not null")


def templates(table: DataFrame, name: str | Iterable[str] | None = None, words: MagicWords = CORE) -> DataFrame:
    """Templates with their key and parameters; one name or several are compared by key, and calls of parser functions are then left out."""
    from pagelode.functions.titles import template_key

    own = table.where("kind = 'template'").withColumn("key", template_key(F.col("name"))).withColumn("args", params_map(F.col("params")))
    if name is None:
        return own
    names = [name] if isinstance(name, str) else list(name)
    return own.where(F.col("key").isin([template_key(F.lit(n)) for n in names]) & _called(words)[0].isNull()) if names else own.limit(0)


def wikilinks(table: DataFrame) -> DataFrame:
    """Links with target (without fragment), fragment and label."""
    target = F.split("name", "#")
    label = F.get(F.col("params"), F.size("params") - 1)["value"]
    return table.where("kind = 'wikilink'").withColumn("target", F.trim(F.get(target, 0))).withColumn("fragment", F.get(target, 1)).withColumn("label", label)


def categories(table: DataFrame, prefixes: tuple[str, ...] = ("category",)) -> DataFrame:
    """Category links by prefix, whatever its case; a leading colon doesn't hide one."""
    t = F.regexp_replace(F.col("name"), r"^:+\s*", "")
    own = table.where("kind = 'wikilink'").withColumn("category", F.trim(F.regexp_extract(t, rf"^(?i)(?:{'|'.join(prefixes)})\s*:([^#]*)", 1)))
    return own.where("category != ''")


def sections(table: DataFrame, id_col: str) -> DataFrame:
    """Headings as sections: idx, level, title, start, and end at the next heading of the same level or above; the parent's idx, null at the top."""
    run = Window.partitionBy(id_col).orderBy("start")
    own = table.where("kind = 'heading'").select(id_col, "level", F.col("name").alias("title"), "start")
    own = own.withColumn("idx", F.row_number().over(run))
    rest = run.rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(*[F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("start"))).over(rest)) for k in range(1, 7)])
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    parent = F.coalesce(*[F.when(F.col("level") == k, F.max(F.when(F.col("level") < k, F.col("idx"))).over(before)) for k in range(1, 7)])
    return own.withColumn("end", end).withColumn("parent", parent)


def visible_one(text: str) -> str:
    """What a reader sees, roughly: templates, arguments and comments go, links give their label or target."""
    rows = flat(text)
    kids: dict[int, list[dict]] = {}
    for n in rows:
        kids.setdefault(n["parent"], []).append(n)
    hidden = {"template", "argument", "comment"}
    gone = [n for n in rows if n["kind"] in hidden]
    spans = []
    for n in rows:
        if n["kind"] == "wikilink":
            bar = n["raw"].rfind("|") if n["params"] else -1
            spans += [(n["start"], n["start"] + (bar + 1 if bar >= 0 else 2)), (n["end"] - 2, n["end"])]
        elif n["kind"] == "extlink":
            head = len(n["raw"]) - len(n["raw"][1:].partition(" ")[2])
            spans += [(n["start"], n["start"] + head), (n["end"] - 1, n["end"])] if " " in n["raw"] else [(n["start"], n["end"])]
        elif n["kind"] == "heading":
            spans += [(n["start"], n["start"] + n["level"]), (n["end"] - n["level"], n["end"])]
        elif n["kind"] == "tag":
            inner = re.match(r"<[^>]*>(.*)</[^>]*>$", n["raw"], re.S)
            spans += [(n["start"], n["start"] + inner.start(1)), (n["start"] + inner.end(1), n["end"])] if inner else [(n["start"], n["end"])]
    return "".join(_outside(text, [(n["start"], n["end"]) for n in gone] + spans))


def _outside(text: str, spans: list[tuple[int, int]]) -> Iterator[str]:
    at = 0
    for a, b in sorted(spans):
        if a > at:
            yield text[at:a]
        at = max(at, b)
    yield text[at:]


def rewriter(change: Callable[[str], object], schema: str = "string") -> Callable[[Column], Column]:
    """A column function from one of texts; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else change(t) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return lambda column: F.pandas_udf(run, schema)(column)


visible = rewriter(visible_one)


def in_prose(text: str, change: Callable[[str], str]) -> str:
    """A text with its prose changed: not templates, arguments, comments, raw tags, link targets or addresses."""
    out = []
    for n in flat(text):
        if n["kind"] in ("template", "argument", "wikilink", "heading"):
            continue
        plain = n["kind"] == "text" and _prose(n, text)
        out.append(change(n["raw"]) if plain else n["raw"])
    return "".join(out)


def _prose(n: dict, text: str) -> bool:
    """Text at the top, or in a heading."""
    return n["depth"] == 0 or (n["depth"] == 1 and n["raw"].strip("=") != "" and text[n["start"] - 1 : n["start"]] != "[" and not n["raw"].startswith(("[[", "{{")))


# The fixes by name, pattern and literal replacement.
FIXES = {
    "extra-spaces": (r"(?<=\S) {2,}(?=\S)", " "),
    "date-ranges": (r"(?<=\b\d{4})-(?=\d{4}\b)", "\u2013"),
    "ellipsis": (r"(?<!\.)\.{3}(?!\.)", "\u2026"),
}


def outside_raw(text: Column, change: Callable[[Column], Column]) -> Column:
    """A text with all but its comments and raw tags changed, by built-in functions."""
    raw = rf"(?is)<!--.*?(?:-->|\z)|<({RAW})\b[^<>]*?(?:/>|>.*?</\1\s*>)"
    pieces = F.transform(F.split(text, raw), change)
    kept = F.regexp_extract_all(text, F.lit(raw), 0)
    return F.array_join(F.flatten(F.zip_with(pieces, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


# The cosmetic passes that are plain replacements.
COSMETIC = {
    "trailing_whitespace": (r"[ \t]+(?=\n)", ""),
    "extra_blank_lines": (r"\n{4,}", "\n\n\n"),
    "redundant_link_text": (r"\[\[([^\[\]|{}]+)\|\1\]\]", "[[$1]]"),
    "self_closing_br": (r"(?i)<br\s*>", "<br />"),
    "bold": (r"(?i)<b>([^<>\n]+)</b>", "'''$1'''"),
    "italic": (r"(?i)<i>([^<>\n]+)</i>", "''$1''"),
}
SAFE = ("trailing_whitespace", "extra_blank_lines", "redundant_link_text")


def cosmetic(text: Column, passes: tuple[str, ...] = SAFE) -> Column:
    for name in passes:
        text = outside_raw(text, _replacing(*COSMETIC[name]))
    return text


def _replacing(pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda piece: F.regexp_replace(piece, pattern, to)


def would_change(text: Column, passes: tuple[str, ...] = SAFE) -> Column:
    return cosmetic(text, passes) != text


def add_category(text: Column, name: str) -> Column:
    """Adds a category at the end, unless it is there."""
    import re as _re

    there = text.rlike(rf"(?i)\[\[\s*category\s*:\s*{_re.escape(name)}\s*[\]|]")
    return F.when(there, text).otherwise(F.concat(F.rtrim(text), F.lit(f"\n[[Category:{name}]]")))


def remove_category(text: Column, name: str) -> Column:
    import re as _re

    return F.regexp_replace(text, rf"(?i)\[\[\s*category\s*:\s*{_re.escape(name)}\s*(?:\|[^\]]*)?\]\]\n?", "")


def change_category(text: Column, old: str, new: str) -> Column:
    import re as _re

    return F.regexp_replace(text, rf"(?i)(\[\[\s*category\s*:\s*){_re.escape(old)}(\s*(?:\|[^\]]*)?\]\])", f"$1{new}$2")


CELLS = "array<struct<table:int, row:int, col:int, header:boolean, text:string>>"


def table_cells(text: str) -> list[dict]:
    """The cells of a text's tables laid out on a grid: a cell that spans rows or columns stands in each."""
    out: list[dict] = []
    tables: list[dict] = []
    n = 0

    def add(t: dict, body: str, header: bool) -> None:
        attrs, bar, rest = body.partition("|")
        if not bar or "[[" in attrs or "{{" in attrs:
            attrs, rest = "", body
        span = lambda k: int(m[1]) if (m := re.search(rf'{k}\s*=\s*"?(\d+)', attrs)) else 1
        t["cells"].append({"row": max(t["row"], 0), "header": header, "text": rest.strip(), "rows": span("rowspan"), "cols": max(1, min(span("colspan"), 1000))})

    def close(t: dict) -> None:
        last = max((c["row"] for c in t["cells"]), default=0)
        taken: set[tuple[int, int]] = set()
        for c in t["cells"]:
            col = 0
            while (c["row"], col) in taken:
                col += 1
            down = last - c["row"] + 1 if c["rows"] == 0 else min(c["rows"], last - c["row"] + 1)
            for r in range(c["row"], c["row"] + down):
                for k in range(col, col + c["cols"]):
                    taken.add((r, k))
                    out.append({"table": t["no"], "row": r, "col": k, "header": c["header"], "text": c["text"]})

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("{|"):
            tables.append({"no": n, "row": -1, "cells": []})
            n += 1
        elif not tables:
            continue
        elif s.startswith("|}"):
            close(tables.pop())
        elif s.startswith("|-"):
            t = tables[-1]
            t["row"] = max(t["row"], 0) + (1 if any(c["row"] == max(t["row"], 0) for c in t["cells"]) else 0)
        elif s.startswith("|+"):
            continue
        elif s.startswith(("|", "!")):
            header = s[0] == "!"
            for body in re.split(r"\|\||!!" if header else r"\|\|", s[1:]):
                add(tables[-1], body, header)
        elif tables[-1]["cells"]:
            tables[-1]["cells"][-1]["text"] = (tables[-1]["cells"][-1]["text"] + "\n" + s).strip()
    while tables:
        close(tables.pop())
    return sorted(out, key=lambda c: (c["table"], c["row"], c["col"]))


def tables(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each cell of the tables' grids; texts without a table are not sent to the parser."""
    own = F.when(F.col(text_col).contains("{|"), rewriter(table_cells, CELLS)(F.col(text_col)))
    return df.select(id_col, F.explode(own).alias("c")).select(id_col, "c.*")


def unified_diff(before: Column, after: Column, title: str = "page", context: int = 3) -> Column:
    """A unified line diff; empty where texts are equal. Hunks are one library's choice, not a standard's."""
    import difflib

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), title, title, lineterm="", n=context)) for x, y in zip(a, b)], dtype=object)

    return run(before, after)


def proofread_parts(text: Column) -> Column:
    """struct<header, body, footer> of a proofread page."""
    form = r"(?s)^<noinclude>(.*?)</noinclude>(.*?)(?:<noinclude>(.*?)</noinclude>\s*)?$"
    got = lambda i: F.regexp_extract(text, form, i)
    return F.when(text.rlike(form), F.struct(got(1).alias("header"), got(2).alias("body"), got(3).alias("footer"))).otherwise(F.struct(F.lit("").alias("header"), text.alias("body"), F.lit("").alias("footer")))


def sorted_language_links(languages: tuple[str, ...]) -> Callable[[Column], Column]:
    """Puts a page's language links in order of code, each in a slot that one held before."""

    def change(text: str) -> str:
        own = [n for n in flat(text) if n["kind"] == "wikilink" and n["depth"] == 0 and n["name"].partition(":")[0].strip().lower() in languages]
        out, at = [], 0
        for slot, link in zip(own, sorted(own, key=lambda n: n["name"].partition(":")[0].strip().lower())):
            out += [text[at : slot["start"]], link["raw"]]
            at = slot["end"]
        return "".join(out) + text[at:]

    return rewriter(change)
