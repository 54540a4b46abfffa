"""Edits of pages as rows: node edits, text scopes and replacements in scope.

Everything here works on a node table (wikitext.whole_table or node_table), made by one parse and best
written or cached, as it is read more than once. An edit is a row: page id, start, end and text; end
equals start where text is put in. Edits of one page may nest: one that lies inside another is settled by
interval containment, the outer one stands. The new text of a page is spliced from the leaves between its
edits and the edits' texts, in order; pages without an edit aren't touched.

All windows run inside a page. Null texts stay null. Page ids must be unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions.scalars import placed_matches, to_isbn13
from pagelode.functions.titles import template_key
from pagelode.functions.wikitext import CONTAINERS, FIXES, templates


def of_nodes(nodes: DataFrame, where: Column, text: Column | str | None, id_col: str = "page_id") -> DataFrame:
    """Edits that put a text in the place of each node that a condition holds for; None removes it."""
    new = F.lit(text or "") if text is None or isinstance(text, str) else text
    return nodes.where(where).select(id_col, "start", "end", new.alias("text"))


def settled(edits: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The edits that lie inside no other; of several with one span the first by text. Equal insertions count once."""
    order = Window.partitionBy(id_col).orderBy("start", (F.col("end") > F.col("start")), F.desc("end"), "text")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return edits.distinct().withColumn("_covered", covered).where("_covered is null or _covered <= start").drop("_covered")


def spliced(nodes: DataFrame, edits: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page id, text) of the pages that have edits.

    Each page's leaves and the ends of its edits are put in order; a piece runs from one place to the
    next, and is left out where an edit covers it.
    """
    own = settled(edits.select(id_col, "start", "end", "text"), id_col)
    leaves = nodes.where(~F.col("kind").isin(*CONTAINERS)).join(own.select(id_col).distinct(), id_col, "left_semi")
    leaf = leaves.select(id_col, F.col("start").alias("at"), F.lit(0).alias("rank"), F.struct("start", "raw").alias("leaf"), F.lit(None).cast("int").alias("until"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast(leaf.schema["leaf"].dataType)
    begin = own.select(id_col, F.col("start").alias("at"), F.when(F.col("end") > F.col("start"), 2).otherwise(1).alias("rank"), none.alias("leaf"), F.col("end").alias("until"), "text")
    end = own.where("end > start").select(id_col, F.col("end").alias("at"), F.lit(0).alias("rank"), none.alias("leaf"), F.lit(None).cast("int").alias("until"), F.lit(None).cast("string").alias("text"))
    page = Window.partitionBy(id_col).orderBy("at", "rank", F.col("leaf").isNull())
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = leaf.unionByName(begin).unionByName(end).select(
        "*", F.last("leaf", ignorenulls=True).over(so_far).alias("of"), F.coalesce(F.max("until").over(so_far), F.lit(0)).alias("covered"), F.lead("at").over(page).alias("next"), F.row_number().over(page).alias("no")
    )
    stop = F.coalesce("next", F.col("of.start") + F.char_length("of.raw"))
    kept = F.when(F.col("covered") <= F.col("at"), F.substr("of.raw", F.col("at") - F.col("of.start") + 1, stop - F.col("at")))
    pieces = rows.select(id_col, "no", F.concat(F.coalesce("text", F.lit("")), F.coalesce(kept, F.lit(""))).alias("piece")).where("piece != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda x: x["piece"]), "")
    new = pieces.groupBy(id_col).agg(joined.alias("text"))
    return own.select(id_col).distinct().join(new, id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


def applied(pages: DataFrame, nodes: DataFrame, edits: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """The pages with their edits made. nodes are those of the pages' texts."""
    new = spliced(nodes, edits, id_col).withColumn("_edited", F.lit(True)).withColumnRenamed("text", "_new")
    out = pages.join(new, id_col, "left").withColumn(text_col, F.when(F.col("_edited"), F.col("_new")).otherwise(F.col(text_col)))
    return out.drop("_edited", "_new").select(*pages.columns)


def like(raw: str, kind: str) -> Column:
    """The nodes of a kind that are written so; nested ones count."""
    return (F.col("kind") == kind) & (F.col("raw") == raw)


def rename_templates(nodes: DataFrame, names: Iterable[str], to: Column | str, id_col: str = "page_id") -> DataFrame:
    """Edits that call another template; white space about the name stays."""
    slot = F.get(F.filter("slots", lambda s: s["role"] == "name"), 0)
    old = F.substr("raw", slot["start"] - F.col("start") + 1, slot["end"] - slot["start"])
    lead = F.char_length(old) - F.char_length(F.regexp_replace(old, r"^\s+", ""))
    text = F.lit(to) if isinstance(to, str) else to
    trail = F.char_length(old) - F.char_length(F.regexp_replace(old, r"\s+$", ""))
    return templates(nodes, list(names)).where(slot.isNotNull()).select(id_col, (slot["start"] + lead).alias("start"), (slot["end"] - trail).alias("end"), text.alias("text"))


def set_parameter(nodes: DataFrame, names: Iterable[str], name: str, value: Column | str, id_col: str = "page_id") -> DataFrame:
    """Edits that give a parameter of templates a value: the last one of that name keeps its white space, or a new one comes at the end."""
    new = F.lit(value) if isinstance(value, str) else value
    calls = templates(nodes, list(names))
    own = F.filter("params", lambda p: p["name"] == name)
    last = F.get(own, F.size(own) - 1)
    raw = F.substr("raw", last["start"] - F.col("start") + 1, last["end"] - last["start"])
    numbered = F.lit(name).rlike(r"^\d+$") & ~raw.rlike(rf"^\s*{name}\s*=")
    head = F.when(numbered, 0).otherwise(F.instr(raw, "="))
    rest = F.substr(raw, head + 1, F.char_length(raw))
    lead = F.when(numbered, 0).otherwise(F.char_length(rest) - F.char_length(F.regexp_replace(rest, r"^\s+", "")))
    trail = F.when(numbered | (F.trim(rest) == ""), 0).otherwise(F.char_length(rest) - F.char_length(F.regexp_replace(rest, r"\s+$", "")))
    found = F.coalesce(F.size(own), F.lit(0)) > 0
    start = F.when(found, last["start"] + head + lead).otherwise(F.col("end") - 2)
    end = F.when(found, last["end"] - trail).otherwise(F.col("end") - 2)
    return calls.select(id_col, start.alias("start"), end.alias("end"), F.when(found, new).otherwise(F.concat(F.lit(f"|{name}="), new)).alias("text"))


def drop_parameter(nodes: DataFrame, names: Iterable[str], name: str, id_col: str = "page_id") -> DataFrame:
    """Edits that take every parameter of a name out of templates, with the bar before it."""
    own = F.explode(F.filter("params", lambda p: p["name"] == name)).alias("p")
    return templates(nodes, list(names)).select(id_col, own).select(id_col, (F.col("p.start") - 1).alias("start"), F.col("p.end").alias("end"), F.lit("").alias("text"))


def map_templates(nodes: DataFrame, names: Iterable[str], rename: str | None = None, parameters: Mapping[str, Column | str | None] | None = None, id_col: str = "page_id") -> DataFrame:
    """Edits of all templates of some names, nested ones too: another name, parameters set, or dropped where the value is None.

    Only the spans that change are edited, so a template inside a parameter that stays can be edited as well.
    """
    parts = [] if rename is None else [rename_templates(nodes, names, rename, id_col)]
    parts += [drop_parameter(nodes, names, k, id_col) if v is None else set_parameter(nodes, names, k, v, id_col) for k, v in (parameters or {}).items()]
    out = nodes.limit(0).select(id_col, "start", "end", F.lit("").alias("text"))
    for part in parts:
        out = out.unionByName(part)
    return out


def map_nodes(nodes: DataFrame, change: Callable[[Column, Column, Column], Column], id_col: str = "page_id") -> DataFrame:
    """(page id, text): every page with each node rewritten, the inner ones first.

    change takes a node's kind, its name and its source, in which the nodes inside are already rewritten,
    and gives the new source. Text nodes are given as a whole only at the top of a page, else in parts of
    their own, without the marks about them. Raw tags are given as they are, and nothing inside them.

    One round for each level of nesting, from the deepest; a round touches the nodes of its level only.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select(id_col, F.lit("").alias("text")).limit(0)
    # text changes inside its slots: the pieces between them are marks
    leaf = nodes.where(~F.col("kind").isin(*CONTAINERS))
    cut = F.transform("slots", lambda s: F.substr(F.col("raw"), s["start"] - F.col("start") + 1, s["end"] - s["start"]))
    before = F.transform(
        "slots",
        lambda s, i: F.substr(F.col("raw"), F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("slots"), i - 1)["end"] - F.col("start")) + 1, s["start"] - F.when(i == 0, F.col("start")).otherwise(F.get(F.col("slots"), i - 1)["end"])),
    )
    tail = F.substr("raw", F.get("slots", F.size("slots") - 1)["end"] - F.col("start") + 1, F.char_length("raw"))
    changed = F.transform(F.arrays_zip(before.alias("mark"), cut.alias("text")), lambda x: F.concat(x["mark"], change(F.lit("text"), F.lit(None).cast("string"), x["text"])))
    text = F.when(F.size("slots") > 0, F.concat(F.array_join(changed, ""), tail)).otherwise(F.col("raw"))
    level = leaf.select(id_col, "parent", "depth", "start", F.when(F.col("kind") == "text", text).otherwise(change(F.col("kind"), F.col("name"), F.col("raw"))).alias("new"))
    boxes = nodes.where(F.col("kind").isin(*CONTAINERS)).select(id_col, "id", "parent", "depth", "start", "kind", "name")
    inner = lambda rows: rows.groupBy(id_col, F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "new"))), lambda x: x["new"]), "").alias("inside"))
    held = level.where(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):
        done = boxes.where(F.col("depth") == depth).join(inner(held), [id_col, "id"]).select(id_col, "parent", "depth", "start", change(F.col("kind"), F.col("name"), F.col("inside")).alias("new"))
        held = level.where(F.col("depth") == depth).unionByName(done)
    return inner(held).select(id_col, F.col("inside").alias("text"))


@dataclass(frozen=True)
class Scope:
    """Which text counts: what is false is left out, at any depth."""

    templates: bool = False
    link_targets: bool = False
    comments: bool = False
    raw_tags: bool = False
    headings: bool = True
    tag_attributes: bool = False


PROSE = Scope()
EVERYWHERE = Scope(**{f.name: True for f in fields(Scope)})


def _regions(nodes: DataFrame, id_col: str) -> DataFrame:
    """(page id, start, end, flag): the spans that each flag of a scope is about."""
    kinds = {"template": "templates", "comment": "comments", "tag": "raw_tags", "heading": "headings"}
    whole = nodes.where(F.col("kind").isin(*kinds)).select(id_col, "start", "end", F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("kind")].alias("flag"))
    roles = F.when((F.col("kind") == "wikilink") & (F.col("s.role") == "target"), "link_targets").when((F.col("kind") == "argument") & (F.col("s.role") == "name"), "templates").when((F.col("kind") == "tag") & (F.col("s.role") == "attribute"), "tag_attributes")
    part = nodes.where(F.col("kind").isin("wikilink", "argument", "tag")).select(id_col, "kind", F.explode("slots").alias("s")).select(id_col, "s.start", "s.end", roles.alias("flag")).where("flag is not null")
    return whole.unionByName(part)


def pieces(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page id, start, end, role, text and a flag for each field of a scope): all pieces of text, in which no markup is.

    A flag tells whether the piece lies in a region of its kind, whatever lies between: regions and pieces of
    a page are put in order of place, and a piece is inside if one that began before ends after its start.
    """
    names = [f.name for f in fields(Scope)]
    found = nodes.where(~F.col("kind").isin(*CONTAINERS)).select(id_col, F.col("start").alias("_from"), "raw", F.explode("slots").alias("s"))
    found = found.select(id_col, "s.start", "s.end", "s.role", F.substr("raw", F.col("s.start") - F.col("_from") + 1, F.col("s.end") - F.col("s.start")).alias("text"), F.lit(None).cast("string").alias("flag"))
    marks = _regions(nodes, id_col).select(id_col, "start", "end", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "flag")
    order = Window.partitionBy(id_col).orderBy("start", F.col("flag").isNull())
    within = {n: F.coalesce(F.max(F.when(F.col("flag") == n, F.col("end"))).over(order) > F.col("start"), F.lit(False)) for n in names}
    return found.unionByName(marks).withColumns(within).where("flag is null").drop("flag")


def text_in(nodes: DataFrame, scope: Scope = PROSE, id_col: str = "page_id") -> DataFrame:
    """(page id, start, end, role, text): the pieces of text that a scope allows."""
    shut = [f.name for f in fields(Scope) if not getattr(scope, f.name)]
    own = pieces(nodes, id_col)
    for name in shut:
        own = own.where(~F.col(name))
    return own.select(id_col, "start", "end", "role", "text")


def contains_text(nodes: DataFrame, pattern: str, scope: Scope = PROSE, id_col: str = "page_id") -> DataFrame:
    """The ids of pages with a piece of text in scope that matches a pattern."""
    return text_in(nodes, scope, id_col).where(F.col("text").rlike(pattern)).select(id_col).distinct()


def replace_text(nodes: DataFrame, pattern: str, to: Column | str, scope: Scope = PROSE, id_col: str = "page_id") -> DataFrame:
    """Edits of the pieces of text in scope that a pattern changes; a string is literal, a column may refer to groups."""
    new = F.regexp_replace("text", F.lit(pattern), to if isinstance(to, Column) else F.lit(to.replace("\\", "\\\\").replace("$", "\\$")))
    return rewritten(nodes, lambda text: new, scope, id_col)


def rewritten(nodes: DataFrame, change: Callable[[Column], Column], scope: Scope = PROSE, id_col: str = "page_id") -> DataFrame:
    """Edits of the pieces of text in scope that a function of a column changes."""
    return text_in(nodes, scope, id_col).withColumn("new", change(F.col("text"))).where("new != text").select(id_col, "start", "end", F.col("new").alias("text"))


def fixed(*names: str) -> Callable[[Column], Column]:
    """The fixes of some names, one after the other, for rewritten()."""
    for name in names:
        if name not in FIXES:
            raise ValueError(f"no fix is named {name!r}: choose from {sorted(FIXES)}")

    def change(text: Column) -> Column:
        for name in names:
            text = F.regexp_replace(text, *FIXES[name])
        return text

    return change


def unlink(nodes: DataFrame, target: str, fold_first: bool = True, id_col: str = "page_id") -> DataFrame:
    """Edits that take the link off a page's mentions: the label or target stays, with what is inside it."""
    norm = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(t, "#", 1), r"^\s*:", ""), r"[\s_]+", " "))
    fold = (lambda t: template_key(norm(t))) if fold_first else norm
    kept = F.coalesce(F.get("params", 0)["start"], F.col("start") + 2)
    own = nodes.where((F.col("kind") == "wikilink") & (fold(F.col("name")) == fold(F.lit(target))))
    before = own.select(id_col, "start", kept.alias("end"), F.lit("").alias("text"))
    return before.unionByName(own.select(id_col, (F.col("end") - 2).alias("start"), "end", F.lit("").alias("text")))


def replace_matches(nodes: DataFrame, pattern: str, change: Callable[[Column], Column], scope: Scope = PROSE, id_col: str = "page_id") -> DataFrame:
    """Edits of the matches of a pattern in scope, each by what a function of the match gives; null leaves it."""
    hit = F.explode(placed_matches(F.col("text"), pattern)).alias("m")
    own = text_in(nodes, scope, id_col).select(id_col, "start", hit).select(id_col, (F.col("start") + F.col("m.start")).alias("start"), F.col("m.text").alias("hit"))
    return own.withColumn("text", change(F.col("hit"))).where("text != hit").select(id_col, "start", (F.col("start") + F.char_length("hit")).alias("end"), "text")


def isbns_as_13(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Edits that write valid ten-digit ISBNs in prose as their thirteen digits."""
    head = lambda m: F.regexp_extract(m, r"^ISBN:? ", 0)
    return replace_matches(nodes, r"\bISBN:? (?:\d[- ]?){9}[\dXx]\b", lambda m: F.concat(head(m), to_isbn13(F.regexp_replace(m, r"^ISBN:? ", ""))), id_col=id_col)


def _sections(nodes: DataFrame, id_col: str) -> DataFrame:
    """The sections of pages' top level: idx, level, title, start, body (where the heading ends), next (heading's start, or the page's end) and stop (where its subsections end too)."""
    ends = nodes.groupBy(id_col).agg(F.max("end").alias("page_end"))
    own = nodes.where("kind = 'heading' and depth = 0").select(id_col, "level", F.col("name").alias("title"), "start", F.col("end").alias("body")).join(ends, id_col)
    run = Window.partitionBy(id_col).orderBy("start")
    rest = run.rowsBetween(1, Window.unboundedFollowing)
    stop = F.coalesce(*[F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("start"))).over(rest)) for k in range(1, 7)], "page_end")
    return own.withColumns({"idx": F.row_number().over(run), "next": F.coalesce(F.lead("start").over(run), "page_end"), "stop": stop})


def replace_section(nodes: DataFrame, title: str, content: Column | str, id_col: str = "page_id") -> DataFrame:
    """Edits that give the first section of a title other content; its heading stays, its subsections go."""
    new = F.lit(content) if isinstance(content, str) else content
    first = _sections(nodes, id_col).where(F.col("title") == title).groupBy(id_col).agg(F.min(F.struct("start", "body", "stop")).alias("s"))
    text = F.concat(F.lit("\n"), F.regexp_replace(new, r"^\n+|\n+$", ""), F.lit("\n"))
    return first.select(id_col, F.col("s.body").alias("start"), F.col("s.stop").alias("end"), text.alias("text"))


def drop_empty_sections(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Edits that take out sections with nothing in them, not even in their subsections. A comment is something."""
    own = _sections(nodes, id_col)
    inside = nodes.where((F.col("depth") == 0) & (F.col("kind") != "heading") & F.col("raw").rlike(r"\S")).select(id_col, F.col("end").alias("at"), F.lit(True).alias("full"))
    # what stands before the next heading and ends after this one's belongs to this section
    places = own.select(id_col, F.col("body").alias("at"), "start").unionByName(inside, allowMissingColumns=True)
    order = Window.partitionBy(id_col).orderBy("at", F.col("start").isNull())
    full = places.withColumn("start", F.last("start", ignorenulls=True).over(order)).where("full and start is not null").select(id_col, "start").distinct().withColumn("full", F.lit(True))
    rest = Window.partitionBy(id_col).orderBy("start").rowsBetween(0, Window.unboundedFollowing)
    marked = own.join(full, [id_col, "start"], "left").withColumn("filled", F.min(F.when(F.col("full"), F.col("start"))).over(rest))
    gone = marked.where("filled is null or filled >= stop")
    return gone.select(id_col, "start", F.col("next").alias("end"), F.lit("").alias("text"))


def decode_entities(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Edits that write HTML entities as characters where that can't be read as markup or as a space: printable ones above ASCII.

    Names are those of HTML 5 that stand for one character, a table of fixed size.
    """
    from html import unescape
    from html.entities import html5

    fits = lambda c: len(c) == 1 and ord(c) >= 128 and c.isprintable() and not c.isspace()
    named = [(k[:-1], c) for k, c in html5.items() if k.endswith(";") and fits(c)]
    named += [(f"#{n}", c) for n in range(128, 160) if fits(c := unescape(f"&#{n};"))]  # these mean other characters
    table = F.broadcast(nodes.sparkSession.createDataFrame(named, "key string, named string"))
    number = F.when(F.col("name").rlike("^#[xX]"), F.conv(F.substring("name", 3, 9), 16, 10)).when(F.col("name").startswith("#"), F.substring("name", 2, 9)).try_cast("long")
    own = nodes.where("kind = 'entity'").select(id_col, "start", "end", "raw", number.alias("n"), F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"))).otherwise(F.col("name")).alias("key"))
    code = F.when(F.col("n").between(160, 0x10FFFF) & ~F.col("n").between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex("n"), 8, "0")), "UTF-32"))
    char = F.coalesce("named", F.when(code.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S}]$"), code))
    return own.join(table, "key", "left").withColumn("text", char).where("text is not null").select(id_col, "start", "end", "text")
