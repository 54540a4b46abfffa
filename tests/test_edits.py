"""Node edits and text scopes on odd pages."""

import random

from pyspark.sql import functions as F

from pagelode.functions import wikitext
from pagelode.operators import edits

PARTS = ["{{", "}}", "[[", "]]", "|", "=", "a", "b ", "<!--", "-->", "<nowiki>", "</nowiki>", '<pre x="1 2">', "</pre>", "\n", "== h ==", "{{{", "}}}", "[http://a b c]", "&amp;", "é", "\U0001f600"]


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")


def by_id(df):
    return {r.page_id: r.text for r in df.collect()}


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_no_edit_changes_nothing(spark):
    rows = pages(spark, [None, "", "plain", *fuzz(60, 1)])
    nodes = wikitext.whole_table(rows, "page_id").cache()
    want = by_id(rows)
    none = edits.of_nodes(nodes, F.lit(False), "x")
    assert by_id(edits.applied(rows, nodes, none)) == want
    same = edits.of_nodes(nodes, F.lit(True), F.col("raw"))  # each node by itself
    assert by_id(edits.applied(rows, nodes, same)) == want
    kept = edits.map_nodes(nodes, lambda kind, name, raw: raw)
    assert by_id(kept) == {k: v for k, v in want.items() if v}
    assert edits.map_nodes(nodes.limit(0), lambda kind, name, raw: raw).count() == 0


def test_splices_are_those_of_a_plain_version(spark):
    texts = fuzz(40, 2) + ["abcdef"]
    rng = random.Random(3)
    made = []
    for i, t in enumerate(texts):
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, len(t))
            b = min(len(t), a + rng.choice([0, 0, 1, 3, 10]))
            own = [e for e in made if e[0] == i]
            if all(b <= e[1] or a >= e[2] or (e[1] <= a and b <= e[2]) or (a <= e[1] and e[2] <= b) for e in own):  # nested, or apart
                made.append((i, a, b, rng.choice(["", "X", "long\n"])))
    rows = pages(spark, texts)
    table = spark.createDataFrame(made, "page_id long, start int, end int, text string")
    got = by_id(edits.applied(rows, wikitext.whole_table(rows, "page_id"), table))
    for i, t in enumerate(texts):
        own = sorted({e[1:] for e in made if e[0] == i}, key=lambda e: (e[0], e[1] > e[0], -e[1], e[2]))
        out, at = "", 0
        for a, b, new in own:
            if a >= at:
                out, at = out + t[at:a] + new, b
        assert got[i] == out + t[at:], (t, own)


def test_scopes_nest(spark):
    text = "a {{t|b [[c|d <!-- e -->]] {{{f|g}}}}} <pre k='h'>i</pre>\n== j {{l}} ==\n{{{m|n}}} [//o.p q] &amp; [[r]]"
    nodes = wikitext.whole_table(pages(spark, [text]), "page_id").cache()
    got = lambda scope: "".join(r.text for r in sorted(edits.text_in(nodes, scope).collect(), key=lambda r: r.start) if r.text.strip()).replace(" ", "").strip()
    assert got(edits.PROSE) == "a\njnq"[:1] + "jnq"
    assert got(edits.Scope(templates=True)) == "atbdfgjlmnq"
    assert got(edits.Scope(templates=True, comments=True)) == "atbdefgjlmnq"
    assert got(edits.Scope(link_targets=True)) == "ajnqr"  # a link in a template stays out
    assert got(edits.Scope(raw_tags=True)) == "aijnq" and got(edits.Scope(raw_tags=True, tag_attributes=True)) == "ahijnq"
    assert got(edits.Scope(headings=False)) == "anq"
    assert got(edits.EVERYWHERE) == "atbcdefghijlmnqr"


def test_parameters(spark):
    rows = pages(spark, ["{{a|x|2=y}}", "{{A|1=z| n = 1 |n=2\n}}", "{{a}}", "{{b|n=1}}", "{{a|{{a|n=3}}}}"])
    nodes = wikitext.whole_table(rows, "page_id").cache()
    done = by_id(edits.applied(rows, nodes, edits.set_parameter(nodes, ["a"], "n", "N")))
    assert done == {0: "{{a|x|2=y|n=N}}", 1: "{{A|1=z| n = 1 |n=N\n}}", 2: "{{a|n=N}}", 3: "{{b|n=1}}", 4: "{{a|{{a|n=N}}|n=N}}"}
    done = by_id(edits.applied(rows, nodes, edits.set_parameter(nodes, ["a"], "1", "N")))
    assert done == {0: "{{a|N|2=y}}", 1: "{{A|1=N| n = 1 |n=2\n}}", 2: "{{a|1=N}}", 3: "{{b|n=1}}", 4: "{{a|N}}"}
    done = by_id(edits.applied(rows, nodes, edits.drop_parameter(nodes, ["a"], "n")))
    assert done == {0: "{{a|x|2=y}}", 1: "{{A|1=z}}", 2: "{{a}}", 3: "{{b|n=1}}", 4: "{{a|{{a}}}}"}


def test_unlink_keeps_what_is_inside(spark):
    rows = pages(spark, ["[[a b#x|''l'' {{t}}]] [[A_b]] [[:a  b|]] [[c|[[a b]]]]", "[[a b"])
    nodes = wikitext.whole_table(rows, "page_id").cache()
    assert by_id(edits.applied(rows, nodes, edits.unlink(nodes, "a b")))[0] == "''l'' {{t}} A_b  [[c|a b]]"
