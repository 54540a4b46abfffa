"""Content as of a time, ordered and damaged dumps, signatures by place, written claims."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from pagelode.functions import dates
from pagelode.operators import activity, entities
from pagelode.sources import dump


def test_content_at_is_a_plain_search(spark):
    rng = random.Random(4)
    # page 0 has a third of all revisions; times repeat
    revs = [(p if rng.random() > 0.33 else 0, rng.randint(0, 500), i, f"t{i}", "x") for i, p in enumerate(rng.choices(range(20), k=600))] + [(None, 3, 900, "n", "x"), (1, None, 901, "n", "x")]
    asked = [(i, rng.randint(0, 22), rng.randint(-5, 520), "own") for i in range(300)] + [(300, None, 4, "own"), (301, 0, None, "own"), (302, 0, 100, "own"), (302, 0, 100, "own")]
    r = spark.createDataFrame(revs, "page_id long, ts int, rev_id long, text string, asked string")
    a = spark.createDataFrame(asked, "i int, page_id long, at int, note string")
    for width in (None, 1, 50, 10_000):
        got = sorted((x.i, x.rev_id, x.text, x.note) for x in activity.content_at(r, a, width).collect())
        want = []
        for i, p, t, _ in asked:
            best = max(((ts, rev, text) for q, ts, rev, text, _ in revs if q == p and None not in (q, ts, t) and ts <= t), default=(None, None, None))
            want.append((i, best[1], best[2], "own"))
        assert got == sorted(want, key=lambda x: (x[0], x[1] or 0)), width
    assert activity.content_at(r.limit(0), a).where("rev_id is not null").count() == 0 and activity.content_at(r, a.limit(0)).count() == 0
    stamps = activity.content_at(r.withColumn("ts", F.timestamp_seconds("ts")), a.withColumn("at", F.timestamp_seconds("at")))
    assert sorted((x.i, x.rev_id) for x in stamps.collect()) == [(i, rev) for i, rev, *_ in sorted(want, key=lambda x: (x[0], x[1] or 0))]


def test_histories_by_namespace(spark):
    r = spark.createDataFrame([(1, 1, 0, 5, None), (2, 1, 1, 6, "u"), (3, 2, 1, 7, "v")], "rev_id int, page_id int, ns int, ts int, user string")
    assert [x.rev_id for x in activity.history(r, namespaces=[1]).collect()] == [3, 2]


def xml(i, text="x"):
    return f"<page><title>T{i}</title><ns>0</ns><id>{i}</id><revision><id>{i}</id><text>{text}</text></revision></page>\n"


def body(n, seed):
    rng = random.Random(seed)
    return "<mediawiki>\n" + "".join(xml(i, "".join(rng.choices("abcdefghij klmnop", k=rng.randint(100, 3000)))) for i in range(n)) + "</mediawiki>\n"


@pytest.mark.parametrize("kind", ["xml", "xml.bz2", "xml.gz"])
def test_order_is_the_sequential_one(spark, tmp_path, kind):
    pack = {"xml": bytes, "xml.bz2": lambda b: bz2.compress(b, 1), "xml.gz": gzip.compress}[kind]
    for name, n in (("a", 400), ("b", 90)):
        (tmp_path / f"{name}.{kind}").write_bytes(pack(body(n, n).encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        own = dump.read(spark, f"{tmp_path}/*.{kind}")
        got = own.saved(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    splits = got.select("file", "block").distinct().count()
    assert splits > 4 or kind == "xml.gz"
    assert [r.page_id for r in got.orderBy("file", "block", "place").collect()] == [*range(400), *range(90)]
    assert got.columns == dump.pages(spark, f"{tmp_path}/*.{kind}").columns
    assert own.pages._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_damage_is_found_by_the_one_read(spark, tmp_path):
    whole = body(200, 1).encode()
    damaged = {
        "cut.xml.bz2": (bz2.compress(whole[:-20] + b"   "), "cut off"), "cut.xml": (whole[: whole.index(b"</page>", 9000) + 8], "cut off"), "dtd.xml": (b'<?xml version="1.0"?>\n<!DOCTYPE x []>' + whole, "document type"),
        "odd.xml": (whole.replace(b"</page>\n<page><title>T7<", b"</page >\n<page><title>T7<"), "end tag"), "letters.xml": (whole.replace(b"<text>", b"<text>\xff\xfe", 1), "UTF-8"),
        "broken.xml.bz2": (bz2.compress(whole)[:-200], ""), "flipped.xml.bz2": (bz2.compress(whole)[:3000] + b"\x00\x00\x00" + bz2.compress(whole)[3003:], ""), "none.xml": (b"", "cut off"),
    }
    for name, (data, says) in damaged.items():
        folder = tmp_path / name.replace(".", "-")
        folder.mkdir()
        (folder / f"good é.{name.split('.', 1)[1]}").write_bytes(bz2.compress(whole) if name.endswith("bz2") else whole)
        assert dump.read(spark, str(folder)).saved(f"{tmp_path}/{name}-good").count() == 200
        (folder / name).write_bytes(data)
        with pytest.raises(Exception) as got:  # noqa: PT011  the codec's own errors too
            dump.read(spark, str(folder)).saved(f"{tmp_path}/{name}-out")
        assert says in str(got.value) or "MALFORMED" in str(got.value), name


def test_large_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dump, "LARGEST", 5000)
    (tmp_path / "d.xml").write_text("<mediawiki>" + xml(1, "y" * 6000) + "</mediawiki>")
    with pytest.raises(dump.DumpFormatError, match="over 5000"):
        dump.read(spark, str(tmp_path / "d.xml")).saved(f"{tmp_path}/out")


def test_signature_places(spark):
    texts = ["é<!-- 10:00, 1 May 2020 (UTC)-->10:00, 1 May 2020 (UTC) x 1 mai 2020 à 10:00 (UTC)😀12:00, 31 February 2020 (UTC) 11:00, 2 May 2020 (UTC)", "<!-- 10:00, 1 May 2020 (UTC)", None, "a [2020-05-01 b] 10:00, 1 May 2020 (UTC)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in rows.select("i", dates.signatures(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert all(t[s.start : s.end] == s.text for s in got[i])
    assert [(s.language, s.ts.day) for s in got[0]] == [("en", 1), ("fr", 1), ("en", 2)] and got[1] == got[2] == []
    numbers = {"iso": [f"{i:02d}" for i in range(1, 13)]}
    fixed = [("iso", r"\[(\d{4})-(\d{2})-(\d{2}) ()()b\]", "yMdhi")]
    assert rows.select(dates.signatures(F.col("text"), formats=fixed, months=numbers).alias("s")).where("size(s) > 0").count() == 0  # no hour
    fixed = [("iso", r"(\d{2}):(\d{2}), (\d) (May) (\d{4})", "hidMy")]
    assert [len(r.s) for r in rows.orderBy("i").select(dates.signatures(F.col("text"), formats=fixed, months={"iso": dates.MONTHS["en"]}).alias("s")).collect()] == [2, 0, 0, 1]


def test_claims_come_back(spark):
    snak = '{"snaktype":"value","property":"P%d","datatype":"quantity","datavalue":{"value":{"amount":"+12345678901234567890","unit":"1"},"type":"quantity"}}'
    claim = '{"mainsnak":%s,"type":"statement","qualifiers":{"P9":[%s,%s],"P3":[{"snaktype":"novalue","property":"P3"}]},"qualifiers-order":["P9","P3"],"id":"Q1$a\\"b","rank":"preferred","references":[{"snaks":{"P5":[%s]}},{"snaks":{"P4":[%s]}}]}'
    one = claim % (snak % 1, snak % 9, '{"snaktype":"somevalue","property":"P9"}', snak % 5, snak % 4)
    json = '{"type":"item","id":"Q1","labels":{"en":{"language":"en","value":"a \\"q\\" \\\\ é"}},"descriptions":{},"aliases":{"en":[{"language":"en","value":"x"},{"language":"en","value":"w"}]},"claims":{"P7":[%s],"P1":[%s,%s]},"sitelinks":{"enwiki":{"site":"enwiki","title":"T"}}}' % (one, one, '{"mainsnak":{"snaktype":"novalue","property":"P1"},"type":"statement","rank":"normal"}')
    bare = '{"type":"property","id":"P1","labels":{"en":{"language":"en","value":"p"}}}'
    first = entities.decode(spark.createDataFrame([(json,), (bare,)], "json string"))
    again = entities.decode(entities.encode(first).drop("id"))
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    written = {r.id: r.json for r in entities.encode(first).collect()}["Q1"]
    assert written.index('"P7"') < written.index('"P1"') and "12345678901234567890" in written
    rows = entities.statement_rows(first).orderBy(F.rand(1))
    regrouped = first.drop("statements").join(entities.from_statement_rows(rows), "id").select(*first.columns)
    assert [str(r) for r in regrouped.collect()] == [str(r) for r in first.where("id = 'Q1'").collect()]
