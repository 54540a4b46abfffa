"""Classes of equal fingerprints and their links, each traced to documents."""

from pagelode.llm import simhash
from pagelode.llm.queries import near_fingerprints

SF = "/root/testdata/sf0.001"


def test_copies_have_a_class_and_links(spark):
    rows = [(7, 5), (3, 5), (9, 5), (4, 4), (1, -1), (8, -1), (2, 0), (6, None)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, fingerprint long"), 1).collect()
    assert sorted(map(tuple, got)) == sorted([(7, 3, 0), (3, 3, 0), (9, 3, 0), (4, 4, 0), (1, 1, 0), (8, 1, 0), (2, 2, 0), (4, 3, 1), (4, 2, 1)])


def test_query_against_all_pairs(spark):
    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    first = {}
    for d in sorted(prints):
        first.setdefault(prints[d], d)
    want = [(d, first[p], 0) for d, p in prints.items()]
    own = sorted(first.values())
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            far = ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
            if far <= 3:
                want.append((b, a, far))
    assert sorted(map(tuple, near_fingerprints(spark, SF).collect())) == sorted(want)
