"""Line dedup by an exact set-similarity join. DataFrame operations only.

A line's tokens are its distinct words. A line is removed if an earlier line, by document id and then
by place, has a Jaccard similarity of 0.8 or more with it, whether or not that one is removed itself.

1. Tokens are ordered by rarity: counts of all words in 2^20 hash buckets give powers of two, and a
   token's 63-bit key is that power followed by 58 bits of its hash. Any order common to all lines is
   right; this one puts frequent words last.
2. Lines with equal token sets form a class; only the first can be a match for others.
3. Prefix filter: lines of sizes n and m that reach the similarity share a token among the first
   n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1, and two tokens among one more of each. A line is posted
   under the rare tokens of its prefix, and under the pairs of frequent tokens of the longer one: of two
   shared tokens the first is rare, and then in both prefixes, or both are frequent. Lines of LONG
   tokens or more are posted under all tokens of their prefix, and pairs are made up to 1.25 LONG only:
   two lines that reach the similarity are both up to 1.25 LONG, or both from LONG on. So a line of n
   tokens has n / 5 + 1 single keys and a bounded number of pairs.
4. Length and positional filters go with the join: the sizes allow the similarity, and so do the
   tokens left after the common one. So does a bitmap: its bits hold the parity of the tokens that fall
   on each, and two lines' bitmaps differ in no more bits than their sets differ in tokens. Long lines
   have 128 or 256 bits, as 64 tell little of them. Up to 128 go with the join; pairs of the longest
   lines that are left are held against all 256.
5. Stars first: the lines of posting lists of more than STARRED are held against HUBS of their lines, the first ones of as many parts. A line that is confirmed needs no other match; only the others are held
   against the earlier lines of all their posting lists.
6. Jaccard is verified on whole token sets. One match is enough, so each line's pair with the closest
   bitmaps goes first; only lines that it doesn't confirm carry their sets to all their pairs.

Blank lines are kept and match nothing; null text has no lines. Documents with null ids are neither
changed nor matched. Repeated rows get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import Scratch, bit_map, free, in_map

BUCKETS = 1 << 20
#: A token is rare if its bucket's power of two is at most so much above the mean bucket's.
RARE = 2
#: Lines of so many tokens have bitmaps of 128 and of 256 bits; shorter ones of 64.
WIDE, WIDEST = 80, 160
MAPS = ["m0", "m1", "m2", "m3"]
KEYS = ["doc_id", "line_no"]
#: Posting lists are held against themselves in so many parts, one after the other, which need less disk.
PARTS = 4
#: Lines of so many tokens are held against each other by single tokens.
LONG = 100
#: Lists of more lines have a star.
STARRED = 20
#: A star has so many hubs at most.
HUBS = 16
#: White space within lines.
BLANK = " \t\x0b\x0c\r"


def spaced(text: Column) -> Column:
    """The text with all white space but line breaks as spaces; most texts have no other and are not rewritten."""
    out, odd = text, F.lit(False)
    for c in "\t\x0b\x0c\r":
        out, odd = F.replace(out, F.lit(c), F.lit(" ")), odd | F.contains(text, F.lit(c))
    return F.when(odd, out).otherwise(text)


def _bucket(hash_: Column) -> Column:
    """The first 20 bits of a hash."""
    return F.shiftrightunsigned(hash_, 44).cast("int")


def dense(found: DataFrame, size: int, default: int) -> DataFrame:
    """One row with one array of a fixed size from rows (bucket, value)."""
    every = found.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left")
    filled = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("value", F.lit(default)).cast("tinyint").alias("value"))))
    return every.agg(F.transform(filled, lambda x: x["value"]).alias("values"))


def rarity(docs: DataFrame) -> DataFrame:
    """One row with the power of two of each bucket's count of words."""
    words = docs.select(F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word != ''")
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).count()
    return dense(counts.select("bucket", F.floor(F.log2("count")).alias("value")), BUCKETS, 0)


def rare_below(powers: DataFrame) -> int:
    """The bound of rare tokens' keys, from the mean power of all buckets."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.when(x > 0, F.pow(F.lit(2.0), x)).otherwise(0.0))
    mean = powers.select(F.greatest(F.lit(1.0), total / BUCKETS)).collect()[0][0]
    return (int(mean).bit_length() + RARE) << 58


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines with a word; white space is spaces."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def hashes(line: Column) -> Column:
    """The hashes of a line's distinct words, in no order."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def tokens(line: Column, powers: str = "powers") -> Column:
    """The sorted keys of a line's distinct words; powers: the column with rarity()'s array."""
    # no key is null, and Spark is told so: it sorts such arrays as plain numbers
    power = lambda h: F.coalesce(F.get(F.col(powers), _bucket(h)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(hashes(line), lambda h: F.shiftleft(power(h), 58).bitwiseOR(F.shiftrightunsigned(h, 6))))


def singles(keys: Column, bound: int) -> Column:
    """The rare tokens of the prefix, in order, or all of a long line's. bound: keys below it are rare.

    A token whose bucket counts one word occurs once in all lines and is left out.
    """
    met = F.filter(F.slice(keys, 1, F.floor(F.size(keys) / 5).cast("int") + 1), lambda k: k >= 1 << 58)  # n - ceil(0.8 n) + 1
    return F.filter(met, lambda k: (k < bound) | (F.size(keys) >= LONG))


def pairs(keys: Column, bound: int) -> Column:
    """Hashes of the pairs of frequent tokens in the prefix longer by one; none for lines over 1.25 LONG tokens."""
    keys = F.when(F.size(keys) <= LONG * 5 // 4, keys).otherwise(F.array().cast("array<bigint>"))
    longer = F.slice(keys, 1, F.floor(F.size(keys) / 5).cast("int") + 2)
    own = F.filter(longer, lambda k: k >= bound)
    return F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.xxhash64(a, b))))


def _apart() -> Column:
    """Bits in which the bitmaps of x and y differ: of 128 where both are long, else of 64."""
    low, high = F.col("x.m0").bitwiseXOR(F.col("y.m0")), F.col("x.m1").bitwiseXOR(F.col("y.m1"))
    wide = (F.col("x.n") >= WIDE) & (F.col("y.n") >= WIDE)
    return F.when(wide, F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))


def _may_match() -> Column:
    """Length, bitmap and positional filters of x (this line) and y (an earlier one), in whole numbers and the cheapest first."""
    both = F.col("x.n") + F.col("y.n")  # 4 / 9 of these must be common, and 1 / 9 may differ
    room = F.least("x.pos", "y.pos") + 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    sizes = (5 * F.col("x.n") >= 4 * F.col("y.n")) & (5 * F.col("y.n") >= 4 * F.col("x.n"))
    # x is open; said of both sides, so that the two are one plan and Spark moves the posts once
    open_ = F.col("x.open") + F.col("y.open") > F.col("y.open")
    earlier = (F.col("y.doc_id") < F.col("x.doc_id")) | ((F.col("y.doc_id") == F.col("x.doc_id")) & (F.col("y.line_no") < F.col("x.line_no")))
    return sizes & open_ & (9 * _apart() <= both) & ((F.col("x.pos") < 0) | (9 * room >= 4 * both)) & earlier


def bitmap(keys: Column) -> list[Column]:
    """MAPS: for each of 64, 128 or 256 bits whether an odd count of tokens falls on it; null beyond a line's width."""

    def part(i: int, parts: int) -> Column:
        here = lambda k: F.lit(1).cast("bigint") if parts == 1 else (F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(parts - 1)) == i).cast("bigint")
        return F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", here(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    n = F.size(keys)
    narrow = [F.when(n < WIDE, part(0, 1)).when(n < WIDEST, part(0, 2)).otherwise(part(0, 4)), F.when(n >= WIDEST, part(1, 4)).when(n >= WIDE, part(1, 2))]
    return [m.alias(name) for m, name in zip([*narrow, *(F.when(n >= WIDEST, part(i, 4)) for i in (2, 3))], MAPS)]


def narrow() -> list[Column]:
    """The bitmaps as posts carry them, m0 and m1: of 128 bits from WIDE tokens on, else of 64 in m0."""
    m = [F.coalesce(F.col(name), F.lit(0).cast("bigint")) for name in MAPS]
    return [m[0].bitwiseXOR(m[2]).alias("m0"), m[1].bitwiseXOR(m[3]).alias("m1")]


def closer(found: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (KEYS and n of x and y, apart) that the 256 bits of the longest lines leave, without n; apart counts those bits where both have them. maps: KEYS and MAPS of these lines."""
    names = ["x_doc", "x_line", "y_doc", "y_line", "apart"]
    longest = F.least("x_n", "y_n") >= WIDEST
    both = found.where(longest).drop("apart").join(maps.toDF("x_doc", "x_line", *(f"x_{m}" for m in MAPS)), ["x_doc", "x_line"])
    both = both.join(maps.toDF("y_doc", "y_line", *(f"y_{m}" for m in MAPS)), ["y_doc", "y_line"])
    bits = reduce(Column.__add__, (F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MAPS))
    left = both.withColumn("apart", bits).where(9 * F.col("apart") <= F.col("x_n") + F.col("y_n"))
    return found.where(~longest).select(*names).unionByName(left.select(*names))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The lines x, as KEYS, of pairs (x_doc, x_line, y_doc, y_line) whose sets (doc_id, line_no, tokens) reach the similarity."""
    own = pairs.join(sets.toDF("x_doc", "x_line", "a"), ["x_doc", "x_line"]).join(sets.toDF("y_doc", "y_line", "b"), ["y_doc", "y_line"])
    good = own.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b")))
    return good.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line_no")).distinct()


def confirmed(found: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lines x of pairs (x_doc, x_line, y_doc, y_line, apart) that reach the similarity, from whole token sets; the closest pair of each line first."""
    ends = found.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line_no")).unionAll(found.select("y_doc", "y_line"))
    # one map of documents and of lines: texts without a line that is needed are not split
    flags = scratch.save(bit_map(ends.select(F.explode(F.array(F.xxhash64("doc_id"), F.xxhash64(*KEYS))).alias("key")), "key"), f"{name}-flags")
    some = split_lines(rows.where(in_map(flags, F.xxhash64("doc_id")))).where(in_map(flags, F.xxhash64(*KEYS)))
    sets = scratch.save(some.select(*KEYS, hashes(F.col("line")).alias("tokens")), f"{name}-sets")
    closest = found.groupBy("x_doc", "x_line").agg(F.min(F.struct("apart", "y_doc", "y_line")).alias("y")).select("x_doc", "x_line", "y.y_doc", "y.y_line")
    first = scratch.save(verified(closest, sets), f"{name}-closest")
    others = found.drop("apart").join(first.toDF("x_doc", "x_line"), ["x_doc", "x_line"], "left_anti")
    rest = scratch.save(verified(others, sets), name)
    scratch.drop(f"{name}-sets", f"{name}-flags")
    return first.unionByName(rest)


def posted(classes: DataFrame) -> DataFrame:
    """A row for each key that a class is posted under; pos is -1 under pairs."""
    columns = [*KEYS, "n", "open", *narrow()]
    return classes.select(*columns, F.posexplode("one").alias("pos", "key")).unionByName(classes.select(*columns, F.lit(-1).alias("pos"), F.explode("two").alias("key")))


def met(x: DataFrame, y: DataFrame) -> DataFrame:
    """The pairs of posts x and y that the filters leave, once each."""
    names = [F.col("x.doc_id").alias("x_doc"), F.col("x.line_no").alias("x_line"), F.col("y.doc_id").alias("y_doc"), F.col("y.line_no").alias("y_line")]
    found = x.alias("x").join(y.alias("y"), F.col("x.key") == F.col("y.key")).where(_may_match())
    return found.select(*names, F.col("x.n").alias("x_n"), F.col("y.n").alias("y_n"), _apart().alias("apart")).distinct()


def matched(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line_no) of the classes' first lines that have an earlier match. Drops the scratch table of classes."""
    maps = scratch.save(classes.where(F.col("n") >= WIDEST).select(*KEYS, *MAPS), "maps")
    few = posted(classes.withColumn("open", F.lit(1)))
    # only long posting lists have stars; a map tells which these are
    long_ = scratch.save(bit_map(few.groupBy("key").count().where(F.col("count") > STARRED), "key"), "long")
    here = [F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PARTS)) == part for part in range(PARTS)]
    near = None
    for part in range(PARTS):
        own = few.where(here[part] & in_map(long_, F.col("key")))
        # near copies are not all like their first line: of each list, the first lines of HUBS parts are hubs
        hubs = own.groupBy("key", F.pmod(F.xxhash64(*KEYS), F.lit(HUBS)).alias("dealt")).agg(F.min(F.struct(*KEYS, "n", "open", "pos", "m0", "m1")).alias("hub")).select("key", "hub.*")
        found = scratch.save(met(own, hubs), f"near-{part}")
        near = found if near is None else near.unionByName(found)
    stars = scratch.save(closer(near.distinct(), maps), "stars")
    scratch.drop(*[f"near-{part}" for part in range(PARTS)])
    first = confirmed(stars, rows, scratch, "by-star")
    # lines that the map tells to be open are; the others are looked up
    flags = scratch.save(bit_map(first.select(F.xxhash64(*KEYS).alias("key")), "key"), "confirmed")
    may = in_map(flags, F.xxhash64(*KEYS))
    looked = classes.where(may).join(first.withColumn("open", F.lit(0)), KEYS, "left").withColumn("open", F.coalesce("open", F.lit(1)))
    marked = classes.where(~may).withColumn("open", F.lit(1)).unionByName(scratch.save(looked, "looked-up"))
    lists = None
    for part in range(PARTS):
        posts = posted(marked).where(here[part])
        found = scratch.save(met(posts, posts), f"met-{part}")
        lists = found if lists is None else lists.unionByName(found)
    scratch.drop("classes", "looked-up", "confirmed", "long")
    rest = closer(lists.distinct(), maps).join(stars, ["x_doc", "x_line", "y_doc", "y_line"], "left_anti")
    rest = scratch.save(rest, "rest")
    scratch.drop("stars", "maps", *[f"met-{part}" for part in range(PARTS)])
    return first.unionByName(confirmed(rest, rows, scratch, "by-list"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with its text cut to the lines that stay, n_lines (with a word) and n_removed.

    Input columns named n_lines and n_removed are replaced; null text stays null.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    powers = scratch.save(rarity(rows), "rarity")
    bound = rare_below(powers)
    keyed = split_lines(rows).withColumn("powers", powers.scalar()).select("doc_id", "line_no", tokens(F.col("line")).alias("t"))
    keyed = keyed.select("doc_id", "line_no", F.size("t").alias("n"), *bitmap(F.col("t")), F.xxhash64("t").alias("s1"), F.xxhash64("t", F.lit(1)).alias("s2"), singles(F.col("t"), bound).alias("one"), pairs(F.col("t"), bound).alias("two"))
    keyed = scratch.save(keyed, "keyed", dictionary=False)
    classes = keyed.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in MAPS), F.first("one").alias("one"), F.first("two").alias("two"))
    classes = scratch.save(classes.select("s1", "s2", "f.*", "n", *MAPS, "one", "two"), "classes", dictionary=False)
    heads = scratch.save(classes.select("s1", "s2", *KEYS), "heads")
    keyed = scratch.save(keyed.select("doc_id", "line_no", "s1", "s2"), "sets-of-lines")
    scratch.drop("keyed")
    gone = matched(rows, classes.drop("s1", "s2"), scratch).withColumn("gone", F.lit(True))
    firsts = heads.join(gone, ["doc_id", "line_no"], "left").select("s1", "s2", F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "gone")
    later = (F.col("doc_id") != F.col("d")) | (F.col("line_no") != F.col("l")) | F.col("gone")
    removed = keyed.select("doc_id", "line_no", "s1", "s2").join(firsts, ["s1", "s2"]).where(later)
    docs = docs.drop("n_lines", "n_removed")
    own, lines_, gone_ = free(docs, "own_id", "split_lines", "removed_lines")
    removed = removed.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(gone_))
    # texts are split behind the join, so that it moves them once
    out = docs.join(removed, F.col(id_col) == F.col(own), "left").withColumn(lines_, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), gone_), lambda i: F.get(lines_, i))
    whole = F.filter(F.col(lines_), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return out.withColumns(
        {
            text_col: F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size(whole).cast("long"),
            "n_removed": F.coalesce(F.size(gone_), F.lit(0)).cast("long"),
        }
    ).drop(own, gone_, lines_)
