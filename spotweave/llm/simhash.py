"""SimHash fingerprints by DataFrame expressions, and near ones by permuted block tables.

A text's terms are its adjacent word pairs (the last word alone); each term's
128-bit hash votes on every bit with the term's weight, the lengths of its words
(each up to 12).  The votes of two bits share a long, in lanes of 32 bits, so a
text's votes are 64 sums that need no shuffle.  A bit is set if more than half
of the weight votes for it.

Null texts are empty; texts without words have the fingerprint of the empty
word.  Words are runs of bytes other than space and tab to carriage return.

Fingerprints within a radius of each other agree in some blocks of bits: one
table per choice of blocks, permuted to the front as its key, meets the queries
by equi-join.  Equal fingerprints count once, a key that many hold is dealt out,
and a pair counts in the first of the tables in which it meets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from .groups import join_classes
from .store import parallelism, settle

BITS = 128
#: Of the rows that ``compare_edited`` returns, one in so many asks for its near fingerprints, within so many bits.
ASKED, RADIUS = 20, 3
#: Documents of a bucket that one window orders, on average.
BUCKET = 64
#: First rows of buckets that are looked up by broadcast (24 bytes each); more of them by shuffle.
BROADCAST_HEADS = 500_000
_LANES = 0x0000000100000001
_SPACE = " \t\n\x0b\x0c\r"


def terms(text: Column) -> Column:
    """The array of (word, next word) of a text; the last word's next is null."""
    words = F.split(F.btrim(text, F.lit(_SPACE)), r"[ \t-\r]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def vote_sums(a: Column, b: Column) -> list[Column]:
    """The aggregates of the votes over a text's terms: ``total`` and 64 sums of two lanes."""
    weight = F.least(F.length(a), F.lit(12)) + F.coalesce(F.least(F.length(b), F.lit(12)), F.lit(0)) + F.lit(1)
    weight = weight.cast("bigint")
    out = [F.sum(weight).alias("total")]
    for k, h in enumerate((F.xxhash64(a, b), F.xxhash64(b, a, F.lit(1)))):
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES)) * weight).alias(f"v{k}_{i}") for i in range(32)]
    return out


def decide() -> Column:
    """The fingerprint, 32 hex digits, of the sums named by ``vote_sums``."""
    halves = []
    for k in (0, 1):
        low = [F.when(F.col(f"v{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0).cast("bigint")) for i in range(32)]
        high = [F.when(F.shiftrightunsigned(F.col(f"v{k}_{i}"), 32) * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0).cast("bigint")) for i in range(32)]
        for bits in (high, low):
            word = bits[0].cast("bigint")
            for x in bits[1:]:
                word = word.bitwiseOR(x.cast("bigint"))
            halves.append(F.lpad(F.lower(F.hex(word)), 8, "0"))
    return F.concat(*halves)


def fingerprint_by(texts: DataFrame, keys: list[str], text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row (told by ``keys``, which must tell rows apart): keys, fingerprint and the ``carry`` columns, which must be longs.

    All aggregates are of fixed width, so the terms of a text are added up in a
    hash table and never sorted.
    """
    rows = texts.select(*keys, *carry, F.posexplode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "t"))
    aggs = vote_sums(F.col("t.a"), F.col("t.b")) + [F.max(F.when(F.col("pos") == 0, F.col(c))).alias(c) for c in carry]
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *carry, decide().alias("fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return fingerprint_by(rows, ["id", "row"], "text").select(F.col("id").alias(id_col), "fingerprint")


def halves(fingerprint: Column) -> tuple[Column, Column]:
    """A fingerprint as two longs."""
    part = lambda at: F.shiftleft(F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(fingerprint, at + 8, 8), 16, 10).cast("bigint"))
    return part(1), part(17)


def distance(a: Column, b: Column) -> Column:
    (a0, a1), (b0, b1) = halves(a), halves(b)
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about one half for unrelated texts."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


#: Fingerprints of one key that a task meets; a key of more is dealt out.  Such keys are looked up by broadcast (16 bytes each) up to this number.
KEY_ROWS, BROADCAST_KEYS = 4096, 500_000


def _near_pairs(queries: DataFrame, table: DataFrame, radius: int, blocks: int) -> DataFrame:
    """All pairs (query, near, distance) of different fingerprints within ``radius`` bits, each once."""
    hex_at = [round(i * (BITS // 4) / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))
    part = lambda c, i: F.substring(c, hex_at[i] + 1, hex_at[i + 1] - hex_at[i])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(F.lit(n), *[part("fingerprint", i) for i in c]).alias("key")) for n, c in enumerate(choices)])
        one = df.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
        return one.select(F.col("fingerprint").alias(name), F.inline(keys))

    rows = keyed(table, "near")
    large = settle(rows.groupBy("key").count().where(F.col("count") > KEY_ROWS).select("key", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("parts")), "large-keys")
    if large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        large = F.broadcast(large)
    rows = rows.join(large, "key", "left").select("key", "choice", "near", F.coalesce(F.pmod(F.xxhash64("near", F.lit(7)), "parts"), F.lit(0)).cast("int").alias("part"))
    asked = keyed(queries, "query").join(large, "key", "left").select("key", "choice", "query", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    agree = [part("query", i) == part("near", i) for i in range(blocks)]
    first = None
    for n, c in enumerate(choices):
        both = agree[c[0]]
        for i in c[1:]:
            both = both & agree[i]
        first = F.when(both, n) if first is None else first.when(both, n)
    a, b = asked.alias("a"), rows.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.choice") == F.col("b.choice"))
    near = (F.col("query") != F.col("near")) & (distance(F.col("query"), F.col("near")) <= radius) & (first == F.col("a.choice"))
    return a.join(b, same & near).select("query", "near", distance(F.col("query"), F.col("near")).alias("distance"))


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (query, near, distance) of different fingerprints within ``radius`` bits, of two tables with a column ``fingerprint``.

    ``blocks`` > ``radius``.  Null fingerprints take no part.  The rows grow with
    the pairs that there are; ``near_counts`` gives one row per query.
    """
    return _near_pairs(queries, table, radius, blocks)


def near_counts(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Per distinct fingerprint of ``queries``: n_near, how many other distinct ones of ``table`` are within ``radius`` bits."""
    found = _near_pairs(queries, table, radius, blocks).groupBy(F.col("query").alias("fingerprint")).agg(F.count("*").alias("n_near"))
    every = queries.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    return every.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` and, at the end of each bucket (``head`` 1), the first row of the next one; after the last bucket that of the first.

    Buckets are ordered in two levels, so no window holds all of them.
    """
    upper = F.floor(F.col("bucket") / 4096)
    inner = Window.partitionBy("u").orderBy("bucket")
    ids = heads.select("bucket", upper.alias("u")).withColumn("n", F.lag("bucket").over(inner)).withColumn("r", F.row_number().over(inner.orderBy(F.desc("bucket"))))
    every = Window.orderBy("u")
    tails = ids.where("r = 1").select("u", F.col("bucket").alias("t"))
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = tails.select("u", F.coalesce(F.lag("t").over(every), F.last("t").over(whole)).alias("t"))
    before = ids.join(tails, "u").select("bucket", F.coalesce("n", "t").alias("before"))
    moved = heads.join(before, "bucket").drop("bucket").withColumnRenamed("before", "bucket")
    return rows.withColumn("head", F.lit(0)).unionByName(moved.withColumn("head", F.lit(1)))


#: Ids that tell the order's bounds, and the bounds.
SAMPLE, BOUNDS = 16_384, 127


def _order_key(docs: DataFrame) -> tuple[DataFrame, Column]:
    """A long that never falls as the id rises: an integer itself, of other ids the first bytes after those that all share."""
    if docs.schema["id"].dataType.simpleString() == "bigint":
        return docs, F.col("id")
    text = F.col("id").cast("string")
    low, high = docs.agg(F.min(text), F.max(text)).first()
    low, high = (low or "").encode(), (high or "").encode()
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), shared + 1, 7)), 14, "0")
    return docs, F.conv(head, 16, 10).cast("bigint")


def _buckets(docs: DataFrame) -> DataFrame:
    """bucket, id, th (hash of the text) and text; buckets follow the order of id and th and hold about ``BUCKET`` rows.

    A hashed sample gives bounds of about equal shares; between two bounds the
    order's key is cut evenly.  An id that repeats so often that it is several
    bounds is cut by th.
    """
    exact = docs.schema["id"].dataType.simpleString() == "bigint"
    docs, key = _order_key(docs)
    docs = docs.select(key.alias("k"), "id", F.xxhash64("text").alias("th"), "text")
    count = docs.count()
    rate = max(1, count // SAMPLE)
    held = [r[0] for r in docs.where(F.pmod(F.xxhash64("id", "th"), F.lit(rate)) == 0).select("k").orderBy("k").limit(8 * SAMPLE).collect()] if count else []
    ends = docs.agg(F.min("k"), F.max("k")).first() if count else (0, 0)
    picks = [held[i * len(held) // (BOUNDS + 1)] for i in range(1, BOUNDS + 1)] if held else [0]
    cuts = sorted(set(picks))
    times = [picks.count(c) for c in cuts]
    each = max(1, -(-count // ((len(cuts) + 1) * BUCKET)))
    many = [max(1, t * count // (BOUNDS * BUCKET)) if t > 1 and exact else 1 for t in times] + [1]
    top = max(each, *many)

    def numbers(values: list[float]) -> Column:
        return F.element_at(F.lit([float(v) for v in values]), F.col("j") + 1)

    low, high = [ends[0], *cuts], [*cuts, ends[1]]
    docs = docs.withColumn("j", F.size(F.filter(F.lit(cuts), lambda c: c < F.col("k"))))
    share = (F.col("k").cast("double") - numbers(low)) / F.greatest(numbers(high) - numbers(low), F.lit(1.0))
    between = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(each - 1))
    within = F.floor((F.col("th").cast("double") / F.lit(2.0**64) + 0.5) * numbers(many))
    on = F.col("k") == F.element_at(F.lit([*cuts, cuts[-1]]), F.col("j") + 1)
    bucket = (F.col("j") * 2 + on.cast("int")) * F.lit(top + 1) + F.when(on, F.least(within, numbers(many) - 1)).otherwise(between)
    return docs.select(bucket.cast("bigint").alias("bucket"), "id", "th", "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last floor(n / 2) of n characters replaced by the
    first as many (or all) of the next row's, by ascending id (then a hash of the
    text; after the last the first).  Rows without an id are left out.  Ids are
    integers, or else ordered as text.  Per row: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, and n_near: for one
    row in ``ASKED`` (by id) how many other distinct fingerprints of the table
    are within ``RADIUS`` bits of its own, null for the others.

    Texts are shuffled once, by bucket; the first text of each bucket, a small
    part of them, joins the bucket before.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    id_ = F.col(f"`{id_col}`").cast("bigint" if isinstance(kind, IntegralType) else "string").alias("id")
    base = docs.where(F.col(f"`{id_col}`").isNotNull()).select(id_, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _buckets(base)
    first = rows.groupBy("bucket").agg(F.min(F.struct("id", "th")).alias("m")).select("bucket", "m.id", "m.th")
    few = first.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS
    heads = settle(rows.join(F.broadcast(first) if few else first, ["bucket", "id", "th"], "left_semi").dropDuplicates(["bucket"]), "heads")
    dealt = _with_heads(rows, heads).repartition(parallelism(spark), "bucket")
    order = Window.partitionBy("bucket").orderBy("head", "id", "th")
    dealt = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order)).where("head = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    both = dealt.select("bucket", "id", "th", "place", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    sha = F.sha2("edited", 256)
    word = lambda at: F.conv(F.substring(sha, at, 8), 16, 10).cast("bigint")
    parts = [F.shiftleft(word(16 * i + 1), 32).bitwiseOR(word(16 * i + 9)) for i in range(4)]
    none = F.lit(None).cast("bigint")
    noted = ["n_chars", *(f"sha{i}" for i in range(4))]
    entry = lambda k, t, values: F.struct(F.lit(k).alias("k"), F.col(t).alias("text"), *[v.alias(n) for v, n in zip(values, noted)])
    pair = F.array(entry(0, "text", [none] * 5), entry(1, "edited", [F.col("n_chars"), *parts]))
    each = both.select("bucket", "id", "th", "place", F.inline(pair))
    prints = fingerprint_by(each, ["bucket", "id", "th", "place", "k"], "text", tuple(noted))
    wide = prints.groupBy("bucket", "id", "th", "place").agg(
        F.max(F.when(F.col("k") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("k") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        *[F.max(n).alias(n) for n in noted],
    )
    wide = settle(wide, "fingerprints")
    asked = F.pmod(F.col("id") if isinstance(kind, IntegralType) else F.xxhash64("id"), F.lit(ASKED)) == 0
    sizes = wide.where(asked).groupBy("fingerprint").agg(F.count("*").alias("size"))
    near = settle(near_counts(sizes, wide, RADIUS).join(sizes, "fingerprint").select(F.col("fingerprint").alias("probe"), "n_near", "size"), "near")
    dealt = _with_heads(wide, wide.where("place = 1"))
    order = Window.partitionBy("bucket").orderBy("head", "place")
    rows = dealt.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("head = 0")
    rows = rows.select(
        "id",
        "n_chars",
        F.concat(*[F.lpad(F.lower(F.hex(f"sha{i}")), 16, "0") for i in range(4)]).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(asked, F.col("fingerprint")).alias("probe"),
    )
    rows = join_classes(settle(rows, "compared"), near, "probe", "size", wide.where(asked).count(), "left")
    return rows.select(F.col("id").cast(kind).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
