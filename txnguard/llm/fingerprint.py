"""Document fingerprints by a homomorphic multiset hash, in SQL functions only.

A text is the multiset of its paragraphs: lines, cut further behind sentence
ends.  Each paragraph is hashed to a wide vector, and a fingerprint is the
lane-wise sum of the vectors modulo a power of two, so it doesn't depend on
their order, and paragraphs are added or taken away by adding or subtracting
vectors.  Lanes: ``EXACT`` of 32 random bits (equality, modulo 2**32) and
``SIGNS`` of +1 or -1 (modulo 2**16).  The squared length of a difference of
sign lanes estimates the squared distance of the two multisets, from which
``likeness`` takes a . b / (a . a + b . b - a . b).

Sign lanes are summed three to a 64-bit number, 21 bits each, over blocks of
2**20 paragraphs, so no sum overflows however long the text.

Defined cases: null texts count as empty and have the zero fingerprint, two of
them have likeness 1; equal doc_ids are ordered by text; rows with a null doc_id stand in
no order, so the text behind them is the empty one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 3            # 64-bit hashes for the sign lanes
SIGNS = 63 * WORDS   # sign lanes
EXACT = 8            # equality lanes
_THREE = (1 << 0) | (1 << 21) | (1 << 42)
_FIELD = (1 << 21) - 1


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n+|(?<=[.!?]) +"), lambda p: p != "")


def _sums() -> list[Column]:
    """Aggregates over rows with a column ``p``: packed sign sums, halves of
    the equality hashes, and the count."""
    out = []
    for w in range(WORDS):
        out += [F.sum(F.shiftrightunsigned(F.col(f"h{w}"), k).bitwiseAND(F.lit(_THREE))).alias(f"s{w}_{k}") for k in range(21)]
    for e in range(EXACT // 2):
        out += [F.sum(F.col(f"e{e}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"lo{e}"),
                F.sum(F.shiftrightunsigned(F.col(f"e{e}"), 32)).alias(f"hi{e}")]
    return [*out, F.count("*").alias("n")]


def _lanes() -> Column:
    """All lanes of one block as an array: signs, then equality lanes."""
    signs = [F.shiftrightunsigned(F.col(f"s{w}_{k}"), 21 * f).bitwiseAND(F.lit(_FIELD)) * 2 - F.col("n")
             for w in range(WORDS) for k in range(21) for f in range(3)]
    return F.array(*signs, *(F.col(f"{half}{e}") for e in range(EXACT // 2) for half in ("lo", "hi")))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fingerprint_lanes(docs: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """For each row of ``docs`` (unique in ``keys``) one array of lanes per
    entry of ``texts`` (new name: text column).  If ``docs`` is dealt by one of
    the keys, nothing is shuffled: all paragraphs of a row are in its task."""
    kinds = list(texts)
    p = docs.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), paragraphs(F.col(c)).alias("ps"))
                                               for i, c in enumerate(texts.values())))).alias("t"))
    p = p.select(*keys, "t.kind", F.posexplode_outer("t.ps").alias("at", "p"))
    p = p.withColumn("block", F.shiftright(F.coalesce("at", F.lit(0)), 20))
    p = p.select(*keys, "kind", "block", "p", *(F.xxhash64(F.lit(101 + w), "p").alias(f"h{w}") for w in range(WORDS)),
                 *(F.xxhash64(F.lit(501 + e), "p").alias(f"e{e}") for e in range(EXACT // 2)))
    blank = F.col("p").isNull()
    s = p.groupBy(*keys, "kind", "block").agg(*_sums(), F.max(blank).alias("none"))
    zero = F.array_repeat(F.lit(0).cast("long"), SIGNS + EXACT)
    s = s.select(*keys, "kind", F.when(F.col("none"), zero).otherwise(_lanes()).alias("lanes"))
    g = s.groupBy(*keys).agg(F.collect_list(F.struct("kind", "lanes")).alias("all"))

    def total(kind: int) -> Column:
        return F.aggregate(F.filter("all", lambda x: x["kind"] == kind), zero, lambda acc, x: _added(acc, x["lanes"]))
    return g.select(*keys, *(total(i).alias(k) for i, k in enumerate(kinds)))


def as_text(lanes: str) -> Column:
    """Hexadecimal text of a fingerprint: 4 digits a sign lane, 8 an equality lane."""
    return F.array_join(F.transform(lanes, lambda x, i: F.when(i < SIGNS, F.lpad(F.hex(F.pmod(x, F.lit(1 << 16))), 4, "0"))
                                    .otherwise(F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0"))), "")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint lanes after adding (or, ``sign`` -1, taking away) ``b``."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def likeness(a: str, b: str) -> Column:
    """Estimated generalised Jaccard likeness of two multisets, 0 to 1; exactly
    1 for equal lanes.  The lanes are whole sums, not yet taken modulo a power,
    so any number of paragraphs counts."""
    def square(c):
        return F.aggregate(F.slice(c, 1, SIGNS), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    diff = square(F.zip_with(a, b, lambda x, y: x - y))
    na, nb = square(F.col(a)), square(F.col(b))
    dot = (na + nb - diff) / 2
    union = na + nb - dot
    return F.when(F.col(a) == F.col(b), 1.0).when(union <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / union)))


def ranges(docs: DataFrame, key: str, most: int = 4096) -> list:
    """At most ``most`` upper bounds that cut ``key`` into even ranges, each
    with at least one row; the last is the greatest key."""
    n = min(most, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2))
    r = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q"), F.max(key).alias("top")).first()
    return [] if r["top"] is None else sorted({*r["q"], r["top"]})


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (key, text) with ``next`` (the text of the row behind it by key
    and text; behind the last the first), ``range`` and ``r`` (place in it).

    Rows are dealt to key ranges once; the first row of each range goes along
    to the range before it, so the whole table is never sorted in one task."""
    bounds = ranges(docs, key)
    k = max(1, len(bounds))
    step = max(1, int(k ** 0.5))
    every = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array(F.lit(0).cast("long"))
    coarse = F.array(*(F.lit(b) for b in bounds[step - 1:: step])) if bounds[step - 1:: step] else F.array().cast("array<long>")

    def below(arr):
        return F.size(F.filter(arr, lambda b: b < F.col(key)))
    jump = below(coarse) * step
    d = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    # rows without a key are dealt by their text to ranges below 0
    none = -1 - F.pmod(F.xxhash64(text), F.lit(4096))
    d = d.withColumn("range", F.when(F.col(key).isNull(), none).otherwise(jump + below(F.slice(every, jump + 1, step))).cast("int"))
    firsts = [r["m"] for r in d.filter(F.col(key).isNotNull()).groupBy("range").agg(F.min(key).alias("m")).collect()]  # one per range
    where = F.struct(F.col("range").alias("range"), F.lit(0).alias("halo"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(k)).cast("int").alias("range"), F.lit(1).alias("halo"))
    d = d.withColumn("w", F.explode(F.when(F.col(key).isin(firsts), F.array(where, before)).otherwise(F.array(where))))
    d = d.select(key, text, "w.range", "w.halo")
    w = Window.partitionBy("range").orderBy("halo", key, text)
    d = d.withColumn("next", F.when(F.col(key).isNull(), "").otherwise(F.lead(text).over(w))).withColumn("r", F.row_number().over(w))
    return d.filter("halo = 0").drop("halo")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter of
    the code points replaced by the beginning of the next document)."""
    d = with_next(docs)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    d = d.withColumn("n_chars", n.cast("long"))
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k)))
    d = d.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["range", "r", "doc_id", "n_chars", "edited_sha256"]
    f = fingerprint_lanes(d, keys, {"own": "text", "edit": "edited", "following": "next"})
    return f.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("edit").alias("edited_fingerprint"),
                    likeness("own", "edit").alias("near_edited"), likeness("own", "following").alias("near_next"))
