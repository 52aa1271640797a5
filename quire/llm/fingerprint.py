"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each run of five words is hashed once. The top eight bits of a hash name one of 256 bins and a bin keeps its
smallest hash. An empty bin is filled by optimal densification: it copies the first filled bin of a probe
sequence that depends on the bin alone (PROBES hashed probes, then the filled bin whose hash with it is
smallest, which is the first of a random permutation). Each bin's value is hashed once more with the bin, so that one value in many
bins, as in short texts, does not agree or differ in all of them by chance; the low four bits are packed into sixteen
64-bit words. Two fingerprints agree in a bin by chance with C = 1/16, so a share m of equal bins stands for a
likeness of (m - C) / (1 - C), cut at 0.

Hashes are sorted, so bins are runs of one array; there is no explode and no shuffle in a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents

K, BINS, PROBES = 5, 256, 8
CHANCE = 1 / 16
KNOTS, BUCKET_ROWS = 64, 500
NIBBLES = 0x1111111111111111
LEAST = -(1 << 63)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 56).cast("int") + 128


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the packed fingerprint of the column ``text`` as array<bigint> ``name``, empty for a text without words."""
    t = f"__{name}"
    keep = df.columns
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(t, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.select(*keep, t, F.size(t).alias(f"{t}n"))
    h, n = F.col(t), F.col(f"{t}n")
    runs = F.transform(F.slice(h, F.lit(1), F.greatest(n - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]))
    shingles = F.when(n >= K, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, F.sort_array(shingles).alias(t))
    s = F.col(t)
    df = df.select(*keep, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))).alias(t))
    m = F.col(t)
    blank = F.lit(None).cast("bigint")
    gap = lambda x, i: F.array_append(F.array_repeat(blank, _bin(x) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(m, i - 1))) - 1), x)
    tail = F.array_repeat(blank, BINS - 1 - F.coalesce(_bin(F.get(m, F.size(m) - 1)), F.lit(BINS - 1)))
    df = df.select(*keep, t, F.concat(F.flatten(F.transform(m, gap)), tail).alias(f"{t}b"))
    b = F.col(f"{t}b")

    def filled(v: Column, i: Column) -> Column:
        probes = [F.get(b, F.pmod(F.xxhash64(i, F.lit(p)), F.lit(BINS)).cast("int")) for p in range(1, PROBES + 1)]
        first = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("at"), x.alias("v"))))["v"]
        return F.xxhash64(F.coalesce(v, *probes, first), i)

    df = df.select(*keep, F.transform(b, filled).alias(t))
    d = F.col(t)
    pack = lambda g: F.aggregate(F.slice(d, g * 16 + 1, F.lit(16)), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 4).bitwiseOR(x.bitwiseAND(F.lit(15).cast("bigint"))))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), pack)
    return df.select(*keep, F.when(F.size(d) > 0, packed).otherwise(F.array().cast("array<bigint>")).alias(name))


def as_text(packed: Column) -> Column:
    """A fingerprint as 256 hex digits; empty for a text without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets of two packed fingerprints: 1 for two texts without words, 0 for one."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftright(z, 1))
        z = z.bitwiseOR(F.shiftright(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(NIBBLES)))

    share = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda t, x: t + x) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (share - CHANCE) / (1 - CHANCE))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(F.size(a) == 0, F.lit(1.0)).otherwise(both)


def _bucket(key: Column, knots: list[int], each: int) -> Column:
    """Rows of neighbouring keys: ``each`` equal steps between two knots. Never falls as the key rises; below KNOTS * each."""
    at = F.array(*[F.lit(x).cast("bigint") for x in knots])
    i = F.least(F.greatest(F.size(F.filter(at, lambda x: x <= key)) - 1, F.lit(0)), F.lit(len(knots) - 2))
    low, high = F.get(at, i).cast("double"), F.get(at, i + 1).cast("double")
    part = F.when(high > low, (key.cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
    return i * each + F.least(F.greatest(F.floor(part * each), F.lit(0)), F.lit(each - 1)).cast("int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document by
    ascending id; after the last comes the first. A null text counts as empty. A null id comes before all others;
    rows that repeat an id follow each other by text. A single row is its own next. An empty table gives an
    empty result. Other columns are ignored.

    Neighbours meet in buckets of about BUCKET_ROWS rows between quantiles of the id, one shuffle for the texts. The
    first row of a bucket is also sent to the bucket before it. Buckets grow in number with the rows, and so does the
    table of their first ids, two numbers for each BUCKET_ROWS rows; Spark broadcasts it only while it measures small.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(LEAST).cast("bigint"))
    steps = [i / KNOTS for i in range(KNOTS + 1)]
    n, knots = base.agg(F.count(F.lit(1)), F.percentile_approx(key, steps, 10_000)).first()
    each = max(1, -(-n // (KNOTS * BUCKET_ROWS)))
    bucket = _bucket(key, knots or [0, 0], each)
    firsts = base.select(key.alias("key"), bucket.alias("bucket")).groupBy("bucket").agg(F.min("key").alias("first_key"))
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(whole)))
    printed = with_fingerprint(base.select("doc_id", "text", key.alias("key"), bucket.alias("bucket")), "text", "print")
    sent = printed.join(firsts.select(F.col("bucket").alias("of"), "first_key", "before"), F.col("bucket") == F.col("of"))
    place = lambda bucket, guest: F.struct(F.col(bucket).cast("int").alias("b"), F.lit(guest).alias("guest"))
    places = F.when(F.col("key") == F.col("first_key"), F.array(place("bucket", False), place("before", True))).otherwise(F.array(place("bucket", False)))
    sent = sent.select("doc_id", "text", "key", "print", F.explode(places).alias("p")).select("doc_id", "text", "key", "print", "p.b", "p.guest")
    order = Window.partitionBy("b").orderBy("guest", "key", "text")
    met = sent.select("*", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print")).filter("not guest")
    chars = F.length("text")
    cut = F.floor(chars / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))"))
    met = met.select("doc_id", chars.cast("bigint").alias("n_chars"), "print", "next_print", F.when(cut > 0, edited).otherwise(F.col("text")).alias("edited"))
    met = with_fingerprint(met, "edited", "edited_print")
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


QUERIES = {"op3_fingerprint": op3_fingerprint}
SQL: dict[str, str] = {}
