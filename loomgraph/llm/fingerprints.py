"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A term (word) with weight w (its count) gets for each of SAMPLES draws r and c from Gamma(2, 1) and b from [0, 1), all
from hashes of the term and the draw's number. With t = floor(ln w / r + b), the draw's sample is the (term, t) of
the least ln a = ln c - r (t - b + 1). Two texts have the same sample with just the chance of their generalised
Jaccard similarity: the sum of the terms' lesser weights over that of the greater ones.

Each sample is one long: ln a as a fixed-point number above 22 bits of a hash of (term, t); so the least one is a
plain min, which is combined before rows move. Equal texts have equal longs: ln is StrictMath's, the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, stored

SAMPLES, SIDE = 48, 2
SPACES = "[\\x20\\x09-\\x0D]+"
_M = (1 << 21) - 1


def _uniform(z: Column, shift: int) -> Column:
    """21 bits of z as a number inside (0, 1)."""
    return (F.shiftrightunsigned(z, shift).bitwiseAND(F.lit(_M)) + F.lit(0.5)) / F.lit(float(_M + 1))


def draw(term: Column, k: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term's k-th draw."""
    y, z = F.xxhash64(term, 2 * k), F.xxhash64(term, 2 * k + 1)
    r = -F.log(_uniform(y, 0) * _uniform(y, 21))
    return r, F.log(-F.log(_uniform(z, 0) * _uniform(z, 21))), _uniform(y, 42)


def sample(term: Column, log_weight: Column, drawn: tuple[Column, Column, Column], k: Column) -> Column:
    """A draw's (ln a, term, t) as a long; null if the logarithm of the weight is null."""
    r, ln_c, b = drawn
    t = F.floor(log_weight / r + b)
    high = F.shiftleft(((ln_c - r * (t - b + 1) + 512.0) * float(1 << 31)).cast("long"), 22)
    return high.bitwiseOR(F.xxhash64(term, t, k).bitwiseAND(F.lit((1 << 22) - 1)))


def bounds(rows: DataFrame, parts: int) -> list[int]:
    """At most `parts` ids that cut the rows into about equal runs: what the driver gets is as long as asked for."""
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    return sorted(set(found))


def bucket(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the id, in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < doc_id))
    coarse = below(listed(cuts[step - 1 :: step])) if len(cuts) >= step else F.lit(0)
    return (coarse * step + below(F.slice(listed(cuts), coarse * step + 1, step))).cast("int")


def with_next(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """next_<column>: of the row after, in the order of (bucket, *order); of the last row, the first row's.

    Rows of a bucket are sorted in one task; a bucket's last row looks up the first of the next bucket, in a table of
    a row for each bucket.
    """
    inside = Window.partitionBy("bucket").orderBy(*order)
    heads = rows.groupBy("bucket").agg(F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("head"))
    across = Window.orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("after"))
    step = rows.withColumn("following", F.lead(F.struct(*columns)).over(inside))
    joined = step.join(after, "bucket")
    return joined.select(*rows.columns, *(F.when(F.col("following").isNotNull(), F.col(f"following.{c}")).otherwise(F.col(f"after.{c}")).alias(f"next_{c}") for c in columns))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without a word, 0 for one."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.lit(float(SAMPLES)))


def text_of(samples: Column) -> Column:
    """8 hexadecimal digits for each sample; the empty string for a text without a word."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 4) characters replaced by as many of the next document's first (or
    all that it has). A null text counts as empty; a null id comes first; rows with equal ids follow in the order of
    their texts. An empty table gives an empty result; a very long text stays in its row, and its words in its task.
    Other columns of docs are left out, whatever their names. Texts are shuffled once, by runs of ids, and neither words nor draws leave the task that made them.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(rows.select("doc_id"), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("bucket", bucket(F.col("doc_id"), cuts))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "text"))
    pairs = with_next(rows.withColumn("number", number), ["doc_id", "text"], ["text"]).select("bucket", "number", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))

    # A word is a 63-bit hash, and the last bit tells the text from the edited one.
    coded = lambda text, bit: F.transform(_words(text), lambda w: F.shiftleft(F.xxhash64(w), 1) + bit)
    terms = (
        pairs.select("bucket", "number", F.explode(F.concat(coded(F.col("text"), 0), coded(F.col("edited"), 1))).alias("word"))
        .select("bucket", "number", F.shiftright("word", 1).alias("term"), F.col("word").bitwiseAND(F.lit(1)).alias("edited"))
        .groupBy("bucket", "number", "term")
        .agg(F.count(F.when(F.col("edited") == 0, 1)).alias("w"), F.count(F.when(F.col("edited") == 1, 1)).alias("v"))
    )
    # SIDE draws to a row: few enough for compiled code to stay small, enough to look up few groups.
    weighed = terms.select("bucket", "number", "term", F.log("w").alias("w"), F.log("v").alias("v"), F.explode(F.array(*map(F.lit, range(SAMPLES // SIDE)))).alias("block"))
    k = [F.col("block") * SIDE + j for j in range(SIDE)]
    drawn = weighed.select("*", *(x.alias(f"{name}{j}") for j in range(SIDE) for name, x in zip(("r", "c", "b"), draw(F.col("term"), k[j]), strict=True)))
    least = [F.min(sample(F.col("term"), F.col(w), (F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"b{j}")), k[j])).alias(f"{w}{j}") for w in ("w", "v") for j in range(SIDE)]
    blocks = drawn.groupBy("bucket", "number", "block").agg(*least)
    folded = lambda w: F.array(*(F.hash(f"{w}{j}") for j in range(SIDE))).alias(w)
    gathered = blocks.groupBy("bucket", "number").agg(F.count("w0").alias("w"), F.count("v0").alias("v"), F.sort_array(F.collect_list(F.struct("block", folded("w"), folded("v")))).alias("all"))
    none = F.array().cast("array<int>")
    packed = lambda w: F.when(F.col(w) == 0, none).otherwise(F.flatten(F.transform("all", lambda x: x[w])))
    samples = gathered.select("bucket", "number", packed("w").alias("samples"), packed("v").alias("edited_samples"))
    base = pairs.select("bucket", "number", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    made = stored(base.join(samples, ["bucket", "number"], "left").select(*base.columns, F.coalesce("samples", none).alias("samples"), F.coalesce("edited_samples", none).alias("edited_samples")), "fingerprints")
    return with_next(made, ["number"], ["samples"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("samples")).alias("fingerprint"),
        text_of(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
