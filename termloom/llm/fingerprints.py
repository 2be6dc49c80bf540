"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is a weighted set: its words, lower-cased, by how often they occur. For sample k each term draws r and c from
Gamma(2, 1) and b from U(0, 1), all from hashes of (term, k). With weight w, the term quantises its log-weight to
t = floor(ln w / r + b) and bids ln a = ln c - r * (t - b + 1). The least bid gives the sample (term, t), and two texts agree
in a sample with a probability of their generalised Jaccard similarity, sum(min(w)) / sum(max(w)).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import SPACE, ordered, written

SAMPLES = 32
#: Bits of a sample's identity (term, t); the bid stands above them in one 63-bit number, so that min() finds the sample.
ID_BITS = 24


def _uniform(bits: Column, width: int) -> Column:
    return (bits + F.lit(0.5)) * F.lit(2.0**-width)


def _bid(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k's bid of a term, with its identity in the low bits."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    field = lambda x, low, width: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))
    r = -F.log(_uniform(field(one, 43, 21), 21) * _uniform(field(one, 22, 21), 21))
    c = -F.log(_uniform(field(two, 32, 32), 32) * _uniform(field(two, 0, 32), 32))
    b = _uniform(field(one, 0, 22), 22)
    t = F.floor(log_weight / r + b)
    a = F.log(c) - r * (t - b + 1)
    place = F.shiftleft(((a + 128.0) * 2.0**31).cast("long"), ID_BITS)
    return place.bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and sample (array<int>): the samples of each key's text. Keys must be unique; texts without words have no row.

    If the rows are dealt out by some of the keys already, neither of the two aggregations moves anything.
    """
    words = texts.select(*keys, F.explode(F.split(F.lower(text), f"{SPACE}+")).alias("w")).where("w <> ''")
    terms = words.groupBy(*keys, F.xxhash64("w").alias("_term")).agg(F.count("*").alias("_n"))
    terms = terms.select(*keys, "_term", F.log(F.col("_n").cast("double")).alias("_ln"))
    least = terms.groupBy(*keys).agg(*(F.min(_bid(F.col("_term"), F.col("_ln"), k)).alias(f"_{k}") for k in range(samples)))
    ids = [F.col(f"_{k}").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int") for k in range(samples)]
    return least.select(*keys, F.array(*ids).alias("sample"))


def printed(sample: Column, samples: int = SAMPLES) -> Column:
    """A fingerprint as hexadecimal digits; of a text without words, one dash a sample."""
    digits = F.array_join(F.transform(sample, lambda x: F.lpad(F.lower(F.hex(x)), ID_BITS // 4, "0")), "")
    return F.coalesce(digits, F.lit("-" * samples))


def likeness(a: Column, b: Column) -> Column:
    """The part of the samples that agree, an unbiased estimate of the generalised Jaccard similarity. Two texts without words: 1."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(agree / F.size(a))


def with_edits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in descending doc_id, null last, and what stands around each: (rows, texts).

    rows: doc_id, n_chars, _d and _h (doc_id and a hash of the text, which name a row), _copies (equal rows are one document of the order, and
    count again in the result), and the next document's _next_d, _next_h; after the last comes the first. texts: _d, _h,
    text, edited: its last n_chars // 2 code points replaced by the next text's first as many, or all.
    """
    null_id = F.lit(-(2**63)).cast("long")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce("doc_id", null_id).alias("_d"), F.xxhash64(F.col("doc_id").isNull(), text).alias("_h"), "doc_id", text.alias("text"))
    whole = docs.groupBy("_d", "_h").agg(F.first("text").alias("text"))  # the same columns in all its uses: texts are dealt out once
    keys = docs.groupBy("_d", "_h").agg(F.count("*").alias("_copies"), F.max(F.length("text")).alias("n_chars"), F.max("doc_id").alias("doc_id"))
    rows = written(ordered(keys, [F.col("doc_id").desc_nulls_last(), F.col("_h")]).drop("_before"), "rows")
    total = rows.agg(F.count("*").alias("_total"))
    after = rows.crossJoin(F.broadcast(total)).select(((F.col("_rn") + F.col("_total") - 1) % F.col("_total")).alias("_rn"), F.col("_d").alias("_next_d"), F.col("_h").alias("_next_h"))
    rows = written(rows.join(after, "_rn"), "rows")
    # The head of each text that goes to the document before it; only these parts of texts move a second time.
    before = rows.select(F.col("_next_d").alias("_d"), F.col("_next_h").alias("_h"), F.col("_d").alias("_to_d"), F.col("_h").alias("_to_h"), F.floor(F.col("n_chars") / 2).cast("int").alias("_half"))
    heads = whole.join(before, ["_d", "_h"]).select(F.col("_to_d").alias("_d"), F.col("_to_h").alias("_h"), F.substring("text", F.lit(1), F.col("_half")).alias("_head"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("_head"))
    texts = whole.join(heads, ["_d", "_h"]).select("_d", "_h", "text", edited.alias("edited"))
    return rows.withColumn("n_chars", F.col("n_chars").cast("long")).drop("_rn"), texts


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text. Texts without words look like each other and like nothing else."""
    rows, texts = with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = texts.select("_d", "_h", F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("x"))
    each = signatures(both.select("_d", "_h", "x.edit", "x.text"), ["_d", "_h", "edit"], "text")
    pair = each.groupBy("_d", "_h").agg(*(F.max(F.when(F.col("edit") == k, F.col("sample"))).alias(name) for k, name in enumerate(("own", "changed"))))
    about = texts.select("_d", "_h", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    found = written(about.join(pair, ["_d", "_h"], "left"), "fingerprints")
    ahead = found.select(F.col("_d").alias("_next_d"), F.col("_h").alias("_next_h"), F.col("own").alias("_next"))
    found = found.join(rows, ["_d", "_h"]).join(ahead, ["_next_d", "_next_h"])
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    near = [likeness(F.col("own"), F.col(x)).alias(name) for x, name in (("changed", "near_edited"), ("_next", "near_next"))]
    return found.select("doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"), *near)
