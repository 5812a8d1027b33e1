"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is cut into units after white space, after a few letters and digits, and after every character beyond Latin-1; so units
are pieces of words in Latin script and single characters in all others, and each cut depends on one character alone. Every 2
units in a row are hashed, and a k-mer of K units is chosen if the least of the hashes inside it lies at its left or right edge.
The choice depends on the k-mer alone, so an edit moves no anchor beyond the k-mers that it touches; after an insertion the same
anchors are found at shifted offsets. k-mers of single characters in
every script, chosen by higher-order functions, took 3073 CPU seconds a GB with the check tool, beyond its limit of 1800 (README).

A fingerprint is the sequence of anchors, each the offset (in units) and a 32-bit hash of its k-mer. Two fingerprints are matched
by position: an anchor together with its distance to the next one. Shifting a text keeps these, so an edit costs the anchors it
touches and one distance, while equal anchors in another arrangement don't match. likeness() is the Jaccard index of them.

Defined results: a null text counts as empty and has an empty fingerprint; a text with fewer units than a k-mer, or without a
chosen k-mer, has one anchor, its whole; two empty fingerprints are alike (1.0), an empty one and another are not (0.0). Rows
with a null id come first; rows that repeat an id are ordered by a hash of their text, and equal rows count as one document with
a row each. Texts of any length are taken whole. An empty table gives an empty result. Extra input columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Units of a k-mer. Inner hashes cover 2 units, so K - 1 of them lie in a k-mer.
K = 6
#: Characters that end a unit: white space, four letters and three digits, and all beyond Latin-1.
LAST = r"\s048dDLT\x{100}-\x{10FFFF}"
UNIT = f"[^{LAST}]++[{LAST}]?+|[{LAST}]"
ANCHORS = "array<struct<at:int,h:bigint>>"


def units(text: Column) -> Column:
    """array<string>: the units of a text, which joined give it back."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def hashes(of: Column) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w))


def with_chosen(df: DataFrame, unit_hashes: str, out_col: str) -> DataFrame:
    """df with out_col: array<struct<at, h>> of the chosen k-mers of an array of unit hashes, in order of position."""
    s = "__tl_s"
    u, n = F.col(unit_hashes), F.size(unit_hashes)
    out = df.withColumn(s, F.when(n >= K, F.zip_with(F.slice(u, F.lit(1), n - 1), F.slice(u, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))))
    # position i is chosen if min(s[i], s[i + K - 2]) <= min(s[i + 1 .. i + K - 3]); the k-mer's hash joins its inner hashes
    at = lambda i, d: F.get(F.col(s), i + d)
    chosen = lambda i: F.least(at(i, 0), at(i, K - 2)) <= F.least(*[at(i, d) for d in range(1, K - 2)])
    kmer = lambda i: F.struct(i.alias("at"), F.shiftrightunsigned(F.xxhash64(*[at(i, d) for d in range(0, K - 1, 2)], F.get(u, i + K - 1)), 32).alias("h"))
    found = F.when(n >= K, F.transform(F.filter(F.sequence(F.lit(0), n - K), chosen), kmer)).otherwise(F.array().cast(ANCHORS))
    return out.withColumn(out_col, found).drop(s)


def or_whole(chosen: Column, unit_hashes: Column) -> Column:
    """The chosen k-mers, or where there are none, one anchor for the whole text."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.shiftrightunsigned(F.xxhash64(unit_hashes), 32).alias("h")))
    return F.when(F.size(chosen) > 0, chosen).when(F.size(unit_hashes) > 0, whole).otherwise(F.array().cast(ANCHORS))


def with_anchors(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df with out_col: array<struct<at, h>> of the anchors of a text, in order of position."""
    out = df.withColumn("__tl_u", hashes(units(F.coalesce(F.col(text_col), F.lit("")))))
    out = with_chosen(out, "__tl_u", "__tl_f")
    return out.withColumn(out_col, or_whole(F.col("__tl_f"), F.col("__tl_u"))).drop("__tl_u", "__tl_f")


def with_both_anchors(df: DataFrame, kept: str, rest: str, taken: str) -> DataFrame:
    """df with anchors, of kept + rest, and edited_anchors, of kept + taken.

    All units of the kept part but its last are those of both texts, and the k-mers inside them are looked at once.
    """
    out = df.withColumn("__tl_k", units(F.col(kept)))
    last = F.coalesce(F.get("__tl_k", F.size("__tl_k") - 1), F.lit(""))
    out = out.withColumn("__tl_h", hashes(F.slice("__tl_k", F.lit(1), F.greatest(F.size("__tl_k") - 1, F.lit(0)))))
    out = out.withColumn("__tl_u", F.concat("__tl_h", hashes(units(F.concat(last, F.col(rest))))))
    # the first k-mer that reaches beyond the common units
    out = out.withColumn("__tl_first", F.greatest(F.size("__tl_h") - (K - 1), F.lit(0)))
    out = out.withColumn("__tl_t", F.concat(F.slice("__tl_h", F.col("__tl_first") + 1, F.lit(K - 1)), hashes(units(F.concat(last, F.col(taken))))))
    out = with_chosen(with_chosen(out, "__tl_u", "__tl_f"), "__tl_t", "__tl_g")
    moved = F.transform("__tl_g", lambda x: F.struct((x["at"] + F.col("__tl_first")).alias("at"), x["h"].alias("h")))
    out = out.withColumn("__tl_e", F.concat(F.filter("__tl_f", lambda x: x["at"] < F.col("__tl_first")), moved))
    edited_units = F.concat(F.slice("__tl_h", F.lit(1), F.col("__tl_first")), F.col("__tl_t"))
    out = out.withColumn("anchors", or_whole(F.col("__tl_f"), F.col("__tl_u"))).withColumn("edited_anchors", or_whole(F.col("__tl_e"), edited_units))
    return out.drop("__tl_k", "__tl_h", "__tl_u", "__tl_first", "__tl_t", "__tl_f", "__tl_g", "__tl_e")


def placed(anchors: Column) -> Column:
    """array<int>: each anchor with its distance to the next one (0 for the last), as a hash."""
    return F.transform(anchors, lambda x, i: F.shiftright(F.xxhash64(x["h"], F.coalesce(F.get(anchors, i + 1)["at"] - x["at"], F.lit(0))), 32).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of placed anchors, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def as_string(anchors: Column) -> Column:
    """offset.hash by anchor, in hexadecimal."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.concat(F.hex(x["at"]), F.lit("."), F.hex(x["h"]))), " "))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By distinct document key (k, h): the previous key, its number of characters, and whether the key has a previous one.

    Keys alone are dealt by range, and a window over each range finds what comes before; the ranges' ends meet in a table of
    one row by range. The first document follows the last.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = docs.select(F.coalesce(docs[doc_id].cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"), F.length(text).cast("bigint").alias("n"))
    ranged = keys.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("k", "h")
    me = F.struct("k", "h", "n")
    # written, because both uses below must see the same parts
    distinct = materialize(ranged.groupBy("part", "k", "h").agg(F.max("n").alias("n")), "keys")
    lagged = distinct.select("part", "k", "h", "n", F.lag(me).over(order).alias("before"))
    ends = distinct.groupBy("part").agg(F.max(me).alias("last"))
    # one row by partition of a shuffle: a bounded number, gathered for one window
    over = Window.orderBy("part")
    every = Window.partitionBy(F.lit(1))
    ends = ends.select("part", F.coalesce(F.lag("last").over(over), F.max_by("last", "part").over(every)).alias("prior"))
    joined = lagged.join(F.broadcast(ends), "part")
    return joined.select("k", "h", F.coalesce("before", "prior").alias("before")).select("k", "h", F.col("before.k").alias("bk"), F.col("before.h").alias("bh"), F.col("before.n").alias("bn"))


def compare(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Whole texts are shuffled once, to meet their neighbour's key; to the previous document go only the first characters that it
    takes over and the placed anchors. Rows that repeat an id and a text meet one row of their key.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[doc_id].cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    met = rows.join(neighbours(docs, doc_id, text_col).hint("shuffle_merge"), ["k", "h"])
    # both uses of rows keep the same columns, so that their shuffle is done once
    one = Window.partitionBy("k", "h").orderBy("doc_id")
    sent = met.withColumn("__tl_no", F.row_number().over(one)).where("__tl_no = 1")
    sent = with_anchors(sent, "text", "next_anchors").select(F.col("bk").alias("k"), F.col("bh").alias("h"), F.col("text").substr(F.lit(1), F.floor(F.col("bn") / 4).cast("int")).alias("taken"), placed(F.col("next_anchors")).alias("next_placed"))
    pairs = rows.join(sent.hint("shuffle_merge"), ["k", "h"]).withColumn("n", F.length("text"))
    kept = F.col("n") - F.floor(F.col("n") / 4).cast("int")
    pairs = pairs.withColumn("kept", F.col("text").substr(F.lit(1), kept)).withColumn("rest", F.col("text").substr(kept + 1, F.col("n")))
    pairs = with_both_anchors(pairs, "kept", "rest", "taken").withColumn("edited", F.concat("kept", "taken"))
    pairs = pairs.withColumn("placed", placed(F.col("anchors"))).withColumn("edited_placed", placed(F.col("edited_anchors")))
    return pairs.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_string(F.col("anchors")).alias("fingerprint"), as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("placed"), F.col("edited_placed")).alias("near_edited"), likeness(F.col("placed"), F.col("next_placed")).alias("near_next"),
    )
