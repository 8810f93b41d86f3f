"""Threshold-scaled document sketches: every five-word shingle hash below a fixed fraction of the hash space is kept.

Sketches of equal scale merge by union, and the share of one's hashes found in the other estimates containment however unequal the texts are.
DataFrame functions only. Words are the lower-cased runs of non-white-space; a text of fewer than five words has one shingle, an empty or null one none.
The fingerprint is 16 hex digits of the whole text's hash, a colon, and 8 hex digits for each kept hash, ascending; so equal texts have equal
fingerprints, also where nothing was kept. Likeness is the Jaccard estimate of the two sketches; where both are empty, 1 for equal whole-text hashes and else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions

SHINGLE, SCALE_BITS = 5, 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def sketch(text: Column, shingle: int = SHINGLE, scale_bits: int = SCALE_BITS) -> Column:
    """Sorted distinct 32-bit values: the leading bits of the hashes below 2^(64 - scale_bits), taken as unsigned."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))
        low = F.filter(hashes, lambda h: h < F.lit(-(1 << 63) + (1 << (64 - scale_bits))))
        kept = F.transform(low, lambda h: F.shiftright(h.bitwiseAND(F.lit((1 << (64 - scale_bits)) - 1)), 32 - scale_bits))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(kept))).otherwise(F.array().cast("array<bigint>"))

    # one evaluation of the word array for all its uses
    return F.element_at(F.transform(F.array(words(text)), of), 1)


def fingerprint(text: Column, kept: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(F.coalesce(text, F.lit(""))))), 16, "0"), F.lit(":"), F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ""))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Jaccard estimate of two sketches; `same` decides where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(same.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles found in b; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def _bucket(key: Column, edges: list) -> Column:
    """Number of edges at or below the key, by bisection; 0 for a null key."""
    if not edges:
        return F.lit(0)
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    array = F.array(*map(F.lit, edges))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(edges)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, *values: Column) -> DataFrame:
    """docs' doc_id, text and `values` as struct `cur`, and the same of the document next in ascending (doc_id, text) order as `nxt`; the first follows the last.

    Documents are dealt once, by ranges of doc_id; each range also gets the first document of the range after it.
    """
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    edges = sorted({c for c in cuts or []})
    bucket = _bucket(F.col("doc_id"), edges)
    first = docs.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    used = sorted(first, key=lambda r: r["b"])
    heads = [None if r["nulls"] else r["low"] for r in used]
    row = docs.select(F.struct("doc_id", "text", *values).alias("cur"), bucket.alias("b"))
    out = row.withColumn("copy", F.lit(False))
    if used:
        before = {r["b"]: used[i - 1]["b"] for i, r in enumerate(used)}
        known = [h for h in heads if h is not None]
        head = F.col("cur.doc_id").isin(known) if known else F.lit(False)
        if None in heads:
            head = head | F.col("cur.doc_id").isNull()
        target = F.get(F.array(*(F.lit(before.get(b, -1)) for b in range(len(edges) + 1))), F.col("b"))
        out = out.unionByName(row.where(head).select("cur", target.alias("b"), F.lit(True).alias("copy")))
    order = Window.partitionBy("b").orderBy("copy", F.col("cur.doc_id").asc_nulls_first(), F.col("cur.text").asc_nulls_first())
    return out.withColumn("nxt", F.lead("cur").over(order)).where(~F.col("copy")).select("cur", "nxt")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the estimated containments of the text in the edited and the next one."""
    pairs = with_next(docs, sketch(F.col("text")).alias("kept"))
    text, after = F.coalesce("cur.text", F.lit("")), F.coalesce("nxt.text", F.lit(""))
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    step = pairs.select("cur", F.col("nxt.kept").alias("next_kept"), (F.xxhash64(text) == F.xxhash64(after)).alias("same_next"), n.cast("long").alias("n_chars"), F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(after, F.lit(1), quarter)).alias("edited"))
    step = step.withColumn("edited_kept", sketch(F.col("edited")))
    mine, other = F.col("cur.kept"), F.col("edited_kept")
    return step.select(
        F.col("cur.doc_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("cur.text"), mine).alias("fingerprint"), fingerprint(F.col("edited"), other).alias("edited_fingerprint"),
        likeness(mine, other, F.coalesce("cur.text", F.lit("")) == F.col("edited")).alias("near_edited"), likeness(mine, F.col("next_kept"), F.col("same_next")).alias("near_next"),
        containment(mine, other).alias("contained_in_edited"), containment(mine, F.col("next_kept")).alias("contained_in_next"),
    )
