r"""Threshold-scaled sketches of documents, in DataFrame functions only.

A sketch holds every hash of a text's five-word shingles that lies below a fixed
fraction of the hash space, so its size grows with the text and the sketch of a
union is the union of the sketches. That makes containment of a short text in a very
long one as easy to estimate as likeness of equals: both texts sampled the same shingles.

A text with words but no hash below the fraction keeps its least hash, so
that short texts have a sketch; ``merged`` drops such a hash again when another text brings hashes below.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hashes whose first hexadecimal digit is below this one are kept: two sixteenths of all.
BELOW = "2"
#: Words in a shingle, and hexadecimal digits that are kept of a hash.
WORDS, DIGITS = 5, 16
#: Rows that a range of the order holds about, and the most ranges (the bounds are collected and sent to all tasks).
RANGE_ROWS, RANGES = 64, 1 << 16


def words(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the sketch of the column ``text``: distinct hashes (hexadecimal), rising.

    A text of fewer than five words (but some) has one shingle, its whole sequence; a null or empty text has an empty sketch.
    """
    shingle = ", ".join(f"_w[i + {k}]" for k in range(WORDS))
    hashed = F.expr(
        f"""case when size(_w) = 0 then cast(array() as array<string>)
        when size(_w) < {WORDS} then array(left(md5(cast(array_join(_w, ' ') as binary)), {DIGITS}))
        else transform(sequence(0, size(_w) - {WORDS}), i -> left(md5(cast(concat_ws(' ', {shingle}) as binary)), {DIGITS})) end"""
    )
    out = rows.withColumn("_w", words(F.col(text))).withColumn("_w", hashed)
    low = F.array_sort(F.array_distinct(F.filter("_w", lambda h: h < BELOW)))
    least = F.when(F.size("_w") > 0, F.array(F.array_min("_w"))).otherwise(F.col("_w"))
    out = out.withColumns({name: low, "_w": least})
    return out.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.col("_w"))).drop("_w")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together (without shingles across their border)."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < BELOW)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has too, from the sketches; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other holds too: 1 for equal ones, 1 for two empty ones, 0 if just one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / least)


def packed(sketch: Column) -> Column:
    """A sketch as bytes, eight a hash."""
    return F.unhex(F.array_join(sketch, ""))


def unpacked(sketch: Column) -> Column:
    """The sketch of ``packed`` bytes."""
    return F.regexp_extract_all(F.lower(F.hex(sketch)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def in_ranges(docs: DataFrame, rows: int = RANGE_ROWS, most: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``_tie`` and ``_range``, heads of the ranges): ranges of falling doc_id, then falling hash of the text, numbered in order.

    Bounds are approximate quantiles of doc_id (an integer; nulls come last). An id that is a bound several
    times, as it holds many rows, is cut into as many parts by the hash. Heads have the ``doc_id`` and ``_tie`` of each
    range's first row, and ``_after``, the range before it (for the first range the last): at most ``2 * most`` narrow rows.
    """
    n = docs.count()
    parts = max(1, min(most, -(-n // rows)))
    found = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    held: dict[int, int] = {}
    for b in found:
        held[int(b)] = held.get(int(b), 0) + 1
    above = sorted(held, reverse=True)
    # 0: ids above all bounds; then, bound by bound, as many ranges of its own id as it is a bound, and one of ids below it
    starts = np.cumsum([1, *(held[b] + 1 for b in above)])
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    if above:
        steps = ", ".join(str(1 << k) for k in reversed(range(len(above).bit_length())))
        sent = {"_above": np.asarray(above), "_starts": starts[:-1], "_shares": np.asarray([held[b] for b in above])}
        docs = docs.withColumns({k: F.lit(v.astype(np.int64)) for k, v in sent.items()})
        # how many bounds are not below the id, by halving
        docs = docs.withColumn(
            "_k",
            F.expr(
                f"""case when doc_id is null then {len(above)} else aggregate(array({steps}), 0, (low, step) ->
                case when low + step <= {len(above)} and get(_above, low + step - 1) >= doc_id then low + step else low end) end"""
            ),
        )
        own, share = F.get("_starts", F.col("_k") - 1), F.get("_shares", F.col("_k") - 1)
        part = F.least(F.greatest(F.floor((0.5 - F.col("_tie").cast("double") / 2.0**64) * share), F.lit(0)), share - 1)
        number = F.when(F.col("_k") == 0, 0).when(F.get("_above", F.col("_k") - 1) == F.col("doc_id"), own + part).otherwise(own + share)
        docs = docs.withColumn("_range", number.cast("int")).drop("_k", *sent)
    else:
        docs = docs.withColumn("_range", F.lit(0))
    first = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_tie")).alias("h")
    heads = docs.groupBy("_range").agg(first)
    # one narrow row for each range that has rows
    order = Window.orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lag("_range").over(order), F.last("_range").over(whole))
    return docs, heads.select(F.col("h.doc_id").alias("doc_id"), F.col("h._tie").alias("_tie"), after.alias("_after"))


def with_next(docs: DataFrame, columns: tuple[str, ...], rows: int = RANGE_ROWS, most: int = RANGES) -> DataFrame:
    """``docs`` (doc_id, text and ``columns``) with ``next``, a struct of the text and ``columns`` of the document next in falling doc_id.

    After the last comes the first; a lone document is its own next. Rows that share a doc_id
    follow in falling hash of their texts, so rows that are repeated follow each other.
    Each text is shuffled once, to its range of the order; ranges' first rows go to the range before as well.
    """
    docs, heads = in_ranges(docs, rows, most)
    # at most 2 * most rows of three numbers
    docs = docs.withColumn("_k", F.coalesce("doc_id", F.lit(0))).withColumn("_null", F.col("doc_id").isNull())
    heads = heads.select(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_null"), "_tie", "_after")
    docs = docs.join(F.broadcast(heads), ["_k", "_null", "_tie"], "left")
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("_after").alias("r"), F.lit(True).alias("extra"))
    places = F.when(F.col("_after").isNull(), F.array(own)).otherwise(F.array(own, extra))
    docs = docs.withColumn("_place", F.explode(places))
    order = Window.partitionBy("_place.r").orderBy("_place.extra", F.col("doc_id").desc_nulls_last(), F.desc("_tie"), F.desc("text"))
    docs = docs.withColumn("next", F.lead(F.struct("text", *columns)).over(order)).where("not _place.extra")
    return docs.drop("_k", "_null", "_tie", "_after", "_range", "_place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's sketch, and that of its edited text, whose last half gives way to the beginning of the next document.

    (doc_id, n_chars, edited, sketch, edited_sketch, next_sketch). A null text counts as empty. Order of ``with_next``;
    repeated rows each get a row. No documents give no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "_s").withColumn("sketch", packed(F.col("_s"))).drop("_s"), ("sketch",))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next.text", half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = rows.withColumns({c: unpacked(F.col(c)) for c in ("sketch", "next_sketch")})
    return with_sketch(rows, "edited", "edited_sketch")


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``fingerprints``; sketches are joined to strings."""
    return fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
