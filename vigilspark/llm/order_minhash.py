"""Order MinHash fingerprints of documents, from DataFrame functions only.

A text is cut into runs of `k` words (fewer words: one run). Each run gets its occurrence number, and a hash of
both. The hash picks a bin and an order within it; of each bin the `keep` smallest are selected, put back into text
order, and the tuple of their runs is hashed. The signature is the list of (bin, tuple hash): moving or replacing
words changes the tuples, so the share of equal entries follows the edit distance, not only the set of runs.

Runs are packed into longs (33 bits of hash over 31 bits of position), so one sort of a long array groups equal
runs for their occurrence numbers and orders the bins.

Cases: null texts are empty; an empty text has an empty signature, and two of them are alike (1.0); equal texts have
equal fingerprints; a null doc_id comes before all others and repeated ones are ordered by text; other columns are
dropped; an empty table gives an empty result; a single document is its own next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POSITION = (1 << 31) - 1


def _packed(x: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftright(x, 31), 31).bitwiseOR(position.cast("long"))


def _bin(x: Column, bins: int) -> Column:
    return F.shiftright(x, 64 - (bins.bit_length() - 1))


def with_signature(df: DataFrame, text: str, name: str, k: int = 5, bins: int = 64, keep: int = 2) -> DataFrame:
    """Adds column `name`: the signature as array<int>, (bin << 16 | 16 bits of the tuple's hash) in order of bins."""
    w, r, s, o, low, t = (f"_{name}_{x}" for x in "wrsolt")
    n = F.size(r)
    df = df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(k))))
    df = df.withColumn(r, F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(runs))
    df = df.withColumn(s, F.sort_array(F.transform(r, _packed)))
    # Occurrence numbers: positions in the stretches of equal runs. The first keeps its hash.
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(F.get(F.col(s), i), 31) != F.shiftright(F.get(F.col(s), i - 1), 31)))
    df = df.withColumn(o, F.when(F.size(F.array_distinct(F.transform(s, lambda x: F.shiftright(x, 31)))) < n, starts))
    numbers = F.flatten(F.transform(o, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(F.col(o), j + 1), n) - a - 1)))
    numbered = F.zip_with(s, numbers, lambda x, c: F.when(c == 0, x).otherwise(_packed(F.xxhash64(F.shiftright(x, 31), c), x.bitwiseAND(F.lit(_POSITION)))))
    df = df.withColumn(s, F.when(F.col(o).isNull(), F.col(s)).otherwise(F.sort_array(numbered)))
    df = df.withColumn(low, F.filter(s, lambda x, i: (i < keep) | (_bin(F.get(F.col(s), i - keep), bins) != _bin(x, bins))))
    # The selected runs by bin and text order; bins count from 0 here.
    df = df.withColumn(t, F.sort_array(F.transform(low, lambda x: F.shiftleft(_bin(x, bins) + bins // 2, 31).bitwiseOR(x.bitwiseAND(F.lit(_POSITION))))))
    group = lambda x: F.shiftright(x, 31)
    run = lambda x: F.get(F.col(r), x.bitwiseAND(F.lit(_POSITION)).cast("int"))

    def entry(x: Column, i: Column) -> Column:
        later = [F.get(F.col(t), i + j) for j in range(1, keep)]
        value = F.xxhash64(run(x), *(F.when(group(y) == group(x), run(y)) for y in later))
        first = (i == 0) | (group(F.get(F.col(t), i - 1)) != group(x))
        return F.when(first, F.shiftleft(group(x), 16).bitwiseOR(value.bitwiseAND(F.lit(0xFFFF))).cast("int"))

    df = df.withColumn(name, F.array_compact(F.transform(t, entry)))
    return df.drop(w, r, s, o, low, t)


def as_text(signature: str) -> Column:
    """A signature as a string: six hex digits for each entry."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The share of the bins of either signature in which both hold the same tuple; 1 for two empty ones."""
    binned = lambda c: F.transform(c, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(binned(a), binned(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _bucket(cuts: list[int], x: Column) -> Column:
    """How many cuts after the first are at or below x, by halving."""
    array, steps = F.lit(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(array, low + step) <= x, low + step).otherwise(low))


def with_next(docs: DataFrame, carried: list[str], key: str = "doc_id", tie: str = "text", rows_per_task: int = 4000) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row by ascending key, after the last the first.

    Rows are dealt by ranges of the key between cuts taken from its quantiles (some thousand numbers at most, whatever
    the table). A row at a cut also goes to the range before as its end, so no range needs another one's rows."""
    key_of = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ranges = max(1, min(16384, math.ceil(docs.count() / rows_per_task)))
    points = F.percentile_approx(key_of, [i / ranges for i in range(1, ranges)], 20 * ranges) if ranges > 1 else F.array().cast("array<bigint>")
    least, found = docs.agg(F.min(key_of), points).first()
    cuts = sorted({least if least is not None else 0, *(found or [])})
    b = _bucket(cuts, F.col("_key"))
    rows = docs.withColumn("_key", key_of).withColumn("_b", b)
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("end"))
    before = F.struct(F.when(F.col("_b") == 0, len(cuts) - 1).otherwise(F.col("_b") - 1).alias("b"), (F.col("_b") == 0).cast("int").alias("wrap"), F.lit(True).alias("end"))
    places = F.when(F.get(F.lit(cuts), F.col("_b")) == F.col("_key"), F.array(own, before)).otherwise(F.array(own))
    rows = rows.withColumn("_p", F.explode(places))
    order = Window.partitionBy("_p.b").orderBy("_p.wrap", "_key", tie)
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return rows.where(~F.col("_p.end")).drop("_key", "_b", "_p")


def edited_fingerprints(docs: DataFrame, k: int = 5, bins: int = 64, keep: int = 2) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: the last quarter replaced by the next document's beginning."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signature(rows, "text", "sig", k, bins, keep), ["text", "sig"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_q", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - _q)"), F.expr("left(next_text, _q)")))
    rows = with_signature(rows.drop("text", "next_text"), "edited", "edited_sig", k, bins, keep)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
