"""Mixing sources to target weights with a low-discrepancy schedule, from DataFrame functions only.

Each source's documents are put into a fixed pseudo-random order and cut into blocks of equal numbers of words.
Slots of the mix are golden-ratio points in [0, 1), mapped through the sources' cumulative weights; the r-th slot
of a source takes its r-th block, and starts over after the last. So at any place of the mix the sources are near
their shares, and each source's words come within a few blocks of its target.

Nothing needs one source's rows in one task: running sums over documents and ranks of slots are taken within
fixed chunks of a source and added to the sums of the chunks before. The order is by a hash of id, text and source and,
where rows repeat in all three, their number, so neither a null id nor a repeated row crowds a chunk. What works on one
row per source stands in one task.

Cases: null texts have size 0; size-0 documents are taken 0 times; the null source comes last; sources without words
get target 0; repeated rows, null ids and repeated ids count each as a document of its own; a very long text is cut by
as many blocks as it has; an empty table gives an empty result; other columns pass through mixed_documents, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.identity import marked, numbered, repeated
from vigilspark.llm.util import WORD_PATTERN, checkpointed, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 256
LEAST_BLOCKS = 256
GOLDEN = 0.6180339887498949
SLOT_CHUNK = 1 << 16
CELLS = 4096


def identity(seed: int) -> Column:
    """A hash of a document's id, text and source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), marked("doc_id"), F.md5(F.coalesce("text", F.lit(""))), marked("source")))


def sized(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size (words), identity."""
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD_PATTERN))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), identity(seed).alias("identity"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, sid, source_size, target. Works on one row per source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(w) - 1)
    t = t.withColumn("weight", F.get(F.lit(list(weights)), F.col("sid") % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    # Water level: sources by the level at which they are full; the first level that holds with those before it full.
    by = Window.orderBy("level", "sid")
    whole = Window.orderBy("level", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("try", (F.sum("source_size").over(whole) * F.lit(share) - full) / rest)
    t = t.withColumn("water", F.first(F.when(F.col("try") <= F.col("level"), F.col("try")), ignorenulls=True).over(whole))
    t = t.withColumn("target", F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")))
    return t.select("source", "sid", "source_size", "target")


def schedule(sources: DataFrame, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, least: int = LEAST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(sources with their blocks, slots). Slots: slot, sid, turn (rank in the source), block.

    A source has blocks of at most `block` words, and at least `least` of them or one for each word."""
    s = sources.withColumn("blocks", F.least("source_size", F.greatest(F.ceil(F.col("source_size") / block), F.lit(least))))
    s = s.withColumn("want", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("slots", F.sum("want").over(whole)).withColumn("high", F.sum("want").over(w) / F.col("slots"))
    s = checkpointed(s.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0))))
    total = s.agg(F.max("slots")).first()[0] or 0
    point = (F.col("id").cast("double") + 0.5) * F.lit(GOLDEN)
    slots = s.sparkSession.range(round(total)).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    wide = s.where("want > 0").select("sid", "blocks", "low", "high")
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("int")
    wide = wide.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    hit = slots.join(wide, "cell").where("u >= low and u < high").select("slot", "sid", "blocks", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    counts = hit.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("r", rank).join(before, ["sid", "chunk"]).withColumn("turn", F.col("before") + F.col("r"))
    ranked = ranked.where(F.col("turn") < F.col("blocks") * most)
    return s, ranked.select("slot", "sid", "turn", (F.col("turn") % F.col("blocks")).alias("block"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes (with their place in the order) with sid, source_size, target, blocks, start (words of the source before the
    document) and row keys."""
    rows = sizes.join(sources.select(F.col("source").alias("_s"), "sid", "source_size", "target", "blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("chunk", F.substring("place", 1, 3))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    w = Window.partitionBy("sid", "chunk").orderBy("place")
    inner = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("inner", inner).withColumn("row", F.row_number().over(w))
    return rows.join(before, ["sid", "chunk"]).withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")


def _block_at(p: str) -> str:
    """The block that holds a source's word number p: the first `r` blocks have q + 1 words, the others q."""
    return f"if({p} < r * (q + 1), {p} div (q + 1), r + ({p} - r * (q + 1)) div greatest(q, 1))"


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    rows, slots, _ = _blocks_and_slots(docs, seed)
    cut = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence({_block_at('start')}, {_block_at('(start + size - 1)')})")))
    edge = lambda j: f"(({j}) * q + least({j}, r))"
    cut = cut.withColumn("words", F.expr(f"least(start + size, {edge('block + 1')}) - greatest(start, {edge('block')})"))
    taken = cut.join(slots.select("sid", "block"), ["sid", "block"]).groupBy("sid", "chunk", "row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, ["sid", "chunk", "row"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _place(identity: str, number: str) -> Column:
    return F.when(F.col(number) == 0, F.col(identity)).otherwise(F.md5(F.concat_ws(":", F.col(identity), F.col(number).cast("string"))))


def _blocks_and_slots(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Placed documents, slots, and the identities that repeat."""
    sizes = checkpointed(sized(docs, seed))
    sources, slots = schedule(targets(sizes))
    repeats = repeated(sizes, "identity")
    ordered = numbered(sizes, "identity", repeats, "number").withColumn("place", _place("identity", "number")).drop("identity", "number")
    rows = placed(ordered, sources)
    return rows.withColumn("q", F.expr("source_size div greatest(blocks, 1)")).withColumn("r", F.expr("source_size % greatest(blocks, 1)")), slots, repeats


def _copies(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """place, copies: how often the mix takes the block in which a document starts."""
    at = rows.where("size > 0").select("place", "sid", F.expr(_block_at("start")).alias("block"))
    return at.join(slots.select("sid", "block"), ["sid", "block"]).groupBy("place").agg(F.count(F.lit(1)).cast("int").alias("copies"))


def copies(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, copies: how often the mix of whole documents takes each row that it takes."""
    rows, slots, _ = _blocks_and_slots(docs, seed)
    return rows.select("doc_id", "place").join(_copies(rows, slots), "place").select("doc_id", "copies")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix, whole: a document appears as often as the mix takes its block."""
    rows, slots, repeats = _blocks_and_slots(docs, seed)
    own, number, place, times, copy = unused(docs, "identity", "number", "place", "times", "copy")
    n = _copies(rows, slots).select(F.col("place").alias(place), F.col("copies").alias(times))
    if repeats is not None:
        repeats = repeats.withColumnRenamed("identity", own)
    out = numbered(docs.withColumn(own, identity(seed)), own, repeats, number)
    out = out.withColumn(place, _place(own, number)).join(n, place)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
