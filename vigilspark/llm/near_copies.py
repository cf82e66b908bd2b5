"""Near copies among texts, for the pipeline's SimHash stage: fingerprints within a budget of bits, by the trie join, and
texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

Such texts differ in some ten of 64 fingerprint bits, and a trie join with that budget visits nearly all pairs (README),
so minima under random permutations propose the second kind: 96 minima, in 24 bands of four; a pair at exactly 0.8 shares
no band with a probability of 3 in a million. Texts with equal sets are one node. In each bucket all nodes are first
compared with one of them, its pivot. Buckets whose nodes are then in more than one component are looked through by a task
each, or by one for each pair of blocks of MEMBERS where a bucket is larger; it compares pairs of unlike components, and
returns a link for two of them that it joins. So a large group of near copies makes links in proportion to its members.
A pair is compared in full, by its sets, unless the minima differ in so many places that a similarity of 0.8 is out of the
question (under LEAST_ALIKE of 96: 4.4 standard deviations). Sets travel for proposed pairs and to the buckets that are
looked through, and nowhere else.

Cases: null and empty texts have no runs; they share the fingerprint zero and are linked by it; fewer than five words are
one run; rows that repeat an id are rows of their own, told apart by the text; where they repeat that too, one stays.
A very long text is one step of a task, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import simhash
from vigilspark.llm.components import connected_components
from vigilspark.llm.identity import marked, numbered, repeated
from vigilspark.llm.util import checkpointed, discard, fresh_path, mix64, steps, swept, unused

WIDTH = 5
BANDS, ROWS = 24, 4
LEAST_ALIKE = 60
#: Entries of a block of comparisons within a bucket, and nodes of a bucket that one task compares with as many others.
BLOCK, MEMBERS = 4_000_000, 4096
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_sets(texts: list[bytes], seed: int) -> list[np.ndarray]:
    return [np.unique(np.array(simhash.shingle_hashes(t, WIDTH, seed), np.uint64)) for t in texts]


def minima(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none empty) a key for each band, and a byte of each minimum; keys of unlike bands don't meet."""
    flat = np.concatenate(sets)
    lengths = np.array([len(s) for s in sets])
    begins = np.cumsum(lengths) - lengths
    keys = np.zeros((len(sets), BANDS), np.uint64)
    marks = np.zeros((len(sets), BANDS * ROWS), np.uint8)
    for k, seed in enumerate(_SEEDS):
        least = np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), begins)
        keys[:, k // ROWS] = mix64(keys[:, k // ROWS] * np.uint64(1_000_003) + least + np.uint64(k))
        marks[:, k] = mix64(least) >> np.uint64(56)
    return keys, marks


def described(docs: DataFrame, seed: int) -> DataFrame:
    """identity, doc_id, text -> identity, doc_id, fp (SimHash), n (runs), same (equal for equal sets), keys, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                sets = run_sets(texts, seed)
                some = [i for i, s in enumerate(sets) if len(s)]
                same, keys, marks = np.zeros(len(sets), np.uint64), [None] * len(sets), [None] * len(sets)
                if some:
                    same[some] = [mix64(sets[i]).sum(dtype=np.uint64) for i in some]
                    for i, k, m in zip(some, *minima([sets[i] for i in some]), strict=True):
                        keys[i], marks[i] = k.view(np.int64), m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("identity"),
                        batch.column("doc_id"),
                        pa.array(simhash.fingerprints(texts, 3, seed).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(same.view(np.int64)),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(marks, pa.binary()),
                    ],
                    names=["identity", "doc_id", "fp", "n", "same", "keys", "marks"],
                )

    return docs.mapInArrow(run, "identity string, doc_id long, fp long, n long, same long, keys array<long>, marks binary")


def _fits(x: str, y: str) -> str:
    return f"5 * least({x}, {y}) >= 4 * greatest({x}, {y})"


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs a, b those whose sizes and minima allow a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_ALIKE))

    both = pairs
    for end, mark, n in (("a", "x", "na"), ("b", "y", "nb")):
        both = both.join(nodes.select(F.col("node").alias(end), F.col("marks").alias(mark), F.col("n").alias(n)), end)
    return both.where(_fits("na", "nb")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """node, runs (its sorted set) for nodes (node, identity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                sets = run_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], seed)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "runs"])

    # rows of one identity have one text
    return checkpointed(docs.join(nodes, "identity").select("node", "text").mapInArrow(run, "node long, runs binary").dropDuplicates(["node"]))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[at] == y).sum())
    return 9 * common >= 4 * (len(x) + len(y))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """Of the pairs a, b those with a similarity of 0.8 or more, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes.select("node", "identity"), "node")
    sets = _sets(wanted, docs, seed)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    return checkpointed(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _across(group: pa.Table) -> pa.Table:
    """Links between nodes of a bucket, of unlike components: one for any two components that they join. own: the node's block;
    where a task has two blocks, pairs are of one of each."""
    group = group.combine_chunks()
    node, c, n, own = (group.column(x).to_numpy() for x in ("node", "component", "n", "own"))
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(node), -1)
    runs = [np.frombuffer(r.as_py(), np.uint64) for r in group.column("runs")]
    parent = {int(x): int(x) for x in np.unique(c)}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mixed = own.min() != own.max()
    a, b = [], []
    step = max(1, BLOCK // (len(node) * BANDS * ROWS))
    for at in range(0, len(node), step):
        rows = slice(at, at + step)
        near = (c[rows, None] < c) & (5 * np.minimum(n[rows, None], n) >= 4 * np.maximum(n[rows, None], n))
        if mixed:
            near &= own[rows, None] != own
        i, j = np.nonzero(near)
        for part in np.array_split(np.arange(len(i)), max(1, len(i) * BANDS * ROWS // BLOCK)):
            alike = (marks[at + i[part]] == marks[j[part]]).sum(1)
            order = np.argsort(-alike, kind="stable")  # the likeliest first: they spare others
            for k in order[: int((alike >= LEAST_ALIKE).sum())].tolist():
                x, y = int(at + i[part[k]]), int(j[part[k]])
                p, q = top(int(c[x])), top(int(c[y]))
                if p != q and similar(runs[x], runs[y]):
                    parent[max(p, q)] = min(p, q)
                    a.append(min(node[x], node[y]))
                    b.append(max(node[x], node[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(rows: DataFrame, docs: DataFrame, budget: int, seed: int) -> DataFrame:
    """node, component (smallest node reachable) of the rows that have a link. rows: `described`, with node; docs: identity, text."""
    prints = checkpointed(rows.groupBy("fp").agg(F.min("node").alias("first")))
    sets = checkpointed(rows.where("n > 0").groupBy("same", "n").agg(F.min("node").alias("node"), F.first("identity").alias("identity"), F.first("keys").alias("keys"), F.first("marks").alias("marks")))
    by_print = rows.select("node", "fp").join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    by_set = rows.select("same", "n", F.col("node").alias("a")).join(sets.select("same", "n", F.col("node").alias("b")), ["same", "n"]).where("a <> b").select("a", "b")
    links = checkpointed(by_print.unionAll(by_set).unionAll(simhash.trie_links(prints.select("fp", F.col("first").alias("node")), budget)))

    banded = sets.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("key", "pivot")
    members = checkpointed(banded.join(buckets, "key"))
    tried = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found = _verified(checkpointed(_alike(tried, sets)), sets, docs, seed)
    reached = checkpointed(connected_components(links.unionAll(found)))
    named = members.join(reached, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    apart = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = checkpointed(named.join(apart, "key", "left_semi"))
    if left.isEmpty():
        return reached
    wanted = left.select("node").distinct().join(sets.select("node", "identity", "n", "marks"), "node")
    held = wanted.drop("identity").join(_sets(wanted.select("node", "identity"), docs, seed), "node")
    sizes = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = left.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    further = checkpointed(dealt.join(held, "node").groupBy("key", "low", "high").applyInArrow(_across, "a long, b long"))
    if further.isEmpty():
        return reached
    return connected_components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(further))


def distinct_documents(docs: DataFrame, budget: int = 2, seed: int = 42) -> DataFrame:
    """The documents, with their columns, less all but one of each group: the one with the smallest doc_id stays (null ids
    come last; of rows that share the id, the one whose text has the smallest hash)."""
    with swept(docs.sparkSession):
        return _distinct_documents(docs, budget, seed)


def _distinct_documents(docs: DataFrame, budget: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    own, number = unused(docs, "identity", "number")
    identity = F.md5(F.concat_ws(":", marked("doc_id"), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(own, identity)
    slim = docs.select(identity.alias("identity"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = fresh_path(spark, "described")
    described(slim, seed).select(F.monotonically_increasing_id().alias("node"), "*").write.parquet(path)
    rows = spark.read.parquet(path)
    repeats = repeated(rows, "identity")
    reached = components(rows, slim.select("identity", "text"), budget, seed)
    grouped = rows.select("node", "identity", "doc_id").join(reached, "node")
    grouped = checkpointed(grouped.select("identity", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "identity").alias("rank")))
    first = grouped.groupBy("component").agg(F.min("rank").alias("first"))
    gone = grouped.join(first, "component").where("identity <> first.identity").select(F.col("identity").alias(own)).distinct()
    gone = checkpointed(gone)
    discard(spark, path)
    kept = keyed.join(gone, own, "left_anti")
    if repeats is not None:
        kept = numbered(kept, own, repeats.withColumnRenamed("identity", own), number).where(F.col(number) == 0)
    return kept.select(*docs.columns)
