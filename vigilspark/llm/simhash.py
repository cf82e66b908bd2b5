"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves over a binary trie.

Fingerprints that are equal make one class (a group of copies costs one node). Subtrees of the trie are dealt
out to tasks, for each turn of the fingerprint that puts another of its blocks first; a task traverses its
subtree with itself, node pair by node pair, carries the bits that differ so far and drops a node pair as soon
as they exceed the budget. Each task returns a spanning forest of the links it found, never all pairs.

Cases: null and empty texts have fingerprint zero and are linked like any other; a very long text is hashed
whole, in a step of its own; repeated rows and equal texts share a class; null keys keep a fingerprint and a
null component unless a class gives them one; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.components import connected_components
from vigilspark.llm.util import checkpointed, steps

#: Node pairs with at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 32
#: Node pairs held at once; more wait on a stack.
FRONTIER = 400_000
#: Leaf pairs compared at once, about.
LEAVES = 500_000
#: Fingerprints of a subtree, about, and how many make it be dealt anew.
SUBTREE, CROWDED = 8192, 1 << 18
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 18


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lower-cased, joined by one space; fewer words: of all of them."""
    words = text.lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), seed)]
    if width == 3:
        return [digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:], strict=False)]
    return [digest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]


def fingerprints(texts: list[bytes], width: int, seed: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes, owners, sizes = [], [], np.zeros(len(texts), np.int64)
    total = np.zeros((len(texts), 64), np.int64)

    def spread() -> None:
        if not hashes:
            return
        flat = np.concatenate(hashes)
        lengths = np.array([len(h) for h in hashes])
        begins = np.cumsum(lengths) - lengths
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        np.add.at(total, np.array(owners), np.add.reduceat(bits, begins, axis=0, dtype=np.int32))
        hashes.clear()
        owners.clear()

    held = 0
    for i, text in enumerate(texts):
        own = np.array(shingle_hashes(text, width, seed), np.uint64)
        sizes[i] = len(own)
        for at in range(0, len(own), SPREAD):
            part = own[at : at + SPREAD]
            hashes.append(part)
            owners.append(i)
            held += len(part)
            if held >= SPREAD:
                spread()
                held = 0
    spread()
    return np.packbits(2 * total > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhash(docs: DataFrame, width: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text):
                fp = fingerprints([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()], width, seed)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, same: bool, depth: int = 0):
    """Yields index arrays (i, j) of all pairs with at most `budget` differing bits between the sorted
    fingerprints a and b; same: a is b, and each pair comes once, without i = j. depth: leading bits that are
    equal within a and within b."""
    if not len(a) or not len(b):
        return
    ints = lambda *x: [np.array([v], np.int64) for v in x]
    differing = int((int(a[0]) ^ int(b[0])) >> (64 - depth)).bit_count() if depth else 0
    if differing > budget:
        return
    stack = [(depth, *ints(0, len(a), 0, len(b), differing), np.array([same]))]
    while stack:
        level, a0, a1, b0, b1, d, own = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[s] for x in (a0, a1, b0, b1, d, own))) for s in (slice(half), slice(half, None))]
            continue
        n = (a1 - a0) * (b1 - b0)
        small = (n <= LEAF_PAIRS) | (level == 64)
        if small.any():
            at = np.flatnonzero(small)
            for part in np.split(at, np.searchsorted(np.cumsum(n[at]), np.arange(LEAVES, int(n[at].sum()), LEAVES))):
                count = n[part]
                row = np.repeat(part, count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = (b1 - b0)[row]
                i, j = a0[row] + k // wide, b0[row] + k % wide
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                near &= ~own[row] | (i < j)
                if near.any():
                    yield i[near], j[near]
        big = np.flatnonzero(~small)
        if not len(big):
            continue
        a0, a1, b0, b1, d, own = (x[big] for x in (a0, a1, b0, b1, d, own))
        bit = np.uint64(1 << (63 - level))
        kept = np.uint64(((1 << level) - 1) << (64 - level))
        am = np.clip(np.searchsorted(a, (a[a0] & kept) | bit), a0, a1)
        bm = np.clip(np.searchsorted(b, (b[b0] & kept) | bit), b0, b1)
        nothing = np.zeros(len(own), bool)
        children = [(a0, am, b0, bm, d, own), (am, a1, bm, b1, d, own), (a0, am, bm, b1, d + 1, nothing)]
        other = np.flatnonzero(~own)
        children.append((am[other], a1[other], b0[other], bm[other], d[other] + 1, nothing[other]))
        joined = [np.concatenate(x) for x in zip(*children, strict=True)]
        ok = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        stack.append((level + 1, *(x[ok] for x in joined)))


def forest(n: int, pairs) -> np.ndarray:
    """The smallest index in each index's component, from an iterable of index arrays (i, j)."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _leading(fp: Column, start: int, bits: int) -> Column:
    """`bits` bits of a fingerprint from `start` on, as a long."""
    return F.shiftrightunsigned(F.shiftleft(fp, start), 64 - bits)


def trie_links(classes: DataFrame, budget: int) -> DataFrame:
    """Links a, b between the nodes of classes (columns fp, node; fingerprints distinct) that join all fingerprints within
    `budget` differing bits: a spanning forest for each subtree.

    Of budget + 1 blocks of a fingerprint one has no differing bit, so subtrees of the trie are dealt out for each turn of the
    fingerprint that begins with another block: budget + 1 rows for each fingerprint, whatever the table. A subtree has
    the depth that leaves it some SUBTREE fingerprints; one that holds more than CROWDED is dealt anew by its whole block and,
    turn for turn, the blocks of what is left."""
    n = classes.count()
    blocks = budget + 1
    width = 64 // blocks
    depth = max(1, min(width, (n // SUBTREE).bit_length()))
    turns = F.array(*(F.struct(F.lit(r).alias("turn"), _leading(F.col("fp"), r * width, depth).alias("prefix")) for r in range(blocks)))
    dealt = classes.select("fp", "node", F.explode(turns).alias("t")).select("fp", "node", "t.turn", "t.prefix", F.lit(-1).alias("again"), F.lit(0).cast("long").alias("rest"))
    crowded = checkpointed(dealt.groupBy("turn", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("turn", "prefix"))
    if not crowded.isEmpty():
        left = 64 - width
        inner = max(1, left // blocks)
        turned = lambda r: F.shiftleft("fp", r * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - r * width)) if r else F.col("fp")
        whole = F.coalesce(*(F.when(F.col("turn") == r, turned(r)) for r in range(blocks)))
        many = dealt.join(crowded, ["turn", "prefix"], "left_semi").withColumn("w", whole)
        again = F.array(*(F.struct(F.lit(k).alias("again"), _leading(F.col("w"), width + k * inner, inner).alias("rest")) for k in range(blocks)))
        many = many.select("fp", "node", "turn", _leading(F.col("w"), 0, width).alias("prefix"), F.explode(again).alias("x")).select("fp", "node", "turn", "prefix", "x.again", "x.rest")
        dealt = dealt.join(crowded, ["turn", "prefix"], "left_anti").unionByName(many)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        node = group.column("node").to_numpy()
        turn = key[0].as_py() * width
        fp = (fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp
        order = np.argsort(fp, kind="stable")
        fp, node = fp[order], node[order]
        label = forest(len(fp), trie_pairs(fp, fp, budget, True))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": pa.array(node[linked], pa.int64()), "b": pa.array(node[label[linked]], pa.int64())})

    return dealt.groupBy("turn", "prefix", "again", "rest").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included)."""
    prints = checkpointed(simhash(docs, width, seed, key, text))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    known = classes.where("node is not null")
    reached = connected_components(trie_links(known, budget))
    named = known.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
