"""URL filters: rules first, then the log-likelihood ratio of two character models.

Rules are a host (with all its subdomains) and the beginning of a path; the longest that fits decides. URLs that a rule
decides are the labelled examples: variable-order Markov models over the host's and path's characters are counted for
accepted and rejected ones, exactly, by grouped aggregation of packed n-grams that are joined with those to score, and smoothed
from each order to the next shorter context. Every fifth labelled URL (by hash) is held out of the counts and fixes the
threshold: the length-normalised log-likelihood difference that splits the held-out classes best.

Cases: null URLs and those without :// have an empty host and path, which are scored like any other (score 0, accepted);
without examples of both classes all scores are 0 and the threshold is 0, so what no rule decides is accepted; repeated
rows are independent; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.util import STEP_BYTES, checkpointed, steps

#: (verdict, host, beginning of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 5
#: Bits of a symbol in a packed n-gram.
SYMBOL = 9
HELD_OUT = 5
#: Bins of the held-out scores' histogram, over [-4, 4] nats a character.
BINS = 8000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s).*?://([^/?#]*)([^?#]*).*$"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, g), F.lit("")) for g in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string), and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer ones override
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of all texts: the last ORDER symbols as one number (byte + 1 in SYMBOL bits each, the last one lowest, 0
    before the text's start), so unlike n-grams are never equal; and the row."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = data.copy()
    for n in range(1, ORDER):
        gram[n:] |= np.where(place[n:] >= n, data[:-n], 0) << (SYMBOL * n)
    return gram, row


def positions(texts: DataFrame) -> DataFrame:
    """id, gram, n0, n1, held: a row for each byte of each of the texts (id, text, n0, n1, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text", STEP_BYTES // 8):
                gram, row = packed([t.encode() for t in batch.column("text").to_pylist()])
                rest = [batch.column(c).take(pa.array(row)) for c in ("id", "n0", "n1", "held")]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array(gram), *rest[1:]], names=["id", "gram", "n0", "n1", "held"])

    return texts.mapInArrow(run, "id long, gram long, n0 long, n1 long, held boolean")


def terms(known: DataFrame, seen: tuple[str, str]) -> DataFrame:
    """gram, term: log P(accepted) - log P(rejected) of the last symbol of each n-gram in `known` (gram, and how often each
    class has it, in the columns `seen`). Exact counts of all orders; each is smoothed by the next shorter context's estimate."""
    shorter = None
    for n in range(ORDER):
        low = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << (SYMBOL * k)) - 1))
        grams = known.groupBy(low("gram", n + 1).alias("g")).agg(F.sum(seen[0]).alias("s0"), F.sum(seen[1]).alias("s1"))
        grams = grams.withColumn("c", F.shiftright("g", SYMBOL))
        before = grams.groupBy("c").agg(F.sum("s0").alias("b0"), F.sum("s1").alias("b1"))
        grams = grams.join(F.broadcast(before) if n < 2 else before, "c")  # at most 257 contexts
        if shorter is None:
            grams = grams.withColumn("q0", F.lit(1 / 256.0)).withColumn("q1", F.lit(1 / 256.0))
        else:
            grams = grams.withColumn("g1", low("g", n)).join(F.broadcast(shorter) if n < 2 else shorter, "g1")
        p = [((F.col(f"s{k}") + 2.0 * F.col(f"q{k}")) / (F.col(f"b{k}") + 2.0)).alias(f"q{k}") for k in (0, 1)]  # weighs like two characters
        shorter = grams.select(F.col("g").alias("g1"), *p)
    return shorter.select(F.col("g1").alias("gram"), (F.log("q1") - F.log("q0")).alias("term"))


def scored(chars: DataFrame, model: DataFrame) -> DataFrame:
    """id, score: the mean of the model's terms over the positions of each text."""
    return checkpointed(chars.select("id", "gram").join(model, "gram").groupBy("id").agg(F.avg("term").alias("score")))


def threshold(histogram: list[tuple[int, int, int]]) -> float:
    """The score that splits the held-out classes with the least balanced error; ties: nearest to 0."""
    counts = np.zeros((2, BINS + 1))
    for label, b, n in histogram:
        counts[label, b] = n
    if not counts.sum(1).all():
        return 0.0
    share = counts / counts.sum(1, keepdims=True)
    wrong = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cuts = best * 8.0 / BINS - 4
    return float(cuts[np.argmin(np.abs(cuts))])


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold."""
    host, path = parsed(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", verdict).withColumn("text", F.concat("host", "path"))
    label = lambda what: F.count_if(F.col("decided") == what)
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    texts = rows.groupBy("text").agg(label("block").alias("n0"), label("allow").alias("n1"))
    texts = checkpointed(texts.select(F.monotonically_increasing_id().alias("id"), "text", "n0", "n1", held.alias("held")))
    chars = checkpointed(positions(texts))
    counted = F.when(~F.col("held"), F.col("n0")).otherwise(0), F.when(~F.col("held"), F.col("n1")).otherwise(0)
    known = checkpointed(chars.groupBy("gram").agg(*(F.sum(c).alias(f"t{k}") for k, c in enumerate(counted))))
    model = checkpointed(terms(known, ("t0", "t1")))
    scores = texts.join(scored(chars, model), "id", "left").select("text", "n0", "n1", "held", F.coalesce("score", F.lit(0.0)).alias("score"))
    b = F.least(F.greatest(F.floor((F.col("score") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS)).cast("int")
    bins = scores.where("held").groupBy(b.alias("b")).agg(F.sum("n0"), F.sum("n1")).collect()
    cut = threshold([(label, r[0], r[1 + label]) for r in bins for label in (0, 1)])
    out = rows.join(scores.select("text", "score"), "text")
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select(key, "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score", F.lit(cut).alias("threshold"))
