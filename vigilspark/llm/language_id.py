"""Language identification by fusing evidence: text, declared markup language, address suffix, host.

Text: log-likelihoods of hashed byte trigrams for each language, counted on a bounded sample of labelled rows and smoothed
towards all of them, and for "und", a text in no language (all trigrams alike). Likelihoods are over the whole text and
then tempered to the weight of at most TEXT_WEIGHT trigrams, as neighbouring trigrams are no independent evidence.
Declared language and address suffix: how often each value stands beside each language that the text alone suggests,
over all rows. Host: priors by grouped aggregation over all rows, smoothed from the host to its domain to everything.
The posterior is the normalised product.

A row is accepted if its language is a wanted one with a posterior of at least `least`; "und" never is.

Cases: null and empty texts and those without letters have no text evidence, suggest "und" and are never accepted;
null or empty declared languages, suffixes and hosts give no evidence (the host's prior is then the global one); repeated
rows are independent; other columns are dropped; an empty table gives an empty result; without labelled rows all
languages are alike and nothing is accepted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.identity import marked
from vigilspark.llm.util import checkpointed, steps, text_bytes, unused

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled rows that the text model is fitted on, at most (about; chosen by hash).
TRAIN_ROWS = 8_000
SLOTS = 1 << 17
TEXT_WEIGHT = 150
#: Share of trigrams that any language may have from nowhere.
UNSEEN = 0.02
HOST_PRIOR, DECLARED_PRIOR = 50.0, 50.0
LEAST = 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_WORD = _LETTER.copy()
_WORD[[9, 10, 11, 12, 13, 32]] = True


def trigram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of letters and spaces around a letter, and each row's offsets into them; none spans two
    rows. Digits and signs say nothing about a language, so numbers, addresses and keys in a text don't count."""
    n = len(data) - 2
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    kept = word[:-2] & _LETTER[data[1:-1]] & word[2:]
    for k in (1, 2):  # starts too near a row's end
        cut = offsets[1:-1] - k
        kept[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(kept)
    b = _FOLD[data]
    code = ((b[at] << np.uint32(16)) | (b[at + 1] << np.uint32(8)) | b[at + 2]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - (SLOTS.bit_length() - 1))).astype(np.int64), np.searchsorted(at, offsets)


def fit_text(labelled: DataFrame, languages=LANGUAGES, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log-probabilities [slot, language and und] from about `rows` of the labelled rows (lang, text, row_id)."""
    usable = labelled.where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    every = max(1, math.ceil(usable.count() / rows))
    sample = usable.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0)
    names = list(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                slots, ends = trigram_slots(*text_bytes(batch.column("text")))
                label = np.array([names.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                code, n = np.unique(np.repeat(label, np.diff(ends)) * SLOTS + slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(names) * SLOTS)
    table[counts.column("code").to_numpy()] = counts.column("n").to_numpy()
    table = table.reshape(len(names), SLOTS)
    pooled = (table.sum(0) + 0.01) / (table.sum() + 0.01 * SLOTS)
    weight = 200.0
    known = (table + weight * pooled) / (table.sum(1, keepdims=True) + weight)
    known = (1 - UNSEEN) * known + UNSEEN / SLOTS  # a few odd words make no text foreign
    return np.log(np.vstack([known, np.full(SLOTS, 1.0 / SLOTS)])).T.astype(np.float32)


def text_evidence(rows: DataFrame, logs: np.ndarray) -> DataFrame:
    """The columns of rows besides the text, and evidence: tempered log-likelihoods (null without any trigram)."""
    model = rows.sparkSession.sparkContext.broadcast(logs)  # SLOTS x languages numbers, whatever the table
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{n} {t}" for n, t in rows.select(kept).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for whole in batches:
            for batch in steps(whole, "text"):
                slots, ends = trigram_slots(*text_bytes(batch.column("text")))
                total = np.zeros((batch.num_rows, logs.shape[1]))
                sizes = np.diff(ends)
                some = np.flatnonzero(sizes)
                if len(some):
                    total[some] = np.add.reduceat(logs[slots], ends[:-1][some], axis=0, dtype=np.float64)
                total *= np.minimum(1.0, TEXT_WEIGHT / np.maximum(sizes, 1))[:, None]
                values = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), logs.shape[1]).cast(pa.list_(pa.float64()))
                nothing = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
                evidence = pa.compute.if_else(pa.array(sizes > 0), values, nothing)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), evidence], names=[*kept, "evidence"])

    return rows.select(*kept, "text").mapInArrow(run, f"{schema}, evidence array<double>")


def _tally(rows: DataFrame, by: list[str], classes: list[str], name: str) -> DataFrame:
    """One row per value of `by` with the number of rows that suggest each class, as an array."""
    counts = [F.sum((F.col("suggested") == c).cast("double")) for c in classes]
    return rows.groupBy(*by).agg(F.array(*counts).alias(name))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def fuse(rows: DataFrame, languages=LANGUAGES, least: float = LEAST) -> DataFrame:
    """rows: evidence, declared, suffix, host, domain. Adds lang, confidence, text_lang, accepted."""
    classes = [*languages, "und"]
    n = len(classes)
    names = F.array(*map(F.lit, classes))
    best = F.array_position("evidence", F.array_max("evidence")).cast("int") - 1
    rows = checkpointed(rows.withColumn("suggested", F.coalesce(F.get(names, best), F.lit("und"))))
    overall = rows.agg(*(F.sum((F.col("suggested") == c).cast("double")) for c in classes)).first()
    seen = [x or 0.0 for x in overall]
    everything = F.array(*(F.lit((x + 1.0) / (sum(seen) + n)) for x in seen))
    out = rows
    # hosts smoothed by their domains, domains by everything
    smoothed = lambda own, above: F.zip_with(own, above, lambda x, p: (x + HOST_PRIOR * p) / (_sum(own) + HOST_PRIOR))
    known = rows.where("host is not null and host <> ''")
    domains = _tally(known, ["domain"], classes, "c").select(F.col("domain").alias("_d"), smoothed(F.col("c"), everything).alias("above"))
    hosts = _tally(known, ["host", "domain"], classes, "c").join(domains, F.col("domain").eqNullSafe(F.col("_d")))
    hosts = hosts.select(F.col("host").alias("_h"), F.col("domain").alias("_hd"), smoothed(F.col("c"), F.col("above")).alias("prior"))
    out = out.join(hosts, F.col("host").eqNullSafe(F.col("_h")) & F.col("domain").eqNullSafe(F.col("_hd")), "left").drop("_h", "_hd")
    parts = [F.transform(F.coalesce("prior", everything), lambda p: F.log(p))]
    for column in ("declared", "suffix"):
        # P(value | class), smoothed to the value's share of all rows
        tally = _tally(rows.where(f"{column} is not null and {column} <> ''"), [column], classes, "c")
        share = _sum(F.col("c")) / max(sum(seen), 1.0)
        given = F.zip_with("c", F.array(*map(F.lit, seen)), lambda x, m: F.log((x + DECLARED_PRIOR * share) / (m + DECLARED_PRIOR)))
        out = out.join(tally.select(F.col(column).alias(f"_{column}"), given.alias(f"_{column}_given")), F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
        parts.append(F.coalesce(f"_{column}_given", F.array_repeat(F.lit(0.0), n)))
    total = F.col("evidence")
    for part in parts:
        total = F.zip_with(total, part, lambda x, y: x + y)
    out = out.withColumn("_t", total)
    out = out.withColumn("_e", F.transform("_t", lambda x: F.exp(x - F.array_max("_t"))))
    at = F.array_position("_e", F.array_max("_e")).cast("int") - 1
    out = out.withColumn("lang", F.coalesce(F.get(names, at), F.lit("und"))).withColumn("confidence", F.coalesce(F.array_max("_e") / _sum(F.col("_e")), F.lit(0.0)))
    wanted = F.col("lang").isin(*languages) & (F.col("confidence") >= least)
    return out.withColumn("text_lang", F.col("suggested")).withColumn("accepted", wanted).drop("_t", "_e", "prior", "suggested", "evidence", "_declared_given", "_suffix_given")


def document_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Documents as rows of evidence: the lang column is what is declared, the source stands for the host. row: a column
    that comes along."""
    return docs.select(F.col("doc_id"), *([F.col(row).alias("row")] if row else []), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: markup language, the host's last label, host, and the host's last two labels."""
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1))
    return pages.select("page_id", visible.alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"))


def labelled_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.lower("lang").alias("lang"), "text", F.col("doc_id").alias("row_id"))


def identify(docs: DataFrame, pages: DataFrame | None = None, languages=LANGUAGES, least: float = LEAST) -> DataFrame:
    """lang, confidence, text_lang, declared, accepted for all documents (doc_id) and pages (page_id)."""
    logs = fit_text(labelled_documents(docs), languages)
    rows = document_rows(docs).withColumn("page_id", F.lit(None).cast("long"))
    if pages is not None:
        rows = rows.unionByName(page_rows(pages).withColumn("doc_id", F.lit(None).cast("long")))
    out = fuse(text_evidence(rows, logs), languages, least)
    return out.select("doc_id", "page_id", "lang", "confidence", "text_lang", "declared", "accepted")


def accepted_documents(docs: DataFrame, languages=LANGUAGES, least: float = LEAST) -> DataFrame:
    """The documents whose language is accepted, with their columns. Each row is judged by itself, also where ids repeat."""
    identity = F.md5(F.concat_ws(":", marked("doc_id"), F.md5(F.coalesce("text", F.lit(""))), F.length(marked("lang")).cast("string"), marked("lang"), marked("source")))
    (own,) = unused(docs, "identity")
    keyed = docs.withColumn(own, identity)
    rows = document_rows(keyed, own)
    out = fuse(text_evidence(rows, fit_text(labelled_documents(docs), languages)), languages, least)
    good = checkpointed(out.where("accepted").select(F.col("row").alias(own)).distinct())
    return keyed.join(good, own, "left_semi").select(*docs.columns)
