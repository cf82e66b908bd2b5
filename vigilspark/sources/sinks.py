"""Writers: run folders, event streams, content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import outputs


def write_events(scored: DataFrame, verdicts: DataFrame, path: str) -> None:
    """NDJSON detection findings, by host."""
    e = outputs.ocsf_json(outputs.ocsf(scored, verdicts)).join(scored.select("fingerprint", "host"), "fingerprint")
    e.select("host", F.col("event").alias("value")).write.partitionBy("host").mode("append").text(path)


def write_report_tables(scored: DataFrame, coverage: DataFrame, verdicts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The three relations of a run as Parquet by host, so a host's triage reads its own folders only."""
    for name, rows in (("findings", scored), ("coverage", coverage), ("verdicts", verdicts)):
        rows.write.partitionBy("host").mode(mode).parquet(f"{path}/{name}")


def write_run(scored: DataFrame, coverage: DataFrame, verdicts: DataFrame, path: str) -> DataFrame:
    """A run's folders by host: report (JSON), summary (text), findings (NDJSON) and a manifest with the SHA-256 of every file
    that was written, which is returned as well."""
    spark = scored.sparkSession
    verdicts.write.partitionBy("host").json(f"{path}/report")
    lines = outputs.summary(scored).join(scored.select("fingerprint", "host"), "fingerprint").select("host", F.col("line").alias("value"))
    cover = outputs.coverage_lines(coverage).select("host", F.col("line").alias("value"))
    lines.unionByName(cover).write.partitionBy("host").text(f"{path}/summary")
    write_events(scored, verdicts, f"{path}/findings")
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{kind}") for kind in ("report", "summary", "findings")]
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    outputs.manifest(files.select(F.regexp_extract("path", r"(?:report|summary|findings)/.*$", 0).alias("name"), "content")).write.json(f"{path}/manifest")
    return spark.read.schema("name string, sha256 string").json(f"{path}/manifest")


def put_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """Adds contents (content) that aren't there yet under their SHA-256, sharded by its first two digits; returns the new
    ones' digests."""
    spark = blobs.sparkSession
    rows = blobs.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    try:
        have = spark.read.schema("sha256 string, content binary, shard string").parquet(path).select("sha256")
        rows = rows.join(have, "sha256", "left_anti")
    except Exception as e:  # nothing was ever put there
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.cache()
    rows.write.partitionBy("shard").mode("append").parquet(path)
    return rows.select("sha256")


def get_blobs(spark, path: str, digests: list[str]) -> DataFrame:
    """Contents by digest; the shard prunes folders, and a content that isn't its digest's is left out."""
    rows = spark.read.schema("sha256 string, content binary, shard string").parquet(path)
    wanted = rows.where(F.col("shard").isin(*sorted({d[:2] for d in digests})) & F.col("sha256").isin(*digests))
    return wanted.where(F.sha2("content", 256) == F.col("sha256")).select("sha256", "content")


def append_audit(entries: DataFrame, path: str) -> None:
    entries.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
