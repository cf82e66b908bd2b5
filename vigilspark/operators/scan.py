"""The scan as one plan: which views run, files and their decoded layers under the same rules, technique cells, builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import layers, rules
from vigilspark.operators.rules import RuleSet


def select_views(requested: DataFrame, capabilities: DataFrame, packaged: DataFrame) -> DataFrame:
    """host, view, status for requested views (host, os, view): capabilities (view, os) say where a view can exist, packaged
    (view) what is there to run it. What can't exist is n/a, what should run and can't is failed."""
    can = capabilities.select("view", "os").distinct().withColumn("_can", F.lit(True))
    have = packaged.select("view").distinct().withColumn("_have", F.lit(True))
    j = requested.join(can, ["view", "os"], "left").join(have, "view", "left")
    return j.select("host", "view", F.when(F.col("_can").isNull(), "n/a").when(F.col("_have").isNull(), "failed").otherwise("run").alias("status"))


def configure(command_line: dict, file: dict, default: dict) -> dict:
    """Settings by precedence: command line, then the configuration file, then defaults; unknown names are refused."""
    unknown = (command_line.keys() | file.keys()) - default.keys()
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {k: next(s[k] for s in (command_line, file, default) if s.get(k) is not None) if any(s.get(k) is not None for s in (command_line, file, default)) else None for k in default}


def load_settings(text: str, choices: dict[str, tuple]) -> dict:
    """A configuration file, strictly: an object without repeated or unknown names and with allowed values only. A name that
    is absent isn't in the result; one that is null is there with None."""
    import json

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a name stands twice")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=once)
    if not isinstance(found, dict):
        raise ValueError("settings are an object")
    for name, value in found.items():
        if name not in choices:
            raise ValueError(f"unknown setting: {name}")
        if value is not None and choices[name] and value not in choices[name]:
            raise ValueError(f"{name}: {value!r} is none of {choices[name]}")
    return found


def rescan(files: DataFrame, found: RuleSet) -> DataFrame:
    """Rule matches of files (path, content) and of their decoded layers, which are judged by their origin's name. Layers are
    rows like files, so one pass over the rules serves both; no layer is ever a file."""
    raw = files.select("path", F.col("content").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("method"), F.lit(-1).alias("ordinal"))
    decoded = layers.decoded_layers(files.select("path", "content")).select("path", F.col("data").alias("bytes"), "method", "ordinal")
    out = rules.matches(raw.unionByName(decoded).withColumn("text", F.decode("bytes", "ISO-8859-1")), found, ("method", "ordinal"))
    # a file's own hit says it all; of several layers the first
    first = out.groupBy("path", "rule").agg(F.min(F.struct("ordinal", "method")).alias("m"))
    return first.select("path", "rule", (F.col("m.ordinal") >= 0).alias("decoded"), F.col("m.method").alias("method"))


def cells(found: DataFrame, bridge: DataFrame) -> DataFrame:
    """cell, detections from findings' rules and a bridge (rule, cells: names joined by commas)."""
    pairs = bridge.select("rule", F.explode(F.filter(F.transform(F.split("cells", ","), lambda c: F.trim(c)), lambda c: c != "")).alias("cell")).distinct()
    return found.join(pairs, "rule").groupBy("cell").agg(F.count(F.lit(1)).alias("detections"))


def build_files(always: DataFrame, components: DataFrame, views: list[str]) -> tuple[DataFrame, bool]:
    """(files, needs rules) of a build with these views. components: view, kind (binary or data), file, rules. A view that
    takes compiled rules doesn't ship its rule data."""
    if not views:
        raise ValueError("a build needs a view")
    chosen = components.where(F.col("view").isin(*views))
    missing = set(views) - {r["view"] for r in chosen.select("view").distinct().collect()}
    if missing:
        raise ValueError(f"no such view here: {sorted(missing)}")
    files = chosen.where("kind = 'binary' or not rules").select("file").union(always.select("file")).distinct()
    bad = files.where("file = '' or file like '/%' or contains(file, '\\\\') or contains(file, ':') or array_contains(split(file, '/'), '..')")
    if not bad.isEmpty():
        raise ValueError("a file's path leaves the release")
    return files.orderBy("file"), not chosen.where("rules").isEmpty()
