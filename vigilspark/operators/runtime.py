"""Managed-runtime facts: class ladder, declared repositories, wired elements, constant needles, handler chains, late loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.checkpoints import checkpointed

# Words in constant pools that give a tool or a capability away, in the order in which the first counts.
FAMILY_MARKERS = (("e45e329feb5d925b", "behinder", 0.9), ("3c6e0b8a9c15224a", "godzilla", 0.9), ("X-Accel-Buffering", "suo5", 0.85))
CAPABILITY_NEEDLES = (
    ("exec", ("java/lang/Runtime", "java/lang/ProcessBuilder", "cmd.exe", "/bin/sh", "/bin/bash")), ("tunnel", ("X-Accel-Buffering",)), ("crypto", ("javax/crypto/Cipher", "javax/crypto/spec/SecretKeySpec")),
    ("loader", ("java/lang/ClassLoader",)), ("reflect", ("java/lang/reflect/Method",)), ("script", ("javax/script/ScriptEngine",)), ("jndi", ("javax/naming/InitialContext",)),
)
ACTION_CAPABILITIES = ("exec", "tunnel")


def class_ladder(classes: DataFrame) -> DataFrame:
    """Classes (wired, trusted, generated, out_of_contract, anomaly, mismatch, capabilities) by tier and score: the first rung
    that holds. A mismatch of bytes alone is no evidence."""
    c, n = F.col, F.size("capabilities")
    acts = F.exists("capabilities", lambda x: x.isin(*ACTION_CAPABILITIES))
    rung = lambda tier, score: F.struct(F.lit(tier).alias("tier"), (F.lit(score) if isinstance(score, int) else score).alias("score"))
    a = (
        F.when(c("out_of_contract") & c("wired") & ~c("generated"), rung("likely-malicious", 90))
        .when(c("out_of_contract") & acts, rung("likely-malicious", 80))
        .when(c("out_of_contract") & ~c("generated"), rung("suspicious", 55))
        .when(c("trusted") & ~c("wired") & ~c("anomaly"), rung("clean", 0))
        .when(c("generated") & ~c("wired") & ~c("anomaly") & (n == 0), rung("clean", 0))
        .when(c("anomaly") & (n > 0) & (~c("mismatch") | acts), rung("likely-malicious", F.when(c("wired"), 92).otherwise(80)))
        .when(c("anomaly") & (n > 0), rung("suspicious", 65))
        .when(c("anomaly") & c("wired") & ~c("mismatch"), rung("likely-malicious", 92))
        .when(c("anomaly") & c("wired"), rung("suspicious", 60))
        .when(c("anomaly"), rung("suspicious", 65))
        .when(c("wired"), rung("likely-malicious", F.when(n > 0, 95).otherwise(85)))
        .when(n >= 2, rung("likely-malicious", 80))
        .when(n == 1, rung("suspicious", 55))
        .otherwise(rung("suspicious", 50))
    )
    return classes.select(*classes.columns, a["tier"].alias("tier"), a["score"].alias("score"))


def out_of_contract(classes: DataFrame, repositories: DataFrame) -> DataFrame:
    """classes (pid, class_name, code_source) with out_of_contract: the source lies in none of the process's repositories
    (pid, prefix, application). A process of which no application repository is known proves nothing.

    A source meets the repositories by equality on its own ancestors."""
    known = repositories.groupBy("pid").agg(F.bool_or("application").alias("_known"))
    parts = F.split("code_source", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    places = repositories.select("pid", F.when(F.col("prefix") == "/", "/").otherwise(F.regexp_replace("prefix", "/+$", "")).alias("_up")).distinct()
    sources = classes.where("code_source <> ''").select("pid", "code_source").distinct()
    covered = sources.withColumn("_up", F.explode(up)).join(places, ["pid", "_up"], "left_semi").select("pid", "code_source").distinct().withColumn("_in", F.lit(True))
    j = classes.join(known, "pid", "left").join(covered, ["pid", "code_source"], "left")
    out = (F.coalesce("code_source", F.lit("")) != "") & F.coalesce("_known", F.lit(False)) & F.col("_in").isNull()
    return j.select(*classes.columns, out.alias("out_of_contract"))


def wired_elements(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """class_name, wired, found: elements of the dispatch inventory that nothing vouches for (trusted, generated, has_source),
    merged with class findings."""
    left = elements.where("not trusted and not generated and not has_source").select("class_name").distinct().withColumn("wired", F.lit(True))
    right = findings.select("class_name").distinct().withColumn("found", F.lit(True))
    return left.join(right, "class_name", "full_outer").select("class_name", F.coalesce("wired", F.lit(False)).alias("wired"), F.coalesce("found", F.lit(False)).alias("found"))


def family_of(strings: Column) -> Column:
    """The first marker that is one of the string constants: struct of family and confidence, null without one."""
    return F.coalesce(*(F.when(F.array_contains(strings, needle), F.struct(F.lit(family).alias("family"), F.lit(sure).alias("confidence"))) for needle, family, sure in FAMILY_MARKERS))


def capabilities_of(strings: Column) -> Column:
    """Sorted capabilities of which any needle occurs."""
    hit = lambda needles: F.exists(strings, lambda s: s.rlike("|".join(n.replace(".", "[.]") for n in needles)))
    return F.array_sort(F.array_compact(F.array(*(F.when(hit(n), F.lit(c)) for c, n in CAPABILITY_NEEDLES))))


def constant_facts(pools: DataFrame) -> DataFrame:
    """pools (class_name, strings) with family, confidence and capabilities."""
    rows = pools.withColumn("_f", family_of(F.col("strings")))
    return rows.select(*pools.columns, "_f.family", "_f.confidence", capabilities_of(F.col("strings")).alias("capabilities"))


def chain_positions(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """chain, address, position along linked lists (chain, address, next): by doubling the step each round, so a list of n
    elements takes log n rounds. An address that several chains reach belongs to the first; cycles and gaps end a chain."""
    linked = nodes.where("next is not null").select("chain", "address", "next")
    linked = linked.join(nodes.select("chain", F.col("address").alias("next")), ["chain", "next"], "left_semi")
    heads = nodes.join(linked.select("chain", F.col("next").alias("address")).distinct(), ["chain", "address"], "left_anti")
    at = checkpointed(heads.select("chain", "address", F.lit(0).cast("long").alias("position")))
    step = checkpointed(linked.select("chain", "address", "next"))
    for k in range(rounds):
        further = at.join(step, ["chain", "address"]).select("chain", F.col("next").alias("address"), (F.col("position") + (1 << k)).alias("position"))
        if further.isEmpty():
            break
        at = checkpointed(at.union(further).groupBy("chain", "address").agg(F.min("position").alias("position")))
        step = checkpointed(step.alias("a").join(step.alias("b"), (F.col("a.chain") == F.col("b.chain")) & (F.col("a.next") == F.col("b.address"))).select("a.chain", "a.address", "b.next"))
    w = Window.partitionBy("address").orderBy("chain")
    return at.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("chain", "address", "position")


def late_loads(loads: DataFrame, assemblies: DataFrame, carved: DataFrame) -> DataFrame:
    """Names of modules loaded without a path (pid, assembly_id, il_path) that no carving found yet (pid, name)."""
    named = loads.where(F.coalesce("il_path", F.lit("")) == "").join(assemblies, ["pid", "assembly_id"], "left")
    return named.select("pid", F.coalesce("name", F.lit("(unnamed)")).alias("name")).distinct().join(carved.select("pid", "name"), ["pid", "name"], "left_anti")


def changed_sections(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Sections (module, section, digest) whose bytes in memory aren't those on disk."""
    return memory.alias("m").join(disk.select("module", "section", F.col("digest").alias("_disk")), ["module", "section"]).where("digest <> _disk").select("module", "section")


def best_per_sink(candidates: DataFrame) -> DataFrame:
    """One candidate per artifact and sink: the highest score, then provenance, class and method in order; candidates that a
    verifier refuses don't count."""
    w = Window.partitionBy("artifact", "sink").orderBy(F.desc("score"), "provenance", "class", "method")
    return candidates.where("valid").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def loose_group(path: Column) -> Column:
    """The application a loose class belongs to: what stands before its last WEB-INF/classes, else the file itself."""
    before = F.regexp_extract(path, r"^(.*/)?WEB-INF/classes/", 0)
    return F.when(before != "", F.regexp_replace(before, "WEB-INF/classes/$", "")).otherwise(path)


def retained(classes: DataFrame, most: int) -> DataFrame:
    """Classes (path, size) with kept: in order of paths, while an application's total stays within `most` bytes."""
    w = Window.partitionBy("application").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return classes.withColumn("application", loose_group(F.col("path"))).withColumn("kept", F.sum("size").over(w) <= most)
