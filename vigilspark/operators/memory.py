"""Memory facts: region, class and module ladders, interval joins, byte differences, suspicion ranks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.tables import PIPELINE_CONTRACTS

# Page protection bits.
EXECUTABLE, WRITABLE_EXECUTABLE = 0x10 | 0x20 | 0x40 | 0x80, 0x40 | 0x80
STOMP_FRACTION, STOMP_RUN = 0.05, 256
#: The smallest bucket of addresses, how many of a level make one of the next, and how many levels there are.
BUCKET, SPREAD, LEVELS = 1 << 16, 16, 12


def executable(protect: Column) -> Column:
    return protect.bitwiseAND(EXECUTABLE) != 0


def writable_executable(protect: Column) -> Column:
    return protect.bitwiseAND(WRITABLE_EXECUTABLE) != 0


def protection_name(protect: Column) -> Column:
    return F.when(writable_executable(protect), "RWX").when(executable(protect), "RX").otherwise("non-exec")


def _level(size: str, bucket: int) -> Column:
    """The level whose buckets are at least as large as an interval; buckets of a level are SPREAD times those below."""
    over = F.lit(0)
    for level in range(LEVELS - 1):
        over = over + (F.expr(size) > bucket * SPREAD**level).cast("int")
    return over


def _bucket(address: str, bucket: int, level: Column) -> Column:
    return F.floor(F.expr(f"cast({address} as decimal(20,0))") / F.element_at(F.array(*(F.lit(bucket * SPREAD**k).cast("decimal(20,0)") for k in range(LEVELS))), level + 1)).cast("long")


def _levels_of(sized: DataFrame, level: str) -> Column:
    """The levels in use, LEVELS of them at most, as an array."""
    return F.array(*(F.lit(x) for x in sorted(r[0] for r in sized.select(level).distinct().collect())))


def interval_join(intervals: DataFrame, points: DataFrame, on: list[str], start: str, size: str, point: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs with start <= point < start + size, as an equi-join on buckets of addresses. An interval goes to the one or two
    buckets that it touches at the level of its size, however large it is, a point to one bucket of each level in use; so
    each pair is met once."""
    level, at = unused(intervals, points, names=("level", "bucket"))
    a = intervals.where(F.col(size) > 0).withColumn(level, _level(size, bucket))
    levels = _levels_of(a, level)
    first, last = _bucket(start, bucket, F.col(level)), _bucket(f"{start} + {size} - 1", bucket, F.col(level))
    a = a.withColumn(at, F.explode(F.sequence(first, last)))
    b = points.withColumn(level, F.explode(levels)).withColumn(at, _bucket(point, bucket, F.col(level)))
    return a.join(b, [*on, level, at]).where(f"{point} >= {start} and {point} < {start} + {size}").drop(level, at)


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) that overlap; met at the larger one's level, in the first
    bucket that they share."""
    level, at, own_l, own_r = unused(left, right, names=("level", "bucket", "left", "right"))
    a = left.where("l_end > l_start").withColumn(own_l, _level("l_end - l_start", bucket))
    b = right.where("r_end > r_start").withColumn(own_r, _level("r_end - r_start", bucket))
    levels = _levels_of(a.select(F.col(own_l).alias(level)).unionAll(b.select(F.col(own_r))), level)

    def dealt(rows: DataFrame, own: str, start: str, end: str) -> DataFrame:
        up = rows.withColumn(level, F.explode(F.filter(levels, lambda k: k >= F.col(own))))
        return up.withColumn(at, F.explode(F.sequence(_bucket(start, bucket, F.col(level)), _bucket(f"{end} - 1", bucket, F.col(level)))))

    both = dealt(a, own_l, "l_start", "l_end").join(dealt(b, own_r, "r_start", "r_end"), [*on, level, at])
    both = both.where("l_start < r_end and r_start < l_end").where(F.col(level) == F.greatest(own_l, own_r))
    return both.where(F.col(at) == _bucket("greatest(l_start, r_start)", bucket, F.col(level))).drop(level, at, own_l, own_r)


def unused(*frames: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Column names that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    out = []
    for name in names:
        free = f"_{name}"
        while free in taken:
            free += "_"
        taken.add(free)
        out.append(free)
    return out


def mark_thread_starts(regions: DataFrame, threads: DataFrame) -> DataFrame:
    """regions (pid, base, size) with thread_start: some thread of the process starts inside."""
    hit = interval_join(regions.select("pid", "region_no", "base", "size"), threads, ["pid"], "base", "size", "start_address")
    key = ["pid", "region_no", "base", "size"]  # process images may repeat a region's number
    hit = hit.select(*key).distinct().withColumn("thread_start", F.lit(True))
    return regions.join(hit, key, "left").withColumn("thread_start", F.coalesce("thread_start", F.lit(False)))


def region_ladder(regions: DataFrame) -> DataFrame:
    """regions with tier, score and signals. Managed processes own plain executable heaps unless something escalates them."""
    wx = writable_executable(F.col("protect"))
    jit = F.col("managed") & ~F.col("backed") & ~(wx | F.col("has_pe") | F.col("thread_start"))
    step = F.struct
    out = lambda tier, score, signals: step(F.lit(tier).alias("tier"), (F.lit(score) if isinstance(score, int) else score).alias("score"), signals.alias("signals"))
    ids = lambda *x: F.array(*map(F.lit, x))
    raised = F.array_compact(F.array(F.lit("unbacked-executable-region"), F.when(wx, "rwx"), F.when(F.col("thread_start"), "thread-start"), F.when(F.col("has_pe"), "pe-image")))
    score = F.greatest(F.lit(50), F.when(wx, 80), F.when(F.col("thread_start"), 85), F.when(F.col("has_pe"), 90))
    a = (
        F.when(F.col("backed") & F.col("stomped"), out("likely-malicious", 90, ids("module-stomped")))
        .when(F.col("backed") & F.col("patched"), out("suspicious", 55, ids("inline-patched-code")))
        .when(F.col("backed"), out("clean", 0, ids("image-backed")))
        .when(jit, out("clean", 0, ids("jit-owned")))
        .when(score > 50, out("likely-malicious", score, raised))
        .otherwise(out("suspicious", 50, raised))
    )
    return regions.withColumn("_a", a).select(*regions.columns, "_a.*").withColumn("allowlisted", F.col("tier") == "clean")


def byte_runs(differences: DataFrame, key: list[str]) -> DataFrame:
    """modified bytes and the longest run of neighbours per key, from rows (key, rva) of differing bytes: neighbours share
    rva minus their rank."""
    w = Window.partitionBy(*key).orderBy("rva")
    island = differences.distinct().withColumn("_i", F.col("rva") - F.row_number().over(w))
    runs = island.groupBy(*key, "_i").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(*key).agg(F.sum("run").alias("modified"), F.max("run").alias("max_run"))


def stomp_class(modified: Column, total: Column, max_run: Column) -> Column:
    """stomped, patched or clean."""
    wholesale = (modified / total >= STOMP_FRACTION) | (max_run >= STOMP_RUN)
    return F.when((total <= 0) | (modified <= 0), "clean").when(wholesale, "stomped").otherwise("patched")


#: What a dictionary of contracts must hold, for each runtime.
CONTRACT_LISTS = {"java": ("pipeline_contracts", "type_needles", "string_needles"), "dotnet": ("pipeline_contracts", "capability_apis", "string_needles")}


def load_contracts(text: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """A dictionary of contracts and needles from JSON. ValueError names everything that is wrong with it: lists that are
    missing or empty, and entries that are no text or blank."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"contracts: {e}") from None
    issues, out = [], {}
    for runtime, names in CONTRACT_LISTS.items():
        section = found.get(runtime) if isinstance(found, dict) else None
        for name in names:
            values = section.get(name) if isinstance(section, dict) else None
            if not isinstance(values, list) or not values:
                issues.append(f"{runtime}.{name} is empty")
            elif not all(isinstance(v, str) and v.strip() for v in values):
                issues.append(f"{runtime}.{name} holds an empty entry")
            else:
                out.setdefault(runtime, {})[name] = tuple(values)
    if issues:
        raise ValueError("contracts: " + "; ".join(issues))
    return out


def pipeline_wired(contracts: Column, wanted: tuple[str, ...] = PIPELINE_CONTRACTS) -> Column:
    return F.arrays_overlap(contracts, F.array(*map(F.lit, wanted)))


def jvm_ladder(classes: DataFrame, wanted: tuple[str, ...] = PIPELINE_CONTRACTS) -> DataFrame:
    """Findings of classes (status, contracts, capabilities, out_of_contract, generated, contradiction): the first rung that
    holds; a loader that contradicts the disk adds 5. Other classes are no finding."""
    wired = pipeline_wired(F.col("contracts"), wanted)
    acts = F.exists("capabilities", lambda c: c.isin("exec", "tunnel"))
    n = F.size("capabilities")
    status, outside = F.col("status"), F.col("out_of_contract")
    rung = lambda tier, score, ref: F.struct(F.lit(tier).alias("tier"), F.lit(score).alias("score"), F.lit(f"kb:java-mem/{ref}").alias("ref"))
    a = (
        F.when((status == "spoofed") & wired, rung("likely-malicious", 95, "codesource-spoofed"))
        .when((status == "spoofed") & acts, rung("likely-malicious", 90, "codesource-spoofed"))
        .when(status == "spoofed", rung("suspicious", 60, "codesource-spoofed"))
        .when((status == "disk-absent") & wired, rung("likely-malicious", 95, "fileless-pipeline-class"))
        .when((status == "disk-absent") & (acts | (n >= 2)), rung("likely-malicious", 80, "fileless-capable-class"))
        .when((status == "disk-absent") & (n == 1), rung("suspicious", 55, "fileless-class"))
        .when(status == "disk-absent", rung("suspicious", 50, "fileless-class"))
        .when((status == "unverifiable") & wired, rung("suspicious", 50, "unverifiable-origin"))
        .when(outside & wired & ~F.col("generated"), rung("likely-malicious", 90, "codesource-out-of-contract"))
        .when(outside & acts, rung("likely-malicious", 80, "codesource-out-of-contract"))
        .when(outside & ~F.col("generated"), rung("suspicious", 55, "codesource-out-of-contract"))
    )
    out = classes.withColumn("_a", a).where("_a is not null")
    twisted = F.col("contradiction")
    return out.select(*classes.columns, F.col("_a.tier").alias("tier"), (F.col("_a.score") + F.when(twisted, 5).otherwise(0)).alias("score"), F.when(twisted, "kb:java-mem/loader-contradiction").otherwise(F.col("_a.ref")).alias("knowledge_ref"))


def verify_claims(claims: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """claims (class_name, code_source, nested) against archives' entries (archive, entry) and files (path, readable):
    corroborated, spoofed, disk-absent or unverifiable. An entry may stand under the agents' own layout."""
    entry = F.concat(F.translate("class_name", ".", "/"), F.lit(".class"))
    moved = F.concat(F.lit("inst/"), F.translate("class_name", ".", "/"), F.lit(".classdata"))
    c = claims.withColumn("_want", F.explode(F.array(entry, moved)))
    held = c.join(entries.select(F.col("archive").alias("code_source"), F.col("entry").alias("_want")), ["code_source", "_want"], "left_semi").select("class_name", "code_source").distinct().withColumn("_in", F.lit(True))
    there = files.select(F.col("path").alias("code_source"), "readable")
    j = claims.join(there, "code_source", "left").join(held, ["class_name", "code_source"], "left")
    status = (
        F.when(F.col("nested"), "unverifiable")
        .when(F.coalesce("code_source", F.lit("")) == "", "disk-absent")
        .when(F.col("readable").isNull(), "spoofed")
        .when(~F.col("readable"), "unverifiable")
        .when(F.coalesce("_in", F.lit(False)), "corroborated")
        .otherwise("spoofed")
    )
    out = j.select(*claims.columns, status.alias("status"))
    if "loader_read_ok" in claims.columns:  # the JVM read bytes that the disk doesn't back
        out = out.withColumn("contradiction", (F.col("status") == "spoofed") & F.coalesce("loader_read_ok", F.lit(False)))
    return out


def module_ladder(modules: DataFrame) -> DataFrame:
    """Path-less managed modules (verified, generated, spoofed, convention, contracts, capabilities) by tier and score."""
    wired = (F.size("contracts") > 0) | (F.col("convention") & ~F.col("verified") & ~F.col("generated"))
    n = F.size("capabilities")
    rung = lambda tier, score: F.struct(F.lit(tier).alias("tier"), F.lit(score).alias("score"))
    a = (
        F.when(F.col("verified") & ~wired, rung("clean", 0))
        .when(F.col("generated") & ~wired & (n == 0), rung("clean", 0))
        .when(wired & (n > 0), rung("likely-malicious", 95))
        .when(wired, rung("likely-malicious", 85))
        .when(n >= 2, rung("likely-malicious", 80))
        .when(n == 1, rung("suspicious", 55))
        .otherwise(rung("suspicious", 50))
    )
    signal = F.when(F.col("spoofed") & (a["tier"] != "clean"), "spoofed-strong-name")
    return modules.select(*modules.columns, a["tier"].alias("tier"), a["score"].alias("score"), signal.alias("signal"))


def suspicion(classes: DataFrame) -> DataFrame:
    """classes with candidate and suspicion; watched classes come first, platform classes never."""
    wired, absent = pipeline_wired(F.col("contracts")), F.col("disk_absent")
    plus = lambda c, n: F.when(c, n).otherwise(0)
    hooks = F.exists("methods", lambda m: m.isin("doFilter", "service", "invoke", "preHandle", "onMessage", "transform"))
    s = plus(wired, 40) + plus(absent, 30) + plus(F.col("out_of_contract"), 30) + plus(wired & absent, 15) + plus(F.size("capabilities") > 0, 15) + plus(hooks, 10) - plus(F.col("generated"), 55) + plus(F.col("bootstrap"), 10)
    score = F.when(F.col("platform"), 0).when(F.col("watched"), 100).otherwise(F.greatest(s, F.lit(0)))
    candidate = ~F.col("platform") & (F.col("watched") | ((absent | F.col("out_of_contract")) & ~F.col("generated")) | wired)
    return classes.withColumn("candidate", candidate).withColumn("suspicion", score)


def capture(classes: DataFrame, most: int = 128) -> DataFrame:
    """The `most` candidates of each process by suspicion, then name."""
    w = Window.partitionBy("pid").orderBy(F.desc("suspicion"), "class_name")
    return suspicion(classes).where("candidate").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def merge_modules(scanned: DataFrame, reached: DataFrame) -> DataFrame:
    """Modules from the scan, flagged where dispatch reaches them, and reached ones that the scan missed."""
    hit = reached.select("image_base").distinct().withColumn("reached", F.lit(True))
    both = scanned.join(hit, "image_base", "left").withColumn("reached", F.coalesce("reached", F.lit(False))).withColumn("scanned", F.lit(True))
    return both.unionByName(reached.join(scanned, "image_base", "left_anti").withColumn("reached", F.lit(True)).withColumn("scanned", F.lit(False)), allowMissingColumns=True)


def wired_components(components: DataFrame, modules: DataFrame) -> DataFrame:
    """Components on the request path (component, module_base, field_hits) with their backing module (image_base, benign,
    capabilities): none found 55, benign suppressed, else 85, and 95 where fields or module show a capability."""
    j = components.join(modules.select(F.col("image_base").alias("module_base"), "benign", F.size("capabilities").alias("_n")), "module_base", "left")
    score = F.when(F.col("benign").isNull(), 55).when(F.col("benign"), 0).when((F.col("_n") > 0) | (F.col("field_hits") > 0), 95).otherwise(85)
    tier = F.when(score == 0, "clean").when(score == 55, "suspicious").otherwise("likely-malicious")
    return j.select(*components.columns, score.alias("score"), tier.alias("tier"), (score == 0).alias("suppressed"))


def probe_status(targets: DataFrame) -> DataFrame:
    """host, view, status, truncated from targets (ok, early): all failed is failed, some degraded, none n/a."""
    g = targets.groupBy("host", "view").agg(F.count_if("present").alias("n"), F.count_if(F.col("present") & ~F.col("ok")).alias("bad"), F.bool_or(F.col("present") & F.col("early")).alias("truncated"))
    status = F.when(F.col("n") == 0, "n/a").when(F.col("bad") == F.col("n"), "failed").when(F.col("bad") > 0, "degraded").otherwise("ran")
    return g.select("host", "view", status.alias("status"), "truncated", "n", "bad")
