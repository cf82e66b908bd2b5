"""Readers with explicit schemas. What can't be parsed goes to a quarantine, not away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.functions.classify import READ_LIMIT

MATCH_LINE_LIMIT = 16 << 20
QUARANTINED_CHARS = 4096


def files(spark: SparkSession, *roots: str, glob: str | None = None, limit: int = READ_LIMIT) -> DataFrame:
    """path, length, modified, content of all files below roots; those over the limit have null content, and their bytes are
    never read. Overlapping roots list a file once for each."""
    out = None
    for root in roots:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        reader = reader.option("pathGlobFilter", glob) if glob else reader
        all_ = reader.load(root)
        small = all_.where(F.col("length") <= limit).select("path", "length", F.col("modificationTime").alias("modified"), "content")
        large = all_.where(F.col("length") > limit).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(None).cast("binary").alias("content"))
        rows = small.unionByName(large)
        out = rows if out is None else out.unionByName(rows)
    return out


def listing_gaps(listing: DataFrame) -> DataFrame:
    """path, gap of entries (path, kind, readable, inside) that can't be read: regular files, and directories and links inside
    a root, are covered; anything else is a gap with its reason."""
    kind = F.col("kind")
    gap = (
        F.when(~F.col("readable"), "unreadable")
        .when((kind == "file") | (kind == "directory"), F.lit(None).cast("string"))
        .when((kind == "link") & F.col("inside"), F.lit(None).cast("string"))
        .when(kind == "link", "outside-root")
        .when(kind == "dangling", "dangling")
        .otherwise("not-regular")
    )
    return listing.select("path", gap.alias("gap"))


def skip_counts(gaps: DataFrame) -> DataFrame:
    return gaps.where("gap is not null").groupBy("gap").agg(F.count_distinct("path").alias("paths"))


def engine_matches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(matches: path, rule, namespace, meta map, string ids; quarantine: lines that don't parse, and the beginning of those
    over the limit). Meta comes as pairs or as an
    object, with scalars of any kind as text."""
    every = spark.read.text(path).where(F.trim("value") != "")
    lines = every.where(F.octet_length("value") <= MATCH_LINE_LIMIT)
    rows = lines.select("value", F.from_json("value", schemas.ENGINE_MATCH, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("m"))
    bad = rows.where("m._corrupt is not null or m.path is null").select(F.col("value").alias("line"))
    bad = bad.unionByName(every.where(F.octet_length("value") > MATCH_LINE_LIMIT).select(F.substring("value", 1, QUARANTINED_CHARS).alias("line")))
    good = rows.where("m._corrupt is null and m.path is not null").select(F.col("m.path").alias("path"), F.explode("m.rules").alias("r"))
    return good.select("path", F.col("r.identifier").alias("rule"), F.col("r.namespace").alias("namespace"), meta_map(F.col("r.meta")).alias("meta"), F.transform("r.strings", lambda s: s["identifier"]).alias("strings"), F.col("r.strings").alias("hits")), bad


def meta_map(text: Column) -> Column:
    """map<string,string> of an object, or of a list of pairs; the last of repeated keys."""
    as_object = F.from_json(text, "map<string,string>")
    pairs = F.from_json(text, "array<array<string>>")
    entries = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.trim(text).startswith("["), F.map_from_entries(last)).otherwise(as_object)


def scrub_xml(text: Column) -> Column:
    """Invalid UTF-8's replacement characters and control characters out, as XML refuses them."""
    return F.regexp_replace(text, "[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")


def events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) from event-log XML, one Event element after another with or without a root. Files are split at the
    elements' ends, so a large export is read by many tasks."""
    pieces = spark.read.text(path, lineSep="</Event>").select(F.regexp_extract("value", r"(?s)<Event(?:\s[^>]*)?>.*$", 0).alias("value"))
    texts = pieces.where("value <> ''").select(F.concat("value", F.lit("</Event>")).alias("value"))
    return _parsed(texts, "value")


def events_from_text(texts: DataFrame, column: str = "value") -> DataFrame:
    """Events from rows that hold one Event element each."""
    return _parsed(texts, column)[0]


def _parsed(texts: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    rows = texts.select(F.col(column).alias("line"), F.from_xml(scrub_xml(F.col(column)), schemas.EVENT_XML).alias("e"))
    fine = F.coalesce(F.col("e.System.EventID").isNotNull(), F.lit(False))
    return event_rows(rows.where(fine).select("e.*")), rows.where(~fine).select("line")


def event_rows(parsed: DataFrame) -> DataFrame:
    data = F.coalesce("EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
    named = F.filter(data, lambda d: d["_Name"].isNotNull())
    keys = F.transform(named, lambda d: d["_Name"])
    first = F.filter(named, lambda d, i: F.array_position(keys, d["_Name"]) == i + 1)
    pairs = F.map_from_entries(F.transform(first, lambda d: F.struct(d["_Name"].alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value"))))
    return parsed.select(
        F.col("System.Computer").alias("host"), F.col("System.Channel").alias("channel"), F.col("System.Provider._Name").alias("provider"), F.col("System.EventID").alias("event_id"),
        F.col("System.TimeCreated._SystemTime").alias("time"), pairs.alias("data"), F.transform(data, lambda d: F.coalesce(d["_VALUE"], F.lit(""))).alias("values"),
    )


def reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reports, quarantine): one row per report.json below path, with its file and SHA-256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").load(path)
    rows = raw.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), schemas.REPORT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    fine = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col("r.scan.run_id").isNotNull()
    return rows.where(fine).select("path", "sha256", "r.*").drop("_corrupt"), rows.where(~F.coalesce(fine, F.lit(False))).select("path", "sha256")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """path of the folder, name, sha256 from every manifest.json below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(path)
    entries = F.from_json(F.decode("content", "UTF-8"), "map<string,string>")
    return raw.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode(entries).alias("name", "sha256"))


def report_findings(reports_: DataFrame) -> DataFrame:
    """Findings of reports as the fusion stage's rows."""
    f = reports_.select(F.col("scan.run_id").alias("run_id"), F.posexplode("findings").alias("ord", "f"))
    return f.select(
        "run_id", "ord", F.col("f.host").alias("host"), F.col("f.view").alias("view"), F.col("f.detection.basis").alias("basis"), F.col("f.detection.knowledge_ref").alias("knowledge_ref"), F.col("f.detection.evidence").alias("evidence"),
        F.col("f.classification.family").alias("family"), F.col("f.tier").alias("tier"), F.coalesce("f.score", F.lit(0)).alias("score"), F.coalesce("f.detection.allowlisted", F.lit(False)).alias("allowlisted"), F.col("f.target.file.path").alias("path"),
        F.col("f.target.file.sha256").alias("sha256"), F.col("f.target.process.pid").alias("pid"), F.col("f.artifact.identity").alias("identity"), F.col("f.id").alias("finding_id"),
    )


def report_coverage(reports_: DataFrame) -> DataFrame:
    """Coverage rows; skip counters that a report leaves out stay null."""
    return reports_.select(F.col("scan.run_id").alias("run_id"), F.col("scan.host").alias("host"), F.explode("coverage").alias("c")).select("run_id", "host", "c.*").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def report_time(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time; 0 where it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0))


def claims(spark: SparkSession, path: str) -> DataFrame:
    """One row per class from key<TAB>value facts; a name line begins a class."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    facts = lines.where("line like '%\t%'").select("file", "pos", F.split("line", "\t", 2)[0].alias("k"), F.split("line", "\t", 2)[1].alias("v"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = facts.withColumn("n", F.sum((F.col("k") == "name").cast("int")).over(w)).where("n > 0")
    one = lambda k: F.first(F.when(F.col("k") == k, F.col("v")), ignorenulls=True)
    flag = lambda k: F.coalesce(F.bool_or((F.col("k") == k) & (F.col("v") == "true")), F.lit(False))
    many = lambda k: F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("v"))))
    return numbered.groupBy("file", "n").agg(one("name").alias("class_name"), F.coalesce(one("codesource"), F.lit("")).alias("code_source"), flag("out_of_contract").alias("out_of_contract"), flag("loader_read_ok").alias("loader_read_ok"), flag("verified_generated").alias("generated"), many("iface").alias("contracts"), many("capability").alias("capabilities"))


def process_signals(facts: DataFrame) -> DataFrame:
    """pid, signal, severity, detail from facts of processes (pid, kind, line): lines of maps, targets of descriptors (fd),
    arguments (cmdline), names in the temporary folder (tmp). Each signal and detail once per process.

    Fixed values: signal names, severities, the ends of names that mean code."""
    kind, line = F.col("kind"), F.col("line")
    gone = line.endswith("(deleted)")
    mapped = F.trim(F.regexp_extract(line, r"^(?:\S+\s+){5}(.*)\(deleted\)$", 1))
    opened = F.trim(F.regexp_replace(line, r"\(deleted\)$", ""))
    code = lambda p: p.endswith(".jar") | p.endswith(".so") | p.endswith(".class") | F.contains(p, F.lit(".so."))
    weight = lambda p: F.when(code(p), "strong").otherwise("weak")
    signal = lambda name, severity, detail: F.struct(F.lit(name).alias("signal"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.alias("detail"))
    pid = F.col("pid").cast("string")
    s = (
        F.when((kind == "maps") & gone & (mapped != ""), signal("deleted-mapping", weight(mapped), mapped))
        .when((kind == "fd") & gone & (opened != ""), signal("deleted-fd", weight(opened), opened))
        .when((kind == "cmdline") & line.startswith("-javaagent:"), signal("startup-javaagent", "info", F.substr(line, F.lit(len("-javaagent:") + 1))))
        .when((kind == "cmdline") & (line == "-XX:+DisableAttachMechanism"), signal("attach-disabled", "info", line))
        .when((kind == "cmdline") & (line == "-XX:-EnableDynamicAgentLoading"), signal("dynamic-agent-load-disabled", "info", line))
        .when((kind == "tmp") & (line == F.concat(F.lit(".java_pid"), pid)), signal("attach-listener-already-started", "weak", line))
        .when((kind == "tmp") & (line == F.concat(F.lit(".attach_pid"), pid)), signal("attach-sentinel-present", "weak", line))
    )
    return facts.select("pid", s.alias("s")).where("s is not null").select("pid", "s.*").dropDuplicates(["pid", "signal", "detail"])


def external_findings(signals: DataFrame) -> DataFrame:
    """Strong signals score 40, weak ones 25; informational ones are no finding. A finding's id is stable over signal and detail."""
    rows = signals.where("severity <> 'info'").withColumn("score", F.when(F.col("severity") == "strong", 40).otherwise(25)).withColumn("tier", F.lit("suspicious"))
    ident = F.substring(F.sha2(F.concat("signal", F.lit("\x00"), "detail"), 256), 1, 16)
    return rows.withColumn("id", F.concat(F.lit("jvm-"), F.col("pid").cast("string"), F.lit("-"), ident)).withColumn("knowledge_ref", F.concat(F.lit("kb:java-mem/"), "signal"))


def java_processes(processes: DataFrame) -> DataFrame:
    """processes (pid, comm, argv, readable) with target: the process is a Java server."""
    first = F.regexp_extract(F.element_at("argv", 1), "[^/]*$", 0)
    return processes.withColumn("target", F.coalesce(F.col("readable") & ((F.col("comm") == "java") | (first == "java")), F.lit(False)))


def probe_output(texts: DataFrame) -> DataFrame:
    """host, view, form, findings, status of probes' outputs (host, view, text): an object, or a bare list of findings; what is
    neither is a failed view, never a clean one."""
    as_object = F.from_json("text", f"findings array<struct<{schemas.FINDING}>>, coverage {schemas.COVERAGE}")
    as_list = F.from_json("text", f"array<struct<{schemas.FINDING}>>")
    shape = F.substring(F.ltrim("text"), 1, 1)
    parses = F.try_parse_json("text").isNotNull()
    form = F.when(parses & (shape == "{"), "object").when(parses & (shape == "["), "list").otherwise("unreadable")
    rows = texts.withColumn("form", form).withColumn("o", as_object)
    found = F.when(F.col("form") == "object", F.col("o.findings")).when(F.col("form") == "list", as_list)
    status = F.when(F.col("form") == "unreadable", "failed").otherwise(F.coalesce("o.coverage.status", F.lit("ran")))
    known = F.col("status").isin("ran", "n/a", "degraded", "failed")
    out = rows.select("host", "view", "form", F.coalesce(found, F.array().cast(f"array<struct<{schemas.FINDING}>>")).alias("findings"), status.alias("status"))
    return out.withColumn("status", F.when(known, F.col("status")).otherwise("failed"))
