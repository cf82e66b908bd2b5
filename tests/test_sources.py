"""Readers, sinks, discovery, the rule library and streams on small files."""

import json

import pytest

from pyspark.sql import functions as F

from vigilspark.operators import behaviour, discovery, library, memory, triage
from vigilspark.sources import readers, sinks
from vigilspark.streaming import ingest as stream


def report(run, host="h", tier="suspicious"):
    return {"schema_version": "1.0", "scan": {"host": host, "run_id": run, "started": "2024-01-02T03:04:05Z"}, "verdict": {"tier": tier, "score": 50, "incomplete": False}, "coverage": [{"view": "disk", "status": "ran", "skipped": {"unreadable": 0}}, {"view": "java-mem", "status": "n/a"}], "findings": [{"id": "f1", "host": host, "view": "disk", "tier": tier, "score": 50, "detection": {"basis": "signature", "evidence": "e"}, "target": {"kind": "file", "file": {"path": "/x.php", "sha256": "ab"}}}]}


def test_reports(spark, tmp_path):
    for i, body in enumerate([json.dumps(report("r1")), json.dumps(report("r2")), "{broken"]):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "report.json").write_text(body)
    good, bad = readers.reports(spark, str(tmp_path))
    assert sorted(r.scan.run_id for r in good.collect()) == ["r1", "r2"] and bad.count() == 1
    f = readers.report_findings(good).collect()
    assert {(r.path, r.score, r.allowlisted) for r in f} == {("/x.php", 50, False)}
    c = {(r.view, None if r.skipped is None else r.skipped.unreadable) for r in readers.report_coverage(good).collect()}
    assert c == {("disk", 0), ("java-mem", None)}
    t = good.select(readers.report_time(F.col("scan.started")).alias("t"), readers.report_time(F.lit("never")).alias("z")).first()
    assert (t.t, t.z) == (1704164645000, 0)


def test_engine_matches(spark, tmp_path):
    lines = [
        {"path": "/a", "rules": [{"identifier": "r", "namespace": "n", "meta": [["score", 75], ["x", "y"]], "strings": [{"identifier": "$a", "offset": 3, "match": "m"}]}]},
        {"path": "/b", "rules": [{"identifier": "q", "meta": {"score": "80", "ok": True}, "strings": []}]},
        {"path": "/c", "rules": []},
    ]
    p = tmp_path / "m.ndjson"
    p.write_text("\n".join([json.dumps(x) for x in lines] + ["", "not json"]))
    good, bad = readers.engine_matches(spark, str(p))
    got = {r.path: (r.rule, dict(r.meta), list(r.strings)) for r in good.collect()}
    assert got == {"/a": ("r", {"score": "75", "x": "y"}, ["$a"]), "/b": ("q", {"score": "80", "ok": "true"}, [])}
    assert [r.line for r in bad.collect()] == ["not json"]


def test_events(spark, tmp_path):
    event = '<Event><System><Provider Name="ASP.NET 4"/><EventID>{0}</EventID><Channel>{1}</Channel><Computer>h</Computer><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData><Data Name="ParentProcessName">C:\\x\\w3wp.exe</Data><Data Name="NewProcessName">{2}</Data><Data>ViewState bad</Data></EventData></Event>'
    p = tmp_path / "e.xml"
    p.write_text(event.format(4688, "Security", "C:\\Windows\\cmd.exe") + event.format(1316, "Application", "") + "<Event>broken</Event>")
    good, bad = readers.events(spark, str(p))
    e = good.withColumn("ord", F.monotonically_increasing_id()).cache()
    assert {(r.knowledge_ref, r.identity) for r in behaviour.detect(e).collect()} == {("kb:behavioral/w3wp-child-process", "proc:w3wp->cmd.exe"), ("kb:behavioral/viewstate-mac-failure", "asp.net:viewstate-mac-failure")}
    assert bad.count() == 1
    one = readers.events_from_text(spark.createDataFrame([(event.format(1, "S", "x\x01y"),)], "value string")).first()
    assert one.data["NewProcessName"] == "xy" and one["values"][2] == "ViewState bad"


def test_files_blobs_and_facts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.php").write_bytes(b"12345")
    (tmp_path / "a" / "y.php").write_bytes(b"1" * 100)
    got = {r.path.rsplit("/", 1)[-1]: r.content for r in readers.files(spark, str(tmp_path / "a"), limit=50).collect()}
    assert got == {"x.php": b"12345", "y.php": None}
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary")
    store = str(tmp_path / "blobs")
    new = [r.sha256 for r in sinks.put_blobs(rows, store).collect()]
    assert len(new) == 2 and sinks.put_blobs(rows, store).count() == 0
    assert {bytes(r.content) for r in sinks.get_blobs(spark, store, new).collect()} == {b"one", b"two"}
    (tmp_path / "claims.tsv").write_text("name\ta.B\ncodesource\t/x.jar\niface\tI\niface\tJ\nname\tc.D\nout_of_contract\ttrue\n")
    c = {r.class_name: (r.code_source, r.out_of_contract, list(r.contracts)) for r in readers.claims(spark, str(tmp_path / "claims.tsv")).collect()}
    assert c == {"a.B": ("/x.jar", False, ["I", "J"]), "c.D": ("", True, [])}
    facts = [(1, "maps", "7f-80 r-xp 00 08:01 12 /tmp/x y.so (deleted)"), (1, "maps", "7f-80 r--p 00 08:01 12 /tmp/z (deleted)"), (1, "maps", "7f-80 r-xp 00 08:01 12 /lib/a.so"), (1, "fd", "/tmp/a.jar (deleted)"), (1, "fd", "/tmp/a.jar (deleted)"), (1, "cmdline", "-javaagent:/a.jar"), (1, "tmp", ".java_pid1"), (2, "tmp", ".java_pid1")]
    s = readers.process_signals(spark.createDataFrame(facts, "pid int, kind string, line string"))
    assert sorted((r.pid, r.signal, r.severity, r.detail) for r in s.collect()) == [(1, "attach-listener-already-started", "weak", ".java_pid1"), (1, "deleted-fd", "strong", "/tmp/a.jar"), (1, "deleted-mapping", "strong", "/tmp/x y.so"), (1, "deleted-mapping", "weak", "/tmp/z"), (1, "startup-javaagent", "info", "/a.jar")]
    assert sorted(r.score for r in readers.external_findings(s).collect()) == [25, 25, 40, 40]
    g = readers.listing_gaps(spark.createDataFrame([("a", "file", True, True), ("b", "fifo", True, True), ("c", "link", True, False), ("d", "link", True, True), ("e", "file", False, True)], "path string, kind string, readable boolean, inside boolean"))
    assert {r.path: r.gap for r in g.collect()} == {"a": None, "b": "not-regular", "c": "outside-root", "d": None, "e": "unreadable"}
    p = readers.java_processes(spark.createDataFrame([("java", ["x"], True), ("sh", ["/usr/bin/java"], True), ("sh", ["sh"], True), ("java", ["java"], False)], "comm string, argv array<string>, readable boolean"))
    assert [r.target for r in p.collect()] == [True, True, False, False]


def test_probe_output(spark):
    rows = [("h", "a", json.dumps({"findings": [{"id": "1"}], "coverage": {"status": "degraded"}})), ("h", "b", '[{"id": "1"}, {"id": "2"}]'), ("h", "c", "boom"), ("h", "d", '{"coverage": {"status": "odd"}}')]
    got = {r.view: (r.form, len(r.findings), r.status) for r in readers.probe_output(spark.createDataFrame(rows, "host string, view string, text string")).collect()}
    assert got == {"a": ("object", 1, "degraded"), "b": ("list", 2, "ran"), "c": ("unreadable", 0, "failed"), "d": ("object", 0, "failed")}


def test_discovery(spark):
    configs = [
        ("h", "apache-config", 'DocumentRoot "/var/www/html"\n# DocumentRoot /no\n  documentroot /srv/x/  # here\n'), ("h", "nginx-config", "server {\n root /var/www/html/sub;\n}\n"), ("h", "iis-config", '<virtualDirectory physicalPath="%SystemDrive%\\inetpub" />'),
        ("h", "tomcat-server-xml", '<Host name="x" appBase="webapps">'), ("h", "tomcat-process", "java -Dcatalina.base=/opt/t x"), ("h", "apache-dump", 'Main DocumentRoot: "/var/www/html"'), ("h", "other", "x"),
    ]
    p = discovery.proposals(spark.createDataFrame(configs, "host string, mechanism string, text string"))
    s = discovery.subsume(discovery.merge(p))
    got = {r.path: (r.provenance, r.covered_by, list(r.mechanisms)) for r in s.collect()}
    assert got["/var/www/html"] == ("config", None, ["apache-config", "apache-dump"])
    assert set(got) == {"/var/www/html", "/var/www/html/sub", "/srv/x", "C:\\inetpub", "webapps", "/opt/t"} and got["/var/www/html/sub"][1] == "/var/www/html"
    assert {r.mechanism: r.roots for r in discovery.credit(s).collect()}["nginx-config"] == 1
    only = discovery.with_explicit(p, spark.createDataFrame([("h", "/mine")], "host string, path string"))
    assert [r.path for r in only.collect()] == ["/mine"]
    assert discovery.refuse(p, ["apache-config"]).where("mechanism = 'apache-config'").count() == 0
    assert discovery.listed(s).first().total == 5
    bases = spark.createDataFrame([("h", "/opt/jb", "appserver-process"), ("h", "/opt/wl", "appserver-convention")], "host string, path string, mechanism string")
    listing = spark.createDataFrame([("h", x) for x in ("/opt/jb/standalone/deployments", "/opt/jb/deployments/x", "/opt/wl/servers/s1/stage", "/opt/wl/servers/a/b/stage", "/x/apps")], "host string, path string")
    assert {(r.path, r.provenance) for r in discovery.deployments(bases, listing).collect()} == {("/opt/jb/standalone/deployments", "config"), ("/opt/wl/servers/s1/stage", "convention")}


def test_library(spark):
    pack = 'import "pe"\nrule one {\n  meta:\n    score = 75\n    author = "a"\n    author = "b"\n  strings:\n    $a = "x"\n  condition: any of them\n}\nprivate rule two : tag {\n  condition: true\n}'
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(pack.split("\n"))], "pack string, pos int, line string")
    rows = {r.identifier: r for r in library.rule_meta(library.split_pack(lines)).collect()}
    assert set(rows) == {"one", "two"} and rows["one"].body.startswith('import "pe"\nrule one') and dict(rows["one"].meta) == {"score": "75", "author": "a"}
    assert (rows["one"].meta_score, rows["two"].meta_score) == (75, None)
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "rule_id long, depends_on long")
    c = {(r.rule_id, r.depends_on) for r in library.dependency_closure(refs).collect()}
    assert c == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, d string")
    new, conflict = library.insert_if_absent(old, spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, d string"), "k", "d")
    assert [r.k for r in new.collect()] == ["c"] and [r.k for r in conflict.collect()] == ["b"]
    rows = spark.range(53).select(F.col("id").alias("x"))
    seen = [r.x for n in range(1, 7) for r in library.page(rows, 9, n, [F.col("x")]).collect()]
    assert seen == list(range(53))
    assert [r.position for r in library.page(rows, 9, -4, [F.col("x")]).collect()] == list(range(1, 10))


def test_memory(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 70000, 200000)], "pid int, l_start long, l_end long")
    b = spark.createDataFrame([(1, 9, 80000), (1, 10, 11), (2, 0, 5)], "pid int, r_start long, r_end long")
    assert sorted((r.l_start, r.r_start) for r in memory.overlap_join(a, b, ["pid"]).collect()) == [(0, 9), (70000, 9)]
    d = spark.createDataFrame([("k", i) for i in (1, 2, 3, 7, 8, 20)], "k string, rva long")
    assert tuple(memory.byte_runs(d, ["k"]).first()[1:]) == (6, 3)
    m = spark.createDataFrame([(1, True, ["a"]), (2, False, []), (3, False, ["x"])], "image_base int, benign boolean, capabilities array<string>")
    w = memory.wired_components(spark.createDataFrame([("a", 1, 1), ("b", 2, 0), ("c", 3, 0), ("d", 9, 0), ("e", 2, 1)], "component string, module_base int, field_hits int"), m)
    assert {r.component: (r.score, r.suppressed) for r in w.collect()} == {"a": (0, True), "b": (85, False), "c": (95, False), "d": (55, False), "e": (95, False)}


def test_triage(spark):
    f = spark.createDataFrame([("k", "h1", "/a", " ", "clean", 5), ("k", "h1", "/a", "r", "clean", 9)], "content_key string, host string, file_path string, knowledge_ref string, tier string, score int")
    g = triage.groups(f).first()
    assert (g.tier, g.score, g.locations, list(g.rules)) == ("", 9, 1, ["r"])


def test_stream(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "runs")
    source.mkdir()
    for i, r in enumerate(["r1", "r2", "r1"]):
        (source / f"{i}.json").write_text(json.dumps(report(r)))
    run = lambda: stream.ingest(stream.report_stream(spark, str(source)), table, str(tmp_path / "cp")).awaitTermination(120)
    run()
    (source / "9.json").write_text(json.dumps(report("r2")))
    (source / "8.json").write_text(json.dumps(report("r3")))
    run()
    assert sorted(r.run_id for r in spark.read.parquet(table).collect()) == ["r1", "r2", "r3"]


def test_run_folder(spark, tmp_path):
    from vigilspark.operators import fusion, outputs
    from vigilspark.plans.projections import view

    d = "/root/testdata/sf0.001"
    scored = fusion.assess(view(spark, d, "v_finding").where("ord < 200")).cache()
    coverage = view(spark, d, "v_coverage")
    verdicts = fusion.host_verdicts(scored, coverage)
    path = str(tmp_path / "run")
    manifest = sinks.write_run(scored, coverage, verdicts, path)
    files = readers.files(spark, f"{path}/report", f"{path}/summary", f"{path}/findings").select(F.regexp_extract("path", r"(?:report|summary|findings)/.*$", 0).alias("name"), "content")
    states = {r.state for r in outputs.verify_manifest(manifest, outputs.manifest(files)).collect()}
    assert states == {"ok"} and spark.read.text(f"{path}/findings").count() == scored.count()


def test_freeze_and_identifiers(spark):
    resolved = spark.createDataFrame([(1, 10, 3), (2, 11, 1)], "set_id int, rule_id int, revision int")
    sets = spark.createDataFrame([(1,), (2,), (3,)], "set_id int")
    add, refused = library.freeze(sets, resolved, spark.createDataFrame([(2, 11, 1)], "set_id int, rule_id int, revision int"))
    assert [tuple(r) for r in add.collect()] == [(1, 10, 3)] and sorted(r.set_id for r in refused.collect()) == [2, 3]
    texts = spark.createDataFrame([("rule a { }",), ("private rule b : t { }\nrule c { }",), ("no",), ("  global rule d\n{",)], "t string")
    assert [r.n for r in texts.select(library.rule_identifier(F.col("t")).alias("n")).collect()] == ["a", None, None, "d"]


def test_settings():
    import pytest

    from vigilspark.operators import scan

    assert scan.load_settings('{"a": "x", "b": null}', {"a": ("x", "y"), "b": ()}) == {"a": "x", "b": None}
    for text in ('{"a": "x", "a": "y"}', '{"z": 1}', '{"a": "q"}', "[1]"):
        with pytest.raises(ValueError):
            scan.load_settings(text, {"a": ("x", "y")})


def test_layer_archives(spark, tmp_path):
    """Out and in again; the same bytes whatever the order; what was tampered with is refused."""
    import tarfile

    from vigilspark.sources import layer_archive

    rows = [("own", "a", "rule a { condition: true }"), ("own", "b", "rule b { condition: a }"), ("community", "a", "rule a { condition: false }")]
    one, two = str(tmp_path / "one.tgz"), str(tmp_path / "two.tgz")
    digest = layer_archive.export_layers(spark.createDataFrame(rows, layer_archive.COLUMNS), one)
    assert digest == layer_archive.export_layers(spark.createDataFrame(rows[::-1], layer_archive.COLUMNS).repartition(3), two)
    assert sorted(map(tuple, layer_archive.import_layers(spark, one).collect())) == sorted(rows)
    empty = str(tmp_path / "empty.tgz")
    layer_archive.export_layers(spark.createDataFrame([], layer_archive.COLUMNS), empty)
    assert layer_archive.import_layers(spark, empty).count() == 0
    for bad in ([("own", "../x", "t")], [rows[0], rows[0]], [("a/b", "c", "t")]):
        with pytest.raises(ValueError):
            layer_archive.export_layers(spark.createDataFrame(bad, layer_archive.COLUMNS), str(tmp_path / "bad.tgz"))
    with tarfile.open(one) as tar:
        files = [(m.name, tar.extractfile(m).read()) for m in tar]
    for changed in ([(n, d + b" " if n == "own/a.yar" else d) for n, d in files], files[:-1], [*files, ("own/c.yar", b"x")], [*files, ("../../etc/x.yar", b"x")], [f for f in files if f[0] != layer_archive.MANIFEST]):
        (tmp_path / "bad.tgz").write_bytes(layer_archive.deterministic_tar(changed))
        with pytest.raises(ValueError):
            layer_archive.import_layers(spark, str(tmp_path / "bad.tgz"))
    (tmp_path / "bad.tgz").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        layer_archive.import_layers(spark, str(tmp_path / "bad.tgz"))


def _choice(spark):
    layers = spark.createDataFrame([(1, "own"), (1, "own"), (2, "own"), (2, "base"), (None, "base"), (4, None), (5, "none")], "set_id long, layer string")
    named = spark.createDataFrame([(1, 1), (1, 2), (3, 5), (3, 5), (4, 3), (2, 9), (5, 4), (None, 1), (6, 6)], "set_id long, rule_id long")
    barred = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 5), (3, 7), (4, 3), (None, 2), (6, 1)], "set_id long, rule_id long")
    rules = spark.createDataFrame([(1, "own", False), (2, "base", False), (3, "own", False), (4, "own", True), (5, None, False), (6, "base", False), (8, "own", False)], "rule_id long, layer string, deleted boolean").withColumn("identifier", F.concat(F.lit("r"), "rule_id"))
    revisions = spark.createDataFrame([(k, n, f"{k}.{n}") for k in range(1, 7) for n in range(1, k + 1)], "rule_id long, revision int, body string")
    return layers, named, barred, rules, revisions


WANTED = [(None, 1), (None, 2), (None, 6), (1, 2), (1, 3), (2, 1), (2, 3), (2, 6), (3, 5), (6, 6)]


def _above_explode(df) -> list[str]:
    """Operators of the plan that take the pairs of a set and a rule of its layers."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line and "set_id" in line)
    return [line.lstrip(" :+-").split(" ")[0] for line in lines[:at]]


def test_resolved_counts(spark):
    """counts are those of the rows, null sets too, without a row for each set and rule."""
    counts = library.resolved_counts(*_choice(spark))
    assert sorted(((r.set_id or 0), r.rules) for r in counts.collect()) == [(0, 3), (1, 2), (2, 3), (3, 1), (6, 1)]
    assert "explode" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_resolve_deals_pairs_last(spark):
    """pairs of set and rule are made last, and neither joined nor made distinct."""
    found = library.resolve(*_choice(spark))
    assert sorted(((r.set_id or 0), r.rule_id, r.revision) for r in found.collect()) == [(s or 0, k, k) for s, k in WANTED]
    assert set(_above_explode(found)) <= {"Union", "Project"}


def test_resolved_members_deal_pairs_last(spark):
    """names and texts are joined with rules, not with pairs of set and rule."""
    found = library.resolved_members(*_choice(spark))
    rows = sorted(((r.set_id or 0), r.rule_id, r.identifier, r.body) for r in found.collect())
    assert rows == [(s or 0, k, f"r{k}", f"{k}.{k}") for s, k in WANTED]
    assert set(_above_explode(found)) <= {"Union", "Project"}


def test_pairs_are_dealt_by_blocks_of_sets(spark):
    """what a task writes repeats itself: few sets follow each other, rule after rule, and none of the pairs is lost."""
    layers = spark.range(3000).select(F.col("id").alias("set_id"), F.lit("own").alias("layer"))
    rules = spark.range(40).select(F.col("id").alias("rule_id"), F.lit("own").alias("layer"), F.lit(False).alias("deleted"))
    barred = spark.createDataFrame([(7, 3), (7, 4), (8, 3)], "set_id long, rule_id long")
    named = spark.createDataFrame([(9, 3), (3001, 3)], "set_id long, rule_id long")
    revisions = rules.select("rule_id", F.lit(1).alias("revision"))
    found = library.resolve(layers, named, barred, rules, revisions)
    rows = found.select("set_id", "rule_id", F.spark_partition_id().alias("task")).toPandas()
    assert len(rows) == 3000 * 40 - 3 + 1 == len(rows.drop_duplicates(["set_id", "rule_id"]))
    assert not set(zip(rows.set_id, rows.rule_id, strict=True)) & {(7, 3), (7, 4), (8, 3)}
    assert all(part.set_id.head(1000).nunique() < 500 for _, part in rows.groupby("task"))


def test_members_need_no_order_of_revisions(spark):
    """the latest revisions are counted, as v_revision numbers them, and their rows are neither sorted nor all shuffled."""
    from vigilspark.plans import library_queries
    from vigilspark.plans.projections import view

    folder = "/root/testdata/sf0.001"
    revisions = library_queries._selection(spark, folder)[-1]
    assert "Window" not in revisions._jdf.queryExecution().optimizedPlan().toString()
    as_rows = lambda df: sorted(map(tuple, df.select("rule_id", "revision", "body").collect()))
    assert as_rows(revisions) == as_rows(library.latest_revision(view(spark, folder, "v_revision")))
