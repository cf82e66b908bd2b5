"""Scores, corroboration and verdicts on hand-made findings."""

import random

import pytest

from vigilspark.operators import fusion, outputs
from pyspark.sql import functions as F

COLUMNS = "ord long, host string, view string, basis string, knowledge_ref string, evidence string, family string, tier string, score int, allowlisted boolean, path string, pid int, identity string"


def row(ord_, **kw):
    base = dict(host="h", view="disk", basis="signature", knowledge_ref="r", evidence=f"e{ord_}", family=None, tier="", score=0, allowlisted=False, path=f"/p{ord_}", pid=None, identity="i")
    return (ord_, *{**base, **kw}.values())


def assess(spark, rows):
    return {r.ord: (r.tier, r.score) for r in fusion.assess(spark.createDataFrame(rows, COLUMNS)).collect()}


@pytest.mark.parametrize(
    ("kw", "expected"),
    [
        (dict(), ("likely-malicious", 70)),
        (dict(score=90), ("confirmed", 90)),
        (dict(score=39), ("clean", 39)),
        (dict(tier="suspicious", score=90), ("suspicious", 90)),
        (dict(tier="confirmed", score=3), ("confirmed", 3)),
        (dict(family="Behinder", score=10), ("likely-malicious", 80)),
        (dict(family="Behinder", tier="confirmed", score=10), ("confirmed", 10)),
        (dict(basis="stomp-diff", tier="confirmed", score=10), ("confirmed", 85)),
        (dict(basis="stomp-diff", tier="likely-malicious", score=90), ("likely-malicious", 90)),
        (dict(basis="stomp-diff", score=99), ("suspicious", 50)),
        (dict(basis="behavioral"), ("suspicious", 50)),
        (dict(basis="behavioral-context", score=90), ("clean", 10)),
        (dict(basis="something"), ("suspicious", 45)),
    ],
)
def test_alone(spark, kw, expected):
    assert assess(spark, [row(1, **kw)])[1] == expected


def test_corroboration(spark):
    a = row(1, view="disk", basis="signature", tier="likely-malicious", score=70)
    b = row(2, view="java-mem", basis="structural-heuristic", tier="likely-malicious", score=60)
    assert assess(spark, [a, b]) == {1: ("confirmed", 90), 2: ("confirmed", 95)}
    # allowlisted rows and heuristics don't corroborate; hosts stay apart
    assert assess(spark, [a, row(2, view="java-mem", basis="structural-heuristic", allowlisted=True)])[1] == ("likely-malicious", 70)
    assert assess(spark, [a, row(2, view="java-mem", basis="heuristic")])[1] == ("likely-malicious", 70)
    assert assess(spark, [a, row(2, view="java-mem", basis="structural-heuristic", host="other")])[1] == ("likely-malicious", 70)
    # within a view only another attributed finding on the same target does
    c = row(3, path="/p1", family="Godzilla", evidence="x")
    assert assess(spark, [a, c])[1] == ("confirmed", 90)
    assert assess(spark, [c])[3] == ("likely-malicious", 80)


def test_order_does_not_matter(spark):
    rows = [row(i, view=["disk", "java-mem"][i % 2], score=i * 7 % 100, evidence=f"e{i % 5}", path=f"/p{i % 3}") for i in range(60)]
    first = assess(spark, rows)
    random.Random(1).shuffle(rows)
    assert assess(spark, rows) == first


def test_fingerprint_and_dedup(spark):
    rows = [row(1, evidence="same", path="/a", score=10), row(2, evidence="same", path="/a", score=20), row(3, evidence="same", path="/a", score=20)]
    out = fusion.dedup_fingerprint(fusion.normalise(spark.createDataFrame(rows, COLUMNS))).collect()
    assert [(r.ord, r.score) for r in out] == [(1, 20)]
    assert len(out[0].fingerprint) == 16


def test_verdict_never_reports_an_incomplete_scan_as_clean(spark):
    scored = fusion.assess(spark.createDataFrame([row(1, host="a", basis="behavioral-context"), row(2, host="b", score=90), row(3, host="c", basis="behavioral-context")], COLUMNS))
    coverage = spark.createDataFrame([("a", "failed", False), ("b", "failed", False), ("c", "degraded", False), ("d", "ran", True), ("e", "n/a", False)], "host string, status string, truncated boolean")
    v = {r.host: (r.tier, r.incomplete, r.exit_code) for r in fusion.host_verdicts(scored, coverage).collect()}
    assert v == {"a": ("unknown", True, 5), "b": ("confirmed", True, 4), "c": ("clean", False, 0), "d": ("unknown", True, 5), "e": ("clean", False, 0)}


def test_event_record(spark):
    import json

    scored = fusion.assess(spark.createDataFrame([row(1, score=90, view="java-mem", path=None, pid=7)], COLUMNS))
    v = fusion.host_verdicts(scored, spark.createDataFrame([("h", "ran", False)], "host string, status string, truncated boolean"))
    e = json.loads(outputs.ocsf_json(outputs.ocsf(scored, v)).first().event)
    assert (e["class_uid"], e["type_uid"], e["severity_id"], e["confidence_id"]) == (2004, 200401, 5, 3)
    assert [a["tactic"]["uid"] for a in e["attacks"]] == ["TA0003", "TA0005"]
    assert e["observables"] == ["device.hostname=h", "process.pid=7"]
    assert outputs.build_id(F.lit("a"), F.lit("b")) is not None
