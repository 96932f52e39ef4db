"""Scored detectors, report helpers: values and what is kept."""

import pytest
from pyspark.sql import functions as F

from shroud.functions.dialect import SPARK as Q
from shroud.operators import report, scored

CASES = [
    ("api_token: Bearer 0123456789abcdefzQ", "C09", "TOKEN", "0123456789abcdefzQ"), ("login_email = jane7@corp-mail.io", "C17", "EMAIL", "jane7@corp-mail.io"), ('{"username": "jane.roe7"}', "C18", "USERNAME", "jane.roe7"),
    ("intro\nHarbor77!Stone7q\nend", "C23", "PASSWORD", "Harbor77!Stone7q"), ("net 10.4.0.0/16 up", "C27", "PRIVATE_CIDR", "10.4.0.0/16"), ("host 192.168.4.7 ok", "C27", "PRIVATE_IP", "192.168.4.7"), ("file share FS1234567 moved", "C28", "FILE_SHARE", "FS1234567"),
    ("group AD123-SH456-FILE-L-STFSA1234567R", "C29", "AD_GROUP", "AD123-SH456-FILE-L-STFSA1234567R"), ("azure rg-prod-weu-app-12 created", "C30", "AZURE_RG", "rg-prod-weu-app-12"), ("vnet-prod-weu-hub-12 peering", "C31", "CLOUD_RESOURCE", "vnet-prod-weu-hub-12"),
    ("storage account stweuprodfiles101", "C32", "STORAGE_ACCOUNT", "stweuprodfiles101"), ("server srv-app-prod-12 in subnet", "C33", "HOSTNAME", "srv-app-prod-12"), ("owner CORP\\jane.roe1", "C34", "USERNAME", "CORP\\jane.roe1"),
    ("openstack ecs-prod-eu-de-12 flavor", "C38", "OTC_RESOURCE", "ecs-prod-eu-de-12"), ("project_id: 0123456789abcdef0123456789abcdef", "C38", "OPENSTACK_PROJECT_ID", "0123456789abcdef0123456789abcdef"), ("to b1.obs.eu-de.otc.t-systems.com", "C38", "OTC_ENDPOINT", "b1.obs.eu-de.otc.t-systems.com"),
]
CLEAN = ["view?token= Bearer abc", "user_name: 12345", '{"username": "[PWM_3]"}', "plain words in a row", "net 11.4.0.0/16 up", "host 192.0.2.7 ok", "part FS1234567 moved", "group AD123-SH456-FILE-X-STFSA1234567R", "the rg-hello-world thing", "db-hello-world", "a strongword", "the x-y-1 value", "see module.name here", "as-hello-world", "to b1.example.org", "", None]


def test_scored(spark):
    texts = [t for t, *_ in CASES] + CLEAN
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in scored.scan(df).collect():
        assert texts[r.doc_id][r.start : r.end] == r.raw
        got.setdefault(r.doc_id, set()).add((r.detector, r.type, r.raw))
    for k, (text, *want) in enumerate(CASES):
        assert tuple(want) in got.get(k, ()), text
    assert [texts[k] for k in range(len(CASES), len(texts)) if k in got] == []
    assert {d for v in scored.scan(df, ("C29",)).collect() for d in [v.detector]} == {"C29"}


@pytest.mark.parametrize(("x", "ok"), [("2001:db8::1", True), ("::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False), ("1::2::3", False), ("fe80::1%eth0", True), ("12:30", False)])
def test_ipv6(spark, x, ok):
    assert spark.range(1).select(F.lit(x).alias("x")).select(F.expr(scored.ipv6(Q, "x"))).first()[0] is ok


def test_report_helpers(spark):
    spans = spark.createDataFrame([(1, 5, 9, "b"), (1, 0, 4, "a"), (2, 3, 8, "c")], "doc_id long, start int, end int, raw string")
    ranges = spark.createDataFrame([(1, 8, 12), (2, 8, 9)], "doc_id long, start int, end int")
    assert sorted(r.raw for r in report.outside(spans, ranges).collect()) == ["a", "c"]
    assert {(r.raw, r.id) for r in report.numbered(spans).collect()} == {("a", "f_0001"), ("b", "f_0002"), ("c", "f_0001")}
    moved = report.shifted(spans.withColumn("placeholder", F.lit("[PWM_1]"))).collect()
    assert {(r.raw, r.new_start, r.new_end) for r in moved} == {("a", 0, 7), ("b", 8, 15), ("c", 3, 10)}
    tokens = spark.createDataFrame([("[PUB_HOST_2]",), ("[NET_1_SUB_2]",), ("[PWM_10]",), ("[NET_1]",), ("[PWM_9]",)], "token string")
    assert [r.token for r in tokens.orderBy(*report.natural("token")).collect()] == ["[PWM_9]", "[PWM_10]", "[NET_1]", "[NET_1_SUB_2]", "[PUB_HOST_2]"]
    lines = spark.createDataFrame([("x" * 300 + "[PWM_1]" + "y" * 300, 300), ("short [PWM_1]", 6)], "line string, at int")
    assert [len(r[0]) for r in lines.select(report.preview(F.col("line"), F.col("at"), F.lit(7))).collect()] == [180, 13]
