"""Cases that once came out wrong: addresses, job endings, split titles, empty images, missing counts."""

from pyspark.sql import functions as F

from proofgrid.functions.text import natural_key
from proofgrid.operators import address, labels, policy, scenes
from proofgrid.streaming.events import job_fold


def test_reserved_addresses_fail_closed(spark):
    cases = {"1:2": True, "12:34": True, "::ffff:7f00:1": True, "::ffff:8.8.8.8": False, "::ffff:10.0.0.1": True,
             "2001:db8::1": False, "2001:db8:0:0:0:0:0:1": False, "1:2:3:4:5:6:7:8:9": True, "::1": True, "::": True,
             "fe80::1": True, "8.8.8.8": False, "8.8.8": True, "64:ff9b::8.8.8.8": False, "1::2::3": True, ":::": True}
    rows = spark.createDataFrame(list(cases), "string").select("value", policy.is_private_ip(F.col("value")).alias("p"))
    assert {r.value: r.p for r in rows.collect()} == cases


def test_title_case_after_every_non_word_character(spark):
    df = spark.createDataFrame(["SMITH-JONES O'BRIEN/west ny", ""], "string")
    assert [r[0] for r in df.select(address.title_case(F.col("value"))).collect()] == ["Smith-Jones O'Brien/West NY", ""]


def test_natural_key_of_long_runs(spark):
    names = ["a9", "a10", "a" + "1" * 20 + "1", "a" + "1" * 20 + "2", "a007"]
    df = spark.createDataFrame(names, "string").orderBy(natural_key(F.col("value")))
    assert [r.value for r in df.collect()] == ["a007", "a9", "a10", "a" + "1" * 20 + "1", "a" + "1" * 20 + "2"]


def test_site_title_over_two_tokens(spark):
    df = spark.createDataFrame([("s", 1, "SITE"), ("s", 2, "PLAN"), ("t", 1, "PLAN"), ("t", 2, "SITE"), ("u", 1, "SITE PLAN")],
                               "sheet string, pos int, text string")
    got = labels.site_sheets(df, sheet="sheet", text="text", position="pos")
    assert {r.sheet: r.site_reference for r in got.collect()} == {"s": True, "t": False, "u": True}


def test_late_jobs_fail_and_ties_are_ordered(spark):
    rows = [("late", "2024-01-01 00:00:00", 1, "running"), ("late", "2024-01-01 05:00:00", 2, "ready"),
            ("tie", "2024-01-01 00:00:00", 2, "failed"), ("tie", "2024-01-01 00:00:00", 1, "ready"),
            ("open", "2024-01-01 00:00:00", 1, "running")]
    df = spark.createDataFrame(rows, "job string, ts string, id int, st string").withColumn("ts", F.to_timestamp("ts"))
    got = job_fold(df, job="job", status="st", time="ts", ident="id", complete=F.lit(True), now=F.lit("2024-01-01 00:30:00"))
    assert {r.job: r.status for r in got.collect()} == {"late": "failed", "tie": "ready", "open": "running"}


def test_match_spread_of_an_empty_image(spark):
    df = spark.createDataFrame([("p", float(x), float(x * x), 0, 0) for x in range(5)], "k string, x double, y double, w int, h int")
    row = scenes.match_spread(df, keys=["k"], x="x", y="y", width="w", height="h").first()
    assert (row.cells, row.hull_coverage) == (0, 0.0)
