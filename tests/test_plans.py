"""What the optimiser makes of the scan stays of the scan's own size."""

from __future__ import annotations

from guardlake import catalog, rules
from guardlake.operators import audit, content
from guardlake.plans import derived as D

SF = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_rule_stands_in_the_plan_a_fixed_number_of_times(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    scan = optimised(content.scanned(content.normalised(D.content(spark, SF))))
    exploded = optimised(catalog.queries()["p1_p16_scan"](spark, SF))
    for r in rules.REGEX_RULES:
        part = r.pattern[:40]
        assert exploded.count(part) == scan.count(part), r.rule_id
    assert len(exploded) < 2 * len(scan) and exploded.count("RLIKE") <= scan.count("RLIKE")


def test_a_filter_on_the_score_does_not_repeat_the_scan(spark):
    scan = optimised(content.scanned(content.normalised(D.content(spark, SF))))
    plan = optimised(catalog.queries()["r2_risk_gate"](spark, SF))
    assert all(plan.count(r.pattern[:40]) == scan.count(r.pattern[:40]) for r in rules.REGEX_RULES)


def test_gated_rules_find_what_the_patterns_alone_find(spark):
    """No rule needs a string that a text it matches can lack."""
    import re

    texts = ["IGNORE all the\nprevious Prompts", "disregard rules", "<|  SYSTEM|>", "[/system ]", "New Instruction -", "You ARE now going to", "<|im_end|>", "enable god  mode", "Jailbreak prompt", "jailbreakmode", "activate dev\tmode", "DATA:text/html,abcdefgh12", "İ ignore previous directions", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: {f.rule_id for f in r.findings} for r in content.scored(df).collect()}
    for i, text in enumerate(texts):
        assert {x.rule_id for x in rules.REGEX_RULES if re.search(x.pattern, text, re.A)} == {x for x in found[i] if x in {r.rule_id for r in rules.REGEX_RULES}}, text


def test_the_sanitizers_plan_is_near_the_scans(spark):
    """All lanes are in it, and each rule still stands there as often as in the scan alone."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    rows = [("1", "<p>a</p>", "s", "html"), ("2", "# b", "s", "md"), ("3", "{}", "s", "json"), ("4", "c", "s", "text")]
    df = spark.createDataFrame(rows, "content_id string, text string, source string, declared_type string")
    scan, whole = optimised(content.scored(df)), optimised(content.sanitize(df))
    assert all(whole.count(r.pattern[:40]) == scan.count(r.pattern[:40]) for r in rules.REGEX_RULES)
    assert len(whole) < 3 * len(scan)


def files_read(df) -> int:
    """How many files the scan of df opens, by its own count."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    leaf = leaf.executedPlan() if "Adaptive" in leaf.getClass().getName() else leaf
    return leaf.collectLeaves().head().metrics().get("numFiles").get().value()


def test_a_search_reads_the_folders_that_can_hold_its_events(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = [(i, f"s{i % 40}", base + timedelta(hours=i), ["Allow", "Deny"][i % 2]) for i in range(240)]
    audit.write_events(spark.createDataFrame(events, "event_id long, session_id string, ts timestamp, decision string"), f"{tmp_path}/e")
    table = spark.read.parquet(f"{tmp_path}/e")
    found = audit.audit_search(table, base + timedelta(days=2), base + timedelta(days=4), "s7")
    assert sorted(r.event_id for r in found.collect()) == [i for i, s, ts, _ in events if s == "s7" and 48 <= i < 96]
    assert files_read(found) <= 3 < 20 < files_read(table.filter("event_id >= 0"))
    assert audit.audit_search(table, decision="Deny").count() == 120
