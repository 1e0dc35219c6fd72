"""The audit strings of a record, and how they are gathered."""

from tivlens.operators import treat

COLUMNS = "row_id long, rule_id string, priority string, classification string, action string, method string, seq int"


def test_strings_of_a_record(spark):
    """Names sorted and once, methods in catalogue order and as often as found; nulls are no names."""
    rows = [(1, "K-003", "P2", "ERROR", "FIXED", "mapped", 30), (1, "C-001", None, "MISSING", "REFERRED", "asked", 1),
            (1, "K-003", "P2", "ERROR", "FIXED", "mapped", 30), (1, "G-001", "P1", "ERROR", "REFERRED", None, 20),
            (None, "C-002", None, "MISSING", "ASSUMED", "guessed", 2), (None, "V-001", "P3", None, "QUARANTINED", "kept", 9)]
    got = {r["row_id"]: r for r in treat.per_record(spark.createDataFrame(rows, COLUMNS)).collect()}
    one, none = got[1], got[None]
    assert one["treatment_rule"] == "C-001;G-001;K-003" and one["classification"] == "ERROR;MISSING" and one["priority"] == "P1;P2"
    assert one["treatment_method"] == "C-001: asked | G-001 | K-003: mapped | K-003: mapped"
    assert (one["quarantined"], one["referred"], one["assumed"], one["fixed"], one["has_k003"]) == (False, True, False, True, True)
    assert none["priority"] == "P3" and none["classification"] == "MISSING" and none["treatment_applied"] == "QUARANTINED"
    only = treat.per_record(spark.createDataFrame(rows[1:2], COLUMNS)).first()
    assert only["priority"] is None


def test_one_list_per_record(spark):
    """Four lists per record were kept, merged and sorted; now one is."""
    plan = treat.per_record(spark.createDataFrame([], COLUMNS))._jdf.queryExecution().executedPlan().toString()
    final = [line for line in plan.splitlines() if "ObjectHashAggregate" in line or "SortAggregate" in line]
    assert final and all(line.count("collect_list(") + line.count("collect_set(") <= 1 for line in final)
