from pyspark.sql import functions as F

from tallgrass.operators import decisions, profile, reference, rules, scorecard
from tallgrass.operators.ir import Bool, Comparison, Rule

C = Comparison
MATKL = Rule("R1", "mara", "not_null", C("MATKL", "is_not_null"), severity="High")
MEINS = Rule("R2", "mara", "domain_in", C("MEINS", "in", ["EA", "KG", "ST"]), domain=("EA", "KG", "ST"))
CROSS = Rule("R3", "mara", "cross_field", Bool("implies", [C("MTART", "eq", "HALB"), C("MATKL", "ne", "L003")]), name="no L003")


def tiny(spark):
    return spark.createDataFrame([("100", "FERT", "L001", "EA"), ("101", "FERT", None, "KG"), ("102", "HALB", "L002", "ZZ"), ("103", "HALB", "L003", "EA")], "MATNR string, MTART string, MATKL string, MEINS string")


def test_findings_of_one_scan(spark):
    got = rules.run_rules(tiny(spark), "mara", ["MATNR"], [MATKL, MEINS, CROSS, MATKL])
    by = {}
    for r in got.collect():
        by.setdefault(r["rule_id"], []).append(r)
    assert {k: [r["record_id"] for r in v] for k, v in by.items()} == {"R1": ["MATNR=101"] * 2, "R2": ["MATNR=102"], "R3": ["MATNR=103"]}
    r2, r3 = by["R2"][0], by["R3"][0]
    assert r2["issue"] == "MEINS='ZZ' is outside the permitted domain" and r2["expected"] == ["EA", "KG", "ST"] and r2["observed_value"] == "ZZ"
    assert by["R1"][0]["issue"] == "mandatory field MATKL is empty" and by["R1"][0]["expected"] == ["non-null"]
    assert r3["field"] == "MTART,MATKL" and r3["observed_value"] is None and r3["metadata"] == {"MTART": "HALB", "MATKL": "L003"}
    assert r3["issue"] == "cross-field rule 'no L003' not satisfied" and r3["dimension"] == "Consistency"


def test_one_scan_of_only_the_needed_columns(spark, small, capsys):
    df = spark.read.parquet(f"{small}/mara.parquet")
    rules.run_rules(df, "mara", ["matnr"], [Rule("A", "mara", "not_null", C("matkl", "is_not_null")), Rule("B", "mara", "not_null", C("spart", "is_not_null"))]).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<matnr:string,matkl:string,spart:string>" in plan


def test_missing_fields_empty_tables_and_null_keys(spark):
    gone = Rule("R4", "mara", "not_null", C("NOPE", "is_not_null"))
    assert rules.run_rules(tiny(spark), "mara", ["MATNR"], [gone]).count() == 0
    assert rules.run_rules(tiny(spark).limit(0), "mara", ["MATNR"], [MATKL]).count() == 0
    keyed = tiny(spark).withColumn("MATNR", F.lit(None).cast("string"))
    assert rules.run_rules(keyed, "mara", ["MATNR"], [MATKL]).first()["record_id"] == "MATNR=None"
    assert rules.run_ruleset({"mara": tiny(spark)}, {"mara": ["MATNR"]}, [MATKL, Rule("X", "marc", "not_null", C("A", "is_null"))]).count() == 1


def test_scorecard_and_top_fields(spark):
    found = rules.run_rules(tiny(spark), "mara", ["MATNR"], [MATKL, MEINS, MATKL])
    got = {r["dimension"]: r for r in scorecard.scorecard(found, 4, own={"Uniqueness": (0, 4)}).collect()}
    assert got["Completeness"]["n_findings"] == 2 and got["Completeness"]["affected"] == 1 and got["Completeness"]["score"] == 75.0
    assert got["Uniqueness"]["score"] == 100.0 and got["Uniqueness"]["excluded"] == 4 and got["Consistency"]["n_findings"] == 0
    assert scorecard.overall(scorecard.scorecard(found, 4)).first()[0] == (75 + 75 + 100 + 100) / 4
    assert scorecard.top_fields(found, 1).first()["label"] == "mara.MATKL (Completeness)"


def test_precision_and_recall(spark):
    found = spark.createDataFrame([("V", "r", "a"), ("V", "r", "b"), ("V", "r", "b")], "dimension string, rule_id string, record_id string")
    labels = spark.createDataFrame([("V", "r", "a"), ("V", "r", "c"), ("C", "q", "z")], "dimension string, rule_id string, record_id string")
    got = {r["dimension"]: r for r in scorecard.precision_recall(found, labels).collect()}
    assert (got["V"]["tp"], got["V"]["fp"], got["V"]["fn"], got["V"]["f1"]) == (1, 1, 1, 0.5)
    assert (got["C"]["precision"], got["C"]["recall"], got["C"]["f1"]) == (1.0, 0.0, 0.0)


def test_twins_decoys_and_joins(spark):
    members = spark.createDataFrame([("a", "C1"), ("b", "C1"), ("c", "C1"), ("d", "C2")], "member string, cluster_id string")
    twins = spark.createDataFrame([("b", "a", "upper"), ("d", "a", "swap"), ("x", "a", "swap")], "twin string, source string, strategy string")
    records = spark.createDataFrame([("a", "H"), ("b", "H"), ("d", "H"), ("x", "Z")], "k string, t string")
    got = scorecard.twin_recall(twins, members, records, "k", ["t"]).first()
    assert (got["n_twins"], got["n_matchable"], got["found"], got["recall"], got["matchable_recall"]) == (3, 2, 1, 1 / 3, 0.5)
    assert scorecard.twin_recall(twins, members, records, "k", ["t"], ["strategy"]).count() == 2
    decoys = spark.createDataFrame([("k1", "a", "b"), ("k1", "a", "d")], "kind string, left_id string, right_id string")
    assert scorecard.decoy_errors(decoys, members).first()["error_rate"] == 0.5
    u = {r["cluster_id"]: r["unlabelled"] for r in scorecard.unlabelled_joins(members, decoys).collect()}
    assert u == {"C1": 2, "C2": 0}


def test_profile_and_keys(spark):
    df = spark.createDataFrame([("1", "x", None, "7"), ("2", "x", None, "8"), ("3", "x", "", "99")], "k string, c string, e string, n string")
    got = {r["field_name"]: r for r in profile.profile(df, categories=2).collect()}
    assert [got[f]["type_hint"] for f in "kcen"] == ["key", "constant", "constant", "key"]
    assert got["e"]["populated_count"] == 1 and got["e"]["populated_pct"] == 33.33 and got["e"]["max_length"] == 0
    empty = {r["field_name"]: r for r in profile.profile(df.limit(0)).collect()}
    assert len(empty) == 4 and empty["k"]["n_rows"] == 0 and empty["k"]["type_hint"] == "constant"
    assert profile.top_values(df, ["c"]).first()["n"] == 3
    u = profile.key_uniqueness(df.unionAll(df.limit(1)), ["k"]).first()
    assert (u["n_rows"], u["distinct_keys"], u["rows_sharing_a_key"], u["is_unique"], u["examples"]) == (4, 3, 2, False, ["k=1"])
    null = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "a string, b string")
    assert profile.key_uniqueness(null, ["a", "b"]).first()["distinct_keys"] == 2
    assert profile.key_uniqueness(null, ["zz"]).first()["assessable"] is False
    two = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")], "x string, y string")
    assert profile.key_candidates(two) == [("x", "y")]


def test_reference_lists(spark):
    t = spark.createDataFrame([("1000", "100"), ("1000", "101"), ("2000", " 200 "), ("2000", None)], "w string, d string")
    listed = reference.entries(t, "T024D", "d", "w")
    df = spark.createDataFrame([("1000", "100"), ("2000", "100"), ("2000", "200"), ("1000", None), ("1000", "")], "w string, d string")
    got = [r["is_member"] for r in reference.mark_members(df, listed, "d", F.col("w")).orderBy("w", F.desc_nulls_last("d")).collect()]
    assert got == [True, None, None, True, False]
    rate = reference.match_rate(df, listed, "d", F.col("w")).first()
    assert (rate["n_values"], rate["n_matched"], rate["match_rate"]) == (3, 2, 2 / 3)
    assert reference.match_rate(df, listed, "d", loaded=False).first()["match_rate"] is None
    assert reference.match_rate(df.limit(0), listed, "d").first()["match_rate"] == 0.0


def test_advisories_verdicts_and_actions(spark):
    import pytest

    df = tiny(spark)
    assert [r["target"] for r in decisions.sparse_fields(df, "mara", ["MATKL", "MEINS"]).collect()] == ["mara.MATKL"]
    assert decisions.sparse_fields(df.limit(0), "mara", ["MATKL"]).count() == 0
    found = rules.run_rules(df, "mara", ["MATNR"], [MATKL, MEINS])
    assert [r["target"] for r in decisions.failing_fields(found).collect()] == ["mara.MEINS"]
    assert [r[0] for r in decisions.excluded_records(found, ["mara.MEINS"]).collect()] == ["MATNR=102"]
    A = decisions.Advisory
    assert decisions.resolve([A("a", "raise_threshold", 0.05), A("b", "raise_threshold", 0.03), A("m", "exclude_records")]) == (0.05, ["m"])
    with pytest.raises(ValueError):
        A("a", "raise_threshold")
    with pytest.raises(ValueError):
        A("a", "shout")
    pairs = spark.createDataFrame([("k1", 0.88), ("k2", 0.91), ("k3", 0.81)], "pair_key string, score double")
    none = spark.createDataFrame([], "pair_key string, decision string, confidence double, rationale string, fingerprint string")
    first = decisions.judge(pairs, none, lambda r: ("duplicate", 0.9, "same"), "f1", cap=1)
    assert [r["pair_key"] for r in first.collect()] == ["k2"]
    both = decisions.judge(pairs, first, lambda r: ("not_duplicate", 0.8, ""), "f1", cap=1)
    assert sorted(r["pair_key"] for r in both.collect()) == ["k1", "k2"]
    assert decisions.apply_verdicts(pairs, both, "f1").where("is_open").count() == 1
    assert decisions.apply_verdicts(pairs, both, "f2").where("is_open").count() == 3
    many = spark.createDataFrame([("Completeness", "mara", "MTART", "R", f"r{i}", "Critical") for i in range(10)] + [("Validity", "mara", "MATKL", "S", f"r{i}", "Low") for i in range(15)], "dimension string, table_name string, field string, rule_id string, record_id string, severity string")
    plan = decisions.actions(many, ["mara.MATKL"])
    assert [(r["field"], r["affected"], r["priority"]) for r in plan.orderBy("place").collect()] == [("MTART", 10, 40.0), ("MATKL", 15, 22.5)]
    texts = plan.select("group_id", F.when(F.col("place") == 1, F.col("affected")).otherwise(1).alias("affected"), F.lit("t").alias("text"))
    assert [r["text"] for r in decisions.attach_narrative(plan, texts).orderBy("place").collect()] == ["t", None]
