import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import clusterview, decisions, encode, matching, reference, ruleimport, rulebank, rules, scorecard
from tallgrass.operators import profile as profiles
from tallgrass.operators import schema as schemas
from tallgrass.operators.ir import Comparison, Rule
from tallgrass.operators.matching import Matching
from tallgrass.plans.numbering import numbered
from tallgrass.sources import datasets

RAW = {
    "table": "MARA", "primary_key": ["MATNR"], "formatting": {"null_date_sentinels": ["00/00/0000"]},
    "uniqueness": {"blocking_keys": ["MTART", "MEINS"], "compare_fields": ["MAKT.MAKTX", {"field": "WRKST", "weight": 3}], "methods": {"fuzzy": {"metric": "token_sort_ratio", "weight": 0.5}, "semantic": {"weight": 0.5}},
                   "bands": {"duplicate": 0.92, "review_low": 0.8}, "max_block_pairs": 20_000_000, "attribute_veto": {"enabled": True, "cap": 0.75, "material_words": ["steel"]}},
    "fields": {"MATNR": {"type": "key", "role": "key", "mandatory": True}, "MTART": {"type": "code", "domain": ["A", "B"], "mandatory": True}, "MEINS": {"type": "code"}, "ERSDA": {"type": "date"}, "NTGEW": {"type": "quantity"}, "WRKST": {}},
}


def test_schema_round_trip_and_checks(tmp_path):
    s = schemas.schema(RAW)
    assert s.uniqueness.shares() == {"MAKT.MAKTX": 0.25, "WRKST": 0.75} and s.uniqueness.settings.block == ("MTART", "MEINS") and s.mandatory == ["MATNR", "MTART"]
    schemas.save_schema(s, tmp_path / "mara.yaml")
    assert schemas.load_schemas(tmp_path)["MARA"] == s == schemas.load_schemas(tmp_path, ["MARA"])["MARA"]
    with pytest.raises(FileNotFoundError):
        schemas.load_schemas(tmp_path, ["MARC"])
    assert schemas.resolve_compared("MARA", "MAKT.MAKTX") == ("MAKT", "MAKTX") and schemas.resolve_compared("MARA", "WRKST") == ("MARA", "WRKST")
    for change in ({"blocking_key": "MTART"}, {"compare_fields": [{"field": "X", "weight": 0}]}, {"bands": {"duplicate": 0.7, "review_low": 0.8}}, {"methods": {"fuzzy": {"metric": "soundex"}}}, {"attribute_veto": {"cap": 2}}):
        with pytest.raises(ValueError):
            schemas.schema(RAW | {"uniqueness": RAW["uniqueness"] | change})
    for fields in ({"MATNR": {"type": "number"}}, {"MTART": {}}):
        with pytest.raises(ValueError):
            schemas.schema(RAW | {"fields": fields})


def test_schema_on_data(spark, small):
    s = schemas.schema(RAW)
    df = spark.createDataFrame([("1", "A", "1.000,500", "1/4/2020"), ("2", "B", "x", "00/00/0000"), ("3", None, None, " ")], "MATNR string, MTART string, NTGEW string, ERSDA string")
    typed = s.typed(df).collect()
    assert [r["NTGEW"] for r in typed] == [1000.5, None, None] and str(typed[0]["ERSDA"]) == "2020-01-04" and typed[1]["ERSDA"] is None and typed[0]["MATNR"] == "1"
    assert [r[0] for r in df.select(s.missing("ERSDA")).collect()] == [False, True, True]
    built = schemas.build(df, schemas.Schema("t", ("MATNR",), (schemas.Field("MATNR", "key"), schemas.Field("MTART", "code"))))
    assert built.domain("MTART") == ("A", "B") and built.field("MTART").populated_pct == 66.67
    declared = schemas.from_spec(spark.read.parquet(f"{small}/field_spec.parquet"), {"marc": ["matnr", "werks"]})
    assert sum(len(x.fields) for x in declared.values()) == 57 and declared["marc"].key == ("matnr", "werks")
    assert schemas.catalogue(spark, declared.values()).where("is_key").count() == 2


def test_scaffold_and_keys(spark):
    df = spark.createDataFrame([("E1", "E", "Pump", "x", None), ("E1", "D", "Pumpe", "x", "z"), ("E2", "E", "Valve", "x", None), ("E2", "D", "Ventil", "x", None)], "EQUNR string, SPRAS string, EQKTX string, MANDT string, KZLTX string")
    s = schemas.scaffold(df, "EQKT")
    assert s.key == ("EQUNR", "SPRAS") and not s.field("KZLTX").mandatory and s.field("MANDT").type == "code" and s.field("EQUNR").type == "key"
    assert schemas.rank_keys([("c",), ("a", "b"), ("b",)], ["a", "b", "c"]) == [("b",), ("a", "b"), ("c",)]
    many = spark.range(2000).select(F.floor(F.col("id") / 40).alias("a"), (F.col("id") % 40).alias("b"), (F.col("id") % 7).alias("c"), F.lit(1).alias("d"))
    assert profiles.key_candidates(many) == [("a", "b")]


def row(**cells):
    out = [None] * 27
    for name, value in cells.items():
        out[ruleimport.COLUMNS[name]] = value
    return out


def test_rule_import(spark, tmp_path):
    rows = ruleimport.workbook_rows([
        row(name="R1", table="MARA", field="MATNR", expression="$P_I_MATNR IS NOT NULL", label="Completeness"), row(name="R2", table="MARA", field="MEINS", expression="$P_I_MEINS IN ('EA','KG')"), row(new_name="R3", table="MARA", field="MTART", lookup="T134", expression="x"),
        row(name="R4", table="MARA", field="MATKL", expression="$P_I_MATKL IS NOT NULL"), row(name="R5", table="MARA", field="MEINS", lookup="T006", expression="x"), row(name="R6", table="MARA", field="MTART, MEINS", expression="$P_I_A IN ('1')"),
        row(name="R7", table="MARA", field="MEINS", expression="$P_I_A = $P_I_B"), row(name="R8", table="MARC", field="WERKS", expression="$P_I_W IS NOT NULL"), row(table="MARA", field="MEINS", expression="match_regex(x)"), [],
    ])
    got = ruleimport.import_rules(spark, rows, {"MARA": schemas.schema(RAW)})
    assert [(r.rule_id, r.severity, r.executable) for r in got.rules] == [
        ("IS_MARA_MATNR_NOT_NULL", "High", True), ("IS_MARA_MEINS_DOMAIN_IN", "Medium", True), ("IS_MARA_MTART_REFERENCE_EXISTS", "Medium", True), ("IS_MARA_MATKL_NOT_NULL", "Medium", False), ("IS_MARA_MEINS_REFERENCE_EXISTS", "Medium", False)]
    assert got.rules[2].domain == ("A", "B") and len(got.notes) == 2 and [d["name"] for d in got.deferred] == ["R6", "R7", "UNNAMED_RULE"]
    report = {(r["archetype"], r["dimension"]): (r["imported"], r["dormant"]) for r in ruleimport.import_report(spark, got).collect()}
    assert report == {("not_null", "Completeness"): (2, 1), ("domain_in", "Validity"): (1, 0), ("reference_exists", "Validity"): (2, 1)}
    ruleimport.save_rules(got, tmp_path)
    from tallgrass.operators.ir import load_rules

    assert [r.rule_id for r in load_rules(tmp_path)] == [r.rule_id for r in got.rules] and json.loads((tmp_path / "_import_report.json").read_text())["imported"] == 5
    assert [ruleimport.single_field(x) for x in ("A", " A,\n", "A B", "", None)] == ["A", "A", None, None, None]
    assert [ruleimport.dimension_of(*x) for x in ((None, "not_null"), ("Consistency", "other"), ("?", "other"))] == ["Completeness", "Validity", "Validity"]


def test_rule_bank_from_files(spark, tmp_path):
    (tmp_path / "field_roles.yaml").write_text("roles: [uom, group]")
    (tmp_path / "a.yaml").write_text("templates:\n- {template_id: T1, target_table: mara, field_role: uom, strength: strong, reference_match_min: 0.9}\n- {template_id: T2, target_field: matkl}\n")
    templates, roles = ruleimport.load_bank(spark, tmp_path)
    assert roles == ["group", "uom"] and [(r["template_id"], r["target_table"], r["strength"]) for r in templates.orderBy("template_id").collect()] == [("T1", "mara", "strong"), ("T2", "ANY", "weak")]
    for bad in ("strength: great", "population_min: 2", "field_role: colour"):
        (tmp_path / "b.yaml").write_text(f"templates:\n- {{template_id: T3, {bad}}}\n")
        with pytest.raises(ValueError):
            ruleimport.load_bank(spark, tmp_path)


def test_suggestions(spark):
    df = spark.createDataFrame([("EA", "A"), ("ea ", "B"), ("ZZ", None), ("", "A")], "meins string, mtart string")
    listed = reference.entries(spark.createDataFrame([("EA",), ("KG",)], "v string"), "T006", "v")
    proof = {r["field_name"]: (r["n_values"], r["n_matched"], r["reference_match_rate"]) for r in rulebank.reference_evidence(df, listed, {"meins": "T006", "mtart": "T134"}).collect()}
    assert proof["meins"][:2] == (3, 2) and round(proof["meins"][2], 3) == 0.667 and proof["mtart"] == (3, 0, None)
    seen = spark.createDataFrame([("t", "meins", ["?"], 1.0, None, 3, None, 3, 4), ("t", "mtart", ["?"], 1.0, 0.5, 3, None, 3, 4)], rulebank.OBSERVATION)
    with_rates = rulebank.with_evidence(seen, rulebank.reference_evidence(df, listed, {"meins": "T006"}))
    assert {r["field_name"]: r["reference_match_rate"] and round(r["reference_match_rate"], 2) for r in with_rates.collect()} == {"meins": 0.67, "mtart": 0.5}
    named = rulebank.interpret(seen, lambda o: ["uom", "odd"] if o["field_name"] == "meins" else ["odd"], ["uom"])
    assert {r["field_name"]: r["role_candidates"] for r in named.collect()} == {"meins": ["uom"], "mtart": ["unknown"]}
    r = rulebank.assemble_rule({"template_id": "T", "archetype": "domain_in"}, "t", "meins", ["EA"])
    assert r.executable and r.domain == ("EA",) and not rulebank.assemble_rule({"template_id": "T", "archetype": "reference_exists"}, "t", "meins").executable
    with pytest.raises(ValueError):
        rulebank.assemble_rule({"template_id": "T", "archetype": "cross_field"}, "t", "meins")


def test_reference_manifest(spark, tmp_path):
    (tmp_path / "manifest.yaml").write_text("tables:\n- {name: T006, file: t006.csv, value_field: msehi, status: loaded, as_of: '2026-01-01'}\n- {name: T024D, file: t024d.csv, value_field: dispo, scope_field: werks, status: loaded}\n- {name: T023, value_field: matkl, status: pending_extract}\n- {name: T134, file: none.csv, value_field: x, status: loaded}\n")
    (tmp_path / "t006.csv").write_text("msehi\nST\nkg\n")
    (tmp_path / "t024d.csv").write_text("werks,dispo\n1000,100\n1000,101\n2000,200\n")
    read = lambda f: spark.read.option("header", True).csv(f"{tmp_path}/{f}")
    listed, manifest = reference.load_store(spark, reference.load_manifest(tmp_path / "manifest.yaml"), read)
    assert {r["table_name"]: r["status"] for r in manifest.collect()} == {"T006": "loaded", "T024D": "loaded", "T023": "pending_extract", "T134": "pending_extract"}
    assert listed.where("table_name = 'T024D' and scope_key = '1000'").count() == 2 and listed.where("value = 'KG'").count() == 1
    assert {r["table_name"] for r in reference.pending(manifest).collect()} == {"T023", "T134", "T024D"}
    assert reference.load_store(spark, [], read)[0].count() == 0


M = Matching(block=("t", "u"), metric="jaro_winkler", duplicate=0.85, review_low=0.70)


def matched(spark, *texts, m=M):
    df = spark.createDataFrame([(chr(65 + i), "HALB", "EA", x) for i, x in enumerate(texts)], "k string, t string, u string, text string")
    found = matching.candidates(df, "k", "text", m)
    return found, matching.banded(matching.class_pairs(found, m), m)


def test_chain_members_below_the_band(spark):
    found, bands = matched(spark, "Hex Bolt M8 Stainless Steel", "Hex Bolt M8 Stainless", "Bolt M8 Stainless")
    members = matching.clusters(found, bands, copies=True)
    filled = spark.createDataFrame([("A", 3, 9), ("B", 3, 8), ("C", 3, 7)], "member string, n_mandatory int, n_total int")
    kept = matching.survivors(members, filled, found)
    rows = {r["member"]: r for r in clusterview.listing(members, kept, found, filled, M).collect()}
    assert [rows[x]["is_survivor"] for x in "ABC"] == [True, False, False] and rows["A"]["score"] == 1.0 and rows["A"]["place"] == 0
    assert not rows["B"]["below_band"] and rows["C"]["below_band"] and rows["C"]["place"] > rows["B"]["place"] > 1 and rows["C"]["text"] == "Bolt M8 Stainless"
    weakest = matching.weakest_links(members, found, M)
    one = clusterview.overview(members, kept, weakest, "mara").collect()
    assert len(one) == 1 and (one[0]["cluster_id"], one[0]["n_records"], one[0]["survivor"], one[0]["block"], one[0]["resolution"]) == ("CL-0001", 3, "A", "HALB/EA", "automatic") and one[0]["weakest_link"] < 0.85
    assert clusterview.largest(clusterview.overview(members, kept, weakest, "mara")).count() == 1


def test_classes_say_the_same_as_pairs(spark, small):
    from tallgrass.queries import quality

    found = quality._candidates(spark, small)
    full = matching.banded(matching.score_pairs(found, quality.SETTINGS), quality.SETTINGS)
    slim = matching.banded(matching.class_pairs(found, quality.SETTINGS), quality.SETTINGS)
    assert matching.score_spread(found, full).exceptAll(matching.score_spread(found, slim)).count() == 0
    a, b = matching.clusters(found, full), matching.clusters(found, slim, copies=True)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    copies = matched(spark, "x y", "X  Y", "x-y", "q")[1].collect()
    assert [(r["left_id"], r["right_id"], r["n_pairs"], r["band"]) for r in copies] == [("A", "C", 3, "duplicate")]


def test_uncertain_pairs_and_notes(spark):
    found, bands = matched(spark, "Hex Bolt M8 Stainless Steel", "Bolt M8 Stainless", None, m=Matching(block=("t", "u"), duplicate=0.92, review_low=0.70))
    pairs = clusterview.uncertain(bands, found).collect()
    assert [(r["left_id"], r["right_id"], r["left_text"], r["block"]) for r in pairs] == [("A", "B", "Hex Bolt M8 Stainless Steel", "HALB/EA")]
    assert all(r["meaning"] for r in clusterview.spread(matching.score_spread(found, bands)).collect())
    rows = {r["setting"]: r["in_force"] for r in clusterview.settings(spark, M, 0.05, {"MAKT.MAKTX": 1.0}).collect()}
    assert rows["duplicate band"] == "0.9" and rows["review band from"] == "0.75" and rows["most pairs of a block"] == "no limit" and rows["compared field MAKT.MAKTX"] == "1"
    assert clusterview.mode_note("full")[0] == "ok" and "why" in clusterview.mode_note("fuzzy_only", "why")[1] and clusterview.mode_note(None)[0] == "warn"
    assert clusterview.approval_note([]).startswith("No table") and "mara" in clusterview.approval_note([Rule("a", "mara", "other", Comparison("x", "is_null"))])
    assert "0.05" in clusterview.advisory_note(0.05, ["t.f"]) and clusterview.advisory_note(0, []).startswith("No advisory")


def test_verdicts(spark, tmp_path):
    pairs = spark.createDataFrame([("p1", "A", "B", 0.88), ("p2", "C", "D", 0.91), ("p3", "E", "F", 0.81), ("p4", "G", "H", 0.85)], "pair_key string, left_id string, right_id string, score double")
    (tmp_path / "v.json").write_text("\n".join(json.dumps({"pair_key": k, "decision": d, "confidence": c, "rationale": "said", "fingerprint": f}) for k, d, c, f in [("p1", "duplicate", 0.9, "now"), ("p2", "not_duplicate", 0.8, "now"), ("p3", "duplicate", 0.7, "then")]) + "\nnot json")
    verdicts = decisions.load_verdicts(spark, str(tmp_path / "v.json"))
    assert verdicts.count() == 3 and decisions.load_verdicts(spark, str(tmp_path / "none.json")).count() == 0
    judged = decisions.apply_verdicts(pairs, verdicts, "now")
    assert {r["pair_key"]: (r["decision"], r["is_open"]) for r in judged.collect()} == {"p1": ("duplicate", False), "p2": ("not_duplicate", False), "p3": (None, True), "p4": (None, True)}
    filled = spark.createDataFrame([("A", 1, 2), ("B", 1, 3)], "member string, n_mandatory int, n_total int")
    got = decisions.verdict_clusters(judged, filled).collect()
    assert [(r["cluster_id"], r["survivor"], r["other"], r["reason"], r["confidence"]) for r in got] == [("CL-LLM-0001", "B", "A", "completeness", 0.9)]
    tied = decisions.verdict_clusters(judged, filled.limit(0)).first()
    assert (tied["survivor"], tied["reason"]) == ("A", "none")
    f = decisions.verdict_findings(decisions.verdict_clusters(judged, filled), "mara", "k").first()
    assert (f["record_id"], f["severity"], f["confidence"], f["metadata"]["source"]) == ("k=A", "Medium", 0.9, "adjudicator") and "B: said" in f["issue"]
    assert set(rules.FINDING) == set(f.asDict())
    twins = spark.createDataFrame([("B", "A")], "twin string, source string")
    decoys = spark.createDataFrame([("D", "C"), ("A", "B")], "left_id string, right_id string")
    q = scorecard.verdict_quality(judged.where("decision is not null").unionByName(judged.where("pair_key = 'p4'").withColumn("decision", F.lit("duplicate"))), twins, decoys).first()
    assert tuple(q) == (3, 1, 1, 1, 1, 1)


def test_plan_holds_what_was_not_compared(spark, tmp_path):
    findings = rules.run_rules(spark.createDataFrame([("1", None), ("2", None)], "k string, v string"), "mara", ["k"], [Rule("N", "mara", "not_null", Comparison("v", "is_not_null"), severity="Critical")])
    held = spark.createDataFrame([("no_description", 5), ("odd", 1)], "reason string, n_records long")
    got = [(r["place"], r["rule_id"], r["affected"], r["severity"], r["priority"]) for r in decisions.plan(findings, held, "mara", "fuzzy_only", 30).orderBy("place").collect()]
    assert got == [(1, "fuzzy_only", 30, "Medium", 60.0), (2, "no_description", 5, "High", 15.0), (3, "N", 2, "Critical", 8.0), (4, "odd", 1, "High", 3.0)]
    assert decisions.uniqueness_actions(held, "mara", "full", 0).count() == 2 and decisions.uniqueness_actions(held, "mara", "fuzzy_only", 0).count() == 3
    assert decisions.load_plan(tmp_path / "x.json") == {}
    (tmp_path / "x.json").write_text("[1]")
    assert decisions.load_plan(tmp_path / "x.json") == {}
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert decisions.load_plan(tmp_path / "x.json") == {"a": 1}


def test_advisories_by_target():
    a, b = decisions.Advisory("t.f", "raise_threshold", 0.05, "sparse"), decisions.Advisory("t.g", "exclude_records")
    assert decisions.merge([a, b], [a], [decisions.Advisory("t.f", "exclude_records")]) == {"t.f": [a, decisions.Advisory("t.f", "exclude_records")], "t.g": [b]}
    assert decisions.describe(a) == "t.f: raise the bands by 0.05 (sparse)" and "hold back" in decisions.describe(b)


def test_encoding(spark, tmp_path):
    df = spark.createDataFrame([("1", "Hex Bolt"), ("2", "hex - BOLT"), ("3", None), ("4", "Nut")], "k string, t string")
    v = encode.encode_texts(df, "k", "t", encode.hashing_encoder(16), batch=2)
    rows = {r["key"]: r["vector"] for r in v.collect()}
    assert sorted(rows) == ["1", "2", "4"] and rows["1"] == rows["2"] != rows["4"] and all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in rows.values())
    with pytest.raises(Exception, match="encoder returned"):
        encode.encode_texts(df, "k", "t", lambda texts: np.zeros((1, 2, 3))).collect()
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(encode.unit_length(F.col("v"))).collect()
    assert zero[0][0] == [0.0, 0.0] and np.allclose(zero[1][0], [0.6, 0.8])
    code = encode.identity_code("hash", 16)
    assert code != encode.identity_code("hash", 32)
    texts = df.where("k <> '3'").select(F.col("k").alias("key"), F.col("t").alias("norm"))
    datasets.save_vectors(v, str(tmp_path / "v"), code, matching.content_code(texts, "key", "norm").first()["code"])
    got, why = encode.verified_vectors([(str(tmp_path / "v"), texts)], code)
    assert len(got) == 1 and why == ""
    assert encode.verified_vectors([(str(tmp_path / "v"), texts), (str(tmp_path / "w"), texts)], code) == ([], f"no vectors at {tmp_path}/w")
    assert encode.verified_vectors([(str(tmp_path / "v"), texts.limit(1))], code)[1].endswith("out of date")


def test_numbers_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit("y").alias("number2"))
    got = {r["x"]: r["number"] for r in numbered(df.repartition(5), "x").collect()}
    assert got == {i: i + 1 for i in range(500)} and numbered(df.limit(0), "x").count() == 0


def test_encoders_are_compared(spark):
    df = spark.createDataFrame([("1", "hex bolt steel"), ("2", "bolt hex steel"), ("3", "rubber seal")], "k string, t string")
    got = encode.benchmark(df, "k", "t", spark.createDataFrame([("2", "1")], "twin string, source string"), spark.createDataFrame([("1", "3")], "left_id string, right_id string"), {"w8": encode.hashing_encoder(8), "w64": encode.hashing_encoder(64)})
    rows = {(r["encoder"], r["kind"]): r["mean_cosine"] for r in got.collect()}
    assert len(rows) == 4 and rows["w64", "twin"] > rows["w64", "decoy"]


def test_vector_pairs_of_a_hot_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "a" if i % 5 else "b", rng.normal(size=3).tolist()) for i in range(60)] + [(99, None, [1.0, 0.0, 0.0]), (98, "a", None)]
    df = spark.createDataFrame(rows, "id long, b string, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, b, v in rows if b and v}
    want = {(i, j) for i, b, v in rows for j, c, w in rows if i < j and b and b == c and v and w and unit[i] @ unit[j] >= 0.5}
    monkeypatch.setattr(matching, "CHUNK", 4)
    got = [(r["left_id"], r["right_id"]) for r in matching.vector_pairs(df, "b", "id", "v", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_judge_is_held_to_its_contract(spark):
    pairs = spark.createDataFrame([("p", "A", "B", 0.9)], "pair_key string, left_id string, right_id string, score double")
    none = spark.createDataFrame([], "pair_key string, decision string, confidence double, rationale string, fingerprint string")
    assert decisions.judge(pairs, none, lambda p: decisions.Verdict("duplicate", 0.9, "x"), "f").first()["decision"] == "duplicate"
    for bad in (("maybe", 0.5, ""), ("duplicate", 1.5, "")):
        with pytest.raises(ValueError):
            decisions.judge(pairs, none, lambda p, bad=bad: bad, "f")
    rs = [Rule("a", "t", "not_null", Comparison("x", "is_not_null")), Rule("b", "t", "not_null", Comparison("x", "is_not_null"), executable=False), Rule("c", "t", "domain_in", Comparison("x", "in", ["1"]))]
    assert [r.rule_id for r in rules.select_rules(rs, "Completeness")] == ["a"]


def test_unknown_comparisons_and_subject_keys(spark):
    from tallgrass.operators.ir import predicate
    from tallgrass.operators.ir import rule as read

    with pytest.raises(ValueError):
        predicate({"field": "x", "op": "sounds_like", "value": 1})
    odd = read({"rule_id": "O", "table": "t", "assertion": {"op": "or", "args": [{"field": "x", "op": "sounds_like"}, {"field": "x", "op": "eq", "value": "1"}]}}, strict=False)
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "x string, k string")
    assert rules.run_rules(df, "t", ["k"], [odd]).count() == 0
    keys = spark.createDataFrame([("MATNR=1|WERKS=A",), ("WERKS=A",)], "r string").select(rules.subject_key(F.col("r"), ["MATNR"])).collect()
    assert [r[0] for r in keys] == ["MATNR=1", "WERKS=A"]


def test_wordings_of_a_plan(spark):
    plan = spark.createDataFrame([("Completeness", "t", "f", "R", 3, "High"), ("Uniqueness", "t", "", "", 2, "High")], "dimension string, table_name string, field string, rule_id string, affected long, severity string")
    got = clusterview.worded(plan).collect()
    assert got[0]["action"] == "Fill f in the 3 affected records." and got[0]["rationale"] == "3 records; worst severity High; rule R" and "duplicates" in got[1]["action"] and "rule" not in got[1]["rationale"]
    rs = [Rule("a", "mara", "other", Comparison("x", "is_null")), Rule("b", "makt", "other", Comparison("x", "is_null"), executable=False)]
    assert "makt" in clusterview.no_checks_warning(["mara", "makt"], rs) and clusterview.no_checks_warning(["mara"], rs) == ""
    found, _ = matched(spark, "a", "b", "c", m=Matching(block=("t", "u"), most_block_pairs=2))
    assert [tuple(r) for r in clusterview.oversized(found).collect()] == [("HALB/EA", 3, 3)]
