import datetime as dt

import pytest
from pyspark.sql.types import StructType

from lodestone import schemas
from lodestone.operators import projection
from lodestone.plans import pipeline


def test_project_fits_types_and_fills_what_is_missing(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 1, 'y', 'q') AS s, array(named_struct('u', 'v', 'w', 2), NULL) AS l, map('k', 1) AS m, 2.5D AS d, NULL AS n, date'2024-01-02' AS t, 7L AS big")
    out = projection.project(df, "a bigint, s struct<x:bigint,z:string>, l array<struct<w:double,u:string>>, m string, d string, n array<string>, t timestamp, e int, big int", {"e": "a + 1"})
    assert out.schema == StructType.fromDDL("a bigint, s struct<x:bigint,z:string>, l array<struct<w:double,u:string>>, m string, d string, n array<string>, t timestamp, e int, big int") or out.schema.simpleString() == "struct<a:bigint,s:struct<x:bigint,z:string>,l:array<struct<w:double,u:string>>,m:string,d:string,n:array<string>,t:timestamp,e:int,big:int>"
    r = out.first()
    assert (r["a"], r["s"]["x"], r["s"]["z"], r["m"], r["d"], r["n"], r["e"], r["big"]) == (1, 1, None, '{"k":1}', "2.5", None, 2, 7)
    assert r["l"][0]["w"] == 2.0 and r["l"][0]["u"] == "v" and r["l"][1] is None and r["t"] == dt.datetime(2024, 1, 2)


@pytest.mark.parametrize("have,want", [("'x' AS a", "a int"), ("array(1) AS a", "a struct<x:int>"), ("1.5D AS a", "a bigint"), ("array('p') AS a", "a array<int>"), ("named_struct('x', 'p') AS a", "a struct<x:double>")])
def test_project_names_what_doesnt_fit(spark, have, want):
    with pytest.raises(ValueError, match="^a"):
        projection.project(spark.sql(f"SELECT {have}"), want)
    with pytest.raises(ValueError, match="not in the schema: zz"):
        projection.project(spark.range(1), "id bigint", {"zz": "1"})


def test_violations(spark):
    rows = spark.createDataFrame([(1, "low"), (None, "low"), (2, "odd"), (None, None)], "k int, level string")
    got = {(r["k"], r["level"]): r["broken"] for r in projection.violations(rows, ["k"], {"level": ["low", "high"], "other": ["x"]}).collect()}
    assert got == {(None, "low"): ["k"], (2, "odd"): ["level"], (None, None): ["k"]}


def test_whole_rows_of_a_page(spark):
    html = '<html lang="es"><head><title>Clinica Sol | Madrid</title><meta name="description" content="Clinica dental en Madrid"></head><body>Servicios y precios. <a href="/contacto">Contacto</a><a href="mailto:info@clinicasol.es">m</a><a href="https://instagram.com/clinicasol">ig</a></body></html>'
    pages = spark.createDataFrame([(1, "https://clinicasol.es/", html)], "page_id bigint, url string, html string")
    out = pipeline.sinks(pipeline.prospects(pages, {"target_niche": "clinica dental", "target_location": "Madrid", "target_language": "es"}), dt.datetime(2024, 1, 1))
    columns = lambda ddl: [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl)]
    names = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
    assert names(out["job_prospects"]) == columns(schemas.JOB_PROSPECTS)
    assert names(out["prospects"]) == [("prospect_id" if n == "id" else n, t) for n, t in columns(schemas.PROSPECTS)]
    job = out["job_prospects"].first()
    import json

    evidence, raw = json.loads(job["evidence"]), json.loads(job["raw_extraction"])
    assert list(evidence) == pipeline.EVIDENCE_FIELDS and list(raw) == pipeline.EXTRACTION_FIELDS
    assert evidence["canonical_identity"] == "clinicasol.es" and evidence["emails"] == ["info@clinicasol.es"] and evidence["source_type"] is None
    assert raw["observed_signals"] == (job["observed_signals"] or []) and job["processing_status"] == "processed" and 0 <= job["match_score"] <= 1
    assert out["prospects"].first()["email"] == "info@clinicasol.es"
    assert projection.violations(out["job_prospects"], ["prospect_id", "processing_status"], schemas.ENUMS).count() == 0


# prompts


def test_prompt_of_a_job(spark):
    from lodestone.operators import prompts

    jobs = spark.createDataFrame([
        (1, " Editor ", ["reels", " ", None, "edición"], "Moda", ["vende en Instagram"], [], "x" * 50), (2, None, None, " ", [], [], None), (3, "SEO", [], "Dental", [], ["blog", "agencia"], "corto"),
    ], "id int, user_profession string, user_technologies array<string>, target_niche string, target_entity_hints array<string>, exclusion_entity_hints array<string>, evidence string")
    lines = [prompts.Line("Profesion", "user_profession"), prompts.Line("Servicios", "user_technologies", True), prompts.Line("Nicho", "target_niche", False, "General")]
    whole = prompts.template([prompts.Section("VENDEDOR", lines), prompts.entity_rules(), prompts.Section("TEXTO", [prompts.Text("evidence")], 16, "id < 3")])
    got = {r["id"]: r["p"] for r in jobs.selectExpr("id", f"{whole} AS p").collect()}
    assert got[1] == f"VENDEDOR\n- Profesion: Editor\n- Servicios: reels, edición\n- Nicho: Moda\n\n{prompts.RULES_TITLE}\n{prompts.RULES_FOR}\n- vende en Instagram\n\nTEXTO\nxxxxxxxxxx"
    assert got[2] == "VENDEDOR\n- Profesion: No especificado\n- Servicios: No especificado\n- Nicho: General"
    assert got[3] == f"VENDEDOR\n- Profesion: SEO\n- Servicios: No especificado\n- Nicho: Dental\n\n{prompts.RULES_TITLE}\n{prompts.RULES_AGAINST}\n- blog\n- agencia"
