"""Golden values and properties of the engine's operators, on small rows of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import contacts, urls
from lodestone.functions.text import fold_trimmed
from lodestone.operators import crawl, entity, extraction, features, hits, kpi, quality, scoring, synthesis, upsert
from lodestone.operators.parse import parse
from lodestone.plans import pipeline
from lodestone.sources import providers
from lodestone.sources.html import read_pages

CLINIC = """<html lang="es-AR"><head><title>Clinica X | Madrid</title><meta name="description" content="Dentista">
<script type="application/ld+json">{"@type":"Dentist","telephone":"+34 911 223 344","address":{"streetAddress":"Calle Mayor 1","addressLocality":"Madrid","postalCode":"28013","addressCountry":"ES"},"email":"info@clinica.es"}</script></head>
<body><a href="/contacto">Contacto</a><a href="mailto:Hola@clinica.es?subject=x">mail</a><a href="tel:0034911223344">tel</a><a href="https://wa.me/34600">wa</a><a href="https://instagram.com/clinicax">ig</a><a href="/reservas">Reserva</a>
<form></form><p>20-05-2023 y 123456789 o 11111111. Tel (011) 4555-1234</p><noscript>no</noscript></body></html>"""
DIRECTORY = "<title>Top 10 best directory listing</title>compare reviews <script>var a='</p>'</script>"
SOCIAL = '<title>Acme</title> link in bio servicios reels agencia clientes <a href="https://linktr.ee/acme">x</a>'
MAGAZINE = "<title>Revista y newsroom</title>magazine press"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://www.clinica.es/", CLINIC), (2, "https://instagram.com/acme.studio", SOCIAL), (3, "https://best-directory.com/listing/top-10", DIRECTORY), (4, "https://diario.test/blog/x", MAGAZINE), (5, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def prospects(pages):
    df = pipeline.prospects(pages, {"target_niche": "dental", "target_location": "España", "target_language": "es", "target_budget_signals": ["instagram activo"]})
    return {r["page_id"]: r.asDict() for r in df.collect()}


def one(spark, *expressions):
    return spark.range(1).select(*(F.expr(e).alias(f"c{i}") for i, e in enumerate(expressions))).first()


def test_metadata(pages):
    rows = {r["page_id"]: r for r in parse(read_pages(pages)).collect()}
    r = rows[1]
    assert r["phones"] == ["+34911223344", "01145551234"] and r["emails"] == ["hola@clinica.es", "info@clinica.es"]
    assert r["phone_validation_rejections"] == {"date_like": 1, "sequence_noise": 2} and r["invalid_phone_candidates_count"] == 3
    assert [(c["type"], c["source"]) for c in r["contact_channels"]] == [("phone", "structured_data"), ("email", "structured_data"), ("email", "mailto_link"), ("whatsapp", "whatsapp_link"), ("phone", "visible_text"), ("contact_form", "html_form"), ("booking", "booking_link")]
    assert r["cta_candidates"] == ["contact_form", "whatsapp", "booking"] and r["internal_links"] == ["https://www.clinica.es/contacto", "https://www.clinica.es/reservas"]
    assert "no" not in r["clean_text"].split() and r["html_lang"] == "es-ar" and r["form_detected"]
    s = rows[2]
    assert s["primary_identity_type"] == "social_profile" and s["social_profile"]["external_links"] == ["https://linktr.ee/acme"] and s["social_profiles"][0]["contact_signals"] == ["external_link"]
    assert rows[5]["clean_text"] == "" and rows[5]["contact_channels"] == []
    assert rows[3]["clean_text"] == "Top 10 best directory listing compare reviews"


def test_prospects(prospects):
    clinic, social, listing, media = (prospects[i] for i in (1, 2, 3, 4))
    assert clinic["canonical_identity"] == "clinica.es" and clinic["location"] == "28013 Madrid, España" and clinic["location_match_status"] == "match"
    assert (clinic["entity_type_detected"], clinic["is_target_entity"], clinic["taxonomy_business_type"]) == ("direct_business", True, "dental_clinic")
    assert (clinic["quality_status"], clinic["contact_consistency_status"], clinic["primary_email"]) == ("accepted", "consistent", "info@clinica.es")
    assert social["canonical_identity"] == "instagram:acme.studio"
    assert listing["acceptance_decision"] == "rejected_directory" and listing["entity_type_detected"] == "aggregator"
    assert media["entity_type_detected"] in ("media", "blog_post") and media["acceptance_decision"].startswith("rejected_")
    assert clinic["inferred_opportunities"] == ["Posible oportunidad: mejorar instrumentacion digital visible"]


def test_sinks(pages):
    tables = pipeline.sinks(pipeline.prospects(pages), "2024-01-01")
    assert {k: v.count() for k, v in tables.items()}["prospects"] == 5
    kinds = {(r["contact_type"], r["is_primary"]) for r in tables["prospect_contacts"].collect()}
    assert {("email", True), ("phone", True), ("whatsapp", False), ("form", False)} <= kinds


@pytest.mark.parametrize("raw,reason", [("+34 600 111 222", None), ("++34600111222", "invalid_plus_format"), ("123456", "invalid_length"), ("20052023", "date_like"), ("20230520", "date_like"), ("10:30 1234", "timestamp_like"), ("12k 555 12345", "metric_like"), ("1912345678", "metric_like"), ("7777777", "sequence_noise"), ("1234567", "sequence_noise"), ("9876543", "sequence_noise")])
def test_phones(spark, raw, reason):
    assert one(spark, contacts.phone_rejection(f"'{raw}'"))["c0"] == reason


def test_text_and_urls(spark):
    r = one(spark, fold_trimmed("'  Ñandú  CAFÉ ß '"), urls.domain("'https://www.Acme.com:80/x'"), urls.registered("'shop.acme.com.ar'", ["com", "net"]), urls.page_kind("'/Contact/booking'", urls.PARSED_KINDS), urls.page_kind("'/Contact/booking'", urls.CRAWL_KINDS))
    assert tuple(r) == ("nandu cafe", "acme.com:80", "acme.com.ar", "booking", "contact")


def test_hit_branches(spark):
    rows = [("https://www.acme.com/", "Acme sitio oficial", "contacto"), ("https://wix.com/x", "a", "b"), ("https://instagram.com/pepe", "t", "dm coach"), ("https://instagram.com/acme", "t", "dm coach"), ("ftp://x", "", "")]
    got = {r["url"]: r for r in hits.process(spark.createDataFrame(rows, "url string, title string, snippet string"), True).collect()}
    assert got["https://www.acme.com/"]["score"] == 1.03 and got["https://www.acme.com/"]["discovery_confidence"] == "high"
    assert got["https://wix.com/x"]["exclusion_reason"] == "blocked_domain:x.com"
    assert got["https://instagram.com/pepe"]["exclusion_reason"] == "excluded_social_post" and got["https://instagram.com/acme"]["social_profile_score"] == 0.95
    assert got["ftp://x"]["exclusion_reason"] == "invalid_url"


def test_seeds_give_way_to_official_sites(spark):
    found = hits.process(spark.createDataFrame([("https://doctoralia.es/", "Acme oficial", "contacto"), ("https://acme.com/", "Acme", "")], "url string, title string, snippet string"))
    anchors = spark.createDataFrame([("https://doctoralia.es/", 0, "https://facebook.com/a", "web"), ("https://doctoralia.es/", 1, "https://clinic.test/", "Sitio web"), ("https://doctoralia.es/", 2, "https://late.test/", "Sitio web")], "seed_url string, ordinal int, url string, label string")
    out, gone = hits.expand_seeds(found, anchors)
    rows = {r["url"]: r for r in out.collect()}
    assert set(rows) == {"https://clinic.test/", "https://acme.com/"} and rows["https://clinic.test/"]["seed_source_url"] == "https://doctoralia.es/"
    assert [r["reason"] for r in gone.collect()] == ["excluded_as_directory_seed:doctoralia"]


@pytest.mark.parametrize("ai,conf,heur,hconf,mult,cap,want", [(0.85, "high", 0.4, "medium", 1.0, None, None), (0.8, "high", 0.7, "medium", None, None, 0.785), (None, None, 0.5, "low", 0.0, 0.4, 0.4)])
def test_final_score(spark, ai, conf, heur, hconf, mult, cap, want):
    row = [("ai" if ai is not None else "heuristic", ai, conf, heur, hconf, "s", mult, cap)]
    r = scoring.final_score(spark.createDataFrame(row, "selected_method string, ai_score double, ai_confidence string, heuristic_score double, heuristic_confidence string, heuristic_summary string, score_multiplier double, score_cap double")).first()
    if want is not None:
        assert r["final_score"] == want
    else:
        assert r["ai_weight"] == 0.6 and r["agreement_band"] == "low"


def test_kpis(spark):
    trace = lambda **k: json.dumps({"status": "fallback", "selected_method": "heuristic", **k})
    rows = [(1, trace(fallback_reason="timeout", latency_ms=900)), (1, trace(fallback_reason="timeout", latency_ms=700)), (1, trace(fallback_reason="api", latency_ms=300)), (1, json.dumps({"status": "success", "selected_method": "ai", "latency_ms": 500, "prompt_tokens": 10, "estimated_cost_usd": 0.00003})), (1, json.dumps({"status": "skipped"})), (1, None)]
    r = kpi.ai_usage(spark.createDataFrame(rows, "job_id int, ai_trace string")).first()
    assert (r["attempts"], r["fallback_ratio"], r["average_latency_ms"], r["estimated_cost_usd"], r["fallback_reasons"]) == (4, 0.75, 600.0, 0.00003, {"api": 1, "timeout": 2})
    jobs = spark.createDataFrame([(1, "completed", 6, 6, 1, 1), (2, "completed", 0, 0, 0, 0)], "job_id int, status string, total_processed int, total_found int, total_failed int, total_skipped int")
    captured = spark.createDataFrame([(1, "accepted", None, "accepted_target"), (1, "rejected", "geo_mismatch", None), (1, "needs_review", None, "rejected_media")], "job_id int, quality_status string, rejection_reason string, acceptance_decision string")
    c = {r["job_id"]: r for r in kpi.capture_summary(jobs, captured).collect()}
    assert c[1]["acceptance_rate"] == 0.1667 and c[1]["candidate_dropoff_by_reason"] == {"geo_mismatch": 1, "rejected_media": 1, "processing_failed": 1, "processing_skipped": 1} and c[2]["acceptance_rate"] == 0
    commercial = spark.createDataFrame([(1, "accepted_target", None, '{"invalid_phone_candidates_count": 2}'), (1, "accepted_target", "inconsistent", '{"phone_validation_rejections": {"a": 1, "b": 1}}'), (1, "accepted_related", None, None)], "job_id int, acceptance_decision string, contact_consistency_status string, raw_extraction string")
    r = kpi.commercial_summary(commercial).first()
    assert (r["accepted_target_precision"], r["false_phone_filtered_count"], r["inconsistent_contact_count"]) == (0.6667, 4, 1)
    assert kpi.quality_filter("rejected, accepted,rejected") == ["rejected", "accepted"] and kpi.quality_filter("all") == kpi.QUALITY
    with pytest.raises(ValueError):
        kpi.quality_filter("bad")


def test_capture_prefix_equals_loop(spark):
    rng = random.Random(1)
    rows = [(j, r, rng.random() < 0.3) for j in range(40) for r in range(rng.randint(0, 15))]
    got = {(r["job_id"], r["rank"]) for r in kpi.capture_prefix(spark.createDataFrame(rows, "job_id int, rank int, ok boolean"), ["rank"], 2, 8, "ok").collect()}
    want = set()
    for j in range(40):
        accepted = processed = 0
        for job, r, ok in rows:
            if job == j and accepted < 2 and processed < 8:
                want.add((j, r))
                processed += 1
                accepted += ok
    assert got == want


def channel_loop(channels, root):
    """First-wins loop over channels, as plain Python."""
    score = {"low": 1, "medium": 2, "high": 3}
    best, email, econf, status, phone, pconf, source = -1, None, "low", "unknown", None, "low", None
    for kind, value, src in channels:
        base = {"mailto_link": "high", "visible_text": "medium"}[src]
        if kind == "email":
            domain = value.split("@")[1]
            if domain == root or domain.endswith("." + root):
                rank, conf, state = 3, "high", "consistent"
            elif domain == "gmail.com":
                rank, conf, state = 2, base, "unknown"
            else:
                rank, conf, state = 1, "low", "inconsistent"
            if rank > best:
                best, status, econf = rank, state, conf
                email = value if rank > 1 else None
                if email:
                    source = f"email:{src}"
        elif kind == "phone":
            conf = "high" if value.startswith("+") and base == "medium" else base
            if score[conf] > score[pconf]:
                phone, pconf = value, conf
                source = source or f"phone:{src}"
        else:
            source = source or f"form:{src}"
    return email, econf if email else "low", status, phone, pconf, source


def test_contact_quality_equals_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        made = [rng.choice([("email", rng.choice(["a@acme.es", "b@gmail.com", "c@x.org", "d@shop.acme.es"])), ("phone", rng.choice(["+341234567", "912345678"])), ("contact_form", "f")]) for _ in range(rng.randint(0, 6))]
        rows.append((i, [(k, v, rng.choice(["mailto_link", "visible_text"])) for k, v in made]))
    df = spark.createDataFrame(rows, "id int, contact_channels array<struct<type:string,value:string,source:string>>").selectExpr("*", "'https://www.acme.es/' AS website_url", "false AS form_detected", "cast(NULL AS string) AS whatsapp_url", "cast(NULL AS string) AS booking_url", "cast(NULL AS struct<external_links:array<string>>) AS social_profile")
    for r in quality.contact_quality(df).collect():
        want = channel_loop(rows[r["id"]][1], "acme.es")
        assert (r["primary_email"], r["primary_email_confidence"], r["contact_consistency_status"], r["primary_phone"], r["primary_phone_confidence"], r["primary_contact_source"]) == want


def test_locations(spark):
    rows = [(1, "Calle Mayor 1, 28013 Madrid, España"), (2, "es"), (3, "Av. Corrientes 1234 | Buenos Aires | AR"), (4, None), (5, "hotel x, Lima")]
    df = quality.parse_location(spark.createDataFrame(rows, "id int, place string"), "place", "l_")
    got = {r["id"]: r for r in df.withColumn("f", F.expr(quality.format_location("l_city", "l_region", "l_country", "l_postal"))).collect()}
    assert got[1]["f"] == "28013 Madrid, España" and got[2]["l_country"] == "España" and got[3]["l_country"] == "Argentina" and got[4]["f"] is None and got[5]["l_city"] == "Lima"


def test_keywords_of_equals_grouped(spark):
    df = spark.createDataFrame([(1, "beta alpha beta the contact gamma alpha beta zeta delta epsilon"), (2, ""), (3, "ñandú ñandú abc")], "id int, text string")
    arrays = {r["id"]: r["k"] for r in df.select("id", F.expr(quality.keywords_of("text")).alias("k")).collect()}
    grouped = {}
    for r in sorted(quality.service_keywords(df, "id", "text").collect(), key=lambda r: r["rank"]):
        grouped.setdefault(r["id"], []).append(r["token"])
    assert arrays == grouped | {2: []} and arrays[1] == ["beta", "alpha", "delta", "epsilon", "gamma"]


def test_payloads(spark):
    good = {"inferred_niche": " ", "inferred_tech_stack": ["React", "", "React", 3], "generic_attributes": {"observed_signals": ["- uno.", "UNO"], "pain_points_detected": ["Mejorar web"]}, "hiring_signals": "sí", "estimated_revenue_signal": "HIGH", "score": "1.7", "confidence_level": 0.55}
    rows = [(1, json.dumps(good)), (2, "{broken"), (3, json.dumps({k: v for k, v in good.items() if k != "score"})), (4, None)]
    got = {r["id"]: r for r in extraction.validate(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert got[1]["valid"] and got[1]["ai_niche"] == "Desconocido" and got[1]["ai_score"] == 1.0 and got[1]["ai_confidence"] == "medium" and got[1]["ai_hiring"] and got[1]["ai_observed"] == ["uno"]
    assert got[1]["ai_opportunities"] == ["Posible oportunidad: mejorar web"]
    assert [got[i]["fallback_reason"] for i in (2, 3, 4)] == ["invalid_json", "invalid_payload", "missing_payload"]


def test_queries(spark):
    lists, texts = synthesis.LISTS, synthesis.TEXTS
    values = {"search_query": "Academias online Madrid", "user_profession": "video editor", "target_niche": "ecommerce y academias online", "target_location": "Madrid", "target_language": "es", "target_budget_signals": ["instagram", "linktree"]}
    df = spark.createDataFrame([(1, *(values.get(c) for c in texts), *(values.get(c) for c in lists))], "id int, " + ", ".join(f"{c} string" for c in texts) + ", " + ", ".join(f"{c} array<string>" for c in lists))
    r = synthesis.build_queries(df).first()
    assert r["queries"][:5] == ["Academias online Madrid", "ecommerce y academias online Madrid", "ecommerce Madrid", "academia online Madrid", "tienda online Madrid"] and len(r["queries"]) == 16
    assert all("-pinterest" not in q for q in r["queries"]) and "site:instagram.com" in r["queries"][5]
    flat = [q for b in r["query_batches"] for q in b]
    assert len(flat) == len(set(flat)) and all(len(b) <= 2 for b in r["query_batches"])
    b = one(spark, synthesis.candidate_cap("5"), synthesis.capture_target("0", "5"), synthesis.batch_size("1", "20"), synthesis.discovery_budget("5", "20", "20"))
    assert tuple(b) == (20, 5, 3, 10)


def test_upserts(spark):
    schema = "k int, created_at int, v string, seq int"
    old, new = spark.createDataFrame([(1, 10, "a", 1), (2, 11, "b", 1)], schema), spark.createDataFrame([(2, 20, "c", 1), (2, 21, "d", 2), (3, 22, None, 1)], schema)
    assert sorted(map(tuple, upsert.upsert(old, new, ["k"], ["seq"]).select("k", "created_at", "v").collect())) == [(1, 10, "a"), (2, 11, "d"), (3, 22, None)]
    assert {tuple(r) for r in upsert.backfill(old.select("k"), new.select("k", "v"), ["k"]).select("k").collect()} == {(3,)}
    rows = spark.createDataFrame([(1, "https://a.es/", "https://a.es/", "website", "https://a.es/contacto", None, None, [("https://a.es/x", "")], ["https://a.es/contacto", "https://a.es/precios"])], "prospect_id int, primary_identity_url string, website_url string, primary_identity_type string, contact_page_url string, booking_url string, pricing_page_url string, crawled_pages array<struct<url:string,page_type:string>>, internal_links array<string>")
    assert {(r["url"], r["page_type"]) for r in upsert.pages(rows).collect()} == {("https://a.es/", "home"), ("https://a.es/contacto", "contact"), ("https://a.es/x", "other"), ("https://a.es/precios", "pricing")}


def test_crawl_merge_stops_when_enough(pages):
    parsed = parse(read_pages(pages)).withColumns({"root": F.lit("r"), "page_type": F.lit("about")})
    assert [r["page_id"] for r in crawl.stop_when_enough(parsed, "root", "page_id").collect()] == [1]
    merged = crawl.merge(parsed, "root", "page_id").first()
    assert merged["pages_crawled"] == 5 and merged["phone_validation_rejections"] == {"date_like": 1, "sequence_noise": 2} and merged["title"] == "Clinica X | Madrid" and merged["form_detected"]
    assert crawl.crawl(crawl.identity(parse(read_pages(pages))), parse(read_pages(pages))).columns[0] == "root"


def test_sources(spark):
    serp = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.test%2F">Acme</a><a class="result__snippet">best shop</a></div><div class="result"><h3>B</h3><a href="https://b.test/">b</a></div>'
    rows = providers.html_hits(spark.createDataFrame([("q", serp)], "query string, html string")).collect()
    assert [(r["ordinal"], r["url"]) for r in rows] == [(0, "https://acme.test/"), (1, "https://b.test/")] and rows[0]["snippet"] == "best shop"
    payload = json.dumps({"web": {"results": [{"url": " https://a.test ", "title": "A", "description": "d"}]}})
    assert providers.json_hits(spark.createDataFrame([("q", payload)], "query string, payload string")).first()["url"] == "https://a.test"
    spark.dataSource.register(providers.HitSource)
    assert spark.read.format("lodestone_hits").option("queries", "a|b").option("limit", 3).load().count() == 6
    chain = spark.createDataFrame([(1, "google", "x", None), (1, "brave_api", "y", "dup"), (2, "brave_api", "z", None), (2, "google", "w", None)], "job_id int, provider string, url string, exclusion_reason string")
    assert {(r["job_id"], r["url"]) for r in providers.provider_chain(chain, ["brave_api", "google"]).collect()} == {(1, "x"), (2, "z")}
    assert providers.provider_order("google, nope,ddg_html") == ["google", "duckduckgo"]


def test_result_page_texts_inside_links():
    page = '<div class="result"><a class="result__a" href="https://a.test/">A <b>bold</b></a><p><a class="result__snippet" href="https://a.test/">uno <i>dos</i></a></p></div><div class="g"><a href="https://c.test/"><h3>C</h3></a><div class="VwiC3b">text <a href="#x">more</a></div></div>'
    assert [(r["ordinal"], r["url"], r["title"], r["snippet"]) for r in providers.read_results(page)] == [(0, "https://a.test/", "A bold", "uno dos"), (1, "https://c.test/", "C", "text more")]


def test_taxonomy_and_entity_ties(spark):
    assert entity.folded(["asociacion", "asociación"]) == ["asociacion", "asociacion"]
    r = one(spark, features.opportunities("array('- Mejorar X.', 'podria Y', 'mejorar x')"), features.clean_list("array('1) a', 'A', ' ', 'b')", 5))
    assert r["c0"] == ["Posible oportunidad: mejorar X", "podria Y"] and r["c1"] == ["a", "b"]


def test_job_context_and_traces(spark, pages):
    filters = json.dumps({"target_accepted_results": 5, "discovery_profile": {"user_service_offers": ["a", "b"], "user_ticket_size": "alto"}})
    row = spark.createDataFrame([(1, "dental", filters, "ddg")], "id int, target_niche string, filters_json string, source_type string")
    c = pipeline.job_context(row).first()
    assert (c["target_accepted_results"], c["user_service_offers"], c["user_ticket_size"], c["source_type"], c["max_candidates_to_process"]) == (5, ["a", "b"], "alto", "duckduckgo_search", None)
    df = extraction.trace(extraction.evidence_pack(pipeline.prospects(pages.where("page_id = 1"))), "p", "v1")
    r = df.select("evidence_pack", "ai_trace").first()
    assert json.loads(r["evidence_pack"])["domain"] == "clinica.es" and r["ai_trace"]["status"] in ("skipped", "fallback")
    assert one(spark, upsert.skipped_counter("3", "5"))["c0"] == 0
    hit = hits.discovery_metadata(spark.createDataFrame([("u", "q", 1)], "url string, query string, position int")).first()
    assert hit["discovery"]["source_query"] == "q" and hit["discovery"]["title"] is None


def test_schemas(spark):
    from lodestone import schemas

    for ddl in schemas.TABLES.values():
        spark.createDataFrame([], ddl)
    rows = spark.createDataFrame([(1, 2, "accepted"), (1, None, "accepted"), (1, 3, "odd")], "job_id int, prospect_id int, quality_status string")
    assert schemas.invalid(rows, "job_prospects").count() == 2
