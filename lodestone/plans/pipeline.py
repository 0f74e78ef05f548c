"""The page pipeline as one lazy plan: parse, crawl, identity, features, entity, gate, model payloads, score, taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import written
from ..functions.plan import barrier, shared
from .. import schemas
from ..operators import crawl, entity, extraction, features, kpi, projection, quality, scoring, upsert
from ..operators.parse import parse
from ..operators.projection import project
from ..operators.upsert import last_rows
from ..sinks.store import Store, Table
from ..sources.html import read_pages

PROMPT_VERSION = "v1"
SIGNATURE_TEXT = 2500
#: Criteria of a job that the rules read, with their types.
CRITERIA = {
    "target_niche": "string", "target_location": "string", "target_language": "string", "user_target_offer_focus": "string",
    "target_pain_points": "array<string>", "target_budget_signals": "array<string>", "user_technologies": "array<string>",
}


def job_context(jobs: DataFrame) -> DataFrame:
    """Query parameters of jobs: criteria, the profile inside filters_json, targets, and names of sources as they are stored."""
    profile = lambda k: F.get_json_object("filters_json", f"$.discovery_profile.{k}")
    listed = lambda k: F.from_json(profile(k), "array<string>").alias(k)
    number = lambda k: F.expr(f"try_cast(get_json_object(filters_json, '$.{k}') AS int)").alias(k)
    plain = ["workspace_id", "user_profession", "user_technologies", "user_value_proposition", "user_past_successes", "user_roi_metrics", "target_niche", "target_location", "target_language", "target_company_size", "target_pain_points", "target_budget_signals"]
    return jobs.select(
        F.col("id").alias("job_id"), *(c for c in plain if c in jobs.columns), listed("user_service_offers"), listed("user_service_constraints"), profile("user_target_offer_focus").alias("user_target_offer_focus"), profile("user_ticket_size").alias("user_ticket_size"),
        F.expr(upsert.source_type("source_type")).alias("source_type"), number("target_accepted_results"), number("max_candidates_to_process"),
    )


def with_criteria(pages: DataFrame, criteria: dict | None = None) -> DataFrame:
    """Adds a job's criteria as literals; missing ones are null."""
    given = criteria or {}

    def literal(name: str, kind: str):
        value = given.get(name)
        return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kind)

    return pages.withColumns({k: literal(k, t) for k, t in CRITERIA.items()})


def metadata(pages: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Metadata of pages(page_id, url, html) merged with their key pages', with the technologies of the HTML, identity and what
    discovery said of the URL: one row per row of pages.

    Rows are told apart by a digest of what they hold, so null and repeated ids keep their rows; what the rules need of the HTML is
    taken where it is read, and nothing is joined back. Of several hits for one URL the least title and snippet count.
    """
    told = F.md5(F.to_json(F.struct("page_id", "url", "html"))).alias("row_key")
    raw = read_pages(pages.select("page_id", "url", "html", told), keep=("row_key", "html"))
    raw = raw.withColumn("html_stack", F.expr(features.technologies("coalesce(html, '')"))).drop("html")
    parsed = shared(parse(raw, ("row_key", "html_stack")), "row_key")
    rows = crawl.identity(barrier(crawl.with_key_pages(parsed, parsed, "row_key"))).drop("row_key")
    if hits is None:
        return rows.withColumns({"discovery_title": F.lit(None).cast("string"), "discovery_snippet": F.lit(None).cast("string")})
    found = hits.groupBy("url").agg(F.min(F.struct(F.col("title").alias("t"), F.col("snippet").alias("s"))).alias("h"))
    return rows.join(found.select("url", F.col("h.t").alias("discovery_title"), F.col("h.s").alias("discovery_snippet")), "url", "left")


def assess(rows: DataFrame) -> DataFrame:
    """Features, entity type, quality gate and signature of pages with metadata and criteria."""
    df = barrier(quality.evaluate(barrier(entity.classify(barrier(features.heuristics(barrier(rows)))))))
    return df.withColumn("signature", F.expr(quality.signature("domain", f"substring(clean_text, 1, {SIGNATURE_TEXT})", f"'{PROMPT_VERSION}'")))


def score(rows: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Final score and taxonomy. payloads: signature, payload, of pages that a model has seen."""
    if payloads is None:
        df = rows.withColumns({"ai_score": F.lit(None).cast("double"), "ai_confidence": F.lit(None).cast("string"), "selected_method": F.lit("heuristic"), "fallback_reason": F.col("ai_gate"), "ai_niche": F.lit(None).cast("string")})
    else:
        df = extraction.with_payloads(rows, payloads)
    df = df.withColumns({"heuristic_score": F.col("score"), "heuristic_confidence": F.col("confidence_level"), "heuristic_summary": F.col("fit_summary"), "inferred_niche": F.coalesce("ai_niche", "inferred_niche")})
    return entity.taxonomy(barrier(scoring.final_score(df)))


def prospects(pages: DataFrame, criteria: dict | None = None, hits: DataFrame | None = None, payloads: DataFrame | None = None) -> DataFrame:
    """The whole plan over pages(page_id, url, html)."""
    return score(assess(with_criteria(metadata(pages, hits), criteria)), payloads)


#: Names in the evidence and the raw extraction of a job's row.
EVIDENCE_FIELDS = [
    "source_type", "discovery_method", "search_query", "canonical_identity", "primary_identity_type", "primary_identity_url", "emails", "phones", "socials", "social_profiles", "contact_page_url", "form_detected",
    "contact_consistency_status", "primary_email_confidence", "primary_phone_confidence", "primary_contact_source", "geo_evidence", "raw_location_text", "parsed_location", "city", "region", "country", "postal_code",
    "language_evidence", "cta_evidence", "structured_data_evidence", "discovery_evidence", "observed_signals", "inferred_opportunities", "acceptance_decision", "entity_type_detected", "entity_type_confidence",
    "entity_type_evidence", "is_target_entity", "taxonomy_top_level", "taxonomy_business_type", "content_coverage", "heuristic_signals", "scoring_trace", "phone_validation_rejections", "invalid_phone_candidates_count",
]
EXTRACTION_FIELDS = [
    "inferred_niche", "taxonomy_top_level", "taxonomy_business_type", "inferred_tech_stack", "generic_attributes", "observed_signals", "inferred_opportunities", "estimated_revenue_signal", "has_active_ads", "hiring_signals",
    "raw_location_text", "parsed_location", "city", "region", "country", "postal_code", "validated_location", "location_match_status", "location_confidence", "detected_language", "language_match_status", "primary_cta",
    "booking_url", "pricing_page_url", "whatsapp_url", "contact_channels_json", "contact_quality_score", "contact_consistency_status", "primary_email_confidence", "primary_phone_confidence", "primary_contact_source",
    "primary_identity_type", "primary_identity_url", "social_profiles", "company_size_signal", "service_keywords", "acceptance_decision", "entity_type_detected", "entity_type_confidence", "entity_type_evidence",
    "is_target_entity", "ai_trace", "heuristic_trace", "scoring_trace", "phone_validation_rejections", "invalid_phone_candidates_count",
]


def sinks(rows: DataFrame, run_ts) -> dict[str, DataFrame]:
    """Whole rows of the persistent tables out of scored pages, in their declared schemas; run_ts stands for the clock.

    What a page lacks is null; nested values are JSON where the schema has text. Of pages of one identity the one with the greatest id counts.
    """
    one = upsert.latest(rows, ["canonical_identity"], [F.desc("page_id")])
    text = {"match_status": "cast(NULL AS string)", "job_id": "cast(NULL AS bigint)", "source_url": "url", "workspace_id": "cast(NULL AS string)", "rank_position": "cast(NULL AS int)", "source_type": "cast(NULL AS string)", "discovery_method": "cast(NULL AS string)", "search_query": "cast(NULL AS string)", "source": "cast(NULL AS string)", "quality_flags": "cast(NULL AS array<string>)", "phone": "primary_phone", "email": "primary_email"}
    one = one.withColumns({"prospect_id": F.xxhash64("canonical_identity"), "run_at_": F.lit(run_ts).cast("timestamp"), **{c: F.expr(e) for c, e in text.items() if c not in one.columns}})
    place = "named_struct('formatted', location, 'city', city, 'region', region, 'country', country, 'postal_code', postal_code, 'source', cast(NULL AS string))"
    one = one.withColumn("parsed_location", F.expr(f"CASE WHEN location IS NOT NULL THEN {place} END"))
    stamps = {"created_at": "run_at_", "updated_at": "run_at_"}
    socials = [c for c in ("linkedin_url", "instagram_url", "tiktok_url", "facebook_url") if c in one.columns]
    derived = {
        "emails": "array_compact(array(email))", "phones": "array_compact(array(phone))", "socials": f"array_compact(array({', '.join(socials)}))" if socials else "cast(array() AS array<string>)",
        "source_type": upsert.source_type("coalesce(source_type, source)"), "discovery_method": upsert.discovery_method("discovery_method"), "contact_channels_json": "contact_channels",
    }
    struct = lambda names: f"to_json({projection.nested(one, {n: derived.get(n, n) for n in names})}, map('ignoreNullFields', 'false'))"
    pains = "nullif(inferred_opportunities, cast(array() AS array<string>))"
    job = stamps | {
        "id": "cast(NULL AS bigint)", "processing_status": "'processed'", "quality_status": "coalesce(quality_status, 'accepted')", "match_score": "coalesce(final_score, 0D)", "search_query_snapshot": "search_query",
        "source_type": derived["source_type"], "discovery_method": derived["discovery_method"], "pain_points": pains, "observed_signals": "nullif(observed_signals, cast(array() AS array<string>))", "inferred_opportunities": pains,
        "evidence": struct(EVIDENCE_FIELDS), "raw_extraction": struct(EXTRACTION_FIELDS),
    }
    prospect = project(one, schemas.PROSPECTS, stamps | {"id": "prospect_id", "score": "final_score"}).withColumnRenamed("id", "prospect_id")
    stamp = lambda df: df.withColumns({c: F.lit(run_ts).cast("timestamp") for c in ("created_at", "updated_at")})
    return {
        "prospects": prospect, "job_prospects": project(one, schemas.JOB_PROSPECTS, job),
        "prospect_contacts": stamp(upsert.contacts(one.drop("contact_channels"))), "prospect_pages": stamp(upsert.pages(one)),
    }


#: Keys of the persistent tables, and the column that orders versions of a row.
KEYS = {"prospects": ["canonical_identity"], "job_prospects": ["job_id", "prospect_id"], "prospect_contacts": ["prospect_id", "contact_type", "contact_value"], "prospect_pages": ["prospect_id", "url"]}


def save(old: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New snapshots of the persistent tables: incoming rows win by key, creation times stay, prospects keep the id they have.

    Rows of the other tables name prospects by identity and get its id: the known one, or the one that comes with the prospect.
    """
    prospects = upsert.upsert(old["prospects"], incoming["prospects"], KEYS["prospects"], ["updated_at"], ["created_at", "prospect_id"])
    ids = prospects.select("canonical_identity", "prospect_id")
    out = {"prospects": prospects}
    for name in [n for n in incoming if n != "prospects"]:
        rows = incoming[name].drop("prospect_id").join(ids, "canonical_identity").select(old[name].columns)
        out[name] = upsert.upsert(old[name], rows, KEYS[name], ["updated_at"])
    return out


def tables(schemas: dict[str, StructType], buckets: int = 64) -> dict[str, Table]:
    """The persistent tables as a store holds them."""
    kept = {"prospects": ("created_at", "prospect_id")}
    return {n: Table(s, tuple(KEYS[n]), ("updated_at",), kept.get(n, ("created_at",)), buckets) for n, s in schemas.items()}


def commit(store: Store, incoming: dict[str, DataFrame], writer: str = "main", number: int | None = None) -> bool:
    """save() into a store: the four tables change together or not at all, and only buckets of incoming keys are read and written.

    Prospects keep the id they have; rows of the other tables name them by canonical_identity.
    """
    new = last_rows(incoming["prospects"], KEYS["prospects"], ["updated_at"], None, ["created_at", "prospect_id"])
    known = store.read_keys("prospects", new.select("canonical_identity")).select("canonical_identity", F.col("prospect_id").alias("known_"))
    prospects = written(new.join(known, "canonical_identity", "left").withColumn("prospect_id", F.coalesce("known_", "prospect_id")).drop("known_"), "prospects")
    ids = prospects.select("canonical_identity", "prospect_id")
    others = {n: df.drop("prospect_id").join(ids, "canonical_identity").select(store.tables[n].schema.names) for n, df in incoming.items() if n != "prospects"}
    return store.commit({"prospects": prospects, **others}, writer, number)


def metrics(jobs: DataFrame, rows: DataFrame, logs: DataFrame) -> dict[str, DataFrame]:
    """Summaries per job and the two global rows."""
    captures = kpi.capture_summary(jobs, rows)
    operational = kpi.operational_summary(captures, kpi.exclusion_counts(logs))
    commercial = kpi.commercial_summary(rows)
    return {"capture": captures, "operational": operational, "commercial": commercial, "operational_metrics": kpi.operational_metrics(operational), "commercial_metrics": kpi.commercial_metrics(jobs, commercial)}
