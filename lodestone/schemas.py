"""Schemas of the persistent tables as DDL, with keys and closed value sets. Open JSON is kept as text, lists as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables, columns, keys, enumerations.
JOBS = (
    "id bigint, workspace_id string, requested_by string, status string, user_profession string, user_technologies array<string>, user_value_proposition string, user_past_successes array<string>, user_roi_metrics array<string>,"
    " target_niche string, target_location string, target_language string, target_company_size string, target_pain_points array<string>, target_budget_signals array<string>, source_type string, filters_json string,"
    " started_at timestamp, finished_at timestamp, error_message string, total_found int, total_processed int, total_saved int, total_failed int, total_skipped int, created_at timestamp, updated_at timestamp"
)
PROSPECTS = (
    "id bigint, workspace_id string, company_name string, canonical_identity string, domain string, primary_identity_type string, primary_identity_url string, website_url string, category string, location string, raw_location_text string,"
    " parsed_location struct<formatted:string,city:string,region:string,country:string,postal_code:string,source:string>, city string, region string, country string, postal_code string, validated_location string, location_match_status string,"
    " location_confidence string, detected_language string, language_match_status string, description string, email string, phone string, contact_page_url string, form_detected boolean, primary_cta string, booking_url string, pricing_page_url string,"
    " whatsapp_url string, contact_channels array<struct<type:string,value:string,source:string,confidence:string,is_primary:boolean,domain_relation:string>>, contact_quality_score double, contact_consistency_status string,"
    " primary_email_confidence string, primary_phone_confidence string, primary_contact_source string, company_size_signal string, service_keywords array<string>, linkedin_url string, instagram_url string, tiktok_url string, facebook_url string,"
    " social_profiles array<struct<platform:string,url:string,handle:string,is_primary:boolean,profile_kind:string,contact_signals:array<string>,activity_signals:array<string>,confidence:string>>, inferred_tech_stack array<string>, inferred_niche string,"
    " taxonomy_top_level string, taxonomy_business_type string, generic_attributes string, observed_signals array<string>, inferred_opportunities array<string>, entity_type_detected string, entity_type_confidence string, entity_type_evidence string,"
    " is_target_entity boolean, hiring_signals boolean, estimated_revenue_signal string, has_active_ads boolean, source string, source_url string, score double, confidence_level string, created_at timestamp, updated_at timestamp"
)
JOB_PROSPECTS = (
    "id bigint, job_id bigint, prospect_id bigint, workspace_id string, source_url string, source_type string, discovery_method string, search_query_snapshot string, rank_position int, processing_status string, quality_status string,"
    " quality_flags array<string>, rejection_reason string, acceptance_decision string, contact_consistency_status string, primary_email_confidence string, primary_phone_confidence string, primary_contact_source string, discovery_confidence string,"
    " entity_type_detected string, entity_type_confidence string, entity_type_evidence string, is_target_entity boolean, match_score double, confidence_level string, fit_summary string, pain_points array<string>, outreach_angles array<string>,"
    " taxonomy_top_level string, taxonomy_business_type string, observed_signals array<string>, inferred_opportunities array<string>, evidence string, raw_extraction string, error_message string, created_at timestamp, updated_at timestamp"
)
CONTACTS = "id bigint, prospect_id bigint, contact_type string, contact_value string, label string, is_primary boolean, is_public boolean, contact_person_name string, contact_person_role string, confidence double, source_url string, created_at timestamp, updated_at timestamp"
PAGES = "id bigint, prospect_id bigint, url string, page_type string, http_status int, title string, meta_description string, detected_language string, text_hash string, content_signals string, last_seen_at timestamp, last_scraped_at timestamp, created_at timestamp, updated_at timestamp"
SIGNALS = "id bigint, prospect_id bigint, signal_type string, signal_value string, confidence double, notes string, created_at timestamp"
LOGS = "id bigint, job_id bigint, level string, message string, source_name string, context string, created_at timestamp"

TABLES = {"scraping_jobs": JOBS, "prospects": PROSPECTS, "job_prospects": JOB_PROSPECTS, "prospect_contacts": CONTACTS, "prospect_pages": PAGES, "prospect_signals": SIGNALS, "scraping_logs": LOGS}
KEYS = {"prospects": ["canonical_identity"], "job_prospects": ["job_id", "prospect_id"], "prospect_contacts": ["prospect_id", "contact_type", "contact_value"], "prospect_pages": ["prospect_id", "url"]}
ENUMS = {
    "status": ["pending", "running", "completed", "failed"], "confidence_level": ["low", "medium", "high"], "location_match_status": ["match", "mismatch", "unknown"], "quality_status": ["accepted", "needs_review", "rejected"],
    "acceptance_decision": ["accepted_target", "accepted_related", "rejected_directory", "rejected_media", "rejected_article", "rejected_low_confidence"], "level": ["INFO", "WARNING", "ERROR"],
}


def invalid(df: DataFrame, table: str) -> DataFrame:
    """Rows that break the table's rules: missing key parts, values outside a closed set."""
    tests = [F.col(k).isNull() for k in KEYS.get(table, []) if k in df.columns]
    tests += [F.col(c).isNotNull() & ~F.col(c).isin(values) for c, values in ENUMS.items() if c in df.columns]
    broken = F.lit(False)
    for t in tests:
        broken = broken | t
    return df.where(broken)
