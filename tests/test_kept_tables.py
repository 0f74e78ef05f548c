import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entity, extraction, kpi, maintained, paging, quality, synthesis
from lodestone.plans import ledger, search_queries
from lodestone.sinks.store import Store
from lodestone.sources import providers

# payloads as of a clock

ROWS, PAYLOADS = "n int, signature string, prompt_version string, run_at timestamp, extra map<string,int>", "signature string, prompt_version string, created_at timestamp, sequence bigint, payload string"


@pytest.mark.parametrize("hot", [100_000, 10])
def test_payloads_as_of_equal_a_loop(spark, hot):
    draw, day = random.Random(hot), lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    sign = lambda: draw.choice(["a", "a", "a", "b", "c", None])
    rows = [(i, sign(), draw.choice(["v1", "v2", None]), draw.choice([day(draw.randrange(20)), None]), {"x": i}) for i in range(200)]
    known = [(sign(), draw.choice(["v1", "v2"]), day(draw.randrange(20)), i, f"p{i}") for i in range(60)] + [("a", "v1", None, 99, "timeless")]

    def newest(r):
        fits = [p for p in known if None not in (r[1], r[2], r[3], p[2]) and (p[0], p[1]) == (r[1], r[2]) and p[2] <= r[3]]
        return max(fits, key=lambda p: (p[2], p[3]))[4] if fits else None

    out = extraction.payloads_as_of(spark.createDataFrame(rows, ROWS).select("n", "signature", "prompt_version", "run_at"), spark.createDataFrame(known, PAYLOADS), hot_rows=hot)
    assert {r["n"]: r["payload"] for r in out.collect()} == {r[0]: newest(r) for r in rows}
    assert extraction.payloads_as_of(spark.createDataFrame([], ROWS).drop("extra"), spark.createDataFrame(known, PAYLOADS)).count() == 0


# pages by place


def test_pages_equal_offsets(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, *range(30)]), i) for i in range(400)] + [(9, 1, 1000)]
    df = spark.createDataFrame(rows, "job_id bigint, at int, id bigint").repartition(5)
    clustered = paging.cluster(df, "job_id", [F.desc_nulls_first("at"), F.desc("id")])
    marks = paging.bookmarks(clustered, "job_id", 10)
    for job in (1, 2, None, 9, 77):
        want = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1] is not None, -(r[1] or 0), -r[2]))
        for number in (0, 1, 4, 50):
            got = [(r["job_id"], r["at"], r["id"]) for r in paging.page(clustered, marks, "job_id", job, number, 10).collect()]
            assert got == want[10 * number : 10 * number + 10]
    second = paging.pages(clustered, marks, "job_id", 1)
    assert second.count() == sum(min(10, max(0, sum(r[0] == j for r in rows) - 10)) for j in (1, 2, 3, None, 9))
    plan = paging.page(clustered, marks, "job_id", 1, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place" in plan and "LessThan(place" in plan


def test_pages_of_nothing(spark):
    clustered = paging.cluster(spark.createDataFrame([], "job_id bigint, at int"), "job_id", [F.asc("at")])
    marks = paging.bookmarks(clustered, "job_id", 10)
    assert marks.count() == 0 and paging.page(clustered, marks, "job_id", 1, 0, 10).collect() == []


# metrics kept up to date


def test_metrics_follow_their_changes(spark, tmp_path):
    draw = random.Random(6)
    row = lambda i, j: (j, i, draw.choice(["accepted", "needs_review", "rejected"]), None, draw.choice(["accepted_target", "accepted_related", "rejected_media"]), draw.choice(["consistent", "inconsistent"]), '{"invalid_phone_candidates_count": 2}')
    fields, jobs_are = "job_id bigint, row_id bigint, quality_status string, rejection_reason string, acceptance_decision string, contact_consistency_status string, raw_extraction string", "job_id bigint, status string, total_processed bigint, total_found bigint, total_failed bigint, total_skipped bigint"
    store = Store(spark, str(tmp_path), maintained.tables(fields, jobs_are, ("job_id", "row_id"), 8))
    rows, jobs = {}, {j: (j, "completed", 5 + j, 6 + j, 0, 1) for j in range(12)}
    none = spark.createDataFrame([], "job_id bigint, reason string, n bigint")
    for n, change in enumerate([range(12), [1, 5], [5]]):
        new = [row(draw.randrange(6), j) for j in change for _ in range(3)]
        new = list({(r[0], r[1]): r for r in new}.values())
        rows |= {(r[0], r[1]): r for r in new}
        if n == 2:
            jobs[5] = (5, "running", 50, 60, 3, 1)
        some = [jobs[j] for j in change] if n != 1 else []
        assert maintained.update(store, spark.createDataFrame(new, fields), spark.createDataFrame(some, jobs_are), none, number=n)
        if n:
            assert len(store.state().tables["summaries"][-1]["buckets"]) <= len(change)
        all_rows, all_jobs = spark.createDataFrame(list(rows.values()), fields), spark.createDataFrame(list(jobs.values()), jobs_are)
        full = kpi.operational_metrics(kpi.operational_summary(kpi.capture_summary(all_jobs, all_rows), none))
        assert maintained.operational_metrics(store).collect() == full.collect()
        assert maintained.commercial_metrics(store).collect() == kpi.commercial_metrics(all_jobs, kpi.commercial_summary(all_rows)).collect()


# plans that are taken up again


def test_ledger_resumes_behind_whole_stages(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path / "s"), ledger.LEDGER), []

    def plan(parameters, fail=None):
        book = ledger.Ledger(store, "r", parameters)

        def work(name, n):
            def build():
                calls.append(name)
                if name == fail:
                    raise InterruptedError
                return spark.range(n)

            return book.stage(name, build)

        return [work("one", 3).count(), work("two", 4).count()], book

    with pytest.raises(InterruptedError):
        plan({"a": 1}, fail="two")
    counts, book = plan({"a": 1})
    assert counts == [3, 4] and calls == ["one", "two", "two"] and book.done == ["two"]
    assert plan({"a": 1})[0] == [3, 4] and len(calls) == 3
    assert plan({"a": 2})[1].done == ["one", "two"]


# search queries: what is known of them

JOB = "search_query string, target_niche string, target_location string, target_language string, user_profession string, user_technologies array<string>, user_service_offers array<string>, user_service_constraints array<string>, user_target_offer_focus string, target_budget_signals array<string>, ai_dork_queries array<string>, ai_negative_terms array<string>"


def queries_of(spark, **job):
    row = tuple(job.get(c.split(" ")[0]) for c in JOB.split(", "))
    return synthesis.build_queries(spark.createDataFrame([row], JOB)).first()


def test_search_queries_of_a_plain_job(spark):
    r = queries_of(spark, search_query="clinicas dentales", target_niche="clinicas dentales", target_location="Madrid", target_language="es")
    assert r["queries"][0] == "clinicas dentales" and "clinicas dentales Madrid" in r["queries"]
    assert any("sitio oficial" in q for q in r["queries"]) and any("contacto" in q for q in r["queries"]) and any("-blog" in q for q in r["queries"][2:])
    flat = [q for b in r["query_batches"] for q in b]
    assert len(r["query_batches"]) >= 2 and max(map(len, r["query_batches"])) <= 2 and len(flat) == len(set(flat))
    assert any("empresa" in q or "negocio" in q for q in flat) and any("ubicaciones" in q or "sedes" in q for q in flat)


def test_search_queries_without_a_query(spark):
    r = queries_of(spark, target_niche="veterinarias", target_location="Lima")
    assert r["queries"][0] == "veterinarias Lima" and any("sitio oficial" in q for q in r["queries"])


def test_search_queries_of_mixed_niches(spark):
    r = queries_of(spark, search_query="empresas ecommerce y academias online España", target_niche="Ecommerce y academias online", target_location="España", target_language="es", user_target_offer_focus="negocios que vendan productos digitales o hagan ecommerce")
    q = r["queries"]
    assert {"ecommerce España", "academia online España"} <= set(q)
    assert any(x.startswith("ecommerce España sitio oficial") for x in q) and any(x.startswith("academia online España contacto") for x in q)
    assert any("-prensa" in x for x in q) and any("-informe" in x for x in q) and any("-asesoria" in x or "-consultoria" in x for x in q)


def test_search_queries_of_creative_roles(spark):
    r = queries_of(spark, search_query="marcas personales y coaches España", user_profession="Editor de Video", target_niche="Marcas Personales y Coaches", target_location="España", target_language="es", target_budget_signals=["Activos en Instagram o TikTok", "Tienen linktree/tienda oficial"])
    q = r["queries"]
    assert any("site:instagram.com" in x for x in q) and any("site:tiktok.com" in x for x in q) and any("link in bio" in x or "linktree" in x for x in q)
    assert not any("-instagram" in x or "-tiktok" in x for x in q)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_are_searched_in_one_pass(spark, tmp_path):
    """However many providers there are, the chain reads the queries once and deals their hits out once."""
    spark.createDataFrame([(i, o, f"q{i} {o}") for i in range(40) for o in range(3)], "job_id long, ordinal int, query string").write.parquet(f"{tmp_path}/queries")
    hits = providers.provider_chain(search_queries._search(spark.read.parquet(f"{tmp_path}/queries")), ["brave_api", "duckduckgo", "google"])
    assert plan_of(hits).count("Relation ") == 1 and "Join" not in plan_of(hits)
    rows = hits.collect()
    assert rows and all(len({r["provider"] for r in rows if r["job_id"] == i}) <= 1 for i in range(40))


def test_query_synthesis_works_out_each_part_once(spark):
    """What of the retries is new is worked out once, not once a batch, and a query isn't put to lower case once a term."""
    job = tuple("a" if " string" in c else None for c in JOB.split(", "))
    plan = plan_of(synthesis.build_queries(spark.createDataFrame([job], JOB)))
    assert plan.count("array_except(retry_queries") <= 1 and "contains(lower(lambda q" not in plan
    r = queries_of(spark, search_query="ropa -Blog", target_niche="ropa", target_location="Lima", ai_dork_queries=[" inurl:x   -IDEAS "], ai_negative_terms=["", " ", None, "-De   Segunda", "-blog"])
    assert r["queries"][0].startswith("inurl:x -IDEAS -blog -noticias") and r["queries"][0].endswith("-linkedin -De Segunda")
    assert [q for q in r["queries"] if "sitio oficial" in q][0].startswith("ropa Lima sitio oficial -blog -ideas")


def test_page_rules_look_each_dictionary_up_once(spark):
    """Points and evidence of an entity type share one look-up; folded texts aren't carried along; words are counted without a loop over the stop words."""
    pages = "title string, description string, discovery_title string, discovery_snippet string, website_url string, url string, internal_links array<string>, clean_text string, structured_data array<string>, emails array<string>, phones array<string>, form_detected boolean, addresses array<string>, map_links array<string>, booking_url string, pricing_page_url string, primary_identity_type string, social_profile struct<handle:string,offer_signals:array<string>,platform_ctas:array<string>>"
    rows = spark.createDataFrame([("Asociacion", "", None, None, "https://a.es", "https://a.es", [], "camara de comercio y asociacion", [], [], [], False, [], [], None, None, "website", None)], pages).repartition(1)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = plan_of(entity.classify(rows))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    listed = ",".join(entity.folded(entity.rules.ASSOCIATION)[:4])
    assert plan.replace(", ", ",").count(listed) == 1
    assert "array_contains" not in quality.keywords_of("t")
    texts = [("casa casa perro para sobre perro casa árbol gato", ["para"], ["casa", "perro", "gato", "sobre", "árbol"]), ("para para", ["para"], []), ("", ["para"], []), ("para", [], ["para"]), (None, ["para"], None)]
    for text, stop, want in texts:
        row = spark.createDataFrame([(text,)], "t string").select(F.expr(quality.keywords_of("t", stopwords=stop)).alias("k")).first()
        assert row["k"] == want
