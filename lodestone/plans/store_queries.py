"""Queries over tables that are kept from run to run: atomic commits, incremental upserts, discovery with feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import new_folder, written
from ..operators import discovery, extraction, kpi, maintained, paging
from ..sinks.store import Store, Table
from . import pipeline
from .adapters import adapter, with_sql
from .case_queries import _save_sql, saved_rows
from .job_queries import OPERATIONAL_METRICS, _exclusions
from .page_queries import _t

_KINDS = {"prospects": "prospect_id, canonical_identity, score", "job_prospects": "job_id, prospect_id, score", "prospect_contacts": "prospect_id, contact_type, contact_value, score", "prospect_pages": "prospect_id, url, score"}


def commit_four_tables(spark, sf_dir):
    """Two runs committed to a store, with an aborted one between and the second done twice: counts and checksums of the four tables read back."""
    rows = written(saved_rows(spark, sf_dir), "rows")

    def incoming(run: str) -> dict:
        r = rows.where(f"run = '{run}'").selectExpr("canonical_identity", "job_id", "score", "'email' AS contact_type", "v AS contact_value", "concat('https://', v, '.es') AS url", f"concat('{run}', canonical_identity) AS prospect_id", "seq AS created_at", "seq AS updated_at")
        return {name: r.select("canonical_identity", *(c for c in [*columns.split(", "), "created_at", "updated_at"] if c != "canonical_identity")) for name, columns in _KINDS.items()}

    first, second = incoming("F"), incoming("O")
    schemas = {n: first[n].select(*columns.split(", "), "created_at", "updated_at").schema for n, columns in _KINDS.items()}
    store = Store(spark, new_folder(spark, "store"), pipeline.tables(schemas, 8))
    pipeline.commit(store, first, "run", 0)
    # a writer that is lost after two of four tables leaves nothing to see
    for name in ("prospects", "prospect_pages"):
        store.stage(name, second[name].withColumns({"prospect_id": F.lit("lost"), "score": F.lit(-1.0)}).select(store.tables[name].schema.names))
    pipeline.commit(store, second, "run", 1)
    pipeline.commit(store, second, "run", 1)
    store.compact("prospect_contacts", 1)
    sums = [store.read(n).groupBy("prospect_id").agg(F.count("*").alias(f"{n}_rows"), F.sum("score").alias(f"{n}_score"), F.sum("created_at").alias(f"{n}_created")) for n in _KINDS]
    df = sums[0]
    for other in sums[1:]:
        df = df.join(other, "prospect_id")
    return df


def incremental_upserts(spark, sf_dir):
    """Orders of each customer kept up to date by one commit a priority, compacted on the way: last state, first time seen, versions."""
    orders = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS customer", "o_orderstatus AS status", "map('price', o_totalprice) AS facts", "o_orderdate AS created_at", "o_orderkey", "cast(substring(o_orderpriority, 1, 1) AS int) AS part")
    schema = orders.drop("part").schema
    store = Store(spark, new_folder(spark, "store"), {"orders": Table(schema, ("customer",), ("o_orderkey",), buckets=16)})
    for part in range(1, 6):
        store.commit({"orders": orders.where(f"part = {part}").drop("part")}, "parts", part)
        if part == 3:
            store.compact("orders", 2)
    return store.read("orders").selectExpr("customer", "status", "facts['price'] AS price", "cast(created_at AS date) AS created_at", "o_orderkey")


INCREMENTAL_UPSERTS = """WITH r AS (SELECT *, {'p': substr(o_orderpriority, 1, 1)::int, 'k': o_orderkey} AS v FROM orders)
SELECT o_custkey AS customer, arg_max(o_orderstatus, v) AS status, arg_max(o_totalprice, v) AS price, arg_min(o_orderdate, v)::date AS created_at, arg_max(o_orderkey, v) AS o_orderkey FROM r GROUP BY o_custkey"""


_HITS = ["l_suppkey AS job_id", "cast(l_linenumber AS int) AS batch", "cast(l_orderkey AS bigint) AS rank", "concat('https://p', l_partkey % 150, '.es') AS url", "l_returnflag = 'R' AS accepted"]
_JOBS = ["s_suppkey AS job_id", "CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey % 9 END AS target", "CASE WHEN s_suppkey % 4 > 0 THEN 6 + s_suppkey % 30 END AS cap"]


def discovery_batches(spark, sf_dir):
    """Search batches of jobs, each opened with the budget that the earlier ones left: statuses, positions and reasons."""
    hits, jobs = _t(spark, sf_dir, "lineitem").selectExpr(*_HITS), _t(spark, sf_dir, "supplier").selectExpr(*_JOBS)
    # two runs, the second of which takes up the states of the first
    first, state = discovery.run(hits.where("batch <= 3"), jobs)
    second, _ = discovery.run(hits.where("batch > 3"), jobs, state)
    return first.unionByName(second)


DISCOVERY_BATCHES = f"""WITH RECURSIVE h AS (SELECT {', '.join(_HITS)} FROM lineitem), j0 AS (SELECT {', '.join(_JOBS)} FROM supplier),
j1 AS (SELECT job_id, coalesce(target, 1) AS target, coalesce(cap, greatest(5, 4 * coalesce(target, 1))) AS cap FROM j0),
j AS (SELECT *, least(cap, greatest(5, 2 * least(cap, greatest(3, least(5, target + 1))))) AS most FROM j1),
d AS (SELECT job_id, batch, url, min(rank) AS rank, (min({{'r': rank, 'a': accepted}})).a AS accepted, count(*) AS copies FROM h GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id, batch ORDER BY rank, url) AS place FROM d),
r AS (SELECT m.*, target, cap, most, row_number() OVER (PARTITION BY job_id ORDER BY batch, rank, url) AS n FROM m JOIN j USING (job_id) WHERE place <= most),
o AS (SELECT r.*, row_number() OVER (PARTITION BY job_id ORDER BY n) AS i FROM r),
s(job_id, i, batch, rank, url, copies, accepted, status, found, processed, good, taken, budget, seen) AS (
  SELECT job_id, 0::BIGINT, -1, 0::BIGINT, '', 0::BIGINT, false, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM j
  UNION ALL
  SELECT job_id, i, batch, rank, url, copies, accepted, st, found + (st IN ('found', 'processed'))::BIGINT, processed + (st = 'processed')::BIGINT, good + (st = 'processed' AND accepted)::BIGINT,
    t + (st NOT IN ('not_reached', 'beyond_budget'))::BIGINT, b, CASE WHEN st IN ('found', 'processed') THEN list_append(seen, url) ELSE seen END
  FROM (SELECT *, CASE WHEN b <= 0 THEN 'not_reached' WHEN t >= b THEN 'beyond_budget' WHEN list_contains(seen, url) THEN 'duplicate_url_reopened' WHEN good >= target THEN 'found' ELSE 'processed' END AS st
    FROM (SELECT o.job_id, o.i, o.batch, o.rank, o.url, o.copies, o.accepted, o.target, s.found, s.processed, s.good, s.seen, CASE WHEN o.batch <> s.batch THEN 0 ELSE s.taken END AS t,
        CASE WHEN o.batch = s.batch THEN s.budget WHEN s.good >= o.target OR s.found >= o.cap THEN 0 ELSE least(o.cap - s.found, o.most) END AS b
      FROM s JOIN o ON o.job_id = s.job_id AND o.i = s.i + 1)))
SELECT job_id, batch, rank, url, copies, accepted, status, CASE WHEN status IN ('found', 'processed') THEN found END AS position, CASE WHEN status = 'processed' THEN processed END AS processed_order FROM s WHERE i > 0"""


def payload_as_of(spark, sf_dir):
    """Orders ask for the model payload of their customer's group as of their date; payloads come with line items, several a day."""
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('s', o_custkey % 40) AS signature", "CASE WHEN o_orderkey % 50 > 0 THEN concat('v', o_orderkey % 2 + 1) END AS prompt_version", "cast(o_orderdate AS timestamp) AS run_at")
    payloads = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_quantity", "l_partkey")).alias("m"))
    payloads = payloads.where("m.l_quantity > 10").selectExpr("concat('s', m.l_partkey % 45) AS signature", "concat('v', l_linenumber % 3 + 1) AS prompt_version", "cast(m.l_shipdate AS timestamp) AS created_at", "l_orderkey * 10 + l_linenumber AS sequence", "concat('{\"score\": ', cast(m.l_quantity AS int), '}') AS payload")
    met = extraction.payloads_as_of(rows, payloads, hot_rows=200)
    return met.select("o_orderkey", "signature", "prompt_version", "payload", F.col("payload_at").cast("date").alias("payload_at"))


PAYLOAD_AS_OF = """WITH r AS (SELECT o_orderkey, 's' || (o_custkey % 40) AS signature, CASE WHEN o_orderkey % 50 > 0 THEN 'v' || (o_orderkey % 2 + 1) END AS prompt_version, o_orderdate::timestamp AS run_at FROM orders),
g AS (SELECT l_orderkey, l_linenumber, max({'d': l_shipdate, 'q': l_quantity, 'p': l_partkey}) AS m FROM lineitem GROUP BY ALL),
p AS (SELECT 's' || (m.p % 45) AS signature, 'v' || (l_linenumber % 3 + 1) AS prompt_version, m.d::timestamp AS created_at, l_orderkey * 10 + l_linenumber AS sequence, '{"score": ' || m.q::int || '}' AS payload FROM g WHERE m.q > 10)
SELECT o_orderkey, r.signature, r.prompt_version, arg_max(payload, {'c': created_at, 's': sequence}) AS payload, max(created_at)::date AS payload_at
FROM r LEFT JOIN p ON r.signature = p.signature AND r.prompt_version = p.prompt_version AND p.created_at <= r.run_at GROUP BY ALL"""


def keyset_pages(spark, sf_dir):
    """The third page of ten log lines of every job, newest first, by the places of a clustered table."""
    logs = adapter(spark, sf_dir, "logs")
    clustered = paging.cluster(logs.select("job_id", "id", "created_at", "level", "message"), "job_id", [F.desc_nulls_first("created_at"), F.desc("id")])
    return paging.pages(clustered, paging.bookmarks(clustered, "job_id", 10), "job_id", 2).select("job_id", "id", "level", "message")


KEYSET_PAGES = with_sql("logs") + "SELECT job_id, id, level, message FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC NULLS FIRST, id DESC) BETWEEN 21 AND 30"


def _maintained(spark, sf_dir):
    jobs = kpi.newest(adapter(spark, sf_dir, "totals"), 500).select("job_id", "status", "total_processed", "total_found", "total_failed", "total_skipped")
    rows = adapter(spark, sf_dir, "job_prospects").join(jobs.select("job_id"), "job_id", "left_semi").select("job_id", "prospect_id", "quality_status", "rejection_reason", "acceptance_decision", "contact_consistency_status", "raw_extraction", "part_id")
    rows, jobs = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows"), written(jobs, "jobs")
    store = Store(spark, new_folder(spark, "store"), maintained.tables(rows.schema, jobs.schema, ("job_id", "row_id"), 8))
    exclusions = _exclusions(spark, sf_dir)
    maintained.update(store, rows.where("part_id % 3 = 0"), jobs, exclusions, number=0)
    # the two later changes bring rows of some jobs only
    for n in (1, 2):
        maintained.update(store, rows.where(f"part_id % 3 = {n}"), jobs.limit(0), exclusions, number=n)
    return store


def maintained_operational(spark, sf_dir):
    """Operational metrics after three increments, out of summaries kept per job."""
    return maintained.operational_metrics(_maintained(spark, sf_dir))


QUERIES = {
    "commit_four_tables": (commit_four_tables, _save_sql()), "incremental_upserts": (incremental_upserts, INCREMENTAL_UPSERTS), "discovery_batches": (discovery_batches, DISCOVERY_BATCHES),
    "payload_as_of": (payload_as_of, PAYLOAD_AS_OF), "keyset_pages": (keyset_pages, KEYSET_PAGES), "maintained_operational": (maintained_operational, OPERATIONAL_METRICS),
}
