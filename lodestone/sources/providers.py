"""Search providers as offline sources: raw result tables, result pages in HTML or JSON, fetch logs, the chain of providers.

Live crawling, evasion of blocks and outbound calls are not part of the engine; what a crawler brings in arrives as tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qs, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import any_in
from .html import Reader

#: Fixed values.
HIT_SCHEMA = "url string, query string, position int, title string, snippet string, discovery_confidence string, business_likeness_score double, website_result_score double, social_profile_score double, result_kind string, discovery_reasons array<string>, seed_source_url string, seed_source_type string"
PROVIDER_ALIASES = {"brave_api": "brave_api", "duckduckgo_html": "duckduckgo", "ddg_html": "duckduckgo", "duckduckgo": "duckduckgo", "google_html": "google", "google": "google"}
CREATIVE_ROLES = ["editor", "video", "videographer", "creative", "creador", "designer", "diseñador", "developer", "desarrollador", "marketing", "web", "seo", "fotograf", "photograph", "community manager", "social media"]
CHALLENGES = ["anomaly.js", "challenge-form", "cc=botnet", 'id="challenge-form"']
BLOCK_TOKENS = ["/sorry/", "detected unusual traffic", "captcha", "recaptcha"]
BLOCKED_FAILURES = ["rate_limit", "anti_bot_challenge", "google_captcha"]
DEMO_URLS = ["https://example.com", "https://example.org", "https://example.net"]
MOST_RAW_HITS = 15
LEAST_SNIPPET = 20
MOST_ATTEMPTS = 3


def provider_order(value: str | None, default: tuple[str, ...] = ("duckduckgo",)) -> list[str]:
    """Configured providers in order; unknown names are skipped."""
    names = [x.strip().lower() for x in value.split(",") if x.strip()] if value else list(default)
    return [PROVIDER_ALIASES[n] for n in names if n in PROVIDER_ALIASES]


def allows_social(profession: str) -> str:
    return any_in(f"lower(coalesce({profession}, ''))", CREATIVE_ROLES)


def provider_chain(hits: DataFrame, order: list[str], key: str = "job_id") -> DataFrame:
    """Hits of the first provider, in order, that has any kept hit for the job."""
    rank = F.expr("CASE provider " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(order)) + " END")
    rated = hits.withColumn("rank_", rank).where(F.col("rank_").isNotNull() & F.col("exclusion_reason").isNull() & F.col(key).isNotNull())
    first = rated.withColumn("first_", F.min("rank_").over(Window.partitionBy(key)))
    return first.where("rank_ = first_").drop("rank_", "first_")


def demo_hits(jobs: DataFrame, most: int = 10) -> DataFrame:
    """Stand-in hits of jobs(job_id, query) for which no provider is at hand: the demo URLs in order, at most so many each."""
    urls_ = F.array(*map(F.lit, DEMO_URLS[:most]))
    rows = jobs.select("job_id", "query", F.posexplode(urls_).alias("pos_", "url"))
    return rows.select("job_id", "url", "query", (F.col("pos_") + 1).alias("position"), F.lit("Demo result").alias("title"), F.lit("low").alias("discovery_confidence"))


def seed_hits(jobs: DataFrame, urls: str = "seed_urls", cap: str = "max_candidates_to_process") -> DataFrame:
    """Hits out of seed URLs given with a job, cut at its cap."""
    rows = jobs.select("job_id", F.posexplode(urls).alias("pos", "url"), F.col(cap).alias("cap_"))
    return rows.where("pos < cap_").select("job_id", "url", (F.col("pos") + 1).alias("position"), F.lit("high").alias("discovery_confidence"), F.lit("seed_url").alias("source_type"))


def json_hits(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits out of JSON result pages: web.results[] of url, title, description, in their order."""
    results = F.from_json(F.get_json_object(payload, "$.web.results"), "array<struct<url:string,title:string,description:string>>")
    others = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*others, F.posexplode(results).alias("ordinal", "r"))
    return rows.select(*others, "ordinal", F.trim("r.url").alias("url"), F.col("r.title").alias("title"), F.col("r.description").alias("snippet"))


def unwrap(url: str) -> str:
    """Target of a redirecting result link."""
    url = url.strip()
    if url.startswith("//duckduckgo.com"):
        target = parse_qs(urlparse(url).query).get("uddg")
        return target[0] if target else url
    return url


class _Results(Reader):
    """Result blocks of a result page: nodes of class `result` (links by class) or `g` (first link, h3 title), or where no node has
    class `g`, those with the attribute data-sokoban-container."""

    def __init__(self):
        super().__init__()
        self.blocks: list[dict] = []
        self.depth: list[tuple[int, dict]] = []
        self.pieces: list[tuple[int, list]] = []  # titles, snippets and texts that are open, with their level; `sinks` are the reader's own

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        level = len(self.open)
        own = "result" in classes or (tag == "div" and ("g" in classes or "data-sokoban-container" in values))
        if own:
            block = {"plain": "result" in classes, "kind": "result" if "result" in classes else "g" if "g" in classes else "spare", "url": None, "link": None, "title": [], "snippet": [], "texts": []}
            self.blocks.append(block)
            self.depth.append((level, block))
        if not self.depth:
            return
        block = self.depth[-1][1]
        href = values.get("href")
        if tag == "a" and href:
            if "result__url" in classes:
                block["url"] = href
            elif block["link"] is None:
                block["link"] = href
        if tag == "h3" or "result__title" in classes or "result__a" in classes and not block["title"]:
            self.pieces.append((level, block["title"]))
        elif "result__snippet" in classes:
            self.pieces.append((level, block["snippet"]))
        elif not block["plain"] and not own and tag in ("div", "span"):
            style = values.get("style") or ""
            likely = "data-sncf" in values or "VwiC3b" in classes or "line-clamp" in style if tag == "div" else "st" in (values.get("class") or "")
            block["texts"].append((likely, []))
            self.pieces.append((level, block["texts"][-1][1]))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        level = len(self.open)
        self.pieces = [s for s in self.pieces if s[0] <= level]
        self.depth = [d for d in self.depth if d[0] <= level]

    def handle_data(self, data):
        super().handle_data(data)
        if text := data.strip():
            for sink in {id(s): s for _, s in self.pieces}.values():
                sink.append(text)


def read_results(html: str | None) -> list[dict]:
    reader = _Results()
    reader.feed(html or "")
    reader.close()
    out = []
    blocks = reader.blocks
    if any(b["kind"] == "g" for b in blocks):
        blocks = [b for b in blocks if b["kind"] != "spare"]
    for b in blocks:
        url = unwrap(b["url"] or b["link"] or "")
        if not b["plain"] and (not url.startswith("http") or "google" in (urlparse(url).hostname or "")):
            continue
        title = " ".join(b["title"])
        texts = [(likely, " ".join(t)) for likely, t in b["texts"]]
        # the longest text of the kinds that hold snippets, else the first of some length
        snippet = " ".join(b["snippet"]) or max((t for likely, t in texts if likely), key=len, default="") or next((t for _, t in texts if t != title and len(t) > LEAST_SNIPPET), "")
        out.append({"ordinal": len(out), "url": url, "title": title, "snippet": snippet})
    return out


def html_hits(pages: DataFrame, html: str = "html", query: str = "query") -> DataFrame:
    """Hits out of result pages in HTML: query, ordinal, url, title, snippet."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [(q, r) for q, h in zip(batch.column("q").to_pylist(), batch.column("h").to_pylist(), strict=True) for r in read_results(h)]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.string()), *(pa.array([r[k] for _, r in rows], t) for k, t in (("ordinal", pa.int32()), ("url", pa.string()), ("title", pa.string()), ("snippet", pa.string())))], ["query", "ordinal", "url", "title", "snippet"])

    return pages.select(F.col(query).cast("string").alias("q"), F.col(html).cast("string").alias("h")).mapInArrow(work, "query string, ordinal int, url string, title string, snippet string")


def challenged(status: str, html: str) -> str:
    """Whether a response is a challenge page."""
    return f"({status} = 202 AND {any_in(f'lower({html})', CHALLENGES)})"


def blocked_page(status: str, html: str) -> str:
    """Whether a response of the other HTML provider is a block page: by status, or by a token at any status."""
    return f"coalesce({status} = 429 OR {any_in(f'lower({html})', BLOCK_TOKENS)}, false)"


def search_error(found: str, message: str) -> str:
    """Why a query brought nothing: no results, or by the text of the error; null if it brought some."""
    low = f"lower({message})"
    return (
        f"CASE WHEN {message} IS NULL AND {found} > 0 THEN NULL WHEN {message} IS NULL THEN 'no_results' WHEN contains({low}, 'ratelimit') OR contains({low}, '429') THEN 'rate_limit'"
        f" WHEN contains({low}, 'timeout') THEN 'timeout' ELSE 'unexpected_error' END"
    )


def discover(hits: DataFrame, runs: DataFrame, order: list[str], key: str = "job_id", demo: bool = False) -> DataFrame:
    """One row per job: the provider that wins, its status, the failure of the last one asked, warnings and counts.

    hits: key, provider, url, exclusion_reason. runs: key, provider, warning, failure_reason, one row for each provider a job could
    ask. Providers are asked in order until one has a kept hit; warnings and exclusions of those asked add up.
    """
    rank = F.expr("CASE provider " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(order)) + " END")
    counts = hits.groupBy(key, "provider").agg(F.count_if(F.col("exclusion_reason").isNull()).alias("kept"), F.count_if(F.col("exclusion_reason").isNotNull()).alias("excluded"))
    rated = runs.join(counts, [key, "provider"], "left").withColumn("rank_", rank).where("rank_ IS NOT NULL")
    won = rated.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("kept") > 0, F.col("rank_"))), F.max("rank_")).alias("last_"))
    asked = rated.join(won, key).where("rank_ <= last_")
    # at most one row for each provider, so the list is short
    warnings = F.expr("array_join(transform(array_sort(collect_list(CASE WHEN warning <> '' THEN struct(rank_, warning) END)), w -> w.warning), '; ')")
    df = asked.groupBy(key).agg(warnings.alias("warning"), F.sum(F.coalesce("excluded", F.lit(0))).alias("n_excluded"), F.max_by(F.struct("provider", F.coalesce("kept", F.lit(0)).alias("kept"), "failure_reason"), "rank_").alias("last_"))
    blocked = ", ".join(f"'{f}'" for f in BLOCKED_FAILURES)
    empty = "last_.kept = 0"
    status = f"CASE WHEN NOT ({empty}) THEN 'ok' WHEN last_.failure_reason IN ({blocked}) THEN 'blocked' ELSE 'no_results' END"
    provider = f"CASE WHEN {empty} AND {str(demo).lower()} THEN 'demo' ELSE last_.provider END"
    return df.select(
        key, F.expr(provider).alias("provider"), F.expr(f"CASE WHEN {empty} AND {str(demo).lower()} THEN 'ok' ELSE {status} END").alias("provider_status"),
        F.expr(f"CASE WHEN {empty} THEN coalesce(last_.failure_reason, 'no_results') END").alias("failure_reason"), F.expr("nullif(warning, '')").alias("warning"), F.expr("last_.kept").alias("n_kept"), "n_excluded",
    )


# ---- fetch log ----


def fetch_error(status: str, cause: str = "cast(NULL AS string)") -> str:
    """Type of a failed fetch by status code, else by cause (timeout, tls, dns, other)."""
    return (
        f"CASE WHEN {status} = 403 THEN 'http_403' WHEN {status} = 429 THEN 'http_429' WHEN {status} BETWEEN 500 AND 599 THEN 'http_5xx' WHEN {status} IS NOT NULL AND {status} NOT BETWEEN 200 AND 299 THEN 'http_4xx'"
        f" WHEN {status} IS NULL AND {cause} = 'timeout' THEN 'timeout' WHEN {status} IS NULL AND {cause} = 'tls' THEN 'tls_error' WHEN {status} IS NULL AND {cause} = 'dns' THEN 'dns_error' WHEN {status} IS NULL THEN 'network_error' END"
    )


def retryable(error: str) -> str:
    return f"coalesce({error} IN ('http_429', 'http_5xx', 'timeout', 'network_error'), false)"


def retry_after(header: str) -> str:
    """Seconds of a Retry-After header; null for dates, junk and negative numbers."""
    return f"CASE WHEN try_cast({header} AS double) >= 0 THEN try_cast({header} AS double) END"


def backoff(error: str, header: str, attempt: str, base: float = 1.0) -> str:
    """Delay before the next attempt without jitter: the server's wish, else doubling from the base."""
    wish = f"CASE WHEN {error} = 'http_429' THEN {retry_after(header)} END"
    return f"coalesce({wish}, {max(base, 0.0)}D * power(2D, {attempt} - 1))"


def next_attempt(log: DataFrame, base: float = 1.0) -> DataFrame:
    """Adds error_type, retryable, delay_seconds and will_retry to a log of fetches (status, cause, retry_after, attempt)."""
    df = log.withColumn("error_type", F.expr(fetch_error("status", "cause")))
    df = df.withColumn("retryable", F.expr(retryable("error_type")))
    df = df.withColumn("will_retry", F.expr(f"retryable AND attempt < {MOST_ATTEMPTS}"))
    return df.withColumn("delay_seconds", F.expr(f"CASE WHEN will_retry THEN {backoff('error_type', 'retry_after', 'attempt', base)} END"))


# ---- Python data source: the extension point for other providers ----


class _Part(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class _HitReader(DataSourceReader):
    def __init__(self, options):
        self.queries = [q for q in (options.get("queries") or "").split("|") if q]
        self.most = int(options.get("limit", MOST_RAW_HITS))
        self.site = options.get("site", "https://example.com/")

    def partitions(self):
        return [_Part(q) for q in self.queries] or [_Part("")]

    def read(self, partition):
        for i in range(self.most if partition.query else 0):
            yield partition.query, i, urljoin(self.site, f"{partition.query.replace(' ', '-')}/{i}"), f"{partition.query} {i}", ""


class _HitStream(DataSourceStreamReader):
    """Queries in their order as a stream; the offset is the number of queries read, so a restart goes on behind the last whole batch."""

    def __init__(self, options):
        self.batch = _HitReader(options)
        self.most = int(options.get("queriesPerBatch", 100))
        self.sent = 0

    def initialOffset(self):
        return {"queries": 0}

    def latestOffset(self):
        self.sent = min(len(self.batch.queries), self.sent + self.most)
        return {"queries": self.sent}

    def partitions(self, start, end):
        self.sent = max(self.sent, end["queries"])
        return [_Part(q) for q in self.batch.queries[start["queries"] : end["queries"]]]

    def read(self, partition):
        return self.batch.read(partition)

    def commit(self, end):
        """Nothing is held back for a repeat: a query's hits can be asked for again."""


class HitSource(DataSource):
    """Template of a search provider as a data source: one partition per query, in a batch or as a stream. Register with spark.dataSource.register.

    A provider overrides the reader's read(); this one makes deterministic rows for tests.
    """

    @classmethod
    def name(cls):
        return "lodestone_hits"

    def schema(self):
        return "query string, ordinal int, url string, title string, snippet string"

    def reader(self, schema):
        return _HitReader(self.options)

    def streamReader(self, schema):
        return _HitStream(self.options)
