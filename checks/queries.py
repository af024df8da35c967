"""One query for each operator, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from webtrawl.functions import html, links
from webtrawl.operators import (
    accounts,
    pacing,
    replies,
    requests,
    search,
    stats,
    tables,
    tasks,
)
from webtrawl.plans import accounts as account_plans
from webtrawl.plans import crawl, index, responses
from webtrawl.plans import search as search_plans
from webtrawl.plans import tasks as task_plans
from webtrawl.schemas import CRAWLER_STATS, Field, Table
from webtrawl.sources import messages, pages as page_source
from webtrawl.sources import tables as stored_tables
from webtrawl.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
PHRASE = "of the"
AUDIT_SECONDS = 7200
POSTING_BUCKETS = 16

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.spread(inputs.table(spark, sf_dir, "pages"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of the newest version of each page."""
    outdated = page_source.outdated_versions(inputs.table(spark, sf_dir, "pages"), "page_id")
    return index.documents_of(page_source.drop_versions(_pages(spark, sf_dir), outdated, "page_id"))


# Pages: text, links, tokens


@query
def page_text(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", html.page_text(F.col("html")).alias("content")
    )


@query
def page_text_decoded(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", html.page_text(F.col("html"), decode=True).alias("content")
    )


@query
def page_text_exact(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", html.exact_text(F.col("html"))["content"].alias("content")
    )


@query
def page_links(spark, sf_dir):
    root = links.url_root(F.col("url"))
    found = html.page_hrefs(F.col("html"))
    return _pages(spark, sf_dir).select(
        root.alias("root"),
        F.col("url").alias("src"),
        F.explode(links.page_links(found, root)).alias("dst"),
    )


@query
def normalize_links(spark, sf_dir):
    return (
        inputs.snapshot(spark, sf_dir)
        .select("site", "url", F.posexplode("hrefs").alias("pos", "href"))
        .select("url", "pos", "href", links.absolute_link(F.col("href"), F.col("site")).alias("link"))
    )


@query
def page_tokens(spark, sf_dir):
    return search.postings(search.tokenise(_documents(spark, sf_dir))).drop("n_tokens")


@query
def term_document_frequency(spark, sf_dir):
    return search.document_frequency(search.tokenise(_documents(spark, sf_dir)))


# Search


@query
def search_phrase(spark, sf_dir):
    path = scratch_path(spark, "index")
    built = index.build_index(_documents(spark, sf_dir), path, POSTING_BUCKETS)
    return search_plans.search_phrase(built, PHRASE, size=10, start=5)


def _raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written out: the check names each parameter many times, and each would be made anew.
    return materialize(inputs.search_requests(spark, sf_dir), "requests")


@query
def search_batch(spark, sf_dir):
    documents = materialize(search.tokenise(_documents(spark, sf_dir)), "tokens")
    hits, _ = search_plans.search_batch(documents, _raw_requests(spark, sf_dir))
    return hits


@query
def search_responses(spark, sf_dir):
    documents = materialize(search.tokenise(_documents(spark, sf_dir)), "tokens")
    checked = requests.search_requests(_raw_requests(spark, sf_dir))
    accepted, _ = requests.split_by_status(checked)
    return responses.search_responses(checked, search.search_requests(documents, accepted))


# Crawl


@query
def fetch_snapshot(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    root = links.url_root(F.col("url"))
    linked = pages.select(
        F.explode(links.page_links(html.page_hrefs(F.col("html")), root)).alias("url")
    )
    frontier = pages.select("url").unionByName(linked).distinct()
    sizes = pages.select("url", F.char_length("html").alias("n_chars"))
    fetched, failed = page_source.fetch(frontier, sizes)
    return fetched.withColumn("state", F.lit("fetched")).unionByName(
        failed.withColumn("state", F.lit("failed")), allowMissingColumns=True
    )


@query
def frontier_new_links(spark, sf_dir):
    snapshot = materialize(inputs.snapshot(spark, sf_dir).withColumnRenamed("site", "root"), "snapshot")
    return crawl.new_links(snapshot, snapshot.select("root", "url"))


@query
def crawl_frontier(spark, sf_dir):
    """From the first page of each root."""
    snapshot = materialize(inputs.snapshot(spark, sf_dir), "snapshot")
    seeds = snapshot.where("place = 1").select(F.col("site").alias("root"), "url")
    return crawl.crawl(seeds, snapshot.select("url", "hrefs"))


@query
def fair_fetch_order(spark, sf_dir):
    log = inputs.fetch_log(spark, sf_dir).select("root", "url", "ts", "event_id")
    return pacing.fair_order(log, ["ts", "event_id"])


# Pacing and statistics


@query
def rate_limit_audit(spark, sf_dir):
    log = inputs.fetch_log(spark, sf_dir).select("event_id", "root", "ts")
    return pacing.rate_audit(log, AUDIT_SECONDS)


@query
def rate_limited_schedule(spark, sf_dir):
    log = inputs.fetch_log(spark, sf_dir).select("event_id", "root", "ts")
    return pacing.paced_schedule(log, "event_id", AUDIT_SECONDS)


@query
def crawl_page_counts(spark, sf_dir):
    return stats.page_counts(inputs.fetch_log(spark, sf_dir))


@query
def crawl_time_stats(spark, sf_dir):
    return stats.time_stats(inputs.fetch_log(spark, sf_dir))


@query
def crawl_progress(spark, sf_dir):
    return stats.progress(inputs.fetch_log(spark, sf_dir), ["ts", "event_id"])


@query
def crawl_status(spark, sf_dir):
    """A page counts as fetched when its last fetch was no error."""
    log = inputs.fetch_log(spark, sf_dir)
    last = log.groupBy("root", "url").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    frontier = inputs.table(spark, sf_dir, "pages").select(
        links.url_root(F.col("url")).alias("root"), "url"
    )
    return stats.crawl_status(frontier, last.where(F.col("last") != "error"))


# Accounts


@query
def latest_token(spark, sf_dir):
    return accounts.latest_token(inputs.logins(spark, sf_dir))


@query
def token_lifetimes(spark, sf_dir):
    return accounts.token_lifetimes(inputs.logins(spark, sf_dir))


@query
def token_validity_asof(spark, sf_dir):
    lifetimes = accounts.token_lifetimes(inputs.logins(spark, sf_dir))
    return accounts.token_validity(inputs.requests(spark, sf_dir), lifetimes)


def _account_inputs(spark, sf_dir):
    return inputs.tokens(spark, sf_dir), inputs.users(spark, sf_dir)


@query
def validate_token(spark, sf_dir):
    return accounts.validate_tokens(
        inputs.requests(spark, sf_dir), *_account_inputs(spark, sf_dir)
    )


@query
def authorize_requests(spark, sf_dir):
    return accounts.authorize(inputs.requests(spark, sf_dir), *_account_inputs(spark, sf_dir))


@query
def index_responses(spark, sf_dir):
    return responses.index_responses(
        inputs.index_requests(spark, sf_dir), inputs.tokens(spark, sf_dir), inputs.users(spark, sf_dir)
    )


@query
def stat_answers(spark, sf_dir):
    return responses.stat_answers(
        inputs.requests(spark, sf_dir),
        inputs.tokens(spark, sf_dir),
        inputs.users(spark, sf_dir),
        inputs.stats(spark, sf_dir),
    )


@query
def current_responses(spark, sf_dir):
    return responses.current_responses(
        inputs.requests(spark, sf_dir), *_account_inputs(spark, sf_dir)
    )


@query
def user_crawl_stats(spark, sf_dir):
    allowed = accounts.authorize(inputs.requests(spark, sf_dir), *_account_inputs(spark, sf_dir))
    return accounts.caller_stats(allowed, inputs.stats(spark, sf_dir))


@query
def signup_conflicts(spark, sf_dir):
    return accounts.signup_conflicts(inputs.signups(spark, sf_dir), inputs.users(spark, sf_dir))


@query
def signup_batch(spark, sf_dir):
    return account_plans.signup_batch(inputs.signups(spark, sf_dir), inputs.users(spark, sf_dir))


@query
def login_batch(spark, sf_dir):
    emails = inputs.logins(spark, sf_dir).withColumn("email", inputs.login_email(F.col("user_id") * 2))
    return account_plans.login_batch(emails, inputs.users(spark, sf_dir))


# Requests, tasks, messages


@query
def validate_signup_request(spark, sf_dir):
    return inputs.account_requests(spark, sf_dir).select(
        "request_id", requests.signup_status().alias("status")
    )


@query
def validate_login_request(spark, sf_dir):
    return inputs.account_requests(spark, sf_dir).select(
        "request_id", requests.login_status().alias("status")
    )


@query
def validate_search_request(spark, sf_dir):
    return requests.search_requests(inputs.search_requests(spark, sf_dir))


@query
def validate_index_request(spark, sf_dir):
    return inputs.index_requests(spark, sf_dir).select(
        "request_id", requests.index_status().alias("status")
    )


@query
def route_index_requests(spark, sf_dir):
    return task_plans.route_index_requests(
        inputs.index_requests(spark, sf_dir), *_account_inputs(spark, sf_dir)
    )


@query
def recrawl_filter(spark, sf_dir):
    return tasks.recrawl_filter(inputs.stats(spark, sf_dir), inputs.as_of())


@query
def classify_protocol(spark, sf_dir):
    return tasks.classify_protocol(inputs.tasks(spark, sf_dir).select("task_id", "domain"))


@query
def route_crawl_tasks(spark, sf_dir):
    return tasks.route_tasks(
        inputs.tasks(spark, sf_dir), inputs.stats(spark, sf_dir), inputs.as_of()
    )


@query
def rpc_timeouts(spark, sf_dir):
    return replies.match_replies(
        inputs.rpc_requests(spark, sf_dir), inputs.rpc_replies(spark, sf_dir)
    )


@query
def parse_messages(spark, sf_dir):
    parsed = messages.parse_messages(inputs.messages(spark, sf_dir))
    kind = F.when(~F.col("malformed"), F.col("message.type"))
    fields = [
        F.when(~F.col("malformed"), c).alias(name)
        for c, name in zip(messages.task_fields(), ["domain", "author_id"], strict=True)
    ]
    return parsed.select("message_id", "malformed", kind.alias("type"), *fields)


# Tables


@query
def table_all(spark, sf_dir):
    path = f"{sf_dir}/supplier.parquet"
    fields = [Field(f.name, f.dataType) for f in spark.read.parquet(path).schema]
    return stored_tables.scan(spark, Table("supplier", tuple(fields)), path)


@query
def table_filter(spark, sf_dir):
    return tables.filter_rows(
        inputs.table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=7
    )


@query
def table_get(spark, sf_dir):
    """The first machinery customer of each supplier's nation."""
    suppliers = inputs.table(spark, sf_dir, "supplier")
    wanted = suppliers.select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    customers = inputs.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    return tables.get_rows(wanted, customers, ["c_nationkey"], "c_custkey")


@query
def table_update(spark, sf_dir):
    return tables.update_rows(
        inputs.table(spark, sf_dir, "customer"), {"c_acctbal": 0.0}, c_mktsegment="BUILDING"
    )


@query
def table_delete(spark, sf_dir):
    return tables.delete_rows(inputs.table(spark, sf_dir, "customer"), c_mktsegment="BUILDING")


@query
def table_upsert(spark, sf_dir):
    """Each order is a change of its customer's balance; suppliers come in as new customers."""
    customers = inputs.table(spark, sf_dir, "customer")
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.lit(0).alias("c_nationkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_orderkey").alias("version"),
    )
    suppliers = inputs.table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
        F.col("s_suppkey").alias("version"),
    )
    return tables.upsert(customers, orders.unionByName(suppliers), ["c_custkey"], ["version"])


@query
def table_delete_by_key(spark, sf_dir):
    keys = inputs.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return tables.delete_by_key(
        inputs.table(spark, sf_dir, "customer"),
        keys.select(F.col("o_custkey").alias("c_custkey")),
        ["c_custkey"],
    )


@query
def table_validate(spark, sf_dir):
    nation = F.col("c_nationkey")
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.expr("repeat(c_name, c_nationkey)").alias("domain"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("status"),
        F.col("c_custkey").alias("author_id"),
        F.when(nation % 2 == 0, 1).alias("https"),
        F.when(F.col("c_acctbal") >= 0, inputs.as_of()).alias("time"),
    )
    return tables.validate(rows, CRAWLER_STATS).select(
        "author_id", "status", "https", "pages_count", "violation"
    )


@query
def assign_ids(spark, sf_dir):
    """Orders get the ids that follow the customers' greatest key."""
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    customers = inputs.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return tables.assign_ids(customers, orders, "id", ["o_orderdate", "o_orderkey"])
