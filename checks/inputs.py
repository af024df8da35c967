"""Inputs of the checked queries, derived by Spark from the given tables.

Each function takes (spark, sf_dir); ``checks.oracle`` derives the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.functions.html import page_hrefs
from webtrawl.functions.links import https_flag, url_root
from webtrawl.functions.times import expiry, seconds, to_second
from webtrawl.operators.ordered import next_value, rank_rows
from webtrawl.sources.pages import spread
from webtrawl.sources.scratch import materialize

AS_OF = "2024-01-31 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_events(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Every event with one of the pages: page ids run from 0 without gaps."""
    pages = table(spark, sf_dir, "pages")
    count = pages.count()
    events = table(spark, sf_dir, "events").withColumn("page_id", F.col("event_id") % count)
    return events.join(pages.select("page_id", *columns), "page_id")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch for each event, its duration in whole milliseconds."""
    return page_events(spark, sf_dir, "url").select(
        "event_id",
        "user_id",
        "event_type",
        url_root(F.col("url")).alias("root"),
        "url",
        "ts",
        F.round(F.col("value") * 100).alias("duration"),
    )


def login_email(user_id):
    return F.concat(F.lit("user"), user_id.cast("string"), F.lit("@example.com"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    return clicks.select(
        "user_id",
        "event_id",
        F.col("ts").alias("issued"),
        F.md5(F.concat_ws(":", "user_id", "event_id")).alias("token"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logins(spark, sf_dir).select(
        "token", "user_id", expiry(F.col("issued")).alias("expire_date")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each event: some with a good token, some with a wrong one or none."""
    click = F.col("event_type") == "click"
    later = F.col("ts") + seconds(F.floor(F.col("value") * 600))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(click, F.md5(F.concat_ws(":", "user_id", "event_id")))
        .when(F.col("event_type") != "purchase", F.md5(F.concat(F.lit("x:"), "event_id")))
        .alias("token"),
        F.when(click, later).otherwise(F.col("ts")).alias("ts"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    signup = F.when(F.col("event_type") == "signup", F.col("ts"))
    click = F.when(F.col("event_type") == "click", F.col("ts"))
    return (
        events.groupBy("user_id")
        .agg(F.min(signup).alias("created"), F.max(click).alias("visited"))
        .where(F.col("created").isNotNull())
        .select(
            F.col("user_id").cast("int").alias("id"),
            login_email(F.col("user_id")).alias("email"),
            F.concat(F.lit("name"), F.col("user_id").cast("string")).alias("name"),
            to_second(F.col("created")).alias("created_date"),
            to_second(F.coalesce("visited", "created")).alias("last_login_date"),
        )
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fetch_log(spark, sf_dir)
        .groupBy(F.col("root").alias("domain"), F.col("user_id").cast("int").alias("author_id"))
        .agg(F.max("ts").alias("last"), F.count(F.lit(1)).cast("int").alias("pages_count"))
        .select(
            "domain",
            F.when(F.col("pages_count") > 1, "Done").otherwise("Crawling").alias("status"),
            "author_id",
            https_flag(F.col("domain")).alias("https"),
            to_second(F.col("last")).alias("time"),
            "pages_count",
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl task for each event; errors and sign-ups name the domain without its protocol."""
    bare = F.regexp_replace("root", "^https?://", "")
    return fetch_log(spark, sf_dir).select(
        F.col("event_id").alias("task_id"),
        F.when(F.col("event_type").isin("error", "signup"), bare).otherwise(F.col("root")).alias("domain"),
        F.col("user_id").cast("int").alias("author_id"),
        "ts",
    )


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        login_email(key % 700).alias("email"),
        F.concat(F.lit("name"), (key * 7 % 900).cast("string")).alias("name"),
    )


def rpc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("correlation_id"),
        "ts",
        F.col("props").alias("body"),
    )


def rpc_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors get no reply; views get a second one a second later."""
    delay = F.floor(F.col("value") % 10)
    answered = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    delays = F.when(F.col("event_type") == "view", F.array(delay, delay + 1)).otherwise(F.array(delay))
    return answered.withColumn("delay", F.explode(delays)).select(
        F.col("event_id").cast("string").alias("correlation_id"),
        (F.col("ts") + seconds(F.col("delay"))).alias("ts"),
        F.concat_ws(":", F.lit("reply"), "event_id", "delay").alias("body"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task messages in both shapes, and bodies cut short."""
    data = F.concat(
        F.lit('{"type": "crawl", "data": {"domain": "'),
        "root",
        F.lit('", "author_id": '),
        F.col("user_id").cast("string"),
        F.lit("}}"),
    )
    index = F.concat(
        F.lit('{"type": "index", "index": {"domain": "'),
        F.regexp_replace("root", "^https?://", ""),
        F.lit('", "https": '),
        F.when(F.col("root").startswith("https"), "true").otherwise("false"),
        F.lit("}}"),
    )
    kind = F.col("event_type")
    return fetch_log(spark, sf_dir).select(
        F.col("event_id").alias("message_id"),
        F.when(kind == "view", index)
        .when(kind == "error", F.concat(F.lit('{"type": "crawl", '), "url"))
        .otherwise(data)
        .alias("body"),
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event: the title of its page, with good and bad paging."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    pages = table(spark, sf_dir, "pages")
    titled = spread(pages).select("page_id", title.alias("title"))
    count = pages.count()
    events = table(spark, sf_dir, "events").withColumn("page_id", F.col("event_id") % count)
    return events.join(titled, "page_id").select(
        F.col("event_id").alias("request_id"),
        F.when(kind != "error", F.col("title")).alias("q"),
        F.when(kind == "signup", F.col("value").cast("string"))
        .when(kind == "purchase", (k.cast("int") * 2).cast("string"))
        .otherwise(k)
        .alias("limit"),
        F.when(kind == "view", "-1")
        .otherwise((F.floor("value") % 4).cast("string"))
        .alias("offset"),
    )


def account_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up and login parameters, some missing; the password is only there or not."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_name")).alias("email"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("given")).alias("password"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
    )


def index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = fetch_log(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") != "view", F.col("root")).alias("domain"),
    )
    return domains.join(requests(spark, sf_dir), "request_id")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, hrefs, place): the given pages with their links, by root.

    No href of the given HTML leads to a given page, so each page also gets links
    to the two that follow it under its root, in several forms, to its root, and
    outside.  ``place`` is its place under its root, by page_id.
    """
    pages = spread(table(spark, sf_dir, "pages")).select(
        "page_id", url_root(F.col("url")).alias("site"), "url", page_hrefs(F.col("html")).alias("found")
    )
    placed = rank_rows(materialize(pages, "links"), ["site"], ["page_id"], "place")
    following = next_value(placed, ["site"], ["place"], "url", "next")
    following = next_value(following, ["site"], ["place"], "next", "after")
    path = F.substring("after", F.char_length("site") + 2, F.char_length("after"))
    made = F.array(
        F.concat("next", F.lit("#top")),
        F.concat(F.lit("old/../"), path),
        F.col("site"),
        F.lit("https://elsewhere.example/p1"),
    )
    return following.select("site", "url", F.concat("found", F.array_compact(made)).alias("hrefs"), "place")
