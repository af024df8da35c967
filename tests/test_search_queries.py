"""The search queries on small tables of their own."""

import pytest

from checks import queries
from webtrawl.operators import requests


@pytest.fixture
def small(spark, tmp_path):
    def page(title, text):
        return f"<html><head><title>{title}</title></head><body><p>{text}</p></body></html>"

    pages = [(0, "u0", page("Of the cat", "of the cat")), (1, "u1", page("Dog", "of the cat")), (2, "u2", page("", "x"))]
    events = [
        (0, "click", 1.0, '{"k": 5}'),  # the first page's title, from the second hit on
        (1, "view", 0.0, '{"k": 5}'),
        (2, "view", 0.0, '{"k": 5}'),
        (3, "error", 0.0, '{"k": 5}'),
        (4, "signup", 1.5, '{"k": 5}'),
        (6, "purchase", 0.0, '{"k": 50}'),
        (7, "purchase", 0.0, '{"k": 51}'),
    ]
    schema = "event_id bigint, event_type string, value double, props string"
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(events, schema).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_search_responses(spark, small):
    answers = dict(map(tuple, queries.search_responses(spark, small).collect()))
    assert answers == {
        0: '{"status":"ok","data":["u1"]}',
        1: '{"status":"ok","data":[]}',  # a title is no part of the text
        2: '{"status":"ok","data":[]}',
        3: '{"status":"q required","data":{}}',
        4: '{"status":"invalid literal for int() with base 10: \'1.5\'","data":{}}',
        6: '{"status":"ok","data":["u0","u1"]}',
        7: '{"status":"limit shoud be between 1 and 100","data":{}}',
    }
    hits = queries.search_batch(spark, small).select("request_id", "rank", "url").collect()
    assert sorted(map(tuple, hits)) == [(0, 2, "u1"), (6, 1, "u0"), (6, 2, "u1")]


def test_parameters_are_made_once(spark, small):
    """The check of a request names its parameters many times; they are read, not made each time."""
    accepted, _ = requests.split_by_status(requests.search_requests(queries._raw_requests(spark, small)))
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "<title>" not in plan
