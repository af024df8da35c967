"""Lines on many sites, against a plain count."""

from collections import defaultdict

from pyspark.sql import functions as F

from webtrawl.llm import line_spread

BLANKS = " \t\r\x0b\x0c\n"


def plain(rows, sites):
    spread = defaultdict(set)
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANKS):
                spread[line.strip(BLANKS)].add(source)
    found = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(spread[x.strip(BLANKS)]) < sites]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def sited_rows():
    """Lines on 1 to 60 sites, some repeated within their documents."""
    rows = []
    for site in range(60):
        lines = [f"line on {n}" for n in range(1, 61) if site < n]
        lines += [f"own {site}", "", "  ", f"\tline on 60 "] + lines[:2]
        rows.append((site, "\n".join(lines), None, f"site {site}" if site else None, None))
    return rows


def check(docs, rows, sites):
    got = line_spread.clean(docs, sites=sites).select("doc_id", "n_lines", "n_removed", "clean_text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, sites)


def test_awkward_rows(docs, rows):
    for sites in (1, 2, 3):
        check(docs, rows, sites)


def test_every_spread(spark):
    rows = sited_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for sites in (2, 8, 20, 59):
        check(docs, rows, sites)


def test_only_lines_near_the_threshold_are_counted(spark):
    """Without the exact count, no line near the threshold is found, and all others are."""
    docs = spark.createDataFrame(sited_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    slim = docs.select(F.col("doc_id").alias("mark"), F.col("source").alias("site"), "text")
    found = line_spread.spread(line_spread.lines_of(slim), 20, near=0.25).count()
    assert found == 41  # lines on 20 to 60 sites


def test_time_is_linear_in_lines(spark):
    """A document of very many lines, most of which go, is cleaned; a lookup by line would not end."""
    lines = [f"line {k}" for k in range(60_000)]
    text = "\n".join(x for k, x in enumerate(lines) for x in (x, f"own {k}", ""))
    frame = spark.createDataFrame([(k, text.replace("own", f"own{k}"), f"s{k}") for k in range(3)], "doc_id bigint, text string, source string")
    got = line_spread.clean(frame, sites=3).select("doc_id", "n_lines", "n_removed", "clean_text").collect()
    for r in got:
        assert (r.n_lines, r.n_removed) == (180_000, 60_000)
        assert r.clean_text == "\n".join(x for k in range(60_000) for x in (f"own{r.doc_id} {k}", ""))


def test_columns_stay(docs):
    assert line_spread.clean(docs).columns == [*docs.columns, "n_lines", "n_removed", "clean_text"]


def test_no_rows(nothing):
    assert line_spread.clean(nothing).collect() == []
