"""The checked queries in SQL, written independently of the Spark side."""

from __future__ import annotations

from checks.inputs import AS_OF
from checks.queries import AUDIT_SECONDS, PHRASE

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
ROOT = "regexp_extract(url, '^https?://[^/?#]+')"
BLANKS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}"
)
WORD = r"[\p{L}\p{M}\p{N}_]+"

# Derived inputs

FETCH_LOG = f"""
fetch_log AS (
  SELECT e.event_id, e.user_id, e.event_type, {ROOT} AS root, p.url, e.ts,
    round(e.value * 100) AS duration
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
)"""

LOGINS = """
logins AS (
  SELECT user_id, event_id, ts AS issued, md5(user_id::VARCHAR || ':' || event_id::VARCHAR) AS token
  FROM events WHERE event_type = 'click'
)"""

TOKENS = """
tokens AS (
  SELECT token, user_id, date_trunc('second', issued) + INTERVAL 1 DAY AS expire_date FROM logins
)"""

REQUESTS = """
requests AS (
  SELECT event_id AS request_id,
    CASE WHEN event_type = 'click' THEN md5(user_id::VARCHAR || ':' || event_id::VARCHAR)
         WHEN event_type = 'purchase' THEN NULL
         ELSE md5('x:' || event_id::VARCHAR) END AS token,
    CASE WHEN event_type = 'click' THEN ts + to_seconds(floor(value * 600)::BIGINT) ELSE ts END AS ts
  FROM events
)"""

USERS = """
users AS (
  SELECT user_id::INTEGER AS id, 'user' || user_id::VARCHAR || '@example.com' AS email,
    'name' || user_id::VARCHAR AS name,
    date_trunc('second', min(ts) FILTER (event_type = 'signup')) AS created_date,
    date_trunc('second', coalesce(max(ts) FILTER (event_type = 'click'),
                                  min(ts) FILTER (event_type = 'signup'))) AS last_login_date
  FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') > 0
)"""

STATS = """
stats AS (
  SELECT root AS domain, CASE WHEN count(*) > 1 THEN 'Done' ELSE 'Crawling' END AS status,
    user_id::INTEGER AS author_id, CASE WHEN root LIKE 'https://%' THEN 1 ELSE 0 END AS https,
    date_trunc('second', max(ts)) AS time, count(*)::INTEGER AS pages_count
  FROM fetch_log GROUP BY root, user_id
)"""

TASKS = """
tasks AS (
  SELECT event_id AS task_id,
    CASE WHEN event_type IN ('error', 'signup') THEN split_part(root, '://', 2) ELSE root END AS domain,
    user_id::INTEGER AS author_id, ts
  FROM fetch_log
)"""

SIGNUPS = """
signups AS (
  SELECT c_custkey AS seq, 'user' || (c_custkey % 700)::VARCHAR || '@example.com' AS email,
    'name' || (c_custkey * 7 % 900)::VARCHAR AS name
  FROM customer
)"""

NEWEST_STAT = """
newest AS (
  SELECT * FROM stats
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY time DESC, author_id) = 1
)"""

SEARCH_REQUESTS = r"""
raw_requests AS (
  SELECT e.event_id AS request_id,
    CASE WHEN event_type = 'error' THEN NULL
         ELSE regexp_extract(p.html, '(?is)<title>(.*?)</title>', 1) END AS q,
    CASE event_type WHEN 'signup' THEN value::VARCHAR
      WHEN 'purchase' THEN ((props::JSON ->> '$.k')::INTEGER * 2)::VARCHAR
      ELSE props::JSON ->> '$.k' END AS "limit",
    CASE WHEN event_type = 'view' THEN '-1' ELSE (floor(value)::BIGINT % 4)::VARCHAR END AS "offset"
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
),
checked AS (
  SELECT *, CASE WHEN q IS NULL THEN 'q required'
      WHEN "limit" IS NULL THEN 'limit required'
      WHEN "offset" IS NULL THEN 'offset required'
      WHEN NOT regexp_matches("limit", '^\s*[+-]?[0-9]+\s*$')
        THEN 'invalid literal for int() with base 10: ''' || "limit" || ''''
      WHEN NOT regexp_matches("offset", '^\s*[+-]?[0-9]+\s*$')
        THEN 'invalid literal for int() with base 10: ''' || "offset" || ''''
      WHEN TRY_CAST("limit" AS BIGINT) NOT BETWEEN 1 AND 100 THEN 'limit shoud be between 1 and 100'
      ELSE 'ok' END AS status
  FROM raw_requests
),
search_requests AS (
  SELECT *, CASE WHEN status = 'ok' THEN TRY_CAST("limit" AS INTEGER) END AS size,
    CASE WHEN status = 'ok' THEN greatest(TRY_CAST("offset" AS BIGINT), 0) END AS start
  FROM checked
)"""

INDEX_REQUESTS = """
index_requests AS (
  SELECT f.event_id AS request_id, CASE WHEN f.event_type <> 'view' THEN f.root END AS domain,
    r.token, r.ts
  FROM fetch_log f JOIN requests r ON r.request_id = f.event_id
)"""

ACCOUNT_REQUESTS = """
account_requests AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_name) END AS email,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'given' END AS password,
    CASE WHEN c_acctbal >= 0 THEN c_name END AS name
  FROM customer
)"""

SNAPSHOT = rf"""
numbered AS (
  SELECT {ROOT} AS site, url, html, row_number() OVER w AS place,
    lead(url, 1) OVER w AS next_url, lead(url, 2) OVER w AS after_url
  FROM pages WINDOW w AS (PARTITION BY {ROOT} ORDER BY page_id)
),
snapshot AS (
  SELECT site, url, place, list_concat(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1),
    list_filter([next_url || '#top', 'old/../' || substr(after_url, length(site) + 2), site,
      'https://elsewhere.example/p1'], lambda x: x IS NOT NULL)) AS hrefs
  FROM numbered
),
raw AS (
  SELECT site, url, unnest(range(0, len(hrefs)))::INTEGER AS pos, unnest(hrefs) AS href FROM snapshot
),
cut AS (
  SELECT *, regexp_replace(regexp_replace(href, '#.*$', ''), '^.*?\.\./', '') AS link0 FROM raw
),
linked AS (
  SELECT site, url, pos, href, CASE WHEN contains(link0, site) THEN link0
    WHEN contains(link0, 'http://') OR contains(link0, 'https://') THEN NULL ELSE site || '/' || link0 END AS link
  FROM cut
),
edges AS (SELECT DISTINCT site, url AS src, link AS dst FROM linked WHERE link IS NOT NULL)"""

# Page text

_KEPT_ELEMENTS = (
    r"regexp_replace(html, '(?is)(<!--.*?-->)|<title\b.*?(?:</title\s*>|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '\1', 'g')"
)
_CLOSED = rf"regexp_replace({_KEPT_ELEMENTS}, '&(amp|quot|copy|middot)([^-.a-zA-Z0-9;])', '&\1;\2', 'g')"
_CLEANED = f"regexp_replace({_KEPT_ELEMENTS}, '<[^>]+>', '', 'g')"
# Entities that stay are put aside as lone characters while bare ampersands are escaped.
_KEPT = {"&amp;": "chr(1)", "&lt;": "chr(2)", "&gt;": "chr(3)"}
_DECODED = f"regexp_replace({_CLOSED}, '<[^>]+>', '', 'g')"
for _name, _char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
for _name, _char in _KEPT.items():
    _DECODED = f"replace({_DECODED}, '{_name}', {_char})"
_DECODED = f"replace({_DECODED}, '&', '&amp;')"
for _name, _char in _KEPT.items():
    _DECODED = f"replace({_DECODED}, {_char}, '{_name}')"


def _collapsed(text: str) -> str:
    return f"regexp_replace({text}, '{BLANKS}', ' ', 'g')"


DOCUMENTS = f"""
documents_ AS (SELECT url, {_collapsed(_DECODED)} AS content FROM pages),
tokenised AS MATERIALIZED (
  SELECT url, regexp_extract_all(lower(content), '{WORD}(?:[''.]{WORD})*') AS tokens FROM documents_
),
sized AS (SELECT url, tokens, len(tokens) AS n_tokens FROM tokenised),
corpus AS (SELECT count(*) AS n, avg(n_tokens) AS mean FROM sized),
frequency AS (
  SELECT term, count(*) AS documents
  FROM (SELECT DISTINCT url, unnest(tokens) AS term FROM tokenised) GROUP BY term
)"""

# Scored hits of the phrases in a table wanted(phrase, terms), terms a list.
SCORED = """
lengths AS (SELECT DISTINCT len(terms) AS n FROM wanted),
starts AS (SELECT url, tokens, n_tokens, unnest(generate_series(1, n_tokens)) AS i FROM sized),
run AS (
  SELECT url, n_tokens, array_to_string(list_slice(tokens, i, i + n - 1), ' ') AS phrase
  FROM starts, lengths WHERE i + n - 1 <= n_tokens
),
matches AS (
  SELECT r.phrase, r.url, r.n_tokens, count(*) AS tf
  FROM run r JOIN wanted w ON w.phrase = r.phrase GROUP BY ALL
),
weights AS (
  SELECT phrase, sum(ln(1 + (corpus.n - f.documents + 0.5) / (f.documents + 0.5))) AS weight
  FROM (SELECT phrase, unnest(terms) AS term FROM wanted) w
  JOIN frequency f ON f.term = w.term, corpus GROUP BY phrase
),
scored AS (
  SELECT m.phrase, m.url,
    round(weight * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n_tokens / mean)), 6) AS score
  FROM matches m JOIN weights w ON w.phrase = m.phrase, corpus
)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


ACCOUNTS = (LOGINS, TOKENS, REQUESTS, USERS)

AUTHORIZED = """
authorized AS (
  SELECT r.request_id, r.token, r.ts, u.id, u.email, u.name, u.created_date, u.last_login_date,
    CASE WHEN r.token IS NULL THEN 'forbidden' WHEN t.token IS NULL THEN 'Invalid token'
         WHEN t.expire_date < date_trunc('second', r.ts) THEN 'Token expired'
         WHEN u.id IS NULL THEN 'unknown user' ELSE 'ok' END AS status
  FROM requests r LEFT JOIN tokens t ON t.token = r.token LEFT JOIN users u ON u.id = t.user_id
)"""

LIFETIMES = """
lifetimes AS (
  SELECT token, user_id, issued,
    lead(issued) OVER (PARTITION BY user_id ORDER BY issued, event_id) AS superseded,
    date_trunc('second', issued) + INTERVAL 1 DAY AS expire_date
  FROM logins
)"""


def all_sql() -> dict[str, str]:
    root_links = rf"""
SELECT DISTINCT {ROOT} AS root, url AS src,
  {ROOT} || '/' || unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS dst
FROM pages"""
    hits = (
        DOCUMENTS,
        SEARCH_REQUESTS,
        f"""asked AS (
  SELECT *, regexp_extract_all(lower(q), '{WORD}(?:[''.]{WORD})*') AS terms
  FROM search_requests WHERE status = 'ok'
),
wanted AS (SELECT DISTINCT array_to_string(terms, ' ') AS phrase, terms FROM asked WHERE len(terms) > 0)""",
        SCORED,
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, url) AS rank FROM scored
),
hits AS (
  SELECT request_id, rank, url, score
  FROM asked a JOIN ranked r ON r.phrase = array_to_string(a.terms, ' ')
  WHERE rank > start AND rank <= start + size
)""",
    )
    return {
        "page_text": f"SELECT page_id, {_collapsed(_CLEANED)} AS content FROM pages",
        "page_text_decoded": f"SELECT page_id, {_collapsed(_DECODED)} AS content FROM pages",
        "page_text_exact": f"SELECT page_id, {_collapsed(_DECODED)} AS content FROM pages",
        "page_links": root_links,
        "normalize_links": _with(SNAPSHOT) + " SELECT url, pos, href, link FROM linked",
        "page_tokens": _with(DOCUMENTS)
        + " SELECT unnest(tokens) AS term, url, unnest(generate_series(0, n_tokens - 1))::INTEGER AS pos FROM sized",
        "term_document_frequency": _with(DOCUMENTS) + " SELECT term, documents FROM frequency",
        "search_phrase": _with(
            DOCUMENTS,
            f"wanted AS (SELECT '{PHRASE}' AS phrase, string_split('{PHRASE}', ' ') AS terms)",
            SCORED,
        )
        + " SELECT url, score FROM scored ORDER BY score DESC, url LIMIT 10 OFFSET 5",
        "search_batch": _with(*hits) + " SELECT request_id, rank, url, score FROM hits",
        "search_responses": _with(
            *hits,
            """pages_ AS (
  SELECT request_id, '["' || string_agg(url, '","' ORDER BY rank) || '"]' AS urls
  FROM hits GROUP BY request_id
)""",
        )
        + """ SELECT s.request_id, CASE WHEN status = 'ok'
    THEN '{"status":"ok","data":' || coalesce(urls, '[]') || '}'
    ELSE '{"status":"' || status || '","data":{}}' END AS body
  FROM search_requests s LEFT JOIN pages_ p ON p.request_id = s.request_id""",
        "fetch_snapshot": f"""
WITH links AS ({root_links}),
frontier AS (SELECT url FROM pages UNION SELECT dst FROM links)
SELECT f.url, length(p.html)::INTEGER AS n_chars,
  CASE WHEN p.url IS NULL THEN 'failed' ELSE 'fetched' END AS state
FROM frontier f LEFT JOIN pages p ON p.url = f.url""",
        "frontier_new_links": _with(SNAPSHOT)
        + """ SELECT DISTINCT site AS root, dst AS url FROM edges e
  WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.url = e.dst)""",
        "crawl_frontier": _with(
            SNAPSHOT,
            """reach AS (
  SELECT site AS root, url, 0 AS depth FROM snapshot WHERE place = 1
  UNION
  SELECT r.root, e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url AND e.site = r.root
  WHERE r.depth < 3
),
first_seen AS (SELECT root, url, min(depth) AS depth FROM reach GROUP BY root, url)""",
        )
        + """ SELECT root, f.url, depth, CASE WHEN depth = 3 THEN 'unvisited'
    WHEN s.url IS NOT NULL THEN 'fetched' ELSE 'failed' END AS state
  FROM first_seen f LEFT JOIN snapshot s ON s.url = f.url""",
        "fair_fetch_order": _with(FETCH_LOG)
        + """ SELECT root, url, ts, event_id,
    row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS turn
  FROM fetch_log ORDER BY turn, root""",
        "rate_limit_audit": _with(FETCH_LOG)
        + f""", audited AS (
  SELECT event_id, root, ts, count(*) OVER (PARTITION BY root ORDER BY ts
    RANGE BETWEEN INTERVAL {AUDIT_SECONDS} SECOND PRECEDING AND CURRENT ROW) AS in_window
  FROM fetch_log
)
SELECT *, in_window > 3 AS over_limit FROM audited""",
        "rate_limited_schedule": _with(FETCH_LOG)
        + f""", arrivals AS (
  SELECT event_id, root, ts, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY root ORDER BY ts, event_id) - 1 AS i FROM fetch_log
), started AS (
  SELECT *, (i // 3) * {AUDIT_SECONDS * 1_000_000 + 1} + max(t - (i // 3) * {AUDIT_SECONDS * 1_000_000 + 1})
    OVER (PARTITION BY root, i % 3 ORDER BY i) AS a
  FROM arrivals
)
SELECT event_id, root, ts, make_timestamp(a::BIGINT) AS start_ts, (a - t)::BIGINT AS delay_us FROM started""",
        "crawl_page_counts": _with(FETCH_LOG)
        + " SELECT root, count(*) AS pages_count FROM fetch_log GROUP BY root",
        "crawl_time_stats": _with(FETCH_LOG)
        + """ SELECT root, avg(duration) AS avg_time_per_page,
    max(duration) AS max_time_per_page, min(duration) AS min_time_per_page
  FROM fetch_log GROUP BY root""",
        "crawl_progress": _with(FETCH_LOG)
        + """ SELECT root, ts, event_id,
    row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS pages_count
  FROM fetch_log QUALIFY pages_count % 10 = 0""",
        "crawl_status": _with(FETCH_LOG)
        + f""", last AS (
  SELECT root, url, event_type FROM fetch_log
  QUALIFY row_number() OVER (PARTITION BY root, url ORDER BY ts DESC, event_id DESC) = 1
), known AS (
  SELECT {ROOT} AS root, p.url,
    EXISTS (SELECT 1 FROM last l WHERE l.url = p.url AND l.event_type <> 'error') AS done
  FROM pages p
)
SELECT root, count(*) FILTER (done) AS pages_count, count(*) FILTER (NOT done) AS pending,
  CASE WHEN bool_and(done) THEN 'Done' ELSE 'Crawling' END AS status FROM known GROUP BY root""",
        "latest_token": _with(LOGINS, TOKENS)
        + """ SELECT user_id, l.token, expire_date FROM (
    SELECT * FROM logins
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY issued DESC, event_id DESC) = 1) l
  JOIN (SELECT token, expire_date FROM tokens) t ON t.token = l.token""",
        "token_lifetimes": _with(LOGINS, LIFETIMES) + " SELECT * FROM lifetimes",
        "token_validity_asof": _with(LOGINS, REQUESTS, LIFETIMES)
        + """ SELECT r.request_id, r.token, r.ts,
    CASE WHEN l.token IS NULL THEN 'Invalid token'
      WHEN l.expire_date < date_trunc('second', r.ts) THEN 'Token expired' ELSE 'ok' END AS status
  FROM requests r LEFT JOIN lifetimes l ON l.token = r.token AND r.ts >= l.issued
    AND (l.superseded IS NULL OR r.ts < l.superseded)""",
        "validate_token": _with(*ACCOUNTS, AUTHORIZED)
        + """, named AS (
  SELECT *, CASE WHEN status = 'forbidden' THEN 'Invalid token' ELSE status END AS s FROM authorized
)
SELECT request_id, s AS status, CASE WHEN s = 'ok' THEN id END AS id,
  CASE WHEN s = 'ok' THEN email END AS email, CASE WHEN s = 'ok' THEN name END AS name,
  CASE WHEN s = 'ok' THEN created_date END AS created_date,
  CASE WHEN s = 'ok' THEN last_login_date END AS last_login_date
FROM named""",
        "authorize_requests": _with(*ACCOUNTS, AUTHORIZED)
        + """ SELECT request_id, token, ts, status, CASE WHEN status = 'ok' THEN id END AS author_id
  FROM authorized""",
        "current_responses": _with(*ACCOUNTS, AUTHORIZED)
        + """ SELECT request_id, CASE WHEN status = 'ok'
    THEN '{"status":"ok","data":{"id":' || id::VARCHAR || ',"email":"' || email || '","name":"' || name
      || '","created_date":"' || strftime(created_date, '%Y-%m-%d %H:%M:%S')
      || '","last_login_date":"' || strftime(last_login_date, '%Y-%m-%d %H:%M:%S') || '"}}'
    ELSE '{"status":"' || status || '","data":{}}' END AS body
  FROM authorized""",
        "index_responses": _with(FETCH_LOG, *ACCOUNTS, AUTHORIZED, INDEX_REQUESTS)
        + """, final AS (
  SELECT i.request_id, a.id, CASE WHEN i.domain IS NULL THEN 'domain required' ELSE a.status END AS status
  FROM index_requests i JOIN authorized a ON a.request_id = i.request_id
)
SELECT request_id, CASE WHEN status = 'ok' THEN '{"status":"ok","data":{"id":' || id::VARCHAR || '}}'
  ELSE '{"status":"' || status || '","data":{}}' END AS body
FROM final""",
        "stat_answers": _with(FETCH_LOG, *ACCOUNTS, AUTHORIZED, STATS)
        + """, owned AS (SELECT author_id, count(*) AS crawls FROM stats GROUP BY author_id)
SELECT request_id, status, CASE WHEN status = 'ok' THEN id END AS author_id,
  CASE WHEN status = 'ok' THEN coalesce(crawls, 0) END AS crawls,
  CASE WHEN status <> 'ok' THEN '{"status":"' || status || '","data":{}}' END AS body
FROM authorized a LEFT JOIN owned o ON o.author_id = a.id AND a.status = 'ok'""",
        "user_crawl_stats": _with(FETCH_LOG, *ACCOUNTS, AUTHORIZED, STATS)
        + """, callers AS (
  SELECT id AS author_id, count(*) AS requests FROM authorized WHERE status = 'ok' GROUP BY id
)
SELECT s.author_id, domain, status, time, pages_count AS pages, requests
FROM stats s JOIN callers c ON c.author_id = s.author_id""",
        "signup_conflicts": _with(USERS, SIGNUPS)
        + """ SELECT seq, email, name,
    CASE WHEN email IN (SELECT email FROM users) THEN 'User with this email already exists'
      WHEN name IN (SELECT name FROM users) THEN 'User with this name already exists'
      ELSE 'ok' END AS status FROM signups""",
        # One signup after the other, the emails and names taken so far in lists.
        "signup_batch": _with(USERS, SIGNUPS)
        + """, ordered AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM signups),
steps AS (
  SELECT 0::BIGINT AS n, (SELECT coalesce(list(email), []) FROM users) AS emails,
    (SELECT coalesce(list(name), []) FROM users) AS names,
    NULL::BIGINT AS seq, NULL::VARCHAR AS email, NULL::VARCHAR AS name, NULL::VARCHAR AS status
  UNION ALL
  SELECT n, CASE WHEN status = 'ok' THEN list_append(emails, email) ELSE emails END,
    CASE WHEN status = 'ok' THEN list_append(names, name) ELSE names END, seq, email, name, status
  FROM (
    SELECT o.n, s.emails, s.names, o.seq, o.email, o.name,
      CASE WHEN list_contains(s.emails, o.email) THEN 'User with this email already exists'
        WHEN list_contains(s.names, o.name) THEN 'User with this name already exists'
        ELSE 'ok' END AS status
    FROM steps s JOIN ordered o ON o.n = s.n + 1
  )
)
SELECT seq, email, name, status FROM steps WHERE n > 0""",
        "login_batch": _with(LOGINS, USERS)
        + """, named AS (
  SELECT 'user' || (user_id * 2)::VARCHAR || '@example.com' AS email, event_id, issued, token FROM logins
), last AS (
  SELECT email, token, issued, count(*) OVER (PARTITION BY email) AS logins FROM named
  QUALIFY row_number() OVER (PARTITION BY email ORDER BY issued DESC, event_id DESC) = 1
)
SELECT l.email, u.id AS user_id, logins,
  CASE WHEN u.id IS NULL THEN 'Unregistered user' ELSE 'ok' END AS status,
  CASE WHEN u.id IS NOT NULL THEN token END AS token,
  CASE WHEN u.id IS NOT NULL THEN date_trunc('second', issued) + INTERVAL 1 DAY END AS expire_date,
  CASE WHEN u.id IS NOT NULL THEN date_trunc('second', issued) END AS last_login_date
FROM last l LEFT JOIN users u ON u.email = l.email""",
        "validate_signup_request": _with(ACCOUNT_REQUESTS)
        + """ SELECT request_id, CASE WHEN email IS NULL THEN 'email required'
    WHEN password IS NULL THEN 'password required' WHEN name IS NULL THEN 'name required'
    ELSE 'ok' END AS status FROM account_requests""",
        "validate_login_request": _with(ACCOUNT_REQUESTS)
        + """ SELECT request_id, CASE WHEN email IS NULL THEN 'email required'
    WHEN password IS NULL THEN 'password required' ELSE 'ok' END AS status FROM account_requests""",
        "validate_search_request": _with(SEARCH_REQUESTS) + " SELECT * FROM search_requests",
        "validate_index_request": _with(FETCH_LOG, REQUESTS, INDEX_REQUESTS)
        + """ SELECT request_id, CASE WHEN domain IS NULL THEN 'domain required'
    WHEN token IS NULL THEN 'forbidden' ELSE 'ok' END AS status FROM index_requests""",
        "route_index_requests": _with(FETCH_LOG, *ACCOUNTS, AUTHORIZED, INDEX_REQUESTS)
        + """, final AS (
  SELECT i.request_id, i.domain, a.id,
    CASE WHEN i.domain IS NULL THEN 'domain required' ELSE a.status END AS status
  FROM index_requests i JOIN authorized a ON a.request_id = i.request_id
)
SELECT request_id, status,
  CASE WHEN status = 'ok' THEN md5('task:' || request_id::VARCHAR) END AS task_id,
  CASE WHEN status = 'ok' THEN id END AS author_id,
  CASE WHEN status = 'ok' THEN '{"type":"crawl","data":{"domain":"' || domain || '","author_id":'
    || id::VARCHAR || '}}' END AS body
FROM final""",
        "recrawl_filter": _with(FETCH_LOG, STATS, NEWEST_STAT)
        + f" SELECT *, time >= {AS_OF_SQL} - INTERVAL 86399 SECOND AS skip FROM newest",
        "classify_protocol": _with(FETCH_LOG, TASKS)
        + """ SELECT task_id, domain, CASE WHEN contains(domain, 'https://') THEN 1
    WHEN contains(domain, 'http://') THEN 0 END AS https,
    CASE WHEN NOT contains(domain, 'https://') AND NOT contains(domain, 'http://')
      THEN 'Error: protocol should be specified' END AS error FROM tasks""",
        "route_crawl_tasks": _with(FETCH_LOG, STATS, NEWEST_STAT, TASKS)
        + f""", firsts AS (
  SELECT domain, author_id, ts, task_id, count(*) OVER (PARTITION BY domain, author_id) AS tasks FROM tasks
  QUALIFY row_number() OVER (PARTITION BY domain, author_id ORDER BY ts, task_id) = 1
), placed AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.domain ORDER BY f.ts, f.task_id) = 1 AS leads,
    coalesce(n.time >= {AS_OF_SQL} - INTERVAL 86399 SECOND, false) AS fresh, n.status AS known,
    EXISTS (SELECT 1 FROM stats s WHERE s.domain = f.domain AND s.author_id = f.author_id) AS owned,
    contains(f.domain, '://') AS whole
  FROM firsts f LEFT JOIN newest n ON n.domain = f.domain
), acted AS (
  SELECT *, CASE WHEN fresh AND owned THEN 'skip' WHEN fresh OR NOT leads THEN 'copy'
    WHEN whole THEN 'crawl' ELSE 'error' END AS action FROM placed
)
SELECT task_id, domain, author_id, tasks, action,
  CASE WHEN action = 'skip' THEN NULL WHEN fresh THEN known WHEN whole THEN 'Crawling'
    ELSE 'Error: protocol should be specified' END AS status,
  CASE WHEN action <> 'skip' THEN CASE WHEN contains(domain, 'https://') THEN 1 ELSE 0 END END AS https,
  CASE WHEN action <> 'skip' THEN 0 END AS pages_count
FROM acted""",
        "rpc_timeouts": """
WITH replies AS (
  SELECT event_id, unnest(CASE WHEN event_type = 'view'
      THEN [floor(value % 10)::BIGINT, floor(value % 10)::BIGINT + 1]
      ELSE [floor(value % 10)::BIGINT] END) AS delay, ts FROM events WHERE event_type <> 'error'
), first AS (SELECT event_id, ts, min(delay) AS delay FROM replies GROUP BY ALL),
matched AS (
  SELECT e.event_id, e.ts, f.delay, coalesce(f.delay <= 5, false) AS hit
  FROM events e LEFT JOIN first f ON f.event_id = e.event_id
)
SELECT event_id::VARCHAR AS correlation_id, ts AS request_ts,
  CASE WHEN hit THEN ts + to_seconds(delay) END AS reply_ts,
  CASE WHEN hit THEN 'reply:' || event_id::VARCHAR || ':' || delay::VARCHAR END AS reply,
  CASE WHEN hit THEN 'ok' ELSE 'Timeout exceeded' END AS status
FROM matched""",
        "parse_messages": _with(FETCH_LOG)
        + """, bodies AS (
  SELECT event_id AS message_id, CASE event_type
    WHEN 'view' THEN '{"type": "index", "index": {"domain": "' || split_part(root, '://', 2)
      || '", "https": ' || CASE WHEN root LIKE 'https%' THEN 'true' ELSE 'false' END || '}}'
    WHEN 'error' THEN '{"type": "crawl", ' || url
    ELSE '{"type": "crawl", "data": {"domain": "' || root || '", "author_id": '
      || user_id::VARCHAR || '}}' END AS body
  FROM fetch_log
), read AS (
  SELECT message_id, NOT json_valid(body) AS malformed,
    CASE WHEN json_valid(body) THEN body END AS j FROM bodies
)
SELECT message_id, malformed, j ->> '$.type' AS type,
  coalesce(j ->> '$.data.domain',
    CASE j ->> '$.index.https' WHEN 'true' THEN 'https://' WHEN 'false' THEN 'http://' END
      || (j ->> '$.index.domain')) AS domain,
  (j ->> '$.data.author_id')::INTEGER AS author_id
FROM read""",
        "table_all": "SELECT * FROM supplier",
        "table_filter": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
        "table_get": """
WITH first AS (
  SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY'
  QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1
)
SELECT s_suppkey, s_nationkey AS c_nationkey, c_custkey, c_name, c_acctbal, c_mktsegment,
  c_custkey IS NOT NULL AS found
FROM supplier LEFT JOIN first ON first.c_nationkey = s_nationkey""",
        "table_update": """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM customer""",
        "table_delete": "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'",
        "table_upsert": """
WITH changes AS (
  SELECT o_custkey AS c_custkey, 'Order#' || o_orderkey::VARCHAR AS c_name, 0 AS c_nationkey,
    o_totalprice AS c_acctbal, o_orderpriority AS c_mktsegment
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
  UNION ALL
  SELECT -s_suppkey - 1, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier
)
SELECT * FROM changes
UNION ALL
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changes)""",
        "table_delete_by_key": """
SELECT * FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
        "table_validate": f"""
WITH rows_ AS (
  SELECT repeat(c_name, c_nationkey) AS domain, nullif(c_mktsegment, 'BUILDING') AS status,
    c_custkey::INTEGER AS author_id, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS https,
    CASE WHEN c_acctbal >= 0 THEN {AS_OF_SQL} END AS time
  FROM customer
)
SELECT author_id, status, https, 0 AS pages_count,
  CASE WHEN length(domain) > 255 THEN 'domain: incorrrect str size'
    WHEN status IS NULL THEN 'status: field value is none but required'
    WHEN time IS NULL THEN 'time: field value is none but required' END AS violation
FROM rows_""",
        "assign_ids": """
SELECT o_orderkey, o_orderdate,
  (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id
FROM orders""",
    }
