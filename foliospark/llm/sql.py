"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import filter_audit as audit
from .common import LOWER, UPPER
from .url_filter import GLOBS, RULES
from .warc import MIN_SHARED

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _warc() -> str:
    five_bits = " || ".join(f"substr('{BASE32}', ((v >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    named AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS owner FROM payloads)
    SELECT page_id, n AS payload_bytes,
      array_to_string(list_transform(list_transform(range(0, 8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::INTEGER), lambda v: {five_bits}), '') AS payload_digest,
      CASE WHEN n >= {MIN_SHARED} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= {MIN_SHARED} AND page_id <> owner THEN owner END AS refers_to, true AS valid
    FROM named"""


def _url_filters() -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [f"ends_with('.' || host, '.{h}') AND starts_with(path, '{p}')" for _, h, p in ranked]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ranked))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ranked))
    bad = " OR ".join(f"'.' || host || path LIKE '{g.replace('*', '%')}'" for g in GLOBS)
    return f"""
    WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""


def _filter_audit() -> str:
    words = "list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
    letters = ", ".join(f"('{f}')" for f in audit.FILTERS)
    fails = "contains(failed, substr(o, step, 1))"
    lost = lambda what, when: f"coalesce(sum({what}) FILTER (WHERE {when}), 0)::BIGINT"
    return f"""
    WITH judged AS (SELECT doc_id, part, body, len(words) AS n, len(list_distinct(words)) AS d FROM (SELECT doc_id, coalesce(lang, '') AS part, body, {words} AS words FROM (SELECT *, coalesce(text, '') AS body FROM documents))),
    firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS low FROM judged),
    known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    masked AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN n < {audit.MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * d < {audit.DISTINCT_PERCENT} * n THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {audit.UPPER_PERCENT} * length(body) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(body, '[{audit.MARKS}]') THEN 'D' ELSE '' END || CASE WHEN low < doc_id THEN 'E' ELSE '' END AS failed FROM firsts LEFT JOIN known USING (doc_id)),
    cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL),
    letters(f) AS (VALUES {letters}),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = {len(audit.FILTERS)}),
    gone AS (SELECT part, failed, n, good, toxic, o, CASE {" ".join(f"WHEN contains(failed, substr(o, {k}, 1)) THEN {k}" for k in range(1, 6))} ELSE 6 END AS hit FROM cells, orders),
    steps AS (SELECT part, o, step, {lost("n", "hit > step")} AS kept, {lost("n", "hit = step")} AS removed, {lost("n", f"hit < step AND {fails}")} AS redundant, {lost("n", "failed = substr(o, step, 1)")} AS unique_fails,
      {lost("good", "hit = step")} AS good_lost, {lost("toxic", "hit = step")} AS toxic_lost FROM gone, range(1, 6) r(step) GROUP BY part, o, step)
    SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, substr(o, step, 1)))::BIGINT AS shapley FROM steps"""


ORACLES: dict[str, str] = {"op11_filter_audit": _filter_audit(), "op5_warc": _warc(), "op6_url_filters": _url_filters()}
