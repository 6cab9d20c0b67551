"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality_rules, url_filter
from .common import UPPER

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_REST = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest"
_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}')"
_PATH = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
_SITE = r"regexp_replace(regexp_replace(host, '^[^@]*@|:(80|443)?$', '', 'g'), '^www\.', '')"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _by_rule(value) -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{value(h, p, v)}'" for h, p, v in ordered) + " END"


OP8 = f"""WITH p AS (SELECT page_id, {_REST} FROM pages), h AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM p)
SELECT page_id, host, path, {_by_rule(lambda h, p, v: h + p)} AS rule,
coalesce({_by_rule(lambda h, p, v: v)}, CASE WHEN {_SITE} IN ({", ".join(f"'{u}'" for u in url_filter.LISTED)}) THEN 'block' ELSE 'allow' END) AS verdict FROM h"""

OP3 = rf"""WITH p AS (SELECT page_id, md5(html) AS tag, {_REST} FROM pages), h AS (SELECT *, {_HOST} AS host, {_PATH} AS path,
list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '{url_filter.TRACKING}'))) AS q FROM p),
c AS (SELECT page_id, tag, {_SITE} || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM h),
r AS (SELECT page_id * 8 + k AS record_id, url, k, CASE WHEN page_id % 3 <> 2 THEN CASE WHEN k = 2 AND page_id % 5 = 0 THEN 'x' || tag ELSE tag END END AS etag,
CASE WHEN page_id % 2 = 0 THEN 'm' || page_id END AS lm, CASE WHEN k = 0 THEN {{'id': page_id * 8, 'etag': CASE WHEN page_id % 3 <> 2 THEN tag END, 'lm': CASE WHEN page_id % 2 = 0 THEN 'm' || page_id END}} END AS resp FROM c, (SELECT unnest([0, 1, 2]) AS k)),
a AS (SELECT *, last_value(resp IGNORE NULLS) OVER (PARTITION BY url ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM r),
s AS (SELECT record_id, url, k, x.id AS id, CASE WHEN x IS NULL THEN 'no_response' WHEN CASE WHEN etag IS NOT NULL AND x.etag IS NOT NULL THEN etag = x.etag WHEN lm IS NOT NULL AND x.lm IS NOT NULL THEN lm = x.lm ELSE false END THEN 'resolved' ELSE 'mismatch' END AS status FROM a WHERE k > 0)
SELECT record_id, url, status, CASE WHEN status = 'resolved' THEN id END AS response_id, CASE WHEN status = 'resolved' THEN 'd' || k END AS date_header, CASE WHEN status = 'resolved' THEN 'text/html' END AS type_header FROM s"""

OP10 = f"""WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark), win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS win FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents), dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id"""

ORACLES = {"op3_warc_revisits": OP3, "op8_url_filter": OP8, "op10_decontamination": OP10}


def _distance(counts: str, total: str, shares) -> str:
    """Jensen-Shannon distance, base 2, of counts (a list) from shares."""
    q = "[" + ", ".join(repr(float(s)) + "::DOUBLE" for s in shares) + "]"
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] / greatest({1}, 1) + z[2]) / 2)) ELSE 0 END"
    p, r = term.format(f"(z[1] / greatest({total}, 1))", total), term.format("z[2]", total)
    return f"sqrt(greatest(list_sum(list_transform(list_zip({counts}, {q}), lambda z: ({p} + {r}) / 2)), 0))"


def _op6() -> str:
    limits, languages = quality_rules.Limits(), list(quality_rules.COMMON.values())
    space = r"\x20\x09-\x0D"
    hits = ", ".join(f"len(list_filter(tok, lambda x: x IN ({', '.join(repr(w) for w, _ in words[:3])}))) AS h{i}" for i, words in enumerate(languages))
    last = len(languages) - 1
    pick = "CASE " + " ".join("WHEN " + " AND ".join(f"h{i} >= h{j}" for j in range(i + 1, last + 1)) + f" THEN {i}" for i in range(last)) + f" ELSE {last} END"
    counts = {i: "[" + ", ".join(f"len(list_filter(tok, lambda x: x = {w!r}))" for w, _ in words) + "]" for i, words in enumerate(languages)}
    found = "CASE lang_no " + " ".join(f"WHEN {i} THEN {c}" for i, c in counts.items()) + " END"
    far = "CASE lang_no " + " ".join(
        f"WHEN {i} THEN {_distance('alls', 'n_all', [n / 1000 for _, n in words] + [1 - sum(n / 1000 for _, n in words)])}" for i, words in enumerate(languages)
    ) + " END"
    without = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    classes = ", ".join((without(r"\p{Ll}+"), without(r"\p{Lu}+"), without("[0-9]+"), "length(t) - word_chars", without(r"[.,;:!?''\"()-]+")))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS tok FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], chr(1)) AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d)), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, tok, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {without(r"[#*$%&|<>]+")} AS n_symbols, coalesce(n_rep, 0) AS n_repeat_words,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines, {hits} FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
c AS (SELECT *, [{classes}] AS five, {pick} AS lang_no FROM m), f AS (SELECT *, list_append(five, length(t) - list_sum(five)::BIGINT) AS six, {found} AS found FROM c),
a AS (SELECT *, list_append(found, greatest(n_words - list_sum(found)::BIGINT, 0)) AS alls FROM f), b AS (SELECT *, list_sum(alls)::BIGINT AS n_all FROM a),
s AS (SELECT *, CASE WHEN length(t) >= {limits.least_chars} THEN {_distance("six", "length(t)", quality_rules.CLASS_SHARES)} END AS cd, CASE WHEN n_words >= {limits.least_words} THEN {far} END AS wd, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, base_failed,
NOT base_failed AND NOT coalesce(cd > {limits.class_distance}, false) AND NOT coalesce(wd > {limits.word_distance}, false) AS kept FROM s"""


ORACLES["op6_quality_rules"] = _op6()
