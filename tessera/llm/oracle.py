"""DuckDB SQL of the training-data queries that SQL can express.

Fitted models (op1, op9), BPE merges (op2), XXH64 (op5), byte windows (op7), zstandard (op8), eigenvectors (op11)
and the all-pairs join (op13, too slow there on whole tables) have no SQL form; the tests compare those with brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from tessera.llm.rules import LEAST_WORDS, MOST_REPEATED
from tessera.llm.urls import PATTERN_RULES, PLACE_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, size FROM places JOIN windows USING (size, x)),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_PLACES = ", ".join(f"({_text(r.name.partition('/')[0])}, {_text('/' + r.name.partition('/')[2])}, {_text(r.verdict)})" for r in PLACE_RULES)
_BLOCKED = " OR ".join(f"regexp_matches({_LOWER.format('url')}, {_text(r.regex)})" for r in PATTERN_RULES)
OP6 = f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {_PLACES}),
p AS (SELECT page_id, url, coalesce({_LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT page_id, max({{'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': rule_verdict}}) AS best
      FROM p, r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN {_BLOCKED} THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN m USING (page_id)
"""

#: Vote of a rule: 2 (bad), 1 (good) or 0 (none), null without words. The figures and bounds are those of ``rules.votes``.
_VOTES = [
    ("n_words", "x < 10", "x >= 100"),
    ("word_chars / nullif(n_words, 0)", "x < 2", "x >= 3"),
    ("word_chars / nullif(n_words, 0)", "x > 20", "x <= 12"),
    ("n_symbols / nullif(n_words, 0)", "x > 0.1", "x <= 0.02"),
    ("n_symbols / nullif(word_chars, 0)", "x > 0.03", "x <= 0.005"),
    ("n_symbol_runs / nullif(n_words, 0)", "x > 0.1", "x <= 0.02"),
    ("n_repeat_words / nullif(n_words, 0)", "x > 0.3", "x <= 0.1"),
    ("n_dup_lines / nullif(n_lines, 0)", "x > 0.4", "x <= 0.1"),
    ("n_distinct_words / nullif(n_words, 0)", "x < 0.12", "x >= 0.25"),
]
_VOTE_LIST = ", ".join(f"CASE WHEN {bad.replace('x', f'({v})', 1)} THEN 2 WHEN {good.replace('x', f'({v})', 1)} THEN 1 ELSE 0 END" for v, bad, good in _VOTES)
_SPACE = r"[\x20\x09-\x0D]"
OP10 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM places) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, len(list_distinct(w)) AS n_distinct_words, len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs
      FROM t JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
voted AS (SELECT *, [{_VOTE_LIST}] AS votes FROM m),
p AS (SELECT row_number() OVER (ORDER BY votes) AS id, votes, count(*) AS n FROM voted GROUP BY votes),
each AS (SELECT id, n, j, votes[j] AS v FROM p, range(1, {len(_VOTES) + 1}) AS r(j)),
em(round, id, share) AS (
    SELECT 0, id, CASE WHEN list_contains(votes, 2) THEN 0.05::DOUBLE ELSE 0.95::DOUBLE END FROM p
    UNION ALL
    SELECT round + 1, id, 1 / (1 + exp(-(any_value(ln(prior / (1 - prior))) + sum(ln(good / bad))))) FROM (
        SELECT round, id, (1 + sum(share * n) OVER (PARTITION BY j, v)) / (3 + sum(share * n) OVER (PARTITION BY j)) AS good,
               (1 + sum((1 - share) * n) OVER (PARTITION BY j, v)) / (3 + sum((1 - share) * n) OVER (PARTITION BY j)) AS bad,
               (1 + sum(share * n) OVER (PARTITION BY j)) / (2 + sum(n) OVER (PARTITION BY j)) AS prior
        FROM em JOIN each USING (id) WHERE round < 50)
    GROUP BY round, id),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM voted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND share >= 0.5 AS kept
FROM failed JOIN p USING (votes) JOIN em USING (id) WHERE round = 50
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, [('0x' || substr(x, k, 8))::BIGINT FOR k IN [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op3_warc_archive": OP3,
    "op4_benchmark_contamination": OP4,
    "op6_url_rules": OP6,
    "op10_quality_votes": OP10,
    "op12_fill_in_middle": OP12,
}
