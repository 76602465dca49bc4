"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

import string

from citewell.llm import conversations, fixity, mixing, near_dedup, secrets, vector_codes
from citewell.llm.common import WORD

_SPACE = WORD.replace("[^", "[")


def near_duplicates() -> str:
    n = near_dedup.WORDS
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {near_dedup.PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id"""


def secret_spans() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = (rule.only_long or rule.pattern).replace("(?<![0-9a-f])", "")  # the leftmost match begins at its run
        pattern = "'" + (("(?i)" if rule.either_case else "") + pattern).replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, m, c, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, {rule.least} AS least FROM (
  SELECT doc_id, unnest(regexp_split_to_array(t, {pattern})) AS gap, unnest(regexp_extract_all(t, {pattern}, 0)) AS m, unnest(regexp_extract_all(t, {pattern}, {rule.group})) AS c, generate_subscripts(regexp_split_to_array(t, {pattern}), 1) AS i FROM d WHERE regexp_matches(t, {pattern})) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(m) AS e FROM found WHERE m IS NOT NULL AND length(c) >= least),
g AS (SELECT doc_id, {counts}, {joined} FILTER (WHERE rank < {len(secrets.BASE)}) AS base, {joined} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def fair_mix() -> str:
    weights = f"[{', '.join(f'{float(w)}::DOUBLE' for w in mixing.WEIGHTS)}]"
    copies = range(mixing.MAX_COPIES)
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM per),
weighed AS (SELECT *, {weights}[sid % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {float(mixing.MAX_COPIES)}::DOUBLE AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * {mixing.BUDGET_RATIO}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM weighed),
targets AS (SELECT *, least(cap, max(CASE WHEN here <= cap / weight THEN here END) OVER () * weight) AS target FROM levels),
dealt AS (SELECT doc_id, size, source_size, target, sid, sum(size) OVER (PARTITION BY sid ORDER BY ('0x' || left(sha256('{mixing.SEED}:' || doc_id), 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized JOIN targets ON targets.source IS NOT DISTINCT FROM sized.source),
copied AS (SELECT *, (source_size * copy + upto) / target AS finish FROM dealt, (VALUES {', '.join(f'({c})' for c in copies)}) v(copy) WHERE size > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, upto, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copied),
taken AS (SELECT doc_id, count(*) AS copies FROM summed WHERE finish <= 1 OR total <= (SELECT sum(target) FROM targets) GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS INTEGER) AS copies, CASE WHEN target > 0 THEN upto / target END AS first_finish FROM dealt LEFT JOIN taken USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_audit": fixity.ORACLE, "op2_fair_mix": fair_mix(), "op6_trigram_secrets": secret_spans(), "op9_odd_sketch": near_duplicates(), "op12_role_repair": conversations.oracle(), "op13_part_codes": vector_codes.oracle()}
