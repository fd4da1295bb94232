"""Common table expressions of the oracle SQL (DuckDB)."""

from __future__ import annotations

from plumbline.functions import patterns as P

REVIEWS = """nd AS (SELECT count(*) AS n_docs FROM documents),
reviews AS (
  SELECT row_number() OVER (ORDER BY e.ts, e.event_id) - 1 AS id, e.event_id AS ext_id, e.ts AS created_at, e.user_id AS author_id, d.text, d.lang,
         CAST(1 + floor(least(e.value, 99.0) / 20) AS DOUBLE) AS rating_raw,
         CASE WHEN e.event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END AS rating_norm,
         coalesce(CAST(json_extract_string(e.props, '$.k') AS BIGINT), 0) AS k
  FROM events e CROSS JOIN nd JOIN documents d ON d.doc_id = e.event_id % nd.n_docs)"""

ANSWERS = """answered AS (
  SELECT *, CAST((id * 7919 + 13) % 4 AS DOUBLE) AS informativeness, CAST((id * 104729 + 7) % 4 AS DOUBLE) AS support,
         ((id * 7907 + 101) % 1000) / 1000e0 AS p_contradicts, ((id * 6101 + 31) % 1000) / 1000e0 AS spam, ((id * 5003 + 17) % 1000) / 1000e0 AS templated,
         ((id * 3571 + 57) % 1000) / 1000e0 AS about_game, ((id * 2903 + 211) % 1000) / 1000e0 AS p_offtopic, ((id * 4409 + 5) % 1000) / 1000e0 AS influence,
         ((id * 1201 + 3) % 1000) / 1000e0 AS support_conf, ((id * 1511 + 9) % 1000) / 1000e0 AS topic_conf, ((id * 1709 + 2) % 1000) / 1000e0 AS info_conf,
         k % 7 = 0 AS low_playtime
  FROM reviews)"""


def quoted(rule: str) -> str:
    return "'" + rule.replace("'", "''") + "'"


def any_of(column: str, rules: dict[str, str], options: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(r)}{options})" for r in rules.values()) + ")"


def hits(column: str, rules: dict[str, str], options: str = "") -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, {quoted(r)}{options}) THEN '{n}' END" for n, r in rules.items())
    return f"concat_ws(',', {cases})"


TOKENS = r"len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))"
SYMBOLS = "len(regexp_extract_all(coalesce(text, ''), " + quoted(P.NON_TEXT) + ")) / greatest(length(coalesce(text, '')), 1)"
PROMO = any_of("lower(coalesce(text, ''))", P.PROMO)
NOTE = any_of("coalesce(text, '')", P.MODEL_NOTES, ", 'i'")
NORMALISED = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def label(share: str, n: str) -> str:
    bands = " ".join(f"WHEN {share} >= {s} AND {n} >= {m} THEN '{name}'" for s, m, name in P.BANDS)
    return f"CASE WHEN {n} < 10 OR {share} IS NULL THEN NULL {bands} WHEN {n} >= 500 THEN 'Overwhelmingly Negative' WHEN {n} >= 50 THEN 'Very Negative' ELSE 'Negative' END"


WEIGHT = "CASE code WHEN 1 THEN 1e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 1e0 WHEN 4 THEN 0e0 ELSE 1e0 END"

#: Decisions without a model, with the floor for notes to a model.
HEURISTIC = f"""texts AS (SELECT doc_id, {TOKENS} AS n_tokens, {SYMBOLS} AS symbols, {PROMO} AS promo, {NOTE} AS note FROM documents),
based AS (
  SELECT r.*, t.note, CASE WHEN promo THEN 3 WHEN n_tokens <= 3 OR symbols > 0.5 THEN 2 ELSE 1 END AS code0,
         CASE WHEN promo THEN 0.5e0 WHEN n_tokens <= 3 OR symbols > 0.5 THEN 0.4e0 ELSE 1e0 END AS score,
         CASE WHEN promo THEN ['SPAM'] WHEN n_tokens <= 3 OR symbols > 0.5 THEN ['LOW_INFO'] ELSE [] END AS reasons0
  FROM reviews r CROSS JOIN nd JOIN texts t ON t.doc_id = r.ext_id % nd.n_docs),
coded AS (
  SELECT * EXCLUDE (code0, reasons0), CASE WHEN note THEN 4 ELSE code0 END AS code,
         CASE WHEN note THEN list_concat(['INFLUENCE_ATTEMPT'], reasons0)[1:3] ELSE reasons0 END AS reasons FROM based),
decided AS (SELECT *, {WEIGHT} AS weight FROM coded)"""

#: Decisions from answers (eight contributions in their order).
JUDGED = f"""offgame AS (SELECT *, 1 - about_game AS off FROM answered),
contributed AS (
  SELECT *, [0e0 * (1 - informativeness / 3), 0e0 * (1 - support / 3), 0.5e0 * p_contradicts, 0.2e0 * spam, 0.15e0 * templated, 0.6e0 * off,
             0.2e0 * CASE WHEN low_playtime THEN off ELSE 0e0 END, 0.6e0 * (greatest(0e0, influence - 0.5e0) / 0.5e0)] AS c
  FROM offgame),
telling AS (
  SELECT *, greatest(0e0, 1 - (0e0 + c[1] + c[2] + c[3] + c[4] + c[5] + c[6] + c[7] + c[8])) AS score0,
         list_transform(list_sort(list_filter(list_transform(range(1, 9), lambda i: {{'m': -c[i], 'i': i, 'r': ['LOW_INFO', 'UNSUPPORTED_VERDICT', 'CONTRADICTS_VERDICT', 'SPAM', 'TEMPLATED', 'OFF_TOPIC', 'LOW_EXPERIENCE', 'INFLUENCE_ATTEMPT'][i]}}), lambda x: -x.m >= 0.05e0))[1:3], lambda x: x.r) AS why
  FROM contributed),
coded AS (
  SELECT * EXCLUDE (c, why), CASE WHEN spam > 0.9e0 THEN 3 WHEN score0 < 0.55e0 THEN 2 ELSE 1 END AS code, score0 AS score,
         CASE WHEN spam > 0.9e0 THEN list_concat(['SPAM'], list_filter(why, lambda x: x <> 'SPAM'))[1:3] ELSE why END AS reasons
  FROM telling),
decided AS (SELECT *, {WEIGHT} AS weight FROM coded)"""


def over_reviews(*parts: str) -> str:
    return "WITH " + ",\n".join((REVIEWS, *parts)) + "\n"
