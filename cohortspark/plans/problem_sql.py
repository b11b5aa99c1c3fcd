"""SQL of the queries p1 to p5 for an independent engine."""

from __future__ import annotations

# Zone abbreviations in use at the zones of the sites, and their offsets in minutes.
_ABBREVIATIONS = {
    "Europe/Berlin": {"cet": 60, "cest": 120},
    "Europe/Madrid": {"cet": 60, "cest": 120},
    "Europe/London": {"gmt": 0, "bst": 60},
    "America/New_York": {"est": -300, "edt": -240},
    "America/Chicago": {"cst": -360, "cdt": -300},
    "America/Phoenix": {"mst": -420},
    "America/Halifax": {"ast": -240, "adt": -180},
    "Asia/Kolkata": {"ist": 330},
    "Australia/Sydney": {"aest": 600, "aedt": 660},
}
_AB = ", ".join(f"('{z}', '{a}', {m})" for z, names in _ABBREVIATIONS.items() for a, m in names.items())

_MOMENTS = rf"""
ab(zone, abbr, minutes) AS (VALUES {_AB}),
v AS (SELECT 'response_session' AS src, session_id AS row_key, 'started_at' AS fld, started_at AS raw, site_code AS site FROM response_session
      UNION ALL SELECT 'response_session', session_id, 'completed_at', completed_at, site_code FROM response_session
      UNION ALL SELECT 'phq9_fhir_responses', rec_no, 'authored', authored, regexp_extract(subject.reference, '([^/]*)::', 1) FROM phq9_fhir_responses),
x AS (SELECT v.src, v.row_key, v.fld, s.time_zone, s.date_order, lower(trim(replace(v.raw, '−', '-'))) AS t FROM v LEFT JOIN study_site s ON s.site_code = v.site WHERE v.raw IS NOT NULL),
p AS (SELECT *,
  regexp_extract(t, '^(\d{{4}})-?(\d{{2}})-?(\d{{2}})[t ](\d{{2}}):?(\d{{2}})(?::?(\d{{2}}))?(?:[.,](\d+))?(z|[+-]\d{{2}}(?::?\d{{2}})?)?(?: ?\[?([a-z]+/[a-z_]+)\]?)?$', ['y','mo','d','h','mi','s','f','o','z']) AS i,
  regexp_extract(t, '^(\d{{1,2}})[./](\d{{1,2}})[./](\d{{4}}) (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: ([ap])m)?$', ['a','b','y','h','mi','s','half']) AS n,
  regexp_extract(t, '^([a-z]{{3}}) (\d{{1,2}}), (\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}}) ([ap])m ([a-z]+)$', ['mo','d','y','h','mi','s','half','z']) AS m,
  regexp_extract(t, '^[a-z]{{3}}, (\d{{1,2}}) ([a-z]{{3}}) (\d{{4}}) (\d{{2}}):(\d{{2}}):(\d{{2}}) ([+-]\d{{4}})$', ['d','mo','y','h','mi','s','o']) AS r,
  CASE WHEN regexp_matches(t, '^\d{{10}}$') THEN t::BIGINT * 1000000 WHEN regexp_matches(t, '^\d{{13}}$') THEN t::BIGINT * 1000 WHEN regexp_matches(t, '^\d\.\d+e9$') THEN (t::DOUBLE * 1e6)::BIGINT END AS epoch
  FROM x),
l AS (SELECT src, row_key, fld, time_zone, epoch,
  TRY(CASE WHEN i.y <> '' THEN make_timestamp(i.y::BIGINT, i.mo::BIGINT, i.d::BIGINT, i.h::BIGINT, i.mi::BIGINT, COALESCE(TRY_CAST(i.s AS DOUBLE), 0))
           WHEN n.y <> '' THEN make_timestamp(n.y::BIGINT, (CASE date_order WHEN 'dmy' THEN n.b WHEN 'mdy' THEN n.a END)::BIGINT, (CASE date_order WHEN 'dmy' THEN n.a WHEN 'mdy' THEN n.b END)::BIGINT,
                                              CASE n.half WHEN '' THEN n.h::BIGINT ELSE n.h::BIGINT % 12 + CASE n.half WHEN 'p' THEN 12 ELSE 0 END END, n.mi::BIGINT, COALESCE(TRY_CAST(n.s AS DOUBLE), 0))
           WHEN m.y <> '' THEN make_timestamp(m.y::BIGINT, (position(m.mo IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3, m.d::BIGINT, m.h::BIGINT % 12 + CASE m.half WHEN 'p' THEN 12 ELSE 0 END, m.mi::BIGINT, m.s::DOUBLE)
           WHEN r.y <> '' THEN make_timestamp(r.y::BIGINT, (position(r.mo IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3, r.d::BIGINT, r.h::BIGINT, r.mi::BIGINT, r.s::DOUBLE) END) AS ts,
  COALESCE(TRY_CAST(rpad(left(i.f, 6), 6, '0') AS BIGINT), 0) AS f, COALESCE(NULLIF(i.o, ''), NULLIF(r.o, '')) AS o, NULLIF(i.z, '') AS z, NULLIF(m.z, '') AS abbr FROM p),
k AS (SELECT l.*, COALESCE((SELECT MIN(time_zone) FROM study_site WHERE lower(time_zone) = l.z), CASE WHEN l.z IS NULL THEN l.time_zone END) AS zone, ab.minutes,
  CASE WHEN o = 'z' THEN 0 WHEN o IS NOT NULL THEN (CASE left(o, 1) WHEN '-' THEN -1 ELSE 1 END) * (substr(o, 2, 2)::BIGINT * 60 + COALESCE(TRY_CAST(substr(replace(o, ':', ''), 4, 2) AS BIGINT), 0)) END AS shift
  FROM l LEFT JOIN ab ON ab.zone = l.time_zone AND ab.abbr = l.abbr),
w AS (SELECT *, CASE WHEN zone IS NOT NULL THEN timezone(zone, ts) END AS one, CASE WHEN zone IS NOT NULL THEN timezone(zone, ts) - INTERVAL 1 HOUR END AS two FROM k),
moments AS (SELECT src, row_key, fld, CASE
  WHEN epoch IS NOT NULL THEN epoch
  WHEN shift IS NOT NULL THEN epoch_us(ts) + f - shift::BIGINT * 60000000
  WHEN abbr IS NOT NULL THEN epoch_us(ts) + f - minutes::BIGINT * 60000000
  WHEN timezone(zone, two) = ts THEN epoch_us(two) + f
  WHEN timezone(zone, one) = ts THEN epoch_us(one) + f END AS utc_us FROM w)"""

_P1 = f"WITH {_MOMENTS} SELECT src, row_key, fld, utc_us FROM moments WHERE utc_us IS NOT NULL"

_KEYED = rf"""{_MOMENTS},
b AS (SELECT session_id, respondent_id, questionnaire_id,
      NULLIF(regexp_replace(regexp_replace(regexp_replace(lower(fhir_response_id), '^[\s{{{{]+|[\s}}}}]+$', '', 'g'), '/_history/.*$', ''), '^.*[/:]', ''), '') AS bare FROM response_session),
keyed AS (SELECT b.session_id, CASE WHEN bare IS NOT NULL THEN concat('id|', respondent_id, '|', bare) ELSE concat('at|', respondent_id, '|', questionnaire_id, '|', utc_us) END AS k
          FROM b LEFT JOIN moments t ON t.src = 'response_session' AND t.fld = 'started_at' AND t.row_key = b.session_id
          WHERE respondent_id IS NOT NULL AND (bare IS NOT NULL OR (utc_us IS NOT NULL AND questionnaire_id IS NOT NULL))),
kept AS (SELECT session_id, MIN(session_id) OVER (PARTITION BY k) AS first_id FROM keyed)""".replace("{{{{", "{").replace("}}}}", "}")

_ORPHANS = r"""
WITH child AS (
  SELECT DISTINCT 'skip_rule' AS tbl, CAST(rule_id AS VARCHAR) AS child_key, CAST(trigger_qq_id AS VARCHAR) AS fk, loaded_at FROM skip_rule
  UNION ALL SELECT DISTINCT 'concept', CAST(concept_id AS VARCHAR), upper(trim(vocabulary_id)), loaded_at FROM concept
  UNION ALL SELECT DISTINCT 'concept_relationship', concat(concept_id_1, '/', concept_id_2, '/', relationship_id), CAST(concept_id_2 AS VARCHAR), loaded_at FROM concept_relationship),
parent AS (
  SELECT 'skip_rule' AS tbl, CAST(qq_id AS VARCHAR) AS k, MIN(loaded_at) FILTER (WHERE deleted_at IS NULL) AS live FROM questionnaire_question GROUP BY 1, 2
  UNION ALL SELECT 'concept', upper(trim(vocabulary_id)), MIN(loaded_at) FILTER (WHERE deleted_at IS NULL) FROM vocabulary GROUP BY 1, 2
  UNION ALL SELECT 'concept_relationship', CAST(concept_id AS VARCHAR), MIN(loaded_at) FILTER (WHERE deleted_at IS NULL) FROM concept GROUP BY 1, 2),
found AS (SELECT c.tbl, c.child_key, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.live IS NULL THEN 'deleted' WHEN p.live > c.loaded_at THEN 'late' END AS kind, strftime(c.loaded_at, '%Y-%m') AS period
          FROM child c LEFT JOIN parent p ON p.tbl = c.tbl AND p.k = c.fk WHERE c.fk IS NOT NULL)"""

_P4 = r"""
WITH f AS (SELECT f.*, q.link_id || COALESCE('#' || f.repeat_index, '') AS col, q.question_type, trim(f.response_text, E' \t') AS t FROM fact_response f JOIN question q ON q.question_id = f.question_id),
u AS (SELECT session_id, col, question_type, loaded_at, response_id, CASE
  WHEN question_type IN ('numeric', 'slider') THEN printf('%.2f', COALESCE(response_numeric, TRY_CAST(replace(regexp_extract(t, '^([+-]?\d+([.,]\d+)?)\s*([a-zA-Z/]*)$', 1), ',', '.') AS DOUBLE)))
  WHEN question_type = 'boolean' THEN COALESCE(CAST(response_boolean AS VARCHAR), CASE WHEN lower(t) IN ('true', 'yes', 'ja', 'si', 'y', '1') THEN 'true' WHEN lower(t) IN ('false', 'no', 'nein', 'n', '0') THEN 'false' END)
  WHEN question_type = 'date' THEN CAST(COALESCE(response_date, TRY_CAST(CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN t END AS DATE), CAST(try_strptime(t, ['%d.%m.%Y', '%d %b %Y']) AS DATE)) AS VARCHAR)
  WHEN question_type = 'text' THEN NULLIF(t, '') ELSE NULLIF(lower(trim(option_value, E' \t')), '') END AS cell FROM f),
g AS (SELECT * FROM u WHERE cell IS NOT NULL AND cell <> '')
SELECT session_id, col, arg_max(cell, (loaded_at, response_id)) AS cell FROM g WHERE question_type <> 'multiple_choice' GROUP BY 1, 2
UNION ALL SELECT session_id, col, string_agg(DISTINCT cell, '|' ORDER BY cell) FROM g WHERE question_type = 'multiple_choice' GROUP BY 1, 2"""

_VALUE = """CASE WHEN COALESCE(NULLIF(y.valueCoding.code, ''), y.valueCoding.display) IS NOT NULL THEN ['coding', COALESCE(NULLIF(y.valueCoding.code, ''), y.valueCoding.display)]
  WHEN y.valueBoolean IS NOT NULL THEN ['boolean', CAST(y.valueBoolean AS VARCHAR)] WHEN y.valueDecimal IS NOT NULL THEN ['decimal', printf('%.2f', y.valueDecimal)]
  WHEN y.valueInteger IS NOT NULL THEN ['integer', CAST(y.valueInteger AS VARCHAR)] WHEN y.valueDate IS NOT NULL THEN ['date', y.valueDate]
  WHEN y.valueDateTime IS NOT NULL THEN ['dateTime', y.valueDateTime] WHEN y.valueString IS NOT NULL THEN ['string', y.valueString] END"""

_P5 = f"""
WITH a AS (SELECT rec_no, UNNEST(item) AS x, generate_subscripts(item, 1) - 1 AS p FROM gout_checkin_fhir_responses),
b AS (SELECT rec_no, p AS p0, x.linkId AS up, UNNEST(x.item) AS x, generate_subscripts(x.item, 1) - 1 AS p FROM a),
c AS (SELECT rec_no, p0, p AS p1, x.linkId AS up, UNNEST(x.item) AS x, generate_subscripts(x.item, 1) - 1 AS p FROM b),
r AS (SELECT rec_no, CAST(p AS VARCHAR) AS item_path, '' AS up, x.linkId AS link_id, UNNEST(x.answer) AS y, generate_subscripts(x.answer, 1) - 1 AS answer_no FROM a
      UNION ALL SELECT rec_no, concat(p0, '.', p), up, x.linkId, UNNEST(x.answer), generate_subscripts(x.answer, 1) - 1 FROM b
      UNION ALL SELECT rec_no, concat(p0, '.', p1, '.', p), up, x.linkId, UNNEST(x.answer), generate_subscripts(x.answer, 1) - 1 FROM c),
s AS (SELECT *, {_VALUE} AS v FROM r)
SELECT rec_no, item_path, answer_no, COALESCE(up, '') AS parent_link_id, COALESCE(link_id, '') AS link_id, v[1] AS kind, v[2] AS val FROM s WHERE v IS NOT NULL"""

SQL = {
    "p1_found": _P1,
    "p2_found": f"WITH {_KEYED} SELECT first_id AS session_id_1, session_id AS session_id_2 FROM kept WHERE session_id <> first_id",
    "p2_kept_sessions": f"WITH {_KEYED} SELECT * FROM response_session WHERE session_id NOT IN (SELECT session_id FROM kept WHERE session_id <> first_id)",
    "p3_found": _ORPHANS + " SELECT DISTINCT * FROM found WHERE kind IS NOT NULL",
    "p3_orphan_counts": _ORPHANS + " SELECT tbl, kind, period, COUNT(*) AS n_orphans FROM (SELECT DISTINCT * FROM found WHERE kind IS NOT NULL) GROUP BY 1, 2, 3",
    "p4_found": _P4,
    "p5_found": _P5,
}
