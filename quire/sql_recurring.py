"""DuckDB SQL of the planning half: families, centres, decisions, plans, transactions, ledgers, certification, gates.

The corpus (``queries.recurring``) is made of all lines of all documents. Each line becomes a statement whose words follow
from its hash, so statements of one group are linked with each other and with no other: groups are cliques, and a family
is what hangs together. That is what lets SQL express the families; everything after them is computed in full.
"""

from __future__ import annotations

from .sql import _CONCEPT, _CITED, _NUMBERS, _OVERLAP, _STOP, _TERMS, _TITLES, _function, _norm, _role, _round4, _round_to

_CLASS = "CASE key % 6 WHEN 1 THEN ' access review' WHEN 2 THEN ' source transformed' WHEN 3 THEN ' record restated' WHEN 4 THEN ' should' WHEN 5 THEN ' because (' || kws[1] || ' 19' || (10 + key % 90) || ')' ELSE '' END"

#: The corpus: doc_id, i (from 1), title, line.
_LINES = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
k0 AS (SELECT doc_id, i, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) % greatest(3, n // 3) AS key, CAST('0x' || substr(md5(line), 8, 7) AS BIGINT) % 8 AS v FROM raw),
k1 AS (SELECT *, translate(md5('key' || key), '0123456789', 'ghijklmnop') AS a, translate(md5('variant' || key || '.' || v), '0123456789', 'ghijklmnop') AS b FROM k0),
k2 AS (SELECT *, list_transform(range(8), lambda j: 'k' || substr(a, (4 * j + 1)::INT, 4)) AS kws, list_transform(range(CASE v WHEN 4 THEN 2 WHEN 5 THEN 6 WHEN 6 THEN 8 WHEN 7 THEN 8 ELSE 0 END), lambda j: ' v' || substr(b, (4 * j + 1)::INT, 4)) AS vws FROM k1),
lines AS (SELECT doc_id, i, {_TITLES} AS title, 'The ' || array_to_string(kws, ' ') || {_CLASS} || array_to_string(vws, '') || '.' AS line FROM k2)"""


def _analysis(lines: str, s: str = "") -> str:
    """CTEs from lines to decisions and plans, their names with the suffix s."""
    root = lambda col, *roots: "len(list_filter({}, lambda x: {})) > 0".format(col, " OR ".join(f"starts_with(x, '{r}')" for r in roots))
    return f""",
pos{s} AS (SELECT *, coalesce(sum(length(title) + 6 + length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM {lines}),
txt{s} AS (SELECT doc_id, string_agg('## ' || title || chr(10) || chr(10) || line, chr(10) ORDER BY i) AS text, count(*) AS n_sections FROM {lines} GROUP BY doc_id),
u0{s} AS (SELECT doc_id, i - 1 AS ord, printf('s_%03d', i) AS section_id, title, line AS text, {_norm('line')} AS norm, (pos0 + 5 + length(title))::INT AS char_start FROM pos{s}),
u1{s} AS (SELECT *, 'u_' || substr(sha256(section_id || '|0|0|' || norm), 1, 12) AS unit_id, list_sort(list_distinct(string_split(norm, ' '))) AS tokens FROM u0{s}),
u2{s} AS (SELECT *, list_filter(tokens, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)) AS content, {_role('text')} AS role,
  list_distinct(list_concat(list_concat({_NUMBERS}, {_CITED}), {_TERMS})) AS hard FROM u1{s}),
units{s} AS (SELECT *, list_distinct(list_transform(content, lambda x: {_CONCEPT})) AS concepts, {_function('title', 'role')} AS function FROM u2{s}),
e0{s} AS (SELECT a.doc_id, a.ord AS left_ord, b.ord AS right_ord, a.unit_id AS left_id, b.unit_id AS right_id,
  {_OVERLAP.format(a='len(a.content)', b='len(b.content)', s='len(list_intersect(a.content, b.content))')} AS lex,
  {_OVERLAP.format(a='len(a.concepts)', b='len(b.concepts)', s='len(list_intersect(a.concepts, b.concepts))')} AS con,
  CASE WHEN len(a.hard) + len(b.hard) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(a.hard, b.hard)) / len(list_distinct(list_concat(a.hard, b.hard)))::DOUBLE END AS anc,
  CASE WHEN a.role = b.role THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS rol
  FROM units{s} a JOIN units{s} b ON a.doc_id = b.doc_id AND a.ord < b.ord AND list_has_any(a.concepts, b.concepts)),
edges{s} AS (SELECT * FROM (SELECT doc_id, left_ord, right_ord, left_id, right_id, {_round4('lex')} AS lexical_overlap, {_round4('con')} AS concept_overlap, {_round4('anc')} AS anchor_overlap,
  {_round4('rol')} AS role_compatibility, {_round4('0.35::DOUBLE * lex + 0.35::DOUBLE * con + 0.15::DOUBLE * anc + 0.15::DOUBLE * rol')} AS composite FROM e0{s}) WHERE composite >= 0.43::DOUBLE),
ends{s} AS (SELECT doc_id, left_ord AS ord, right_ord AS other, composite FROM edges{s} UNION ALL SELECT doc_id, right_ord, left_ord, composite FROM edges{s}),
near{s} AS (SELECT doc_id, ord, least(ord, min(other)) AS head, list_reduce(list(composite ORDER BY other), lambda p, q: p + q) / count(*) AS mean FROM ends{s} GROUP BY doc_id, ord),
members{s} AS (SELECT u.*, n.mean, dense_rank() OVER (PARTITION BY u.doc_id ORDER BY n.head) - 1 AS emission FROM near{s} n JOIN units{s} u USING (doc_id, ord)),
shared{s} AS (SELECT doc_id, emission, list_sort(list(w)) AS common FROM (SELECT doc_id, emission, w, count(*) AS n FROM (SELECT doc_id, emission, unnest(concepts) AS w FROM members{s}) GROUP BY doc_id, emission, w) x
  WHERE n = (SELECT count(*) FROM members{s} m WHERE m.doc_id = x.doc_id AND m.emission = x.emission) GROUP BY doc_id, emission),
f0{s} AS (SELECT doc_id, emission, list(unit_id ORDER BY char_start) AS unit_ids, list_sort(list_distinct(list(title))) AS sections, list_distinct(flatten(list(content))) AS words, count(*) AS n FROM members{s} GROUP BY doc_id, emission),
f1{s} AS (SELECT f.*, common, list_sort(list_distinct(list_transform(list_filter(common, lambda t: t <> 'every'), lambda t: CASE t WHEN 'c0' THEN 'duplicate' WHEN 'c1' THEN 'conserve' WHEN 'c2' THEN 'data'
  WHEN 'c3' THEN 'danger' WHEN 'c4' THEN 'cut' WHEN 'c5' THEN 'center' WHEN 'c6' THEN 'advise' WHEN 'c7' THEN 'check' ELSE t END))) AS shown FROM f0{s} f LEFT JOIN shared{s} USING (doc_id, emission)),
families{s} AS (SELECT doc_id, emission, 'f_' || substr(sha256(array_to_string(unit_ids, '|')), 1, 10) AS family_id, unit_ids, sections, n,
  CASE WHEN {root('words', 'access')} AND {root('words', 'review')} THEN 'Periodic access-control review'
    WHEN list_contains(words, 'source') AND {root('words', 'transform')} THEN 'Transformation provenance record'
    WHEN ({root('words', 'evidence', 'proof', 'record')} OR list_contains(common, 'c2')) AND {root('words', 'repeat', 'restat', 'explan', 'consolid')} THEN 'Evidence-preserving consolidation'
    WHEN len(list_filter(shown, lambda t: length(t) > 2)) > 0 THEN array_to_string(list_transform(list_filter(shown, lambda t: length(t) > 2)[1:3], lambda t: upper(t[1]) || t[2:]), ' · ')
    ELSE 'Recurring semantic theme' END AS label FROM f1{s}),
fit{s} AS (SELECT *, CASE function WHEN 'analytical' THEN 1.00::DOUBLE WHEN 'definitory' THEN 0.95::DOUBLE WHEN 'recommendatory' THEN 0.90::DOUBLE WHEN 'context' THEN 0.65::DOUBLE WHEN 'conclusive' THEN 0.45::DOUBLE
  WHEN 'summary' THEN 0.35::DOUBLE WHEN 'evidentiary' THEN 0.30::DOUBLE WHEN 'structural' THEN 0.20::DOUBLE END AS fits FROM members{s}),
s0{s} AS (SELECT doc_id, emission, title, max(fits) AS fits, sum(len(tokens)) AS mass, max((function = 'evidentiary')::INT) AS ev, count(*) AS n, min(char_start) AS first, arg_max(function, fits * 1e9 - char_start) AS strongest
  FROM fit{s} GROUP BY doc_id, emission, title),
scores{s} AS (SELECT doc_id, emission, title, first, strongest, {_round4("0.35::DOUBLE * fits + 0.25::DOUBLE * least(1::DOUBLE, mass / 45::DOUBLE) + 0.15::DOUBLE * (CASE WHEN ev = 1 THEN 1::DOUBLE ELSE 0.45::DOUBLE END) + 0.15::DOUBLE * (CASE WHEN x.n > 1 THEN 1::DOUBLE ELSE 0.65::DOUBLE END) + 0.1::DOUBLE * (1::DOUBLE / (1 + greatest(0, len(sections) - 1)))")} AS score
  FROM s0{s} x JOIN families{s} USING (doc_id, emission)),
ranked{s} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, emission ORDER BY score DESC, first) AS place FROM scores{s}),
choice{s} AS (SELECT doc_id, emission, max(title) FILTER (place = 1) AS centre, max(score) FILTER (place = 1) AS centre_score, max(strongest) FILTER (place = 1) AS strongest, max(title) FILTER (place = 2) AS competing_centre,
  max(score) FILTER (place = 2) AS competing_score FROM ranked{s} GROUP BY doc_id, emission),
own{s} AS (SELECT doc_id, emission, min(ord) AS ord, w FROM (SELECT doc_id, emission, ord, unnest(content) AS w FROM members{s}) GROUP BY doc_id, emission, w HAVING count(*) = 1),
rest{s} AS (SELECT doc_id, emission, ord, list_sort(list(w)) AS residual FROM own{s} GROUP BY doc_id, emission, ord),
d0{s} AS (SELECT m.*, f.family_id, c.centre, coalesce(r.residual, []) AS residual, count(*) OVER (PARTITION BY m.doc_id, m.emission, m.norm) AS twins,
  CASE WHEN mean >= 0.92::DOUBLE THEN 'exact_equivalent' WHEN mean >= 0.68::DOUBLE THEN 'paraphrase_equivalent' WHEN mean >= 0.50::DOUBLE THEN 'partial_overlap' WHEN mean >= 0.43::DOUBLE THEN 'uncertain' ELSE 'related_non_duplicate' END AS band
  FROM members{s} m JOIN families{s} f USING (doc_id, emission) JOIN choice{s} c USING (doc_id, emission) LEFT JOIN rest{s} r USING (doc_id, emission, ord)),
d1{s} AS (SELECT *, CASE WHEN band = 'paraphrase_equivalent' AND twins = 1 AND len(residual) >= 3 THEN 'partial_overlap' ELSE band END AS relation FROM d0{s}),
decisions{s} AS (SELECT *, {_round4('mean')} AS confidence,
  CASE WHEN function IN ('structural', 'evidentiary') THEN 1 WHEN relation IN ('uncertain', 'related_non_duplicate') THEN 2 WHEN title = centre THEN 3 WHEN function IN ('summary', 'conclusive') THEN 4 WHEN relation = 'partial_overlap' THEN 5 ELSE 6 END AS rule,
  CASE rule WHEN 1 THEN 'preserve_in_place' WHEN 2 THEN 'human_review' WHEN 3 THEN 'preserve_in_place' WHEN 4 THEN 'preserve_in_place' WHEN 5 THEN 'human_review' ELSE 'merge_into_centre' END AS disposition,
  CASE rule WHEN 1 THEN 'Protected structural or evidentiary function remains local.' WHEN 2 THEN 'Semantic equivalence is not strong enough for automatic consolidation.'
    WHEN 3 THEN 'Occurrence is located at the selected logical gravity centre.' WHEN 4 THEN 'Necessary functional echo is retained outside the canonical treatment.'
    WHEN 5 THEN 'Partial overlap contains potential unique residual payload; removal is forbidden.' ELSE 'Probable redundant payload may be merged, subject to donor and coverage verification.' END AS rationale FROM d1{s}),
g0{s} AS (SELECT doc_id, emission, count(*) AS n, count(*) FILTER (relation = 'partial_overlap') AS partial, count(*) FILTER (disposition = 'human_review') AS review FROM decisions{s} GROUP BY doc_id, emission),
g1{s} AS (SELECT f.doc_id, f.emission, f.family_id, f.label, f.unit_ids, f.sections, c.centre, c.centre_score, c.strongest, c.competing_centre, c.competing_score, g.n AS n_members,
  {_round4("0.3::DOUBLE * (partial / g.n::DOUBLE) + 0.25::DOUBLE * (len(sections) / greatest(1, n_sections)::DOUBLE) + 0.25::DOUBLE * (review / g.n::DOUBLE) + 0.2::DOUBLE * least(1::DOUBLE, g.n / greatest(2, n_sections)::DOUBLE)")} AS risk_score
  FROM families{s} f JOIN choice{s} c USING (doc_id, emission) JOIN g0{s} g USING (doc_id, emission) JOIN txt{s} USING (doc_id)),
plan{s} AS (SELECT *, CASE WHEN risk_score < 0.25::DOUBLE THEN 'low' WHEN risk_score < 0.5::DOUBLE THEN 'moderate' ELSE 'high' END AS risk_band, row_number() OVER (PARTITION BY doc_id ORDER BY risk_score, n_members, emission) AS place FROM g1{s}),
t0{s} AS (SELECT d.*, p.label, p.place, p.unit_ids, list_sort(d.hard) AS anchors FROM decisions{s} d JOIN plan{s} p USING (doc_id, emission)),
receivers{s} AS (SELECT doc_id, emission, arg_max(norm, key) AS rnorm, arg_max(text, key) AS rtext, arg_max(anchors, key) AS ranchors FROM (SELECT *, len(tokens) * 1e9::DOUBLE - char_start AS key FROM t0{s}
  WHERE title = centre AND disposition = 'preserve_in_place') GROUP BY doc_id, emission),
donors{s} AS (SELECT t.*, r.rnorm, 'See ' || centre || ' for the canonical treatment of ' || label || '.' AS repair, len(list_filter(t.anchors, lambda x: NOT list_contains(r.ranchors, x))) = 0 AS safe
  FROM t0{s} t JOIN receivers{s} r USING (doc_id, emission) WHERE disposition = 'merge_into_centre' AND relation = 'exact_equivalent' AND len(residual) = 0 AND norm = rnorm),
x0{s} AS (SELECT doc_id, emission, place, family_id, centre, label, unit_ids, list(unit_id ORDER BY char_start) FILTER (safe) AS changed, list(unit_id || ': donor hard anchors are not present at the receiver' ORDER BY char_start) FILTER (NOT safe) AS failures,
  coalesce(bool_and(NOT contains({_norm('repair')}, norm)) FILTER (safe), true) AS fresh FROM donors{s} GROUP BY doc_id, emission, place, family_id, centre, label, unit_ids HAVING count(*) FILTER (safe) > 0),
tx{s} AS (SELECT x.*, sha256(t.text) AS base, len(coalesce(failures, [])) = 0 AS anchored, l.title IS NOT NULL AS resolves, anchored AND resolves AND fresh AS passed
  FROM x0{s} x JOIN txt{s} t USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, title FROM {lines}) l ON l.doc_id = x.doc_id AND l.title = x.centre),
moved{s} AS (SELECT x.doc_id, x.emission, l.i, l.title, coalesce(CASE WHEN x.passed THEN d.repair END, l.line) AS line FROM tx{s} x JOIN {lines} l USING (doc_id)
  LEFT JOIN (SELECT * FROM donors{s} WHERE safe) d ON d.doc_id = x.doc_id AND d.emission = x.emission AND d.ord = l.i - 1),
after{s} AS (SELECT doc_id, emission, string_agg('## ' || title || chr(10) || chr(10) || line, chr(10) ORDER BY i) AS revised FROM moved{s} GROUP BY doc_id, emission)
"""


_BASE = _LINES + _analysis("lines")

#: One round of the safe pass and the analysis of what it leaves.
_ROUND = f""",
first AS (SELECT doc_id, emission FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS turn FROM tx WHERE passed) WHERE turn = 1),
lines2 AS (SELECT l.doc_id, l.i, l.title, coalesce(m.line, l.line) AS line FROM lines l LEFT JOIN (SELECT m.* FROM moved m JOIN first f USING (doc_id, emission)) m USING (doc_id, i)),
ready AS (SELECT doc_id, count(*) AS left_over FROM tx GROUP BY doc_id)""" + _analysis("lines2", "2") + """,
touched AS (SELECT x.doc_id, unnest(x.changed) AS unit_id, x.centre FROM tx x JOIN first f USING (doc_id, emission)),
led AS (SELECT u.doc_id, u.ord, u.unit_id, CASE WHEN r.unit_id IS NOT NULL THEN 'preserved_in_place' WHEN t.unit_id IS NOT NULL THEN 'donor_repaired' END AS disposition,
  CASE WHEN r.unit_id IS NOT NULL THEN u.title ELSE t.centre END AS destination, u.hard FROM units u LEFT JOIN (SELECT DISTINCT doc_id, unit_id FROM units2) r USING (doc_id, unit_id) LEFT JOIN touched t USING (doc_id, unit_id)),
lost AS (SELECT doc_id, list_sort(list_distinct(list(anchor))) AS anchors FROM (SELECT doc_id, unnest(hard) AS anchor FROM units) JOIN txt2 USING (doc_id) WHERE NOT contains(txt2.text, anchor) GROUP BY doc_id),
open2 AS (SELECT doc_id, count(*) AS open FROM decisions2 WHERE disposition = 'human_review' GROUP BY doc_id),
sets AS (SELECT doc_id, emission, list_distinct(list(norm)) AS texts FROM members GROUP BY doc_id, emission),
sets2 AS (SELECT doc_id, emission, list_distinct(list(norm)) AS texts, bool_or(role = 'cross_reference') AS xref FROM members2 GROUP BY doc_id, emission),
fresh2 AS (SELECT doc_id, count(*) AS n FROM sets2 a WHERE NOT xref AND NOT EXISTS (SELECT 1 FROM sets b WHERE b.doc_id = a.doc_id AND list_has_all(b.texts, a.texts)) GROUP BY doc_id),
r0 AS (SELECT doc_id, count(*) AS units, count(disposition) AS accounted, coalesce(list(unit_id ORDER BY ord) FILTER (disposition IS NULL), []) AS missing FROM led GROUP BY doc_id),
r1 AS (SELECT r0.*, coalesce(anchors, []) AS gone, coalesce(open, 0) AS open, coalesce(n, 0) AS fresh FROM r0 LEFT JOIN lost USING (doc_id) LEFT JOIN open2 USING (doc_id) LEFT JOIN fresh2 USING (doc_id)),
report AS (SELECT *, list_filter([CASE WHEN len(missing) > 0 THEN len(missing) || ' original semantic unit(s) have no reconciled destination' END,
  CASE WHEN len(gone) > 0 THEN 'Hard anchors are missing: [''' || array_to_string(gone, ''', ''') || ''']' END,
  CASE WHEN fresh > 0 THEN fresh || ' newly introduced candidate recurrence family/families detected' END], lambda x: x IS NOT NULL) AS failures FROM r1),
judged AS (SELECT *, CASE WHEN len(failures) > 0 OR accounted < units THEN 'NOT_VERIFIED' WHEN open > 0 THEN 'FORMAL_GATES_PASSED_UNRESOLVED_SEMANTICS' ELSE 'FORMAL_GATES_PASSED_GLOBAL_SEMANTIC_REVIEW_PENDING' END AS status FROM report)
"""

_TWO = lambda x: f"printf('%.2f', {_round_to(x, 2)})"
_SHARE = lambda x: f"printf('%.1f%%', {_round_to(f'({x}) * 100', 1)})"

_COMPLEX = """, z0 AS (SELECT t.doc_id, n_sections, greatest(1, round_even(length(text) / 4.0::DOUBLE, 0)) / 600000::DOUBLE AS p, (SELECT list((CASE WHEN n_sections > 1 THEN greatest(0, len(sections) - 1) / (n_sections - 1)::DOUBLE ELSE 0::DOUBLE END) ORDER BY place)
    FROM plan q WHERE q.doc_id = t.doc_id) AS parts, coalesce((SELECT sum(n_members) FROM plan q WHERE q.doc_id = t.doc_id), 0) AS own,
    (SELECT count(*) FROM (SELECT unit_id FROM members m WHERE m.doc_id = t.doc_id GROUP BY unit_id HAVING count(DISTINCT emission) > 1)) AS twice FROM txt t),
  z1 AS (SELECT doc_id, least(1::DOUBLE, """ + _round4("p") + """) AS context, least(1::DOUBLE, greatest(0, n_sections - 1) / 20::DOUBLE) AS sect, least(1::DOUBLE, own / greatest(1, n_sections)::DOUBLE) AS density,
    CASE WHEN len(parts) > 0 THEN list_reduce(parts, lambda a, b: a + b) / len(parts) ELSE 0::DOUBLE END AS spread, least(1::DOUBLE, twice / greatest(1, n_sections)::DOUBLE) AS depend FROM z0),
  z2 AS (SELECT *, 0.3::DOUBLE * context + 0.2::DOUBLE * sect + 0.25::DOUBLE * density + 0.15::DOUBLE * spread + 0.1::DOUBLE * depend AS idx FROM z1),
  z3 AS (SELECT *, CASE WHEN idx <= 0.2::DOUBLE THEN 1 WHEN idx <= 0.4::DOUBLE THEN 2 WHEN idx <= 0.6::DOUBLE THEN 3 WHEN idx <= 0.8::DOUBLE THEN 4 ELSE 5 END AS passes FROM z2)
"""

_CHECKED = """, c0 AS (SELECT t.doc_id, (SELECT count(*) = count(DISTINCT unit_id) FROM units u WHERE u.doc_id = t.doc_id) AS a, coalesce((SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM decisions d WHERE d.doc_id = t.doc_id GROUP BY unit_id)), true) AS b,
    coalesce((SELECT bool_and(coalesce(centre <> '', false)) FROM plan p WHERE p.doc_id = t.doc_id), true) AS c,
    coalesce((SELECT bool_and(NOT (function IN ('structural', 'evidentiary') AND disposition = 'remove_fully_redundant')) FROM decisions d WHERE d.doc_id = t.doc_id), true) AS d,
    coalesce((SELECT bool_and(relation NOT IN ('uncertain', 'related_non_duplicate') OR disposition = 'human_review') FROM decisions d WHERE d.doc_id = t.doc_id), true) AS e,
    coalesce((SELECT bool_and(disposition <> 'remove_fully_redundant') FROM decisions d WHERE d.doc_id = t.doc_id), true) AS f,
    (SELECT count(*) FROM plan p WHERE p.doc_id = t.doc_id) AS families, (SELECT count(*) FROM decisions d WHERE d.doc_id = t.doc_id AND disposition = 'human_review') AS reviews FROM txt t)
"""

_STOPPED = "CASE WHEN f.doc_id IS NULL THEN 'No further deterministic exact-duplicate transaction is justified; semantic or partial-overlap families require model adjudication or human review.' ELSE 'Safety transaction cap reached; further processing is withheld.' END"

ORACLES = {
    "families": _BASE + "SELECT doc_id, emission, family_id, label, array_to_string(unit_ids, '|') AS unit_ids, array_to_string(sections, '|') AS sections FROM families",
    "family_labels": _BASE + "SELECT doc_id, family_id, label FROM families",
    "family_evidence": _BASE + """SELECT e.doc_id, f.family_id, f.label, e.left_id || '|' || e.right_id AS pair, lexical_overlap, concept_overlap, anchor_overlap, role_compatibility, composite
      FROM edges e JOIN members m ON e.doc_id = m.doc_id AND e.left_ord = m.ord JOIN families f ON f.doc_id = e.doc_id AND f.emission = m.emission""",
    "family_means": _BASE + """SELECT doc_id, family_id, count(*) AS pairs, """ + _round4("list_reduce(list(composite ORDER BY left_ord, right_ord), lambda p, q: p + q) / count(*)") + """ AS mean_composite FROM (SELECT e.*, f.family_id
      FROM edges e JOIN members m ON e.doc_id = m.doc_id AND e.left_ord = m.ord JOIN families f ON f.doc_id = e.doc_id AND f.emission = m.emission) GROUP BY doc_id, family_id""",
    "centre_scores": _BASE + "SELECT doc_id, family_id, title AS section_title, score, strongest FROM scores JOIN families USING (doc_id, emission)",
    "centre_choice": _BASE + "SELECT doc_id, family_id, centre, centre_score, strongest, competing_centre, competing_score FROM choice JOIN families USING (doc_id, emission)",
    "unit_decisions": _BASE + """SELECT doc_id, emission, family_id, ord, unit_id, title AS section_title, centre, relation, function, disposition, confidence, rationale, array_to_string(residual, '|') AS unique_residual_tokens,
      len(tokens) AS n_tokens FROM decisions""",
    "disposition_counts": _BASE + "SELECT doc_id, disposition, count(*) AS occurrences FROM decisions GROUP BY doc_id, disposition",
    "family_risk": _BASE + "SELECT doc_id, family_id, risk_score, risk_band FROM plan",
    "family_plan": _BASE + f"""SELECT doc_id, place, emission, family_id, label, array_to_string(unit_ids, '|') AS unit_ids, array_to_string(sections, '|') AS sections, centre, centre_score, competing_centre, competing_score, risk_score, risk_band,
      n_members, centre || ' has the strongest ' || replace(strongest, '_', ' ') || ' role fit and can host the canonical treatment.' || CASE WHEN competing_centre IS NULL THEN ' It is the only functionally competent candidate section.'
        ELSE ' It scored ' || {_TWO('centre_score')} || ' versus ' || {_TWO('competing_score')} || ' for ' || competing_centre || '.' END || ' Redistribution risk is ' || risk_band || ' (' || {_TWO('risk_score')}
        || '); protected and uncertain occurrences remain outside the centre.' AS rationale FROM plan""",
    "analysis_invariants": _BASE + _CHECKED + """SELECT doc_id, a AS stable_unique_unit_ids, b AS all_family_occurrences_have_one_decision, c AS every_family_has_a_gravity_centre, d AS protected_occurrences_are_not_removed,
      e AS uncertain_occurrences_fail_closed, f AS no_automatic_deletion_before_rewrite_verification, families, reviews,
      array_to_string(list_filter([CASE WHEN reviews > 0 THEN reviews || ' occurrence decision(s) require human or model-assisted adjudication.' END, CASE WHEN families = 0 THEN 'No recurrence family crossed the conservative candidate threshold.' END,
        CASE WHEN NOT (a AND b AND c AND d AND e AND f) THEN 'At least one structural invariant failed.' END], lambda x: x IS NOT NULL), '|') AS warnings,
      CASE WHEN NOT (a AND b AND c AND d AND e AND f) THEN 'NOT_VERIFIED' WHEN reviews > 0 THEN 'ANALYSIS_COMPLETE_REWRITE_WITHHELD' ELSE 'ANALYSIS_VERIFIED_REWRITE_NOT_YET_RUN' END AS status FROM c0""",
    "complexity": _BASE + _COMPLEX + f"""SELECT doc_id, {_round4('context')} AS context_pressure, {_round4('sect')} AS section_complexity, {_round4('density')} AS repetition_density, {_round4('spread')} AS thematic_dispersion,
      {_round4('depend')} AS cross_section_dependency, {_round4('idx')} AS complexity_index, passes AS planned_passes, 'Initial cap ' || passes || ': context pressure ' || {_SHARE('context')} || ', section complexity ' || {_SHARE('sect')}
      || ', recurrence density ' || {_SHARE('density')} || ', thematic dispersion ' || {_SHARE('spread')} || ', cross-family dependency ' || {_SHARE('depend')} || '. The cap is adaptive and may stop early; it is never a mandatory rewrite count.' AS rationale FROM z3""",
    "transactions": _BASE + """SELECT doc_id, emission, place, family_id, 'tx_' || substr(sha256(base || '|' || family_id), 1, 12) AS transaction_id, base AS base_document_hash, CASE WHEN passed THEN 'committed' ELSE 'rolled_back' END AS state, centre,
      array_to_string(changed, '|') AS changed_unit_ids, true AS ledger_reconciled, anchored AS anchors_preserved, true AS scope_isolated, resolves AS cross_references_resolve, fresh AS new_duplication_absent, 'passed' AS semantic_adjudication,
      array_to_string(coalesce(failures, []), '|') AS failures, array_to_string(list_sort(unit_ids), '|') AS signature, sha256(revised) AS revised_sha256 FROM tx JOIN after USING (doc_id, emission)""",
    "compare_view": _BASE + """SELECT d.doc_id, 'tx_' || substr(sha256(base || '|' || x.family_id), 1, 12) AS transaction_id, CASE WHEN passed THEN 'committed' ELSE 'rolled_back' END AS state, x.centre, d.unit_id, d.text AS before, d.repair AS after
      FROM donors d JOIN tx x USING (doc_id, emission) WHERE safe""",
    "safe_pass_documents": _BASE + _ROUND + f"""SELECT t.doc_id, sha256(t.text) AS revised_sha256, CASE WHEN f.doc_id IS NULL THEN coalesce(left_over, 0) ELSE 0 END AS eligible_families_remaining, {_STOPPED} AS stop_reason
      FROM txt2 t LEFT JOIN first f USING (doc_id) LEFT JOIN ready USING (doc_id)""",
    "conservation_ledger": _BASE + _ROUND + "SELECT doc_id, ord, unit_id, disposition, destination FROM led",
    "global_report": _BASE + _ROUND + f"""SELECT doc_id, units AS original_unit_count, accounted AS accounted_unit_count, {_round4('accounted / greatest(1, units)::DOUBLE')} AS ledger_coverage, array_to_string(missing, '|') AS missing_unit_ids,
      array_to_string(gone, '|') AS missing_hard_anchors, open AS unresolved_occurrences, fresh AS newly_introduced_family_count, true AS all_transactions_committed, true AS all_transaction_checks_passed, status,
      array_to_string(failures, '|') AS failures FROM judged""",
    "certification": _BASE + _ROUND + f"""
      , b AS (SELECT j.*, len(failures) = 0 AND accounted = units AS formal, length(t.text) / 4.0::DOUBLE / 600000 <= 0.55::DOUBLE AS whole FROM judged j JOIN txt t USING (doc_id)),
      c AS (SELECT *, CASE WHEN NOT formal THEN 'NOT_RUN' WHEN open > 0 THEN 'NOT_RUN' WHEN NOT whole THEN 'WITHHELD' ELSE 'MODEL_UNAVAILABLE' END AS semantic_status,
        CASE WHEN NOT formal THEN 'Formal conservation failed; semantic certification is blocked.' WHEN open > 0 THEN open || ' occurrence(s) remain unresolved after family adjudication.'
          WHEN NOT whole THEN 'Whole-document semantic certification is withheld because this input requires structural chunking.' ELSE 'A model transport is required for independent global semantic review.' END AS semantic_reason FROM b)
      SELECT c.doc_id, CASE WHEN f.doc_id IS NULL THEN coalesce(left_over, 0) ELSE 0 END AS eligible_families_remaining, {_STOPPED} AS stop_reason, 'MODEL_UNAVAILABLE' AS model_status, status AS formal_status, semantic_status, semantic_reason,
        false AS eligible, 'NOT YET VERIFIED' AS label, array_to_string(list_concat(failures, [CASE WHEN open > 0 THEN open || ' occurrence(s) still require semantic adjudication' ELSE semantic_reason END]), '|') AS reasons
      FROM c LEFT JOIN first f USING (doc_id) LEFT JOIN ready USING (doc_id)""",
    "pass_metrics": _BASE + _ROUND + f""", y AS (SELECT doc_id, (SELECT sum(len(tokens)) FROM units2 u WHERE u.doc_id = t.doc_id) AS mass,
        coalesce((SELECT sum(len(tokens)) FROM decisions2 d WHERE d.doc_id = t.doc_id AND disposition IN ('merge_into_centre', 'remove_fully_redundant')), 0) AS redundant,
        (SELECT list((CASE WHEN n_sections > 1 THEN greatest(0, len(sections) - 1) / (n_sections - 1)::DOUBLE ELSE 0::DOUBLE END) ORDER BY place) FROM plan2 q WHERE q.doc_id = t.doc_id) AS parts FROM txt2 t)
      SELECT j.doc_id, 1 AS pass_number, {_round4('redundant / greatest(1, mass)::DOUBLE')} AS repetition_burden, {_round4('accounted / greatest(1, units)::DOUBLE')} AS substantive_ledger_coverage,
        {_round4('CASE WHEN len(parts) > 0 THEN list_reduce(parts, lambda a, b: a + b) / len(parts) ELSE 0::DOUBLE END')} AS thematic_dispersion, open AS unresolved_occurrences, array_to_string(failures, '|') AS critical_failures
      FROM judged j JOIN y USING (doc_id)""",
    "staged_views": _BASE + """, v AS (SELECT doc_id, '1 read' AS view FROM txt UNION ALL SELECT doc_id, '2 ledger' FROM units UNION ALL SELECT doc_id, '3 recurrences' FROM families UNION ALL SELECT doc_id, '4 classify' FROM decisions
      UNION ALL SELECT doc_id, '5 centres' FROM choice UNION ALL SELECT doc_id, '6 plan' FROM plan UNION ALL SELECT doc_id, '7 pass' FROM tx UNION ALL SELECT doc_id, '8 verify' FROM txt UNION ALL SELECT doc_id, '9 report' FROM txt)
      SELECT doc_id, view, count(*) AS n FROM v GROUP BY doc_id, view""",
    "gate_adjudication": _BASE + """, x AS (SELECT f.*, (SELECT list_sort(list_distinct(list(title))) FROM lines l WHERE l.doc_id = f.doc_id) AS titles FROM families f),
      c AS (SELECT *, unnest(range(9)) AS "case" FROM x)
      SELECT doc_id, family_id, "case"::INT AS "case", CASE "case" WHEN 0 THEN NULL WHEN 1 THEN 'Adjudication keys do not match the strict contract'
        WHEN 2 THEN 'Adjudication ledger mismatch; missing=[''' || array_to_string(list_sort(unit_ids[2:]), ''', ''') || '''], extra=[]' WHEN 3 THEN 'Adjudication contains duplicate occurrence IDs'
        WHEN 4 THEN 'Model proposed full removal while unique residual payload remains' WHEN 5 THEN 'Risked hard anchors require preservation or human review' WHEN 6 THEN 'Adjudication returned the wrong family ID'
        WHEN 7 THEN 'Adjudication selected a gravity centre that does not exist' ELSE CASE WHEN len(titles) = len(sections) THEN 'Adjudication selected a gravity centre that does not exist'
          ELSE 'Adjudication selected a gravity centre with no family occurrence' END END AS error FROM c""",
    "gate_proposal": _BASE + """, c AS (SELECT *, unnest(range(10)) AS "case" FROM families)
      SELECT doc_id, family_id, "case"::INT AS "case", CASE "case" WHEN 0 THEN NULL WHEN 1 THEN 'Rewrite proposal does not match the family contract' WHEN 2 THEN 'Rewrite proposal does not match the family contract'
        WHEN 3 THEN 'Rewrite proposal contains invalid or duplicate donor IDs' WHEN 4 THEN 'Rewrite receiver is outside the recurrence family' WHEN 5 THEN 'Rewrite receiver is outside the selected gravity centre'
        WHEN 6 THEN 'Source binding failed for ' || unit_ids[2] WHEN 7 THEN 'Hard-anchor inventory mismatch for ' || unit_ids[2] WHEN 8 THEN 'Full removal is forbidden while residual payload remains'
        ELSE 'changed_unit_ids does not match the actual proposal scope' END AS error FROM c""",
    "gate_verification": _BASE + """, c AS (SELECT *, unnest(range(6)) AS "case" FROM families)
      SELECT doc_id, family_id, "case"::INT AS "case", CASE "case" WHEN 1 THEN 'Semantic verification does not match the family contract' WHEN 2 THEN 'Semantic verification does not reconcile every family unit exactly once'
        WHEN 3 THEN 'Semantic verifier claimed pass despite a failed check' WHEN 4 THEN 'Semantic verifier claimed pass despite a failed check' END AS error FROM c""",
    "gate_global": _BASE + """, x AS (SELECT doc_id, min(unit_id) AS unit_id FROM units GROUP BY doc_id), c AS (SELECT *, unnest(range(5)) AS "case" FROM x)
      SELECT doc_id, "case"::INT AS "case", CASE "case" WHEN 1 THEN 'Global semantic verification keys do not match the strict contract' WHEN 2 THEN 'Global semantic ledger mismatch; missing=[''' || unit_id || '''], extra=[]'
        WHEN 3 THEN 'Global semantic verifier claimed pass despite a failed check' END AS error FROM c""",
}
