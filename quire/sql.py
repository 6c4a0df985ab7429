"""DuckDB SQL of the queries that SQL can express, written independently of the DataFrame plans."""

from __future__ import annotations

# Fixed values, written out here once more so that a wrong word on one side shows.
STOPWORDS = "a an and are as at be by for from has have in into is it its of on or that the their this to was were will with".split()
CONCEPT_GROUPS = ['repeat repetition redundancy duplicate restatement recur', 'preserve retain conserve keep maintain', 'evidence proof record support data', 'risk danger hazard threat',
 'remove delete eliminate subtract cut', 'centre center home location section', 'recommend propose advise should', 'verify validate check confirm']
ROLE_MARKERS = [('cross_reference', ['see ', 'refer to', 'as set out in', 'as explained in']), ('qualification', ['provided that', 'subject to', 'only if', 'unless']),
 ('limitation', ['however', 'limited to', 'does not', 'cannot']), ('exception', ['except', 'other than', 'save for']),
 ('evidence', ['evidence', 'recorded', 'measurement', 'data show', 'observed']), ('recommendation', ['recommend', 'should', 'must implement', 'propose']),
 ('consequence', ['therefore', 'consequently', 'as a result']), ('definition', ['means', 'is defined as', 'refers to']), ('reason', ['because', 'since', 'owing to'])]
TITLE_RULES = [('summary', ['summary', 'overview', 'abstract']), ('analytical', ['analysis', 'discussion', 'assessment']), ('recommendatory', ['recommendation', 'remedy', 'proposal']),
 ('conclusive', ['conclusion', 'closing']), ('structural', ['method', 'procedure', 'protocol'])]
EVIDENCE_TITLES = ['evidence', 'record', 'finding']
TITLES = ['Executive Summary', 'Method', 'Background', 'Evidence', 'Analysis', 'Recommendations', 'Conclusion']

_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160)"
_W = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANK})"


def _split(x: str) -> str:
    """Sentences; RE2 has no lookaround, and the classes on both sides of the gap are disjoint."""
    return rf"""string_split(regexp_replace({x}, '([.!?]){_W}+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


def _norm(x: str) -> str:
    inner = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\p{{Z}}%$€£-]', ' ', 'g')"
    return rf"trim(regexp_replace({inner}, '{_W}+', ' ', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOP = _list(STOPWORDS)


def _round_to(x: str, places: int) -> str:
    """round-half-even of the exact binary value, as integers; x up to 1000."""
    ten = 10**places
    k = f"CAST(floor(({x}) * {ten}) AS HUGEINT)"

    def by(bits: int) -> str:
        n, m = f"CAST(({x}) * {2.0**bits!r}::DOUBLE AS HUGEINT) * {2 * ten}", f"(2 * {k} + 1) * {2**bits}::HUGEINT"
        return f"({k} + CASE WHEN {n} > {m} THEN 1 WHEN {n} < {m} THEN 0 ELSE {k} % 2 END) / {ten}.0::DOUBLE"

    return f"CASE WHEN ({x}) < 0.0009765625 THEN {by(72)} WHEN ({x}) <= 1 THEN {by(62)} ELSE {by(52)} END"


def _round4(x: str) -> str:
    return _round_to(x, 4)


# plain documents: one section, one paragraph, for the corpus has no blank lines
_PLAIN = f"""
WITH s AS (SELECT doc_id, unnest({_split('text')}) AS raw, generate_subscripts({_split('text')}, 1) AS i FROM documents WHERE {_strip('text')} <> ''),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, {_strip('raw')} AS text FROM s WHERE {_strip('raw')} <> ''),
n AS (SELECT *, {_norm('text')} AS norm FROM u),
t AS (SELECT *, CASE WHEN norm = '' THEN [] ELSE list_sort(list_distinct(string_split(norm, ' '))) END AS tokens FROM n),
c AS (SELECT *, list_filter(tokens, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)) AS content FROM t)
"""

_CONCEPT = "CASE " + " ".join(f"WHEN list_contains({_list(g.split())}, x) THEN 'c{i}'" for i, g in enumerate(CONCEPT_GROUPS)) + " ELSE x END"
_CASE_TITLE = _TITLES = "CASE (i - 1) % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TITLES)) + " END"


def _sectioned(line: str = "line") -> str:
    """Lines with titles in turn; each line is a section of one paragraph."""
    return f"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE {_strip('text')} <> ''),
l AS (SELECT doc_id, i, {_CASE_TITLE} AS title, {line} AS line FROM l0),
p AS (SELECT *, coalesce(sum(length(title) + 6 + length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM l),
s AS (SELECT doc_id, i, title, pos0, unnest({_split('line')}) AS raw, generate_subscripts({_split('line')}, 1) AS k, line FROM p),
u AS (SELECT doc_id, i, title, pos0, k, line, {_strip('raw')} AS text FROM s WHERE {_strip('raw')} <> ''),
n AS (SELECT *, {_norm('text')} AS norm, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS sent, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS ord FROM u),
t AS (SELECT *, CASE WHEN norm = '' THEN [] ELSE list_sort(list_distinct(string_split(norm, ' '))) END AS tokens FROM n),
c AS (SELECT *, list_filter(tokens, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)) AS content FROM t),
r AS (SELECT *, list_distinct(list_transform(content, lambda x: {_CONCEPT})) AS concepts, {_role('text')} AS role FROM c)
"""


def _role(text: str) -> str:
    out = "CASE "
    for role, words in ROLE_MARKERS:
        out += "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{role}' "
    return out + "ELSE 'claim' END"


def _function(title: str, role: str) -> str:
    out = "CASE "
    for name, words in TITLE_RULES:
        out += "WHEN " + " OR ".join(f"contains(lower({title}), '{w}')" for w in words) + f" THEN '{name}' "
    out += f"WHEN {role} = 'evidence' OR " + " OR ".join(f"contains(lower({title}), '{w}')" for w in EVIDENCE_TITLES) + " THEN 'evidentiary' "
    return out + f"WHEN {role} = 'definition' THEN 'definitory' ELSE 'context' END"


_MARK = "line || CASE (i - 1) % 9 " + " ".join(f"WHEN {k} THEN ' {w[0].strip().capitalize()} it.'" for k, (_, w) in enumerate(ROLE_MARKERS)) + " END"

_ANCHORED = f"""
WITH d AS (SELECT doc_id, coalesce(text || chr(10), '') || 'The "Record ' || doc_id || '" kept $' || n_chars || '.50 and 12% of ' || source
           || ' in Open Data Set (Smith 2024) [see ' || doc_id || '].' AS text FROM documents),
s AS (SELECT doc_id, unnest({_split('text')}) AS raw, generate_subscripts({_split('text')}, 1) AS i FROM d),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, {_strip('raw')} AS text FROM s WHERE {_strip('raw')} <> '')
"""

_OVERLAP = "CASE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE greatest({s} / ({a} + {b} - {s})::DOUBLE, 0.75::DOUBLE * ({s} / least({a}, {b})::DOUBLE)) END"
_WORDS = r"\p{L}\p{N}_"
_NUMBERS = rf"regexp_extract_all(text, '(?:^|[^{_WORDS}])([$€£]?\p{{Nd}}[\p{{Nd}},.]*(?:%|{_W}*(?i:USD|EUR|GBP))?)(?:$|[^{_WORDS}])', 1)"
_CITED = rf"regexp_extract_all(text, '\[[^\]]+\]|\([^)]*\b(?:19|20)\p{{Nd}}{{2}}[^)]*\)', 0)"
_TERMS = rf"regexp_extract_all(text, '(?:^|[^{_WORDS}])([A-Z][A-Za-z]+(?:{_W}+[A-Z][A-Za-z]+){{1,4}})(?:$|[^{_WORDS}])', 1)"

_PAIRS = _sectioned() + f"""
, h AS (SELECT *, list_distinct(list_concat(list_concat({_NUMBERS}, {_CITED}), {_TERMS})) AS hard FROM r),
e AS (SELECT a.doc_id, a.ord AS left_ord, b.ord AS right_ord,
  {_OVERLAP.format(a='len(a.content)', b='len(b.content)', s='len(list_intersect(a.content, b.content))')} AS lex,
  {_OVERLAP.format(a='len(a.concepts)', b='len(b.concepts)', s='len(list_intersect(a.concepts, b.concepts))')} AS con,
  CASE WHEN len(a.hard) + len(b.hard) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(a.hard, b.hard)) / len(list_distinct(list_concat(a.hard, b.hard)))::DOUBLE END AS anc,
  CASE WHEN a.role = b.role THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS rol
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.ord < b.ord AND list_has_any(a.concepts, b.concepts)),
f AS (SELECT *, 0.35::DOUBLE * lex + 0.35::DOUBLE * con + 0.15::DOUBLE * anc + 0.15::DOUBLE * rol AS raw FROM e),
g AS (SELECT doc_id, left_ord, right_ord, {_round4('lex')} AS lexical_overlap, {_round4('con')} AS concept_overlap, {_round4('anc')} AS anchor_overlap, {_round4('rol')} AS role_compatibility,
  {_round4('raw')} AS composite FROM f)
"""

ORACLES = {
    "admit_documents": f"""SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'doc_id is missing' WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'doc_id is repeated' WHEN text IS NULL THEN 'text is missing' WHEN {_strip('text')} = '' THEN 'document is empty'
      WHEN strlen(text) > 20000 THEN 'document is too large' ELSE 'admitted' END AS outcome FROM documents""",
    "sections": _sectioned() + "SELECT doc_id, printf('s_%03d', i) AS section_id, title, 2 AS level, (pos0 + 4 + length(title) - 1 + (CASE WHEN true THEN 1 ELSE 0 END))::INT AS start FROM p",
    "doc_title": _sectioned() + "SELECT DISTINCT doc_id, 'Executive Summary' AS title FROM p",
    "resource_plan": _sectioned() + """, z AS (SELECT doc_id, greatest(1, round_even(max(pos0 + length(title) + 5 + length(line)) / 4.0::DOUBLE, 0))::INT AS tok, count(*) AS n FROM p GROUP BY doc_id),
      q AS (SELECT *, tok / 600.0::DOUBLE AS x FROM z)
      SELECT doc_id, tok AS estimated_tokens, 1000 AS configured_context_limit, 600 AS safe_input_budget, """ + _round4("x") + """ AS context_pressure,
      CASE WHEN x <= 0.55 THEN 'whole_document' WHEN x <= 1 THEN 'section_chunks_with_global_synthesis' ELSE 'overlapping_structural_chunks_with_global_ledger' END AS strategy,
      CASE WHEN x <= 0.55 THEN 1 WHEN x <= 1 THEN greatest(2, n) ELSE greatest(n, floor(x)::INT + 2) END AS overlapping_chunks, 1 + (x > 0.45)::INT + (x > 0.85)::INT AS initial_pass_cap,
      'Estimated input uses ' || printf('%.1f%%', """ + _round_to("x * 100", 1) + """) || ' of the configured safe input budget; selected ' || strategy || '. The pass count is a safety cap, not a mandatory rewrite count.' AS rationale FROM q""",
    "normalize_units": _PLAIN + "SELECT doc_id, ord, text, norm AS normalized_text FROM n",
    "unit_ledger": _sectioned() + """SELECT doc_id, ord, 'u_' || substr(sha256(printf('s_%03d', i) || '|0|' || sent || '|' || norm), 1, 12) AS unit_id, printf('s_%03d', i) AS section_id, title AS section_title,
      0 AS paragraph_index, sent AS sentence_index FROM n""",
    "unit_offsets": _sectioned() + """, w AS (SELECT *, pos0 + 5 + length(title) AS base FROM n),
      f AS (SELECT doc_id, i, k, ord, base, line, text, sum(length(text)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
      SELECT doc_id, ord, (base + coalesce(before, 0) + sent_gap)::INT AS char_start, (base + coalesce(before, 0) + sent_gap + length(text))::INT AS char_end
      FROM (SELECT f.*, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 + length(line) - length(ltrim(line, """ + _BLANK + """)) AS sent_gap FROM f)""",
    "unit_tokens": _PLAIN + "SELECT doc_id, ord, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n_tokens FROM t",
    "discourse_role": _sectioned(_MARK) + "SELECT doc_id, ord, role FROM r",
    "local_function": _sectioned(_MARK) + f"SELECT doc_id, ord, title AS section_title, {_function('title', 'role')} AS function FROM r",
    "anchors_numbers": _ANCHORED + r"""SELECT doc_id, ord, array_to_string(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_$])([$]?[0-9][0-9,.]*%?)', 1), '|') AS numbers FROM u""",
    "anchors_quotations": _ANCHORED + """SELECT doc_id, ord, array_to_string(regexp_extract_all(text, '"([^"]{2,})"', 1), '|') AS quotations FROM u""",
    "anchors_citations": _ANCHORED + r"""SELECT doc_id, ord, array_to_string(regexp_extract_all(text, '\[[^\]]+\]|\([^)]*\b(?:19|20)[0-9]{2}[^)]*\)', 0), '|') AS citations FROM u""",
    "anchors_terms": _ANCHORED + r"""SELECT doc_id, ord, array_to_string(regexp_extract_all(text, '\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4}\b', 0), '|') AS defined_terms FROM u""",
    "content_concepts": _PLAIN + f"SELECT doc_id, ord, array_to_string(content, ' ') AS content, array_to_string(list_sort(list_distinct(list_transform(content, lambda x: {_CONCEPT}))), ' ') AS concepts FROM c",
    "exact_repeat_families": _sectioned() + """SELECT doc_id, norm AS normalized_text, count(*) AS occurrences, min(ord) AS first_ord, count(DISTINCT title) AS titles FROM c WHERE len(content) > 0
      GROUP BY doc_id, norm HAVING count(*) > 1""",
    "section_units": _sectioned() + "SELECT doc_id, title AS section_title, count(*) AS n_units FROM n GROUP BY doc_id, title",
    "pair_evidence": _PAIRS + "SELECT * FROM g",
    "candidate_edges": _PAIRS + "SELECT doc_id, left_ord, right_ord, composite FROM g WHERE composite >= 0.43::DOUBLE",
    "degree": _PAIRS + """, w AS (SELECT * FROM g WHERE composite >= 0.43::DOUBLE)
      SELECT doc_id, ord, count(*) AS degree FROM (SELECT doc_id, left_ord AS ord FROM w UNION ALL SELECT doc_id, right_ord AS ord FROM w) GROUP BY doc_id, ord""",
    "canonical_hashes": f"SELECT doc_id, sha256(text) AS document_hash, sha256({_strip('replace(text, chr(13) || chr(10), chr(10))')} || chr(10)) AS canonical_hash FROM documents",
    "rounding": "SELECT l_orderkey, l_linenumber, " + _round4("(l_linenumber * l_partkey % 20001) / 20000.0::DOUBLE") + " AS rounded FROM lineitem",
    "continuation": """
      WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS pass_number, CASE WHEN l_partkey % 3 = 0 THEN 0::DOUBLE ELSE l_tax END AS burden, CASE WHEN l_suppkey % 10 = 0 THEN 0.99 ELSE 1 END AS cover,
        l_discount / 4 AS inst, l_quantity::INT % 3 AS unres, l_returnflag = 'R' AND l_partkey % 7 = 0 AS crit, least(5, greatest(1, l_partkey % 6)) AS planned, l_discount * 8 AS risk,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax + l_discount / 8 END AS prev FROM lineitem),
      a AS (SELECT *, CASE WHEN crit OR cover < 1 THEN 'STOP_NOT_VERIFIED' WHEN risk >= 0.7::DOUBLE THEN 'STOP_HUMAN_REVIEW' WHEN unres = 0 AND burden = 0 THEN 'STOP_STABLE'
        WHEN prev IS NOT NULL AND inst < 0.02::DOUBLE AND prev - burden < 0.01::DOUBLE THEN 'STOP_STABLE' WHEN pass_number >= 5 THEN 'STOP_SAFETY_CAP'
        WHEN pass_number >= planned AND (unres > 0 OR burden > 0) THEN 'ADD_PASS' ELSE 'CONTINUE' END AS action FROM g),
      b AS (SELECT doc_id, pass_number, action, CASE action WHEN 'STOP_NOT_VERIFIED' THEN 'A critical invariant or ledger-coverage check failed; the document must roll back or enter human review.'
          WHEN 'STOP_HUMAN_REVIEW' THEN 'Expected consolidation benefit no longer exceeds the measured conservation risk.'
          WHEN 'STOP_STABLE' THEN CASE WHEN unres = 0 AND burden = 0 THEN 'No material accidental recurrence remains and the complete ledger is reconciled.' ELSE 'Change instability is below 2% and marginal burden improvement is below 1%.' END
          WHEN 'STOP_SAFETY_CAP' THEN 'The absolute five-pass safety cap was reached with unresolved work; certification is withheld.'
          WHEN 'ADD_PASS' THEN 'Unresolved dispersion remains after the initial plan; one bounded pass was added.'
          ELSE 'Material recurrence remains, ledger coverage is complete, and expected benefit exceeds conservation risk.' END AS reason, CASE WHEN action = 'ADD_PASS' THEN least(5, planned + 1) ELSE planned END AS passes_initially_planned FROM a)
      SELECT *, CASE WHEN action IN ('ADD_PASS', 'CONTINUE') THEN greatest(0, passes_initially_planned - pass_number) ELSE 0 END AS estimated_passes_remaining FROM b""",
    "word_counts": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\t-\r\x1c-\x20\x{85}\p{Z}]+')) AS words FROM documents",
    "previous_pass": """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS pass_number, min(l_tax) AS repetition_burden FROM lineitem GROUP BY l_orderkey, l_linenumber)
      SELECT *, lag(repetition_burden) OVER (PARTITION BY doc_id ORDER BY pass_number) AS previous_burden FROM p""",
    "paragraph_units": f"""
      WITH l AS (SELECT doc_id, {_CASE_TITLE.replace('(i - 1) % 7', '((doc_id % 7) + 7) % 7')} AS title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
      p AS (SELECT *, 4 + length(title) + coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l),
      q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS par FROM p WHERE {_strip('line')} <> ''),
      s AS (SELECT *, unnest({_split('line')}) AS raw, generate_subscripts({_split('line')}, 1) AS k FROM q),
      g AS (SELECT *, base + coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot, {_strip('raw')} AS text FROM s),
      h AS (SELECT *, spot + length(raw) - length(ltrim(raw, {_BLANK})) AS char_start FROM g WHERE text <> '')
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS ord, par::INT AS paragraph_index, (row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1)::INT AS sentence_index,
        char_start::INT AS char_start, (char_start + length(text))::INT AS char_end, title FROM h""",
}
