"""SQL of the registered queries for DuckDB, as common table expressions that build on each other."""

from __future__ import annotations

from sievelake.functions import lexicons as L
from sievelake.operators import issues
from sievelake.sources.applicants import APPLICANTS_CTE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def terms(text: str, vocabulary) -> str:
    """Terms of a vocabulary in a text, by one pattern for each."""
    return f"list_filter({array(vocabulary)}, lambda k: contains(lower({text}), k) AND regexp_matches(lower({text}), '(^|[^a-z0-9+#.])' || regexp_escape(k) || '([^a-z0-9+#.]|$)'))"


def signals(text: str, words) -> str:
    return f"list_filter({array(words)}, lambda k: contains(lower({text}), k))"


MARK = "^[-•*▪◦‣·–—>]"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
IS_BULLET = f"(regexp_matches(line, '{MARK}') OR (length(line) > 40 AND regexp_matches(line, '^[A-Z][a-z]+(ed|ing)\\b')))"
HEADER = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i)\\b(?:{w})\\b') THEN '{n}'" for n, w in L.HEADERS) + " END"
OPENS = f"(NOT (regexp_matches(line, '{MARK}') OR (length(line) > 40 AND regexp_matches(line, '^[A-Z]'))) AND length(line) < 50 AND NOT regexp_matches(line, '(?i)^(20\\d\\d|19\\d\\d|{MONTHS})'))"
FIRST = "string_split_regex(regexp_replace(lower(bullet), '[^a-z\\s]', ' ', 'g'), '\\s+')[1:2]"
WEAK = "(" + " OR ".join(f"starts_with(lower(bullet), '{p}') OR contains(lower(bullet), ' {p}')" for p in L.PASSIVE_PHRASES) + ")"
DATES = (
    "(regexp_matches(raw_text, '(?i)(?:19|20)\\d{2}\\s*(?:[-–—]|to)\\s*(?:(?:19|20)\\d{2}|present|current)')"
    " OR regexp_matches(raw_text, '(?i)\\b(?:0?[1-9]|1[0-2])/(?:19|20)\\d{2}\\s*[-–—]\\s*(?:0?[1-9]|1[0-2])/(?:19|20)\\d{2}\\b')"
    f" OR regexp_matches(raw_text, '(?i)\\b(?:{MONTHS})[a-z]*\\s+(?:19|20)\\d{{2}}\\s*[-–—]'))"
)
EMAIL = "[\\w.+-]+@[\\w-]+\\.[\\w.]+"
IGNORED = issues.IGNORED.replace("'", "''")
SPELLING = [f"(?i)\\b(?:{p})\\b".replace("'", "''") for p, _, _ in L.SPELLING]
ANY_MISSPELLING = f"(?i)\\b(?:{'|'.join(p for p, _, _ in L.SPELLING)})\\b".replace("'", "''")
MISSPELLINGS = " + ".join(f"len(list_distinct(list_transform(regexp_extract_all(m, '{p}'), lambda e: lower(e))))" for p in SPELLING)
#: Words with digits for letters, that a list of correct words tells.
DAMAGED = (
    "list_filter(regexp_extract_all(m, '(?i)\\b(?:[a-z]+\\d[a-z0-9]*|[a-z0-9]*\\d[a-z]+)\\b'), lambda e: length(e) >= 3 AND NOT regexp_matches(e, '" + issues.TECHNICAL + "') AND NOT regexp_matches(e, '(?i)^(v\\d|\\d+\\.\\d|0x|#[0-9a-f])')"
    f" AND translate(lower(e), '01586372', 'olsbgetz') <> lower(e) AND list_contains({array(issues.REFERENCE_WORDS)}, translate(lower(e), '01586372', 'olsbgetz')))"
)
#: Words of three letters or more said twice, but no numbers; a pair's second word is not the first of another. An odd state has just counted one.
REPEATED = (
    "list_reduce(list_prepend(0, list_transform(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '^[a-z0-9_]')), lambda i: CASE WHEN length(w[i]) >= 3 AND regexp_matches(w[i], '[a-z_]')"
    " AND w[i] = w[i + 2] AND trim(w[i + 1], ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1 ELSE 0 END)), lambda a, x: CASE WHEN x = 1 AND a % 2 = 0 THEN a + 3 ELSE a - a % 2 END) // 2"
)
MASKED = f"""masked AS (
      SELECT doc_id, raw_text, CASE WHEN regexp_matches(raw_text, '[@:/]|\\.[A-Za-z]') THEN array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(repeat(chr(1), length(e[i])), '')), '') ELSE raw_text END AS m
      FROM (SELECT doc_id, raw_text, string_split_regex(raw_text, '{IGNORED}') AS p, regexp_extract_all(raw_text, '{IGNORED}') AS e FROM applicants))"""
CTES = {
    "applicants": APPLICANTS_CTE,
    "lines": """lines AS (
      SELECT doc_id, i - 1 AS line_no, trim(w[i]) AS line FROM (SELECT doc_id, string_split(raw_text, chr(10)) AS w FROM applicants), unnest(range(1, len(w) + 1)) AS u(i) WHERE trim(w[i]) <> '')""",
    "sections": f"""titled AS (
      SELECT *, trim(regexp_replace(line, '^[#•\\-*|>:\\s]+|[#•\\-*|>:\\s]+$', '', 'g')) AS title FROM lines
    ), headed AS (
      SELECT *, CASE WHEN length(line) <= 65 AND NOT regexp_matches(line, '^[-•*▪◦‣·–—>\\d.]\\s') AND title <> '' THEN {HEADER} END AS header FROM titled
    ), numbered AS (
      SELECT *, count(header) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'contact') AS type FROM headed
    ), marked AS (
      SELECT *, max(section_no) OVER (PARTITION BY doc_id) AS last_no, CASE WHEN {IS_BULLET} THEN trim(regexp_replace(line, '{MARK}+\\s*', '')) END AS bullet FROM numbered
    ), sections AS (
      SELECT *, CASE WHEN header IS NULL OR section_no < last_no THEN type END AS real_type FROM marked)""",
    "features": f"""placed AS (
      SELECT *, min(CASE WHEN real_type = 'projects' THEN section_no END) OVER (PARTITION BY doc_id) AS first_projects FROM sections
    ), line_features AS (
      SELECT doc_id, count(bullet) AS bullets, count(*) FILTER (regexp_matches(bullet, '(?i){L.QUANTIFIED}')) AS quantified,
        coalesce(max(len(string_split_regex(bullet, '\\s+'))), 0) AS longest_bullet, coalesce(sum(len(string_split_regex(bullet, '\\s+'))), 0) AS bullet_words,
        count(*) FILTER (list_has_any({FIRST}, {array(L.POWER_VERBS)})) AS power_verbs, count(*) FILTER (list_has_any({FIRST}, {array(L.STANDARD_VERBS)})) AS standard_verbs,
        count(*) FILTER ({WEAK}) AS weak_bullets, coalesce(string_agg(bullet, ' ' ORDER BY line_no), '') AS bullet_text,
        coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (header IS NULL AND type IN ('experience', 'projects')), '') AS evidence,
        list_sort(list_distinct(list(real_type) FILTER (real_type IS NOT NULL))) AS section_types,
        count(*) FILTER (header IS NULL AND section_no = first_projects AND {OPENS}) AS entries,
        count(*) FILTER (header IS NULL AND type = 'projects' AND (regexp_matches(line, '{MARK}') OR length(line) > 30)) AS project_lines
      FROM placed GROUP BY doc_id
    ), {MASKED}, typo_counts AS (
      SELECT doc_id, CASE WHEN regexp_matches(m, '{ANY_MISSPELLING}') THEN {MISSPELLINGS} ELSE 0 END + least(15, len(list_distinct(list_transform({DAMAGED}, lambda e: lower(e))))) + {REPEATED} AS typos
      FROM (SELECT doc_id, m, regexp_extract_all(lower(raw_text), '[a-z0-9_]+|\\s+|[^a-z0-9_\\s]+') AS w FROM masked)
    ), features AS (
      SELECT a.*, len(list_filter(string_split_regex(raw_text, '\\s+'), lambda w: w <> '')) AS words, nullif(regexp_extract(raw_text, '{EMAIL}'), '') AS email,
        regexp_matches(raw_text, '\\+?\\d[\\d\\s().-]{{7,}}\\d') AS has_phone, regexp_matches(raw_text, '(?i)linkedin\\.com/[a-z0-9-]+') AS has_linkedin,
        regexp_matches(raw_text, '(?i)(github\\.com/|gitlab\\.com/|https?://[a-z0-9-]+\\.(dev|io|com|app|me)\\b)') AS has_portfolio, {DATES} AS has_dates,
        {terms('raw_text', L.SKILLS)} AS skills, {terms('bullet_text', L.SKILLS)} AS proven, {terms('evidence', L.HIGH_BAR_SIGNALS)} AS high_bar,
        regexp_matches(evidence, '(?i)({L.PROOF})') AS proof, f.* EXCLUDE (doc_id, bullet_text, evidence), t.typos
      FROM applicants a JOIN line_features f ON a.doc_id = f.doc_id JOIN typo_counts t ON a.doc_id = t.doc_id)""",
    "keywords": f"keywords AS (SELECT jd_id, {terms('description', L.SKILLS)} AS keywords FROM (VALUES "
    + ", ".join(f"({i}, {quoted(d[-1])})" for i, d in enumerate(L.JOB_DESCRIPTIONS))
    + ") AS t(jd_id, description))",
    "documents": "applicants AS (SELECT doc_id, source || '_' || doc_id || '.txt' AS file_name, 1 AS seq, 0 AS jd_id, 0 AS n_orders, coalesce(text, '') AS raw_text FROM documents)",
}
R1 = "greatest(0.0, floor(({}) * 10 + 0.5) / 10)"
HAS = "list_contains(section_types, '{}')"
ENOUGH = f"(entries >= 2 OR ({HAS.format('projects')} AND project_lines >= 4))"
TOOLS = "least(5.0, greatest(2.0, 2 * len(high_bar) + 0.5 * len(skills)))"
_GENERAL = (("skills", "skill-breadth", "len(skills) >= 4", "least(15.0, 2.5 * len(skills))", 15), ("skills", "skill-count", "len(proven) >= 2", "least(10.0, 3.0 * len(proven))", 10), ("skills", "tooling", "len(high_bar) >= 1 OR len(skills) >= 3", TOOLS, 5))
_CUSTOM = (
    ("skills", "jd-skills", "len(matched) >= least(4, ceil(len(keywords) * 0.35))", "least(15.0, len(matched) / len(keywords) * 10.0 + CASE WHEN len(matched) > 0 THEN proven_matched / len(matched) * 5.0 ELSE 0 END)", 15),
    ("skills", "skill-count", "len(proven) >= 2", "least(10.0, 2.5 * len(proven) + least(4.0, 0.5 * len(skills)))", 10),
    ("skills", "tooling", "len(high_bar) >= 1 OR len(skills) >= 4", TOOLS, 5),
)


def _checks(custom: bool) -> list[tuple[str, str, str, str, int]]:
    signs = (("email", "email IS NOT NULL"), ("phone", "has_phone"), ("linkedin", "has_linkedin"), ("portfolio", "has_portfolio"))
    return [
        *(("parse", n, t, f"CASE WHEN {t} THEN 5.0 ELSE 0 END", 5) for n, t in signs),
        *(_CUSTOM if custom else _GENERAL),
        ("projects", "project-count", ENOUGH, f"CASE WHEN {ENOUGH} THEN 12.0 WHEN entries = 1 OR project_lines >= 2 THEN 7 WHEN {HAS.format('projects')} THEN 4 ELSE 0 END", 12),
        ("projects", "project-depth", "quantified >= 2 OR proof", "least(8.0, greatest(3.0, quantified * 2 + CASE WHEN proof THEN 3 ELSE 0 END))", 8),
        ("projects", "project-verbs", "power_verbs >= 1 OR standard_verbs >= 2", "least(5.0, greatest(2.0, power_verbs * 2 + standard_verbs))", 5),
        ("experience", "dates", "has_dates", f"CASE WHEN has_dates THEN 7.0 WHEN {HAS.format('experience')} THEN 3 ELSE 0 END", 7),
        ("experience", "exp-explanation", f"{HAS.format('experience')} OR bullets >= 4", f"CASE WHEN {HAS.format('experience')} THEN 8.0 ELSE least(8.0, bullets * 1.5) END", 8),
        ("hygiene", "summary", HAS.format("summary"), f"CASE WHEN {HAS.format('summary')} THEN 4.0 ELSE 2 END", 4),
        ("hygiene", "typos", "typos = 0", "greatest(0.0, 6 - typos * 1.5)", 6),
    ]


def _reports(custom: bool) -> str:
    """checks (long form) and reports, general or against the job description that a document names."""
    source = "features"
    before = ""
    if custom:
        before = """kw AS (
      SELECT f.*, keywords, list_filter(keywords, lambda k: contains(lower(raw_text), k) AND regexp_matches(lower(raw_text), '(^|[^a-z0-9+#.])' || regexp_escape(k) || '([^a-z0-9+#.]|$)')) AS matched FROM features f JOIN keywords USING (jd_id)
    ), custom AS (SELECT *, len(list_filter(matched, lambda k: list_contains(proven, k))) AS proven_matched FROM kw), """
        source = "custom"
    rows = " UNION ALL ".join(f"SELECT doc_id, {n} AS nth, '{c}' AS category, '{i}' AS check_id, ({p}) AS passed, CAST({R1.format(x)} AS DOUBLE) AS points, {m} AS max FROM {source}" for n, (c, i, p, x, m) in enumerate(_checks(custom)))
    most = "CASE category WHEN 'parse' THEN 20.0 WHEN 'skills' THEN 30.0 WHEN 'projects' THEN 25.0 WHEN 'experience' THEN 15.0 ELSE 10.0 END"
    jd = "CAST(least(98.0, greatest(30.0, least(30.0, len(proven) * 5 + len(skills) * 1.5) + CASE WHEN proof THEN 10 ELSE 5 END)) AS DOUBLE)"
    if custom:
        jd = "CAST(least(100, greatest(15, floor(len(matched) / len(keywords) * 85 + least(15, proven_matched * 3) + 0.5))) AS DOUBLE)"
    bands = "CASE " + " ".join(f"WHEN score >= {b[1]} THEN '{b[0]}'" for b in L.BANDS) + " END"
    return f"""{before}checks AS ({rows}), category_scores AS (
      SELECT doc_id, category, CAST(least({most}, floor(sum(points) * 10 + 0.5) / 10) AS DOUBLE) AS score FROM checks GROUP BY doc_id, category
    ), totals AS (SELECT doc_id, floor(sum(score) + 0.5) AS total FROM category_scores GROUP BY doc_id), scored AS (
      SELECT f.*, {jd} AS jd_score, CAST(greatest(0, least(100, least(total, CASE WHEN email IS NULL THEN 60 ELSE 100 END, CASE WHEN words <= 80 THEN 40 ELSE 100 END))) AS INTEGER) AS score,
        (email IS NULL OR words <= 80) AS blocked, (CASE WHEN email IS NULL THEN 1 ELSE 0 END + CASE WHEN words <= 80 THEN 1 ELSE 0 END) AS n_blockers
      FROM {source} f JOIN totals t ON f.doc_id = t.doc_id
    ), reports AS (
      SELECT *, CASE WHEN blocked OR score < 65 THEN 'Tier 3: Overhaul Required' WHEN score >= 80 THEN 'Tier 1: Shortlist Ready' ELSE 'Tier 2: Needs Minor Polish' END AS tier, {bands} AS band FROM scored)"""


ARC = "CASE " + " ".join(
    f"WHEN n{i} > 0 AND n{i} = greatest({', '.join(f'n{j}' for j in range(len(L.ROLE_ARCS)))}) THEN {quoted(n)}" for i, (n, _) in enumerate(L.ROLE_ARCS)
) + f" ELSE {quoted(L.DEFAULT_ARC)} END"
BEST = ", ".join(f"n{i}" for i in range(len(L.ROLE_ARCS)))
ARCS = "arcs AS (SELECT doc_id, {arc} AS arc, CAST(greatest({best}) AS INTEGER) AS arc_score, CASE {signals} ELSE [] END AS arc_signals FROM (SELECT *, {counts} FROM (SELECT doc_id, {found} FROM {{source}})))".format(
    arc=ARC, best=BEST, counts=", ".join(f"len(s{i}) AS n{i}" for i in range(len(L.ROLE_ARCS))), signals=" ".join(f"WHEN n{i} > 0 AND n{i} = greatest({BEST}) THEN s{i}" for i in range(len(L.ROLE_ARCS))),
    found=", ".join(f"{signals('{column}', s)} AS s{i}" for i, (_, s) in enumerate(L.ROLE_ARCS)),
)
FAILED = "CASE check_id WHEN 'email' THEN 1 ELSE 0 END"
RESULTS = """failed AS (
      SELECT doc_id, check_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS k FROM checks WHERE NOT passed
    ), failed_counts AS (
      SELECT r.doc_id, least(3, count(check_id)) AS n_failed, count(*) FILTER (check_id = 'email' AND k <= 3 AND n_blockers > 0) AS n_critical_failed FROM reports r LEFT JOIN failed f ON r.doc_id = f.doc_id GROUP BY r.doc_id
    ), results AS (
      SELECT CAST(r.doc_id AS VARCHAR) AS id, r.doc_id, file_name, seq, jd_id, arc AS role_arc, score AS overall_score, tier AS readiness_tier, 'jd-fit' AS evaluation_basis, jd_score, matched,
        list_filter(keywords, lambda k: NOT list_contains(matched, k)) AS missing, email, n_blockers + n_failed + len(list_filter(['contact', 'skills', 'projects', 'experience'], lambda s: NOT list_contains(section_types, s))) AS n_issues,
        n_blockers + n_critical_failed AS n_critical, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(r.doc_id) AS updated_at, r.doc_id % 13 = 0 AS is_deleted,
        CASE WHEN r.doc_id % 17 = 0 THEN 90.0 END AS manual_score
      FROM reports r JOIN failed_counts USING (doc_id) JOIN arcs USING (doc_id)
    ), board AS (
      SELECT *, CAST(coalesce(manual_score, overall_score) AS DOUBLE) AS effective_score FROM results)"""
PROJECTS = f"""firsts AS (SELECT *, min(CASE WHEN real_type = 'projects' THEN section_no END) OVER (PARTITION BY doc_id) AS first_no FROM sections), opened AS (
      SELECT *, {OPENS} AS opens FROM firsts WHERE header IS NULL AND section_no = first_no
    ), entered AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry_no FROM opened
    ), projects AS (SELECT doc_id, entry_no, max(CASE WHEN opens THEN trim(regexp_replace(line, '[:\\-–|]+$', '')) END) AS name FROM entered WHERE entry_no > 0 GROUP BY doc_id, entry_no)"""
_TENSE = [f"regexp_matches(bullet, '(?i)^(?:{w})\\b')" for w in (L.PAST, L.PRESENT)]
TENSES = f"""tenses AS (SELECT doc_id, past, present, CASE WHEN past < present THEN first_past ELSE first_present END AS example FROM (
      SELECT doc_id, count(*) AS n, count(*) FILTER ({_TENSE[0]}) AS past, count(*) FILTER (NOT {_TENSE[0]} AND {_TENSE[1]}) AS present,
        arg_min(bullet, line_no) FILTER ({_TENSE[0]}) AS first_past, arg_min(bullet, line_no) FILTER (NOT {_TENSE[0]} AND {_TENSE[1]}) AS first_present FROM sections WHERE bullet IS NOT NULL GROUP BY doc_id
    ) WHERE n >= 3 AND least(past, present) >= 2)"""
LEVELS = ("applicants", "lines", "sections", "features")


def _re2(pattern: str) -> str:
    """A rule's pattern without what this engine lacks: boundaries for look-around, and a look-ahead that greed makes needless."""
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace(r"(?!\.)", "")


def issues_ctes() -> str:
    """issues: what the rules find, with places, context and lines. Repeated words, which need a back-reference, are told by neighbouring tokens."""
    rows = [(1, i, "spelling", "major", issues.bounded(p), f, w) for i, (p, f, w) in enumerate(L.SPELLING)]
    rows += [(2, i, "grammar", sev, issues.bounded(p), f, w) for i, (p, f, w, sev) in enumerate(L.GRAMMAR) if "repetition" not in w]
    rows += [(3, i, "punctuation", "minor", p, f, w) for i, (p, f, w) in enumerate(L.PUNCTUATION)]
    again = next((i, w, sev) for i, (_, _, w, sev) in enumerate(L.GRAMMAR) if "repetition" in w)
    values = ", ".join(f"({a}, {b}, '{c}', '{d}', {quoted(_re2(e))}, {quoted(f.replace('$', chr(92)))}, {quoted(g)})" for a, b, c, d, e, f, g in rows)
    mixed = _re2(issues.MIXED).replace("'", "''")
    near = "'\"…' || trim(regexp_replace(substr(raw_text, greatest(0, start - {n}) + 1, start + length(error) + {n} - greatest(0, start - {n})), '\\r?\\n', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '…\"'"
    return f"""rules AS (SELECT * FROM (VALUES {values}) AS t(phase, rule, type, severity, pattern, fix, explanation)
    ), found AS (SELECT doc_id, r.*, regexp_extract_all(m, pattern) AS e, string_split_regex(m, pattern) AS p FROM masked, rules r WHERE regexp_matches(m, pattern)
    ), each AS (SELECT doc_id, phase, rule, type, severity, explanation, i AS pos, e[i] AS error, length(p[i]) AS gap, regexp_replace(e[i], pattern, fix) AS fix FROM found, unnest(range(1, len(e) + 1)) AS u(i)
    ), placed_issues AS (SELECT * EXCLUDE (gap), sum(gap + length(error)) OVER (PARTITION BY doc_id, phase, rule ORDER BY pos) - length(error) AS start FROM each
    ), tokens AS (SELECT doc_id, i, w[i] AS tok FROM (SELECT doc_id, regexp_extract_all(m, '[A-Za-z0-9_]+|\\s+|[^A-Za-z0-9_\\s]+') AS w FROM masked), unnest(range(1, len(w) + 1)) AS u(i)
    ), twice AS (SELECT doc_id, i, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok) AS start, lead(tok) OVER d AS gap, lead(tok, 2) OVER d AS next FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), pairs AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM twice WHERE length(tok) >= 3 AND regexp_matches(tok, '^[A-Za-z0-9_]') AND lower(tok) = lower(next) AND regexp_matches(gap, '^\\s+$')
    ), repeated AS (SELECT doc_id, 2 AS phase, {again[0]} AS rule, 'repetition' AS type, {quoted(again[2])} AS severity, {quoted(again[1])} AS explanation, i AS pos, tok || gap || next AS error, tok AS fix, start FROM pairs
      QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY i) % 2 = 1
    ), unequal AS (SELECT *, CASE WHEN phase = 1 THEN explanation || chr(1) || lower(error) WHEN type = 'grammar' THEN lower(error) WHEN phase = 3 THEN error ELSE rule || chr(1) || pos END AS same
      FROM (SELECT * FROM placed_issues UNION ALL BY NAME SELECT * FROM repeated) WHERE NOT (phase = 2 AND regexp_matches(error, '^\\d+\\s+\\d+$')) AND NOT (phase = 3 AND regexp_matches(error, '^\\d[.:]\\d$'))
    ), firsts_of AS (SELECT * FROM unequal QUALIFY row_number() OVER (PARTITION BY doc_id, phase, type, same ORDER BY rule, pos) = 1
    ), ruled AS (SELECT doc_id, phase, rule, type, severity, explanation, error, fix, start, NULL::VARCHAR AS context FROM firsts_of QUALIFY phase <> 3 OR row_number() OVER (PARTITION BY doc_id, phase, rule ORDER BY pos) <= {issues.PUNCTUATION_LIMIT}
    ), digits AS (SELECT doc_id, i, e[i] AS error, length(p[i]) AS gap FROM (SELECT doc_id, regexp_extract_all(m, '{mixed}') AS e, string_split_regex(m, '{mixed}') AS p FROM masked), unnest(range(1, len(e) + 1)) AS u(i)
    ), damaged AS (SELECT doc_id, i, error, translate(lower(error), '01586372', 'olsbgetz') AS fix, sum(gap + length(error)) OVER (PARTITION BY doc_id ORDER BY i) - length(error) AS start FROM digits
    ), ocr AS (SELECT doc_id, 4 AS phase, 0 AS rule, 'ocr' AS type, 'critical' AS severity, 'OCR corruption: digit(s) substituted for letter(s) — ''' || error || ''' should be ''' || fix || '''' AS explanation, error, fix, start, NULL::VARCHAR AS context FROM (
      SELECT * FROM damaged WHERE length(error) >= 3 AND NOT regexp_matches(error, '{issues.TECHNICAL}') AND NOT regexp_matches(error, '(?i)^(v\\d|\\d+\\.\\d|0x|#[0-9a-f])') AND fix <> lower(error) AND list_contains({array(issues.REFERENCE_WORDS)}, fix)
      QUALIFY row_number() OVER (PARTITION BY doc_id, lower(error) ORDER BY i) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {issues.OCR_LIMIT}
    ), {TENSES}, tense AS (SELECT doc_id, 5 AS phase, 0 AS rule, 'grammar' AS type, 'major' AS severity, least(past, present) || ' bullets are in the other tense' AS explanation, 'Mixed tenses: ' || past || ' past-tense + ' || present || ' present-tense bullets' AS error,
      'Standardize all bullets to ' || CASE WHEN past >= present THEN 'past' ELSE 'present' END || ' tense for consistency' AS fix, NULL::INTEGER AS start, 'Example: "' || left(example, 60) || '…"' AS context FROM tenses
    ), numbered_issues AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, rule, start) AS seq FROM (SELECT * FROM ruled UNION ALL BY NAME SELECT * FROM ocr UNION ALL BY NAME SELECT * FROM tense) QUALIFY seq <= {issues.LIMIT}
    ), issues AS (SELECT doc_id, CAST(seq AS INTEGER) AS seq, type, severity, error, fix, explanation, CASE WHEN phase IN (1, 2) THEN {near.format(n=25)} WHEN phase = 4 THEN {near.format(n=20)} ELSE context END AS context,
      CAST(length(left(raw_text, CAST(start AS BIGINT))) - length(replace(left(raw_text, CAST(start AS BIGINT)), chr(10), '')) + 1 AS INTEGER) AS line FROM (SELECT doc_id, seq, phase, type, severity, error, fix, explanation, context, CAST(start AS BIGINT) AS start FROM numbered_issues) JOIN masked USING (doc_id))"""


def over(level: str, body: str, custom: bool = False, source: str = "applicants") -> str:
    """A statement over the tables up to a level: applicants, lines, sections, features, issues, reports or board. source: whose texts, applicants or documents."""
    if level == "issues":
        return f"WITH {', '.join([CTES[source], CTES['lines'], CTES['sections'], MASKED, issues_ctes()])} {body}"
    parts = [CTES[x] for x in LEVELS[: LEVELS.index(level) + 1]] if level in LEVELS else [CTES[x] for x in LEVELS]
    if level in ("reports", "board"):
        if custom or level == "board":
            parts.append(CTES["keywords"])
        parts.append(_reports(custom or level == "board"))
    if level == "board":
        parts += [ARCS.format(source="applicants", column="raw_text"), RESULTS]
    return f"WITH {', '.join([CTES[source], *parts[1:]])} {body}"


def arcs_of(source: str, column: str) -> str:
    return ARCS.format(source=source, column=column)
