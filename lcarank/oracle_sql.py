"""DuckDB statements that recompute every registered query by brute force.

They read the driver's tables (pre-registered views), rebuild the three derived inputs, and use
plain SQL forms of each operator: full cross joins where the Spark plan blocks or indexes, window
functions where it aggregates, an LCS dynamic programme in nested ``list_reduce`` where it runs the
bit-parallel UDF. Regexes are RE2, so lookarounds are replaced by padded character classes.
"""

from __future__ import annotations

from lcarank.constants import (GENERIC_TOKENS, LEGAL_SUFFIXES, RATING_TAIL_PATTERN, ROLE_NOUNS,
                               SITE_TAIL_PATTERN, SKILLS, TITLE_MODIFIERS, EMAIL_PATTERN,
                               PHONE_PATTERN, URL_PATTERN, BROAD_QUERY, EXCLUDED_TITLE_TOKENS,
                               MAX_QUERIES, NO_OVERLAP_WHY)
from lcarank.operators.allowlist import SPOT_CHECK_NAMES
from lcarank.plans.digest import DIGEST_EMPTY, DIGEST_INTRO, DIGEST_TITLE
from lcarank.plans.queries import AS_OF, FILE_LAYOUTS, FILTERED_AS_OF, FILTERED_LOCATION, FILTERED_PAGES, GENERATED_ON, LOCATION
from lcarank.sources.views import (POSTING_TAILS, POSTING_TITLES, RESUME_HEADER,
                                   RESUME_ROLE_LINES)

T = 93


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


def case(key: str, vals: list[str]) -> str:
    parts = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(vals[:-1]))
    return f"CASE {key} {parts} ELSE {vals[-1]} END"


SUFFIX_RE = "( (" + "|".join(LEGAL_SUFFIXES) + "))+$"
GENERIC = lst(GENERIC_TOKENS)
ROLES, MODS = lst(ROLE_NOUNS), lst(TITLE_MODIFIERS)
SITE_RE = "(?i)" + SITE_TAIL_PATTERN
RATING_RE = RATING_TAIL_PATTERN
W = r"[\pL\pN_]"
EMAIL_RE = EMAIL_PATTERN.replace(r"[\w.+-]", r"[\pL\pN_.+-]").replace(r"[\w-]", r"[\pL\pN_-]").replace(r"[\w.-]", r"[\pL\pN_.-]")
PHONE_RE = PHONE_PATTERN.replace(r"\d", r"\p{Nd}")
URL_RE = URL_PATTERN
ISO_RE = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?"
          r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d{1,6})?)?)?)?)?$")
SKILL_ROWS = ", ".join(f"({q(c)}, {q(v)})" for c, vs in SKILLS.items() for v in vs)

# ------------------------------------------------------------------------------------------------
# derived inputs
# ------------------------------------------------------------------------------------------------

LCA_FILINGS = f"""lca_filings AS (
  SELECT 'LCA_Disclosure_Data_FY' || CAST(year(l_shipdate) AS VARCHAR) || '.parquet' AS source_file,
    l_orderkey * 10 + l_linenumber AS row_ord,
    CASE l_orderkey % 5
      WHEN 0 THEN upper(p_name || ' ' || p_type) || ' LLC'
      WHEN 1 THEN p_name || ' ' || p_type || ', Inc.'
      WHEN 2 THEN 'The ' || p_name || ' ' || p_type || ' Co., L.L.C.'
      WHEN 3 THEN p_name || '-' || p_type
      ELSE CASE WHEN l_linenumber = 1 THEN NULL ELSE p_name || ' ' || p_type || ' Corporation' END
    END AS employer_name,
    CASE WHEN l_returnflag = 'A' THEN 'Certified'
         WHEN l_returnflag = 'N' THEN ' CERTIFIED - WITHDRAWN '
         WHEN l_linestatus = 'O' THEN 'Withdrawn'
         ELSE 'Denied' END AS case_status
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_COMPANY = case("doc_id % 8", [
    "p_name || ' ' || p_type || ' Inc'", "lower(p_name || ' ' || p_type) || ', L.L.C.'",
    "p_type || ' ' || p_name", "p_name", "substr(p_name, 1, 2) || substr(p_name, 4) || ' ' || p_type",
    "p_name || ' ' || p_type || ' - Glassdoor 4.1'", "'Global Tech Solutions LLC'", "'3M Co'"])

RAW_POSTINGS = f"""raw_postings AS (
  SELECT CASE WHEN doc_id % 50 = 49 THEN '' WHEN doc_id % 5 = 4 THEN CAST(doc_id - 1 AS VARCHAR)
              ELSE CAST(doc_id AS VARCHAR) END AS posting_id,
    doc_id AS fetch_ord,
    {case("doc_id % 6", [q(t) for t in POSTING_TITLES])} AS title,
    {_COMPANY} AS company_raw,
    CASE WHEN doc_id % 3 = 0 THEN 'San Francisco, CA' ELSE 'Austin, TX' END AS location,
    CASE WHEN doc_id % 11 = 10 THEN 'not-a-date'
         ELSE CAST(CAST(ts AS DATE) AS VARCHAR) || 'T23:30:00-05:00' END AS created,
    'https://example.com/apply/' || CAST(doc_id AS VARCHAR) AS url,
    text || {case("doc_id % 4", [q(t) for t in POSTING_TAILS])} AS description
  FROM documents LEFT JOIN part ON p_partkey = doc_id LEFT JOIN events ON event_id = doc_id)"""

RESUMES = f"""resumes AS (
  SELECT doc_id AS resume_id,
    {q(RESUME_HEADER)} || chr(10) || {case("doc_id % 3", [q(t) for t in RESUME_ROLE_LINES])} || chr(10) || text AS text
  FROM documents)"""


def unescape(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
            f"'&#39;', ''''), '&amp;', '&')")


POSTINGS = f"""postings AS (
  SELECT coalesce(posting_id, '') AS posting_id, fetch_ord,
    {unescape("trim(coalesce(title, ''))")} AS title,
    trim(coalesce(company_raw, '')) AS company_raw, trim(coalesce(location, '')) AS location,
    CASE WHEN regexp_matches(created, {q(ISO_RE)}) THEN try_cast(substr(created, 1, 10) AS DATE) END AS posted,
    coalesce(url, '') AS url, coalesce(description, '') AS description
  FROM raw_postings)"""

DEDUP = """deduped AS (
  SELECT * FROM postings
  QUALIFY posting_id = '' OR row_number() OVER (PARTITION BY posting_id ORDER BY fetch_ord) = 1)"""


def norm_ctes(name: str, src: str, col: str) -> str:
    """CTE ``name`` = src plus column ``norm`` (the company key of ``col``)."""
    return f"""{name}_t AS (
  SELECT *, string_split(trim(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS _tk
  FROM {src}),
{name}_c AS (
  SELECT *, ltrim(array_to_string(list_transform(_tk, lambda t, i:
      CASE WHEN i > 1 AND length(t) = 1 AND length(_tk[i - 1]) = 1 THEN '' ELSE ' ' END || t), '')) AS _c1
  FROM {name}_t),
{name} AS (
  SELECT * EXCLUDE (_tk, _c1), regexp_replace(regexp_replace(_c1, '^the ', ''), {q(SUFFIX_RE)}, '') AS norm
  FROM {name}_c)"""


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(coalesce({x}, '')), {q(SITE_RE)}, ''), {q(RATING_RE)}, ''))"


def fiscal_year(x: str) -> str:
    return f"coalesce(try_cast(regexp_extract({x}, '(?:FY)?(20[0-9]{{2}})', 1) AS INTEGER), 0)"


ALLOW = f"""{norm_ctes("fn", "lca_filings", "employer_name")},
keyed AS (
  SELECT norm AS norm_name, {fiscal_year("source_file")} AS fy, source_file, row_ord, employer_name
  FROM fn
  WHERE starts_with(lower(trim(case_status)), 'certified') AND employer_name IS NOT NULL
    AND employer_name <> '' AND norm <> ''),
allow AS (
  SELECT norm_name, trim(employer_name) AS raw_name, filings, latest_year, source_file AS first_file,
         row_ord AS first_row, employer_name AS first_raw
  FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY source_file, row_ord, employer_name) AS rn,
               count(*) OVER (PARTITION BY norm_name) AS filings,
               max(fy) OVER (PARTITION BY norm_name) AS latest_year
        FROM keyed)
  WHERE rn = 1)"""

BASE = f"WITH {LCA_FILINGS},\n{RAW_POSTINGS},\n{RESUMES},\n{POSTINGS},\n{DEDUP},\n{ALLOW}"


def token_sort(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def lcs(a: str, b: str) -> str:
    return (f"list_reduce(range(1, length({a}) + 1), lambda prev, i: list_reduce(range(1, length({b}) + 1), "
            f"lambda cur, j: list_append(cur, CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1 "
            f"ELSE greatest(prev[j + 1], cur[j]) END), [0]), list_transform(range(0, length({b}) + 1), lambda x: 0))"
            f"[length({b}) + 1]")


def has_anchor(v: str, min_len: int) -> str:
    return f"len(list_filter(string_split({v}, ' '), lambda t: NOT list_contains({GENERIC}, t) AND length(t) >= {min_len})) > 0"


MATCH = f"""names0 AS (SELECT DISTINCT company_raw FROM deduped),
names0c AS (SELECT company_raw, {clean("company_raw")} AS cleaned FROM names0),
{norm_ctes("nk", "names0c", "cleaned")},
plain_exact AS (
  SELECT company_raw, norm AS norm_used, norm AS norm_name, 100.0::DOUBLE AS confidence, 'exact' AS method
  FROM nk WHERE length(norm) >= 3 AND norm IN (SELECT norm_name FROM allow)),
open AS (SELECT company_raw, norm AS v0 FROM nk WHERE NOT (length(norm) >= 3 AND norm IN (SELECT norm_name FROM allow))),
variants AS (
  SELECT company_raw, v0, 0 AS variant, v0 AS v FROM open
  UNION ALL
  SELECT company_raw, v0, 1 AS variant, replace(v0, ' ', '') AS v FROM open
  WHERE len(string_split(v0, ' ')) >= 2 AND length(string_split(v0, ' ')[1]) <= 3
    AND length(replace(v0, ' ', '')) >= 4 AND v0 <> ''),
strs AS (SELECT DISTINCT v FROM variants WHERE length(v) >= 3),
ex AS (SELECT v, v AS norm_name, 100.0::DOUBLE AS confidence, 'exact' AS method FROM strs WHERE v IN (SELECT norm_name FROM allow)),
rest AS (SELECT v FROM strs WHERE v NOT IN (SELECT norm_name FROM allow) AND {has_anchor("v", 3)}),
simp AS (
  SELECT v, norm_name, (1.0 - (m + l - 2 * lcs)::DOUBLE / (m + l)) * 100.0 AS score
  FROM (SELECT *, {lcs("s", "r")} AS lcs
        FROM (SELECT v, norm_name, {token_sort("v")} AS s, {token_sort("norm_name")} AS r,
                     length({token_sort("v")}) AS m, length({token_sort("norm_name")}) AS l
              FROM rest CROSS JOIN allow)
        WHERE 200 * least(m, l) >= {T} * (m + l))
  WHERE 200 * lcs >= {T} * (m + l)),
fz AS (
  SELECT v, norm_name, score FROM (
    SELECT p.*, a.filings, a.first_file, a.first_row, a.first_raw, max(score) OVER (PARTITION BY v) AS top
    FROM simp p JOIN allow a USING (norm_name))
  WHERE score >= top - 1.0
  QUALIFY row_number() OVER (PARTITION BY v ORDER BY filings DESC, score DESC, first_file, first_row, first_raw) = 1),
cont AS (
  SELECT v, norm_name, 100.0::DOUBLE AS score FROM rest CROSS JOIN allow
  WHERE {has_anchor("v", 4)} AND list_has_all(string_split(norm_name, ' '), string_split(v, ' '))),
sb AS (
  SELECT c.v, c.norm_name, c.score FROM cont c JOIN allow a USING (norm_name)
  QUALIFY row_number() OVER (PARTITION BY c.v ORDER BY a.filings DESC, c.score DESC, a.first_file, a.first_row, a.first_raw) = 1),
dec AS (
  SELECT * FROM ex
  UNION ALL SELECT v, norm_name, score, 'fuzzy' FROM fz
  UNION ALL SELECT v, norm_name, score, 'fuzzy-subset' FROM sb WHERE v NOT IN (SELECT v FROM fz)),
joined AS (
  SELECT variants.*, dec.norm_name, dec.confidence, dec.method, a.filings
  FROM variants LEFT JOIN dec USING (v) LEFT JOIN allow a ON a.norm_name = dec.norm_name),
picked AS (
  SELECT company_raw, v0 AS norm_used, norm_name, coalesce(confidence, 0.0) AS confidence,
         coalesce(method, 'none') AS method
  FROM joined
  QUALIFY row_number() OVER (PARTITION BY company_raw ORDER BY
    CASE method WHEN 'exact' THEN 3 WHEN 'fuzzy' THEN 2 WHEN 'fuzzy-subset' THEN 1 ELSE 0 END DESC,
    coalesce(confidence, 0.0) DESC, coalesce(filings, -1) DESC, variant ASC) = 1),
decisions AS (SELECT * FROM plain_exact UNION ALL SELECT * FROM picked),
matched_all AS (
  SELECT d.*, p.posting_id, p.fetch_ord, p.title, p.location, p.posted, p.url, p.description,
         a.raw_name, a.filings, a.latest_year
  FROM deduped p JOIN decisions d USING (company_raw) LEFT JOIN allow a ON a.norm_name = d.norm_name),
matched AS (SELECT *, norm_name AS emp_key FROM matched_all WHERE method <> 'none'),
boosted AS (
  SELECT *, CASE WHEN filings IS NULL OR filings <= 0 THEN 0.0 ELSE
      3.0 * (0.7 * least(1.0, log10(1.0 + filings) / log10(5001.0))
           + 0.3 * CASE WHEN newest <> 0 AND latest_year <> 0
                        THEN greatest(0.0, 1.0 - 0.25 * greatest(0, newest - latest_year)) ELSE 1.0 END) END AS boost
  FROM matched, (SELECT coalesce(max(latest_year), 0) AS newest FROM matched))"""


def contains(text: str, kw: str) -> str:
    esc = f"regexp_replace({kw}, '([^a-z0-9 ])', '\\\\\\1', 'g')"
    return f"regexp_matches(' ' || {text} || ' ', '[^a-z0-9]' || {esc} || '[^a-z0-9]')"


VOCAB = f"""skills(canonical, variant) AS (VALUES {SKILL_ROWS}),
res_low AS (
  SELECT resume_id, regexp_replace(regexp_replace(regexp_replace(lower(text), {q(EMAIL_RE)}, ' ', 'g'),
         {q(PHONE_RE)}, ' ', 'g'), {q(URL_RE)}, ' ', 'g') AS low, text FROM resumes),
res_skills AS (SELECT DISTINCT resume_id, canonical AS kw FROM res_low CROSS JOIN skills WHERE {contains("low", "variant")}),
res_tk AS (SELECT resume_id, regexp_extract_all(lower(text), '[a-z]+') AS tk FROM resumes),
res_found AS (
  SELECT resume_id, list_transform(tk, lambda t, i:
    CASE WHEN list_contains({ROLES}, t) AND i > 1 AND list_contains({MODS}, tk[i - 1]) THEN
      concat_ws(' ',
        CASE WHEN i > 3 AND list_contains({MODS}, tk[i - 2]) AND list_contains({MODS}, tk[i - 3]) THEN tk[i - 3] END,
        CASE WHEN i > 2 AND list_contains({MODS}, tk[i - 2]) THEN tk[i - 2] END,
        tk[i - 1], t) END) AS found
  FROM res_tk),
res_titles AS (
  SELECT resume_id, list_filter(found, lambda x, i: x IS NOT NULL AND list_position(found, x) = i) AS titles
  FROM res_found),
res_kw AS (
  SELECT resume_id, kw FROM res_skills
  UNION SELECT resume_id, unnest(titles) AS kw FROM res_titles)"""


def _with(*parts: str) -> str:
    return BASE + ",\n" + ",\n".join(parts)


HITS = """terms AS (SELECT DISTINCT kw FROM res_kw),
hits AS (
  SELECT fetch_ord, kw, bool_or(in_t) AS in_title, bool_or(in_d) AS in_desc FROM (
    SELECT m.fetch_ord, t.kw, """ + contains("lower(m.title)", "t.kw") + """ AS in_t,
           """ + contains("lower(m.description)", "t.kw") + """ AS in_d
    FROM matched m CROSS JOIN terms t)
  WHERE in_t OR in_d GROUP BY fetch_ord, kw)"""

OVERLAP = """ov AS (
  SELECT r.resume_id, h.fetch_ord,
         list_sort(list(r.kw) FILTER (WHERE h.in_title)) AS tt,
         list_sort(list(r.kw) FILTER (WHERE h.in_desc AND NOT h.in_title)) AS dt
  FROM res_kw r JOIN hits h USING (kw) GROUP BY r.resume_id, h.fetch_ord)"""


def why(tt: str, dt: str) -> str:
    nt, nd = f"len(coalesce({tt}, []))", f"len(coalesce({dt}, []))"
    parts = (f"concat_ws('; ', CASE WHEN {nt} > 0 THEN 'title: ' || array_to_string({tt}, ', ') END, "
             f"CASE WHEN {nd} > 0 THEN 'skills: ' || array_to_string({dt}[1:8], ', ') END)")
    return (f"CASE WHEN {nt} + {nd} = 0 THEN {q(NO_OVERLAP_WHY)} ELSE 'Matches ' || CAST({nt} + {nd} AS VARCHAR) "
            f"|| ' resume terms — ' || {parts} END")


def score(nt: str, nd: str, boost: str) -> str:
    return f"round_even((5.0::DOUBLE * {nt} + 1.0::DOUBLE * {nd}) + {boost}, 2)"


def digest_sql(dry_run: bool = False) -> str:
    pre = ""
    base = BASE
    if dry_run:
        first = ("raw_postings AS (SELECT * FROM raw_postings0 WHERE title = (SELECT title FROM raw_postings0 "
                 "ORDER BY fetch_ord LIMIT 1) QUALIFY row_number() OVER (PARTITION BY title ORDER BY fetch_ord) <= 50)")
        base = base.replace("raw_postings AS (", "raw_postings0 AS (", 1).replace(f"{RESUMES},", f"{RESUMES},\n{first},", 1)
    return base + ",\n" + ",\n".join([MATCH, VOCAB, HITS, OVERLAP, f"""pairs AS (
  SELECT r.resume_id, b.fetch_ord, b.posting_id, b.emp_key, b.method, b.confidence, o.tt, o.dt,
         {score("len(coalesce(o.tt, []))", "len(coalesce(o.dt, []))", "b.boost")} AS score
  FROM resumes r CROSS JOIN boosted b LEFT JOIN ov o ON o.resume_id = r.resume_id AND o.fetch_ord = b.fetch_ord),
capped AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY resume_id, emp_key ORDER BY score DESC, fetch_ord) <= 2),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, fetch_ord) AS rank FROM capped
  QUALIFY rank <= 25),
totals AS (SELECT emp_key, count(*) AS total FROM matched GROUP BY emp_key),
final AS (
  SELECT k.*, t.total - count(*) OVER (PARTITION BY k.resume_id, k.emp_key) AS extra,
         max(k.rank) OVER (PARTITION BY k.resume_id, k.emp_key) AS last_rank
  FROM kept k JOIN totals t USING (emp_key))"""]) + pre


def filtered_sql() -> str:
    """The digest over postings that a search query of some resume finds, within the page limit, recent
    and in the location."""
    queries = f"""qset AS (SELECT DISTINCT unnest(list_concat([{q(BROAD_QUERY)}], list_filter(titles,
      lambda t: NOT list_has_any(string_split(t, ' '), {lst(EXCLUDED_TITLE_TOKENS)})))[1:{MAX_QUERIES}]) AS query FROM res_uniq)"""
    uniq = f"""res_uniq AS (SELECT resume_id, list_filter(titles, lambda t: t <> {q(BROAD_QUERY)}) AS titles FROM res_titles)"""
    paged = ("raw_postings AS (SELECT * FROM raw_postings0 QUALIFY row_number() OVER (PARTITION BY title ORDER BY fetch_ord) "
             f"<= {FILTERED_PAGES} * 50)")
    kept = f"""deduped AS (SELECT * FROM deduped0 WHERE (posted IS NULL OR posted >= DATE '{FILTERED_AS_OF}' - INTERVAL 14 DAY)
      AND contains(lower(location), {q(FILTERED_LOCATION)})
      AND EXISTS (SELECT 1 FROM qset WHERE {contains("lower(title)", "query")}))"""
    out = digest_sql().replace(f",\n{VOCAB}", "").replace("raw_postings AS (", "raw_postings0 AS (", 1)
    out = out.replace(f"{RESUMES},", f"{RESUMES},\n{paged},\n{VOCAB},\n{uniq},\n{queries},", 1)
    return out.replace(DEDUP, DEDUP.replace("deduped AS", "deduped0 AS") + ",\n" + kept, 1)


DIGEST_COLS = f"""SELECT resume_id, rank, posting_id, fetch_ord, emp_key, method, confidence, score,
  {why("tt", "dt")} AS why, extra,
  CASE WHEN rank = last_rank AND extra > 0 THEN '+' || CAST(extra AS VARCHAR) || ' more opening(s) at this employer' END AS note
FROM final"""


def markdown_sql() -> str:
    label = ("CASE WHEN method = 'exact' THEN 'exact company match (verified)' ELSE method || ' match, confidence ' "
             "|| CAST(CAST(round_even(confidence, 0) AS BIGINT) AS VARCHAR) || ' — **⚠ UNVERIFIED — confirm**' END")
    na = lambda c: f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN 'n/a' ELSE CAST({c} AS VARCHAR) END"
    rows = f"""rows AS (
  SELECT f.*, b.title, b.company_raw, b.raw_name, b.filings, b.latest_year, b.location, b.posted, b.url,
    {why("f.tt", "f.dt")} AS why_t,
    CASE WHEN f.rank = f.last_rank AND f.extra > 0 THEN '+' || CAST(f.extra AS VARCHAR) || ' more opening(s) at this employer' END AS note
  FROM final f JOIN boosted b USING (fetch_ord)),
blocks AS (
  SELECT resume_id, rank, list_concat([
    '## ' || CAST(rank AS VARCHAR) || '. ' || title, '',
    '- **Company:** ' || company_raw || ' → **' || raw_name || '** — ' || CAST(filings AS VARCHAR)
      || ' certified H-1B LCAs (FY' || CAST(latest_year AS VARCHAR) || ')',
    '- **H-1B match:** ' || {label},
    '- **Location:** ' || {na("location")} || ' · **Posted:** ' || {na("posted")},
    '- **Apply:** [Apply →](' || url || ')',
    '- **Why it fits:** ' || why_t,
    '- **Score:** ' || CAST(score AS VARCHAR)],
    CASE WHEN note IS NOT NULL THEN ['- _' || note || '_', ''] ELSE [''] END) AS lines
  FROM rows),
heads AS (
  SELECT r.resume_id, coalesce(n, 0) AS n FROM resumes r
  LEFT JOIN (SELECT resume_id, count(*) AS n FROM final GROUP BY resume_id) c USING (resume_id)),
head_lines AS (
  SELECT resume_id, 0 AS rank, list_concat([{q(DIGEST_TITLE)}, '',
    '_Resume: `resume_' || CAST(resume_id AS VARCHAR) || '` · ' || CAST(n AS VARCHAR)
      || ' openings at transfer-capable employers · generated {GENERATED_ON}_', '', {q(DIGEST_INTRO)}, ''],
    CASE WHEN n = 0 THEN [{q(DIGEST_EMPTY)}] ELSE [] END) AS lines
  FROM heads),
all_lines AS (SELECT * FROM blocks UNION ALL SELECT * FROM head_lines)
SELECT resume_id, CAST(rank * 100 + i - 1 AS BIGINT) AS line_no, lines[i] AS line
FROM (SELECT resume_id, rank, lines, unnest(range(1, len(lines) + 1)) AS i FROM all_lines)"""
    return digest_sql() + ",\n" + rows


ORACLE: dict[str, str] = {}

ORACLE["filings_scan"] = (f"WITH {LCA_FILINGS} SELECT source_file, row_ord, employer_name, case_status, "
                          f"{fiscal_year('source_file')} AS fiscal_year FROM lca_filings")

ORACLE["allowlist"] = (f"WITH {LCA_FILINGS},\n{ALLOW}\nSELECT norm_name, raw_name, filings, latest_year, "
                       "first_file, first_row FROM allow")

ORACLE["allowlist_stats"] = (f"WITH {LCA_FILINGS},\n{norm_ctes('fn', 'lca_filings', 'employer_name')}\n"
                             "SELECT count(DISTINCT source_file) AS files, count(*) AS rows_total, "
                             "count(*) FILTER (WHERE starts_with(lower(trim(case_status)), 'certified')) AS rows_certified, "
                             "count(DISTINCT norm) FILTER (WHERE starts_with(lower(trim(case_status)), 'certified') "
                             "AND employer_name IS NOT NULL AND employer_name <> '' AND norm <> '') AS employers_unique "
                             "FROM fn")

ORACLE["filings_files"] = f"WITH {LCA_FILINGS},\n{ALLOW}\nSELECT norm_name, filings, latest_year FROM allow"
ORACLE["filings_files_stats"] = ORACLE["allowlist_stats"]

ORACLE["allowlist_sample"] = (f"WITH {LCA_FILINGS},\n{ALLOW}\nSELECT norm_name, raw_name, filings, latest_year "
                              "FROM allow ORDER BY md5(norm_name) LIMIT 20")

_SPOT = ", ".join(f"({q(k)}, {q(n)})" for k, n in SPOT_CHECK_NAMES)
ORACLE["allowlist_spot_check"] = (f"WITH {LCA_FILINGS},\n{ALLOW},\nspot(kind, name) AS (VALUES {_SPOT}),\n"
                                  f"{norm_ctes('sn', 'spot', 'name')}\n"
                                  "SELECT kind, name, norm AS norm_key, a.norm_name IS NOT NULL AS hit, a.filings, a.latest_year "
                                  "FROM sn LEFT JOIN allow a ON a.norm_name = sn.norm")

_PCOLS = "posting_id, fetch_ord, title, company_raw, location, posted, url, description"
ORACLE["postings_ingest"] = f"WITH {RAW_POSTINGS},\n{POSTINGS}\nSELECT {_PCOLS} FROM postings"
ORACLE["postings_dedupe"] = f"WITH {RAW_POSTINGS},\n{POSTINGS},\n{DEDUP}\nSELECT {_PCOLS} FROM deduped"
ORACLE["postings_recent"] = (f"WITH {RAW_POSTINGS},\n{POSTINGS},\n{DEDUP}\nSELECT {_PCOLS} FROM deduped "
                             f"WHERE posted IS NULL OR posted >= DATE '{AS_OF}' - INTERVAL 14 DAY")
ORACLE["postings_location"] = (f"WITH {RAW_POSTINGS},\n{POSTINGS},\n{DEDUP}\nSELECT {_PCOLS} FROM deduped "
                               f"WHERE contains(lower(location), {q(LOCATION)})")
ORACLE["postings_page_limit"] = (f"WITH {RAW_POSTINGS}\nSELECT posting_id, fetch_ord, title FROM raw_postings "
                                 "QUALIFY row_number() OVER (PARTITION BY title ORDER BY fetch_ord) <= 50")

ORACLE["company_keys"] = (f"WITH {RAW_POSTINGS},\n{POSTINGS},\n"
                          f"ck AS (SELECT DISTINCT company_raw FROM postings),\n"
                          f"ck2 AS (SELECT company_raw, {clean('company_raw')} AS cleaned FROM ck),\n"
                          f"{norm_ctes('ckn', 'ck2', 'cleaned')}\n"
                          f"SELECT company_raw, cleaned, norm AS norm_key, {token_sort('norm')} AS sorted_key, "
                          "CASE WHEN len(string_split(norm, ' ')) >= 2 AND length(string_split(norm, ' ')[1]) <= 3 "
                          "AND length(replace(norm, ' ', '')) >= 4 AND norm <> '' THEN replace(norm, ' ', '') END AS despaced "
                          "FROM ckn")

_OPEN = f"""oc AS (SELECT DISTINCT {clean("company_raw")} AS cleaned FROM deduped),
{norm_ctes("ocn", "oc", "cleaned")},
rest AS (SELECT DISTINCT norm AS v FROM ocn WHERE length(norm) >= 3 AND norm NOT IN (SELECT norm_name FROM allow)
         AND {has_anchor("norm", 3)})"""

ORACLE["exact_match"] = (_with(f"""em AS (SELECT DISTINCT company_raw FROM deduped),
em2 AS (SELECT company_raw, {clean("company_raw")} AS cleaned FROM em),
{norm_ctes("emn", "em2", "cleaned")}""") + "\nSELECT company_raw, norm AS norm_name FROM emn "
                         "WHERE length(norm) >= 3 AND norm IN (SELECT norm_name FROM allow)")

ORACLE["similarity_join"] = _with(_OPEN) + f"""
SELECT v, norm_name, (1.0 - (m + l - 2 * lcs)::DOUBLE / (m + l)) * 100.0 AS score
FROM (SELECT *, {lcs("s", "r")} AS lcs
      FROM (SELECT v, norm_name, {token_sort("v")} AS s, {token_sort("norm_name")} AS r,
                   length({token_sort("v")}) AS m, length({token_sort("norm_name")}) AS l
            FROM rest CROSS JOIN allow)
      WHERE 200 * least(m, l) >= {T} * (m + l))
WHERE 200 * lcs >= {T} * (m + l)"""

ORACLE["containment_join"] = _with(_OPEN) + f"""
SELECT v, norm_name FROM rest CROSS JOIN allow
WHERE {has_anchor("v", 4)} AND list_has_all(string_split(norm_name, ' '), string_split(v, ' '))"""

ORACLE["match_decisions"] = _with(MATCH) + "\nSELECT company_raw, norm_used, norm_name, confidence, method FROM decisions"
ORACLE["match_audit"] = _with(MATCH) + "\nSELECT method, count(*) AS postings FROM matched_all GROUP BY method"
ORACLE["matched_postings"] = _with(MATCH) + ("\nSELECT posting_id, fetch_ord, company_raw, emp_key, raw_name, filings, "
                                             "latest_year, confidence, method FROM matched")
ORACLE["employer_openings"] = _with(MATCH) + "\nSELECT emp_key, count(*) AS openings FROM matched GROUP BY emp_key"
ORACLE["sponsor_boost"] = _with(MATCH) + ("\nSELECT fetch_ord, emp_key, round_even(boost, 6) AS boost, "
                                          f"{score('0', '0', 'boost')} AS zscore FROM boosted")

ORACLE["resume_pii_strip"] = (f"WITH {RESUMES}\nSELECT resume_id, regexp_replace(regexp_replace(regexp_replace("
                              f"lower(text), {q(EMAIL_RE)}, ' ', 'g'), {q(PHONE_RE)}, ' ', 'g'), {q(URL_RE)}, ' ', 'g') "
                              "AS stripped FROM resumes")

ORACLE["resume_vocabulary"] = (f"WITH {RESUMES},\n{VOCAB},\n"
                               "kwl AS (SELECT resume_id, list_sort(list(DISTINCT kw)) AS kws FROM res_kw GROUP BY resume_id),\n"
                               f"qs AS (SELECT resume_id, titles, list_filter(list_concat([{q(BROAD_QUERY)}], "
                               f"list_filter(titles, lambda t: NOT list_has_any(string_split(t, ' '), {lst(EXCLUDED_TITLE_TOKENS)}))), "
                               "lambda x, i: list_position(list_concat(["
                               f"{q(BROAD_QUERY)}], list_filter(titles, lambda t: NOT list_has_any(string_split(t, ' '), "
                               f"{lst(EXCLUDED_TITLE_TOKENS)}))), x) = i) AS qq FROM res_titles)\n"
                               "SELECT qs.resume_id, array_to_string(titles, ' | ') AS titles, "
                               "array_to_string(qq[1:6], ' | ') AS queries, "
                               "array_to_string(coalesce(kws, []), ' | ') AS keywords, "
                               "CAST(len(coalesce(kws, [])) AS BIGINT) AS keyword_count "
                               "FROM qs LEFT JOIN kwl USING (resume_id)")

ORACLE["posting_term_hits"] = _with(MATCH, VOCAB, HITS) + "\nSELECT fetch_ord, kw, in_title, in_desc FROM hits"

# One row per vocabulary (the smallest resume that has it) and profile (the smallest posting among those
# whose hits are the same).
ORACLE["overlap_scores"] = _with(MATCH, VOCAB, HITS) + f""",
vocab AS (SELECT kws, min(resume_id) AS vocab_id, count(*) AS resumes FROM
  (SELECT resume_id, list_sort(list(kw)) AS kws FROM res_kw GROUP BY resume_id) GROUP BY kws),
vt AS (SELECT vocab_id, resumes, unnest(kws) AS kw FROM vocab),
prof AS (SELECT key, min(fetch_ord) AS first_ord, count(*) AS postings FROM (
  SELECT m.fetch_ord, string_agg(CASE WHEN h.kw IS NOT NULL THEN h.kw || CASE WHEN h.in_title THEN '+' ELSE '-' END END, '|' ORDER BY h.kw) AS key
  FROM matched m LEFT JOIN hits h USING (fetch_ord) GROUP BY m.fetch_ord) GROUP BY key),
po AS (SELECT v.vocab_id, v.resumes, p.first_ord, p.postings,
    list_sort(list(v.kw) FILTER (WHERE h.in_title)) AS tt,
    list_sort(list(v.kw) FILTER (WHERE h.in_desc AND NOT h.in_title)) AS dt
  FROM prof p JOIN hits h ON h.fetch_ord = p.first_ord JOIN vt v USING (kw) GROUP BY ALL)
SELECT vocab_id, first_ord, resumes, postings, {score("len(coalesce(tt, []))", "len(coalesce(dt, []))", "0.0")} AS score,
       {why("tt", "dt")} AS why
FROM po"""

ORACLE["digest"] = digest_sql() + "\n" + DIGEST_COLS
ORACLE["digest_dry_run"] = digest_sql(dry_run=True) + "\n" + DIGEST_COLS
ORACLE["digest_markdown"] = markdown_sql()
ORACLE["digest_filtered"] = filtered_sql() + "\n" + DIGEST_COLS

# The staged files take the header layouts in turn; columns are found by canonical header.
_HEADERS = ", ".join(f"({i}, {k}, {q(h)})" for i, layout in enumerate(FILE_LAYOUTS) for k, h in enumerate(layout.values()))


def _column(exact: str, parts: list[str]) -> str:
    rank = f"CASE WHEN c = {q(exact)} THEN 0 " + " ".join(f"WHEN contains(c, {q(p)}) THEN {i}" for i, p in enumerate(parts, 1)) + " END"
    return f"(min(CASE WHEN {rank} IS NOT NULL THEN {rank} * 1000 + position END) % 1000)::INT"


ORACLE["header_map"] = (
    f"WITH {LCA_FILINGS},\nfiles AS (SELECT source_file, (row_number() OVER (ORDER BY source_file) - 1) % {len(FILE_LAYOUTS)} AS layout "
    f"FROM (SELECT DISTINCT source_file FROM lca_filings)),\nhead(layout, position, header) AS (VALUES {_HEADERS}),\n"
    "canon AS (SELECT source_file, position, trim(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '_') AS c FROM files JOIN head USING (layout))\n"
    f"SELECT source_file, {_column('employer_name', ['employer_name', 'employer'])} AS employer, "
    f"{_column('case_status', ['case_status', 'status'])} AS status FROM canon GROUP BY source_file")

ORACLE["filings_csv"] = (
    f"WITH {LCA_FILINGS.replace('lca_filings AS', 'lca_filings0 AS', 1)},\nlca_filings AS (SELECT source_file, row_ord, employer_name, "
    f"CASE WHEN row_ord % 7 <> 0 THEN case_status END AS case_status FROM lca_filings0),\n{ALLOW}\n"
    "SELECT norm_name, filings, latest_year FROM allow")

# Pages of 50; a posting's place in its page.
ORACLE["postings_pages"] = (
    f"WITH {RAW_POSTINGS.replace('raw_postings AS', 'raw_postings0 AS', 1)},\nraw_postings AS (SELECT * EXCLUDE (fetch_ord), fetch_ord // 50 * 1048576 + "
    f"row_number() OVER (PARTITION BY fetch_ord // 50 ORDER BY fetch_ord) - 1 AS fetch_ord FROM raw_postings0),\n{POSTINGS}\nSELECT {_PCOLS} FROM postings")

ORACLE["digest_files"] = ("SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY line_no) - 1 AS line_no, line FROM (\n"
                          + markdown_sql() + ")")

# In every other file the status comes first, so that a row of one cell has a status and no employer.
ORACLE["filings_csv_accounts"] = (
    f"WITH {LCA_FILINGS},\nwhole AS (SELECT *, row_ord % 7 <> 0 AND starts_with(lower(trim(case_status)), 'certified') AS cert FROM lca_filings)\n"
    "SELECT replace(source_file, '.parquet', '.csv') AS source_file, count(*) AS rows, count(*) FILTER (WHERE row_ord % 7 = 0) AS short_rows, "
    "count(*) FILTER (WHERE cert) AS rows_certified, count(*) FILTER (WHERE cert AND employer_name <> '') AS rows_named FROM whole GROUP BY source_file")
