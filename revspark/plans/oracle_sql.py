"""DuckDB SQL oracles for the correctness gate.

Each oracle restates the reference semantics in plain SQL, usually in a
different formulation from the Spark job (window frames instead of
semi-joins, ``contains`` joins instead of suffix expansion), so the two
check each other.  Only used by ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

from revspark.functions.text import CPP_EXTS, JS_EXTS
from revspark.operators import line_rules as LR
from revspark.operators.history import STATUS_RULES
from revspark.sources.analogs import FINDINGS_SQL, PR_FILES_SQL, REVIEWS_SQL
from revspark.sources.code_files import oracle_code_files_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def code_ctes() -> str:
    """code_files -> cf, files with rule language -> fl, lines -> ln,
    non-blank code lines with loop flag and snippet -> nc."""
    return f"""
cf AS ({oracle_code_files_sql()}),
fl AS (
  SELECT review_id, file, content,
         CASE WHEN suffix(file, '.java') THEN 'java'
              WHEN lower(regexp_extract(file, '^.+\\.([^.]*)$', 1)) IN {_in(CPP_EXTS)} THEN 'cpp'
              WHEN lower(regexp_extract(file, '^.+\\.([^.]*)$', 1)) = 'py' THEN 'py'
              WHEN lower(regexp_extract(file, '^.+\\.([^.]*)$', 1)) IN {_in(JS_EXTS)} THEN 'js'
              ELSE 'generic' END AS lang
  FROM cf WHERE regexp_matches(content, '[^\\x00-\\x20]')
),
ln0 AS (
  SELECT review_id, file, lang, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS raw
  FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS parts FROM fl) s
),
ln AS (
  SELECT review_id, file, lang, CAST(line AS INTEGER) AS line, raw,
         CASE WHEN lang = 'py' THEN split_part(raw, '#', 1)
              WHEN contains(raw, '//') THEN split_part(raw, '//', 1)
              WHEN regexp_matches(raw, '^[\\x00-\\x20]*(/\\*|\\*)') THEN ''
              ELSE raw END AS code,
         regexp_replace(raw, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS code_snippet,
         coalesce(bool_or(regexp_matches(raw, '^[\\x00-\\x20]*(for|while)(\\(| [\\x00-\\x20]*[^\\x00-\\x20])')
                          OR contains(raw, '.forEach') OR contains(raw, '.map('))
                  OVER (PARTITION BY review_id, file ORDER BY line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
                  false) AS in_loop
  FROM ln0
),
nc AS (SELECT * FROM ln WHERE regexp_matches(code, '[^\\x00-\\x20]'))
"""


def _select_finding(rule: str, sev: str, msg_sql: str, src: str, where: str = "TRUE") -> str:
    return (f"SELECT review_id, {q(rule)} AS rule_id, {q(sev)} AS severity, file, CAST(line AS INTEGER) AS line, "
            f"code_snippet, {msg_sql} AS message FROM {src} WHERE {where}")


def _contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _var_msg(template: str) -> str:
    before, after = template.split("{var}")
    return f"{q(before)} || var || {q(after)}"


def line_rule_selects() -> dict[str, str]:
    """Per line rule, one SELECT over the ``nc`` CTE of ``code_ctes``."""
    out = {}
    out["l1_cpp_leak"] = f"""
SELECT n.review_id, {q(LR.RULE_LEAK)} AS rule_id, 'ERROR' AS severity, n.file, CAST(n.line AS INTEGER) AS line,
       n.code_snippet, {q(LR.MSG_CPP_LEAK)} AS message
FROM (SELECT review_id, file,
         max(CASE WHEN regexp_matches(code, {q(LR.CPP_ALLOC_RE)}) AND NOT contains(code, 'close')
                   AND NOT contains(code, 'free') THEN line END) AS alloc_line,
         max(CASE WHEN regexp_matches(code, {q(LR.CPP_CLOSE_RE)}) THEN line END) AS close_line
      FROM nc WHERE lang = 'cpp' GROUP BY review_id, file) agg
JOIN nc n ON n.review_id = agg.review_id AND n.file = agg.file AND n.line = agg.alloc_line
WHERE agg.alloc_line > coalesce(agg.close_line, 0)"""
    out["l4_py_leak"] = f"""
SELECT n.review_id, {q(LR.RULE_LEAK)} AS rule_id, 'ERROR' AS severity, n.file, CAST(n.line AS INTEGER) AS line,
       n.code_snippet, {q(LR.MSG_PY_LEAK)} AS message
FROM (SELECT review_id, file,
         max(CASE WHEN regexp_matches(code, 'open\\(') AND NOT contains(code, '.close()') THEN line END) AS open_line,
         max(CASE WHEN contains(code, '.close()') THEN line END) AS close_line,
         bool_or(regexp_matches(code, {q(LR.PY_WITH_OPEN_RE)})) AS with_open
      FROM nc WHERE lang = 'py' GROUP BY review_id, file) agg
JOIN nc n ON n.review_id = agg.review_id AND n.file = agg.file AND n.line = agg.open_line
WHERE NOT agg.with_open AND agg.open_line > coalesce(agg.close_line, 0)"""

    def null_rule(lang, assign_re, group, match_sql, guard_sql, msg):
        return f"""
SELECT l.review_id, {q(LR.RULE_NULL)} AS rule_id, 'ERROR' AS severity, l.file, CAST(l.line AS INTEGER) AS line,
       l.code_snippet, {_var_msg(msg).replace('var', 'a.var')} AS message
FROM nc l
JOIN (SELECT review_id, file, line AS a_line, regexp_extract(code, {q(assign_re)}, {group}) AS var
      FROM nc WHERE lang = {q(lang)}) a
  ON a.review_id = l.review_id AND a.file = l.file AND a.var <> '' AND a.a_line <= l.line
WHERE l.lang = {q(lang)} AND ({match_sql}) AND ({guard_sql})"""

    out["l2_cpp_null_deref"] = null_rule(
        "cpp", LR.CPP_NULL_ASSIGN_RE, 1,
        "contains(l.code, a.var || '->') OR contains(l.code, '*' || a.var)",
        "NOT contains(l.code, 'if') AND NOT contains(l.code, '!') AND NOT contains(l.code, '==')",
        LR.MSG_CPP_NULL)
    out["l5_py_none_access"] = null_rule(
        "py", LR.PY_NULL_ASSIGN_RE, 1,
        "contains(l.code, a.var || '.') OR contains(l.code, a.var || '[')",
        "NOT contains(l.code, 'if') AND NOT contains(l.code, 'is not None') AND NOT contains(l.code, 'not ' || a.var)",
        LR.MSG_PY_NULL)
    out["l7_js_null_access"] = null_rule(
        "js", LR.JS_NULL_ASSIGN_RE, 2,
        "contains(l.code, a.var || '.') AND NOT contains(l.code, a.var || '?.') AND NOT contains(l.code, 'typeof')",
        "NOT contains(l.code, 'if') AND NOT contains(l.code, '&&') AND NOT contains(l.code, '?')",
        LR.MSG_JS_NULL)

    def loop_rule(lang, words, msg):
        return "\n" + _select_finding(
            LR.RULE_LOOP, "WARNING", q(msg), "nc", f"lang = {q(lang)} AND in_loop AND {_contains_any('code', words)}")

    out["l3_cpp_query_in_loop"] = loop_rule("cpp", LR.CPP_LOOP_WORDS, LR.MSG_CPP_LOOP)
    out["l6_py_query_in_loop"] = loop_rule("py", LR.PY_LOOP_WORDS, LR.MSG_PY_LOOP)
    out["l8_js_call_in_loop"] = loop_rule("js", LR.JS_LOOP_WORDS, LR.MSG_JS_LOOP)
    out["l9_generic_call_in_loop"] = loop_rule("generic", LR.GENERIC_LOOP_WORDS, LR.MSG_GENERIC_LOOP)
    return out


def line_rule_sql() -> dict[str, str]:
    pre = "WITH " + code_ctes()
    return {k: pre + v for k, v in line_rule_selects().items()}


def line_findings_select() -> str:
    """UNION ALL of every line rule (needs ``code_ctes``)."""
    return "\nUNION ALL\n".join(line_rule_selects().values())


def history_sql() -> dict[str, str]:
    pre = f"WITH r AS ({REVIEWS_SQL}), f AS ({FINDINGS_SQL}), cf AS ({oracle_code_files_sql()})"
    q1 = pre + """
SELECT r.id, r.repo_name, r.pr_number, r.commit_sha, r.analyzed_at, r.status,
  CAST((SELECT count(*) FROM f WHERE f.review_id = r.id) AS BIGINT) AS finding_count,
  CAST((SELECT count(*) FROM f WHERE f.review_id = r.id AND f.severity = 'ERROR') AS BIGINT) AS error_count
FROM r ORDER BY r.id DESC"""
    cases = """cases AS (SELECT doc_id AS case_id, CAST(quality AS INTEGER) AS expected FROM labels),
act AS (SELECT c.case_id, c.expected, (SELECT count(*) FROM documents d WHERE d.doc_id = c.case_id AND d.n_chars >= 400) AS actual FROM cases c),
conf AS (SELECT
  CAST(coalesce(sum(CASE WHEN expected > 0 AND actual > 0 THEN least(expected, actual) ELSE 0 END), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(CASE WHEN expected > 0 AND actual > expected THEN actual - expected
                         WHEN expected <= 0 AND actual > 0 THEN actual ELSE 0 END), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(CASE WHEN expected > 0 AND actual = 0 THEN expected ELSE 0 END), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(CASE WHEN expected <= 0 AND actual = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn
  FROM act)"""
    m2 = f"WITH {cases}," + """
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 100.0 ELSE tp * 100.0 / (tp + fp) END AS p,
                 CASE WHEN tp + fn = 0 THEN 100.0 ELSE tp * 100.0 / (tp + fn) END AS r FROM conf)
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM pr"""
    rules = ",".join(STATUS_RULES)
    return {
        "q1_review_history": q1,
        "q2_findings_of_review": pre + " SELECT * FROM f WHERE review_id IN (SELECT id FROM r)",
        "q3_files_of_review": pre + " SELECT review_id, file AS file_path FROM cf WHERE review_id IN (SELECT id FROM r)",
        "q4_file_content": pre + """ SELECT review_id, file AS file_path, min(content) AS content,
            count(*) AS n_copies, count(*) > 1 AS duplicated FROM cf GROUP BY review_id, file""",
        "q5_status_totals": pre + f""" SELECT (SELECT count(*) FROM r) AS total_reviews,
            (SELECT count(*) FROM f) AS total_findings, '{rules}' AS rules""",
        "q6_dashboard_totals": f"WITH q1 AS ({q1}) SELECT count(*) AS reviews, "
            "CAST(coalesce(sum(finding_count), 0) AS BIGINT) AS findings, "
            "CAST(coalesce(sum(error_count), 0) AS BIGINT) AS errors FROM q1",
        "m1_confusion": f"WITH {cases} SELECT * FROM conf",
        "m2_scores": m2,
        "k2_review_status": f"""WITH r AS ({REVIEWS_SQL}), f AS (SELECT * FROM ({PR_FILES_SQL}) x WHERE {supported_sql('file')})
            SELECT r.id AS review_id, CAST(count(f.review_id) AS BIGINT) AS n_files,
            CASE WHEN count(f.review_id) = 0 THEN 'NO_CODE_FILES' ELSE 'SUCCESS' END AS status
            FROM r LEFT JOIN f ON f.review_id = r.id GROUP BY r.id""",
    }


# ---------------------------------------------------------------------------
# P, S, D, E, K1 oracles
# ---------------------------------------------------------------------------
from revspark.functions.crypto import hmac_sha256_hex_sql  # noqa: E402
from revspark.functions.text import SUPPORTED_EXTS  # noqa: E402
from revspark.operators import enrich as EN  # noqa: E402
from revspark.plans.review import ALL_RULES  # noqa: E402
from revspark.sources import fixtures as FX  # noqa: E402
from revspark.sources import scan as SC  # noqa: E402

JT = "'^[\\x00-\\x20]+|[\\x00-\\x20]+$'"  # Java trim as a regex


def jtrim_sql(x: str) -> str:
    return f"regexp_replace({x}, {JT}, '', 'g')"


def nonblank_sql(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^\\x00-\\x20]'), false)"


def rule_lang_sql(p: str) -> str:
    ext = f"lower(regexp_extract({p}, '^.+\\.([^.]*)$', 1))"
    return (f"CASE WHEN suffix({p}, '.java') THEN 'java' WHEN {ext} IN {_in(CPP_EXTS)} THEN 'cpp' "
            f"WHEN {ext} = 'py' THEN 'py' WHEN {ext} IN {_in(JS_EXTS)} THEN 'js' ELSE 'generic' END")


def prompt_lang_sql(p: str) -> str:
    def ends(*e):
        return "(" + " OR ".join(f"suffix(lower({p}), '.{x}')" for x in e) + ")"
    return (f"CASE WHEN {ends('cpp', 'h', 'hpp', 'cc', 'c')} THEN 'C++' WHEN {ends('py')} THEN 'Python' "
            f"WHEN {ends('js', 'jsx')} THEN 'JavaScript' WHEN {ends('ts', 'tsx')} THEN 'TypeScript' "
            f"WHEN {ends('go')} THEN 'Go' WHEN {ends('rs')} THEN 'Rust' ELSE 'Java' END")


def supported_sql(p: str) -> str:
    return f"coalesce(regexp_matches(lower({p}), '\\.({'|'.join(SUPPORTED_EXTS)})$'), false)"


DOC_FILES_SQL = """SELECT CAST(doc_id // 10 AS BIGINT) AS review_id,
  'docs/' || source || '/D' || CAST(doc_id AS VARCHAR) || '.' || ['txt', 'py', 'js', 'cpp'][doc_id % 4 + 1] AS file,
  text AS content FROM documents"""


def code_ctes_from(files_sql: str) -> str:
    """``code_ctes`` over any files table (review_id, file, content)."""
    base = code_ctes()
    start = base.index("cf AS (")
    end = base.index("fl AS (")
    return base[:start] + f"cf AS ({files_sql}),\n" + base[end:]


def paths_sql() -> str:
    return f"WITH cf AS ({oracle_code_files_sql()}), paths AS (SELECT file AS path FROM cf UNION ALL SELECT url AS path FROM pages) "


def enriched_sql(findings_cte: str | None = None) -> str:
    """CTE ``ef``: findings with rationale / fix / priority (needs code_ctes).
    Without ``findings_cte`` the findings of every rule are used (CTE ``lf``)."""
    rows = []
    for rule, lang, rat, fix in EN.DIMENSION_ROWS:
        prio = EN.PRIORITY.get(rule, EN.DEFAULT_PRIORITY)
        rows.append(f"({q(rule)}, {q(lang)}, {q(rat)}, {q(fix)}, {prio})")
    dim = "(VALUES " + ", ".join(rows) + ") dim(rule_key, lang_key, rationale, fix, priority)"
    keys = _in(EN.PRIORITY.keys())
    src = findings_cte or "lf"
    head = "" if findings_cte else f"{java_golden_cte()}, lf AS ({all_findings_select()}),\n"
    return f"""
{head}lk AS (SELECT *, CASE WHEN rule_id IN {keys} THEN rule_id ELSE '*' END AS rule_key,
              {prompt_lang_sql('file')} AS lang_key FROM {src}),
ef AS (
  SELECT lk.review_id, lk.rule_id, lk.severity, lk.file, lk.line, lk.code_snippet, lk.message,
         coalesce(d1.rationale, d2.rationale) AS rationale, coalesce(d1.fix, d2.fix) AS fix_suggestion,
         CAST(coalesce(d1.priority, d2.priority) AS INTEGER) AS priority_score
  FROM lk LEFT JOIN {dim.replace('dim(', 'd1(')} ON d1.rule_key = lk.rule_key AND d1.lang_key = lk.lang_key AND d1.lang_key <> '*'
          LEFT JOIN {dim.replace('dim(', 'd2(')} ON d2.rule_key = lk.rule_key AND d2.lang_key = '*'
),
rv AS (SELECT DISTINCT review_id, 'repo/R' || CAST(review_id AS VARCHAR) AS source,
              sha256(CAST(review_id AS VARCHAR)) AS commit_sha,
              TIMESTAMP '2024-01-01 00:00:00' + to_seconds(review_id) AS analyzed_at FROM cf)
"""


def more_sql() -> dict[str, str]:
    out = {}
    out["p1_rule_lang"] = paths_sql() + f"SELECT path, {rule_lang_sql('path')} AS lang FROM paths"
    out["p2_prompt_lang"] = paths_sql() + f"SELECT path, {prompt_lang_sql('path')} AS language FROM paths"
    out["p3_line_explode"] = "WITH " + code_ctes_from(DOC_FILES_SQL) + " SELECT review_id, file, line, raw FROM ln"
    pre = "WITH " + code_ctes()
    out["p4_comment_strip"] = pre + " SELECT review_id, file, line, code FROM ln"
    out["p5_inside_loop"] = pre + " SELECT review_id, file, line FROM nc WHERE in_loop"
    out["p6_blank_filter"] = pre + " SELECT review_id, file, count(*) AS n_code_lines FROM nc GROUP BY review_id, file"
    user = ("'Language: ' || " + prompt_lang_sql("file") + " || chr(10) || 'Rule ID: ' || rule_id || chr(10) || "
            "'Severity: ' || severity || chr(10) || 'File: ' || file || chr(10) || 'Line: ' || CAST(line AS VARCHAR) "
            "|| chr(10) || 'Code Snippet:' || chr(10) || code_snippet || chr(10) || 'Message: ' || message")
    sys_before, sys_after = EN.SYSTEM_PROMPT_FMT.split("%s")
    system = f"{q(sys_before)} || {prompt_lang_sql('file')} || {q(sys_after)}"
    out["p7_prompt_text"] = pre + f", {java_golden_cte()}, lf AS ({all_findings_select()}) SELECT review_id, file, line, rule_id, " \
        f"{system} AS system_prompt, {user} AS user_prompt FROM lf"

    out["s1_file_scan"] = (f"WITH cf AS ({oracle_code_files_sql()}), allf AS (SELECT review_id, file, content FROM cf "
                           f"UNION ALL {DOC_FILES_SQL}) SELECT * FROM allf WHERE {supported_sql('file')} "
                           f"AND {nonblank_sql('content')}")
    out["s2_supported_filter"] = paths_sql() + f"SELECT path, {supported_sql('path')} AS supported FROM paths"
    out["s3_pr_files"] = (f"WITH cf AS ({oracle_code_files_sql()}), f AS (SELECT review_id, file FROM cf UNION ALL "
                          "SELECT DISTINCT review_id, 'docs/R' || CAST(review_id AS VARCHAR) || '.md' FROM cf UNION ALL "
                          "SELECT DISTINCT review_id, 'img/R' || CAST(review_id AS VARCHAR) || '.PNG' FROM cf) "
                          f"SELECT review_id, file FROM f WHERE {supported_sql('file')}")
    # S4 on the same payload text as the Spark job
    sha = "sha256(CAST(o_orderkey AS VARCHAR))"
    body = ("'{\"number\": ' || CAST(o_orderkey AS VARCHAR) || ', \"state\": \"open\", \"head\": ' || "
            "CASE WHEN o_orderkey % 5 = 0 THEN '{\"ref\": \"b' || CAST(o_orderkey AS VARCHAR) || '\"}' "
            "WHEN o_orderkey % 5 = 1 THEN '{\"ref\":\"b' || CAST(o_orderkey AS VARCHAR) || '\",\"sha\":\"\"}' "
            f"ELSE '{{\"ref\": \"feature/' || CAST(o_orderkey AS VARCHAR) || '\", \"sha\": \"' || {sha} || '\"}}' END "
            "|| ', \"base\": {\"ref\": \"main\", \"sha\": \"' || sha256(CAST(o_custkey AS VARCHAR)) || '\"}}'")

    def extract(name):
        key = f'"{name}"'
        idx = f"strpos(body, '{key}')"
        def loc(pos):  # 1-based position of '"' at or after pos, 0 if none
            return f"(CASE WHEN strpos(substr(body, {pos}), '\"') = 0 THEN 0 ELSE strpos(substr(body, {pos}), '\"') + ({pos}) - 1 END)"
        s0 = loc(f"{idx} + {len(key) + 1}")
        e1 = loc(f"{s0} + 1")
        return (f"CASE WHEN {idx} > 0 AND {s0} > 0 AND {e1} > 0 AND {e1} - 1 > {s0} "
                f"THEN substr(body, {s0} + 1, {e1} - 1 - {s0}) ELSE 'unknown' END")
    out["s4_pr_metadata"] = (f"WITH p AS (SELECT o_orderkey AS review_id, {body} AS body FROM orders) "
                             f"SELECT review_id, {extract('sha')} AS head_sha, {extract('ref')} AS head_branch FROM p")
    gh = SC.GITHUB_PR_RE
    url_t = jtrim_sql("github_url")
    out["s5_request_routing"] = f"""
WITH rq AS (
  SELECT page_id AS request_id, ['github', 'code', 'other'][page_id % 3 + 1] AS type,
    CASE page_id % 4 WHEN 0 THEN 'https://github.com/o' || CAST(page_id % 13 AS VARCHAR) || '/r' || CAST(page_id % 5 AS VARCHAR) || '/pull/' || CAST(page_id AS VARCHAR)
      WHEN 1 THEN '   ' WHEN 2 THEN url
      ELSE '  see https://github.com/a-' || CAST(page_id AS VARCHAR) || '/b/pull/' || CAST(page_id * 7 AS VARCHAR) || '/files ' END AS github_url,
    CASE WHEN page_id % 5 = 0 THEN ' ' ELSE html END AS code,
    CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'page' || CAST(page_id AS VARCHAR) || '.js' END AS file_name
  FROM pages
),
x AS (
  SELECT *, type = 'github' AS is_gh, type = 'code' AS is_code, NOT {nonblank_sql('github_url')} AS blank_url,
         NOT {nonblank_sql('code')} AS blank_code, coalesce(regexp_matches({url_t}, {q(gh)}), false) AS matched
  FROM rq
)
SELECT request_id,
  CASE WHEN is_gh AND NOT blank_url AND matched THEN 'github' WHEN is_code AND NOT blank_code THEN 'code' ELSE 'error' END AS route,
  CASE WHEN is_gh AND NOT blank_url AND matched THEN regexp_extract({url_t}, {q(gh)}, 1) END AS owner,
  CASE WHEN is_gh AND NOT blank_url AND matched THEN regexp_extract({url_t}, {q(gh)}, 2) END AS repo,
  CASE WHEN is_gh AND NOT blank_url AND matched THEN CAST(regexp_extract({url_t}, {q(gh)}, 3) AS INTEGER) END AS pr_number,
  CASE WHEN is_code AND NOT blank_code THEN (CASE WHEN {nonblank_sql('file_name')} THEN file_name ELSE {q(SC.DEFAULT_FILE_NAME)} END) END AS file_name,
  CASE WHEN is_gh AND blank_url THEN {q(SC.ERR_URL_REQUIRED)} WHEN is_gh AND NOT matched THEN {q(SC.ERR_URL_INVALID)}
       WHEN is_code AND blank_code THEN {q(SC.ERR_CODE_REQUIRED)} WHEN NOT is_gh AND NOT is_code THEN {q(SC.ERR_TYPE)} END AS error
FROM x"""
    routed = out["s5_request_routing"].replace("SELECT request_id,", "SELECT request_id, code,", 1)
    base = oracle_code_files_sql()
    req_files = (f"SELECT r.request_id AS review_id, c.file, c.content FROM routed r JOIN ({base}) c ON c.review_id = r.pr_number // 10 "
                 f"WHERE r.route = 'github' AND {supported_sql('c.file')} UNION ALL "
                 f"SELECT request_id, file_name, code FROM routed WHERE route = 'code' AND {supported_sql('file_name')}")
    ctes = code_ctes_from(req_files)[len("WITH "):] if code_ctes_from(req_files).startswith("WITH ") else code_ctes_from(req_files)
    out["r1_request_to_result"] = f"""WITH routed AS ({routed}), {ctes}, {java_golden_cte()},
lf AS ({line_findings_select()} UNION ALL
       SELECT r.request_id, j.rule_id, j.severity, j.file, j.line, j.code_snippet, j.message FROM jg j
       JOIN routed r ON r.route = 'github' AND r.pr_number // 10 = j.review_id),
{enriched_sql('lf')},
nf AS (SELECT review_id, count(*) AS n FROM cf GROUP BY 1),
ne AS (SELECT review_id, count(*) AS n, max(priority_score) AS top FROM ef GROUP BY 1)
SELECT r.request_id, r.route, CASE WHEN nf.n IS NULL THEN 'NO_CODE_FILES' ELSE 'SUCCESS' END AS status,
       coalesce(nf.n, 0) AS file_count, coalesce(ne.n, 0) AS finding_count, ne.top AS top_priority
FROM routed r LEFT JOIN nf ON nf.review_id = r.request_id LEFT JOIN ne ON ne.review_id = r.request_id WHERE r.error IS NULL"""


    out["d1_diff_parse"] = (f"WITH cf AS ({oracle_code_files_sql()}), {FX.DIFF_EXPECTED_SQL} "
                            "SELECT diff_id, review_id, file, line FROM changed")
    lf = findings_with_steps_select()
    out["s6_changed_files"] = f"WITH cf AS ({oracle_code_files_sql()}) SELECT doc_id AS diff_id, file FROM cf WHERE {supported_sql('file')}"
    out["d2_diff_scope"] = (pre + f", {java_golden_cte()}, lf AS ({lf}), {FX.DIFF_EXPECTED_SQL} SELECT lf.* EXCLUDE (path_lines) FROM lf WHERE EXISTS "
                            "(SELECT 1 FROM changed c WHERE c.review_id = lf.review_id AND c.file = lf.file "
                            "AND (c.line = lf.line OR list_contains(lf.path_lines, c.line)))")
    en = pre + ", " + enriched_sql()
    out["e1_enrich"] = en + " SELECT * FROM ef"
    fb_r, fb_f = EN.FALLBACK_RATIONALE, EN.FALLBACK_FIX

    def text_field(name):
        jt = f"json_type(clean, '$.{name}')"
        return (f"CASE WHEN empty THEN '' WHEN NOT ok THEN {q(fb_r if name == 'rationale' else fb_f)} "
                f"WHEN {jt} IS NULL THEN '' WHEN {jt} = 'NULL' THEN 'null' WHEN {jt} IN ('OBJECT', 'ARRAY') THEN '' "
                f"ELSE coalesce(json_extract_string(clean, '$.{name}'), '') END")
    def as_int(d):
        return f"CASE WHEN isnan({d}) THEN 0 ELSE CAST(trunc(greatest(least({d}, 2147483647.0), -2147483648.0)) AS INTEGER) END"
    number = "TRY_CAST(json_extract(clean, '$.priorityScore') AS DOUBLE)"
    pj = "json_type(clean, '$.priorityScore')"
    prio = (f"CASE WHEN empty THEN {EN.MISSING_PRIORITY} WHEN NOT ok THEN {EN.FALLBACK_PRIORITY} "
            f"WHEN {pj} IS NULL OR {pj} = 'NULL' THEN {EN.MISSING_PRIORITY} "
            f"WHEN {pj} = 'BOOLEAN' THEN CASE WHEN CAST(json_extract(clean, '$.priorityScore') AS BOOLEAN) THEN 1 ELSE 0 END "
            f"WHEN {pj} = 'VARCHAR' THEN coalesce({as_int(f'TRY_CAST({jtrim_sql(chr(34) + chr(120) + chr(34))} AS DOUBLE)')}, {EN.MISSING_PRIORITY}) "
            f"WHEN {pj} IN ('OBJECT', 'ARRAY') THEN {EN.MISSING_PRIORITY} "
            f"ELSE coalesce({as_int(number)}, {EN.MISSING_PRIORITY}) END")
    prio = prio.replace('"x"', "json_extract_string(clean, '$.priorityScore')")
    out["e2_response_guard"] = f"""
WITH {FX.RESPONSES_SQL},
t AS (SELECT conv_id, turn, {jtrim_sql('coalesce(response, ' + "''" + ')')} AS t FROM responses),
c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)^```[^\\n]*\\n.*```')
        THEN {jtrim_sql("regexp_extract(t, '(?s)^```[^\\n]*\\n(.*)```', 1)")} ELSE t END AS clean FROM t),
p AS (SELECT *, clean = '' AS empty, coalesce(json_valid(clean), false) AS ok FROM c)
SELECT conv_id, turn, {text_field('rationale')} AS rationale, {text_field('fix')} AS fix,
       CAST({prio} AS INTEGER) AS priority FROM p"""
    bullet = ("'- **' || rule_id || '** `' || file || ':L' || CAST(line AS VARCHAR) || '` (Priority ' || "
              "CAST(priority_score AS VARCHAR) || '/10)' || chr(10) || '  ' || rationale || chr(10) || chr(10)")
    header = EN.REPORT_HEADER.replace("\n", "' || chr(10) || '")
    out["e3_review_summary"] = en + f""",
sm AS (SELECT review_id, string_agg({bullet}, '' ORDER BY file, line, rule_id, {bullet}) AS body FROM ef GROUP BY review_id)
SELECT rv.review_id, '{header}' || coalesce(sm.body, {q(EN.REPORT_EMPTY)}) AS summary
FROM rv LEFT JOIN sm ON sm.review_id = rv.review_id"""
    cbody = ("'### Review: ' || severity || chr(10) || '**Rule**: ' || rule_id || ' | **Priority**: ' || "
             "CAST(priority_score AS VARCHAR) || '/10' || chr(10) || chr(10) || rationale || chr(10) || chr(10) || "
             "'**Fix**:' || chr(10) || '```' || chr(10) || fix_suggestion || chr(10) || '```'")
    out["e4_review_request"] = en + f""",
sm AS (SELECT review_id, string_agg({bullet}, '' ORDER BY file, line, rule_id, {bullet}) AS body FROM ef GROUP BY review_id),
cm AS (SELECT review_id, list({{'path': file, 'line': line, 'side': 'RIGHT', 'body': {cbody}}}
          ORDER BY file, line, {cbody}) AS comments FROM ef GROUP BY review_id)
SELECT rv.review_id, to_json({{'body': '{header}' || coalesce(sm.body, {q(EN.REPORT_EMPTY)}), 'event': 'COMMENT',
   'commit_id': rv.commit_sha, 'comments': coalesce(cm.comments, [])}})::VARCHAR AS request_json
FROM rv LEFT JOIN sm ON sm.review_id = rv.review_id LEFT JOIN cm ON cm.review_id = rv.review_id"""
    item = ("{'file': file, 'line': line, 'rule_id': rule_id, 'severity': severity, 'message': message, "
            "'code_snippet': code_snippet, 'rationale': rationale, 'fix_suggestion': fix_suggestion, "
            "'priority_score': priority_score}")
    out["e5_result_document"] = en + f""",
ag AS (SELECT review_id, count(*) AS n, list({item} ORDER BY file, line, rule_id, severity, message, code_snippet,
          rationale, fix_suggestion, priority_score) AS findings FROM ef GROUP BY review_id)
SELECT rv.review_id, rv.source, rv.analyzed_at, CAST(coalesce(ag.n, 0) AS BIGINT) AS finding_count,
       to_json(coalesce(ag.findings, []))::VARCHAR AS findings_json
FROM rv LEFT JOIN ag ON ag.review_id = rv.review_id"""
    lim = []
    for c, n in (("code_snippet", 2000), ("message", 1000), ("rationale", 2000), ("fix_suggestion", 3000)):
        lim.append(f"{c}, coalesce(length({c}) > {n}, false) AS {c}_overflow")
    out["k1_persist_findings"] = en + f""" SELECT
  row_number() OVER (ORDER BY review_id, file, line, rule_id, message, code_snippet) AS id,
  review_id, rule_id, severity, file AS file_path, line AS line_number, priority_score, {', '.join(lim)}
FROM ef"""
    return out


# ---------------------------------------------------------------------------
# G oracles (recursive CTEs)
# ---------------------------------------------------------------------------
from revspark.sources import event_flow as EF  # noqa: E402


def flow_ctes() -> str:
    ids = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in EF.NODE_IDS.items())
    defs = " UNION ALL ".join(
        f"SELECT graph_id, node, {q(v)} AS var, {str(n).upper()} AS is_null, node || ':' || {q(v)} AS def_id "
        f"FROM nodes WHERE node = {q(nd)}" for nd, v, n in EF.DEFS)
    uses = " UNION ALL ".join(f"SELECT graph_id, node, {q(v)} AS var FROM nodes WHERE node = {q(nd)}"
                              for nd, v in EF.USES)
    return f"""
ev AS (
  SELECT CAST(user_id * 100000 + (CAST(date_trunc('week', ts) AS DATE) - DATE '1970-01-01') AS BIGINT) AS graph_id,
         ts, event_id, event_type AS node FROM events
),
seq AS (
  SELECT graph_id, node, lead(node) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS nxt,
         row_number() OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS rn FROM ev
),
edges AS (
  SELECT DISTINCT graph_id, src, dst, 'UNCONDITIONAL' AS edge_type FROM (
    SELECT graph_id, node AS src, nxt AS dst FROM seq WHERE nxt IS NOT NULL
    UNION ALL SELECT graph_id, 'ENTRY', node FROM seq WHERE rn = 1
    UNION ALL SELECT graph_id, node, 'EXIT' FROM seq WHERE nxt IS NULL) x
),
nodes AS (
  SELECT DISTINCT graph_id, node, CASE node {ids} END AS node_id FROM (
    SELECT graph_id, src AS node FROM edges UNION ALL SELECT graph_id, dst FROM edges) y
),
defs AS ({defs}),
uses AS ({uses}),
guards AS (SELECT graph_id, src, dst, {q(EF.GUARD_VAR)} AS var FROM edges WHERE src = {q(EF.GUARD_SRC)}),
reach AS (
  WITH RECURSIVE r(graph_id, node, def_id, var, def_node) AS (
    SELECT d.graph_id, e.dst, d.def_id, d.var, d.node FROM defs d JOIN edges e ON e.graph_id = d.graph_id AND e.src = d.node
    UNION
    SELECT r.graph_id, e.dst, r.def_id, r.var, r.def_node FROM r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node
    WHERE r.node = r.def_node OR NOT EXISTS (SELECT 1 FROM defs k WHERE k.graph_id = r.graph_id AND k.node = r.node AND k.var = r.var)
  ) SELECT * FROM r
)
"""


def flow_sql() -> dict[str, str]:
    pre = "WITH " + flow_ctes()
    out = {}
    out["g0_flow_edges"] = pre + " SELECT * FROM edges"
    out["g1_degrees"] = pre + """ SELECT n.graph_id, n.node,
        CAST((SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node) AS BIGINT) AS out_degree,
        CAST((SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node) AS BIGINT) AS in_degree
      FROM nodes n"""
    out["g1_neighbours"] = pre + """ SELECT graph_id, src AS node, dst AS neighbour, 'successor' AS kind FROM edges
      UNION ALL SELECT graph_id, dst, src, 'predecessor' FROM edges"""
    out["g1_remove_edges"] = pre + " SELECT graph_id, src, dst FROM edges EXCEPT SELECT graph_id, src, dst FROM guards"
    out["g2_gen_kill"] = pre + """ SELECT graph_id, node, def_id, 'gen' AS kind FROM defs
      UNION ALL SELECT a.graph_id, a.node, b.def_id, 'kill' FROM defs a JOIN defs b
        ON a.graph_id = b.graph_id AND a.var = b.var AND a.node <> b.node"""
    out["g3_reaching_defs"] = pre + " SELECT graph_id, node, def_id FROM reach"
    out["g4_def_use"] = pre + """ SELECT r.graph_id, r.def_node, u.node AS use_node, u.var, r.def_id
      FROM uses u JOIN reach r ON r.graph_id = u.graph_id AND r.node = u.node AND r.var = u.var"""
    barrier = f"({q(EF.CLOSE_NODE)}, {q(EF.ESCAPE_NODE)})"
    leak = f"""
lk AS (
  WITH RECURSIVE p(graph_id, start, node, path) AS (
    SELECT graph_id, node, node, [node] FROM nodes WHERE node = {q(EF.RESOURCE_DEF)} AND node NOT IN {barrier}
    UNION ALL
    SELECT p.graph_id, p.start, e.dst, list_append(p.path, e.dst) FROM p
    JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.node
    WHERE p.node NOT IN {barrier} AND p.node <> 'EXIT' AND NOT list_contains(p.path, e.dst)
  ) SELECT * FROM p WHERE node = 'EXIT'
)"""
    out["g5_leak_paths"] = pre + ", " + leak + " SELECT DISTINCT graph_id, start AS def_node FROM lk"
    ids = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in EF.NODE_IDS.items())
    out["g7_witness_path"] = pre + ", " + leak + f""",
ranked AS (
  SELECT graph_id, start, path, list_transform(path, lambda x: CASE x {ids} END) AS idp FROM lk
),
best AS (
  SELECT graph_id, start, arg_min(path, [len(path)] || idp) AS path FROM ranked GROUP BY graph_id, start
)
SELECT graph_id, start AS def_node, array_to_string(path, ' -> ') AS witness,
       list_transform(path, lambda x: CASE WHEN x IN ('ENTRY', 'EXIT') THEN -1 ELSE CASE x {ids} END END) AS lines FROM best"""
    out["g6_unguarded_null"] = pre + """,
ug AS (
  WITH RECURSIVE u(graph_id, start, var, node) AS (
    SELECT graph_id, node, var, node FROM defs WHERE is_null
    UNION
    SELECT u.graph_id, u.start, u.var, e.dst FROM u JOIN edges e ON e.graph_id = u.graph_id AND e.src = u.node
    WHERE NOT EXISTS (SELECT 1 FROM guards g WHERE g.graph_id = e.graph_id AND g.src = e.src AND g.dst = e.dst
                      AND g.var = u.var)
  ) SELECT * FROM u
)
SELECT DISTINCT us.graph_id, us.node, us.var FROM uses us
JOIN ug ON ug.graph_id = us.graph_id AND ug.node = us.node AND ug.var = us.var
JOIN reach r ON r.graph_id = us.graph_id AND r.node = us.node AND r.var = us.var AND r.def_node = ug.start"""
    return out


# ---------------------------------------------------------------------------
# W oracles
# ---------------------------------------------------------------------------
from revspark.streaming import intake as WI  # noqa: E402


def webhooks_sql() -> str:
    acts = "[" + ", ".join(q(a) for a in FX.WEBHOOK_ACTIONS) + "]"
    full = ("'{\"action\": \"' || " + acts + "[event_id % 5 + 1] || '\", \"number\": ' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 29 = 0 THEN '0000000000' ELSE '' END "
            "|| ', \"repository\": {\"full_name\": \"o/r' || CAST(user_id AS VARCHAR) || "
            "'\"}, \"pull_request\": {\"head\": {\"sha\": \"' || sha256(CAST(event_id AS VARCHAR)) || '\"}}}'")
    return f"""
wf AS (SELECT event_id, user_id, ts, {full} AS body FROM events),
wp AS (SELECT event_id, ts, CASE WHEN event_id % 17 = 0 THEN substr(body, 1, CAST(floor(length(body) / 2) AS INTEGER))
                                 ELSE body END AS payload FROM wf),
hooks AS (
  SELECT event_id, ts, payload,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'sha256=' || sha256(payload)
         ELSE 'sha256=' || {hmac_sha256_hex_sql(FX.WEBHOOK_SECRET, 'payload')} END AS signature,
    CASE WHEN event_id % 7 = 0 THEN 'push' ELSE 'pull_request' END AS event
  FROM wp
)"""


def intake_sql() -> str:
    acts = _in(WI.TRIGGER_ACTIONS)
    return f"""
ik AS (
  SELECT *, coalesce(starts_with(signature, 'sha256=') AND signature = 'sha256=' || {hmac_sha256_hex_sql(FX.WEBHOOK_SECRET, 'payload')}, false) AS sig_ok,
         coalesce(event = 'pull_request', false) AS is_pr,
         coalesce(json_valid(payload), false) OR coalesce(payload, '') = '' AS json_ok,
         coalesce(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.action') END, '') AS action
  FROM hooks
),
it AS (
  SELECT *, sig_ok AND is_pr AND json_ok AND action IN {acts} AS triggered FROM ik
),
intake AS (
  SELECT event_id,
    CAST(CASE WHEN NOT sig_ok THEN {WI.OUT_UNAUTHORIZED[0]} WHEN NOT is_pr THEN {WI.OUT_NOT_PR[0]}
              WHEN NOT json_ok THEN {WI.OUT_BAD_JSON[0]} ELSE 200 END AS INTEGER) AS status,
    CASE WHEN NOT sig_ok THEN {q(WI.OUT_UNAUTHORIZED[1])} WHEN NOT is_pr THEN {q(WI.OUT_NOT_PR[1])}
         WHEN NOT json_ok THEN {q(WI.OUT_BAD_JSON[1])} WHEN triggered THEN {q(WI.OUT_TRIGGERED[1])}
         ELSE {q(WI.ACTION_IGNORED_FMT[0])} || action || {q(WI.ACTION_IGNORED_FMT[1])} END AS outcome,
    triggered,
    CASE WHEN triggered AND json_valid(payload) THEN coalesce(json_extract_string(payload, '$.repository.full_name'), '') END AS repo_name,
    CASE WHEN triggered AND json_valid(payload) THEN coalesce(TRY_CAST(json_extract(payload, '$.number') AS INTEGER), 0) END AS pr_number,
    CASE WHEN triggered AND json_valid(payload) THEN coalesce(json_extract_string(payload, '$.pull_request.head.sha'), '') END AS commit_sha
  FROM it
)"""


def chain_sql(key_sql: str, gap_s: int) -> str:
    g = gap_s * 1_000_000
    return f"""
ev AS (SELECT {key_sql} AS k, event_id AS id, epoch_us(ts) AS t FROM events),
nx AS (SELECT e.k, e.id, e.t, (SELECT e2.id FROM ev e2 WHERE e2.k = e.k AND e2.t >= e.t + {g}
                               ORDER BY e2.t, e2.id LIMIT 1) AS nxt FROM ev e),
heads AS (SELECT k, arg_min(id, [t, id]) AS id FROM ev GROUP BY k),
chain AS (
  WITH RECURSIVE c(k, id) AS (
    SELECT k, id FROM heads
    UNION ALL SELECT nx.k, nx.nxt FROM c JOIN nx ON nx.id = c.id WHERE nx.nxt IS NOT NULL
  ) SELECT * FROM c
)"""


def stream_sql(key_sql: str, gap_s: int, delay_s: int) -> str:
    """``walk``: the events of a key one after the other, in order of arrival, then time, then id."""
    g, dl = gap_s * 1_000_000, delay_s * 1_000_000
    return f"""
ev AS (SELECT {key_sql} AS k, event_id AS id, epoch_us(ts) AS t,
              CAST(least((day(ts) - 1) // 8 + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END, 3) AS INTEGER) AS slice FROM events),
wm AS (SELECT slice, max(max(t)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {dl} AS mark FROM ev GROUP BY slice),
o AS (SELECT ev.*, mark, coalesce(t < mark, false) AS late, row_number() OVER (PARTITION BY k ORDER BY slice, t, id) AS n FROM ev JOIN wm USING (slice)),
walk AS (
  SELECT k, n, id, slice, late, true AS accepted, id AS set_id, t AS last, slice AS last_slice FROM o WHERE n = 1
  UNION ALL
  SELECT k, n, id, slice, late, ok, CASE WHEN ok THEN id ELSE set_id END, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN slice ELSE last_slice END
  FROM (SELECT o.k, o.n, o.id, o.slice, o.late, o.t, w.set_id, w.last, w.last_slice,
               o.t >= w.last + {g} OR (w.last_slice < o.slice AND w.last + {g} <= o.mark) AS ok
        FROM walk w JOIN o ON o.k = w.k AND o.n = w.n + 1) x
)"""


def w_sql() -> dict[str, str]:
    out = {}
    w1 = "WITH " + webhooks_sql() + ", " + intake_sql() + " SELECT * FROM intake"
    out["w1_webhook_intake"] = w1
    out["w1_webhook_intake_stream"] = w1
    w2 = "WITH " + chain_sql("user_id", 10 * 3600) + """
SELECT e.k AS user_id, e.id AS event_id, e.id IN (SELECT id FROM chain) AS accepted FROM ev e"""
    out["w2_throttle"] = w2
    out["w2_throttle_stream"] = "WITH RECURSIVE " + stream_sql("user_id", 10 * 3600, 10 * 3600) + """
SELECT k AS user_id, id AS event_id, accepted, late, slice FROM walk"""
    g = 3600 * 1_000_000
    out["w3_first_version"] = "WITH " + chain_sql("user_id % 20", 3600) + f""",
sets AS (SELECT ev.k, ev.id AS set_id, ev.t AS st FROM ev JOIN chain ON chain.id = ev.id)
SELECT e.k AS ttl_key, e.id AS event_id, s.set_id FROM ev e JOIN sets s ON s.k = e.k
WHERE (s.st < e.t OR (s.st = e.t AND s.set_id <= e.id)) AND e.t < s.st + {g}"""
    out["w3_first_version_stream"] = "WITH RECURSIVE " + stream_sql("user_id % 20", 3600, 3600) + """
SELECT k AS ttl_key, id AS event_id, set_id, late, slice FROM walk"""
    out["w5_live_history"] = f"""WITH f AS ({FINDINGS_SQL}), r AS ({REVIEWS_SQL})
SELECT r.id AS review_id, count(f.review_id) AS finding_count, count(*) FILTER (WHERE f.severity = 'ERROR') AS error_count
FROM r LEFT JOIN f ON f.review_id = r.id GROUP BY r.id"""
    return out


# ---------------------------------------------------------------------------
# T and J oracles
# ---------------------------------------------------------------------------
from revspark.operators import java_rules as JR  # noqa: E402
from revspark.operators import tokens as TK  # noqa: E402
from revspark.sources import code_files as CF  # noqa: E402

# Java-rule oracles are generator goldens: the expected findings of every
# template occurrence in the derived corpus (FIXTURES.md B1), placed at the
# line the generator writes them to.  Columns: template, query key, rule id,
# severity, line offset in the template, snippet, message, only in @Service
# classes, copies.  $v / $n are the template's variable and chunk number, $L
# the line of the finding, $P that of the null definition (always the template's second line).
JAVA_EXPECTED = [
    (0, "j1_resource_leak", JR.R_LEAK, "ERROR", 1, '$v = FileChannel.open(log, "r//w")',
     JR.MSG_LEAK.format("$v", "FileChannel"), False, 1),
    (3, "j2_null_deref", JR.R_NULL, "ERROR", 2, "return $v.capacity();", JR.MSG_NULL.format("$v", "$P"), False, 1),
    (5, "j3a_shared_field", JR.R_CONC, "WARNING", 1, "visits += 2;", JR.MSG_SHARED.format("visits"), True, 1),
    (6, "j3a_shared_field", JR.R_CONC, "WARNING", 1, "if (desks.get(badge) == null) {", JR.MSG_SHARED.format("desks"),
     True, 1),
    (6, "j3b_check_then_act", JR.R_CONC, "WARNING", 1, "desks.get(badge) == null", JR.MSG_CTA, False, 1),
    (7, "j3a_shared_field", JR.R_CONC, "WARNING", 2, "return desks;", JR.MSG_SHARED.format("desks"), True, 1),
    (7, "j3c_unsafe_publication", JR.R_CONC, "WARNING", 2, "return desks;", JR.MSG_PUBLISH.format("desks"), False, 1),
    (8, "j3a_shared_field", JR.R_CONC, "WARNING", 2, "Badge b = badgeRepository.findByCode(codes[q]);",
     JR.MSG_SHARED.format("badgeRepository"), True, 1),
    (8, "j4a_query_in_loop", JR.R_N1, "WARNING", 2, "badgeRepository.findByCode(codes[q])", JR.MSG_N1_LOOP, False, 1),
    (9, "j3a_shared_field", JR.R_CONC, "WARNING", 1,
     "return codes.stream().map(c -> badgeRepository.findByCode(c)).toList();", JR.MSG_SHARED.format("badgeRepository"),
     True, 1),
    (9, "j4b_query_in_stream", JR.R_N1, "WARNING", 1, "badgeRepository.findByCode(c)", JR.MSG_N1_STREAM, False, 1),
    (10, "j3a_shared_field", JR.R_CONC, "WARNING", 3, "badgeRepository.save(a);",
     JR.MSG_SHARED.format("badgeRepository"), True, 1),
    (10, "j4a_query_in_loop", JR.R_N1, "WARNING", 3, "badgeRepository.save(a)", JR.MSG_N1_LOOP, False, 2),
    (11, "j5_sql_concat", JR.R_SQL, "ERROR", 1, "st.executeUpdate(\"delete from badges where code = \" + $v)",
     JR.MSG_SQL, False, 1),
    (13, "j6_hardcoded_secret", JR.R_SECRET, "ERROR", 1, 'password = "p$n-$v"', JR.MSG_SECRET.format("password"),
     False, 1),
    (14, "j7_loop_bound", JR.R_LOOP, "WARNING", 1, "row <= grid.length()", JR.MSG_LOOP, False, 1),
    # a later return that does not hand the resource out; a close on one path only
    (16, "j1_resource_leak", JR.R_LEAK, "ERROR", 1, "r = new FileReader(path)", JR.MSG_LEAK.format("r", "FileReader"),
     False, 1),
    (17, "j1_resource_leak", JR.R_LEAK, "ERROR", 1, '$v = new FileInputStream("c")',
     JR.MSG_LEAK.format("$v", "FileInputStream"), False, 1),
    # an assignment on one path only; a guard that falls through (20 leaves: no finding)
    (18, "j2_null_deref", JR.R_NULL, "ERROR", 5, "return $v.length();", JR.MSG_NULL.format("$v", "$P"), False, 1),
    (19, "j2_null_deref", JR.R_NULL, "ERROR", 5, "audit($v.trim());", JR.MSG_NULL.format("$v", "$P"), False, 1),
    # 21: words of an initializer are no fields; 22: a '>' that compares
    (22, "j3a_shared_field", JR.R_CONC, "WARNING", 1, "return n > visits;", JR.MSG_SHARED.format("visits"), True, 1),
    # a loop without braces around an if; a chained receiver
    (23, "j3a_shared_field", JR.R_CONC, "WARNING", 3, "badgeRepository.findOne(id);",
     JR.MSG_SHARED.format("badgeRepository"), True, 1),
    (23, "j4a_query_in_loop", JR.R_N1, "WARNING", 3, "badgeRepository.findOne(id)", JR.MSG_N1_LOOP, False, 1),
    (23, "j4a_query_in_loop", JR.R_N1, "WARNING", 4, "badgeRepository.deleteAll(id)", JR.MSG_N1_LOOP, False, 1),
    (24, "j3a_shared_field", JR.R_CONC, "WARNING", 2, "badgeRepository.queryFor(q).getRows();",
     JR.MSG_SHARED.format("badgeRepository"), True, 1),
    (24, "j4a_query_in_loop", JR.R_N1, "WARNING", 2, "badgeRepository.queryFor(q)", JR.MSG_N1_LOOP, False, 1),
    (24, "j4a_query_in_loop", JR.R_N1, "WARNING", 2, "badgeRepository.queryFor(q).getRows()", JR.MSG_N1_LOOP, False, 1),
    # paths: a return and a throw before the close (27 closes on both branches, 32 in a switch, 33 on nested branches)
    (28, "j1_resource_leak", JR.R_LEAK, "ERROR", 1, '$v = open("f")', JR.MSG_LEAK.format("$v", "Reader"), False, 1),
    (31, "j1_resource_leak", JR.R_LEAK, "ERROR", 1, '$v = open("g")', JR.MSG_LEAK.format("$v", "Reader"), False, 1),
    # a null that comes round the loop; a loop that may not run or is left early (29 sets on both branches, 35 in a do body)
    (30, "j2_null_deref", JR.R_NULL, "ERROR", 1, "for (int i = 0; i < 3; i++) {audit($v.trim()); $v = null; }",
     JR.MSG_NULL.format("$v", "$P"), False, 1),
    (34, "j2_null_deref", JR.R_NULL, "ERROR", 7, "return $v.length();", JR.MSG_NULL.format("$v", "$P"), False, 1),
]


def java_golden_cte() -> str:
    """CTE ``jg``: expected Java findings of the corpus (review_id, rule_id,
    severity, file, line, code_snippet, message, qkey)."""
    tpl = CF.templates()
    n_lines = ", ".join(f"({i}, {b.count('~') + 1})" for e, i, b in tpl if e == "java")
    exp = ", ".join(
        f"({t}, {q(k)}, {q(r)}, {q(s)}, {o}, {q(sn)}, {q(m)}, {str(svc).upper()}, {c})"
        for t, k, r, s, o, sn, m, svc, c in JAVA_EXPECTED)
    n_java = CF.template_counts()["java"]
    return f"""
jc AS (
  SELECT doc_id, k, (doc_id * 31 + k * k * 17 + k) % {n_java} AS idx
  FROM (SELECT doc_id, unnest(range(0, 2 + (doc_id // 5) % 6)) AS k FROM documents WHERE doc_id % 5 = 0) x
),
jn AS (SELECT jc.*, tl.n FROM jc JOIN (VALUES {n_lines}) tl(idx, n) ON tl.idx = jc.idx),
js AS (
  SELECT doc_id, k, idx, n,
         CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 5 END + 1
           + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS start_line
  FROM jn
),
jg AS (
  SELECT CAST(d.doc_id // {CF.FILES_PER_REVIEW} AS BIGINT) AS review_id, e.rule_id, e.severity,
         'src/' || d.source || '/F' || CAST(d.doc_id AS VARCHAR) || '.java' AS file,
         CAST(js.start_line + e.off AS INTEGER) AS line,
         replace(replace(e.snippet, '$v', 'v' || CAST(js.doc_id % 7 AS VARCHAR)), '$n', CAST(js.k AS VARCHAR)) AS code_snippet,
         replace(replace(e.message, '$v', 'v' || CAST(js.doc_id % 7 AS VARCHAR)), '$P',
                 CAST(js.start_line + 1 AS VARCHAR)) AS message,
         e.qkey,
         CASE e.qkey WHEN 'j1_resource_leak' THEN [CAST(js.start_line + e.off AS INTEGER), CAST(js.start_line + js.n - 1 AS INTEGER)]
                     WHEN 'j2_null_deref' THEN [CAST(js.start_line + 1 AS INTEGER), CAST(js.start_line + e.off AS INTEGER)] END AS path_lines
  FROM js JOIN documents d ON d.doc_id = js.doc_id
  JOIN (VALUES {exp}) e(idx, qkey, rule_id, severity, off, snippet, message, svc, copies) ON e.idx = js.idx
  CROSS JOIN LATERAL (SELECT unnest(range(e.copies)) AS copy_no) cp
  WHERE NOT e.svc OR js.doc_id % 2 = 0
)"""


def token_ctes() -> str:
    """T1 over the .java files of the corpus (needs ``cf``)."""
    sp, tk = q(TK.SPECIAL_RE), q(TK.TOKEN_RE)
    return f"""
jf AS (SELECT review_id, file, content FROM cf WHERE suffix(file, '.java')),
jp AS (SELECT review_id, file, regexp_split_to_array(content, {sp}) AS pieces,
              list_append(regexp_extract_all(content, {sp}), '') AS specials FROM jf),
jb AS (SELECT review_id, file, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i:
         pieces[i] || CASE WHEN starts_with(specials[i], '/') THEN regexp_replace(specials[i], '[^\\n]', ' ', 'g')
                          ELSE specials[i] END), '') AS clean FROM jp),
jl AS (SELECT review_id, file, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text
       FROM (SELECT review_id, file, string_split(clean, chr(10)) AS ls FROM jb) y),
jt0 AS (SELECT review_id, file, line, unnest(range(0, len(ts))) AS idx, unnest(ts) AS tok
        FROM (SELECT review_id, file, line, regexp_extract_all(text, {tk}) AS ts FROM jl) z),
jt AS (
  SELECT review_id, file, CAST(line AS INTEGER) AS line, CAST(idx AS INTEGER) AS idx, tok,
         CAST(line AS BIGINT) * {1 << TK.LINE_BITS} + idx AS pos,
         CASE WHEN starts_with(tok, '"') THEN 'str' WHEN starts_with(tok, '''') THEN 'chr'
              WHEN regexp_matches(tok, '^[A-Za-z_$]') THEN 'id' WHEN regexp_matches(tok, '^[0-9]') THEN 'num'
              ELSE 'op' END AS kind,
         CAST(sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END)
              OVER (PARTITION BY review_id, file ORDER BY line, idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS nd,
         CAST(sum(CASE WHEN tok = '{{' THEN 1 WHEN tok = '}}' THEN -1 ELSE 0 END)
              OVER (PARTITION BY review_id, file ORDER BY line, idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS bd
  FROM jt0
)"""


def java_sql() -> dict[str, str]:
    out = {}
    cf = f"cf AS ({oracle_code_files_sql()})"
    out["t1_tokens"] = f"WITH {cf}, {token_ctes()} SELECT review_id, file, line, idx, tok, kind, nd, bd FROM jt"
    # on the corpus a block's kind can be read off the line that opens it
    out["t2_scopes"] = f"""WITH {cf}, {token_ctes()},
br AS (SELECT review_id, file, pos, line, tok, CASE WHEN tok = '{{' THEN nd ELSE nd + 1 END AS lvl,
              lag(tok) OVER (PARTITION BY review_id, file ORDER BY pos) AS prev
       FROM jt QUALIFY tok IN ('{{', '}}')),
bp AS (SELECT *, lead(tok) OVER w AS c_tok, lead(pos) OVER w AS c_pos, lead(line) OVER w AS c_line
       FROM br WINDOW w AS (PARTITION BY review_id, file, lvl ORDER BY pos)),
hd AS (SELECT bp.*, jl.text FROM bp JOIN jl ON jl.review_id = bp.review_id AND jl.file = bp.file AND jl.line = bp.line
       WHERE tok = '{{' AND c_tok = '}}'),
kd AS (SELECT *, CASE WHEN lvl = 1 THEN 'class' WHEN lvl = 2 THEN 'method' WHEN prev IN ('else', 'do', 'try', 'finally') THEN prev
         WHEN regexp_matches(text, '^ *try *[(]') THEN 'try' ELSE regexp_extract(text, '^ *(if|for|while|switch|catch|synchronized) *[(]', 1) END AS kind
       FROM hd)
SELECT review_id, file, pos AS open_pos, c_pos AS close_pos, line AS open_line, c_line AS close_line, lvl AS depth, kind,
       CASE kind WHEN 'class' THEN regexp_extract(text, 'class ([A-Za-z0-9_]+)', 1)
                 WHEN 'method' THEN regexp_extract(text, '([A-Za-z0-9_]+)[(]', 1) END AS name
FROM kd"""
    pre = "WITH " + code_ctes() + ", " + java_golden_cte()
    rules = "(VALUES " + ", ".join(f"({q(r)}, {q(sv)})" for r, sv in ALL_RULES) + ") rl(rule_id, severity)"
    out["d3_run_rules"] = pre + f", af AS ({all_findings_select()}) SELECT * FROM af"
    out["d4_rule_stats"] = pre + f""", af AS ({all_findings_select()}) SELECT rl.rule_id, rl.severity,
        CAST((SELECT count(*) FROM af WHERE af.rule_id = rl.rule_id) AS BIGINT) AS n_findings FROM {rules}"""
    both = f"SELECT review_id, file, content FROM ({oracle_code_files_sql()}) UNION ALL {DOC_FILES_SQL}"
    out["d5_scan_once"] = "WITH " + code_ctes_from(both) + ", " + java_golden_cte() + \
        f", af AS ({all_findings_select()}) SELECT * FROM af"
    ident = "'^[A-Za-z_$]'"
    def typeish(a: str, b: str, c: str) -> str:
        """The twin of java_rules._typeish over the columns of a token and the two before it."""
        return (f"(coalesce(regexp_matches({a}, {ident}) AND {a} NOT IN {_in(TK.MODIFIERS)} AND {a} NOT IN {_in(TK.EXPR_KEYWORDS)}, false) "
                f"OR coalesce({a} = '>' AND ({b} IN ('>', ']', '?') OR (regexp_matches({b}, '^[A-Z]') "
                f"AND {c} IN (',', '.', 'extends', 'super', '&')) OR {c} = '<'), false) OR coalesce({a} = ']' AND {b} = '[', false))")
    starts = ("NOT (tok IN ('.', ')', ']') OR p1 = '.' OR (tok = '(' AND after_word) OR (tok = '[' AND (after_word OR p1 IN (')', ']'))) "
              f"OR (regexp_matches(tok, {ident}) AND tok NOT IN {_in(TK.STMT_KEYWORDS)} AND tok NOT IN {_in(TK.EXPR_KEYWORDS)} AND p1 = 'new'))")
    callable_ = [k for k in TK.STMT_KEYWORDS if k not in ("this", "super")]
    out["t3_calls"] = f"""WITH {cf}, {token_ctes()},
jw0 AS (SELECT *, coalesce(lag(tok, 1) OVER w, '') AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3,
              lag(tok, 4) OVER w AS p4, lag(pos, 1) OVER w AS p1_pos,
              least(nd, nd - CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END) AS deep
       FROM jt WINDOW w AS (PARTITION BY review_id, file ORDER BY pos)),
jw1 AS (SELECT *, regexp_matches(p1, {ident}) AND p1 NOT IN {_in(callable_)} AND p1 NOT IN {_in(TK.EXPR_KEYWORDS)} AS after_word FROM jw0),
jw AS (SELECT *, max(CASE WHEN {starts} THEN pos END) OVER (PARTITION BY review_id, file, deep ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS chain_start FROM jw1),
pr AS (SELECT review_id, file, pos, line, tok, p1, p2, p3, p4, p1_pos, CASE WHEN tok = '(' THEN nd ELSE nd + 1 END AS lvl
       FROM jw WHERE tok IN ('(', ')')),
pp AS (SELECT *, lead(tok) OVER w AS c_tok, lead(pos) OVER w AS c_pos
       FROM pr WINDOW w AS (PARTITION BY review_id, file, lvl ORDER BY pos)),
calls AS (
  SELECT pp.review_id, pp.file, pp.p1 AS name, pp.pos AS a_open, pp.c_pos AS a_close, n.pos AS name_pos,
         CASE WHEN n.p1 = '.' AND n.chain_start IS NOT NULL THEN n.chain_start ELSE n.pos END AS call_pos
  FROM pp JOIN jw n ON n.review_id = pp.review_id AND n.file = pp.file AND n.pos = pp.p1_pos
  WHERE pp.tok = '(' AND pp.c_tok = ')' AND regexp_matches(pp.p1, {ident}) AND pp.p1 NOT IN {_in(TK.STMT_KEYWORDS)}
    AND (pp.p2 = '.' OR NOT {typeish('pp.p2', 'pp.p3', 'pp.p4')}) AND coalesce(pp.p2, '') <> 'new'
)
SELECT c.review_id, c.file, c.name, coalesce(string_agg(t.tok, '' ORDER BY t.pos), '') AS receiver,
       CAST(c.call_pos // {1 << TK.LINE_BITS} AS INTEGER) AS call_line, c.a_open, c.a_close
FROM calls c LEFT JOIN jw t ON t.review_id = c.review_id AND t.file = c.file AND t.pos >= c.call_pos AND t.pos < c.name_pos
     AND NOT (t.tok = '.' AND t.pos = (SELECT max(x.pos) FROM jt x WHERE x.review_id = c.review_id AND x.file = c.file AND x.pos < c.name_pos))
GROUP BY c.review_id, c.file, c.name, c.name_pos, c.call_pos, c.a_open, c.a_close"""
    out["t4_fields"] = f"""WITH {cf}, {token_ctes()},
ja AS (SELECT *, sum(CASE WHEN tok = '<' THEN 1 WHEN tok = '>' THEN -1 ELSE 0 END)
                OVER (PARTITION BY review_id, file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ang FROM jt),
jw AS (SELECT *, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3,
         ang - coalesce(arg_max(ang, CASE WHEN tok IN (';', '{{', '}}') THEN pos END) OVER b, 0) AS angle,
         coalesce(max(CASE WHEN tok IN (';', '{{', '}}') THEN pos END) OVER b, -1) AS stmt_start,
         coalesce(max(CASE WHEN tok IN ('class', 'interface') AND coalesce(lag1, '') <> '.' THEN pos END) OVER b, -1)
           AS last_class_kw
       FROM (SELECT *, lag(tok, 1) OVER (PARTITION BY review_id, file ORDER BY pos) AS lag1,
                    lead(tok, 1) OVER (PARTITION BY review_id, file ORDER BY pos) AS n1 FROM ja) x
       WINDOW w AS (PARTITION BY review_id, file ORDER BY pos),
              b AS (PARTITION BY review_id, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
br AS (SELECT review_id, file, pos, tok, stmt_start, last_class_kw, CASE WHEN tok = '{{' THEN nd ELSE nd + 1 END AS lvl
       FROM jw WHERE tok IN ('{{', '}}')),
bp AS (SELECT *, lead(tok) OVER w AS c_tok, lead(pos) OVER w AS c_pos
       FROM br WINDOW w AS (PARTITION BY review_id, file, lvl ORDER BY pos)),
cls AS (SELECT review_id, file, pos AS c_open, c_pos AS c_close, lvl AS c_lvl FROM bp
        WHERE tok = '{{' AND c_tok = '}}' AND last_class_kw > stmt_start),
cand AS (SELECT jw.* FROM jw WHERE kind = 'id' AND n1 IN ('=', ';', ',') AND angle = 0 AND nd = bd
           AND ({typeish('p1', 'p2', 'p3')} OR coalesce(p1 = ',', false))),
fl AS (SELECT c.review_id, c.file, k.c_open, c.pos AS f_pos, c.tok AS f_name, c.stmt_start
       FROM cand c JOIN cls k ON k.review_id = c.review_id AND k.file = c.file
        AND c.pos > k.c_open AND c.pos < k.c_close AND c.bd = k.c_lvl)
SELECT f.review_id, f.file, f.c_open, f.f_name,
       coalesce(string_agg(t.tok, '' ORDER BY t.pos) FILTER (WHERE t.tok NOT IN {_in(TK.MODIFIERS)} AND t.tok <> '@'
                AND NOT coalesce(t.p1 = '@', false)), '') AS type_text,
       coalesce(bool_or(t.tok = 'final'), false) AS is_final
FROM fl f JOIN jw t ON t.review_id = f.review_id AND t.file = f.file AND t.pos > f.stmt_start AND t.pos < f.f_pos
GROUP BY f.review_id, f.file, f.c_open, f.f_pos, f.f_name"""
    gold = f"WITH {java_golden_cte()}"
    for key in JR.JAVA_RULES:
        steps = ", path_lines" if key in ("j1_resource_leak", "j2_null_deref") else ""
        out[key] = gold + (f" SELECT review_id, rule_id, severity, file, line, code_snippet, message{steps} FROM jg "
                           f"WHERE qkey = {q(key)}")
    return out


def all_findings_select() -> str:
    """Line findings (needs code_ctes) UNION ALL Java goldens (needs jg)."""
    return (line_findings_select() + "\nUNION ALL\nSELECT review_id, rule_id, severity, file, line, code_snippet, "
            "message FROM jg")


def findings_with_steps_select() -> str:
    """All findings with the lines of their dataflow path (null without one)."""
    return (f"SELECT *, CAST(NULL AS INTEGER[]) AS path_lines FROM ({line_findings_select()}) x\nUNION ALL\n"
            "SELECT review_id, rule_id, severity, file, line, code_snippet, message, path_lines FROM jg")


def w4_sql() -> dict[str, str]:
    """W4 in batch form: triggered PRs -> their review's findings (line + Java),
    scoped to the changed lines of the diff, enriched."""
    pre = ("WITH " + code_ctes() + ", " + java_golden_cte() + ", " + webhooks_sql() + ", " + intake_sql() + ", "
           + FX.DIFF_EXPECTED_SQL + f", af AS ({findings_with_steps_select()}), "
           "sc AS (SELECT * FROM af WHERE EXISTS (SELECT 1 FROM changed c WHERE c.review_id = af.review_id "
           "AND c.file = af.file AND (c.line = af.line OR list_contains(af.path_lines, c.line)))), " + enriched_sql("sc"))
    trig = """,
trig AS (SELECT DISTINCT repo_name, pr_number, commit_sha, CAST(pr_number // 100 AS BIGINT) AS review_id
         FROM intake WHERE triggered)"""
    return {"w4_continuous_review": pre + trig + """
SELECT t.repo_name, t.pr_number, t.commit_sha, t.review_id, ef.rule_id, ef.severity, ef.file, ef.line,
       ef.code_snippet, ef.message, ef.priority_score
FROM trig t JOIN ef ON ef.review_id = t.review_id""", "w4_reviews": pre + trig + """,
nf AS (SELECT review_id, count(*) AS n FROM cf GROUP BY 1), ne AS (SELECT review_id, count(*) AS n FROM ef GROUP BY 1)
SELECT t.*, CASE WHEN nf.n IS NULL THEN 'NO_CODE_FILES' ELSE 'SUCCESS' END AS status,
       coalesce(nf.n, 0) AS file_count, coalesce(ne.n, 0) AS finding_count
FROM trig t LEFT JOIN nf USING (review_id) LEFT JOIN ne USING (review_id)""", "w4_files": pre + trig + """
SELECT t.*, cf.file FROM trig t JOIN cf USING (review_id)"""}
