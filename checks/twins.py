"""The same queries as DuckDB SQL over the same tables.

Written independently of the library: DuckDB matches with RE2, so it takes the rule patterns as
they stand in the rule file.  Only the planted lines' pieces and paths are shared.
"""

from __future__ import annotations

import tomllib
from pathlib import Path

import keysift.rules
from checks.catalog import COMPOSITE, KEYLESS, REJECTED, _allowed_commits
from checks.corpus import ALPHABETS, MARKER, PATH_KINDS, PATHS, PLANT_KINDS, PLANTS

BUILTIN = tomllib.loads(Path(keysift.rules.__file__).with_name("builtin.toml").read_text(encoding="utf-8"))
TOKENS = {"rules": [{"id": "hex-token", "description": "Hex token", "severity": "low", "entropy": 2.0,
                     "keywords": ["token"], "tags": ["token"],
                     "regex": r'(?i)\btoken\s*=\s*(?:"|&quot;)[0-9a-f]{40}(?:"|&quot;)'}]}
NL = "chr(10)"
# Written out here, so that a slip in the library's lists shows.
SKIPPED_EXTENSIONS = (".jpg .jpeg .png .gif .pdf .doc .docx .xls .xlsx .zip .tar .gz .rar .exe .dll .so .dylib .ttf .woff .woff2 "
                      ".eot .mp3 .mp4 .avi .mov").split()
SKIPPED_ENDINGS = "package-lock.json yarn.lock Cargo.lock .min.js .min.css".split()
SKIPPED_IN_IMAGES = ".exe .dll .so .dylib .bin .o .a .jpg .jpeg .png .gif .pdf .zip .tar .gz".split()
SKIPPED_IN_COMMITS = "jpg jpeg png gif pdf doc docx xls xlsx zip tar gz exe dll so dylib".split()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ors(parts) -> str:
    parts = list(parts)
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


# -- planted texts ---------------------------------------------------------------------------

def plant(seed: str) -> str:
    digest = f"sha256(CAST({seed} AS VARCHAR))"

    def piece(p) -> str:
        if isinstance(p, str):
            return lit(p)
        names = ALPHABETS[p[0]]
        token = f"translate({digest}, '{names[0]}', '{names[1]}')" if names else digest
        return f"substr({token}, {p[1]}, {p[2]})"

    whens = " ".join(f"WHEN {k} THEN " + " || ".join(map(piece, pieces)) for k, pieces in enumerate(PLANTS))
    return f"(CASE ({seed}) % {PLANT_KINDS} {whens} ELSE '' END)"


def path(seed: str) -> str:
    name = f"CAST({seed} AS VARCHAR)"
    whens = " ".join(f"WHEN {k} THEN {lit(a)} || {name} || {lit(b)}" for k, a, b in PATHS)
    return (f"(CASE ({seed}) % {PATH_KINDS} {whens} "
            f"ELSE 'src/mod' || CAST(({seed}) % {PATH_KINDS} AS VARCHAR) || '/file_' || {name} || '.ts' END)")


DOCS = f"SELECT doc_id, {path('doc_id')} AS path, text || {plant('doc_id')} AS content FROM documents"
CHAT = ("SELECT 'chat/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt' AS path, "
        f"text || {plant('conv_id * 100 + turn')} AS content FROM conversations")
PAGES = "SELECT 'page/' || CAST(page_id AS VARCHAR) || '.html' AS path, html AS content FROM pages"
FILES = f"""SELECT doc_id, path, CASE doc_id % 23 WHEN 0 THEN content || chr(0)
    WHEN 1 THEN repeat(chr(1), 400) || content ELSE content END AS content FROM ({DOCS})"""
COMMITS = f"""SELECT substr(sha256('commit-' || CAST(step AS VARCHAR) || '-' || CAST(doc_id % 4 AS VARCHAR)), 1, 40)
      AS commit, step * 10 + doc_id % 4 AS commit_seq, {path('doc_id')} AS path, step, doc_id,
    CASE WHEN step = 3 AND doc_id % 5 = 0 THEN 'moved' || chr(10) ELSE '' END || text ||
    CASE WHEN step = 1 OR (step = 3 AND doc_id % 7 = 0) THEN '' ELSE {plant('doc_id')} END AS content
  FROM documents, (VALUES (1), (2), (3)) AS s(step)"""


# -- scanning ----------------------------------------------------------------------------------

def with_defaults(config: dict) -> list[dict]:
    return [dict(r, severity=r.get("severity") or "medium", entropy=r.get("entropy") or 3.0,
                 description=r.get("description", ""), tags=r.get("tags", []), keywords=r.get("keywords", []))
            for r in config["rules"]]


def firing(config: dict) -> list[dict]:
    rules = with_defaults(config)
    return [r for r in rules if r["keywords"]] if any(r["keywords"] for r in rules) else rules


def rule_rows(config: dict) -> str:
    rows = ", ".join(f"({i}, {lit(r['id'])}, {lit(r['description'])}, {lit(r['severity'])}, "
                     f"{lit(','.join(r['tags']))}, CAST({r['entropy']} AS DOUBLE), {lit(','.join(r['keywords']))})"
                     for i, r in enumerate(with_defaults(config)))
    return (f"rules(rule_no, rule_id, description, severity, tags, threshold, keywords) AS (VALUES {rows})")


def entropy(s: str) -> str:
    n = f"octet_length(encode({s}))"
    share = f"((length({s}) - length(replace({s}, c, ''))) / CAST({n} AS DOUBLE))"
    bits = (f"list_sum(list_transform(list_distinct(string_split({s}, '')), "
            f"lambda c: -{share} * log2({share})))")
    penalty = f"CASE WHEN {is_hex(s)} AND {sequential(s)} THEN 1.2 / log2(CAST({n} AS DOUBLE)) ELSE 0 END"
    factor = f"CASE WHEN {one_case(s)} THEN 0.8 ELSE 1.0 END"
    return f"(CASE WHEN {s} = '' THEN 0.0 WHEN {n} = 1 THEN ({single(s)}) ELSE ({bits} - {penalty}) * {factor} END)"


def single(s: str) -> str:
    """One byte: no entropy, and minus infinity (here NULL) for a hex digit."""
    return f"CASE WHEN {is_hex(s)} THEN NULL ELSE 0.0 END"


def is_hex(s: str) -> str:
    return f"regexp_full_match({s}, '[0-9a-fA-F]*')"


def one_case(s: str) -> str:
    return f"(regexp_matches({s}, '[a-z]') <> regexp_matches({s}, '[A-Z]'))"


def sequential(s: str) -> str:
    repeated = f"({s} <> '' AND octet_length(encode({s})) = length({s}) AND replace({s}, substr({s}, 1, 1), '') = '')"
    integer = f"(regexp_full_match({s}, '[+-]?[0-9]+') AND TRY_CAST({s} AS BIGINT) IS NOT NULL)"
    ladder = ors(
        f"(length({s}) >= 16 AND len(list_filter(range(1, 17), "
        f"lambda i: lower(substr({s}, i, 1)) = substr('{ladder}', i, 1))) > 12.8)"
        for ladder in ("0123456789abcdef", "abcdef0123456789"))
    return f"({repeated} OR {integer} OR ({is_hex(s)} AND length({s}) >= 10 AND regexp_matches({s}, '[a-f]') AND {ladder}))"


def stopword(s: str, word: str) -> str:
    at = f"strpos(lower({s}), '{word}')"
    before, after = (f"regexp_matches(substr(lower({s}), {at} {off}, 1), '[a-z0-9]')"
                     for off in ("- 1", f"+ {len(word)}"))
    return f"({at} > 0 AND ({at} = 1 OR NOT {before}) AND NOT {after})"


def path_allowed(p: str, config: dict = BUILTIN) -> str:
    return ors(f"regexp_matches({p}, {lit(x)})" for a in config.get("allowlist", []) for x in a.get("paths", []))


def globally_allowed(s: str, config: dict = BUILTIN) -> str:
    lists = config.get("allowlist", [])
    return ors([f"regexp_matches({s}, {lit(x)})" for a in lists for x in a.get("regexes", [])]
               + [stopword(s, w) for a in lists for w in a.get("stopwords", [])])


def rule_allowed(config: dict = BUILTIN) -> str:
    return ors(f"(rule_id = {lit(r['id'])} AND regexp_matches(match, {lit(x)}))"
               for r in config["rules"] for a in r.get("allowlist", [])
               for x in a.get("regexes", []) + a.get("paths", []))


def inline_allowed(line: str) -> str:
    forms = (f"#\\s*{MARKER}", f"//\\s*{MARKER}", f"/\\*\\s*{MARKER}\\s*\\*/",
             f"\\{{\\{{\\s*/*\\s*{MARKER}\\s*\\*/\\s*\\}}\\}}", f"<!--\\s*{MARKER}\\s*-->",
             f"\\{{%\\s*comment\\s%\\}}{MARKER}")
    return ors(f"regexp_matches({line}, {lit('(?i)' + f)})" for f in forms)


def matches(texts: str, config: dict = BUILTIN, keep: str = "doc_id", extra: str = "") -> str:
    """CTEs ending in ``located``: one row per raw match, with ``keep`` columns of ``texts``.

    ``texts`` selects at least path and content.
    """
    every = firing(config)
    number = {r["id"]: i for i, r in enumerate(config["rules"])}
    columns = f"{keep}, " if keep else ""
    keyword = lambda r: ors(f"contains(low, {lit(k.lower())})" for k in r["keywords"]) if r["keywords"] else "TRUE"
    raw = " UNION ALL ".join(
        f"SELECT tid, {number[r['id']]} AS rule_no, regexp_extract_all(content, {lit(r['regex'])}) AS ms, "
        f"string_split_regex(content, {lit(r['regex'])}) AS gs FROM numbered WHERE {keyword(r)}" for r in every)
    return f"""{rule_rows(config)},
texts AS MATERIALIZED ({texts}),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS tid, *, lower(content) AS low FROM texts),
raw AS MATERIALIZED (SELECT * FROM ({raw}) WHERE len(ms) > 0),
hits AS (SELECT tid, rule_no, ms, gs, unnest(range(1, len(ms) + 1)) AS k FROM raw),
placed AS (SELECT tid, rule_no, ms[k] AS match,
    CAST(coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM hits),
cut AS (SELECT p.*, {columns}path, content, substr(content, 1, start) AS prefix,
    substr(content, 1, start + length(match) - 1) AS upto, string_split(content, {NL}) AS lines
  FROM placed p JOIN numbered USING (tid)),
located AS MATERIALIZED (SELECT *, start + length(match) AS "end",
    length(prefix) - length(replace(prefix, {NL}, '')) + 1 AS line,
    length(prefix) - strpos_last AS "column",
    length(upto) - length(replace(upto, {NL}, '')) + 1 AS last_line
  FROM (SELECT *, length(prefix) - length(string_split(prefix, {NL})[-1]) - 1 AS strpos_last FROM cut)
  JOIN rules USING (rule_no)){extra}"""


def findings(texts: str, config: dict = BUILTIN, keep: str = "", gate_path: bool = True) -> str:
    """CTEs ending in ``findings``."""
    gate = f"WHERE NOT {path_allowed('path', config)}" if gate_path else ""
    scoped = f"SELECT * FROM ({texts}) {gate}"
    columns = f"{keep}, " if keep else ""
    return matches(scoped, config, keep) + f""",
scored AS (SELECT *, {entropy('match')} AS h FROM located),
findings AS MATERIALIZED (SELECT {columns}rule_id, description, match, path AS file, line, "column", severity,
    tags, round(h, 6) AS entropy,
    substr(sha256(rule_id || path || CAST(line AS VARCHAR) || ':' || CAST("column" AS VARCHAR) || match), 1, 32)
      AS fingerprint,
    array_to_string(lines[greatest(line - 2, 1):least(last_line + 2, len(lines))], {NL}) AS context
  FROM scored WHERE h >= threshold AND NOT {rule_allowed(config)} AND NOT {globally_allowed('match', config)}
    AND NOT {inline_allowed('lines[line]')})"""


PLAIN = 'rule_id, description, match, file, line, "column", severity, tags, entropy, fingerprint, context'


def on_findings(select: str, texts: str = DOCS, **options) -> str:
    return f"WITH {findings(texts, **options)} {select}"


def on_matches(select: str, **options) -> str:
    return f"WITH {matches(DOCS, **options)} {select}"


# -- snapshots, responses ------------------------------------------------------------------------

def old_new(select: str) -> str:
    """CTEs ``old`` and ``new``: findings of the second and third snapshot."""
    texts = f"SELECT * FROM ({COMMITS}) WHERE step > 1"
    return (f"WITH {findings(texts, keep='step')}, old AS (SELECT DISTINCT * FROM findings WHERE step = 2), "
            f"new AS (SELECT DISTINCT * FROM findings WHERE step = 3) {select}")


VERIFIABLE = ("rule_id IN ('github-pat', 'github-fine-grained-pat', 'github-oauth', 'github-app-token', "
              "'slack-bot-token', 'slack-user-token', 'stripe-live-secret', 'stripe-test-secret', "
              "'stripe-restricted-live', 'openai-api-key', 'anthropic-api-key')")


def responses(source: str) -> str:
    """CTE ``judged(rule_id, match, status, account, message, kind, error)``, one per secret of ``source``."""
    return f"""answers AS (SELECT DISTINCT rule_id, match, substr(sha256(match), 1, 1) AS a,
    substr(sha256(match), 2, 1) AS b FROM {source}),
coded AS (SELECT *, CASE WHEN a <= '7' THEN 200 WHEN a <= 'a' THEN 401 WHEN a <= 'c' THEN 403 ELSE 500 END AS code,
    CASE WHEN a = 'f' THEN 'timeout' ELSE '' END AS broken FROM answers),
judged AS (SELECT rule_id, match,
  CASE WHEN NOT {VERIFIABLE} THEN 'unknown' WHEN broken <> '' THEN 'error'
    WHEN rule_id LIKE 'github%' THEN CASE code WHEN 200 THEN 'valid' WHEN 401 THEN 'invalid' WHEN 403 THEN 'revoked'
      ELSE 'error' END
    WHEN rule_id LIKE 'slack%' THEN CASE WHEN b <= '9' THEN 'valid' WHEN b <= 'd' THEN 'invalid' ELSE 'error' END
    WHEN rule_id LIKE 'openai%' THEN CASE code WHEN 200 THEN 'valid' WHEN 401 THEN 'invalid' ELSE 'error' END
    ELSE CASE code WHEN 200 THEN 'valid' WHEN 401 THEN 'invalid' ELSE 'unknown' END END AS status,
  CASE WHEN NOT {VERIFIABLE} OR broken <> '' THEN ''
    WHEN rule_id LIKE 'github%' AND code = 200 AND b <> '0' THEN 'user' || b
    WHEN rule_id LIKE 'slack%' AND b <= '9' THEN 'team' || b || '/bot' ELSE '' END AS account,
  CASE WHEN NOT {VERIFIABLE} THEN 'Verification not available for rule: ' || rule_id WHEN broken <> '' THEN ''
    WHEN rule_id LIKE 'github%' THEN CASE code
      WHEN 200 THEN CASE WHEN b = '0' THEN 'GitHub token is valid' ELSE 'GitHub token valid for user: user' || b END
      WHEN 401 THEN 'GitHub token is invalid or expired'
      WHEN 403 THEN 'GitHub token has been revoked or rate limited'
      ELSE 'Unexpected response: ' || CAST(code AS VARCHAR) END
    WHEN rule_id LIKE 'slack%' THEN CASE
      WHEN b <= '9' THEN 'Slack token valid for team: team' || b || ', user: bot'
      WHEN b <= 'd' THEN 'Slack token invalid: invalid_auth' ELSE '' END
    WHEN rule_id LIKE 'stripe%' THEN CASE code
      WHEN 200 THEN 'Stripe ' || CASE substr(match, 1, 8) WHEN 'sk_live_' THEN 'live' WHEN 'sk_test_' THEN 'test'
        ELSE 'restricted_live' END || ' key is valid'
      WHEN 401 THEN 'Stripe key is invalid or revoked'
      ELSE 'Unexpected response from Stripe: ' || CAST(code AS VARCHAR) END
    WHEN rule_id LIKE 'openai%' THEN CASE code
      WHEN 200 THEN CASE WHEN match LIKE 'sk-proj-%' THEN 'OpenAI project API key is valid'
        ELSE 'OpenAI API key is valid' END
      WHEN 401 THEN 'OpenAI API key is invalid' ELSE 'Unexpected response: ' || CAST(code AS VARCHAR) END
    ELSE CASE code WHEN 200 THEN 'Anthropic API key is valid' WHEN 401 THEN 'Anthropic API key is invalid'
      ELSE 'Unexpected response from Anthropic: ' || CAST(code AS VARCHAR) END END AS message,
  CASE WHEN NOT {VERIFIABLE} OR broken <> '' OR code <> 200 THEN ''
    WHEN rule_id LIKE 'stripe%' THEN CASE substr(match, 1, 8) WHEN 'sk_live_' THEN 'live' WHEN 'sk_test_' THEN 'test'
      ELSE 'restricted_live' END
    WHEN rule_id LIKE 'openai%' THEN CASE WHEN match LIKE 'sk-proj-%' THEN 'project' ELSE 'standard' END
    ELSE '' END AS kind,
  CASE WHEN NOT {VERIFIABLE} THEN '' WHEN broken <> '' THEN broken
    WHEN rule_id LIKE 'slack%' AND b > 'd' THEN 'unreadable response' ELSE '' END AS error
  FROM coded)"""


VERIFIED = f"""SELECT f.*, CASE WHEN NOT {VERIFIABLE.replace('rule_id', 'f.rule_id')} THEN FALSE
    ELSE j.status = 'valid' END AS verified,
  CASE WHEN {VERIFIABLE.replace('rule_id', 'f.rule_id')} THEN j.account ELSE '' END AS account,
  CASE WHEN {VERIFIABLE.replace('rule_id', 'f.rule_id')} AND j.status IN ('valid', 'invalid', 'revoked', 'error')
    THEN j.message ELSE '' END AS message,
  CASE WHEN {VERIFIABLE.replace('rule_id', 'f.rule_id')} THEN j.status END AS verification_status
  FROM {{source}} f LEFT JOIN judged j ON f.rule_id = j.rule_id AND f.match = j.match"""


# -- small pieces -----------------------------------------------------------------------------------

EXTENSION = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def file_gate(limit: int) -> str:
    endings = ors(f"suffix(path, {lit(e)})" for e in SKIPPED_ENDINGS)
    return (f"octet_length(encode(content)) <= {limit} AND NOT regexp_matches(path, '(^|/)\\.git/') "
            f"AND {EXTENSION} NOT IN {in_list(SKIPPED_EXTENSIONS)} AND NOT {endings}")


# At most 1024 bytes from the front: control characters are single bytes, so they are counted
# among the characters whose own bytes all lie in front of the cut or start before it.
CONTROL = """list_sum(list_transform(range(1, 1025), lambda i: CASE WHEN strpos(
    '00 01 02 03 04 05 06 07 08 0B 0C 0E 0F 10 11 12 13 14 15 16 17 18 19 1A 1B 1C 1D 1E 1F',
    substr(bytes, 2 * i - 1, 2)) > 0 AND 2 * i <= length(bytes) THEN 1 ELSE 0 END))"""
BINARY = f"""SELECT doc_id, path, content, has_nul, coalesce(control > 0.3 * least(1024, length(bytes) // 2), FALSE)
    AS control_heavy FROM (SELECT *, {CONTROL} AS control FROM (SELECT doc_id, path, content,
    contains(content, chr(0)) AS has_nul, substr(hex(encode(content)), 1, 2048) AS bytes FROM ({FILES})))"""
TEXT_FILES = f"""SELECT doc_id, path, content FROM ({BINARY})
    WHERE {file_gate(100 * 1024 * 1024)} AND NOT has_nul AND NOT control_heavy"""
GOOD_IMAGE = "doc_id // 20 % 11 NOT IN (4, 6)"
BAD_LAYER = "doc_id // 10 % 7 IN (3, 5)"
IMAGE_FILES = f"SELECT * FROM ({FILES}) WHERE {EXTENSION} NOT IN {in_list(SKIPPED_IN_IMAGES)}"
FILES_SCANNED = (f"SELECT count(*) AS files_scanned FROM ({FILES}) WHERE {file_gate(100 * 1024 * 1024)} "
                 f"AND NOT {path_allowed('path')}")

MADE = """SELECT unnest([d, upper(d), translate(d, 'abcdef', '012345'), substr(translate(d, 'abcdef', '012345'), 1, 18),
    '0123456789abcdef' || substr(d, 1, 8), 'ABCDEF012345678' || substr(d, 1, 2), repeat(substr(d, 1, 1), 12),
    substr(d, 1, 1), '', substr(d, 1, 6) || '==' || 'é' || chr(128512),
    translate(substr(d, 1, 10), 'abc', 'XYZ') || '==']) AS s
  FROM (SELECT sha256(CAST(doc_id AS VARCHAR)) AS d FROM documents)"""


def on_strings(select: str) -> str:
    return f"WITH {matches(DOCS)}, strings AS (SELECT match AS s FROM located UNION ALL {MADE}) {select}"


IS_BASE64 = "(regexp_full_match(s, '[A-Za-z0-9+/]+={0,2}') AND octet_length(encode(s)) % 4 = 0)"
HAS_SYMBOL = "regexp_matches(s, '[^0-9A-Za-z]')"
KEEP = "left({0}, 4) || '***' || right({0}, 4)"
BYTES = "octet_length(encode({0}))"
REDACTED = f"CASE WHEN {BYTES} > 8 THEN {KEEP} ELSE '***' END"
PROVIDER = """CASE WHEN octet_length(encode(s)) <= 4 THEN '' WHEN substr(s, 1, 4) IN ('ghp_', 'gho_', 'ghs_') THEN 'github'
  WHEN substr(s, 1, 4) IN ('xoxb', 'xoxp') THEN 'slack'
  WHEN octet_length(encode(s)) > 8 AND substr(s, 1, 8) IN ('sk_test_', 'sk_live_') THEN 'stripe'{extra}
  WHEN substr(s, 1, 3) = 'sk-' THEN 'openai' ELSE '' END"""
LEVEL = "CASE WHEN lower(severity) IN ('critical', 'high') THEN 'error' WHEN lower(severity) = 'low' THEN 'note' ELSE 'warning' END"
SCORE = "CASE lower(severity) WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'low' THEN '4.0' ELSE '6.5' END"
TOTALS = "SELECT count(*) AS findings FROM findings"
SUMMARY = "'Found ' || findings || ' secrets' || CASE WHEN files_scanned > 0 THEN ', scanned ' || files_scanned || ' files' ELSE '' END"
STAMP = "epoch(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 1800))"


def composite() -> str:
    rules = {"rules": [dict(r, required=[]) for r in COMPOSITE["rules"]] + [
        dict(COMPOSITE["rules"][0], id="companion", regex=COMPOSITE["rules"][0]["required"][0]["regex"])]}
    near = ("EXISTS (SELECT 1 FROM located c WHERE c.tid = f.tid AND c.rule_id = '{0}' "
            "AND abs(c.line - f.line) <= {1})")
    return (f"WITH {findings(DOCS, rules, keep='tid')} SELECT {PLAIN} FROM findings f WHERE rule_id = 'generic-secret' "
            f"OR (rule_id = 'github-pat' AND {near.format('companion', 1)}) "
            f"OR (rule_id = 'stripe-live-secret' AND {near.format('github-pat', 0)})")


COMPARED = """compared AS (SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.fingerprint, o.fingerprint)
    AS fingerprint, coalesce(n.match, o.match) AS match, coalesce(n.file, o.file) AS file,
    coalesce(n.line, o.line) AS line, coalesce(n.severity, o.severity) AS severity, n.description AS description,
    CASE WHEN n.fingerprint IS NULL THEN 'resolved' WHEN o.fingerprint IS NULL THEN 'new' ELSE 'existing' END AS status
  FROM new n FULL OUTER JOIN old o ON n.fingerprint = o.fingerprint)"""


def compared(select: str) -> str:
    return old_new(", " + COMPARED + " " + select).replace("  , compared", ", compared")


def stable(alias: str) -> str:
    head = f"decode(encode({alias}.match)[1:8])"
    return f"substr(sha256({alias}.rule_id || {alias}.file || {head}), 1, 32)"


def declared() -> str:
    rows = ", ".join(f"({lit(r['id'])}, {lit(r.get('severity', ''))}, CAST({r.get('entropy', 0)} AS DOUBLE))"
                     for r in KEYLESS["rules"])
    return f"declared(rule_id, declared_severity, declared_entropy) AS (VALUES {rows})"


def twins() -> dict[str, str]:
    base6 = "rule_id, fingerprint, match, file, line, severity"
    history = findings(COMMITS, keep="commit")
    in_range = findings(f"SELECT * FROM ({COMMITS}) WHERE commit_seq > 13 AND commit_seq <= 32", keep="commit")
    changed = f"""SELECT n.path, n.content FROM ({COMMITS}) n JOIN ({COMMITS}) o ON n.path = o.path
        WHERE n.step = 3 AND o.step = 2 AND n.content <> o.content"""
    layers = f"""SELECT 'image_' || CAST(doc_id // 20 AS VARCHAR) AS image,
        CAST(doc_id // 10 AS VARCHAR) || '/layer.tar' AS layer, path, content FROM ({IMAGE_FILES.replace(FILES, DOCS)})
        WHERE {GOOD_IMAGE} AND NOT {BAD_LAYER}"""
    based = f""" UNION ALL SELECT 'image_' || CAST(number AS VARCHAR), 'base' || CAST(number % 4 AS VARCHAR) || '/layer.tar', path, content
        FROM (SELECT DISTINCT doc_id // 20 AS number FROM documents) i JOIN ({IMAGE_FILES.replace(FILES, DOCS)}) f ON f.doc_id // 10 = number % 4
        WHERE number % 11 NOT IN (4, 6)"""
    distinct = f"SELECT DISTINCT {PLAIN} FROM findings"
    hot = f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'hot/all.txt' ELSE path END AS path, content FROM ({DOCS})"
    kept_commits = " OR ".join(f"starts_with(commit, {lit(c)})" for c in _allowed_commits())
    hours = f"CAST(floor({STAMP} / 3600) * 3600 AS BIGINT)"
    return {
        "scan_table": on_findings(distinct),
        "stream_scan": on_findings(f"SELECT {PLAIN} FROM findings"),
        "scan_files": on_findings(distinct, TEXT_FILES),
        "scan_image_dir": on_findings(f"SELECT {PLAIN} FROM findings", IMAGE_FILES),
        "scan_history": f"WITH {history} SELECT {PLAIN}, commit FROM findings",
        "scan_commit_range": f"WITH {in_range} SELECT {PLAIN}, commit FROM findings",
        "scan_history_incremental": f"WITH {history} SELECT {PLAIN}, commit FROM findings",
        "commit_prefixes": f"""SELECT commit, count(*) AS files FROM ({COMMITS}) WHERE NOT ({kept_commits}) GROUP BY commit""",
        "changed_files": f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
            ELSE 'modified' END AS change FROM (SELECT * FROM ({COMMITS}) WHERE step = 3) n
            FULL OUTER JOIN (SELECT * FROM ({COMMITS}) WHERE step = 2) o ON n.path = o.path
            WHERE n.content IS DISTINCT FROM o.content""",
        "scan_changed_manifest": on_findings(f"SELECT {PLAIN} FROM findings", changed),
        "commits_scanned": f"SELECT count(DISTINCT commit) AS commits_scanned FROM ({COMMITS})",
        "commit_allowlist": f"""SELECT commit, count(*) AS files FROM ({COMMITS})
            WHERE NOT ({kept_commits}) GROUP BY commit""",
        "scan_changed": on_findings(f"SELECT {PLAIN} FROM findings", changed),
        "scan_archives": f"""WITH {findings(layers, keep='image, layer')} SELECT {PLAIN.replace(
            'tags', "tags || ',docker-layer' AS tags")}, image, layer FROM findings""",
        "scan_archives_distinct": f"""WITH {findings(layers + based, keep='image, layer')} SELECT {PLAIN.replace(
            'tags', "tags || ',docker-layer' AS tags")}, image, layer FROM findings""",
        "layer_reuse": f"""SELECT min(layer) AS layer, count(*) AS places, count(DISTINCT image) AS images FROM (
            SELECT DISTINCT doc_id // 20 AS image, CAST(doc_id // 10 AS VARCHAR) || '/layer.tar' AS layer,
              CASE WHEN doc_id // 10 % 7 = 3 THEN 'broken' WHEN doc_id // 10 IN (0, 2) THEN 'base' ELSE '' END
              || CASE WHEN doc_id // 10 % 7 = 3 THEN '' ELSE CAST(doc_id // 10 AS VARCHAR) END AS digest FROM documents WHERE {GOOD_IMAGE}
            UNION ALL SELECT DISTINCT doc_id // 20, 'base' || CAST(doc_id // 20 % 4 AS VARCHAR) || '/layer.tar',
              'base' || CAST(doc_id // 20 % 4 AS VARCHAR) FROM documents WHERE {GOOD_IMAGE}) GROUP BY digest""",
        "archive_metrics": f"""SELECT 'image_' || CAST(doc_id // 20 AS VARCHAR) AS image,
            count(DISTINCT CASE WHEN {GOOD_IMAGE} THEN doc_id // 10 END) AS layers_scanned,
            count(*) FILTER ({GOOD_IMAGE} AND NOT {BAD_LAYER}) AS files,
            CASE WHEN doc_id // 20 % 11 = 4 THEN 1 WHEN doc_id // 20 % 11 = 6 THEN 0
              ELSE count(DISTINCT CASE WHEN {BAD_LAYER} THEN doc_id // 10 END) + CAST(doc_id // 20 % 5 = 2 AS INTEGER) END AS errors
            FROM documents GROUP BY doc_id // 20""",
        "archive_errors": f"""SELECT 'image_' || CAST(doc_id // 20 AS VARCHAR) AS image, CASE WHEN {GOOD_IMAGE} THEN
              CAST(doc_id // 10 AS VARCHAR) || '/layer.tar' END AS layer, 'unreadable' AS kind, 1 AS errors
            FROM documents WHERE ({GOOD_IMAGE} AND {BAD_LAYER}) OR doc_id // 20 % 11 = 4 GROUP BY ALL
            UNION ALL SELECT DISTINCT 'image_' || CAST(doc_id // 20 AS VARCHAR), 'large.tar', 'large', 1
            FROM documents WHERE {GOOD_IMAGE} AND doc_id // 20 % 5 = 2""",
        "skipped_files": f"""SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS length, CASE
            WHEN octet_length(encode(content)) > 20000 THEN 'size' WHEN regexp_matches(path, '(^|/)\\.git/') THEN 'git folder'
            WHEN NOT ({file_gate(1 << 60)}) THEN 'extension' WHEN {path_allowed('path')} THEN 'path allowlist'
            WHEN has_nul OR control_heavy THEN 'binary' END AS reason FROM ({BINARY}) WHERE reason IS NOT NULL""",
        "scan_tree": on_findings(distinct, TEXT_FILES),
        "scan_union_roots": on_findings(f"SELECT {PLAIN} FROM findings",
                                        f"SELECT path, content FROM ({DOCS}) UNION ALL {CHAT} UNION ALL {PAGES}"),
        "scan_custom_rule": on_findings(f"SELECT {PLAIN} FROM findings",
                                        f"SELECT path, content FROM ({DOCS}) UNION ALL {PAGES}", config=TOKENS),
        "rules_table": f"""WITH {rule_rows(BUILTIN)}, low AS MATERIALIZED (SELECT lower(content) AS low FROM ({DOCS})),
            words AS (SELECT rule_no, lower(unnest(string_split(keywords, ','))) AS word FROM rules WHERE keywords <> ''),
            hit AS (SELECT DISTINCT rule_no, row FROM words,
                (SELECT row_number() OVER () AS row, low FROM low) WHERE contains(low, word))
            SELECT rule_id AS id, description, severity, tags, threshold AS entropy, keywords,
              (SELECT count(*) FROM hit WHERE hit.rule_no = rules.rule_no) AS documents FROM rules""",
        "rule_defaults": f"""WITH {matches(DOCS, KEYLESS)}, {declared()} SELECT rule_id, severity, threshold,
            count(*) AS matches, declared_severity, declared_entropy FROM located JOIN declared USING (rule_id)
            GROUP BY ALL""",
        "gate_files": f"""SELECT doc_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS length
            FROM ({FILES}) WHERE {file_gate(20000)}""",
        "gate_path_allowlist": f"SELECT doc_id, path FROM ({DOCS}) WHERE NOT {path_allowed('path')}",
        "gate_binary": f"""SELECT doc_id, has_nul, control_heavy, has_nul OR control_heavy AS is_binary,
            NOT (has_nul OR control_heavy) AS is_text FROM ({BINARY})""",
        "gate_image_ext": f"SELECT doc_id, path FROM ({IMAGE_FILES})",
        "files_scanned": FILES_SCANNED,
        "candidate_rules": "WITH low AS MATERIALIZED (SELECT doc_id, lower(content) AS low FROM (" + DOCS + ")) "
            + " UNION ALL ".join(
                f"SELECT doc_id, {lit(r['id'])} AS rule_id FROM low WHERE "
                + ors(f"contains(low, {lit(k.lower())})" for k in r["keywords"]) for r in firing(BUILTIN)),
        "rule_matches": on_matches("SELECT doc_id, rule_id, match FROM located"),
        "match_offsets": on_matches('SELECT doc_id, rule_id, start, "end", match FROM located'),
        "match_position": on_matches('SELECT doc_id, rule_id, start, line, "column" FROM located'),
        "match_context": on_matches(f"""SELECT doc_id, rule_id, start,
            array_to_string(lines[greatest(line - 2, 1):least(last_line + 2, len(lines))], {NL}) AS context
            FROM located"""),
        "context_window": on_matches(f"""SELECT doc_id, rule_id, start, line,
            array_to_string(lines[greatest(line - 2, 1):least(line + 2, len(lines))], {NL}) AS context FROM located"""),
        "entropy_gate": on_matches(f"""SELECT doc_id, rule_id, match, round(h, 6) AS entropy, threshold FROM
            (SELECT *, {entropy('match')} AS h FROM located) WHERE h >= threshold"""),
        "rule_allowlist": on_matches(f"SELECT doc_id, rule_id, match, {rule_allowed()} AS allowed FROM located"),
        "global_allowlist": on_matches(
            f"SELECT doc_id, rule_id, match, {globally_allowed('match')} AS allowed FROM located"),
        "stopwords": on_matches(f"""SELECT doc_id, rule_id, match, {stopword('match', 'example')} AS example,
            {stopword('match', 'placeholder')} AS placeholder, {stopword('match', 'a')} AS a FROM located"""),
        "inline_allow": on_matches(
            f"SELECT doc_id, rule_id, match, {inline_allowed('lines[line]')} AS inline_allow FROM located"),
        "scan_no_keywords": on_findings(f"SELECT {PLAIN} FROM findings", config=KEYLESS),
        "composite_rules": composite(),
        "entropy": on_strings(f"SELECT s, round({entropy('s')}, 6) AS entropy FROM strings"),
        "entropy_flags": on_strings(f"""SELECT s, {is_hex('s')} AS is_hex, {sequential('s')} AS sequential,
            {one_case('s')} AS one_case, {IS_BASE64} AS is_base64, NOT regexp_matches(s, '[A-Z]') AS lowercase,
            {HAS_SYMBOL} AS has_symbol FROM strings"""),
        "entropy_penalty": on_strings(f"""SELECT s, round({entropy('s')} * CASE WHEN {is_hex('s')} THEN 0.81 ELSE 1 END
            * CASE WHEN {IS_BASE64} THEN 0.95 ELSE 1 END * CASE WHEN regexp_matches(s, '[A-Z]') THEN 1 ELSE 0.8 END
            * CASE WHEN {HAS_SYMBOL} THEN 1 ELSE 0.85 END, 6) AS entropy FROM strings"""),
        "fingerprint": on_findings('SELECT rule_id, file, line, "column", fingerprint FROM findings'),
        "stable_fingerprint": on_findings(
            f"SELECT rule_id, file, line, {stable('findings')} AS stable_fingerprint FROM findings"),
        "redact": on_strings(f"SELECT s, {REDACTED.format('s')} AS redacted FROM strings"),
        "match_clip": on_strings(f"""SELECT s, CASE WHEN {BYTES.format('s')} > 40 THEN left(s, 20) || '...' ||
            right(s, 20) ELSE s END AS clipped FROM strings"""),
        "detect_provider": on_strings(f"""SELECT s, {PROVIDER.format(extra='')} AS provider, {PROVIDER.format(
            extra=" WHEN starts_with(s, 'sk-ant-api-') THEN 'anthropic'")} AS provider_fixed FROM strings"""),
        "provider_rule": on_strings(f"""SELECT s, CASE p WHEN 'github' THEN 'github-pat' WHEN 'slack' THEN
            CASE WHEN s LIKE 'xoxb%' THEN 'slack-bot-token' ELSE 'slack-user-token' END WHEN 'stripe' THEN
            CASE WHEN starts_with(s, 'sk_live_') THEN 'stripe-live-secret' ELSE 'stripe-test-secret' END
            WHEN 'openai' THEN 'openai-api-key' ELSE p || '-pat' END AS rule_id
            FROM (SELECT s, {PROVIDER.format(extra='')} AS p FROM strings)"""),
        "verifiable": on_findings(f"""SELECT rule_id, count(*) AS findings, {VERIFIABLE} AS verifiable
            FROM findings GROUP BY rule_id"""),
        "dedup": on_findings('SELECT DISTINCT rule_id, file, line, "column", fingerprint FROM findings'),
        "dedup_late": on_findings(distinct),
        "severity_counts": on_findings("SELECT severity, count(*) AS findings FROM findings GROUP BY severity"),
        "file_summary": on_findings("SELECT file, count(*) AS findings, " + ", ".join(
            f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
            + ", min(line) AS first_line, max(line) AS last_line FROM findings GROUP BY file"),
        "severity_filter": on_findings(
            "SELECT rule_id, file, severity, fingerprint FROM findings WHERE severity IN ('critical', 'high')"),
        "report_summary": on_findings(f"""SELECT findings, files_scanned, commits_scanned, {SUMMARY} ||
            ', scanned ' || commits_scanned || ' commits' AS summary FROM ({TOTALS}), ({FILES_SCANNED}),
            (SELECT count(DISTINCT commit) AS commits_scanned FROM ({COMMITS}))"""),
        "commit_gate": on_findings(
            "SELECT count(*) AS findings, count(*) > 0 AS failed FROM findings WHERE severity IN ('critical', 'high')",
            f"SELECT * FROM ({DOCS}) WHERE NOT regexp_matches(path, '\\.({'|'.join(SKIPPED_IN_COMMITS)})$')"),
        "baseline_rows": on_findings(f"SELECT {base6} FROM findings"),
        "baseline_new": old_new(f"SELECT {base6} FROM new WHERE fingerprint NOT IN (SELECT fingerprint FROM old)"),
        "baseline_existing": old_new(f"SELECT {base6} FROM new WHERE fingerprint IN (SELECT fingerprint FROM old)"),
        "baseline_resolved": old_new(f"SELECT {base6} FROM old WHERE fingerprint NOT IN (SELECT fingerprint FROM new)"),
        "baseline_compare": compared(f"SELECT {base6}, description, status FROM compared"),
        "baseline_compare_stable": old_new(f""", o AS (SELECT DISTINCT file, rule_id, (rule_id, file, match) AS key FROM old),
            n AS (SELECT file, rule_id, (rule_id, file, match) AS key FROM new)
            SELECT file, rule_id, CASE WHEN key IN (SELECT key FROM o) THEN 'existing' ELSE 'new' END AS status,
              count(*) AS findings FROM n GROUP BY ALL
            UNION ALL SELECT file, rule_id, 'resolved', count(*) FROM o
              WHERE key NOT IN (SELECT key FROM n) GROUP BY ALL"""),
        "baseline_roundtrip": old_new(f"SELECT {base6} FROM new WHERE fingerprint NOT IN (SELECT fingerprint FROM old)"),
        "baseline_compare_bucketed": compared(f"SELECT {base6}, description, status FROM compared"),
        "baseline_stats": compared("SELECT status, severity, count(*) AS findings FROM compared "
                                   "GROUP BY CUBE (status, severity)"),
        "baseline_totals": compared("SELECT count(*) AS total, " + ", ".join(
            f'count(*) FILTER (status = \'{s}\') AS "{s}"' for s in ("new", "existing", "resolved")) + " FROM compared"),
        "verify_classify": on_findings(f", {responses('findings')} SELECT rule_id, match, status, account, message, "
                                       "kind, error FROM judged"),
        "verify_join": on_findings(f""", {responses('findings')}, v AS ({VERIFIED.format(source='findings')})
            SELECT fingerprint, verified, account, message, verification_status FROM v"""),
        "verify_status_filter": on_findings(f""", {responses('findings')}, v AS ({VERIFIED.format(source='findings')})
            SELECT fingerprint, verified, verification_status FROM v
            WHERE verification_status IS NULL OR verification_status = 'valid'"""),
        "report_json": on_findings(f"""SELECT findings, files_scanned, CAST(0 AS BIGINT) AS commits_scanned,
            {SUMMARY} AS summary, {SUMMARY} AS json_summary FROM ({TOTALS}), ({FILES_SCANNED})"""),
        "sink_jsonl": on_findings('SELECT rule_id, match, file, line, "column", fingerprint, context FROM findings'),
        "findings_by_file": on_findings(f"""SELECT file, rule_id, line, "column", match,
            row_number() OVER (PARTITION BY file ORDER BY line, "column", rule_id, match) AS rank,
            row_number() OVER (ORDER BY encode(file), line, "column", rule_id, match) AS place
            FROM (SELECT DISTINCT file, rule_id, line, "column", match, fingerprint FROM findings)""", hot),
        "report_document": on_findings('SELECT rule_id, match, file, line, "column", severity, fingerprint, context FROM findings', hot),
        "sarif_document": on_findings(f"""SELECT rule_id, {LEVEL} AS level, description || ': ' || match AS message, file, line, "column",
            CASE WHEN {BYTES.format('match')} > 100 THEN left(match, 100) || '...' ELSE match END AS snippet, fingerprint FROM findings""", hot),
        "sink_formats": on_findings("""SELECT unnest(['json', 'jsonl', 'csv', 'sarif', 'text']) AS format, n AS findings
            FROM (SELECT count(*) AS n FROM findings)"""),
        "rejected_rules": "SELECT id, regex, TRUE AS has_reason, documents FROM (VALUES " + ", ".join(
            f"({lit(r['id'])}, {lit(r['regex'])}, {lit(r['keywords'][0])})" for r in REJECTED["rules"][:3]) + f""") r(id, regex, keyword),
            LATERAL (SELECT count(*) AS documents FROM ({DOCS}) WHERE contains(lower(content), keyword))""",
        "csv_rows": on_findings(f"""SELECT rule_id AS "Rule ID", description AS "Description",
            {REDACTED.format('match')} AS "Match", file AS "File", line AS "Line", "column" AS "Column",
            severity AS "Severity", tags AS "Tags", printf('%.2f', entropy) AS "Entropy",
            substr(fingerprint, 1, 16) || '...' AS "Fingerprint", '' AS "Verified" FROM findings"""),
        "listing": on_findings(f"""SELECT file, upper(severity) AS severity, rule_id, line, "column",
            CASE WHEN {BYTES.format('match')} > 40 THEN left(match, 20) || '...' || right(match, 20) ELSE match END
            AS match, description, replace(tags, ',', ', ') AS tags, printf('%.2f', entropy) AS entropy FROM findings"""),
        "sarif_results": on_findings(f"""SELECT rule_id, file, line, "column", {LEVEL} AS level,
            description || ': ' || match AS message, CASE WHEN {BYTES.format('match')} > 100 THEN left(match, 100) ||
            '...' ELSE match END AS snippet, fingerprint, {LEVEL} AS json_level, CAST(line AS VARCHAR) AS json_line
            FROM findings"""),
        "sarif_rules": on_findings(f"""SELECT DISTINCT rule_id, description, {LEVEL} AS level, {SCORE} AS score, tags
            FROM findings"""),
        "stream_report_once": on_findings("SELECT DISTINCT rule_id, file, fingerprint FROM findings"),
        "stream_suppress_known": on_findings(
            "SELECT rule_id, file, fingerprint FROM findings WHERE NOT known",
            f"SELECT *, FALSE AS known FROM ({DOCS}) UNION ALL SELECT doc_id, path, content, TRUE FROM ({COMMITS}) "
            "WHERE step = 3", keep="known") + " AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE known)",
        "findings_by_hour": on_findings(f"""SELECT {hours} AS window_start, {hours} + 3600 AS window_end, severity,
            count(*) AS findings FROM findings GROUP BY ALL""", keep="doc_id"),
        # Part k is cut off at the latest time of the parts before it, less the delay; what is closed by the last watermark is out.
        "stream_window_counts": on_findings(f""", timed AS (SELECT severity, {STAMP} AS ts, {hours} AS hour, doc_id * 4 // (SELECT max(doc_id) + 1 FROM documents)
              + CAST(doc_id % 7 = 3 AS INTEGER) AS part FROM findings),
            marks AS (SELECT p.part, max(t.ts) - 7200 AS mark FROM (SELECT unnest(range(1, 6)) AS part) p JOIN timed t ON t.part < p.part GROUP BY p.part)
            SELECT hour AS window_start, hour + 3600 AS window_end, severity, count(*) AS findings FROM timed LEFT JOIN marks USING (part)
            WHERE hour + 3600 > coalesce(mark, 0) AND hour + 3600 <= (SELECT max(mark) FROM marks) GROUP BY ALL""", keep="doc_id"),
        "findings_by_sliding_hours": on_findings(f"""SELECT w AS window_start, w + 7200 AS window_end, severity,
            count(*) AS findings FROM (SELECT severity, unnest([{hours}, {hours} - 3600]) AS w FROM findings)
            GROUP BY ALL""", keep="doc_id"),
        "after_scan": old_new(f""", left_over AS (SELECT * FROM new WHERE severity IN ('critical', 'high')
            AND fingerprint NOT IN (SELECT fingerprint FROM old)), {responses('new')},
            v AS ({VERIFIED.format(source='left_over')})
            SELECT rule_id, fingerprint, severity, verified, account, verification_status FROM v"""),
    }
