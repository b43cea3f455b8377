"""SQL statements of the registered queries, for a second engine to check.

Each runs on the driver's plain tables.  The views at the top restate
``plans.inputs``; the rest is written from the meaning of each operator rather
than from the Spark code.
"""

from __future__ import annotations

from .. import fixed_values as fv
from . import inputs

ORACLES: dict[str, str] = {}

# Blanks as the SQL engine's regex dialect spells them.
_B = (
    r"[\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _fill(parts: list[str]) -> str:
    return " || ".join(
        f"CAST({p[1:-1]} AS VARCHAR)" if p.startswith("{") and p.endswith("}") else _q(p) for p in parts
    )


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"


# -- views ------------------------------------------------------------------

_FILES = f"""
named AS (
  SELECT *,
    CASE doc_id % 10
      WHEN 0 THEN 'mod_' || doc_id || '.py' WHEN 1 THEN 'test_' || doc_id || '.py'
      WHEN 2 THEN doc_id || '.spec.ts' WHEN 3 THEN 'README_' || doc_id || '.md'
      WHEN 4 THEN 'conf_' || doc_id || '.yaml' WHEN 5 THEN doc_id || 'Test.java'
      WHEN 6 THEN '.hidden_' || doc_id WHEN 7 THEN '__init__.py'
      WHEN 8 THEN 'Dockerfile' ELSE 'app_' || doc_id || '.js' END AS file_name,
    lang || '/' || CASE doc_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' ELSE 'node_modules' END
      || '/d' || (doc_id % 7)
      || CASE WHEN doc_id % 10 IN (7, 8) THEN '/p' || doc_id ELSE '' END AS dir,
    replace(text, chr(10), chr(10) || '# ') AS commented,
    replace(text, chr(10), chr(10) || '// # ') AS slashed
  FROM documents),
files AS (
  SELECT source AS project, dir || '/' || file_name AS rel_path, dir, file_name,
    CASE WHEN doc_id % 10 = 6 OR doc_id % 10 = 8 THEN ''
         ELSE '.' || list_extract(string_split(file_name, '.'), -1) END AS ext,
    CASE WHEN doc_id % 10 IN (0, 1, 7) THEN {_fill(inputs.PYTHON_FILE)}
         WHEN doc_id % 10 IN (2, 5, 9) THEN {_fill(inputs.SLASH_FILE)}
         ELSE text END AS content,
    1700000000000000 + doc_id * 1000000 + n_chars AS mtime_us,
    doc_id, lang, n_chars
  FROM named),
classed AS (
  SELECT *, doc_id % 10 IN (1, 2, 5) AS is_test, doc_id % 10 IN (3, 4, 8) AS is_resource,
    doc_id % 3 = 2 AS below_excluded,
    doc_id % 10 IN (6, 7) AS noise
  FROM files)"""

_LISTED = "ext IN ('.py', '.ts', '.js', '.java')"

# Columns: status and target for both test settings.
_SCANNED = _FILES + f""",
scanned AS (
  SELECT *,
    CASE WHEN NOT noise AND (is_resource OR is_test OR {_LISTED}) THEN 'process' ELSE 'skipped' END AS status,
    CASE WHEN is_test THEN 'test' WHEN is_resource THEN 'resource' ELSE 'module' END AS target,
    CASE WHEN is_test THEN 'skip' WHEN is_resource THEN 'resource' ELSE 'module' END AS strict_target,
    NOT noise AND {_LISTED} AS in_tree
  FROM classed WHERE NOT below_excluded),
written AS (SELECT * FROM scanned WHERE status = 'process')"""

_EDGES = f"""
edges AS (SELECT doc_id, {_fill(inputs.EDGE_TEXT)} AS text FROM documents)"""


# -- text expressions -------------------------------------------------------

_KEY_RX = "sk-[a-zA-Z0-9-]{32,}"
_CLOUD_RX = "AKIA[0-9A-Z]{16}"
_IP_RX = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_MAIL_RX = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_WORD = "(?:key|password|secret|token|auth|api|pwd)"
_PAIR_RX = f"(?i)({_WORD}[-_]?{_WORD}?{_B}*[:=]{_B}*['\"])[^'\"\\n]{{8,}}(['\"])"


def _redacted(text: str) -> str:
    for rx in (_KEY_RX, _CLOUD_RX, _IP_RX, _MAIL_RX):
        text = _sub(text, rx, fv.MARK_SENSITIVE)
    return _sub(text, _PAIR_RX, rf"\1{fv.MARK_SECRET}\2")


def _masked(text: str) -> str:
    text = f"replace({text}, '\\', '/')"
    return _sub(_sub(text, "(?i)/home/dev", "<USER_HOME>"), "/dev/", "/<USER>/")


def _minified(text: str, ext: str) -> str:
    closed = f"({text} || CASE WHEN {text} = '' OR right({text}, 1) = chr(10) THEN '' ELSE chr(10) END)"
    bare = (
        f"(CASE WHEN lower({ext}) IN {_list(fv.HASH_COMMENT_EXTENSIONS)} THEN {_sub(closed, '#[^' + chr(92) + 'n]*', '')} "
        f"WHEN lower({ext}) IN {_list(fv.SLASH_COMMENT_EXTENSIONS)} THEN {_sub(closed, '//[^' + chr(92) + 'n]*', '')} "
        f"ELSE {closed} END)"
    )
    trimmed = _sub(bare, _B + r"+\n", "\n")
    return _sub(_sub(trimmed, r"\n{3,}", "\n\n"), r"\A\n{2,}", "\n")


def _tokens(text: str) -> str:
    return f"((length({text}) + 3) // 4)"


# -- sources ----------------------------------------------------------------

ORACLES["decode_text"] = r"""
SELECT doc_id, text || chr(10) || chr(65533) || chr(65533) || chr(65533) || chr(10) AS text FROM documents"""

ORACLES["incremental_ingest"] = f"""
WITH done AS (
  SELECT source AS project, doc_id || '.py' AS rel_path, 'module' AS target,
    {_masked(_redacted(_minified('text', "'.py'")))} AS content
  FROM documents)
SELECT *, {_tokens('content')} AS n_tokens FROM done"""

# -- filters ----------------------------------------------------------------

ORACLES["dir_prune"] = f"WITH {_FILES} SELECT project, rel_path FROM files WHERE rel_path NOT LIKE '%/node_modules/%'"

_RULES = """
last AS (SELECT source AS project, max(doc_id) AS last_id, max(doc_id) % 7 AS k FROM documents GROUP BY 1)"""

ORACLES["gitignore_rules"] = f"""
WITH {_RULES}
SELECT project, CAST(2 AS BIGINT) AS rule_no, '*.spec.ts' AS rule, '(?s:.*\\.spec\\.ts)\\z' AS regex FROM last
UNION ALL SELECT project, 3, 'd' || k || '/', '(?s:d' || k || ')\\z' FROM last
UNION ALL SELECT project, 4, 'conf_*.yaml', '(?s:conf_.*\\.yaml)\\z' FROM last
UNION ALL SELECT project, 5, '!keep.py', '(?s:\\!keep\\.py)\\z' FROM last
UNION ALL SELECT project, 6, '[ab]pp_' || last_id || '?*.js', '(?s:[ab]pp_' || last_id || '..*\\.js)\\z' FROM last"""

ORACLES["filter_gitignore"] = f"""
WITH {_FILES}, {_RULES},
both_files AS (SELECT project, rel_path, dir, file_name FROM files
  UNION ALL SELECT project, '.gitignore', '', '.gitignore' FROM last)
SELECT f.project, f.rel_path FROM both_files f JOIN last l USING (project)
WHERE NOT f.file_name LIKE '%.spec.ts'
  AND NOT regexp_matches(f.file_name, 'conf_.*\\.yaml$')
  AND NOT regexp_matches(f.file_name, '[ab]pp_' || l.last_id || '..*\\.js$')
  AND len([x for x in string_split(f.dir, '/') if ends_with(x, 'd' || l.k)]) = 0"""

ORACLES["filter_exclude"] = f"""
WITH {_FILES} SELECT project, rel_path FROM files
WHERE NOT starts_with(file_name, 'README') AND NOT ends_with(file_name, '.spec.ts')"""

ORACLES["filter_grouped"] = f"""
WITH {_FILES} SELECT project, rel_path FROM files WHERE NOT contains(file_name, 'README')
  AND NOT regexp_matches(file_name, '(00|11|22|33|44|55|66|77|88|99)\\.')"""

ORACLES["filter_include"] = f"""
WITH {_FILES} SELECT project, rel_path FROM files
WHERE starts_with(file_name, 'mod_') OR contains(file_name, 'Test') OR ends_with(file_name, '.js')"""

ORACLES["filter_default_noise"] = f"""
WITH {_FILES} SELECT project, rel_path FROM files
WHERE file_name <> '__init__.py' AND NOT starts_with(file_name, '.')"""

ORACLES["filter_extension"] = f"""
WITH {_FILES} SELECT project, rel_path FROM files
WHERE ends_with(file_name, '.py') OR ends_with(file_name, '.js') OR file_name = 'Dockerfile'"""

_STACKS = ", ".join(
    f"({_q(stack)}, {_q(suffix)})" for stack, suffixes in fv.STACK_PRESETS.items() for suffix in suffixes
)
ORACLES["stack_match"] = f"""
WITH {_FILES}, presets(stack, suffix) AS (VALUES {_STACKS})
SELECT project, rel_path, stack FROM files JOIN presets ON suffix = ext OR suffix = file_name"""

ORACLES["tree_mode"] = f"""
WITH {_FILES}, admitted AS (SELECT *, NOT noise AND {_LISTED} AS ok FROM classed)
SELECT project, rel_path, ok AS in_all, ok AND NOT is_test AS in_modules, ok AND is_test AS in_tests FROM admitted"""

ORACLES["scan_status"] = f"""
WITH {_SCANNED}
SELECT project, rel_path, status AS status_all,
  CASE WHEN NOT noise AND {_LISTED} THEN 'process' ELSE 'skipped' END AS status_modules
FROM scanned"""

ORACLES["scan_merged_rules"] = f"""
WITH {_FILES}, {_RULES},
both_files AS (SELECT project, rel_path, dir, file_name, ext, doc_id FROM files
  UNION ALL SELECT project, '.gitignore', '', '.gitignore', '', 6 FROM last),
judged AS (
  SELECT f.*, NOT (doc_id % 10 IN (6, 7, 8, 2, 4) OR (doc_id % 10 = 1 AND file_name LIKE '%1.py')
    OR regexp_matches(file_name, '[ab]pp_' || l.last_id || '..*\\.js$')) AS kept
  FROM both_files f JOIN last l USING (project)
  WHERE dir NOT LIKE '%/node_modules/%' AND len([x for x in string_split(dir, '/') if ends_with(x, 'd' || l.k)]) = 0)
SELECT project, rel_path, CASE WHEN kept THEN 'process' ELSE 'skipped' END AS status, kept AND {_LISTED} AS in_tree
FROM judged"""

# -- classes ----------------------------------------------------------------

ORACLES["split_ext"] = f"WITH {_FILES} SELECT project, rel_path, file_name, ext, dir FROM files"

ORACLES["split_ext_urls"] = r"""
WITH cut AS (SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*', ''), '/'), -1) AS file_name FROM pages)
SELECT page_id, file_name, regexp_extract(file_name, '^\.*[^.].*(\.[^.]*)$', 1) AS ext FROM cut"""

ORACLES["classify_test"] = f"""
WITH {_FILES} SELECT project, rel_path, regexp_matches(file_name,
  '(?i)^({"|".join(fv.TEST_NAME_STEMS)})\\.({"|".join(fv.TEST_NAME_EXTENSIONS)})$') AS is_test FROM files"""

ORACLES["classify_resource"] = f"""
WITH {_FILES} SELECT project, rel_path, file_name IN {_list(fv.RESOURCE_FILENAMES)}
  OR lower(ext) IN {_list(fv.RESOURCE_EXTENSIONS)} AS is_resource FROM files"""

ORACLES["route_target"] = f"""
WITH {_FILES}, way AS (SELECT *,
  CASE WHEN is_test THEN 'test' WHEN is_resource THEN 'resource' ELSE 'module' END AS way FROM classed)
SELECT project, rel_path, way AS "full", way AS skeleton, 'skip' AS tree_only,
  CASE way WHEN 'test' THEN 'skip' ELSE way END AS no_tests,
  CASE way WHEN 'resource' THEN 'module' ELSE way END AS no_resources
FROM way"""

# -- text -------------------------------------------------------------------

for _name, _rx in (
    ("redact_api_key", _KEY_RX), ("redact_cloud_key", _CLOUD_RX), ("redact_ip", _IP_RX),
    ("redact_email", _MAIL_RX),
):
    ORACLES[_name] = f"WITH {_EDGES} SELECT doc_id, {_sub('text', _rx, fv.MARK_SENSITIVE)} AS text FROM edges"
ORACLES["redact_assignment"] = (
    f"WITH {_EDGES} SELECT doc_id, {_sub('text', _PAIR_RX, chr(92) + '1' + fv.MARK_SECRET + chr(92) + '2')} AS text FROM edges"
)
ORACLES["redact_all"] = f"SELECT doc_id, {_redacted('text')} AS text FROM documents"
ORACLES["redact_all_edges"] = f"WITH {_EDGES} SELECT doc_id, {_redacted('text')} AS text FROM edges"
ORACLES["mask_paths"] = f"WITH {_EDGES} SELECT doc_id, {_masked('text')} AS text FROM edges"
ORACLES["minify_hash"] = f"WITH {_EDGES} SELECT doc_id, {_sub('text', '#[^' + chr(92) + 'n]*', '')} AS text FROM edges"
ORACLES["minify_slash"] = f"WITH {_EDGES} SELECT doc_id, {_sub('text', '//[^' + chr(92) + 'n]*', '')} AS text FROM edges"
ORACLES["minify_all"] = f"WITH {_FILES} SELECT project, rel_path, {_minified('content', 'ext')} AS content FROM files"
_TAIL = _B[:-1] + r"\n]+\z"
ORACLES["minify_whole"] = (
    "WITH " + _EDGES + " SELECT doc_id, " + _sub(_minified("text", "'.py'"), _TAIL, "") + " AS text FROM edges"
)
ORACLES["minify_reduction"] = f"""
WITH {_FILES}, small AS (SELECT project, rel_path, length(content) AS n, length({_minified('content', 'ext')}) AS m FROM files)
SELECT project, rel_path, 100 - m * 100 / nullif(n, 0) AS saved_percent FROM small"""
ORACLES["transform_chain"] = f"""
WITH {_FILES} SELECT project, rel_path, {_masked(_redacted(_minified('content', 'ext')))} AS content FROM files"""

ORACLES["csv_list"] = """
SELECT doc_id, CAST(3 AS BIGINT) AS n_items, '.' || lang || '|' || source || '|x ' || doc_id AS items FROM documents"""

ORACLES["checksum"] = """
SELECT d.doc_id, sha256(d.text) AS sha256, coalesce(l.quality = 0, false) AS differs
FROM documents d LEFT JOIN labels l USING (doc_id)"""

ORACLES["redact_segments"] = ORACLES["redact_all_edges"]
ORACLES["chain_segments"] = f"""
WITH {_SCANNED}, done AS (
  SELECT project, rel_path, {_masked(_redacted(_minified('content', 'ext')))} AS content FROM written)
SELECT project, rel_path, content, {_tokens('content')} AS n_tokens FROM done"""

# -- Python code ------------------------------------------------------------

_OUTLINE = _fill([
    "@cached\ndef load_", "{doc_id}", "(path, limit=", "{n_chars}", "):\n    \"\"\"Load record ", "{doc_id}",
    ".\"\"\"\n    pass\n\nclass Store_", "{doc_id}", "(Base):\n    \"\"\"Store for ", "{lang}",
    ".\"\"\"\n\n    def get(self, key):\n        pass\n\n    async def fetch(self, url: str) -> bytes:\n"
    "        \"\"\"Fetch it.\"\"\"\n        pass",
])
ORACLES["skeleton"] = f"""
WITH {_FILES} SELECT project, rel_path, CASE WHEN ext = '.py' THEN {_OUTLINE} ELSE content END AS content FROM files"""

_SHORT = f"(CASE WHEN ext = '.py' THEN {_OUTLINE} ELSE content END)"
ORACLES["chain_skeleton"] = f"""
WITH {_SCANNED}, short AS (SELECT project, rel_path, ext, {_SHORT} AS content FROM written)
SELECT project, rel_path, {_masked(_redacted(_minified('content', 'ext')))} AS content FROM short"""

_SYMBOLS = """
found AS (
  SELECT project, rel_path, 0 AS ord, 'function' AS kind, NULL AS parent, 'load_' || doc_id AS name FROM {src} WHERE ext = '.py'
  UNION ALL SELECT project, rel_path, 1, 'class', NULL, 'Store_' || doc_id FROM {src} WHERE ext = '.py'
  UNION ALL SELECT project, rel_path, 2, 'method', 'Store_' || doc_id, 'get' FROM {src} WHERE ext = '.py'
  UNION ALL SELECT project, rel_path, 0, 'error', NULL, 'Invalid AST (SyntaxError): invalid syntax (line 1)'
  FROM {src} WHERE ext IN ('.ts', '.js', '.java'))"""

ORACLES["symbols"] = f"""
WITH {_SCANNED}, shown AS (SELECT * FROM scanned WHERE in_tree), {_SYMBOLS.format(src='shown')}
SELECT project, rel_path, CAST(ord AS BIGINT) AS ord, kind, parent, name FROM found"""

# -- trees ------------------------------------------------------------------

_TREE = """
leaves AS (SELECT project, rel_path AS path, string_split(rel_path, '/') AS node FROM scanned WHERE in_tree),
nodes AS (
  SELECT DISTINCT project, node[1:i] AS node, i AS depth, CASE WHEN i = len(leaf) THEN 'file' ELSE 'dir' END AS kind
  FROM (SELECT project, node AS leaf, node, unnest(range(1, len(node) + 1)) AS i FROM leaves)),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY project, node[1:depth - 1] ORDER BY node[depth] DESC) = 1 AS is_last
  FROM nodes),
bars AS (
  SELECT n.project, n.node,
    string_agg(CASE WHEN a.depth = n.depth THEN '' WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) AS prefix
  FROM flagged n JOIN flagged a ON a.project = n.project AND a.depth <= n.depth AND a.node = n.node[1:a.depth]
  GROUP BY 1, 2),
lines AS (
  SELECT f.project, array_to_string(f.node, '/') AS path, f.kind,
    b.prefix || CASE WHEN f.is_last THEN '└── ' ELSE '├── ' END || f.node[f.depth] AS line,
    b.prefix || CASE WHEN f.is_last THEN '    ' ELSE '│   ' END AS below
  FROM flagged f JOIN bars b USING (project, node))"""

ORACLES["tree_nodes"] = f"""
WITH {_SCANNED}, {_TREE} SELECT project, array_to_string(node, '/') AS path, depth, kind FROM nodes"""
ORACLES["tree_render"] = f"WITH {_SCANNED}, {_TREE} SELECT project, path, line FROM lines"
ORACLES["tree_line_counts"] = f"""
WITH {_SCANNED}, {_TREE} SELECT project, count(*) AS tree_lines FROM lines GROUP BY 1"""
ORACLES["tree_symbols"] = f"""
WITH {_SCANNED}, {_TREE}, shown AS (SELECT * FROM scanned WHERE in_tree), {_SYMBOLS.format(src='shown')}
SELECT project, path, CAST(0 AS BIGINT) AS ord, line FROM lines
UNION ALL
SELECT l.project, l.path, s.ord + 1, l.below || CASE s.kind
    WHEN 'function' THEN 'Function: ' || s.name || '()' WHEN 'class' THEN 'Class: ' || s.name
    WHEN 'method' THEN '  Method: ' || s.name || '()' ELSE '[ERROR] ' || s.name END
FROM found s JOIN lines l ON l.project = s.project AND l.path = s.rel_path"""

# -- tokens and cost --------------------------------------------------------

ORACLES["tokens_heuristic"] = f"SELECT doc_id, {_tokens('text')} AS n_tokens FROM documents"
ORACLES["tokens_fallback"] = ORACLES["tokens_heuristic"]
ORACLES["tokens_bpe"] = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens FROM documents"
ORACLES["token_encoding"] = """
SELECT p_partkey, ['GPT-4-', 'gpt-4o-', 'gpt-3.5-', 'Legacy '][p_size % 4 + 1] || p_name AS model,
  CASE WHEN p_size % 4 = 1 THEN 'o200k_base' ELSE 'cl100k_base' END AS encoding FROM part"""

_BASE = "replace(p_name, ' ', '-') || '-' || p_size"
_RAW = f"""
raw AS (
  SELECT p_partkey AS seq, {_BASE} AS base,
    ['openai', 'azure', 'bedrock_converse', 'vertex_ai', 'anthropic', 'gemini', 'sagemaker'][p_partkey % 7 + 1] AS prov,
    ['OPENAI', 'AZURE', 'AWS (BEDROCK)', 'GOOGLE (VERTEX)', 'ANTHROPIC', 'GOOGLE', 'AWS (SAGEMAKER)'][p_partkey % 7 + 1] AS provider,
    * FROM part),
normal AS (
  SELECT seq, base AS base_name, CASE WHEN seq % 3 = 0 THEN base ELSE prov || '/' || base END AS id, provider,
    CASE WHEN seq % 13 = 0 THEN 0.0 ELSE p_retailprice / 1e9 END * 1000 AS input_cost_1k,
    p_retailprice / 1e8 * 1000 AS output_cost_1k,
    CAST(CASE WHEN seq % 5 > 1 AND p_size > 0 THEN p_size * 1000
              WHEN seq % 4 > 1 AND p_size > 0 THEN p_size * 100 ELSE 4096 END AS BIGINT) AS context_window
  FROM raw WHERE seq % 97 <> 13 AND seq % 89 <> 3 AND seq % 11 NOT IN (4, 6)),
models AS (
  SELECT * EXCLUDE (rank) FROM (
    SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY
      CASE WHEN provider IN ('AZURE', 'AWS (BEDROCK)', 'GOOGLE (VERTEX)', 'AWS (SAGEMAKER)') THEN 1 ELSE 0 END, seq) AS rank
    FROM normal) WHERE rank = 1),
chosen AS (SELECT 'src' || p_partkey AS project, {_BASE} AS target_model FROM part)"""

_USED = f"""
used AS (SELECT source AS project, CAST(sum({_tokens('text')}) AS BIGINT) AS n_tokens FROM documents GROUP BY 1),
priced AS (
  SELECT project, n_tokens, target_model, n_tokens / 1000 * coalesce(input_cost_1k, 0) AS cost_usd,
    coalesce(context_window, 4096) AS context_limit
  FROM used LEFT JOIN chosen USING (project) LEFT JOIN models ON base_name = target_model)"""

ORACLES["tokens_by_project"] = f"""
SELECT source AS project, CAST(sum({_tokens('text')}) AS BIGINT) AS n_tokens FROM documents GROUP BY 1"""
ORACLES["cost_by_model"] = f"WITH {_RAW}, {_USED} SELECT project, target_model, n_tokens, cost_usd FROM priced"
ORACLES["context_overflow"] = f"""
WITH {_RAW}, {_USED} SELECT project, n_tokens, context_limit, n_tokens > context_limit AS over_limit FROM priced"""
ORACLES["cost_cached"] = f"""
WITH counted AS (
  SELECT doc_id, coalesce(CAST(quality * 1000 - toxic AS BIGINT), {_tokens('text')}) AS n_tokens
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 THEN n_tokens / 1000 * CAST(0.0025 AS DOUBLE) ELSE 0.0 END AS cost_usd FROM counted"""
ORACLES["model_lookup"] = f"""
WITH {_RAW} SELECT project, target_model, input_cost_1k, coalesce(context_window, 4096) AS context_limit
FROM chosen LEFT JOIN models ON base_name = target_model"""

# -- reuse ------------------------------------------------------------------


def _flag(n: int) -> str:
    return f"CASE WHEN n_chars % {2 * n} >= {n} THEN 'true' ELSE 'false' END"


ORACLES["config_fingerprint"] = f"""
SELECT doc_id, md5('["' || CASE lang WHEN 'en' THEN 'full' WHEN 'fr' THEN 'skeleton' ELSE 'tree_only' END || '", '
  || {" || ', ' || ".join(_flag(n) for n in (1, 2, 4, 8, 16))} || ']') AS config_hash FROM documents"""


def _print(mtime: str, content: bool = True, options=inputs.OPTIONS) -> str:
    parts = f"project, rel_path, {mtime}, strlen(content), {_q(options.config_fingerprint())}"
    return f"sha256(concat_ws('|', {parts}{', sha256(content)' if content else ''}))"


ORACLES["file_fingerprint"] = f"""
WITH {_FILES} SELECT project, rel_path, {_print('mtime_us')} AS by_content, {_print('mtime_us', False)} AS by_stat FROM files"""

_STRICT = inputs.OPTIONS.with_(process_tests=False)


def _cache(options=inputs.OPTIONS) -> str:
    return f"""
cache AS (
  SELECT {_print('CASE WHEN quality = 1 THEN mtime_us ELSE mtime_us - 1000000 END', options=options)} AS fingerprint,
    project, rel_path, 'stored ' || doc_id AS content, n_chars + toxic AS n_tokens, quality
  FROM files JOIN labels USING (doc_id)),
current_files AS (SELECT *, {_print('mtime_us', options=options)} AS fingerprint FROM files)"""


ORACLES["cache_hits"] = f"""
WITH {_FILES}, {_cache()} SELECT f.project, f.rel_path, c.content, c.n_tokens
FROM current_files f JOIN cache c USING (fingerprint)"""
ORACLES["cache_generations"] = f"""
WITH {_FILES}, {_cache()} SELECT f.project, f.rel_path,
  CASE WHEN c.n_tokens % 2 = 1 THEN 'again ' ELSE '' END || c.content AS content, c.n_tokens
FROM current_files f JOIN cache c USING (fingerprint)"""
ORACLES["cache_misses"] = f"""
WITH {_FILES}, {_cache()} SELECT project, rel_path, fingerprint FROM current_files
WHERE fingerprint NOT IN (SELECT fingerprint FROM cache)"""
ORACLES["cache_upsert"] = f"""
WITH {_FILES}, {_cache()}
SELECT fingerprint, project, rel_path, 'fresh ' || doc_id AS content, n_chars AS n_tokens FROM current_files
UNION ALL SELECT fingerprint, project, rel_path, content, n_tokens FROM cache WHERE quality <> 1"""
ORACLES["cache_schema_evolve"] = f"""
WITH {_FILES}, {_cache()}
SELECT fingerprint, content, CAST(0 AS BIGINT) AS n_tokens FROM cache
UNION ALL SELECT fingerprint, 'fresh ' || doc_id, n_chars FROM current_files"""

# -- the model catalogue ----------------------------------------------------

_MODEL = "base_name, id, provider, input_cost_1k, output_cost_1k, context_window"
ORACLES["registry_normalize"] = f"WITH {_RAW} SELECT {_MODEL} FROM normal"
ORACLES["registry_provider"] = f"""
WITH {_RAW} SELECT provider, count(*) AS n_models, min(base_name) AS first_model FROM normal GROUP BY 1"""
ORACLES["registry_canonical"] = f"WITH {_RAW} SELECT {_MODEL} FROM models"
ORACLES["registry_merge"] = f"""
WITH {_RAW}, live AS (
  SELECT {_BASE} AS base_name, {_BASE} AS id, 'OPENAI' AS provider, abs(s_acctbal) / 1e9 * 1000 AS input_cost_1k,
    CAST(0 AS DOUBLE) AS output_cost_1k, CAST(8000 AS BIGINT) AS context_window,
    row_number() OVER (PARTITION BY {_BASE} ORDER BY s_suppkey) AS rank
  FROM supplier JOIN part ON s_suppkey = p_partkey)
SELECT {_MODEL} FROM live WHERE rank = 1
UNION ALL SELECT {_MODEL} FROM models WHERE base_name NOT IN (SELECT base_name FROM live)"""
ORACLES["providers"] = f"WITH {_RAW} SELECT DISTINCT provider FROM models"
ORACLES["models_by_provider"] = f"""
WITH {_RAW}, wanted AS (
  SELECT provider FROM raw WHERE seq % 89 <> 3 UNION SELECT upper(p_brand) FROM part UNION SELECT 'UNKNOWN' FROM raw WHERE seq % 89 = 3)
SELECT provider, base_name AS model FROM models
UNION ALL SELECT provider, '-- No Models --' FROM wanted WHERE provider NOT IN (SELECT provider FROM models)"""

# -- counters ---------------------------------------------------------------


def _counters(cached: bool) -> str:
    """Counters with tests switched off, with or without stored results."""
    reuse = "LEFT JOIN cache c USING (fingerprint)" if cached else ""
    hit = "c.content IS NOT NULL" if cached else "false"
    count = f"coalesce(c.n_tokens, {_tokens('f.content')})" if cached else _tokens("f.content")
    state = f", {_cache(_STRICT)}" if cached else ", current_files AS (SELECT *, '' AS fingerprint FROM files)"
    return f"""
WITH {_SCANNED}{state},
fate AS (
  SELECT s.project,
    CASE WHEN s.noise OR NOT (s.is_resource OR {_LISTED.replace('ext', 's.ext')}) THEN 'skipped'
         WHEN s.strict_target = 'skip' THEN 'rejected' ELSE 'ok' END AS fate,
    s.strict_target AS target, {hit} AS hit, {count} AS n_tokens
  FROM scanned s JOIN current_files f USING (project, rel_path) {reuse})
SELECT project, count(*) FILTER (fate = 'ok') AS processed, count(*) FILTER (fate = 'ok' AND hit) AS cached,
  count(*) FILTER (fate = 'skipped') AS skipped, count(*) FILTER (fate = 'rejected') AS errors,
  CAST(coalesce(sum(n_tokens) FILTER (fate = 'ok'), 0) AS BIGINT) AS total_tokens,
  count(*) FILTER (fate = 'ok' AND target = 'module') AS modules_written,
  count(*) FILTER (fate = 'ok' AND target = 'test') AS tests_written,
  count(*) FILTER (fate = 'ok' AND target = 'resource') AS resources_written
FROM fate GROUP BY project"""


ORACLES["run_counters"] = _counters(cached=True)
ORACLES["summary_json"] = f"""
SELECT project, CAST(json_object('project', project, 'processed', processed, 'cached', cached, 'skipped', skipped,
  'errors', errors, 'total_tokens', total_tokens, 'modules_written', modules_written,
  'tests_written', tests_written, 'resources_written', resources_written) AS VARCHAR) AS summary
FROM ({_counters(cached=False)})"""
ORACLES["target_counts"] = f"""
WITH {_SCANNED} SELECT project, count(*) FILTER (status = 'process' AND target = 'module') AS modules_written,
  count(*) FILTER (status = 'process' AND target = 'test') AS tests_written,
  count(*) FILTER (status = 'process' AND target = 'resource') AS resources_written
FROM scanned GROUP BY 1"""

# -- documents --------------------------------------------------------------

_RULE = _q(fv.ENTRY_RULE)
ORACLES["entry_block"] = f"""
WITH {_SCANNED} SELECT project, rel_path,
  {_RULE} || chr(10) || rel_path || chr(10) || content || chr(10) AS block FROM written"""

_CATEGORIES = """
entries AS (
  SELECT project, CAST(CASE target WHEN 'module' THEN 2 WHEN 'test' THEN 3 ELSE 4 END AS BIGINT) AS section,
    rel_path AS sort_key, CAST(0 AS BIGINT) AS ord, {rule} || chr(10) || rel_path || chr(10) || content AS value
  FROM {written}),
heads AS (
  SELECT DISTINCT project, section, '' AS sort_key, CAST(-1 AS BIGINT) AS ord,
    CASE section WHEN 2 THEN 'SCRIPTS/MODULES:' WHEN 3 THEN 'TESTS:' ELSE 'RESOURCES (CONFIG/DATA/DOCS):' END AS value
  FROM entries),
tails AS (SELECT project, section, chr(1114111) AS sort_key, CAST(0 + 1 AS BIGINT) AS ord, chr(10) AS value FROM heads),
titles AS (
  SELECT project, CAST(0 AS BIGINT) AS section, '' AS sort_key, CAST(-1 AS BIGINT) AS ord,
    'PROJECT CONTEXT: ' || project || chr(10) || repeat('=', 80) || chr(10) AS value
  FROM (SELECT DISTINCT project FROM {all}))"""
_CATS = _CATEGORIES.format(rule=_RULE, written="written", all="scanned")
_TREE_BLOCKS = """
tree_blocks AS (
  SELECT project, CAST(1 AS BIGINT) AS section, '' AS sort_key, CAST(-1 AS BIGINT) AS ord,
    'PROJECT STRUCTURE:' || chr(10) || repeat('-', 50) AS value FROM titles
  UNION ALL SELECT project, 1, replace(path, '/', chr(1)), 0, line FROM lines
  UNION ALL SELECT project, 1, '', 0, '' FROM titles WHERE project NOT IN (SELECT project FROM lines)
  UNION ALL SELECT project, 1, chr(1114111), 1, chr(10) FROM titles),
unified AS (
  SELECT * FROM titles UNION ALL SELECT * FROM tree_blocks UNION ALL SELECT * FROM heads
  UNION ALL SELECT * FROM entries UNION ALL SELECT * FROM tails)"""

ORACLES["category_docs"] = f"WITH {_SCANNED}, {_CATS} SELECT * FROM heads UNION ALL SELECT * FROM entries"
ORACLES["unified_doc"] = f"WITH {_SCANNED}, {_TREE}, {_CATS}, {_TREE_BLOCKS} SELECT * FROM unified"
_DOC_TOKENS = "CAST((sum(length(value) + 1) + 3) // 4 AS BIGINT)"
ORACLES["document_tokens"] = f"""
WITH {_SCANNED}, {_TREE}, {_CATS}, {_TREE_BLOCKS} SELECT project, {_DOC_TOKENS} AS token_count FROM unified GROUP BY 1"""
_MAPPED = """
mapped AS (
  SELECT project, section, sort_key, ord, length(value) + 1 AS n_chars,
    length(value) - length(replace(value, chr(10), '')) + 1 AS n_lines FROM {blocks}),
placed AS (
  SELECT *, sum(n_chars) OVER w - n_chars AS start, sum(n_lines) OVER w - n_lines + 1 AS first_line FROM mapped
  WINDOW w AS (PARTITION BY project ORDER BY section, sort_key, ord ROWS UNBOUNDED PRECEDING))"""
ORACLES["document_map"] = f"""
WITH {_SCANNED}, {_TREE}, {_CATS}, {_TREE_BLOCKS}, {_MAPPED.format(blocks='unified')}
SELECT project, section, sort_key, ord, CAST(start AS BIGINT) AS start, CAST(n_chars AS BIGINT) AS n_chars,
  CAST(first_line AS BIGINT) AS first_line, CAST(n_lines AS BIGINT) AS n_lines FROM placed"""
ORACLES["symbol_document_map"] = f"""
WITH {_SCANNED}, {_TREE}, shown AS (SELECT * FROM scanned WHERE in_tree), {_SYMBOLS.format(src='shown')}, {_CATS}, {_TREE_BLOCKS},
listed AS (
  SELECT * FROM unified UNION ALL
  SELECT l.project, 1, replace(l.path, '/', chr(1)), s.ord + 1, l.below || CASE s.kind
      WHEN 'function' THEN 'Function: ' || s.name || '()' WHEN 'class' THEN 'Class: ' || s.name
      WHEN 'method' THEN '  Method: ' || s.name || '()' ELSE '[ERROR] ' || s.name END
  FROM found s JOIN lines l ON l.project = s.project AND l.path = s.rel_path),
{_MAPPED.format(blocks='listed')}
SELECT project, section, count(*) AS n_blocks, CAST(min(start) AS BIGINT) AS start,
  CAST(max(start + n_chars) AS BIGINT) AS stop, CAST(min(first_line) AS BIGINT) AS first_line,
  CAST(sum(n_lines) AS BIGINT) AS n_lines FROM placed GROUP BY 1, 2"""
ORACLES["run_summary"] = f"""
WITH {_SCANNED}, {_TREE}, {_CATS}, {_TREE_BLOCKS},
counted AS (
  SELECT project, count(*) FILTER (status = 'process') AS processed, count(*) FILTER (status = 'skipped') AS skipped,
    CAST(0 AS BIGINT) AS errors,
    count(*) FILTER (status = 'process' AND target = 'module') AS m,
    count(*) FILTER (status = 'process' AND target = 'test') AS t,
    count(*) FILTER (status = 'process' AND target = 'resource') AS r
  FROM scanned GROUP BY 1),
sized AS (SELECT project, {_DOC_TOKENS} AS token_count FROM unified GROUP BY 1),
trees AS (SELECT project, count(*) AS tree_lines FROM lines GROUP BY 1)
SELECT project, processed, skipped, errors, token_count, coalesce(tree_lines, 0) AS tree_lines,
  concat_ws(',', CASE WHEN m > 0 THEN 'transcription_modules' END, CASE WHEN t > 0 THEN 'transcription_tests' END,
    CASE WHEN r > 0 THEN 'transcription_resources' END, 'transcription_full_context') AS generated
FROM counted JOIN sized USING (project) LEFT JOIN trees USING (project)"""

_TURNS = _CATEGORIES.format(rule=_RULE, written="turns", all="turns")
ORACLES["conversation_context"] = f"""
WITH turns AS (
  SELECT 'conversation ' || conv_id AS project, lpad(CAST(turn AS VARCHAR), 19, '0') || '_' || role || '.md' AS rel_path,
    'resource' AS target, text AS content FROM conversations), {_TURNS}
SELECT * FROM titles UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM entries UNION ALL SELECT * FROM tails"""

ORACLES["error_report"] = f"""
WITH {_SCANNED}, failed AS (
  SELECT project, rel_path FROM scanned WHERE NOT noise AND is_test AND {_LISTED})
SELECT project, CAST(0 AS BIGINT) AS section, rel_path AS sort_key, CAST(0 AS BIGINT) AS ord,
  'FILE: ' || rel_path || chr(10) || 'ERROR: Filtered by mode or depth' || chr(10) || repeat('-', 80) AS value FROM failed
UNION ALL SELECT DISTINCT project, 0, '', -1, 'TRANSCRIPTION ERRORS REPORT:' || chr(10) || repeat('=', 80) FROM failed"""

# -- all of it --------------------------------------------------------------

ORACLES["context_price"] = f"""
WITH {_RAW}, clean AS (
  SELECT source AS project, lang, {_minified(_redacted('text'), "'.md'")} AS text FROM documents),
used AS (
  SELECT project, lang, count(*) AS n_files, CAST(sum({_tokens('text')}) AS BIGINT) AS n_tokens FROM clean GROUP BY 1, 2)
SELECT project, lang, n_files, n_tokens, target_model, n_tokens / 1000 * coalesce(input_cost_1k, 0) AS cost_usd,
  n_tokens > coalesce(context_window, 4096) AS over_limit
FROM used LEFT JOIN chosen USING (project) LEFT JOIN models ON base_name = target_model"""

_NOTES = """
notes AS (
  SELECT source AS project, CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS ext,
    lang || '/note_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS rel_path, text AS content
  FROM documents)"""

ORACLES["shared_copies"] = f"""
WITH {_NOTES} SELECT project, rel_path,
  CASE WHEN content IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY content, ext) END AS copies,
  content IS NULL OR row_number() OVER (PARTITION BY content, ext ORDER BY project, rel_path) = 1 AS is_first
FROM notes"""
ORACLES["shared_transform"] = f"""
WITH {_NOTES}, done AS (
  SELECT project, rel_path, {_masked(_redacted(_minified('content', 'ext')))} AS content FROM notes)
SELECT project, rel_path, content, {_tokens('content')} AS n_tokens FROM done"""

ORACLES["changed_states"] = """
WITH states AS (
  SELECT source || '/' || lang || '/' || (doc_id % 50) AS path, n_chars * 1000 AS mtime,
    CAST(strlen(text) AS BIGINT) AS length FROM documents)
SELECT path, mtime, length FROM states
QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC, length DESC) = 1"""
