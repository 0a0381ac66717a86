"""Shared SQL fragments: the derived logs, claims and verdicts, said a second time in plain SQL."""

# Observations of every order's claim (two for retried claims), and the upstream events.
OBS = """
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
    CASE WHEN o_orderkey%17=0 THEN 'absent' WHEN o_orderkey%13=0 THEN 'mismatch' WHEN o_orderkey%19=0 THEN 'unknown'
         WHEN o_orderkey%23=0 THEN 'nokey' WHEN o_orderkey%29=0 THEN 'retry' WHEN o_orderkey%31=0 THEN 'shape' ELSE 'ok' END AS fault
  FROM orders),
claim AS (
  SELECT *, 'wf_' || c AS workflow_id, 'log_' || (c // 4) AS source_file,
    CASE WHEN k%37=0 AND k>=200 THEN k-200 ELSE k END AS seq,
    CASE WHEN fault='unknown' THEN 'ghost.tool' WHEN k%5<2 THEN 'orders.upsert' WHEN k%5=2 THEN 'orders.audit'
         WHEN k%5=3 THEN 'orders.purge' ELSE 'orders.link' END AS tool_id,
    CASE WHEN k%5<>0 THEN 1704067200 + k - CASE WHEN k%41=0 THEN 86400 ELSE 0 END END AS epoch
  FROM base),
obs AS (
  SELECT *, k*8+5 AS line_no, 1 AS attempt FROM claim
  UNION ALL
  SELECT *, k*8+6 AS line_no, CASE WHEN k%2=0 THEN 1 ELSE 2 END AS attempt FROM claim WHERE fault='retry')"""

EVENTS = OBS + """,
ev AS (
  SELECT workflow_id, source_file, line_no, 'tool_observed' AS type, CASE WHEN line_no%8=5 THEN 't' ELSE 'u' END || k AS run_event_id,
    CAST(NULL AS VARCHAR) AS parent, seq, tool_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS hits,
    CAST(NULL AS VARCHAR) AS control_kind, CAST(NULL AS VARCHAR) AS decision, true AS valid, k FROM obs
  UNION ALL
  SELECT workflow_id, source_file, k*8, 'retrieval', 'r' || k, NULL, NULL, NULL, (['ok','ok','empty','error'])[(k//7)%4+1],
    CASE WHEN k%14=1 THEN (k//14)%3 END, NULL, NULL, true, k FROM claim WHERE k%7=1
  UNION ALL
  SELECT workflow_id, source_file, k*8+1, 'model_turn', 'm' || k, NULL, NULL, NULL, (['completed','completed','error','aborted','incomplete'])[(k//11)%5+1],
    NULL, NULL, NULL, true, k FROM claim WHERE k%11=2
  UNION ALL
  SELECT workflow_id, source_file, k*8+2, 'control', 'c' || k, NULL, NULL, NULL, NULL, NULL, 'interrupt', NULL, true, k FROM claim WHERE k%43=3
  UNION ALL
  SELECT workflow_id, source_file, k*8+3, 'control', 'b' || k, NULL, NULL, NULL, NULL, NULL, (['branch','gate','loop'])[(k//47)%3+1],
    (['taken','skipped'])[(k//141)%2+1], true, k FROM claim WHERE k%47=4
  UNION ALL
  SELECT workflow_id, source_file, k*8+4, 'tool_skipped', 's' || k, NULL, NULL, 'orders.upsert', NULL, NULL, NULL, NULL, true, k FROM claim WHERE k%53=5
  UNION ALL
  SELECT NULL, source_file, k*8+7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, k FROM claim WHERE k%1009=5
  UNION ALL
  SELECT workflow_id, source_file, k*8+7, 'control', 'z' || k, 't' || k, NULL, NULL, NULL, NULL, 'run_completed', NULL, true, k FROM claim WHERE k%3=0 AND k%1009<>5)"""

_STEPS = """,
planned AS (
  SELECT workflow_id, seq, max_by(tool_id, line_no) AS tool_id, max_by(k, line_no) AS k, COUNT(*) AS repeat_count,
    COUNT(DISTINCT k*10+attempt) > 1 AS divergent
  FROM obs GROUP BY workflow_id, seq)"""

STEPS = OBS + _STEPS

_CHECKS = """,
step AS (
  SELECT p.workflow_id, p.seq, p.tool_id, p.k, p.repeat_count, p.divergent, b.c, b.st, b.price, b.fault,
    CASE b.fault WHEN 'absent' THEN b.k+100000000 WHEN 'nokey' THEN NULL ELSE b.k END AS rec,
    CASE WHEN p.divergent THEN 'RETRY_OBSERVATIONS_DIVERGE' WHEN p.tool_id='ghost.tool' THEN 'UNKNOWN_TOOL' END AS pre,
    CASE WHEN b.k%3=0 THEN b.k%7+1 ELSE 8 END AS line_claimed,
    CASE WHEN b.k%7=0 THEN 'nobody' ELSE 'Customer#' || lpad(CAST(b.c AS VARCHAR), 9, '0') END AS name_claimed
  FROM planned p JOIN base b USING (k)),
fo AS (SELECT o_orderkey AS id, COUNT(*) AS n, MIN(o_orderstatus) AS st, MIN(CAST(o_totalprice AS DECIMAL(18,2))) AS price FROM orders GROUP BY 1),
fc AS (SELECT c_custkey AS id, COUNT(*) AS n, MIN(c_name) AS name FROM customer GROUP BY 1),
fl AS (SELECT l_orderkey AS id, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem GROUP BY 1),
fp AS (SELECT l_orderkey AS id, l_linenumber AS ln, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
fj AS (SELECT o_orderkey AS id, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1),
fx AS (SELECT o_custkey AS id, COUNT(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey WHERE l_orderkey IS NULL GROUP BY 1),
row_codes AS (
  SELECT s.*, 'order' AS which, COALESCE(pre, CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN COALESCE(fo.n,0)=0 THEN 'ROW_ABSENT'
      WHEN fo.n>=2 THEN 'DUPLICATE_ROWS' WHEN fault='shape' THEN 'ROW_SHAPE_MISMATCH'
      WHEN (CASE WHEN fault='mismatch' THEN 'X' ELSE s.st END) <> fo.st OR s.price <> fo.price THEN 'VALUE_MISMATCH' END) AS code,
    CASE WHEN (CASE WHEN fault='mismatch' THEN 'X' ELSE s.st END) <> fo.st THEN 'o_orderstatus' ELSE 'o_totalprice' END AS bad
  FROM step s LEFT JOIN fo ON fo.id=s.rec WHERE s.tool_id IN ('orders.upsert','orders.audit')
  UNION ALL
  SELECT s.*, 'customer', COALESCE(pre, CASE WHEN COALESCE(fc.n,0)=0 THEN 'ROW_ABSENT' WHEN fc.n>=2 THEN 'DUPLICATE_ROWS' WHEN name_claimed<>fc.name THEN 'VALUE_MISMATCH' END), 'c_name'
  FROM step s LEFT JOIN fc ON fc.id=s.c WHERE s.tool_id='orders.audit' AND NOT s.divergent),
verdict AS (
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent,
    CASE WHEN tool_id='orders.upsert' THEN '' WHEN which='order' THEN 'order_row' ELSE 'customer_row' END AS check_id, 'sql_row' AS check_kind, code,
    CASE WHEN code='VALUE_MISMATCH' THEN bad END AS field, CAST(NULL AS BIGINT) AS matched, CAST(NULL AS DOUBLE) AS measured FROM row_codes
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, '', 'sql_row_absent',
    COALESCE(pre, CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN fp.n>0 THEN 'ROW_PRESENT_WHEN_FORBIDDEN' END), NULL,
    CASE WHEN pre IS NULL AND rec IS NOT NULL THEN COALESCE(fp.n,0) END, NULL
  FROM step s LEFT JOIN fp ON fp.id=s.rec AND fp.ln=s.line_claimed WHERE tool_id='orders.purge'
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, 'a_lines', 'related_exists',
    COALESCE(pre, CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN fl.n IS NULL THEN 'RELATED_ROWS_ABSENT' END), NULL, 
    CASE WHEN pre IS NULL AND rec IS NOT NULL THEN COALESCE(fl.n,0) END, NULL
  FROM step s LEFT JOIN fl ON fl.id=s.rec WHERE tool_id='orders.link'
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, 'b_count', 'aggregate',
    CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN COALESCE(fl.n,0) < k%4 THEN 'RELATIONAL_EXPECTATION_MISMATCH' END, NULL,
    CASE WHEN rec IS NOT NULL THEN COALESCE(fl.n,0) END, CASE WHEN rec IS NOT NULL THEN CAST(COALESCE(fl.n,0) AS DOUBLE) END
  FROM step s LEFT JOIN fl ON fl.id=s.rec WHERE tool_id='orders.link' AND pre IS NULL
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, 'c_sum', 'aggregate',
    CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN COALESCE(fl.total,0) > 150 THEN 'RELATIONAL_EXPECTATION_MISMATCH' END, NULL,
    CASE WHEN rec IS NOT NULL THEN COALESCE(fl.n,0) END, CASE WHEN rec IS NOT NULL THEN COALESCE(fl.total,0) END
  FROM step s LEFT JOIN fl ON fl.id=s.rec WHERE tool_id='orders.link' AND pre IS NULL
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, 'd_join', 'join_count',
    CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' WHEN COALESCE(fj.n,0) < 2 THEN 'RELATIONAL_EXPECTATION_MISMATCH' END, NULL,
    CASE WHEN rec IS NOT NULL THEN COALESCE(fj.n,0) END, CASE WHEN rec IS NOT NULL THEN CAST(COALESCE(fj.n,0) AS DOUBLE) END
  FROM step s LEFT JOIN fj ON fj.id=s.rec WHERE tool_id='orders.link' AND pre IS NULL
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, 'e_orphans', 'anti_join',
    CASE WHEN fx.n>0 THEN 'ORPHAN_ROW_DETECTED' END, NULL, COALESCE(fx.n,0), NULL
  FROM step s LEFT JOIN fx ON fx.id=s.c WHERE tool_id='orders.link' AND pre IS NULL
  UNION ALL
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, NULL, NULL, pre, NULL, NULL, NULL FROM step WHERE tool_id='ghost.tool'),
checks AS (
  SELECT *, CASE WHEN code IS NULL THEN 'verified'
    WHEN code IN ('ROW_ABSENT','RELATED_ROWS_ABSENT') THEN 'missing'
    WHEN code IN ('DUPLICATE_ROWS','VALUE_MISMATCH','ROW_PRESENT_WHEN_FORBIDDEN','RELATIONAL_EXPECTATION_MISMATCH','ORPHAN_ROW_DETECTED') THEN 'inconsistent'
    ELSE 'incomplete_verification' END AS status FROM verdict)"""

CHECKS = STEPS + _CHECKS

_ROLLED = """,
grouped AS (
  SELECT workflow_id, seq, ANY_VALUE(tool_id) AS tool_id, ANY_VALUE(k) AS k, ANY_VALUE(repeat_count) AS repeat_count, ANY_VALUE(divergent) AS divergent,
    COUNT(*) AS n, COUNT(*) FILTER (WHERE status='verified') AS ok, COUNT(*) FILTER (WHERE status='incomplete_verification') AS open_,
    MIN(code) FILTER (WHERE code IN ('RETRY_OBSERVATIONS_DIVERGE','UNKNOWN_TOOL','KEY_VALUE_POINTER_MISSING')) AS problem,
    MIN(status) AS only_status, MIN(code) AS only_code,
    string_agg(check_id || ':' || status || ':' || COALESCE(code,''), ';' ORDER BY check_id) AS effects
  FROM checks GROUP BY workflow_id, seq),
steps AS (
  SELECT workflow_id, seq, tool_id, k, repeat_count, divergent, effects, problem IS NULL AND tool_id IN ('orders.audit','orders.link') AS multi,
    CASE WHEN problem IS NOT NULL THEN 'incomplete_verification' WHEN tool_id NOT IN ('orders.audit','orders.link') THEN only_status
         WHEN open_>0 THEN 'incomplete_verification' WHEN ok=n THEN 'verified' WHEN ok=0 THEN 'inconsistent' ELSE 'partially_verified' END AS status,
    CASE WHEN problem IS NOT NULL THEN problem WHEN tool_id NOT IN ('orders.audit','orders.link') THEN only_code
         WHEN open_>0 THEN 'MULTI_EFFECT_INCOMPLETE' WHEN ok=n THEN NULL WHEN ok=0 THEN 'MULTI_EFFECT_ALL_FAILED' ELSE 'MULTI_EFFECT_PARTIAL' END AS code
  FROM grouped),
badfile AS (SELECT DISTINCT source_file FROM claim WHERE k%1009=5),
wf AS (
  SELECT w.workflow_id, w.malformed, COUNT(s.seq) AS n_steps,
    COUNT(*) FILTER (WHERE s.status='verified') AS n_verified, COUNT(*) FILTER (WHERE s.status='missing') AS n_missing,
    COUNT(*) FILTER (WHERE s.status='inconsistent') AS n_inconsistent, COUNT(*) FILTER (WHERE s.status='incomplete_verification') AS n_incomplete,
    COUNT(*) FILTER (WHERE s.status='partially_verified') AS n_partial
  FROM (SELECT workflow_id, BOOL_OR(source_file IN (SELECT source_file FROM badfile)) AS malformed FROM claim GROUP BY 1) w
  LEFT JOIN steps s USING (workflow_id) GROUP BY 1, 2),
wfs AS (
  SELECT *, CASE WHEN malformed OR n_steps=0 OR n_incomplete>0 THEN 'incomplete' WHEN n_missing+n_inconsistent+n_partial>0 THEN 'inconsistent'
    WHEN n_verified=n_steps THEN 'complete' ELSE 'incomplete' END AS status FROM wf)"""

ROLLED = CHECKS + _ROLLED


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


def full() -> str:
    """Events, steps, checks and rollups in one WITH list."""
    return EVENTS + _STEPS + _CHECKS + _ROLLED
