"""The derived graph as SQL views, for the oracles only."""

ID = "(CAST('0x' || substr(sha256({}), 3, 14) AS BIGINT) & 9007199254740991)"


def edge_id(kind: str, source: str, target: str) -> str:
    return ID.format(f"""'rel:["edge","' || {kind} || '","n:' || {source} || '","n:' || {target} || '","default"]'""")


def edge_of(kind: str, source: str, target: str, discriminator: str) -> str:
    """The id of an edge from SQL expressions of the logical ids of its ends."""
    return ID.format(f"""'rel:["edge","' || {kind} || '","' || {source} || '","' || {target} || '","' || {discriminator} || '"]'""")


GRAPH = f"""
evidence AS (SELECT (s_suppkey * 4 + k) * 8 + 7 AS id, t AS source_type, (s_suppkey % 50 + 50) / 100.0::DOUBLE AS confidence, s_nationkey::BIGINT * 8 + 6 AS incident_id
  FROM supplier, (VALUES (0, 'package-lock'), (1, 'npm-registry'), (2, 'other')) f(k, t) WHERE s_acctbal >= 0),
ordered_lines AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS prev FROM lineitem),
hops AS (SELECT * FROM (SELECT CASE WHEN prev IS NULL THEN o_custkey * 8 + 2 ELSE prev * 8 + 1 END AS source_id,
    CASE WHEN prev IS NULL THEN 'Service' ELSE 'PackageVersion' END AS source_kind, l_partkey * 8 + 1 AS target_id,
    (l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 8 + 7 AS evidence_id, epoch_ms(l_shipdate) AS shipped, l_linestatus, l_returnflag,
    '^' || CAST(l_quantity AS BIGINT) AS declared_range
  FROM ordered_lines LEFT JOIN orders ON l_orderkey = o_orderkey WHERE prev IS NOT NULL OR o_orderkey IS NOT NULL) WHERE source_id <> target_id),
edges AS (SELECT *, {edge_id("'DEPENDS_ON'", "source_id", "target_id")} AS id FROM (
  SELECT source_id, source_kind, target_id, list_sort(list(DISTINCT evidence_id)) AS evidence_ids, min(shipped) FILTER (l_linestatus = 'F') AS valid_from,
    CASE WHEN bool_and(l_returnflag = 'R') THEN max(shipped) + 2592000000 END AS valid_until,
    CASE WHEN max(l_returnflag) = 'R' THEN 'production' ELSE 'optional' END AS dependency_type, min(declared_range) AS declared_range
  FROM hops GROUP BY 1, 2, 3)),
roots AS (SELECT p_partkey * 8 + 1 AS root_id FROM part WHERE p_size = 50),
incidents AS (SELECT s_nationkey::BIGINT * 8 + 6 AS id, min(epoch_ms(l_shipdate)) AS interval_start,
    CASE WHEN s_nationkey < 12 THEN min(epoch_ms(l_shipdate)) + 7776000000 END AS interval_end, max(epoch_ms(l_shipdate)) AS observed_at, count(*) AS reports
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY s_nationkey),
affects AS (SELECT DISTINCT s_nationkey::BIGINT * 8 + 6 AS incident_id, l_partkey * 8 + 1 AS version_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_quantity = 50),
incident_roots AS (SELECT incident_id, version_id AS root_id FROM affects)
"""


def states(depth: int, fan_out: int, edges: str = "edges", roots: str = "roots") -> str:
    """CTE `states`: the reverse simple-path traversal."""
    return f"""
page AS (SELECT * FROM {edges} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY id, source_id) <= {fan_out}),
states(root_id, cur, depth, node_ids, edge_ids, terminal) AS (
  SELECT root_id, root_id, 0, [root_id], []::BIGINT[], false FROM {roots}
  UNION ALL
  SELECT s.root_id, e.source_id, s.depth + 1, list_append(s.node_ids, e.source_id), list_append(s.edge_ids, e.id), e.source_kind = 'Service'
  FROM states s JOIN page e ON e.target_id = s.cur WHERE NOT s.terminal AND s.depth < {depth} AND NOT list_contains(s.node_ids, e.source_id)),
paths AS (SELECT root_id, cur AS service_id, depth, edge_ids, '[' || root_id || ',' || cur || ',' || array_to_string(edge_ids, ',') || ']' AS path_key FROM states WHERE terminal)
"""


NONE = "SELECT NULL::BIGINT AS incident_id, NULL::VARCHAR AS code, NULL::BIGINT AS node_id WHERE false"
SERVICE_CODES = ("dependents-per-node-limit-reached", "service-limit-reached", "paths-per-service-limit-reached", "'path-limit-reached', 'traversal-state-limit-reached'")
TARGET_CODES = ("outgoing-edge-limit-reached", "target-limit-reached", "paths-per-target-limit-reached", "'target-limit-reached', 'traversal-state-limit-reached'")


def bounded(limits, edges: str = "edges", roots: str = "incident_roots", root: str = "root_id", here: str = "target_id", there: str = "source_id", stops: str = "e.source_kind = 'Service'", ends: str = "terminal", codes: tuple = SERVICE_CODES, refused: str = NONE, p: str = "", incident: str = "incident_id") -> str:
    """CTEs of traversals under all bounds, one an incident: `states` with their admission number, `paths` of their ends, `said` warnings; names begin with `p`.

    `before` is the number of a start's states of smaller depth: what a start alone has no room for is never walked.
    """
    n = limits.states
    wide, many, more, ending = codes
    return f"""
{p}page AS (SELECT *, row_number() OVER (PARTITION BY {here} ORDER BY id, {there}) AS hop, count(*) OVER (PARTITION BY {here}) AS width FROM {edges} QUALIFY hop <= {limits.fan_out}),
{p}walk(incident_id, root_id, cur, depth, node_ids, edge_ids, terminal, before, level_n) AS (
  SELECT {incident}, {root}, {root}, 0, [{root}], []::BIGINT[], false, 0::BIGINT, 1::BIGINT FROM (SELECT DISTINCT {incident}, {root} FROM {roots})
  UNION ALL
  SELECT incident_id, root_id, cur, depth, node_ids, edge_ids, terminal, before, count(*) OVER (PARTITION BY incident_id, root_id) FROM (
    SELECT * FROM (SELECT s.incident_id, s.root_id, e.{there} AS cur, s.depth + 1 AS depth, list_append(s.node_ids, e.{there}) AS node_ids, list_append(s.edge_ids, e.id) AS edge_ids, {stops} AS terminal, s.before + s.level_n AS before
      FROM {p}walk s JOIN {p}page e ON e.{here} = s.cur WHERE NOT s.terminal AND s.depth < {limits.depth} AND NOT list_contains(s.node_ids, e.{there}) AND s.before + s.level_n <= {n})
    QUALIFY before + row_number() OVER (PARTITION BY incident_id, root_id ORDER BY edge_ids) <= {n + 1} AND row_number() OVER (PARTITION BY incident_id ORDER BY root_id, edge_ids) <= {n + 1})),
{p}ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY root_id, depth, edge_ids) AS ord FROM {p}walk) WHERE ord <= {n + 1}),
{p}states AS (SELECT * FROM {p}ranked WHERE ord <= {n}),
{p}steps AS (SELECT r.incident_id, r.ord, r.cur, r.depth, r.node_ids, e.hop, e.{there} AS next, list_contains(r.node_ids, e.{there}) AS seen FROM {p}states r JOIN {p}page e ON e.{here} = r.cur WHERE NOT r.terminal),
{p}ends AS (SELECT *, min(ord) OVER (PARTITION BY incident_id, cur) AS f, row_number() OVER (PARTITION BY incident_id, cur ORDER BY ord) AS nth FROM {p}states WHERE {ends}),
{p}placed AS (SELECT *, dense_rank() OVER (PARTITION BY incident_id ORDER BY f) AS place FROM {p}ends),
{p}taken AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ord) AS total FROM {p}placed WHERE place <= {limits.ends} AND nth <= {limits.paths_per_end}),
{p}events AS (
  SELECT incident_id, 'cycle-skipped' AS code, next AS node_id, list_append(node_ids, next) AS path, ord, hop FROM {p}steps WHERE seen
  UNION ALL SELECT incident_id, 'depth-limit-reached', cur, list_append(node_ids, arg_min(next, hop)), ord, min(hop) FROM {p}steps WHERE NOT seen AND depth = {limits.depth} GROUP BY incident_id, ord, cur, node_ids
  UNION ALL SELECT incident_id, '{wide}', cur, node_ids, ord, 0 FROM {p}states WHERE NOT terminal AND cur IN (SELECT {here} FROM {p}page WHERE width > {limits.fan_out})
  UNION ALL SELECT incident_id, '{many}', cur, node_ids, ord, 0 FROM {p}placed WHERE place > {limits.ends}
  UNION ALL SELECT incident_id, '{more}', cur, node_ids, ord, 0 FROM {p}placed WHERE place <= {limits.ends} AND nth > {limits.paths_per_end}
  UNION ALL SELECT incident_id, 'path-limit-reached', cur, node_ids, ord, 0 FROM {p}taken WHERE total = {limits.paths + 1}
  UNION ALL SELECT x.incident_id, 'traversal-state-limit-reached', x.cur, x.node_ids, coalesce(p.ord, {n + 1}), coalesce(e.hop, 0) FROM {p}ranked x LEFT JOIN {p}ranked p ON x.depth > 0 AND p.incident_id = x.incident_id AND p.root_id = x.root_id AND p.depth = x.depth - 1 AND p.edge_ids = x.edge_ids[:x.depth - 1]
    LEFT JOIN {p}page e ON x.depth > 0 AND e.id = x.edge_ids[x.depth] AND e.{here} = p.cur WHERE x.ord = {n + 1}
  UNION ALL SELECT incident_id, code, node_id, []::BIGINT[], (SELECT coalesce(max(ord), 0) FROM {p}ranked r WHERE r.incident_id = z.incident_id AND r.root_id < z.node_id), node_id + 1099511627776 FROM ({refused}) z),
{p}numbered AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ord, hop, code, node_id) AS place FROM (SELECT * FROM {p}events QUALIFY row_number() OVER (PARTITION BY incident_id, code, node_id, path ORDER BY ord, hop) = 1)),
{p}stop AS (SELECT incident_id, min(place) AS place, arg_min(ord, place) AS ord FROM {p}numbered WHERE code IN ({ending}) OR place >= {limits.warnings} GROUP BY 1),
{p}said AS (SELECT n.incident_id, code, node_id, path, n.place FROM {p}numbered n LEFT JOIN {p}stop s USING (incident_id) WHERE (s.place IS NULL OR n.place <= s.place) AND n.place < {limits.warnings} UNION ALL SELECT incident_id, 'warning-limit-reached', NULL, [], {limits.warnings} FROM {p}stop WHERE place >= {limits.warnings}),
{p}paths AS (SELECT t.incident_id, root_id, cur AS service_id, depth, node_ids, edge_ids, t.ord, '[' || root_id || ',' || cur || ',' || array_to_string(edge_ids, ',') || ']' AS path_key FROM {p}taken t LEFT JOIN {p}stop s USING (incident_id) WHERE total <= {limits.paths} AND (s.ord IS NULL OR t.ord < s.ord))
"""


#: SQL condition: a warning of `said` that means something was cut.
CUT = "code NOT IN ('cycle-skipped', 'missing-node', 'unsupported-root-node', 'invalid-canonical-hop', 'missing-seed-evidence', 'unsupported-seed-kind')"


AUTHORITY = f"""
sold AS (SELECT l_suppkey, l_returnflag, l_quantity, c_mktsegment, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
relations AS (
  SELECT 'MEMBER_OF' AS kind, s_suppkey * 8 + 3 AS source_id, s_nationkey::BIGINT * 8 + 4 AS target_id, (s_suppkey * 4) * 8 + 7 AS evidence FROM supplier
  UNION ALL SELECT 'OWNS', n_nationkey::BIGINT * 8 + 4, n_regionkey::BIGINT * 8 + 5, (n_nationkey::BIGINT * 4) * 8 + 7 FROM nation
  UNION ALL SELECT 'TRIGGERS', n_regionkey::BIGINT * 8 + 5, {ID.format("'workflow:' || n_regionkey || '/' || c_mktsegment")}, (n_regionkey::BIGINT * 4) * 8 + 7 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'CAN_ACCESS', {ID.format("'workflow:' || n_regionkey || '/' || c_mktsegment")}, {ID.format("'credential:' || c_mktsegment")}, (n_regionkey::BIGINT * 4) * 8 + 7 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'CONTROLS', n_nationkey::BIGINT * 8 + 4, {ID.format("'credential:' || c_mktsegment")}, (n_nationkey::BIGINT * 4) * 8 + 7 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900
  UNION ALL SELECT 'CAN_PUBLISH', {ID.format("'credential:' || c_mktsegment")}, {ID.format("'pkg:npm:' || p_brand")}, (l_suppkey * 4) * 8 + 7 FROM sold WHERE l_returnflag = 'R' AND l_quantity = 50
  UNION ALL SELECT 'MAINTAINS', l_suppkey * 8 + 3, {ID.format("'pkg:npm:' || p_brand")}, (l_suppkey * 4) * 8 + 7 FROM sold WHERE l_returnflag = 'A' AND l_quantity = 1),
authority AS (SELECT *, {edge_id("kind", "source_id", "target_id")} AS id FROM (SELECT kind, source_id, target_id, list_sort(list(DISTINCT evidence)) AS evidence_ids FROM relations GROUP BY 1, 2, 3)),
seeds AS (SELECT s_nationkey::BIGINT * 8 + 6 AS incident_id, s_suppkey * 8 + 3 AS seed_id, [(s_suppkey * 4) * 8 + 7] AS seed_evidence FROM supplier WHERE s_acctbal < -500)
"""


def reach(limits, edges: str = "authority", seeds: str = "seeds", p: str = "a_") -> str:
    """The forward authority traversal; `a_targets` has its paths with what the last relation enables and the evidence."""
    return bounded(limits, edges, seeds, "seed_id", "source_id", "target_id", "false", "depth > 0", TARGET_CODES, p=p) + f""",
{p}targets AS (SELECT p.incident_id, p.root_id AS seed_id, p.service_id AS target_id, p.depth, p.edge_ids, any_value(e.kind) FILTER (e.id = p.edge_ids[len(p.edge_ids)]) AS last_kind, list_sort(list_distinct(flatten(list(e.evidence_ids)) || any_value(s.seed_evidence))) AS evidence_ids
  FROM {p}paths p JOIN {seeds} s ON s.seed_id = p.root_id AND s.incident_id = p.incident_id, unnest(p.edge_ids) u(edge_id) JOIN {edges} e ON e.id = u.edge_id GROUP BY 1, 2, 3, 4, 5)
"""


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select
