"""Queries over the organisation: hierarchy, quotas, commits and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import commit as C
from ..operators import hierarchy as H
from ..operators import pipeline as P
from ..operators import quota as Q
from ..sources import adapters as A

TARGET = 100_000_000.0
HEDGE = 1.05
NODE_HEDGE = {"EUROPE": 1.1, "ASIA": 1.02, "NATION_3": 1.2}
OVERRIDES = {"Customer#000000001": 500_000.0, "Customer#000000010": 250_000.0, "Customer#000000042": 0.0}
THRESHOLDS = {"EUROPE": (2.5, 1.2), "ASIA": (1.5, 0.8), "AMERICA": (0.06, 0.03), "NATION_7": (0.05, 0.02), "_default": (0.04, 0.02)}
LOCKS = {"Customer#000000002": 40_000.0, "Customer#000000003": 55_000.0}
LOCK_SET = {"Customer#000000004", "Customer#000000005"}


def _org(spark: SparkSession, d: str) -> DataFrame:
    org = A.organisation(spark, d)
    return org.withColumn("capacity", Q.leaf_capacity(Q.attainment_columns(org)))


def _stored_org(spark: SparkSession, d: str) -> DataFrame:
    """The organisation, made from its tables once for all parts of a query."""
    return written(_org(spark, d), "organisation")


def _quotas(spark: SparkSession, d: str, **more) -> DataFrame:
    return Q.cascade(_stored_org(spark, d), A.PATH, TARGET, **more)


def _money(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _jagged(spark: SparkSession, d: str) -> DataFrame:
    org = A.organisation(spark, d)
    return org.withColumn("Team", F.when(~F.col("IC").endswith("7"), F.col("Team")))


def hierarchy_edges(spark, d):
    return H.edges(A.organisation(spark, d), A.PATH)


def hierarchy_nodes(spark, d):
    n = H.nodes(H.edges(A.organisation(spark, d), A.PATH))
    edge_count = F.col("nodes") - F.col("roots")
    return n.agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.count_if("is_root").alias("roots")).withColumn("edges", edge_count)


def hierarchy_leaf_metrics(spark, d):
    return H.leaf_metrics(A.organisation(spark, d), A.PATH, ["Current_Pipeline"]).withColumn("Current_Pipeline", F.round("Current_Pipeline", 2))


def hierarchy_children(spark, d):
    return H.children(H.edges(A.organisation(spark, d), A.PATH), "ASIA")


def hierarchy_leaves(spark, d):
    return H.leaves(H.edges(A.organisation(spark, d), A.PATH), "ASIA")


def hierarchy_levels(spark, d):
    return H.levels(H.edges(A.organisation(spark, d), A.PATH))


def hierarchy_managers(spark, d):
    return H.managers(H.edges(A.organisation(spark, d), A.PATH))


def hierarchy_jagged(spark, d):
    return H.edges(_jagged(spark, d), A.PATH)


def hierarchy_compact(spark, d):
    return H.edges(_jagged(spark, d), A.PATH, "compact")


def leaf_capacity(spark, d):
    return _money(_org(spark, d).select("IC", "capacity"), "capacity")


def supplier_capacity(spark, d):
    s = A.suppliers(spark, d)
    return s.select("IC", F.round(Q.leaf_capacity(Q.attainment_columns(s)), 2).alias("capacity"))


def capacity_rollup(spark, d):
    return _money(Q.capacity_rollup(_org(spark, d), A.PATH), "capacity", digits=1)


def cascade_flat(spark, d):
    return _money(_quotas(spark, d), "quota")


def cascade_hedged(spark, d):
    return _money(_quotas(spark, d, hedge=HEDGE), "quota")


def cascade_node_hedge(spark, d):
    return _money(_quotas(spark, d, hedge=NODE_HEDGE), "quota")


def cascade_overrides(spark, d):
    return _money(_quotas(spark, d, hedge=HEDGE, overrides=OVERRIDES), "quota")


def cascade_subtree(spark, d):
    return _money(_quotas(spark, d, root="ASIA"), "quota")


def cascade_graph(spark, d):
    org = _org(spark, d)
    caps = org.select(F.col("IC").alias("node"), "capacity")
    return _money(Q.cascade_graph(H.edges(org, A.PATH), caps, TARGET, "Global_Corp", HEDGE, OVERRIDES), "quota", digits=1)


def _compact_org(spark, d):
    """The stored organisation, its jagged edges without gaps, and its leaves."""
    org = _stored_org(spark, d)
    jagged = org.withColumn("Team", F.when(~F.col("IC").endswith("7"), F.col("Team")))
    leaf = org.select(F.col("IC").alias("node"), "capacity", F.col("Current_Pipeline").alias("pipeline"))
    return org, written(H.edges(jagged, A.PATH, "compact"), "edges"), leaf


def _shared_org(spark, d):
    """As ``_compact_org``; besides, each nation has a desk for the customers that end in
    3, and the desk a pod for those that end in 33, so these have several parents."""
    org, links, leaf = _compact_org(spark, d)
    desk, pod = F.concat(F.lit("Desk/"), F.col("Nation")), F.concat(F.lit("Pod/"), F.col("Nation"))
    more = [("3", F.col("Nation"), desk), ("3", desk, F.col("IC")), ("33", desk, pod), ("33", pod, F.col("IC"))]
    for end, parent, child in more:
        links = links.union(org.where(F.col("IC").endswith(end)).select(parent, child))
    return org, written(links.distinct(), "edges"), leaf


def cascade_dag(spark, d):
    _, links, leaf = _shared_org(spark, d)
    return _money(Q.cascade_graph(links, leaf, TARGET, "Global_Corp", HEDGE, OVERRIDES), "quota", digits=1)


def hierarchy_order(spark, d):
    return H.topological(_shared_org(spark, d)[1])


def hierarchy_rollup(spark, d):
    _, links, leaf = _shared_org(spark, d)
    return _money(_money(H.rolled_up(links, leaf, ["capacity", "pipeline"]), "capacity", digits=1), "pipeline")


def hierarchy_merge(spark, d):
    """Attributes of users as nodes, told one event after another."""
    e = A.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("node"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_action"))
    return H.merge_attributes(rows, "at")


def diagnose_graph(spark, d):
    _, links, leaf = _compact_org(spark, d)
    quotas = written(Q.cascade_graph(links, leaf, TARGET, "Global_Corp", HEDGE), "quotas")
    return P.diagnose_graph(links, leaf, quotas, THRESHOLDS)


def adjust_graph(spark, d):
    _, links, leaf = _compact_org(spark, d)
    quotas = written(Q.cascade_graph(links, leaf, TARGET, "Global_Corp"), "quotas")
    return _money(P.adjust_graph(links, leaf, quotas, THRESHOLDS, "redistribute", 0.2, LOCKS), "quota", "adjusted")


def overassignment(spark, d):
    out = Q.over_assignment(_quotas(spark, d, hedge=HEDGE), 4, TARGET)
    return out.select(F.round("leaf_total", 1).alias("leaf_total"), F.round("over_pct", 6).alias("over_pct"))


def bias_quotient(spark, d):
    return _money(C.bias(A.commits(spark, d)), "bias", digits=6)


def bias_labels(spark, d):
    return C.bias(A.commits(spark, d)).select(C.label(F.col("bias")).alias("label")).groupBy("label").agg(F.count("*").alias("managers"))


def _reconciled(spark, d, machine):
    history = A.commits(spark, d, "customer")
    known = C.bias(history.where("Historical_Commit IS NOT NULL"))
    return _money(_money(C.reconcile(history, known, machine=machine), "commit"), "bias", "forecast", digits=4)


def reconcile_human(spark, d):
    return _reconciled(spark, d, None)


def reconcile_blend(spark, d):
    return _reconciled(spark, d, "Machine_Forecast")


def pipeline_rollup(spark, d):
    return P.node_paths(A.organisation(spark, d), A.PATH).select("node", "level", F.round("pipeline", 2).alias("pipeline"))


def threshold_inheritance(spark, d):
    steps = [F.try_element_at("steps", F.lit(i)) for i in range(1, 6)]
    healthy, at_risk = P.inherited(steps, THRESHOLDS)
    return P.node_paths(A.organisation(spark, d), A.PATH).select("node", "level", healthy.alias("healthy"), at_risk.alias("at_risk"))


def _diagnosis(spark, d):
    org = _stored_org(spark, d)
    return P.diagnose(org, A.PATH, Q.cascade(org, A.PATH, TARGET, HEDGE), THRESHOLDS)


def diagnose(spark, d):
    return _diagnosis(spark, d)


def risk_summary(spark, d):
    return _money(_money(P.risk_summary(_diagnosis(spark, d)), "quota", "pipeline"), "mean_coverage", digits=5)


def _adjusted(spark, d, mode, locks=None):
    org = _stored_org(spark, d)
    quotas = written(Q.cascade(org, A.PATH, TARGET), "quotas")
    return P.adjust(org, A.PATH, quotas, THRESHOLDS, mode, 0.2, locks)


def adjust_flag_only(spark, d):
    return _money(_adjusted(spark, d, "flag_only", LOCKS | {"ASIA": 1.0}), "quota", "adjusted")


def adjust_redistribute(spark, d):
    return _money(_adjusted(spark, d, "redistribute"), "quota", "adjusted")


def adjust_locked(spark, d):
    return _money(_adjusted(spark, d, "redistribute", LOCKS), "quota", "adjusted")


def adjust_lock_set(spark, d):
    return _money(_adjusted(spark, d, "redistribute", LOCK_SET), "quota", "adjusted")


def zero_sum_check(spark, d):
    teams = A.organisation(spark, d).select(F.col("IC").alias("node"), F.col("Team").alias("team"))
    return _money(_money(P.zero_sum(_adjusted(spark, d, "redistribute"), teams), "before", "after"), "most_moved", digits=6)


def top_movers(spark, d):
    return _money(P.top_movers(_adjusted(spark, d, "redistribute"), 4), "quota", "adjusted")


QUERIES = {
    f.__name__: f
    for f in (
        hierarchy_edges, hierarchy_nodes, hierarchy_leaf_metrics, hierarchy_children, hierarchy_leaves, hierarchy_levels, hierarchy_managers, hierarchy_jagged, hierarchy_compact,
        leaf_capacity, supplier_capacity, capacity_rollup, cascade_flat, cascade_hedged, cascade_node_hedge, cascade_overrides, cascade_subtree, cascade_graph, cascade_dag, overassignment,
        hierarchy_order, hierarchy_rollup, hierarchy_merge, diagnose_graph, adjust_graph,
        bias_quotient, bias_labels, reconcile_human, reconcile_blend, pipeline_rollup, threshold_inheritance, diagnose, risk_summary,
        adjust_flag_only, adjust_redistribute, adjust_locked, adjust_lock_set, zero_sum_check, top_movers,
    )
}

# --- DuckDB twins -------------------------------------------------------------------

_Q = [f"'{q}'" for q in A.QUARTERS]
ORG = f"""
    att AS (SELECT o_custkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL),
    cap AS (SELECT o_custkey, 8 * sum(v) / count(*) AS capacity FROM att WHERE q IN ({', '.join(_Q)}) AND v > 0 GROUP BY ALL),
    pipe AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS pipeline FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
    org AS (SELECT 'Global_Corp' AS l0, r_name AS l1, n_name AS l2, n_name || '/' || c_mktsegment AS l3, c_name AS l4, coalesce(capacity, 0) AS cap, coalesce(pipeline, 0) AS pipeline
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN cap ON cap.o_custkey = c_custkey LEFT JOIN pipe ON pipe.o_custkey = c_custkey)"""
_EDGES = "SELECT DISTINCT parent, child FROM (SELECT l0 AS parent, l1 AS child FROM {o} UNION ALL SELECT l1, l2 FROM {o} UNION ALL SELECT l2, l3 FROM {o} UNION ALL SELECT l3, l4 FROM {o}) WHERE parent IS NOT NULL AND child IS NOT NULL"
_JAG = "jag AS (SELECT l0, l1, l2, CASE WHEN l4 NOT LIKE '%7' THEN l3 END AS l3, l4 FROM org)"


def _case(column: str, values: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + f" ELSE {default} END" if values else default


def _cascade(hedge: float | dict = 1.0, overrides: dict | None = None) -> str:
    f = lambda i: _case(f"p.l{i}", hedge, "1.0") if isinstance(hedge, dict) else str(hedge)
    out = [ORG]
    for i in range(1, 4):
        names = ", ".join(f"l{k}" for k in range(i + 1))
        out.append(f"a{i} AS (SELECT {names}, sum(cap) AS cap FROM org GROUP BY ALL)")
    out.append(f"q0 AS (SELECT 'Global_Corp' AS l0, CAST({TARGET} AS DOUBLE) AS quota)")
    for i in range(1, 4):
        on = " AND ".join(f"a.l{k} = p.l{k}" for k in range(i))
        cols = ", ".join(f"a.l{k}" for k in range(i + 1))
        by = ", ".join(f"a.l{k}" for k in range(i))
        out.append(f"q{i} AS (SELECT {cols}, p.quota * {f(i - 1)} * CASE WHEN sum(a.cap) OVER w > 0 THEN a.cap / sum(a.cap) OVER w ELSE 1.0 / count(*) OVER w END AS quota FROM a{i} a JOIN q{i - 1} p ON {on} WINDOW w AS (PARTITION BY {by}))")
    over = _case("a.l4", overrides or {}, "CAST(NULL AS DOUBLE)")
    out.append(f"t4 AS (SELECT a.*, p.quota * {f(3)} AS pool, {over} AS ov FROM org a JOIN q3 p ON a.l3 = p.l3)")
    out.append("s4 AS (SELECT *, count(*) OVER w AS n, coalesce(sum(ov) OVER w, 0) AS taken, count(*) FILTER (ov IS NULL AND cap = 0) OVER w AS fresh, sum(cap) FILTER (ov IS NULL AND cap > 0) OVER w AS weight FROM t4 WINDOW w AS (PARTITION BY l3))")
    out.append("q4 AS (SELECT l0, l1, l2, l3, l4, pipeline, CASE WHEN ov IS NOT NULL THEN ov WHEN cap = 0 THEN pool / n ELSE (pool - taken - pool / n * fresh) * (cap / weight) END AS quota FROM s4)")
    out.append("quotas AS (SELECT l0 AS node, 0 AS level, quota FROM q0 UNION ALL SELECT l1, 1, quota FROM q1 UNION ALL SELECT l2, 2, quota FROM q2 UNION ALL SELECT l3, 3, quota FROM q3 UNION ALL SELECT l4, 4, quota FROM q4)")
    return "WITH " + ",\n".join(out)


_ALL = "SELECT node, level, round(quota, 2) AS quota FROM quotas"
_COMMITS = """
    m AS (SELECT c_custkey, {name} AS manager FROM customer JOIN nation ON c_nationkey = n_nationkey),
    h AS (SELECT manager, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1999) AS DOUBLE) AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 2000) AS DOUBLE) AS a,
                 coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 2001) AS DOUBLE), 0) AS now FROM m LEFT JOIN orders ON o_custkey = c_custkey GROUP BY manager),
    b AS (SELECT manager, CASE WHEN c > 0 THEN coalesce(a, 0) / c ELSE 1.0 END AS bias FROM h {only})"""
_TEAM = _COMMITS.format(name="n_name || '/' || c_mktsegment", only="")
_CUST = _COMMITS.format(name="c_name", only="WHERE c IS NOT NULL")


def _inherit(k: int, columns: list[str]) -> str:
    own = {n: v[k] for n, v in THRESHOLDS.items() if n != "_default"}
    return "coalesce(" + ", ".join(_case(c, own, "NULL") for c in columns) + f", {THRESHOLDS['_default'][k]})"


_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT l{i} AS node, {i} AS level, {', '.join(f'l{k}' if k <= i else f'NULL AS l{k}' for k in range(5))}, sum(pipeline) AS pipeline FROM org GROUP BY {', '.join(f'l{k}' for k in range(i + 1))}" for i in range(5)) + ")"
_LIMITS = f"limits AS (SELECT *, {_inherit(0, ['l4', 'l3', 'l2', 'l1', 'l0'])} AS healthy, {_inherit(1, ['l4', 'l3', 'l2', 'l1', 'l0'])} AS at_risk FROM nodes)"
_DIAG = f"""{_cascade(HEDGE)}, {_NODES}, {_LIMITS},
    d0 AS (SELECT l.node, l.level, quota, pipeline, CASE WHEN quota > 0 THEN pipeline / quota ELSE 0 END AS cov, healthy, at_risk FROM limits l JOIN quotas q ON l.node = q.node AND l.level = q.level),
    diag AS (SELECT node AS "Node", level AS "Level", round(quota, 2) AS "Cascaded_Quota", round(pipeline, 2) AS "Pipeline", round(cov, 4) AS "Coverage_Ratio", healthy AS "Healthy_Threshold", at_risk AS "At_Risk_Threshold",
                    CASE WHEN cov >= healthy THEN 'Healthy' WHEN cov >= at_risk THEN 'Moderate' WHEN cov >= 1.0 THEN 'At Risk' ELSE 'Critical' END AS "Risk_Status" FROM d0)"""


def _adjust(locks: dict | set | None = None) -> str:
    amounts = locks if isinstance(locks, dict) else {}
    names = ", ".join(f"'{n}'" for n in sorted(locks)) if locks else "''"
    return f"""{_cascade()}, {_NODES}, {_LIMITS},
    st AS (SELECT node, level, quota, coalesce({_case('node', amounts, 'NULL')}, quota) AS q FROM quotas),
    lf AS (SELECT s.node, s.level, s.quota, s.q, l.l3, l.pipeline, l.healthy, l.at_risk, s.node NOT IN ({names}) AS free, CASE WHEN s.q > 0 THEN l.pipeline / s.q ELSE 0 END AS cov FROM st s JOIN limits l ON l.node = s.node AND l.level = s.level WHERE s.level = 4),
    gn AS (SELECT *, CASE WHEN free AND cov >= healthy THEN greatest(0, least(q * 0.2, q * ((cov - healthy) / cov))) END AS give, CASE WHEN free AND cov < at_risk THEN CASE WHEN cov > 0 THEN greatest(0, (at_risk - cov) / at_risk) ELSE 1.0 END END AS need FROM lf),
    sm AS (SELECT *, sum(give) OVER w AS s, sum(need) OVER w AS n, count(*) FILTER (free) OVER w AS members FROM gn WINDOW w AS (PARTITION BY l3)),
    ic AS (SELECT *, coalesce(members >= 2 AND s > 0 AND n > 0, false) AS works, CASE WHEN members >= 2 AND s > 0 AND n > 0 AND need IS NOT NULL THEN least(s * (need / n), q * 0.2) END AS inc FROM sm),
    dd AS (SELECT *, sum(inc) OVER (PARTITION BY l3) AS d FROM ic),
    adj AS (SELECT node, level, quota, CASE WHEN works AND give IS NOT NULL THEN q - give * (d / s) WHEN inc IS NOT NULL THEN q + inc ELSE q END AS adjusted, l3 AS team FROM dd
            UNION ALL SELECT node, level, quota, q, NULL FROM st WHERE level < 4)"""


_ADJ = "SELECT node, level, round(quota, 2) AS quota, round(adjusted, 2) AS adjusted FROM adj"
_PCT = "mv AS (SELECT node, quota, adjusted, round((adjusted - quota) / quota * 100, 4) AS pct FROM adj WHERE level = 4 AND quota > 0)"

_MARKS = ", ".join(f"'{n}'" for n in THRESHOLDS if n != "_default")
_COMPACT = "SELECT DISTINCT parent, child FROM (SELECT l0 AS parent, l1 AS child FROM jag UNION ALL SELECT l1, l2 FROM jag UNION ALL SELECT l2, coalesce(l3, l4) FROM jag UNION ALL SELECT l3, l4 FROM jag) WHERE parent IS NOT NULL"
_SHARED = f"""SELECT DISTINCT parent, child FROM ({_COMPACT} UNION ALL SELECT l2, 'Desk/' || l2 FROM org WHERE l4 LIKE '%3' UNION ALL SELECT 'Desk/' || l2, l4 FROM org WHERE l4 LIKE '%3'
              UNION ALL SELECT 'Desk/' || l2, 'Pod/' || l2 FROM org WHERE l4 LIKE '%33' UNION ALL SELECT 'Pod/' || l2, l4 FROM org WHERE l4 LIKE '%33')"""


def _graph(links: str, hedge: float = 1.0, overrides: dict | None = None) -> str:
    """CTEs for a graph: e, kinds, sums (per way), gen, and quotas (last parent wins)."""
    return f"""WITH RECURSIVE {ORG}, {_JAG}, e AS MATERIALIZED ({links}),
    kinds AS MATERIALIZED (SELECT node, node NOT IN (SELECT parent FROM e) AS is_leaf, node NOT IN (SELECT child FROM e) AS is_root FROM (SELECT parent AS node FROM e UNION SELECT child FROM e)),
    up AS (SELECT node, cap, pipeline AS pipe FROM kinds JOIN org ON node = l4 WHERE is_leaf UNION ALL SELECT e.parent, up.cap, up.pipe FROM up JOIN e ON e.child = up.node),
    sums AS MATERIALIZED (SELECT node, sum(cap) AS cap, sum(pipe) AS pipe FROM up GROUP BY node),
    walk AS (SELECT node, 0 AS g FROM kinds WHERE is_root UNION ALL SELECT e.child, g + 1 FROM walk JOIN e ON e.parent = walk.node),
    gen AS MATERIALIZED (SELECT node, max(g) AS generation, min(g) AS level FROM walk GROUP BY node),
    mem AS (SELECT e.parent, e.child, s.cap, bool_and(k.is_leaf) OVER (PARTITION BY e.parent) AS whole, {_case('e.child', overrides or {}, 'CAST(NULL AS DOUBLE)')} AS given FROM e JOIN sums s ON s.node = e.child JOIN kinds k ON k.node = e.child),
    mo AS (SELECT *, CASE WHEN whole THEN given END AS ov, whole AND (CASE WHEN whole THEN given END) IS NULL AND cap = 0 AS fresh FROM mem),
    su AS (SELECT *, count(*) OVER w AS n, sum(cap) OVER w AS total, count(*) FILTER (fresh) OVER w AS nf, coalesce(sum(ov) OVER w, 0) AS taken, sum(cap) FILTER (ov IS NULL AND NOT fresh) OVER w AS weight FROM mo WINDOW w AS (PARTITION BY parent)),
    sh AS (SELECT *, CASE WHEN whole THEN coalesce(cap / nullif(weight, 0), 0) WHEN total > 0 THEN cap / total ELSE 1.0 / n END AS share FROM su),
    co AS (SELECT parent, child, {hedge} * CASE WHEN ov IS NOT NULL THEN 0 WHEN fresh THEN 1.0 / n ELSE share * (1 - nf / n) END AS a, CASE WHEN ov IS NOT NULL THEN ov WHEN fresh THEN 0 ELSE -share * taken END AS b FROM sh),
    win AS MATERIALIZED (SELECT co.* FROM co JOIN gen ON gen.node = co.parent QUALIFY row_number() OVER (PARTITION BY child ORDER BY generation DESC, parent DESC) = 1),
    down AS (SELECT 'Global_Corp' AS node, CAST({TARGET} AS DOUBLE) AS quota UNION ALL SELECT w.child, d.quota * w.a + w.b FROM down d JOIN win w ON w.parent = d.node),
    first_up AS MATERIALIZED (SELECT child, min(parent) AS parent FROM e GROUP BY child),
    climb AS (SELECT node, node AS spot FROM kinds UNION ALL SELECT c.node, f.parent FROM climb c JOIN first_up f ON f.child = c.spot WHERE c.spot NOT IN ({_MARKS})),
    limits AS MATERIALIZED (SELECT k.node, coalesce(max({_case('spot', {n: v[0] for n, v in THRESHOLDS.items() if n != '_default'}, 'NULL')}), {THRESHOLDS['_default'][0]}) AS healthy, coalesce(max({_case('spot', {n: v[1] for n, v in THRESHOLDS.items() if n != '_default'}, 'NULL')}), {THRESHOLDS['_default'][1]}) AS at_risk
               FROM kinds k LEFT JOIN climb c ON c.node = k.node AND c.spot IN ({_MARKS}) GROUP BY k.node)"""


_TEAMS = f"""{_graph(_COMPACT)},
    bosses AS (SELECT e.parent AS team FROM e JOIN kinds k ON k.node = e.child GROUP BY e.parent HAVING bool_and(is_leaf)),
    st AS (SELECT node, quota, coalesce({_case('node', LOCKS, 'NULL')}, quota) AS q FROM down),
    lf AS (SELECT b.team, st.node, st.quota, st.q, pipe AS pipeline, healthy, at_risk, st.node NOT IN ({', '.join(f"'{n}'" for n in LOCKS)}) AS free, CASE WHEN q > 0 THEN pipe / q ELSE 0 END AS cov FROM bosses b JOIN e ON e.parent = b.team JOIN st ON st.node = e.child JOIN sums s ON s.node = st.node JOIN limits l ON l.node = st.node),
    gn AS (SELECT *, CASE WHEN free AND cov >= healthy THEN greatest(0, least(q * 0.2, q * ((cov - healthy) / cov))) END AS give, CASE WHEN free AND cov < at_risk THEN CASE WHEN cov > 0 THEN greatest(0, (at_risk - cov) / at_risk) ELSE 1.0 END END AS need FROM lf),
    sm AS (SELECT *, sum(give) OVER w AS s, sum(need) OVER w AS n, count(*) FILTER (free) OVER w AS members FROM gn WINDOW w AS (PARTITION BY team)),
    ic AS (SELECT *, coalesce(members >= 2 AND s > 0 AND n > 0, false) AS works, CASE WHEN members >= 2 AND s > 0 AND n > 0 AND need IS NOT NULL THEN least(s * (need / n), q * 0.2) END AS inc FROM sm),
    dd AS (SELECT *, sum(inc) OVER (PARTITION BY team) AS d FROM ic)
    SELECT st.node, round(st.quota, 2) AS quota, round(CASE WHEN works AND give IS NOT NULL THEN dd.q - give * (d / s) WHEN inc IS NOT NULL THEN dd.q + inc ELSE st.q END, 2) AS adjusted FROM st LEFT JOIN dd ON dd.node = st.node"""

ORACLE_SQL = {
    "cascade_dag": f"{_graph(_SHARED, HEDGE, OVERRIDES)} SELECT node, round(quota, 1) AS quota FROM down",
    "hierarchy_order": f"{_graph(_SHARED)} SELECT node, generation, row_number() OVER (ORDER BY generation, node) - 1 AS place FROM gen",
    "hierarchy_rollup": f"{_graph(_SHARED)} SELECT node, round(cap, 1) AS capacity, round(pipe, 2) AS pipeline FROM sums",
    "hierarchy_merge": "SELECT user_id AS node, arg_max(value, event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS last_purchase, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS last_action FROM events GROUP BY user_id",
    "diagnose_graph": f"""{_graph(_COMPACT, HEDGE)}, c AS (SELECT d.node, level, quota, pipe, CASE WHEN quota > 0 THEN pipe / quota ELSE 0 END AS cov, healthy, at_risk FROM down d JOIN sums USING (node) JOIN gen USING (node) JOIN limits USING (node))
        SELECT node AS "Node", level AS "Level", round(quota, 2) AS "Cascaded_Quota", round(pipe, 2) AS "Pipeline", round(cov, 4) AS "Coverage_Ratio", healthy AS "Healthy_Threshold", at_risk AS "At_Risk_Threshold",
               CASE WHEN cov >= healthy THEN 'Healthy' WHEN cov >= at_risk THEN 'Moderate' WHEN cov >= 1.0 THEN 'At Risk' ELSE 'Critical' END AS "Risk_Status" FROM c""",
    "adjust_graph": _TEAMS,
    "hierarchy_edges": f"WITH {ORG} {_EDGES.format(o='org')}",
    "hierarchy_nodes": f"WITH {ORG}, e AS ({_EDGES.format(o='org')}), n AS (SELECT parent AS node FROM e UNION SELECT child FROM e) SELECT count(*) AS nodes, count(*) FILTER (node NOT IN (SELECT parent FROM e)) AS leaves, count(*) FILTER (node NOT IN (SELECT child FROM e)) AS roots, (SELECT count(*) FROM e) AS edges FROM n",
    "hierarchy_leaf_metrics": f'WITH {ORG} SELECT l4 AS node, round(pipeline, 2) AS "Current_Pipeline" FROM org',
    "hierarchy_children": f"WITH {ORG}, e AS ({_EDGES.format(o='org')}) SELECT child AS node FROM e WHERE parent = 'ASIA'",
    "hierarchy_leaves": f"WITH {ORG} SELECT DISTINCT l4 AS node FROM org WHERE l1 = 'ASIA'",
    "hierarchy_levels": f"WITH {ORG} SELECT DISTINCT unnest([l0, l1, l2, l3, l4]) AS node, unnest([0, 1, 2, 3, 4]) AS level FROM org",
    "hierarchy_managers": f"WITH {ORG} SELECT l3 AS node, count(DISTINCT l4) AS team_size FROM org GROUP BY l3",
    "hierarchy_jagged": f"WITH {ORG}, {_JAG} {_EDGES.format(o='jag')}",
    "hierarchy_compact": f"WITH {ORG}, {_JAG} SELECT DISTINCT parent, child FROM (SELECT l0 AS parent, l1 AS child FROM jag UNION ALL SELECT l1, l2 FROM jag UNION ALL SELECT l2, coalesce(l3, l4) FROM jag UNION ALL SELECT l3, l4 FROM jag) WHERE parent IS NOT NULL",
    "leaf_capacity": f'WITH {ORG} SELECT l4 AS "IC", round(cap, 2) AS capacity FROM org',
    "supplier_capacity": f"WITH a AS (SELECT l_suppkey, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey, 8 * sum(v) / count(*) AS capacity FROM a WHERE q IN ({', '.join(_Q)}) AND v > 0 GROUP BY ALL) SELECT s_name AS \"IC\", round(coalesce(capacity, 0), 2) AS capacity FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey",
    "capacity_rollup": f"WITH {ORG} " + " UNION ALL ".join(f"SELECT l{i} AS node, {i} AS level, round(sum(cap), 1) AS capacity FROM org GROUP BY {', '.join(f'l{k}' for k in range(i + 1))}" for i in range(5)),
    "cascade_flat": f"{_cascade()} {_ALL}",
    "cascade_hedged": f"{_cascade(HEDGE)} {_ALL}",
    "cascade_node_hedge": f"{_cascade(NODE_HEDGE)} {_ALL}",
    "cascade_overrides": f"{_cascade(HEDGE, OVERRIDES)} {_ALL}",
    "cascade_subtree": f"{_cascade()}, part AS (SELECT l1 AS node, 1 AS level, quota, l1 FROM q1 UNION ALL SELECT l2, 2, quota, l1 FROM q2 UNION ALL SELECT l3, 3, quota, l1 FROM q3 UNION ALL SELECT l4, 4, quota, l1 FROM q4) SELECT node, level, round(quota / (SELECT quota FROM q1 WHERE l1 = 'ASIA') * {TARGET}, 2) AS quota FROM part WHERE l1 = 'ASIA'",
    "cascade_graph": f"{_cascade(HEDGE, OVERRIDES)} SELECT node, round(quota, 1) AS quota FROM quotas",
    "overassignment": f"{_cascade(HEDGE)} SELECT round(sum(quota), 1) AS leaf_total, round(sum(quota) / {TARGET} - 1, 6) AS over_pct FROM q4",
    "bias_quotient": f"WITH {_TEAM} SELECT manager, round(bias, 6) AS bias FROM b",
    "bias_labels": f"WITH {_TEAM} SELECT CASE WHEN bias > 1.05 THEN 'Sandbagger' WHEN bias < 0.95 THEN 'Happy Ears' ELSE 'Neutral' END AS label, count(*) AS managers FROM b GROUP BY 1",
    "reconcile_human": f"WITH {_CUST} SELECT h.manager, round(now, 2) AS \"commit\", round(coalesce(bias, 1.0), 4) AS bias, round(now * coalesce(bias, 1.0), 4) AS forecast FROM h LEFT JOIN b USING (manager)",
    "reconcile_blend": f"WITH {_CUST} SELECT h.manager, round(now, 2) AS \"commit\", round(coalesce(bias, 1.0), 4) AS bias, round(CASE WHEN coalesce(c, a) IS NULL THEN now * coalesce(bias, 1.0) ELSE (now * coalesce(bias, 1.0) + (coalesce(c, 0) + coalesce(a, 0)) / 2) / 2 END, 4) AS forecast FROM h LEFT JOIN b USING (manager)",
    "pipeline_rollup": f"WITH {ORG}, {_NODES} SELECT node, level, round(pipeline, 2) AS pipeline FROM nodes",
    "threshold_inheritance": f"WITH {ORG}, {_NODES}, {_LIMITS} SELECT node, level, healthy, at_risk FROM limits",
    "diagnose": f"{_DIAG} SELECT * FROM diag",
    "risk_summary": f'{_DIAG} SELECT "Risk_Status", count(*) AS nodes, round(sum("Cascaded_Quota"), 2) AS quota, round(sum("Pipeline"), 2) AS pipeline, round(avg("Coverage_Ratio"), 5) AS mean_coverage FROM diag GROUP BY 1',
    "adjust_flag_only": f"{_cascade()} SELECT node, level, round(quota, 2) AS quota, round(coalesce({_case('node', LOCKS | {'ASIA': 1.0}, 'NULL')}, quota), 2) AS adjusted FROM quotas",
    "adjust_redistribute": f"{_adjust()} {_ADJ}",
    "adjust_locked": f"{_adjust(LOCKS)} {_ADJ}",
    "adjust_lock_set": f"{_adjust(LOCK_SET)} {_ADJ}",
    "zero_sum_check": f"{_adjust()}, z AS (SELECT team, sum(quota) AS before, sum(adjusted) AS after, max(CASE WHEN quota > 0 THEN abs(adjusted - quota) / quota ELSE 0 END) AS most FROM adj WHERE level = 4 GROUP BY team) SELECT team, round(before, 2) AS before, round(after, 2) AS after, round(most, 6) AS most_moved, abs(before - after) <= 1.0 AND most <= 0.201 AS ok FROM z",
    "top_movers": f"{_adjust()}, {_PCT} (SELECT node, round(quota, 2) AS quota, round(adjusted, 2) AS adjusted, pct, 'down' AS side FROM mv ORDER BY pct, node LIMIT 3) UNION ALL (SELECT node, round(quota, 2), round(adjusted, 2), pct, 'up' FROM mv ORDER BY pct DESC, node LIMIT 3)",
}
