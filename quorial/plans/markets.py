"""Queries over territories, contracts and churn."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from ..functions.tables import shared_folder, written
from ..operators import contracts as K
from ..operators import learning as L
from ..operators import survival as S
from ..operators import territory as T
from ..sources import adapters as A
from ..sources import readers as R
from ..sources.paged import read_paged, write_pages

TAXONOMY = ["Region", "Account_Segment"]
TERRITORIES = 3
ROLES = {"AE": 1.0, "SE": 2.0, "BDR": 0.5, "VP": 5.0}
LOCKS = {"Customer#000000001": "Named_Accounts", "Customer#000000002": "ASIA_FURNITURE_Territory_3"}
RESELLERS = ["#000000001", "#000000002", "#00000001"]
DEFENSE = ["NATION_1", "NATION_2"]
#: The moves of ``move_account``.
MOVES = [("Customer#000000001", "ASIA_BUILDING_Territory_1"), ("Customer#000000003", "ASIA_BUILDING_Territory_1"), ("Customer#000000003", "EUROPE_BUILDING_Territory_1")]


def _assigned(spark, d):
    return T.allocate(A.accounts(spark, d), TAXONOMY, TERRITORIES)


def _static(spark, d):
    """Accounts dealt to two territories in each bucket by hash, without the allocator."""
    place = F.concat(F.concat_ws("_", *TAXONOMY), F.lit("_Territory_"), (F.ascii(F.substring(F.md5("Account_ID"), 1, 1)) % 2 + 1).cast("string"))
    return A.accounts(spark, d).withColumn("Territory_ID", place)


def taxonomy_summary(spark, d):
    return T.bucket_summary(A.accounts(spark, d), TAXONOMY)


def taxonomy_bucket(spark, d):
    return T.bucket(A.accounts(spark, d), TAXONOMY, ("ASIA", "BUILDING")).select("Account_ID", "bucket", "Estimated_TAM")


def territory_allocate(spark, d):
    return _assigned(spark, d).select("Account_ID", "Estimated_TAM", "Territory_ID")


def territory_allocate_locked(spark, d):
    return T.allocate(A.accounts(spark, d), TAXONOMY, TERRITORIES, locks=LOCKS).select("Account_ID", "Estimated_TAM", "Territory_ID")


def territory_balance(spark, d):
    b = T.balance(_static(spark, d))
    return b.select("Territory_ID", "accounts", "total", *[F.round(c, 4).alias(c) for c in ("mean", "variance", "variance_pct")])


def imbalance(spark, d):
    b = T.balance(_static(spark, d), prefix="ASIA_")
    return b.select("Territory_ID", "accounts", "total", *[F.round(c, 4).alias(c) for c in ("mean", "variance", "variance_pct")])


def seller_assignments(spark, d):
    return T.staff(_static(spark, d), ROLES)


def territory_roster(spark, d):
    return T.roster(T.staff(_static(spark, d), ROLES), list(ROLES))


def export_hierarchy(spark, d):
    return T.export_hierarchy(T.roster(T.staff(_static(spark, d), ROLES), list(ROLES)), ["VP", "SE", "AE"])


def move_account(spark, d):
    moved, _ = T.move_accounts(_static(spark, d), MOVES)
    return moved.select("Account_ID", "Territory_ID")


def move_history(spark, d):
    return T.move_accounts(_static(spark, d), MOVES)[1]


def _ends(spark, d):
    """The territories with the most and the least, for the suggestions."""
    sums = T.balance(_static(spark, d))
    a = sums.orderBy(F.desc("total"), "Territory_ID").first().Territory_ID
    return a, sums.orderBy("total", "Territory_ID").first().Territory_ID


def _suggested(spark, d, kinds):
    over, under = _ends(spark, d)
    out = T.suggest(_static(spark, d), over, under, kinds=kinds)
    return out.select("rank", "kind", "value", "delta", F.array_join(F.transform("accounts", lambda a: a["account_id"]), "|").alias("accounts"))


def suggest_singles(spark, d):
    return _suggested(spark, d, ("single",))


def suggest_pairs(spark, d):
    return _suggested(spark, d, ("pair",))


def suggest_rebalance(spark, d):
    return _suggested(spark, d, ("single", "pair"))


def _contracts(spark, d):
    return K.clean(A.contracts(spark, d))


def _tiered(spark, d, tiers=(10, 25, 50)):
    """What tiers need of contracts, written once, as the best vendors are found in it first."""
    return K.with_tiers(written(_contracts(spark, d).select("vendor", "amount", "duration"), "contracts"), tiers)


def contracts_clean(spark, d):
    return _contracts(spark, d).agg(F.count("*").alias("contracts"), F.sum("duration").alias("days"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2).alias("amount"))


def contracts_dedupe(spark, d):
    return K.dedupe(A.contracts(spark, d), tie=["line"]).select("award_id", "line", "vendor")


def fiscal_year(spark, d):
    rows = A.contracts(spark, d)
    return rows.groupBy(K.fiscal_year(F.col("start")).alias("fiscal_year")).agg(F.count("*").alias("contracts"))


def vendor_type_describe(spark, d):
    return K.describe(_contracts(spark, d).withColumn("vendor_type", K.vendor_type(F.col("vendor"), RESELLERS)), "vendor_type")


def sector_describe(spark, d):
    return K.describe(_contracts(spark, d).withColumn("sector", K.sector(F.col("agency"), DEFENSE)), "sector")


def vendor_class_describe(spark, d):
    rows = _tiered(spark, d, (10,))
    return K.describe(rows.withColumn("vendor_class", F.when(F.col("is_top_10"), "Top 10").otherwise("Other")), "vendor_class")


def distinct_vendors(spark, d):
    return _contracts(spark, d).agg(F.count_distinct("vendor").alias("vendors"), F.count_distinct("agency").alias("agencies"))


def top_vendors(spark, d):
    return K.top_vendors(A.contracts(spark, d), 25)


def vendor_table(spark, d):
    return K.vendor_table(A.contracts(spark, d))


def tier_flags(spark, d):
    rows = _tiered(spark, d)
    return rows.groupBy("is_top_10", "is_top_25", "is_top_50").agg(F.count("*").alias("contracts"), F.count_distinct("vendor").alias("vendors"))


def survival_labels(spark, d):
    return K.survival_labels(written(_contracts(spark, d).select("vendor", "amount", "duration"), "contracts"))


def subaward_flag(spark, d):
    rows = A.contracts(spark, d).withColumn("subawards", F.when(F.col("line") > 3, F.col("line") - 4))
    return K.subaward_flag(rows, "subawards").groupBy("has_subawards").agg(F.count("*").alias("contracts"), F.sum("subawards").alias("subawards"))


def duration_histogram(spark, d):
    return K.histogram(_contracts(spark, d), 0, 2500, 25)


def duration_box(spark, d):
    b = K.box(_contracts(spark, d).withColumn("sector", K.sector(F.col("agency"), DEFENSE)), "sector")
    return b.select("sector", "low", "q25", "q50", "q75", "high", "outside")


def lasting_by_vendor_type(spark, d):
    rows = _contracts(spark, d).withColumn("vendor_type", K.vendor_type(F.col("vendor"), RESELLERS))
    return K.share_lasting(rows, "vendor_type", [30, 365, 1095]).withColumn("share", F.round("share", 6))


def typed_values(spark, d):
    raw = A.contracts(spark, d).select("award_id", "line", F.when(F.col("line") == 2, "unknown").otherwise(F.col("start").cast("string")).alias("start"), F.col("end").cast("string").alias("end"), F.when(F.col("line") == 3, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"))
    t = K.with_duration(K.typed(raw))
    return t.agg(F.count("*").alias("n"), F.count("start").alias("starts"), F.count("amount").alias("amounts"), F.count("duration").alias("durations"), F.sum("duration").alias("days"))


def paged_source(spark, d):
    """The contracts written out as pages, read back page by page."""
    rows = written(A.contracts(spark, d).withColumn("year", K.fiscal_year(F.col("start"))), "contracts")
    path = f"{shared_folder(spark)}/quorial/pages-{uuid.uuid4().hex}"
    write_pages(rows, path, "year", ["award_id", "line"], 5_000)
    limits = rows.groupBy("year").count().agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max(F.ceil(F.col("count") / 5_000)).alias("pages")).first()
    back = read_paged(spark, "award_id long, line int, vendor string, start date, amount double", path=path, years=f"{limits.a}-{limits.b}", max_pages=str(limits.pages), pages_per_task="4")
    return back.groupBy("fiscal_year").agg(F.count("*").alias("contracts"), F.count_distinct("vendor").alias("vendors"), exact_sum("amount").alias("amount"), F.min("start").alias("first"))


def csv_sink(spark, d):
    """The table of vendors written as CSV, and read back."""
    path = f"{shared_folder(spark)}/quorial/vendors-{uuid.uuid4().hex}"
    R.write_csv(K.vendor_table(A.contracts(spark, d), 40), path)
    return R.read_csv(spark, path, "vendor string, billions string, contracts long, first string, last string")


def rf_importance(spark, d):
    return L.importance_grid(_contracts(spark, d), DEFENSE, [1825], (10,), trees=100)


def rf_importance_grid(spark, d):
    return L.importance_grid(_contracts(spark, d), DEFENSE, K.THRESHOLDS)


def rf_importance_by_sector(spark, d):
    return L.importance_by_sector(_contracts(spark, d), DEFENSE)


def churn_rate(spark, d):
    return S.churn_rate(A.lifetimes(spark, d))


def km_global(spark, d):
    return S.kaplan_meier(A.lifetimes(spark, d)).withColumn("survival", F.round("survival", 6))


def km_segment(spark, d):
    return S.kaplan_meier(A.lifetimes(spark, d), ["account_segment"]).withColumn("survival", F.round("survival", 6))


def _risk(spark, d):
    """Few orders mean a high risk."""
    return A.lifetimes(spark, d).withColumn("risk", -F.col("orders").cast("double"))


def c_index(spark, d):
    return S.concordance(_risk(spark, d), "risk")


def c_index_by_times(spark, d):
    """The same over balances, which nearly all differ."""
    return S.concordance(A.lifetimes(spark, d), "balance")


def roc_auc(spark, d):
    return S.roc_auc(_risk(spark, d), "risk")


def stratified_split(spark, d):
    return S.split(A.lifetimes(spark, d), "account_id", 0.2, "event_observed").select("account_id", "event_observed", "is_test")


def standard_scaler(spark, d):
    z = S.standardised(A.lifetimes(spark, d), ["balance", "orders"])
    return z.select("account_id", F.round("balance_z", 4).alias("balance_z"), F.round("orders_z", 4).alias("orders_z"))


def lr_baseline(spark, d):
    return L.churn_baseline(A.lifetimes(spark, d), ["balance", "orders"], ["account_segment", "account_region"], "logistic")


def rf_baseline(spark, d):
    return L.churn_baseline(A.lifetimes(spark, d), ["balance", "orders"], ["account_segment", "account_region"], "forest")


def cox_ph(spark, d):
    rows = S.split(S.standardised(A.lifetimes(spark, d), ["balance", "orders"]), "account_id")
    names = ["balance_z", "orders_z"]
    beta = S.cox(rows.where(~F.col("is_test")), names)
    scored = rows.where("is_test").withColumn("risk", F.round(S.linear_score(names, beta), 9))
    return S.concordance(scored, "risk").withColumn("coefficients", F.array(*[F.lit(round(float(b), 6)) for b in beta]))


def cox_all_features(spark, d):
    """Numbers scaled and all categories one-hot, learned from the training rows."""
    rows = S.split(A.lifetimes(spark, d), "account_id")
    train = rows.where(~F.col("is_test"))
    numbers = ["balance", "orders", "spent"]
    scaled = S.standardised(rows, numbers, fit_on=train)
    full, hot = S.one_hot(scaled, ["account_segment", "account_region"], fit_on=train)
    names = [f"{n}_z" for n in numbers] + hot
    beta = S.cox(full.where(~F.col("is_test")), names)
    scored = full.where("is_test").withColumn("risk", F.round(S.linear_score(names, beta), 9))
    return S.concordance(scored, "risk").withColumn("coefficients", F.array(*[F.lit(round(float(b), 6)) for b in beta]))


def rsf(spark, d):
    rows = written(S.split(A.lifetimes(spark, d), "account_id"), "lifetimes")
    scored = L.survival_forest(rows.where(~F.col("is_test")), ["balance", "orders"])
    return S.concordance(rows.join(scored, "account_id"), "risk")


def bias_windows(spark, d):
    from ..streaming.closes import windowed_bias

    orders = A.table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("Manager_ID"), F.col("o_totalprice").alias("commit"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("closed"))
    out = windowed_bias(orders, "at", width="365 days")
    return out.select(F.to_date("window.start").alias("start"), "manager", F.round("bias", 6).alias("bias"))


QUERIES = {
    f.__name__: f
    for f in (
        taxonomy_summary, taxonomy_bucket, territory_allocate, territory_allocate_locked, territory_balance, imbalance, seller_assignments, territory_roster, export_hierarchy,
        move_account, move_history, suggest_singles, suggest_pairs, suggest_rebalance,
        contracts_clean, contracts_dedupe, fiscal_year, vendor_type_describe, sector_describe, vendor_class_describe, distinct_vendors, top_vendors, vendor_table, tier_flags,
        survival_labels, subaward_flag, duration_histogram, duration_box, lasting_by_vendor_type, typed_values, rf_importance, rf_importance_grid, rf_importance_by_sector,
        churn_rate, km_global, km_segment, c_index, c_index_by_times, roc_auc, stratified_split, standard_scaler, lr_baseline, rf_baseline, cox_ph, cox_all_features, paged_source, csv_sink, rsf, bias_windows,
    )
}

# --- DuckDB twins -------------------------------------------------------------------

_ACC = """
    spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS cents FROM orders GROUP BY ALL),
    acc AS (SELECT c_name AS id, r_name || '_' || c_mktsegment AS bucket, coalesce(cents, 0) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN spent ON o_custkey = c_custkey)"""
_STA = _ACC + ", sta AS (SELECT id, v, bucket || '_Territory_' || (ascii(substr(md5(id), 1, 1)) % 2 + 1) AS t FROM acc)"
_BAL = "b AS (SELECT t, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM sta {where} GROUP BY t), bm AS (SELECT *, avg(s) OVER () AS m FROM b) SELECT t AS \"Territory_ID\", n AS accounts, s AS total, round(m, 4) AS mean, round(s - m, 4) AS variance, round((s - m) / m * 100, 4) AS variance_pct FROM bm"
_STAFF = _STA + """,
    tr AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM (SELECT DISTINCT t FROM sta)),
    ro(role, ratio) AS (VALUES ('AE', 1.0), ('SE', 2.0), ('BDR', 0.5), ('VP', 5.0)),
    sl AS (SELECT t, role, CASE WHEN ratio >= 1 THEN n // CAST(floor(ratio) AS INT) ELSE n END AS chunk, unnest(range(1, CASE WHEN ratio >= 1 THEN 2 ELSE CAST(ceil(1 / ratio) AS INT) + 1 END)) AS slot FROM tr, ro),
    se AS (SELECT t, role, role || '-' || upper(substr(sha256(role || '/' || chunk || '/' || slot), 1, 8)) AS seller FROM sl)"""
_ROST = _STAFF + ", rs AS (SELECT t, " + ", ".join(f"coalesce(string_agg(seller, ', ' ORDER BY seller) FILTER (role = '{r}'), 'Unassigned') AS {r}" for r in sorted(ROLES)) + " FROM se GROUP BY t)"
_SUG = _STA + """,
    tot AS (SELECT t, sum(v) AS s FROM sta GROUP BY t), ov AS (SELECT t, s FROM tot ORDER BY s DESC, t LIMIT 1), un AS (SELECT t, s FROM tot ORDER BY s, t LIMIT 1),
    df AS (SELECT CAST(ov.s - un.s AS BIGINT) AS diff FROM ov, un), pool AS (SELECT id, v FROM sta WHERE t = (SELECT t FROM ov) AND (SELECT diff FROM df) > 0),
    one AS (SELECT 'single' AS kind, v, id AS k FROM pool, df ORDER BY abs(v - diff / 2.0), id LIMIT 5),
    sm AS (SELECT * FROM pool ORDER BY v, id LIMIT 50),
    two AS (SELECT 'pair' AS kind, x.v + y.v AS v, x.id || '|' || y.id AS k FROM sm x JOIN sm y ON x.v < y.v OR (x.v = y.v AND x.id < y.id), df ORDER BY abs(x.v + y.v - diff / 2.0), k LIMIT 5)"""
_PICK = ", al AS ({src}), rk AS (SELECT *, abs(diff) - abs(diff - 2 * v) AS delta, abs(v - diff / 2.0) AS far FROM al, df) SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY delta DESC, kind DESC, far, k) AS INT) AS rank, kind, v AS value, delta, k AS accounts FROM rk) WHERE rank <= 5"
_CON = """
    con AS (SELECT l_orderkey AS award_id, l_linenumber AS line, s_name AS vendor, n_name AS agency, CAST(o_orderdate AS DATE) AS start, CAST(l_shipdate AS DATE) AS "end", l_extendedprice AS amount
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    cl AS (SELECT *, datediff('day', start, "end") AS duration FROM con WHERE "end" >= start),
    ven AS (SELECT vendor, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS contracts, min(start) AS first, max(start) AS last FROM {from_} GROUP BY vendor),
    vr AS (SELECT *, row_number() OVER (ORDER BY total DESC, vendor) AS rank FROM ven)"""
_CLEAN, _RAW = _CON.format(from_="cl"), _CON.format(from_="con")
_DESC = "count(duration) AS n, round(avg(duration), 2) AS mean, round(stddev_samp(duration), 2) AS std, CAST(min(duration) AS DOUBLE) AS min, round(quantile_cont(CAST(duration AS DOUBLE), 0.25), 2) AS q25, round(quantile_cont(CAST(duration AS DOUBLE), 0.5), 2) AS q50, round(quantile_cont(CAST(duration AS DOUBLE), 0.75), 2) AS q75, CAST(max(duration) AS DOUBLE) AS max"
_LIKE = lambda c, xs: " OR ".join(f"contains(upper({c}), '{x.upper()}')" for x in xs)
_FLAG = "fl AS (SELECT cl.*, coalesce(rank <= 10, false) AS is_top_10, coalesce(rank <= 25, false) AS is_top_25, coalesce(rank <= 50, false) AS is_top_50 FROM cl LEFT JOIN vr ON vr.vendor = cl.vendor)"
_LIFE = """
    sp AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS orders FROM orders GROUP BY ALL),
    life AS (SELECT c_custkey AS account_id, c_mktsegment AS account_segment, c_acctbal AS balance, orders, (year(b) - year(a)) * 12 + month(b) - month(a) AS t, CAST(b < TIMESTAMP '2001-02-01' AS INT) AS e FROM customer JOIN sp ON o_custkey = c_custkey)"""
_KM = "c AS (SELECT {by} t, count(*) AS n, sum(e) AS events FROM life GROUP BY ALL), r AS (SELECT *, sum(n) OVER ({part} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM c) SELECT {by} t AS time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(product(1 - events / at_risk) OVER ({part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS survival FROM r"
_CIX = f"WITH {_LIFE}, x AS (SELECT t, e, {{risk}} AS r, count(*) AS n FROM life GROUP BY ALL), p AS (SELECT a.n * b.n AS w, a.r AS ra, b.r AS rb FROM x a JOIN x b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))), s AS (SELECT coalesce(CAST(sum(w) FILTER (ra > rb) AS BIGINT), 0) AS concordant, coalesce(CAST(sum(w) FILTER (ra < rb) AS BIGINT), 0) AS discordant, coalesce(CAST(sum(w) FILTER (ra = rb) AS BIGINT), 0) AS tied FROM p) SELECT *, round((concordant + 0.5 * tied) / (concordant + discordant + tied), 4) AS c_index FROM s"
_SPLIT = "row_number() OVER ({part} ORDER BY md5(account_id || '/42'), account_id) <= ceil(count(*) OVER ({part}) * 0.2)"

ORACLE_SQL = {
    "taxonomy_summary": f"WITH {_ACC} SELECT bucket, count(*) AS accounts, CAST(sum(v) AS BIGINT) AS total FROM acc GROUP BY bucket",
    "taxonomy_bucket": f'WITH {_ACC} SELECT id AS "Account_ID", bucket, v AS "Estimated_TAM" FROM acc WHERE bucket = \'ASIA_BUILDING\'',
    "territory_allocate": f"""WITH RECURSIVE {_ACC}, rn AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, id) AS i FROM acc),
        go AS (SELECT bucket, CAST(0 AS BIGINT) AS i, [0::BIGINT, 0::BIGINT, 0::BIGINT] AS tot, 0 AS p, '' AS id, 0::BIGINT AS v FROM (SELECT DISTINCT bucket FROM acc)
               UNION ALL SELECT g.bucket, r.i, list_transform(g.tot, lambda x, j: x + CASE WHEN j = list_position(g.tot, list_min(g.tot)) THEN r.v ELSE 0 END), list_position(g.tot, list_min(g.tot)), r.id, r.v FROM go g JOIN rn r ON r.bucket = g.bucket AND r.i = g.i + 1)
        SELECT id AS "Account_ID", v AS "Estimated_TAM", bucket || '_Territory_' || p AS "Territory_ID" FROM go WHERE i > 0""",
    # a locked account's territory joins those of its bucket, and starts with its accounts' values
    "territory_allocate_locked": f"""WITH RECURSIVE {_ACC}, lk(id, lock) AS (VALUES ('{list(LOCKS)[0]}', '{list(LOCKS.values())[0]}'), ('{list(LOCKS)[1]}', '{list(LOCKS.values())[1]}')),
        al AS (SELECT acc.*, lock FROM acc LEFT JOIN lk ON lk.id = acc.id),
        nm AS (SELECT bucket, bucket || '_Territory_' || k AS name, k, 0::BIGINT AS far, '' AS first FROM (SELECT DISTINCT bucket FROM acc), range(1, 4) r(k)
               UNION ALL SELECT bucket, lock, 4, -max(v), min(id) FROM al WHERE lock IS NOT NULL AND lock NOT IN (bucket || '_Territory_1', bucket || '_Territory_2', bucket || '_Territory_3') GROUP BY bucket, lock),
        st AS (SELECT nm.bucket, list(nm.name ORDER BY k, far, first) AS names, list(coalesce(s, 0)::BIGINT ORDER BY k, far, first) AS tot
               FROM nm LEFT JOIN (SELECT bucket, lock, sum(v) AS s FROM al WHERE lock IS NOT NULL GROUP BY ALL) x ON x.bucket = nm.bucket AND x.lock = nm.name GROUP BY nm.bucket),
        rn AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, id) AS i FROM al WHERE lock IS NULL),
        go AS (SELECT bucket, CAST(0 AS BIGINT) AS i, tot, 0 AS p, '' AS id, 0::BIGINT AS v FROM st
               UNION ALL SELECT g.bucket, r.i, list_transform(g.tot, lambda x, j: x + CASE WHEN j = list_position(g.tot, list_min(g.tot)) THEN r.v ELSE 0 END), list_position(g.tot, list_min(g.tot)), r.id, r.v FROM go g JOIN rn r ON r.bucket = g.bucket AND r.i = g.i + 1)
        SELECT id AS "Account_ID", v AS "Estimated_TAM", names[p] AS "Territory_ID" FROM go JOIN st USING (bucket) WHERE i > 0
        UNION ALL SELECT id, v, lock FROM al WHERE lock IS NOT NULL""",
    "duration_box": f"""WITH {_CLEAN}, x AS (SELECT CASE WHEN {_LIKE('agency', DEFENSE)} THEN 'DoD' ELSE 'Civilian' END AS sector, CAST(duration AS DOUBLE) AS v FROM cl),
        q AS (SELECT sector, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM x GROUP BY sector),
        y AS (SELECT *, v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM x JOIN q USING (sector))
        SELECT sector, min(v) FILTER (inside) AS low, q25, q50, q75, max(v) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outside FROM y GROUP BY sector, q25, q50, q75""",
    "lasting_by_vendor_type": f"WITH {_CLEAN} SELECT CASE WHEN {_LIKE('vendor', RESELLERS)} THEN 'VAR' ELSE 'Direct' END AS vendor_type, count(*) AS n, CAST(threshold AS INTEGER) AS threshold, round(count(*) FILTER (duration >= threshold) / count(*), 6) AS share FROM cl, (VALUES (30), (365), (1095)) t(threshold) GROUP BY ALL",
    "territory_balance": f"WITH {_STA}, {_BAL.format(where='')}",
    "imbalance": f"WITH {_STA}, {_BAL.format(where='''WHERE starts_with(t, 'ASIA_')''')}",
    "seller_assignments": f'WITH {_STAFF} SELECT t AS "Territory_ID", role AS "Role", seller AS "Seller_ID" FROM se',
    "territory_roster": f'WITH {_ROST} SELECT t AS "Territory_ID", AE AS "AE", BDR AS "BDR", SE AS "SE", VP AS "VP" FROM rs',
    "export_hierarchy": f'WITH {_ROST} SELECT \'Global_Corp\' AS "Global", VP AS "VP", SE AS "SE", AE AS "AE", t AS "Territory_ID" FROM rs',
    "move_account": f"WITH {_STA} SELECT id AS \"Account_ID\", CASE id WHEN '{MOVES[0][0]}' THEN '{MOVES[0][1]}' WHEN '{MOVES[2][0]}' THEN '{MOVES[2][1]}' ELSE t END AS \"Territory_ID\" FROM sta",
    "move_history": f"WITH {_STA}, mv(seq, id, too) AS (VALUES (0, '{MOVES[0][0]}', '{MOVES[0][1]}'), (1, '{MOVES[1][0]}', '{MOVES[1][1]}'), (2, '{MOVES[2][0]}', '{MOVES[2][1]}')) SELECT seq, mv.id AS \"Account_ID\", coalesce(lag(too) OVER (PARTITION BY mv.id ORDER BY seq), t) AS from_territory, too AS to_territory, v AS value FROM mv JOIN sta ON sta.id = mv.id",
    "suggest_singles": f"WITH {_SUG}{_PICK.format(src='SELECT * FROM one')}",
    "suggest_pairs": f"WITH {_SUG}{_PICK.format(src='SELECT * FROM two')}",
    "suggest_rebalance": f"WITH {_SUG}{_PICK.format(src='SELECT * FROM one UNION ALL SELECT * FROM two')}",
    "contracts_clean": f"WITH {_CLEAN} SELECT count(*) AS contracts, CAST(sum(duration) AS BIGINT) AS days, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE), 2) AS amount FROM cl",
    "contracts_dedupe": f"WITH {_RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY year(start) + CASE WHEN month(start) >= 10 THEN 1 ELSE 0 END, amount DESC, line) AS k FROM con) SELECT award_id, line, vendor FROM n WHERE k = 1",
    "paged_source": f"WITH {_RAW} SELECT CAST(year(start) + CASE WHEN month(start) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year, count(*) AS contracts, count(DISTINCT vendor) AS vendors, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, min(start) AS first FROM con GROUP BY 1",
    "fiscal_year": f"WITH {_RAW} SELECT CAST(year(start) + CASE WHEN month(start) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year, count(*) AS contracts FROM con GROUP BY 1",
    "vendor_type_describe": f"WITH {_CLEAN} SELECT CASE WHEN {_LIKE('vendor', RESELLERS)} THEN 'VAR' ELSE 'Direct' END AS vendor_type, {_DESC} FROM cl GROUP BY 1",
    "sector_describe": f"WITH {_CLEAN} SELECT CASE WHEN {_LIKE('agency', DEFENSE)} THEN 'DoD' ELSE 'Civilian' END AS sector, {_DESC} FROM cl GROUP BY 1",
    "vendor_class_describe": f"WITH {_CLEAN}, {_FLAG} SELECT CASE WHEN is_top_10 THEN 'Top 10' ELSE 'Other' END AS vendor_class, {_DESC} FROM fl GROUP BY 1",
    "distinct_vendors": f"WITH {_CLEAN} SELECT count(DISTINCT vendor) AS vendors, count(DISTINCT agency) AS agencies FROM cl",
    "top_vendors": f"WITH {_RAW} SELECT vendor, total, contracts, CAST(rank AS INT) AS rank FROM vr WHERE rank <= 25",
    "csv_sink": f"WITH {_RAW} SELECT vendor, format('{{:.3f}}', round(total / 1e9, 3)) AS billions, contracts, strftime(first, '%b %Y') AS first, strftime(last, '%b %Y') AS last FROM vr WHERE rank <= 40",
    "vendor_table": f"WITH {_RAW} SELECT vendor, format('{{:.3f}}', round(total / 1e9, 3)) AS billions, contracts, strftime(first, '%b %Y') AS first, strftime(last, '%b %Y') AS last FROM vr WHERE rank <= 10",
    "tier_flags": f"WITH {_CLEAN}, {_FLAG} SELECT is_top_10, is_top_25, is_top_50, count(*) AS contracts, count(DISTINCT vendor) AS vendors FROM fl GROUP BY ALL",
    "survival_labels": f"WITH {_CLEAN}, {_FLAG}, th(threshold) AS (VALUES (365), (1095), (1825), (3650)) SELECT threshold, count(*) AS n, count(*) FILTER (duration >= threshold) AS lasting, count(*) FILTER (duration >= threshold AND is_top_10) AS lasting_top_10, count(*) FILTER (duration >= threshold AND is_top_25) AS lasting_top_25, count(*) FILTER (duration >= threshold AND is_top_50) AS lasting_top_50, count(*) FILTER (duration >= threshold) >= 10 AND count(*) FILTER (duration >= threshold) < count(*) AS usable FROM fl, th GROUP BY threshold",
    "subaward_flag": f"WITH {_RAW} SELECT coalesce(CASE WHEN line > 3 THEN line - 4 END, 0) > 0 AS has_subawards, count(*) AS contracts, CAST(sum(coalesce(CASE WHEN line > 3 THEN line - 4 END, 0)) AS BIGINT) AS subawards FROM con GROUP BY 1",
    "duration_histogram": f"WITH {_CLEAN} SELECT CAST(CASE WHEN duration >= 2500 THEN 26 ELSE floor(duration / 100.0) + 1 END AS INT) AS bin, count(*) AS n FROM cl GROUP BY 1",
    "typed_values": f"WITH {_RAW}, r AS (SELECT CASE WHEN line = 2 THEN NULL ELSE start END AS s, \"end\" AS f, CASE WHEN line = 3 THEN NULL ELSE amount END AS a FROM con) SELECT count(*) AS n, count(s) AS starts, count(a) AS amounts, count(s) AS durations, CAST(sum(datediff('day', s, f)) AS BIGINT) AS days FROM r",
    "churn_rate": f"WITH {_LIFE} SELECT count(*) AS n, round(avg(e) * 100, 4) AS churn_pct FROM life",
    "km_global": f"WITH {_LIFE}, {_KM.format(by='', part='')}",
    "km_segment": f"WITH {_LIFE}, {_KM.format(by='account_segment,', part='PARTITION BY account_segment')}",
    "c_index": _CIX.format(risk="-CAST(orders AS DOUBLE)"),
    "c_index_by_times": _CIX.format(risk="balance"),
    "roc_auc": f"WITH {_LIFE}, x AS (SELECT -orders AS s, count(*) AS n, sum(e) AS p FROM life GROUP BY 1), y AS (SELECT *, coalesce(sum(n - p) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x) SELECT round(sum(p * (b + (n - p) / 2)) / (sum(p) * sum(n - p)), 6) AS auc FROM y",
    "stratified_split": f"WITH {_LIFE} SELECT account_id, e AS event_observed, {_SPLIT.format(part='PARTITION BY e')} AS is_test FROM life",
    "standard_scaler": f"WITH {_LIFE}, m AS (SELECT avg(balance) AS mb, stddev_pop(balance) AS sb, avg(orders) AS mo, stddev_pop(orders) AS so FROM life) SELECT account_id, round((balance - mb) / sb, 4) AS balance_z, round((orders - mo) / so, 4) AS orders_z FROM life, m",
    "bias_windows": "WITH w AS (SELECT CAST(to_timestamp(CAST(floor(epoch(o_orderdate) / (365 * 86400)) AS BIGINT) * 365 * 86400) AT TIME ZONE 'UTC' AS DATE) AS start, o_orderpriority AS manager, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS c, CAST(sum(CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS a FROM orders GROUP BY ALL) SELECT start, manager, round(CASE WHEN c > 0 THEN a / c ELSE 1.0 END, 6) AS bias FROM w",
}
