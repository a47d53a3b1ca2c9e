"""Territories: taxonomy buckets, balanced allocation, staffing, manual moves and
suggestions to balance again."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup


def need_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def bucketed(accounts: DataFrame, taxonomy: list[str]) -> DataFrame:
    """Accounts with the name of their bucket; those with a null in it drop out."""
    need_columns(accounts, taxonomy)
    return accounts.dropna(subset=taxonomy).withColumn("bucket", F.concat_ws("_", *[F.col(c).cast("string") for c in taxonomy]))


def bucket(accounts: DataFrame, taxonomy: list[str], key: tuple | str) -> DataFrame:
    key = key if isinstance(key, tuple) else (key,)
    condition = F.lit(True)
    for c, v in zip(taxonomy, key, strict=True):
        condition = condition & (F.col(c) == v)
    return bucketed(accounts, taxonomy).where(condition)


def bucket_summary(accounts: DataFrame, taxonomy: list[str], metric: str = "Estimated_TAM") -> DataFrame:
    total = F.coalesce(F.sum(metric), F.lit(0)) if metric in accounts.columns else F.lit(0)
    return bucketed(accounts, taxonomy).groupBy("bucket").agg(F.count("*").alias("accounts"), total.alias("total"))


def allocate(accounts: DataFrame, taxonomy: list[str], territories: dict[str, int] | int, metric: str = "Estimated_TAM", prefix: str = "Territory", locks: dict[str, str] | None = None) -> DataFrame:
    """Longest-processing-time allocation within each bucket, as ``Territory_ID``.

    Accounts in descending order of the metric (nulls last, as 0; ties by id) go to the
    territory with the least so far, ties to the first.  Locked accounts come first; a
    territory that only they name competes too.  With one territory all go there and
    locks don't hold.

    Rows stream through in order and only the totals of one bucket's territories are
    held, so a bucket may be of any size.
    """
    rows = bucketed(accounts, taxonomy)
    k = lookup(F.col("bucket"), territories, 1) if isinstance(territories, dict) else F.lit(territories)
    lock = lookup(F.col("Account_ID"), locks or {}, None).cast("string")
    columns = accounts.columns
    rows = rows.select(*columns, "bucket", k.cast("int").alias("_k"), F.when(k > 1, lock).alias("_lock"), F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias("_v"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("_lock").isNull(), F.col(metric).desc_nulls_last(), "Account_ID")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap, place, totals = None, None, {}, []
        for b in batches:
            own = dict(zip(b.schema.names, b.columns, strict=True))
            out = []
            for name, k, lock, v in zip(*(own[c].to_pylist() for c in ("bucket", "_k", "_lock", "_v")), strict=True):
                if name != current:
                    current, heap = name, None
                    names = [f"{name}_{prefix}_{i + 1}" for i in range(max(k, 1))]
                    place, totals = {n: i for i, n in enumerate(names)}, [0.0] * len(names)
                if lock is not None:
                    if lock not in place:
                        place[lock] = len(names)
                        names.append(lock)
                        totals.append(0.0)
                    totals[place[lock]] += v
                    out.append(lock)
                    continue
                if heap is None:
                    heap = [(t, i) for i, t in enumerate(totals)]
                    heapq.heapify(heap)
                total, i = heap[0]
                heapq.heapreplace(heap, (total + v, i))
                out.append(names[i])
            yield pa.RecordBatch.from_arrays([*(own[c] for c in columns), pa.array(out, pa.string())], [*columns, "Territory_ID"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in accounts.schema)
    return rows.mapInArrow(run, f"{kinds}, Territory_ID string")


def balance(assigned: DataFrame, metric: str = "Estimated_TAM", prefix: str | None = None) -> DataFrame:
    """Per territory: accounts, total, and the distance from the mean of all, or of
    those whose name starts with ``prefix``."""
    rows = assigned if prefix is None else assigned.where(F.col("Territory_ID").startswith(prefix))
    sums = rows.groupBy("Territory_ID").agg(F.count("*").alias("accounts"), F.coalesce(F.sum(metric), F.lit(0)).alias("total"))
    mean = sums.agg(F.avg("total").alias("mean"))
    return sums.crossJoin(mean).select("Territory_ID", "accounts", "total", "mean", (F.col("total") - F.col("mean")).alias("variance"), (F.try_divide(F.col("total") - F.col("mean"), F.col("mean")) * 100).alias("variance_pct"))


def check_ratios(roles: dict[str, float]) -> None:
    for role, r in roles.items():
        if r <= 0:
            raise ValueError(f"the ratio of {role!r} must be over 0")


def staff(assigned: DataFrame, roles: dict[str, float]) -> DataFrame:
    """``Territory_ID, Role, Seller_ID``: a ratio of 1 or more gives each seller that
    many territories (whole numbers, in the order of names), one under 1 gives each
    territory ``ceil(1 / ratio)`` sellers.  Ids are made from role and place, so they
    don't change from run to run."""
    check_ratios(roles)
    spark = assigned.sparkSession
    config = spark.createDataFrame([(r, float(v), i) for i, (r, v) in enumerate(roles.items())], "Role string, ratio double, seq int")
    # few names: one per territory
    ranked = assigned.select("Territory_ID").distinct().withColumn("n", F.row_number().over(Window.orderBy("Territory_ID")) - 1)
    both = ranked.crossJoin(F.broadcast(config))
    wide = F.col("ratio") >= 1
    chunk = F.floor(F.col("n") / F.when(wide, F.floor("ratio")).otherwise(1)).cast("long")
    slots = F.when(wide, 1).otherwise(F.ceil(1 / F.col("ratio"))).cast("int")
    rows = both.select("Territory_ID", "Role", "seq", chunk.alias("chunk"), F.explode(F.sequence(F.lit(1), slots)).alias("slot"))
    seller = F.concat("Role", F.lit("-"), F.upper(F.substring(F.sha2(F.concat_ws("/", "Role", F.col("chunk").cast("string"), F.col("slot").cast("string")), 256), 1, 8)))
    return rows.select("Territory_ID", "Role", seller.alias("Seller_ID"))


def roster(sellers: DataFrame, roles: list[str]) -> DataFrame:
    """A column of sellers for each role, in the roles' alphabetical order."""
    names = F.array_join(F.array_sort(F.collect_list("Seller_ID")), ", ")
    out = sellers.groupBy("Territory_ID").pivot("Role", sorted(roles)).agg(names)
    return out.fillna("Unassigned", sorted(roles))


def export_hierarchy(team: DataFrame, order: list[str] | None = None, top: str = "Global_Corp") -> DataFrame:
    """A flat path table for the hierarchy operators."""
    if order is None:
        return team.withColumn("Global", F.lit(top))
    need_columns(team, order)
    return team.select(F.lit(top).alias("Global"), *order, "Territory_ID")


def move_accounts(assigned: DataFrame, moves: list[tuple[str, str]], metric: str = "Estimated_TAM") -> tuple[DataFrame, DataFrame]:
    """The table after the moves (the last of an account holds), and their log
    ``seq, Account_ID, from_territory, to_territory, value``.  Unknown accounts raise."""
    spark = assigned.sparkSession
    log = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(moves)], "seq int, Account_ID string, to_territory string")
    first = assigned.groupBy("Account_ID").agg(F.min(F.struct("Territory_ID", F.col(metric).alias("v"))).alias("x"))
    known = F.broadcast(log).join(first, "Account_ID", "left")
    missing = known.where("x IS NULL").select("Account_ID").limit(1).collect()
    if missing:
        raise ValueError(f"unknown account {missing[0][0]!r}")
    before = F.lag("to_territory").over(Window.partitionBy("Account_ID").orderBy("seq"))
    history = known.select("seq", "Account_ID", F.coalesce(before, F.col("x.Territory_ID")).alias("from_territory"), "to_territory", F.col("x.v").alias("value"))
    last = log.groupBy("Account_ID").agg(F.max_by("to_territory", "seq").alias("to"))
    moved = assigned.join(F.broadcast(last), "Account_ID", "left").withColumn("Territory_ID", F.coalesce("to", "Territory_ID")).select(*assigned.columns)
    return moved, history


def suggest(assigned: DataFrame, over: str, under: str, excluded: list[str] | None = None, moved: DataFrame | None = None, top_n: int = 5, metric: str = "Estimated_TAM", kinds: tuple[str, ...] = ("single", "pair")) -> DataFrame:
    """Accounts, or pairs, whose move from ``over`` to ``under`` evens both out best.

    Candidates are those in ``over`` that are neither excluded nor ever moved; the five
    nearest to half the difference are offered, and the five nearest of all pairs of the
    50 smallest.  Returns ``rank, kind, value, delta, accounts``, best first.
    """
    sums = assigned.agg(F.sum(F.when(F.col("Territory_ID") == over, F.col(metric))).alias("o"), F.sum(F.when(F.col("Territory_ID") == under, F.col(metric))).alias("u")).first()
    if sums.o is None or sums.u is None:
        raise ValueError("unknown territory")
    diff = sums.o - sums.u
    pool = assigned.where((F.col("Territory_ID") == over) & F.lit(diff > 0))
    if excluded:
        pool = pool.where(~F.col("Account_ID").isin(excluded))
    if moved is not None:
        pool = pool.join(moved.select("Account_ID").distinct(), "Account_ID", "left_anti")
    name = F.col("Account_Name") if "Account_Name" in assigned.columns else F.col("Account_ID")
    pool = pool.select(F.col("Account_ID").alias("id"), F.struct(F.col("Account_ID").alias("account_id"), name.alias("account_name")).alias("a"), F.col(metric).alias("v"))
    far = lambda v: F.abs(v - diff / 2)
    single = pool.orderBy(far(F.col("v")), "id").limit(5).select(F.lit("single").alias("kind"), "v", F.array("a").alias("accounts"), F.col("id").alias("k"))
    small = pool.orderBy("v", "id").limit(50)
    x, y = small.alias("x"), small.alias("y")
    before = (F.col("x.v") < F.col("y.v")) | ((F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")))
    # at most 50 x 49 / 2 pairs
    pairs = x.join(F.broadcast(y), before).select(F.lit("pair").alias("kind"), (F.col("x.v") + F.col("y.v")).alias("v"), F.array("x.a", "y.a").alias("accounts"), F.concat_ws("|", "x.id", "y.id").alias("k"))
    pairs = pairs.orderBy(far(F.col("v")), "k").limit(5)
    parts = [p for k, p in (("single", single), ("pair", pairs)) if k in kinds]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    delta = abs(diff) - F.abs(F.lit(diff) - 2 * F.col("v"))
    rank = F.row_number().over(Window.orderBy(F.desc("delta"), F.desc("kind"), far(F.col("v")), "k"))
    return both.withColumn("delta", delta).withColumn("rank", rank).where(F.col("rank") <= top_n).select("rank", "kind", F.col("v").alias("value"), "delta", "accounts")


#: Fixed: per segment its share, mean and deviation of the logarithms of employees and of
#: revenue, and the base of the market value.
ACCOUNT_SEGMENTS = {
    "Enterprise": (0.1, 9.2, 1.0, 21.0, 1.0, 500_000),
    "Mid-Market": (0.3, 6.2, 0.8, 17.5, 0.8, 100_000),
    "SMB": (0.6, 3.9, 0.8, 14.5, 0.8, 20_000),
}
#: Fixed: per region its share and parts.
ACCOUNT_REGIONS = {
    "AMER": (0.5, ["North", "South", "East", "West"]),
    "EMEA": (0.3, ["UK", "DACH", "Nordics", "South"]),
    "APAC": (0.2, ["ANZ", "ASEAN", "Japan", "India"]),
}
#: Fixed: industries, all alike in number.
ACCOUNT_INDUSTRIES = ["Technology", "Financial Services", "Healthcare", "Retail", "Manufacturing"]


def generate_accounts(spark, n: int, seed: int = 42) -> DataFrame:
    """Random accounts: log-normal sizes by segment, two in five of them customers, one in
    ten held by a representative.  A row depends on its number and the seed only."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(f"{seed}/{salt}"), F.col("id")), F.lit(2**40)) + 0.5) / 2.0**40
    normal = lambda salt: F.sqrt(-2 * F.log(u(salt + "/r"))) * F.cos(2 * math.pi * u(salt + "/a"))
    one_of = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(u(salt) * len(xs)) + 1).cast("int"))
    of_segment = lambda k: lookup(F.col("Account_Segment"), {name: float(v[k]) for name, v in ACCOUNT_SEGMENTS.items()})

    def drawn(salt: str, shares: dict) -> Column:
        out, top = F.lit(list(shares)[-1]), 1.0
        for name, after in reversed(list(zip(shares, list(shares)[1:]))):
            top -= shares[after][0]
            out = F.when(u(salt) < top, name).otherwise(out)
        return out

    base = spark.range(n).withColumn("Account_Segment", drawn("segment", ACCOUNT_SEGMENTS)).withColumn("Region", drawn("region", ACCOUNT_REGIONS)).withColumn("Industry", one_of("industry", ACCOUNT_INDUSTRIES))
    part = F.lit(None).cast("string")
    for name, (_, parts) in ACCOUNT_REGIONS.items():
        part = F.when(F.col("Region") == name, one_of("part", parts)).otherwise(part)
    base = base.withColumn("Estimated_TAM", of_segment(5) * (0.5 + 2 * u("tam")))
    score = lambda salt, mean, spread: F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mean + spread * normal(salt))), 1)
    return base.select(
        F.concat(F.lit("ACC-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("Account_ID"), F.concat("Industry", F.lit(" Corp "), F.col("id").cast("string")).alias("Account_Name"),
        "Account_Segment", "Region", part.alias("Sub_Region"), "Industry",
        F.greatest(F.lit(10), F.exp(of_segment(1) + of_segment(2) * normal("staff")).cast("int")).alias("Employee_Count"),
        F.greatest(F.lit(500_000.0), F.exp(of_segment(3) + of_segment(4) * normal("revenue"))).alias("Annual_Revenue"), "Estimated_TAM",
        F.when(u("customer") < 0.4, F.col("Estimated_TAM") * (0.1 + 0.7 * u("spend"))).otherwise(0.0).alias("Historical_Spend"),
        score("intent", 50, 20).alias("G2_Intent_Score"), score("activity", 30, 25).alias("CRM_Activity_Score"),
        F.when(u("held") < 0.1, F.concat(F.lit("REP-"), (F.floor(u("rep") * 900) + 100).cast("string"))).alias("Existing_Relationship_Rep_ID"),
    )
