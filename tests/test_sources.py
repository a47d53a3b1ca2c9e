"""Generated churn data and the public account table."""

import os

import pytest
from pyspark.sql import functions as F

from quorial.operators import contracts as K
from quorial.operators import survival as S
from quorial.sources import generators as G
from quorial.sources import readers as R
from quorial.sources.paged import read_paged, write_pages


def test_churn_data(spark):
    static, telemetry = G.churn_data(spark, 300, 24)
    static, telemetry = static.cache(), telemetry.cache()
    assert static.count() == 300 and static.where("time_to_event BETWEEN 1 AND 24").count() == 300
    assert static.where("event_observed = 0 AND time_to_event < 24").count() == 0
    assert static.agg(F.sum("time_to_event")).first()[0] == telemetry.count()
    assert telemetry.where("monthly_active_users_pct NOT BETWEEN 0.1 AND 1 OR csat_score NOT BETWEEN 1 AND 5").count() == 0
    rate = {r.account_segment: r.r for r in static.groupBy("account_segment").agg(F.avg("event_observed").alias("r")).collect()}
    assert rate["SMB"] > rate["Enterprise"]
    again, _ = G.churn_data(spark, 300, 24)
    assert again.exceptAll(static).count() == 0
    assert S.kaplan_meier(static).where("survival > 1 OR survival < 0").count() == 0


def test_public_accounts(spark):
    df = spark.createDataFrame([("a", "12.5", 1.0), ("b", " ", 2.0), ("c", None, 3.0)], "customerID string, TotalCharges string, MonthlyCharges double")
    assert [(r.Account_ID, r.Estimated_TAM) for r in G.public_accounts(df).collect()] == [("a", 12.5), ("b", 0.0), ("c", 0.0)]


def test_csv_goes_out_and_comes_back(spark, tmp_path):
    rows = [("NA", 'a "b", c', 1.5), (None, "x", None), ("", "y", 2.0)]
    df = R.from_rows(spark, [*rows, ("z", "nan", float("nan"))], "Region string, IC string, v double")
    R.write_csv(df, f"file://{tmp_path}/out")
    back = R.read_csv(spark, f"file://{tmp_path}/out", "Region string, IC string, v double")
    want = [("NA", 'a "b", c', 1.5), (None, "x", None), (None, "y", 2.0), ("z", "nan", None)]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(want, key=repr)


def test_json_is_typed(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": "NA", "v": 1}\n{"a": " ", "v": null, "more": 2}\n')
    assert sorted(map(tuple, R.read_json(spark, f"file://{tmp_path}/x.json", "a string, v double").collect()), key=repr) == [("NA", 1.0), (None, None)]


def test_paged_source_of_a_service(spark):
    """Years end at their first empty page, whatever comes behind; failures are tried again."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quorial.sources.paged import read_paged

    pages = {(2019, 1): 3, (2019, 2): 2, (2019, 4): 5, (2020, 1): 1}
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            year, page = int(body["filters"]["time_period"][0]["end_date"][:4]), body["page"]
            asked.append((year, page))
            if (year, page) == (2020, 1) and asked.count((2020, 1)) == 1:
                self.send_error(503)
                return
            out = [{"id": f"{year}/{page}/{i}", "amount": i if i else None, "more": [1]} for i in range(pages.get((year, page), 0))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": out, "naics": body.get("naics")}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    for per_task in ("1", "3"):
        got = read_paged(spark, "id string, amount double", url=url, years="2018-2020", max_pages="5", pages_per_task=per_task, body='{"naics": "x"}').collect()
        assert sorted(r.id for r in got) == ["2019/1/0", "2019/1/1", "2019/1/2", "2019/2/0", "2019/2/1", "2020/1/0"]
        assert {(r.fiscal_year, r.page) for r in got} == {(2019, 1), (2019, 2), (2020, 1)} and sum(r.amount is None for r in got) == 3
    asked.clear()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read_paged(spark, "id string", url=url, years="2018-2020", max_pages="2", pushdown="true").where("fiscal_year >= 2020").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()
    assert [r.id for r in got] == ["2020/1/0"] and {y for y, _ in asked} == {2020}


def test_strict_dates(spark):
    from pyspark.sql import functions as F

    from quorial.operators import contracts as K

    raw = spark.createDataFrame([("2019-01-31", "2020-01-31", "5.5"), ("2019-02-30", None, "n/a")], "start string, end string, amount string")
    got = [tuple(r) for r in K.with_duration(K.typed(raw)).select(F.col("start").cast("string"), "amount", "duration").collect()]
    assert got == [("2019-01-31", 5.5, 365), (None, None, None)]
    with pytest.raises(Exception, match="2019-02-30"):
        K.typed(raw, strict=True).collect()
    assert K.typed(spark.createDataFrame([("2019-01-31", "2020-01-31", "5.5")], raw.schema), strict=True).first().amount == 5.5


def test_quantiles_in_ranges(spark):
    import numpy as np

    from quorial.operators import contracts as K

    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(0, 900, 701).tolist(), "b": [5] * 400 + [9], "c": [7], None: [1, 2], "d": rng.normal(size=300).tolist()}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in K.quantiles(df, "g", "v", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, [0.1, 0.5, 0.99])))
    described = {r.g: r.q50 for r in K.describe(df, "g", "v").collect()}
    assert described["e"] is None and described["c"] == 7


def test_describe_makes_its_rows_once(spark):
    """Every row passes once, whatever is told of it; groups without values stay."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 9), ("b", 4), (None, 3), ("c", None)]
    df = spark.createDataFrame(rows, "g string, duration int").mapInArrow(look, "g string, duration int")
    out = {r.g: tuple(r)[1:] for r in K.describe(df, "g").collect()}
    assert seen.value == len(rows)
    assert out == {"a": (4, 3.5, 3.7, 1.0, 1.75, 2.0, 3.75, 9.0), "b": (1, 4.0, None, 4.0, 4.0, 4.0, 4.0, 4.0), None: (1, 3.0, None, 3.0, 3.0, 3.0, 3.0, 3.0), "c": (0, *[None] * 7)}


def test_packed_pages(spark, tmp_path):
    df = spark.range(40).select("id", F.lit(2020).alias("year"), F.lit("ü").alias("x"))
    write_pages(df, f"{tmp_path}/pages", "year", ["id"], 10)
    files = [n for _, _, names in os.walk(f"{tmp_path}/pages") for n in names if n[0] not in "._"]
    assert files and all(n.endswith(".gz") for n in files)
    back = read_paged(spark, "id long, x string", path=f"{tmp_path}/pages", years="2020", max_pages="4")
    assert sorted((r.id, r.x) for r in back.collect()) == [(i, "ü") for i in range(40)]
