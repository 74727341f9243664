"""Normalization, text functions and run comparison over the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.operators import metrics as mt
from tickerloom.plans.storage import checkpoint_dir, settle, stored
from tickerloom.sources import bars as br
from tickerloom.sources import bundle as bd
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.q_scores import metrics_sql
from workload.registry import query, r, rs, shown

PRICES = "open, high, low, close, adj_close, volume"


@query(
    "bars_keep_last",
    f"""SELECT ticker, date, {rs(PRICES, digits=9)} FROM (SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low,
  l_extendedprice AS close, l_extendedprice / l_quantity AS adj_close, l_quantity AS volume, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1""",
)
def bars_keep_last(spark, sf):
    """Raw trades under messy headers (text prices, repeated columns) normalized to bars."""
    raw = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("string").alias("Date"),
        F.col("l_extendedprice").cast("string").alias("Open"),
        F.col("l_extendedprice").cast("string").alias("HIGH"),
        F.col("l_extendedprice").cast("string").alias("low"),
        F.col("l_extendedprice").alias("Close"),
        F.lit("not a number").alias("Adj Close"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Adj Close.1"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return shown(br.normalize(raw, order=F.col(f"c{raw.columns.index('seq')}")), digits=9)


@query("date_filter", sp.with_(sp.BARS, "SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1"))
def date_filter(spark, sf):
    cut = br.between(fx.bars(spark, sf), "1997-01-01", "1998-12-31")
    return cut.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "csv_layouts",
    sp.with_(sp.BARS, f"SELECT ticker, date, {rs(PRICES)} FROM bars WHERE date >= DATE '1996-01-01'"),
)
def csv_layouts(spark, sf):
    """Bars written as CSV under two header layouts into the shared folder and read back by name."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    bars = settle(fx.bars(spark, sf))
    odd = F.crc32("ticker") % 2 == 1
    bars.filter(odd).select(F.col("ticker").alias("Ticker"), F.col("date").alias("Date"), *PRICES.split(", ")).write.option("header", True).csv(f"{folder}/a")
    turned = ["volume", "adj_close", "close", "low", "high", "open"]
    rest = bars.filter(~odd).select(*[F.col(c).alias(c.replace("_", " ").title()) for c in turned], F.col("date").alias(" DATE "), "ticker", F.lit("1").alias("Note"))
    rest.write.option("header", True).csv(f"{folder}/b")
    return shown(br.read_csv(spark, [f"{folder}/a", f"{folder}/b"], start="1996-01-01"), "ticker", "date", *PRICES.split(", "))


@query(
    "run_bundle",
    sp.with_(sp.BARS, f"""SELECT 'bar_totals' AS "table", ticker, count(*) AS n, {r("sum(volume)", "volume")}, 'written' AS status FROM bars GROUP BY ticker"""),
)
def run_bundle(spark, sf):
    """A result table written as a run bundle into the shared folder, with its manifest, and read back."""
    root = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    totals = fx.bars(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    manifest = bd.write_bundle(spark, {"Bar totals": totals, "nothing": None}, root, "run1").filter("status = 'written'")
    back = bd.read_table(spark, root, "Bar totals", "ticker string, n long, volume double", "run1")
    return shown(back.crossJoin(F.broadcast(manifest.select("table", "status"))), "table", "ticker", "n", "volume", "status")


_REQUEST = """SELECT concat('S', CAST(s_suppkey + 3 AS VARCHAR)) AS ticker, DATE '1995-01-02' + CAST(s_suppkey % 7 AS INT) AS "start", DATE '2001-10-20' + CAST(s_suppkey % 11 AS INT) AS "end" FROM supplier"""


@query(
    "store_coverage",
    sp.with_(
        sp.BARS,
        f"""SELECT q.ticker, q."start", q."end" FROM ({_REQUEST}) q LEFT JOIN (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1) USING (ticker) WHERE NOT coalesce(lo <= q."start" AND hi >= q."end", false)""",
    ),
)
def store_coverage(spark, sf):
    """Requests that the bars do not cover: too early, too late, or an unknown name."""
    key = F.col("s_suppkey")
    request = fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), (key + 3).cast("string")).alias("ticker"),
        F.date_add(F.lit("1995-01-02").cast("date"), (key % 7).cast("int")).alias("start"),
        F.date_add(F.lit("2001-10-20").cast("date"), (key % 11).cast("int")).alias("end"),
    )
    return br.coverage(fx.bars(spark, sf), request)


@query(
    "universe_load",
    sp.with_(
        sp.BARS,
        "SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    ),
)
def universe_load(spark, sf):
    names = fx.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("ticker"))
    return br.universe(fx.bars(spark, sf), names).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "earnings_normalized",
    """SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(o_orderdate AS DATE) AS earnings_date,
  CASE arg_max(o_orderpriority, (o_orderkey, l_linenumber, l_partkey, l_discount)) WHEN '1-URGENT' THEN 'before_open' WHEN '5-LOW' THEN 'after_close' ELSE '' END AS report_timing, round(arg_max(l_discount, (o_orderkey, l_linenumber, l_partkey, l_discount)), 6) + 0.0 AS eps_surprise_pct
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def earnings_normalized(spark, sf):
    """Events with mixed-case headers, padded names and unknown timings; last row per key wins."""
    joined = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = joined.select(
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("Ticker"),
        F.col("o_orderdate").cast("string").alias("Earnings_Date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", " Before_Open").when(F.col("o_orderpriority") == "5-LOW", "AFTER_CLOSE").otherwise(F.col("o_orderpriority")).alias("report_timing"),
        F.col("l_discount").cast("string").alias("eps_surprise_pct"),
        F.struct("o_orderkey", "l_linenumber", "l_partkey", "l_discount").alias("seq"),
    )
    return shown(br.normalize_events(raw, order=F.col("seq")), "ticker", "earnings_date", "report_timing", "eps_surprise_pct")


@query(
    "symbol_lists",
    """SELECT s_suppkey, concat_ws(' ', upper(replace(s_name, '#', '-')), 'S-' || CAST(s_nationkey AS VARCHAR), 'BRK-B') AS symbols, CAST(3 AS BIGINT) AS n FROM supplier""",
)
def symbol_lists(spark, sf):
    """Every supplier's messy text of names, with blanks, repeats, slashes and odd separators, parsed into symbols."""
    name = F.replace("s_name", F.lit("#"), F.lit("/"))
    text = F.concat(F.lit(" , ;"), F.lower(name), F.lit(" ;\ts/"), F.col("s_nationkey").cast("string"), F.lit("\n,"), name, F.lit(",brk / b,"))
    parsed = fx.table(spark, sf, "supplier").select("s_suppkey", tx.symbol_list(text).alias("symbols"))
    return parsed.select("s_suppkey", F.array_join("symbols", " ").alias("symbols"), F.size("symbols").cast("long").alias("n"))


@query(
    "weight_pairs",
    "SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker, round(s_acctbal, 2) + 0.0 AS weight, CAST(NULL AS VARCHAR) AS error FROM supplier UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR)), NULL, 'weight is not numeric' FROM supplier",
)
def weight_pairs(spark, sf):
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    texts = fx.table(spark, sf, "supplier").select(F.concat(key, F.lit(" = "), F.col("s_acctbal").cast("string"), F.lit("; "), key, F.lit(" abc")).alias("raw"))
    return shown(tx.weight_pairs(texts, "raw"), "ticker", "weight", "error", digits=2)


@query(
    "run_compare",
    sp.with_(
        sp.SCORES + "," + metrics_sql("a", "scores", "", "actual_out", "probability_out") + "," + metrics_sql("c", "scores", "", "actual_risk", "probability_risk")
        + ", half AS (SELECT *, 0.5 + (probability_out - 0.5) / 2 AS p2, 1 - probability_risk AS r2 FROM scores)," + metrics_sql("b", "half", "", "actual_out", "p2") + "," + metrics_sql("d", "half", "", "actual_risk", "r2") + """,
u AS (SELECT 'outperform.brier_score' AS metric, a.brier AS x, b.brier AS y, 'low' AS k FROM a, b UNION ALL SELECT 'outperform.roc_auc', a.auc, b.auc, 'auc' FROM a, b UNION ALL SELECT 'outperform.calibration_gap', a.rate - a.mp, b.rate - b.mp, 'gap' FROM a, b
  UNION ALL SELECT 'drawdown_risk.brier_score', c.brier, d.brier, 'risk' FROM c, d UNION ALL SELECT 'drawdown_risk.roc_auc', c.auc, d.auc, 'none' FROM c, d UNION ALL SELECT 'drawdown_risk.calibration_gap', c.rate - c.mp, d.rate - d.mp, 'gap' FROM c, d),
v AS (SELECT *, y - x AS d FROM u)""",
        f"""SELECT metric, {r('x', 'baseline')}, {r('y', 'candidate')}, {r('y - x', 'delta')}, CASE k WHEN 'auc' THEN CASE WHEN d > 0.005 THEN 'improved' WHEN d < -0.005 THEN 'worse' ELSE 'same' END
  WHEN 'low' THEN CASE WHEN d > 0.02 THEN 'worse' WHEN d < -0.02 THEN 'improved' ELSE 'same' END WHEN 'risk' THEN CASE WHEN d > 0.02 THEN 'worse' ELSE 'same' END WHEN 'gap' THEN CASE WHEN d > 0.03 THEN 'mixed' ELSE 'same' END ELSE 'not compared' END AS read FROM v""",
    ),
)
def run_compare(spark, sf):
    """The score panel against a run whose probabilities are pulled halfway to 0.5, and whose risks are turned around."""
    s = stored(fx.scores(spark, sf)).withColumns({"p2": 0.5 + (F.col("probability_out") - 0.5) / 2, "r2": 1 - F.col("probability_risk")})

    def rows(target, actual, p):
        return bd.metric_rows(mt.binary_metrics(s, [], actual, p).select(F.lit(target).alias("target_id"), "brier_score", "roc_auc", "calibration_gap"))

    runs = [rows("outperform", "actual_out", p).unionByName(rows("drawdown_risk", "actual_risk", q)) for p, q in (("probability_out", "probability_risk"), ("p2", "r2"))]
    return shown(bd.compare_runs(*runs))
