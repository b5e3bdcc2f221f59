"""The panel of project-months, its completions and its raw rows, derived from the given tables.

A project is a supplier and line number; a month is that of the ship date. Every window here is
partitioned by project, so the work is one shuffle of pre-aggregated cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.months import SEGMENTS, index_of, month_text, text_or_null
from ..sources.store import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segmented(df: DataFrame, mi: str = "mi") -> DataFrame:
    """Adds segment and regime; rows outside of every segment go."""
    segment, regime = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, era, a, b in SEGMENTS:
        inside = F.col(mi).between(index_of(a), index_of(b))
        segment, regime = F.when(inside, F.lit(name)).otherwise(segment), F.when(inside, F.lit(era)).otherwise(regime)
    return df.withColumn("segment", segment).withColumn("regime", regime).where("segment is not null")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each project and month, with running sums."""
    line = table(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    back = F.col("l_returnflag") == "R"
    rows = line.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ent"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("mi"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
                       F.when(back, -amount).otherwise(amount).alias("amt"), F.col("l_quantity").cast("int").alias("qty"), (F.col("l_discount") >= 0.08).cast("tinyint").alias("d"), back.cast("tinyint").alias("r"), (F.col("l_tax") >= 0.075).cast("int").alias("t"))
    # few rows of a cell lie together before: rows of a project move once, and cells and windows are made where they are then
    cell = (rows.repartition("ent")
            .groupBy("ent", "mi").agg(F.min("sk").alias("sk"), F.min("ln").alias("ln"), F.min("pk").alias("pk"), F.sum("amt").alias("net"), F.sum("qty").alias("q"), F.sum("d").alias("nd"), F.sum("r").alias("nr"), F.max("t").alias("flick")))
    w = Window.partitionBy("ent").orderBy("mi")
    run, all_of = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("ent")
    return cell.select("*", F.sum("net").over(run).alias("cum"), F.sum("q").over(run).alias("cq"), F.sum("nd").over(run).alias("cd"), F.sum("nr").over(run).alias("cr"), F.row_number().over(w).alias("rn"), F.min("mi").over(all_of).alias("m0"), F.min("pk").over(all_of).alias("pk0"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical panel with mi, segment, regime and the entity number; derived once, in files by month."""
    return kept(spark, sf_dir, "panel", lambda: derived(spark, sf_dir), "report_month", spread=False)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from the given tables."""
    c = segmented(cells(spark, sf_dir)).where("ent % 4 <> 0 or mi <= m0 + 40 + sk % 24")
    c = c.withColumn("prev_cum", F.lag("cum").over(Window.partitionBy("ent").orderBy("mi")))
    ent, mi, rn = F.col("ent"), F.col("mi"), F.col("rn")
    cost = (F.lit(30000) * (F.lit(10) + (37 * F.col("sk") + 101 * F.col("ln")) % 30))
    share = F.lit(100) + 5 * F.floor(F.col("cr") / 2) - F.when(rn % 11 == 0, 8).otherwise(0)
    spent = F.when((rn <= 2) | ((ent % 11 == 0) & (mi < index_of("2000-01"))), F.lit(0).cast("decimal(28,2)")).when(rn % 9 == 0, F.col("prev_cum")).otherwise(F.col("cum"))
    oc = F.col("m0") + 24 + (F.col("sk") + 7 * F.col("ln")) % 48
    # what running sums say, as numbers: only these rows move to their parts, places and months, texts are made at the end
    c = c.select(
        "ent", "mi", F.col("rn").cast("int").alias("rn"), "m0", "sk", "pk", "pk0", oc.alias("oc"), F.when((F.col("cd") > 0) & (F.col("flick") == 0), oc + 3 * F.floor((F.col("cd") + 1) / 2)).alias("rc"),
        cost.cast("decimal(14,2)").alias("original_cost"), F.when(F.col("cr") >= 2, (cost * share / 100).cast("decimal(14,2)")).alias("revised_cost"), spent.cast("decimal(14,2)").alias("cumulative_expenditure"),
        F.when((mi >= index_of("1997-06")) & (rn % 13 != 0), F.when((ent % 37 == 0) & (rn % 6 == 0), F.lit(0).cast("decimal(6,2)")).otherwise((F.least(F.lit(101), F.col("cq").cast("decimal(12,2)") / 25) - F.when(rn % 10 == 3, 3).otherwise(0)).cast("decimal(6,2)"))).alias("physical_progress"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_type", "p_brand")
    name = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk0"), "p_name")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sk"), "n_name", "r_name")
    c = segmented(c.join(part, "pk", "left").join(name, "pk0", "left").join(place, "sk", "left").drop("pk", "pk0").hint("rebalance", "mi"))
    modern = F.col("regime") == "MODERN"
    return c.select(
        F.when(modern, F.lpad(ent.cast("string"), 6, "0")).otherwise(F.concat(F.lit("N"), F.lpad(ent.cast("string"), 8, "0"))).alias("project_code"),
        month_text("mi").alias("report_month"), F.when(rn % 19 == 0, F.upper("p_name")).when(rn % 23 == 0, F.concat("p_name", F.lit(" PHASE 2"))).otherwise(F.col("p_name")).alias("project_name"),
        F.when(rn % 17 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("agency"), F.when(modern, F.col("r_name")).alias("ministry"), F.col("p_type").alias("sector"),
        F.when(ent % 97 != 0, F.when((ent % 41 == 0) & (rn % 7 == 0), F.col("r_name")).otherwise(F.col("n_name"))).alias("state"),
        text_or_null(F.when(ent % 50 != 0, F.col("m0") - F.col("sk") % 24)).alias("approval_date"),
        text_or_null(F.when(mi >= index_of("1999-02"), F.col("m0"))).alias("start_date"),
        text_or_null(F.col("oc")).alias("original_completion_date"), text_or_null(F.col("rc")).alias("revised_completion_date"),
        "original_cost", "revised_cost", "cumulative_expenditure", "physical_progress", mi.cast("int").alias("mi"), "segment", "regime", ent.alias("ent"))


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions: every fourth project whose last month is before 2001-10, a month later."""
    p = panel(spark, sf_dir).where("ent % 4 = 0")
    last = p.groupBy("ent").agg(F.max_by(F.struct("project_code", "project_name", "agency", "ministry", "sector", "state", "start_date", "approval_date", "original_completion_date", "revised_completion_date", "original_cost", "revised_cost", "cumulative_expenditure"), "mi").alias("x"), F.max("mi").alias("last_mi"))
    return last.where(F.col("last_mi") < index_of("2001-10")).select("x.*", "ent", "last_mi", (F.col("last_mi") + 1).alias("mi"), month_text(F.col("last_mi") + 1).alias("report_month"))


#: The same recipe for DuckDB, written on its own.
PANEL_SQL = """
cell AS (SELECT l_suppkey*10+l_linenumber AS ent, year(l_shipdate)*12+month(l_shipdate)-1 AS mi, min(l_suppkey) AS sk, min(l_linenumber) AS ln, min(l_partkey) AS pk,
  sum(CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS net, sum(CAST(l_quantity AS INT)) AS q,
  count(*) FILTER (WHERE l_discount >= 0.08::DOUBLE) AS nd, count(*) FILTER (WHERE l_returnflag='R') AS nr, max(CASE WHEN l_tax >= 0.075::DOUBLE THEN 1 ELSE 0 END) AS flick
  FROM lineitem GROUP BY 1,2),
run AS (SELECT *, sum(net) OVER w AS cum, sum(q) OVER w AS cq, sum(nd) OVER w AS cd, sum(nr) OVER w AS cr, row_number() OVER w AS rn, min(mi) OVER (PARTITION BY ent) AS m0, min(pk) OVER (PARTITION BY ent) AS pk0
  FROM cell WINDOW w AS (PARTITION BY ent ORDER BY mi ROWS UNBOUNDED PRECEDING)),
seg AS (SELECT *, CASE WHEN mi BETWEEN 1995*12 AND 1996*12+10 THEN 'SEGMENT_1' WHEN mi BETWEEN 1997*12 AND 1997*12+2 THEN 'SEGMENT_2' WHEN mi BETWEEN 1997*12+5 AND 1998*12+11 THEN 'SEGMENT_3' WHEN mi BETWEEN 1999*12 AND 2001*12+10 THEN 'SEGMENT_4' END AS segment,
  mi >= 1999*12 AS modern FROM run),
kept AS (SELECT *, lag(cum) OVER (PARTITION BY ent ORDER BY mi) AS prev_cum FROM seg WHERE segment IS NOT NULL AND (ent % 4 <> 0 OR mi <= m0+40+sk%24)),
panel AS (SELECT CASE WHEN modern THEN lpad(CAST(ent AS VARCHAR),6,'0') ELSE 'N' || lpad(CAST(ent AS VARCHAR),8,'0') END AS project_code,
  printf('%04d-%02d', mi//12, mi%12+1) AS report_month, CASE WHEN rn%19=0 THEN upper(pn.p_name) WHEN rn%23=0 THEN pn.p_name || ' PHASE 2' ELSE pn.p_name END AS project_name, CASE WHEN rn%17=0 THEN upper(pt.p_brand) ELSE pt.p_brand END AS agency,
  CASE WHEN modern THEN r_name END AS ministry, pt.p_type AS sector, CASE WHEN ent%97<>0 THEN CASE WHEN ent%41=0 AND rn%7=0 THEN r_name ELSE n_name END END AS state,
  CASE WHEN ent%50<>0 THEN printf('%04d-%02d', (m0-sk%24)//12, (m0-sk%24)%12+1) END AS approval_date,
  CASE WHEN mi >= 1999*12+1 THEN printf('%04d-%02d', m0//12, m0%12+1) END AS start_date,
  printf('%04d-%02d', (m0+24+(sk+7*ln)%48)//12, (m0+24+(sk+7*ln)%48)%12+1) AS original_completion_date,
  CASE WHEN cd > 0 AND flick = 0 THEN printf('%04d-%02d', CAST(m0+24+(sk+7*ln)%48+3*((cd+1)//2) AS BIGINT)//12, CAST(m0+24+(sk+7*ln)%48+3*((cd+1)//2) AS BIGINT)%12+1) END AS revised_completion_date,
  CAST(30000*(10+(37*sk+101*ln)%30) AS DECIMAL(14,2)) AS original_cost,
  CASE WHEN cr >= 2 THEN CAST(CAST(300*(10+(37*sk+101*ln)%30)*(100+5*(cr//2)-CASE WHEN rn%11=0 THEN 8 ELSE 0 END) AS BIGINT) AS DECIMAL(14,2)) END AS revised_cost,
  CAST(CASE WHEN rn <= 2 OR (ent%11=0 AND mi < 2000*12) THEN 0 WHEN rn%9=0 THEN prev_cum ELSE cum END AS DECIMAL(14,2)) AS cumulative_expenditure,
  CASE WHEN mi >= 1997*12+5 AND rn%13<>0 THEN CASE WHEN ent%37=0 AND rn%6=0 THEN 0 ELSE CAST(least(101, CAST(cq*4 AS DECIMAL(18,2))/100) - CASE WHEN rn%10=3 THEN 3 ELSE 0 END AS DECIMAL(6,2)) END END AS physical_progress,
  CAST(mi AS INT) AS mi, segment, CASE WHEN modern THEN 'MODERN' ELSE 'LEGACY' END AS regime, ent
  FROM kept LEFT JOIN part pt ON pt.p_partkey = kept.pk LEFT JOIN part pn ON pn.p_partkey = kept.pk0
  LEFT JOIN supplier ON s_suppkey = kept.sk LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""

COMPLETED_SQL = PANEL_SQL + """,
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY mi DESC) AS back FROM panel WHERE ent % 4 = 0) WHERE back = 1 AND mi < 2001*12+9),
completed AS (SELECT project_code, project_name, agency, ministry, sector, state, start_date, approval_date, original_completion_date, revised_completion_date, original_cost, revised_cost, cumulative_expenditure,
  ent, mi AS last_mi, mi+1 AS mi, printf('%04d-%02d', (mi+1)//12, (mi+1)%12+1) AS report_month FROM done)"""
