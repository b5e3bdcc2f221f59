"""Queries of readers and writers: written to a folder that executors share, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as io
from ..sources.store import folder, on_file_system
from ..streaming.append import append_new_months
from .risk import CONTRIB, RISK, contrib, risk
from .surrogate import PANEL_SQL, panel

ONLY = f"WITH {PANEL_SQL}"
#: The second of a load whose label stands in the ledger already; reports to leave out.
LOADED, UNWANTED = 1_700_000_000, ["Report_1996-03.txt", "Report_1999-11.txt"]
KEY = "project_code, report_month"
TEXT = ["project_code", "report_month", "project_name", "agency", "cumulative_expenditure", "physical_progress"]


def _csv(s, d):
    path = folder(s, "csv")
    io.write_csv(panel(s, d), path, TEXT)
    return io.read_csvs(s, [path], TEXT)


def _raw(s, d):
    path = folder(s, "raw")
    panel(s, d).select(F.col("report_month").alias("source_file"), F.col("ent").cast("int").alias("raw_sequence"), F.lit(1).alias("source_page"), F.lit(1).alias("source_row_number"), F.lit("grid").alias("extraction_method"), F.array("project_code", "agency", F.col("original_cost").cast("string")).alias("cells")).write.json(path)
    return io.read_raw(s, path).select("source_file", "raw_sequence", F.array_join("cells", "|").alias("cells"))


def _loaded(s, d):
    path = folder(s, "load")
    io.loadable(panel(s, d).withColumn("project_code", F.when(F.col("ent") % 41 != 0, F.col("project_code"))).withColumn("project_name", F.when(F.col("ent") % 43 != 0, F.col("project_name")))).select("project_code", "project_name", "report_month").write.partitionBy("report_month").parquet(path)
    return s.read.schema("project_code string, project_name string, report_month string").parquet(path)


def _ledger(s, d):
    p = panel(s, d)
    empty = s.createDataFrame([], "version string, status string, n_rows bigint, n_projects bigint, months array<string>")
    one = io.ledger(empty, "v1", p.where("regime = 'LEGACY'"), F.lit(True))
    two = io.ledger(one, "v2", p, F.lit(True))
    three = io.ledger(two, "v3", p.where("false"), F.lit(True))
    four = io.ledger(three, "v2", p.where("regime = 'LEGACY'"), F.lit(False), F.lit(LOADED))
    return io.ledger(four, "v1", p.where("regime = 'MODERN'"), F.lit(False), replace=True).select("version", "status", "n_rows", "n_projects", F.size("months").cast("long").alias("months"))


def _streamed(s, d):
    source, target, check = (folder(s, n) for n in ("arrivals", "target", "stream"))
    rows = panel(s, d).select("project_code", "report_month", F.col("mi").cast("int").alias("mi"))
    for part in ("mi % 3 = 0", "mi % 3 <> 1", "true"):
        rows.where(part).write.mode("append").parquet(source)
        append_new_months(s, source, "project_code string, report_month string, mi int", target, check, ["project_code", "report_month"])
    return s.read.schema("project_code string, report_month string, mi int").parquet(target)


def _discovered(s, d):
    """A report for each month in folders of years; every fifth is a synopsis, two are excluded by name."""
    path = folder(s, "reports")
    p = panel(s, d).select(F.substring("report_month", 1, 4).alias("year"), F.concat_ws("_", F.when(F.col("mi") % 5 == 0, "Synopsis").otherwise("Report"), "report_month").alias("name"), F.concat_ws(",", "project_code", "agency").alias("value"))
    p.repartition("name").write.partitionBy("year", "name").text(path)
    written, fs = on_file_system(s, f"{path}/year=*/name=*/part-*")
    for file in fs.globStatus(written):  # one for each month
        name = file.getPath().getParent().getName().removeprefix("name=")
        fs.rename(file.getPath(), on_file_system(s, f"{file.getPath().getParent().getParent()}/{name}.txt")[0])
    found = io.discovered(s, path, "*.txt", UNWANTED, ["synopsis"])
    return found.select(F.regexp_extract("folder", "year=([0-9]+)$", 1).alias("year"), "file_name", "length")


def _written(s, d):
    """Doubles with 15 digits and null as nothing, as the file's text says."""
    path = folder(s, "fixed")
    p = panel(s, d).select("project_code", "report_month", (F.col("cumulative_expenditure").cast("double") / 3).alias("third"), F.col("state").alias("state"), "agency")
    io.write_csv(p, path, ["project_code", "third", "state"])
    return s.read.text(path).where("value not like 'project_code%'").select(F.col("value").alias("line"))


def _documents(s, d):
    """One JSON document for each project with its months inside, read back."""
    path = folder(s, "json")
    io.write_json(panel(s, d).select("project_code", "report_month", "state"), path, "project_code")
    back = s.read.schema("project_code string, rows array<struct<report_month:string,state:string>>").json(path)
    return back.select("project_code", F.size("rows").cast("long").alias("months"), F.col("rows")[0]["report_month"].alias("first"), F.size(F.filter("rows", lambda r: r["state"].isNull())).cast("long").alias("without_state"))


def _gates(s, d):
    """Months against a contract that was made of them: every fifth has another row count, every seventh other content, one is missing."""
    p = panel(s, d)
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project_code", "agency", "original_cost")]), 256)
    found = p.groupBy("report_month").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("sha256"), F.count(F.lit(1)).alias("n_rows"), F.max("mi").alias("mi"))
    contract = found.withColumn("n_rows", F.when(F.col("mi") % 5 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows"))).withColumn("sha256", F.when(F.col("mi") % 7 == 0, F.lit("0")).otherwise(F.col("sha256")))
    return io.gate(found.where("mi % 11 <> 0").drop("mi"), contract.drop("mi"), "report_month")


def _contents(s, d):
    """SHA-256 of written months: files of equal rows have equal digests, two copies of everything."""
    path = folder(s, "copies")
    p = panel(s, d).where("regime = 'LEGACY'").select(F.concat_ws("|", "report_month", "project_code").alias("value"), "report_month")
    for copy in ("a", "b"):
        p.repartition("report_month").sortWithinPartitions("value").write.partitionBy("report_month").text(f"{path}/{copy}")
    return io.contents(s, path).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("months"))


def _read_star(s, d):
    """The star tables written with a manifest, read back under its check, and joined."""
    path = folder(s, "star")
    manifest = io.write_star(io.star(risk(s, d), contrib(s, d)), path)
    return _joined(io.read_star(s, path, manifest))


def _star(s, d):
    return _joined(io.star(risk(s, d), contrib(s, d)))


def _joined(t):
    """Contributors are added up for each record where they lie, before they meet the records."""
    found = t["contributors"].join(F.broadcast(t["feature_catalog"]), "feature_id").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.sum("contribution").alias("total"))
    return found.join(t["risk_records"].select("record_id", "project_code", "report_month"), "record_id").groupBy("project_code", "report_month").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))


STAR = f"{CONTRIB}, {RISK} SELECT project_code, report_month, count(*) AS n, round(sum(contribution), 6) AS total FROM long JOIN risk USING (project_code, report_month, regime) GROUP BY 1, 2"
ENTRIES = [
    ("a01_csv", lambda s, d: _csv(s, d).select("project_code", "report_month", "agency", "physical_progress"), f"{ONLY} SELECT {KEY}, agency, CAST(physical_progress AS VARCHAR) AS physical_progress FROM panel"),
    ("a02_typed", lambda s, d: io.typed(_csv(s, d), {"cumulative_expenditure": "double", "physical_progress": "double"}).select("project_code", "report_month", "cumulative_expenditure", "physical_progress"), f"{ONLY} SELECT {KEY}, CAST(cumulative_expenditure AS DOUBLE) AS cumulative_expenditure, CAST(physical_progress AS DOUBLE) AS physical_progress FROM panel"),
    ("a03_raw_rows", _raw, f"{ONLY} SELECT report_month AS source_file, CAST(ent AS INT) AS raw_sequence, project_code || '|' || agency || '|' || CAST(original_cost AS VARCHAR) AS cells FROM panel"),
    ("a07_load", _loaded, f"{ONLY} SELECT project_code, CASE WHEN ent % 43 <> 0 THEN project_name ELSE 'UNNAMED PROJECT' END AS project_name, report_month FROM panel WHERE ent % 41 <> 0"),
    ("a08_ledger", _ledger, f"{ONLY} SELECT 'v1' AS version, 'INGESTED_UNVERIFIED' AS status, count(*) AS n_rows, count(DISTINCT project_code) AS n_projects, count(DISTINCT report_month) AS months FROM panel WHERE regime = 'MODERN' UNION ALL SELECT 'v2', 'ACTIVE', count(*), count(DISTINCT project_code), count(DISTINCT report_month) FROM panel "
     f"UNION ALL SELECT 'v3', 'EMPTY', 0, 0, 0 UNION ALL SELECT 'v2-{LOADED}', 'INGESTED_UNVERIFIED', count(*), count(DISTINCT project_code), count(DISTINCT report_month) FROM panel WHERE regime = 'LEGACY'"),
    ("a09_keyed_append", lambda s, d: (lambda p: io.appended(p.where("mi % 3 = 0"), p.where("mi % 2 = 0").withColumn("agency", F.lit("new")), "project_code", "report_month"))(panel(s, d).select("project_code", "report_month", "mi", "agency")).drop("mi"), f"{ONLY} SELECT {KEY}, CASE WHEN mi % 3 = 0 THEN agency ELSE 'new' END AS agency FROM panel WHERE mi % 3 = 0 OR mi % 2 = 0"),
    ("a09_streamed_append", _streamed, f"{ONLY} SELECT {KEY}, mi FROM panel"),
    ("a10_fingerprint", lambda s, d: (lambda p: io.fingerprint(p).alias("a").join(io.fingerprint(p.repartition(7)).alias("b"), "n_rows").select("n_rows", ((F.col("a.x") == F.col("b.x")) & (F.col("a.s") == F.col("b.s"))).alias("same")))(panel(s, d)), f"{ONLY} SELECT count(*) AS n_rows, true AS same FROM panel"),
    ("a04_discovered", _discovered, f"{ONLY} SELECT report_month[1:4] AS year, 'Report_' || report_month || '.txt' AS file_name, CAST(sum(strlen(concat_ws(',', project_code, agency)) + 1) AS BIGINT) AS length FROM panel WHERE mi % 5 <> 0 AND report_month NOT IN ('1996-03', '1999-11') GROUP BY report_month"),
    ("a05_fixed_csv", _written, f"{ONLY} SELECT project_code || ',' || printf('%.15g', CAST(cumulative_expenditure AS DOUBLE) / 3) || ',' || coalesce(state, '') AS line FROM panel"),
    ("a06_json_documents", _documents, f"{ONLY} SELECT project_code, count(*) AS months, min(report_month) AS first, count(*) FILTER (WHERE state IS NULL) AS without_state FROM panel GROUP BY 1"),
    ("a10_gates", _gates, f"{ONLY} SELECT report_month, CASE WHEN max(mi) % 11 = 0 THEN 'MISSING' WHEN max(mi) % 7 = 0 THEN 'CONTENT_DIFFERS' WHEN max(mi) % 5 = 0 THEN 'ROW_COUNT_DIFFERS' ELSE 'ACCEPTED' END AS status FROM panel GROUP BY 1"),
    ("a10_contents", _contents, f"{ONLY} SELECT 2::BIGINT AS copies, count(DISTINCT report_month) AS months FROM panel WHERE regime = 'LEGACY'"),
    ("a11_star_tables", _star, STAR), ("a12_read_star", _read_star, STAR),
]
