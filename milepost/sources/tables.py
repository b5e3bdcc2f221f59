"""CSV, JSON lines and star tables: strict schemas, no inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "source_file string, raw_sequence int, source_page int, source_row_number int, extraction_method string, cells array<string>"


def read_csvs(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """All columns as text, with a header; a byte-order mark goes."""
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").option("multiLine", True).csv(paths)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Trimmed; empty and unreadable values are null."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    one = lambda c: clean(c) if types.get(c, "string") == "string" else clean(c).try_cast(types[c])
    return df.select(*[one(c).alias(c) for c in df.columns])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows with their cells."""
    return spark.read.schema(RAW).json(path)


def discovered(spark: SparkSession, folder: str, pattern: str, without: Sequence[str] = (), holding: Sequence[str] = ()) -> DataFrame:
    """Files below a folder that match, by path, but those of excluded names and those whose names hold an excluded
    word in any case (A04). No file at all is an error. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "length", "path")
    for word in holding:
        files = files.where(~F.contains(F.lower("file_name"), F.lit(word.lower())))
    files = files.where(~F.col("file_name").isin(*without)) if without else files
    if files.isEmpty():
        raise ValueError(f"no file below {folder} matches {pattern}")
    return files.orderBy("path").drop("path")


def decimal_text(c: Column) -> Column:
    """A double as text with 15 significant digits and no trailing zeros, as C's %.15g: the exact binary value is rounded, ties to even.

    The scientific pattern rounds the exact value, which a format by printf does not: that starts from the shortest decimal.
    Numbers below 2.2e-308, which hold fewer than 15 digits, keep the digits they hold."""
    size, long = F.abs(c), F.abs(c).cast("bigint")
    unit = F.when(size < 1e16, 10).when(size < 1e17, 100).when(size < 1e18, 1000).otherwise(10000).cast("bigint")
    kept, rest = F.floor(long / unit.cast("decimal(20,0)")).cast("bigint"), long % unit
    near = (kept + F.when((2 * rest > unit) | ((2 * rest == unit) & (kept % 2 == 1)), 1).otherwise(0)) * unit  # the pattern rounds ties of long integers up
    size = F.when((size >= 1e15) & (size < 9.2e18) & (size == long.cast("double")), near.cast("double")).otherwise(size)
    written = F.call_function("format_number", size, F.lit("0.00000000000000E0"))
    power = F.substring_index(written, "E", -1).cast("int")
    digits = F.regexp_replace(F.substring_index(written, "E", 1), r"\.", "")
    tidy = lambda x: F.regexp_replace(x, r"\.?0*$", "")
    fixed = F.when(power >= 14, digits).when(power >= 0, tidy(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(15))))).otherwise(tidy(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)))
    lifted = F.concat(tidy(F.substring_index(written, "E", 1)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    text = F.when(c.isNull(), None).when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf").when(power.between(-4, 14), fixed).otherwise(lifted)
    return F.when(F.isnan(c), text).otherwise(F.concat(F.when(F.substring(c.cast("string"), 1, 1) == "-", "-").otherwise(""), text))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed columns in order, doubles with 15 significant digits; null as nothing."""
    kinds = dict(df.dtypes)
    one = lambda c: decimal_text(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    df.select(*map(one, fields)).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines; with keys one nested document for each, its rows as an array."""
    if keys:
        rest = [c for c in df.columns if c not in keys]
        df = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    df.write.option("ignoreNullFields", False).json(path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a folder, by name (A10)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.sha2("content", 256).alias("sha256"), "length")


def gate(found: DataFrame, contract: DataFrame, *keys: str) -> DataFrame:
    """Each input of the contract with what is wrong with it: missing, other content, other row count (A10). Both sides: keys, sha256, n_rows."""
    f = found.select(*keys, F.col("sha256").alias("f_sha256"), F.col("n_rows").alias("f_n_rows"))
    status = F.when(F.col("f_n_rows").isNull(), "MISSING").when(F.col("sha256") != F.col("f_sha256"), "CONTENT_DIFFERS").when(F.col("n_rows") != F.col("f_n_rows"), "ROW_COUNT_DIFFERS").otherwise("ACCEPTED")
    return contract.join(f, list(keys), "left").select(*keys, status.alias("status"))


def read_star(spark: SparkSession, folder: str, manifest: DataFrame) -> dict[str, DataFrame]:
    """The three tables, if each has the rows and the digest that the manifest says; else an error (A12). manifest: name, n_rows, x, s."""
    said = {r["name"]: r for r in manifest.collect()}  # three rows
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in said}
    for name, table in tables.items():
        now = fingerprint(table).first()
        if (now["n_rows"], now["x"], now["s"]) != (said[name]["n_rows"], said[name]["x"], said[name]["s"]):
            raise ValueError(f"{name} differs from its manifest")
    return tables


def write_star(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write the star tables and return their manifest."""
    out = None
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
        one = fingerprint(table.sparkSession.read.parquet(f"{folder}/{name}")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def loadable(df: DataFrame) -> DataFrame:
    """Rows with a key; a missing name gets a default (A07). Write with partitionBy("report_month")."""
    keyed = (F.coalesce("project_code", F.lit("")) != "") & (F.coalesce("report_month", F.lit("")) != "")
    return df.where(keyed).withColumn("project_name", F.coalesce(F.nullif(F.col("project_name"), F.lit("")), F.lit("UNNAMED PROJECT")))


def ledger(old: DataFrame, version: str, loaded: DataFrame, verified: Column, at: Column | None = None, replace: bool = False) -> DataFrame:
    """The version ledger with one more entry; a new active one supersedes the old.

    Where the label stands in the ledger already, the new entry takes its place if replace, else it is called by the label and the second of
    the load (at; now). Whatever is loaded, the ledger gets an entry: empty, unverified or active."""
    at = F.unix_timestamp() if at is None else at
    new = loaded.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("project_code").alias("n_projects"), F.array_sort(F.collect_set("report_month")).alias("months"), F.bool_and(verified).alias("ok"))
    seen = old.agg(F.coalesce(F.bool_or(F.col("version") == version), F.lit(False)).alias("seen"))
    label = F.lit(version) if replace else F.when(F.col("seen"), F.concat_ws("-", F.lit(version), at.cast("string"))).otherwise(version)
    status = F.when(F.col("n_rows") == 0, "EMPTY").when(F.col("ok"), "ACTIVE").otherwise("INGESTED_UNVERIFIED")
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  both sides below are one row
    new = one(new).join(F.broadcast(one(seen)), "_k").select(label.alias("version"), status.alias("status"), "n_rows", "n_projects", "months")
    active = new.select((F.col("status") == "ACTIVE").alias("a"))
    stays = old.where(F.col("version") != version) if replace else old
    kept = one(stays).join(F.broadcast(one(active)), "_k").withColumn("status", F.when(F.col("a") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status")))
    return kept.select(*new.columns).unionByName(new)


def appended(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Accepted rows stay; only rows with new keys come in."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of all columns (A10)."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))


def star(risk: DataFrame, contributions: DataFrame) -> dict[str, DataFrame]:
    """Records with ids, features with ids, contributors that point to both."""
    key = ["project_code", "report_month", "regime"]
    records = risk.withColumn("record_id", F.xxhash64(*key, "model"))
    catalog = contributions.select("feature").distinct().withColumn("feature_id", F.row_number().over(Window.orderBy("feature")))  # a row for each feature
    facts = contributions.join(records.select(*key, "record_id"), key).join(F.broadcast(catalog), "feature").select("record_id", "feature_id", "contribution")
    return {"risk_records": records, "feature_catalog": catalog, "contributors": facts}
