"""Contract gates (D22), and joins and look-ups that refuse what they must not meet.

Row conditions are assertions inside the plan: a row that breaks one ends the job that reads it, with the row's key in the message. Counts come from
one aggregate per table, or from an Observation that is filled while the table is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.months import SEGMENTS, index_of

SECTIONS = ("target", "features", "segments", "expected")


class ContractError(ValueError):
    """A table or a description differs from the contract."""


@dataclass(frozen=True)
class Contract:
    """What a data set must be. expected: regime to rows and positives."""

    target: str
    horizon: int
    metadata: tuple[str, ...]
    features: tuple[str, ...]
    forbidden: tuple[str, ...] = ()
    segments: tuple[tuple[str, str, str, str], ...] = tuple(SEGMENTS)
    expected: dict[str, tuple[int, int]] = field(default_factory=dict)


def read(said: dict) -> Contract:
    """A contract from its description; every section must be there."""
    missing = [s for s in SECTIONS if s not in said]
    if missing:
        raise ContractError(f"sections missing: {missing}")
    names = said["features"].get("ordered", [])
    if said["features"].get("count") != len(names) or len(set(names)) != len(names):
        raise ContractError(f"{len(names)} features are named, {said['features'].get('count')} are said")
    return Contract(said["target"]["name"], said["target"]["horizon"], tuple(said["features"].get("metadata", ())), tuple(names), tuple(said["features"].get("forbidden", ())), tuple(map(tuple, said["segments"])), {k: tuple(v) for k, v in said["expected"].items()})


def same_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """df, if its columns are those of the contract in their order."""
    want = [*contract.metadata, *contract.features]
    if df.columns != want:
        missing, extra = [c for c in want if c not in df.columns], [c for c in df.columns if c not in want]
        raise ContractError(f"columns missing: {missing}, not in the contract: {extra}" if missing or extra else "columns are in another order")
    return df


def no_leakage(contract: Contract) -> None:
    both = sorted({*contract.features} & {*contract.forbidden})
    if both:
        raise ContractError(f"features that know the future: {both}")


def same_target(contract: Contract, target: str, horizon: int) -> None:
    if (target, horizon) != (contract.target, contract.horizon):
        raise ContractError(f"target {target} over {horizon} months, not {contract.target} over {contract.horizon}")


def same_segments(contract: Contract, segments: list[tuple]) -> None:
    if tuple(map(tuple, segments)) != contract.segments:
        raise ContractError("segments differ from the contract")


def required(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """df; reading a row that breaks the condition (or makes it null) is an error."""
    said = F.lit(message) if isinstance(message, str) else message
    return df.where(F.assert_true(F.coalesce(condition, F.lit(False)), said).isNull())


def _who() -> Column:
    return F.concat_ws(" ", F.coalesce("project_code", F.lit("(no code)")), "report_month")


def _segment(segments: tuple) -> Column:
    out = F.lit(None).cast("string")
    for name, _, a, b in segments:
        out = F.when(F.col("report_month").between(a, b), name).otherwise(out)
    return out


def sound(df: DataFrame, contract: Contract) -> DataFrame:
    """df with its rows' conditions inside the plan: keys, label domain, a month in a segment, a label window that stays in it."""
    ends = F.lit(None).cast("int")
    for _, _, a, b in contract.segments:
        ends = F.when(F.col("report_month").between(a, b), index_of(b)).otherwise(ends)
    mi = F.substring("report_month", 1, 4).cast("int") * 12 + F.substring("report_month", 6, 2).cast("int") - 1
    df = required(df, F.col("project_code").isNotNull() & F.col("report_month").isNotNull(), F.concat(F.lit("no key: "), _who()))
    df = required(df, F.col(contract.target).isin(0, 1), F.concat(F.lit("label is neither 0 nor 1: "), _who()))
    df = required(df, _segment(contract.segments).isNotNull(), F.concat(F.lit("month outside of every segment: "), _who()))
    return required(df, mi + contract.horizon <= ends, F.concat(F.lit("label window leaves its segment: "), _who()))


def embargoed(rows: DataFrame, origin: int, horizon: int) -> DataFrame:
    """Training rows of an origin (month index); one whose label window reaches it is an error."""
    return required(rows, F.col("mi") + horizon < origin, F.concat(F.lit("inside the embargo: "), _who()))


def observed(df: DataFrame, contract: Contract) -> tuple[DataFrame, Observation]:
    """df, and the counts of its rows, positives and negatives, which are there once something has read df."""
    seen = Observation("contract")
    y = F.col(contract.target)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives")), seen


def gates(df: DataFrame, contract: Contract, *by: str) -> DataFrame:
    """By group: counts, and the first gate that is not passed (D22). One pass over the rows; nothing is raised. by: begins with regime."""
    y = F.col(contract.target)
    ends = F.lit(None).cast("string")
    for _, _, a, b in contract.segments:
        ends = F.when(F.col("report_month").between(a, b), b).otherwise(ends)
    key = df.groupBy(*by, "project_code", "report_month").agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    mi = F.substring("report_month", 1, 4).cast("int") * 12 + F.substring("report_month", 6, 2).cast("int")
    end = F.substring(ends, 1, 4).cast("int") * 12 + F.substring(ends, 6, 2).cast("int")
    total = key.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("n") - F.col("pos") - F.col("neg")).alias("bad_labels"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.when(F.col("project_code").isNull() | F.col("report_month").isNull(), F.col("n"))), F.lit(0)).alias("no_key"), F.coalesce(F.sum(F.when(ends.isNull() | (mi + contract.horizon > end), F.col("n"))), F.lit(0)).alias("outside"))
    rows, hits = F.lit(None).cast("long"), F.lit(None).cast("long")
    for regime, (n, p) in contract.expected.items():
        rows, hits = F.when(F.col(by[0]) == regime, n).otherwise(rows), F.when(F.col(by[0]) == regime, p).otherwise(hits)
    first = (F.when(F.col("no_key") > 0, "KEY_MISSING").when(F.col("repeated") > 0, "KEY_REPEATED").when(F.col("bad_labels") > 0, "LABEL_DOMAIN").when(F.col("outside") > 0, "SEGMENT")
             .when(~F.col("n_rows").eqNullSafe(rows), "ROW_COUNT").when(~F.col("positives").eqNullSafe(hits), "POSITIVE_COUNT").otherwise("PASS"))
    return total.withColumn("status", first)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """df; a key that comes twice is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return required(df.withColumn("__mp_n", n), F.col("__mp_n") == 1, F.concat(F.lit("key comes more than once: "), F.concat_ws(" ", *keys))).drop("__mp_n")


def assigned(df: DataFrame, month: str = "report_month") -> DataFrame:
    """df with segment and regime; a month outside of every segment is an error."""
    segment, regime = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, era, a, b in SEGMENTS:
        segment, regime = F.when(F.col(month).between(a, b), name).otherwise(segment), F.when(F.col(month).between(a, b), era).otherwise(regime)
    return required(df.withColumn("segment", segment).withColumn("regime", regime), F.col("segment").isNotNull(), F.concat(F.lit("month outside of every segment: "), F.coalesce(F.col(month), F.lit("(none)"))))


def one_layout(rows: DataFrame) -> DataFrame:
    """source_file and its layout; a file with rows of several layouts, or of none, is an error."""
    of = rows.groupBy("source_file").agg(F.min("layout").alias("layout"), F.max("layout").alias("__mp_other"))
    return required(of, F.col("layout") == F.col("__mp_other"), F.concat(F.lit("layout changes within "), "source_file")).drop("__mp_other")


def joined_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right by key; a key that right lacks or has twice is an error."""
    one = once(right, *keys).withColumn("__mp_met", F.lit(True))
    met = left.join(one, keys, "left")
    return required(met, F.col("__mp_met"), F.concat(F.lit("no partner: "), F.concat_ws(" ", *keys))).drop("__mp_met")


def exact(records: DataFrame, code: str, month: str) -> DataFrame:
    """The record of a code and month; records of several regimes are an error."""
    mine = records.where((F.col("project_code") == code) & (F.col("report_month") == month))
    return required(mine.withColumn("__mp_n", F.size(F.collect_set("regime").over(Window.partitionBy("project_code", "report_month")))), F.col("__mp_n") <= 1, F.lit(f"{code} {month} has records of several regimes")).drop("__mp_n")


def options(records: DataFrame, month: str | None, *dimensions: str) -> DataFrame:
    """What can be chosen in a month (none: the latest): per dimension its values as a list, without regard to case in its order; the month
    and all months. A month without records is an error (M13)."""
    months = records.where("report_month is not null").agg(F.array_sort(F.collect_set("report_month")).alias("months"))  # a few dozen
    chosen = months.withColumn("month", F.lit(month) if month else F.element_at("months", -1))
    chosen = required(chosen, F.array_contains("months", F.col("month")), F.concat(F.lit("no records in "), F.coalesce("month", F.lit("any month"))))
    rows = records.join(F.broadcast(chosen.select("month")), F.col("report_month") == F.col("month"))  # one row
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))).where("value <> ''").distinct()
    values = long.groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("value").alias("k"), F.col("value").alias("v")))), lambda x: x["v"]).alias("values"))
    # the check of the month stands even if no value is left
    return values.withColumn("__mp", F.lit(1)).join(F.broadcast(chosen.withColumn("__mp", F.lit(1))), "__mp", "right").select("month", "months", "dimension", "values")
