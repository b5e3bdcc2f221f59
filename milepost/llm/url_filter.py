"""URL rules by host-suffix and path-prefix expressions.

Each url is expanded into every pair of a host suffix (as many labels as some rule has) and a path
prefix (as long as some rule's path); each expression's SHA-256 is cut to 4 bytes, joined with the
rules' cut digests, and a meeting is confirmed by the full digest. Of a url's rules the longest wins;
equal lengths: block before allow. Without a rule the verdict is `default`.

Up to `SENT` rules are sent to all tasks, so that expressions don't move at all and a url leaves its
task once; more rules meet the expressions in a shuffle join.

Defined cases: a null url or one without :// has an empty host and path and no rule; hosts and paths
may be of any length, what is built of them grows with the rules' sizes only; an empty rule host or
path fits nothing but an empty suffix or any path; repeated rows get equal verdicts, each its own
row; repeated rules count once; rules with a null field never fit; an empty table gives no rows;
columns host, path, rule and verdict of the input are replaced, other columns are left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that may be sent to all tasks, of about 100 bytes each.
SENT = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: action (allow or block), host, path."""
    kept = pages.columns
    wanted = (rules.where("action is not null and host is not null and path is not null").select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
              .select("action", F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("long"), F.size(F.split("host", r"\.")).alias("n_host"), F.length("path").alias("n_path"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("full")))
    wanted = wanted.withColumn("prefix", F.substring("full", 1, 8))
    sizes = lambda c: F.array(*[F.lit(r[0]) for r in wanted.select(c).distinct().orderBy(c).collect()]).cast("array<int>")  # noqa: E731  no more values than a host or path of a rule has characters
    hosts, lengths = sizes("n_host"), sizes("n_path")
    urls = pages.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.monotonically_increasing_id().alias("_n"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # columns _h and _p: suffixes of so many labels and prefixes of so many characters
    made = urls.withColumn("_h", hosts).withColumn("_p", lengths).withColumn("_l", F.length("host") - F.length(F.replace("host", F.lit("."))) + 1)
    made = made.withColumn("_h", F.expr("transform(filter(_h, n -> n <= _l), n -> substring_index(host, '.', -n))")).withColumn("_p", F.expr("transform(filter(_p, n -> n <= length(path)), n -> substring(path, 1, n))"))
    exprs = F.flatten(F.transform("_h", lambda h: F.transform("_p", lambda p: F.concat_ws("\n", h, p))))
    # every url keeps one row even if it has no expression
    one = made.select("_row", "_n", "host", "path", F.explode_outer(exprs).alias("expr")).withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.coalesce(F.substring("digest", 1, 8), F.concat(F.lit("-"), "_n")))  # no hot null key
    few = wanted.limit(SENT + 1).count() <= SENT
    met = one.join(F.broadcast(wanted) if few else wanted, "prefix", "left")
    fit = F.when(F.col("digest") == F.col("full"), F.struct("long", (F.col("action") == "block").alias("block"), "rule", "action"))
    best = met.groupBy("_n").agg(F.first("_row").alias("_row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fit).alias("best"))
    new = [F.col("host"), F.col("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")]
    return best.select(*[F.col("_row").getField(c).alias(c) for c in kept if c not in ("host", "path", "rule", "verdict")], *new)
