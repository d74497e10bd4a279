"""URL lists as of the time of fetching (operator 2); DataFrame operations only.

A list is a log of dated entries: (kind, value, action, verdict, at).  Kinds: ``host`` (that host), ``domain`` (it
and everything below it), ``prefix`` (host and path up to a slash).  An ``add`` is valid from its day until the next
entry of the same kind and value, a ``remove`` ends it: the log becomes validity intervals.

Every capture asks for its host, all its domain suffixes and all its path prefixes.  The as-of join is an equality
join on (kind, value, month), each interval being entered once per month it covers, followed by the exact day test: a
key that a third of all captures share is spread over months and split further by adaptive skew-join, and a capture
meets only the intervals of its month.  Captures are first reduced to distinct (URL, day).

The most specific active entry decides (longest prefix, then host, then longest domain; block before allow).

Defined results: a null URL or day, or a URL without a host, matches nothing (verdict ``none``); of entries of one
kind and value on one day the last by action (``remove`` after ``add``) and verdict counts; entries with a null in any
field are ignored; captures that repeat are each answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(log: DataFrame) -> DataFrame:
    """(kind, value, verdict, since, until): days from ``since`` to the day before ``until``."""
    entries = log.select("kind", F.lower("value").alias("value"), "action", "verdict", F.to_date("at").alias("since")) \
        .dropna()
    day = entries.groupBy("kind", "value", "since").agg(F.max(F.struct("action", "verdict")).alias("e"))
    after = F.lead("since").over(Window.partitionBy("kind", "value").orderBy("since"))
    return day.withColumn("until", F.coalesce(after, F.lit(FAR).cast("date"))).filter("e.action = 'add'") \
        .select("kind", "value", "e.verdict", "since", "until")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _keys(url: Column) -> Column:
    """(kind, value, rank) that a URL asks for; a higher rank is more specific."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"), (-i).cast("int").alias("rank")))
    parts = F.split(path_of(url), "/")  # the first part is empty; the last has no slash behind it
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")).alias("value"),
        (i + 1).cast("int").alias("rank"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(1).alias("rank")))
    empty = F.slice(own, 1, 0)
    return F.when(F.length(host) > 0, F.concat(own, domains, F.coalesce(prefixes, empty))).otherwise(empty)


def judge(captures: DataFrame, log: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with n_active, matched and verdict as of the day of each capture."""
    asked = captures.select(F.col(url_col).alias("u"), F.col(day_col).alias("d")).dropna().distinct()
    last = captures.agg(F.max(_month(F.col(day_col)))).first()[0] or 0
    held = intervals(log)
    until = F.least(_month(F.date_sub("until", 1)), F.lit(last))
    held = held.filter(_month(F.col("since")) <= last) \
        .withColumn("month", F.explode(F.sequence(_month(F.col("since")), F.greatest(until, _month(F.col("since"))))))
    keys = asked.select("u", "d", _month(F.col("d")).alias("month"), F.explode(_keys(F.col("u"))).alias("k")) \
        .select("u", "d", "month", "k.*")
    active = keys.join(held, ["kind", "value", "month"]).filter("d >= since and d < until")
    best = F.max_by(F.struct("verdict", "value"), F.struct("rank", (F.col("verdict") == "block").alias("b")))
    found = active.groupBy("u", "d").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best"))
    joined = captures.join(found, (F.col(url_col) == F.col("u")) & (F.col(day_col) == F.col("d")), "left")
    return joined.withColumns({
        "n_active": F.coalesce("n_active", F.lit(0)).cast("bigint"), "matched": F.col("best.value"),
        "verdict": F.coalesce("best.verdict", F.lit("none"))}).drop("u", "d", "best")
