"""First, last, latest and best row per group; change detection; percentiles.

``row_number() <= k`` filters are planned with a partial group limit before the exchange, so a key
holding a third of all rows sends at most k rows per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.operators.scans import bucket, join_on, previous
from rolegrid.session import cut

Order = list[str | Column]


def top_k(df: DataFrame, keys: list[str], order: Order, k: int | None, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in the given order; all of them for None."""
    if k is None and rank is None:
        return df
    name = rank or "__rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if k is not None:
        ranked = ranked.filter(F.col(name) <= k)
    return ranked.withColumn(name, F.col(name).cast("bigint")) if rank else ranked.drop(name)


def first_per_group(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """First row per group: first-wins dedupe, latest row, best score, by the order given."""
    return top_k(df, keys, order, 1)


def changes(df: DataFrame, entity: str, run: str, value: str, carry: list[str], by: Column | None = None) -> DataFrame:
    """Rows whose value differs from the entity's previous run. One row per (entity, run) expected."""
    seen = previous(df, [entity], [run], by if by is not None else bucket(run), [run, value, *carry])
    return seen.filter(F.col(f"prev_{value}").isNotNull() & (F.col(f"prev_{value}") != F.col(value)))


def accepted_per_run(attempts: DataFrame) -> DataFrame:
    """One accepted careers answer per (company, run): the highest attempt index, then id."""
    usable = attempts.filter(
        (F.col("validation_status") == "accepted")
        & F.col("candidate_kind").isin("career_site", "ats_board")
        & (F.col("final_url") != "")
        & F.col("run_id").isNotNull()
    )
    return first_per_group(usable, ["company_id", "run_id"], [F.desc("attempt_index"), F.desc("id")])


def churn(attempts: DataFrame, companies: DataFrame, by: Column | None = None) -> DataFrame:
    """Changed careers answers between consecutive runs, with the company they belong to."""
    answers = accepted_per_run(attempts).select("company_id", "run_id", "final_url", "title", "created_at")
    moved = changes(answers, "company_id", "run_id", "final_url", ["title", "created_at"], by)
    names = companies.select("company_id", "slug", "name", "index_membership")
    return moved.join(names, "company_id").select(
        "company_id", "slug", "name", "index_membership",
        F.col("prev_run_id").alias("from_run_id"), F.col("prev_final_url").alias("from_url"),
        F.col("prev_title").alias("from_title"), F.col("prev_created_at").alias("from_at"),
        F.col("run_id").alias("to_run_id"), F.col("final_url").alias("to_url"),
        F.col("title").alias("to_title"), F.col("created_at").alias("to_at"),
    )


def churn_page(attempts: DataFrame, companies: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    page = churn(attempts, companies)
    return page.orderBy(F.desc("to_run_id"), F.lower("name"), "company_id").offset(offset).limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """Latest run per company: started_at, then id."""
    return first_per_group(runs.filter(F.col("company_id").isNotNull()), ["company_id"], [F.desc("started_at"), F.desc("id")])


def first_verdict_url(companies: DataFrame, attempts: DataFrame, source: str = "browser_use") -> DataFrame:
    """companies with the URL of the first attempt of their verdict run by the judging source."""
    first = (
        attempts.filter(F.col("source") == source)
        .groupBy("company_id", F.col("run_id").alias("verdict_run_id"))
        .agg(F.min_by("candidate_url", F.struct("attempt_index", "id")).alias("first_url"))
    )
    wanted = F.col("verdict").isNotNull() & F.col("verdict_run_id").isNotNull()
    return (
        companies.join(first, ["company_id", "verdict_run_id"], "left")
        .withColumn("verdict_url", F.when(wanted, F.col("first_url")))
        .drop("first_url")
    )


def attempt_trail(attempts: DataFrame) -> DataFrame:
    """Attempts in reading order: newest run first, then index, then id."""
    return attempts.orderBy(F.desc_nulls_last("run_id"), "attempt_index", "id")


def last_wins(batch: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last element of each key in a batch."""
    return first_per_group(batch, keys, [F.desc(ordinal)])


def last_wins_counts(batch: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """One row: inserted = keys not known before, updated = batch rows minus inserted."""
    per_key = batch.groupBy(*keys).agg(F.count("*").alias("n"))
    fresh = per_key.join(known.select(*keys, F.lit(True).alias("__k")), keys, "left")
    return fresh.agg(
        F.coalesce(F.count_if(F.col("__k").isNull()), F.lit(0)).alias("inserted"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("__k").isNull())).alias("updated"),
    )


def best_anchor(anchors: DataFrame, page: str = "page_id", link: str = "link") -> DataFrame:
    """Best score per (page, link), first seen on ties; the position stays that of the first sighting."""
    rest = [x for x in anchors.columns if x not in (page, link, "pos")]
    best = anchors.groupBy(page, link).agg(
        F.max_by(F.struct(*rest), F.struct("score", -F.col("pos"))).alias("__best"), F.min("pos").alias("pos")
    )
    return best.select(page, link, "pos", "__best.*")


def rank_candidates(links: DataFrame, page: str = "page_id", link: str = "link", k: int | None = None) -> DataFrame:
    """Rank links of a page: score desc, shorter URL, URL."""
    order = [F.desc("score"), F.length(link), F.col(link)]
    if k is not None:
        return top_k(links, [page], order, k, "rank")
    rank = F.row_number().over(Window.partitionBy(page).orderBy(*order)).cast("bigint")
    return links.withColumn("rank", rank)


def accepted_status(attempts: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """HTTP status behind an accepted answer: the first accepted attempt whose URL is the answer,
    else the first accepted one."""
    accepted = attempts.filter(F.col("validation_status") == "accepted")
    preference = F.struct((F.col("candidate_url") != F.col(answer)).alias("other"), F.col("attempt_index"), F.col("id"))
    return accepted.groupBy(*keys).agg(
        F.coalesce(F.min_by("http_status", preference), F.lit(0)).cast("bigint").alias("answer_status")
    )


def percentiles(df: DataFrame, value: str, keys: list[str] | None = None, digits: int | None = 1) -> DataFrame:
    """n, min, p25, median, p75, p90, max per key; pX is the element at index int(n*f). Exact.

    The input is read once: values are counted per distinct value (combined on the map side) and written
    in value order, cut into range partitions whose number follows their size. Slice totals then tell
    which few slices hold the wanted ranks, and only those are scanned in order.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count("*").alias("__c"))
    rows = cut(counts.repartitionByRange(*keys, "__x").withColumn("__split", F.spark_partition_id()))
    totals = rows.groupBy(*keys, "__split").agg(F.sum("__c").alias("__t"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumns({"__base": F.coalesce(F.sum("__t").over(before), F.lit(0)), "__n": F.sum("__t").over(whole)})
    n = F.col("__n")
    index = {
        "min": F.lit(0), "p25": F.least(n - 1, F.floor(n * F.lit(0.25))), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2),
        "p75": F.least(n - 1, F.floor(n * F.lit(0.75))), "p90": F.least(n - 1, F.floor(n * F.lit(0.90))), "max": n - 1,
    }
    holds = reduce(lambda x, y: x | y, [(F.col("__base") <= i) & (i < F.col("__base") + F.col("__t")) for i in index.values()])
    needed = placed.filter(holds).select(*keys, "__split", "__base", "__n")
    inside = Window.partitionBy(*keys, "__split").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    scanned = join_on(rows, needed, [*keys, "__split"]).filter(n.isNotNull()).withColumn("__cum", F.col("__base") + F.sum("__c").over(inside))
    at = {k: F.min(F.when(F.col("__cum") > i, F.col("__x"))) for k, i in index.items()}
    shown = {"min": at["min"], "p25": at["p25"], "median": (at["low"] + at["high"]) / 2, "p75": at["p75"], "p90": at["p90"], "max": at["max"]}
    if digits is not None:
        shown = {k: F.bround(v, digits) for k, v in shown.items()}
    return scanned.groupBy(*keys).agg(F.max("__n").alias("n"), *[v.alias(k) for k, v in shown.items()])


def page(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def tally(df: DataFrame, key: str | Column, name: str, k: int | None = None, count: str = "n") -> DataFrame:
    """Counts per value, largest first; the value breaks ties so that a cut is repeatable."""
    col = F.col(key) if isinstance(key, str) else key
    counts = df.groupBy(col.alias(name)).agg(F.count("*").alias(count))
    return counts.orderBy(F.desc(count), name).limit(k) if k else counts
