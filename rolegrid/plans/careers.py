"""Careers jobs: resolve a company to its careers page, judge stored pages, classify vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import text as T
from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, map_lookup
from rolegrid.operators import merge
from rolegrid.operators.discover import climb, fetch, homepage_attempts, ladder_candidates, next_hop, single_responses
from rolegrid.operators.gate import attempt_state, board_check, category, gate, should_escalate
from rolegrid.operators.scans import bucket
from rolegrid.session import cut

ATTEMPT = ["company_id", "position", "source", "candidate_url", "candidate_kind", "http_status", "final_url", "title", "validation_status", "rejection_reason", "evidence"]


def _attempt(df: DataFrame, group: int, place: str) -> DataFrame:
    """Judged rows in the shape of an attempt; an accepted one carries no reason."""
    ok = F.col("gate.status") == "accepted"
    return df.select(
        "company_id", F.struct(F.lit(group).alias("g"), F.col(place).cast("bigint").alias("n")).alias("position"), "source",
        F.col("url").alias("candidate_url"), F.col("kind").alias("candidate_kind"), F.coalesce("status", F.lit(0)).alias("http_status"),
        F.col("gate.final_url").alias("final_url"), F.col("gate.title").alias("title"), F.col("gate.status").alias("validation_status"),
        F.when(~ok, F.col("gate.reason")).alias("rejection_reason"), F.col("gate.evidence").alias("evidence"),
    )


def resolve_careers(companies: DataFrame, responses: DataFrame, homepages: DataFrame | None = None, max_candidates: int | None = None, max_sitemaps: int | None = None) -> dict[str, DataFrame]:
    """Homepage, ladder, board check. Returns ``resolutions`` (one row per company) and ``attempts``.

    companies(company_id, slug, name, website), homepages(company_id, url, source) for companies
    whose website is not known yet.
    """
    responses = cut(single_responses(responses))
    base = companies.select("company_id", "slug", "name", F.coalesce("website", F.lit("")).alias("website"))
    if homepages is not None:
        base = base.join(homepages.select("company_id", F.col("url").alias("__hu"), F.col("source").alias("__hs")), "company_id", "left")
    else:
        base = base.withColumns({"__hu": F.lit(None).cast("string"), "__hs": F.lit(None).cast("string")})
    fresh = (F.col("website") == "") & (F.coalesce("__hu", F.lit("")) != "")
    known = base.withColumns({"new_website": F.when(fresh, F.col("__hu")), "new_website_source": F.when(fresh, map_lookup(F.col("__hs"), vocab.HOMEPAGE_SOURCES)), "website": F.when(fresh, F.col("__hu")).otherwise(F.col("website"))})
    known = cut(known)

    def fixed(df: DataFrame, source, url, status: str, reason: str | None, code: int) -> DataFrame:
        return df.select(
            "company_id", F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("n")).alias("position"), source.alias("source"), url.alias("candidate_url"),
            F.lit("website").alias("candidate_kind"), F.lit(code).alias("http_status"), url.alias("final_url"), F.lit("").alias("title"),
            F.lit(status).alias("validation_status"), F.lit(reason).cast("string").alias("rejection_reason"), F.lit("").alias("evidence"),
        )

    found = fixed(known.filter(F.col("new_website").isNotNull()), F.col("__hs"), F.col("new_website"), "accepted", None, 200)
    nowhere = fixed(known.filter(F.col("website") == ""), F.lit("tier1"), F.lit(""), "rejected", "no_careers_signal", 0)
    homes = cut(homepage_attempts(known.select("company_id", "name", "website"), responses))
    home_rows = _attempt(homes.withColumn("__n", F.lit(0)), 1, "__n")
    climbed = cut(climb(ladder_candidates(homes, responses, max_candidates, max_sitemaps), responses))
    rung_rows = _attempt(climbed, 2, "rank")
    answer = climbed.filter("is_answer").select(
        "company_id", "homepage", F.col("gate.final_url").alias("url"), "source", F.col("gate.title").alias("title"), F.col("status").alias("code")
    ).withColumn("offsite", ~U.same_site("url", "homepage"))
    boards = answer.filter("offsite").select("company_id", F.col("url").alias("tenant_url"), U.board_api_url("url").alias("api_url"))
    checked = cut(board_check(fetch(boards.withColumn("url", F.col("api_url")), responses)))
    board_rows = checked.select(
        "company_id", F.struct(F.lit(3).alias("g"), F.lit(0).cast("bigint").alias("n")).alias("position"), F.lit("ats_api").alias("source"),
        F.coalesce("api_url", F.lit("")).alias("candidate_url"), F.lit("ats_board").alias("candidate_kind"), F.coalesce("status", F.lit(0)).alias("http_status"),
        F.col("tenant_url").alias("final_url"), F.lit("").alias("title"), F.when(F.col("board.accepted"), "accepted").otherwise(attempt_state("board.reason")).alias("validation_status"),
        F.nullif("board.reason", F.lit("")).alias("rejection_reason"), F.col("board.evidence").alias("evidence"),
    )
    b = checked.select("company_id", F.col("board.accepted").alias("board_ok"), "tenant_url", U.platform_id_for_host(U.host("tenant_url")).alias("board_platform"))
    j = known.select("company_id", "slug", "new_website", "new_website_source").join(answer, "company_id", "left").join(b, "company_id", "left")
    cleared = F.col("board_ok").isNotNull() & ~F.col("board_ok")  # an answer on the board's own host falls with the board
    usable = F.col("url").isNotNull() & ~F.coalesce(cleared, F.lit(False))
    resolutions = j.select(
        "company_id", "slug", "new_website", "new_website_source",
        F.when(usable, F.coalesce(F.when(F.col("board_ok"), F.col("tenant_url")), "url")).alias("new_url"),
        F.when(usable, F.when(F.col("board_ok"), F.lit("ats_api")).otherwise(map_lookup(F.col("source"), vocab.TIER_TO_SOURCE))).alias("new_url_source"),
        F.when(usable, F.col("code")).alias("new_status"), F.when(usable, F.col("title")).alias("new_title"),
        F.when(F.col("board_ok") & (F.col("board_platform") != 0), F.col("board_platform")).alias("platform_id"),
        F.when(F.col("board_ok"), F.col("tenant_url")).alias("base_url"), usable.alias("resolved"),
    )
    attempts = found.unionByName(nowhere).unionByName(home_rows).unionByName(rung_rows).unionByName(board_rows)
    return {"resolutions": resolutions, "attempts": attempts}


def validate_stored(companies: DataFrame, responses: DataFrame, second_urls: DataFrame | None = None, evidence_bytes: int = 0) -> dict[str, DataFrame]:
    """Judge stored careers URLs under the strict profile. ``second_urls(company_id, final_url, ok)``
    are an agent's answers for pages worth a second look; only an accepted second page changes the
    category, and the stored URL itself is never written.
    """
    responses = cut(single_responses(responses))

    def judge(df: DataFrame, source: str) -> DataFrame:
        rows = df.withColumns({"kind": U.kind_for_url("url"), "source": F.lit(source), "base": F.lit(None).cast("string"), "strict": F.lit(True)})
        return gate(fetch(rows, responses))

    first = cut(judge(companies.select("company_id", "slug", F.col("name").alias("company_name"), F.col("career_site_url").alias("url"), F.col("career_site_url").alias("stored_url")), "browser_use"))
    unsure = first.filter(should_escalate("gate.reason") & (F.col("gate.status") != "accepted"))
    if second_urls is not None:
        asked = second_urls.filter(F.coalesce(F.col("ok"), F.lit(False))).select("company_id", F.col("final_url").alias("__second"))
        pairs = unsure.select("company_id", "slug", "company_name", "stored_url").join(asked, "company_id")
        second = cut(judge(pairs.filter(~U.same_url("__second", "stored_url")).select("company_id", "slug", "company_name", F.col("__second").alias("url"), "stored_url"), "browser_use_agent"))
    else:
        second = first.limit(0)

    def rows(df: DataFrame, n: int) -> DataFrame:
        out = _attempt(df.withColumn("__n", F.lit(n)), 1, "__n")
        ok = F.col("gate.status") == "accepted"
        evidence = F.when(ok, T.append_evidence(F.concat(F.lit("verdict="), "gate.reason"), "gate.evidence")).otherwise(F.col("gate.evidence"))
        kept = F.when(~ok, F.col("body")).when(F.lit(evidence_bytes > 0), T.truncate_bytes("body", max(evidence_bytes, 1), ""))
        extra = df.select("company_id", evidence.alias("__e"), kept.alias("evidence_body"))
        return out.drop("evidence").join(extra.withColumnRenamed("__e", "evidence"), "company_id")

    saved = second.filter("gate.status = 'accepted'").select("company_id", F.lit(True).alias("__saved")) if second_urls is not None else None
    verdicts = first.select(
        "company_id", "slug", category("gate.status", "gate.reason").alias("category"), F.col("stored_url").alias("new_verdict_url"),
        F.coalesce("status", F.lit(0)).alias("new_status"), F.col("gate.title").alias("new_title"), F.col("gate.reason").alias("reason"),
        (should_escalate("gate.reason") & F.lit(second_urls is not None)).alias("escalated"),
    )
    if saved is not None:
        verdicts = verdicts.join(saved, "company_id", "left").withColumn("category", F.when(F.col("__saved"), "confirmed").otherwise(F.col("category"))).drop("__saved")
    verdicts = verdicts.withColumn("new_verdict", F.col("category"))
    return {"verdicts": verdicts, "attempts": rows(first, 0).unionByName(rows(second, 1))}


def classify_vendors(companies: DataFrame, responses: DataFrame, platforms: DataFrame, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """Vendor of each careers site: the page itself, else one hop to its best link.

    Returns ``rows`` (vendor, hop, board URL, outcome), one-row ``summary`` and, when a state is given,
    the new ``company_platforms``.
    """
    responses = cut(single_responses(responses))
    pages = fetch(companies.select("company_id", "slug", F.col("career_site_url").alias("url")), responses)
    ok = F.col("transport_error").isNull() & (F.coalesce("status", F.lit(0)) > 0)
    first = cut(pages.withColumns({"ok": ok, "page_url": F.coalesce(F.nullif("response_url", F.lit("")), "url"), "body": F.coalesce("body", F.lit(""))}).withColumn(
        "vendor", F.when(F.col("ok"), T.fingerprint("page_url", "body"))))
    hops = next_hop(first.filter(F.col("ok") & F.col("vendor").isNull()).select("company_id", "page_url", "body"), "company_id", "page_url", "body")
    second = fetch(hops.withColumn("url", F.col("hop_url")), responses).filter(F.col("transport_error").isNull() & (F.coalesce("status", F.lit(0)) > 0))
    hopped = second.withColumn("__u", F.coalesce(F.nullif("response_url", F.lit("")), "url")).select(
        "company_id", F.col("__u").alias("hop_page"), T.fingerprint("__u", F.coalesce("body", F.lit(""))).alias("hop_vendor")
    ).filter(F.col("hop_vendor").isNotNull())
    names = platforms.select(F.col("name").alias("vendor"), "platform_id", "platform_type")
    j = first.select("company_id", "slug", "ok", "page_url", F.col("vendor").alias("own_vendor")).join(hopped, "company_id", "left").withColumns({
        "vendor": F.coalesce("own_vendor", "hop_vendor"), "hop": F.col("own_vendor").isNull() & F.col("hop_vendor").isNotNull(),
        "board_url": F.when(F.col("own_vendor").isNull() & F.col("hop_vendor").isNotNull(), F.col("hop_page")).otherwise(F.col("page_url")),
    }).join(names, "vendor", "left")
    outcome = F.when(F.col("vendor").isNull(), "unknown").when(~F.col("platform_type").eqNullSafe("application_system"), "failed").otherwise("classified")
    rows = cut(j.select("company_id", "slug", "vendor", "hop", "board_url", "platform_id", outcome.alias("outcome")))
    summary = rows.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("classified", "unknown", "failed")], F.count("*").alias("total"))
    result = {"rows": rows, "summary": summary}
    if state is not None:
        batch = rows.filter("outcome = 'classified'").select("company_id", "platform_id", F.col("board_url").alias("base_url"))
        result["company_platforms"] = merge.vendor_upsert(state, batch, platforms)[0].drop("merge_action")
    return result


def publish(resolved: dict[str, DataFrame], companies: DataFrame, attempts: DataFrame, run_id: int, now: ColumnOrName, dry_run: bool = False) -> dict[str, DataFrame]:
    """Write a resolution run: the checked resolutions and, always, the attempt trail."""
    res = resolved["resolutions"].withColumns({"dry_run": F.lit(dry_run), "new_verdict": F.lit(None).cast("string"), "new_verdict_url": F.lit(None).cast("string")})
    checked = merge.check_resolutions(res)
    new = merge.write_resolutions(companies, checked.filter(F.col("problem").isNull()), now)
    place = F.col("position.g") * F.lit(1 << 40) + bucket("position.n")
    rows = merge.attempt_rows(resolved["attempts"].withColumn("run_id", F.lit(run_id).cast("bigint")), attempts, by=place)
    return {"companies": new, "attempts": rows, "rejects": checked.filter(F.col("problem").isNotNull())}
