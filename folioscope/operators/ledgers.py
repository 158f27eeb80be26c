"""Runs, costs, decisions, work chunks and life cycles as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import numbered

# fixed values: labels that have to run locally first
LOCAL_FIRST = ["ocr-pass", "transcribe-pass", "triage", "process", "store", "hash-record", "embed-add", "graph-build", "briefing"]


def run_summary(obs: DataFrame, by: str = "run_id") -> DataFrame:
    """Observations rolled up per run with the rules that make a run invalid.

    ``obs(run_id, tier, deep, status)``; status is processed, cached or failed.
    """
    d = obs.groupBy(by).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "processed").alias("processed"),
                            F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "failed").alias("failed"),
                            F.count_if((F.col("tier") >= 1) & ~F.col("deep")).alias("deep_missing"))
    nothing = (F.col("processed") == 0) & (F.col("files") > 0) & (F.col("cached") == 0)
    return d.withColumn("ok", (F.col("failed") == 0) & (F.col("deep_missing") == 0) & ~nothing)


def run_verdicts(obs: DataFrame, synthesis: DataFrame, enrich_required: bool = True, by: str = "run_id") -> DataFrame:
    """(run_id, failure): why a run does not count, a row per reason.

    ``obs`` as in :func:`run_summary`, ``synthesis(run_id, skipped, degraded,
    atomized, written, enriched)`` with at most one row per run.  A run that
    processed nothing fails if its inbox was not empty and nothing was cached,
    and is judged no further; nor is one without a unit that needed a deep pass.
    Otherwise the synthesis must have run, not have fallen back to a template,
    and have made atoms and, where required, enriched clusters.
    """
    d = run_summary(obs, by).join(obs.groupBy(by).agg(F.count_if(F.col("tier") >= 1).alias("deep")), by)
    d = d.join(synthesis.withColumn("present", F.lit(True)), by, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    ran = F.col("processed") > 0
    judged = ran & (F.col("deep") > 0)
    missing = F.col("present").isNull() | (F.coalesce("skipped", F.lit(False)) & none("atomized") & none("written"))
    tests = [(F.col("deep_missing") > 0, "deep-missing"), (~ran & (F.col("files") > 0) & (F.col("cached") <= 0), "nothing-processed"),
             (judged & missing, "synthesis-missing"), (judged & F.coalesce("degraded", F.lit(False)), "synthesis-degraded"),
             (judged & none("atomized"), "no-atoms"), (judged & F.lit(enrich_required) & none("enriched"), "nothing-enriched")]
    return d.select(by, F.explode(F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))).alias("failure"))


def cost_rollup(usage: DataFrame, rates: Sequence[tuple[str, float, float, float, float]], default: str, since: str,
                ceiling_usd: float) -> DataFrame:
    """(provider, tokens, usd, over): four counters times the model's rate per
    million; an unknown model costs the default rate, an answer that no model
    gave ("<synthetic>") nothing.

    ``usage(provider, model, ts, input, output, cache_write, cache_read)``.
    """
    usage = usage.filter(~F.col("model").eqNullSafe(F.lit("<synthetic>")))
    table = {name: r for name, *r in rates}
    low = F.lower("model")

    def rate(i: int) -> Column:
        out = F.lit(table[default][i])
        for name, r in reversed(table.items()):
            out = F.when(low.contains(name), r[i]).otherwise(out)
        return out
    cols = ["input", "output", "cache_write", "cache_read"]
    usd = sum((F.col(c) * rate(i) for i, c in enumerate(cols)), F.lit(0.0)) / 1e6
    tokens = sum((F.col(c) for c in cols), F.lit(0))
    d = usage.filter(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("provider").agg(F.sum(tokens).alias("tokens"), F.sum(usd).alias("usd"))
    return d.withColumn("over", F.col("usd") > ceiling_usd)


def flat_cost_rollup(samples: DataFrame, usd_per_million: float, since: str, ceiling_usd: float) -> DataFrame:
    """(provider, tokens, usd, over) of providers that bill all tokens alike and report a running total.

    ``samples(provider, session, started, ts, total)``: a session begun since the
    given time counts with the last total it reported; a session that reported
    none counts nothing, but its provider is listed.  The last total is one
    aggregate per session, so a session of any length stays spread out.
    """
    begun = samples.filter(F.col("started") >= F.lit(since).cast("timestamp"))
    last = begun.groupBy("provider", "session").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.struct("ts", "total"))).alias("total"))
    d = last.groupBy("provider").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"))
    d = d.withColumn("usd", F.col("tokens") * usd_per_million / 1e6)
    return d.withColumn("over", F.col("usd") > ceiling_usd)


def session_tokens(samples: DataFrame) -> DataFrame:
    """First, last and delta of token samples per run; ``samples(run_id, ts, tokens)``."""
    return samples.filter("tokens is not null").groupBy("run_id").agg(
        F.min_by("tokens", F.struct("ts", "tokens")).alias("first"), F.max_by("tokens", F.struct("ts", "tokens")).alias("last")
    ).withColumn("delta", F.col("last") - F.col("first"))


def placement_violations(runs: DataFrame, local_first: Sequence[str] = tuple(LOCAL_FIRST)) -> DataFrame:
    """Labels that ran in the cloud but never locally; ``runs(label, place)``."""
    d = runs.filter(F.col("label").isin(*local_first))
    cloud = d.filter("place = 'cloud'").select("label").distinct()
    return cloud.join(d.filter("place = 'local'").select("label").distinct(), "label", "left_anti")


def decisions(state: DataFrame, files: DataFrame) -> DataFrame:
    """(id, outcome, target): read, work, forget, missing or invalid, and the
    full path spelled as one file name so equal names cannot collide."""
    path = F.col("id")
    escapes = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    have = files.select(F.col("path").alias("id")).distinct().withColumn("_f", F.lit(True))
    d = state.join(have, "id", "left")
    out = (F.when(escapes, "invalid").when(F.col("action") == "read", "read").when(F.col("_f").isNull(), "missing")
           .when(F.col("action").isin("work", "forget"), F.col("action")).otherwise("invalid"))
    d = d.withColumn("outcome", out)
    moved = F.col("outcome").isin("work", "forget")
    return d.select("id", "outcome", F.when(moved, F.regexp_replace("id", r"[/\\]+", "__")).alias("target"))


def progress(jobs: DataFrame, now: str) -> DataFrame:
    """Done, failed, remaining and the time left per batch.
    ``jobs(batch, started, finished, code)``, finished null while open."""
    d = jobs.groupBy("batch").agg(F.count("*").alias("jobs"), F.count("finished").alias("done"),
                                  F.count_if(F.col("finished").isNotNull() & (F.col("code") != 0)).alias("failed"), F.min("started").alias("_s"))
    elapsed = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("_s").cast("timestamp"))
    left = F.col("jobs") - F.col("done")
    return d.withColumn("remaining", left).withColumn("eta", F.when((F.col("done") > 0) & (left > 0), F.round(
        elapsed / F.col("done") * left).cast("bigint"))).drop("_s")


def chunk_ledger(chunks: DataFrame) -> DataFrame:
    """Status per run and chunk state.  ``chunks(run_id, ord, parent, status, files, prior)``.

    After the first quota stop of a run nothing was attempted: the other chunks
    of the item that was stopped are "not_attempted", later items keep the
    ``prior`` status an earlier run left them, if there is one.

    The stop is one minimum per run joined back, not a running window, so a run
    of any length stays spread out.
    """
    stop = chunks.filter("status = 'insufficient_quota'").groupBy("run_id").agg(F.min(F.struct("ord", "parent")).alias("stop"))
    d = chunks.join(stop, "run_id", "left")
    same = F.col("parent").eqNullSafe(F.col("stop.parent"))
    left = F.when(same | F.col("prior").isNull(), "not_attempted").otherwise(F.col("prior"))
    real = F.when(F.col("ord") > F.col("stop.ord"), left).otherwise(F.col("status"))
    return d.groupBy("run_id", real.alias("status")).agg(F.count("*").alias("chunks"), F.sum("files").alias("files"))


def ledger_failures(lines: DataFrame, since: str, required: Sequence[str], line: str = "line", key: str = "id") -> DataFrame:
    """(id, problem): lines that are not JSON, and missing fields of records at
    or after the cutoff."""
    v = F.try_parse_json(F.col(line))
    ts = F.coalesce(F.try_variant_get(v, "$.ts", "string"), F.lit(""))
    gone = F.filter(F.array(*[F.when(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) == "", F.lit(f"missing:{k}")) for k in required]),
                    lambda x: x.isNotNull())
    problems = (F.when(v.isNull(), F.array(F.lit("not-json"))).when((ts != "") & (ts >= since), gone)
                .otherwise(F.array().cast("array<string>")))
    return lines.select(key, F.explode(problems).alias("problem"))


# fixed values: allowed steps of an item
TRANSITIONS = {"pending": ["staged"], "staged": ["measured", "rolled_back"], "measured": ["measured", "rolled_back"], "rolled_back": ["staged"]}


def item_states(events: DataFrame) -> DataFrame:
    """(item, status, events) by replay: the status of the latest event."""
    return events.groupBy("item").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("events"))


def illegal_steps(events: DataFrame, allowed: dict[str, list[str]] | None = None, start: str = "pending") -> DataFrame:
    """(item, seq, before, status) of steps the life cycle does not allow.

    The predecessor comes from a distributed numbering and an equi-join, so an
    item with a third of all events is not one task.
    """
    allowed = allowed or TRANSITIONS
    d = numbered(events.select("item", "ts", "seq", "status"), ["item"], [F.col("ts"), F.col("seq")], "rn")
    prev = d.select("item", (F.col("rn") + 1).alias("rn"), F.col("status").alias("before"))
    d = d.join(prev, ["item", "rn"], "left").withColumn("before", F.coalesce("before", F.lit(start)))
    ok = F.lit(False)
    for a, targets in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col("status").isin(*targets))
    return d.filter(~ok).select("item", "seq", "before", "status")


def duplicate_submissions(jobs: DataFrame) -> DataFrame:
    """(job, of): a submission whose fingerprint an earlier live job carries."""
    live = jobs.filter(F.col("status").isin("queued", "running", "completed"))
    first = live.groupBy("fingerprint").agg(F.min_by("job", F.struct("ts", "job")).alias("of"), F.min(F.struct("ts", "job")).alias("_o"))
    return jobs.join(first, "fingerprint").filter(F.struct("ts", "job") > F.col("_o")).select("job", "of")


def red_since(checks: DataFrame, max_days: float, now: str) -> DataFrame:
    """(check, first_red_at, failing): red without a break for too long.

    ``checks(check, ts, red)``: the first red after the last green.
    """
    green = checks.filter(~F.col("red")).groupBy("check").agg(F.max("ts").alias("green"))
    d = checks.filter("red").join(green, "check", "left").filter(F.col("green").isNull() | (F.col("ts") > F.col("green")))
    d = d.groupBy("check").agg(F.min("ts").alias("first_red_at"))
    days = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("first_red_at").cast("timestamp"))) / 86400
    return d.withColumn("failing", days > max_days)


# -- subtitles and feeds ----------------------------------------------------------------------

def subtitle_lines(texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Lines that carry speech: cue numbers, timings, headers and tags out."""
    from ..functions import text as T
    d = texts.select(*key, F.posexplode(T.lines_of(F.col(text))).alias("line", "raw")).withColumn("raw", T.strip(F.col("raw")))
    noise = F.col("raw").isin("", "WEBVTT") | F.col("raw").contains("-->") | F.col("raw").rlike(r"^\d+$") | F.col("raw").rlike(r"^(Kind:|Language:|NOTE)")
    said = T.strip(T.sub(T.sub(F.col("raw"), r"<[^>]+>", ""), r"\s*(align|position):\S+", ""))
    return d.filter(~noise).select(*key, "line", said.alias("said")).filter("said <> ''")


def drop_repeats(lines: DataFrame, keys: list[str], order: list[str], value: str = "said") -> DataFrame:
    """Lines unlike the line before them.  Equal to the previous line is equal
    to the previous kept line, so one look back is enough."""
    d = numbered(lines, keys, [F.col(c) for c in order], "rn")
    prev = d.select(*keys, (F.col("rn") + 1).alias("rn"), F.col(value).alias("_prev"))
    return d.join(prev, [*keys, "rn"], "left").filter(~F.col("_prev").eqNullSafe(F.col(value))).drop("_prev")


def feed_ids(feeds: DataFrame, keep: int = 15, text: str = "xml") -> DataFrame:
    """(channel, pos, id): the newest ids a feed lists."""
    ids = F.slice(F.regexp_extract_all(F.col(text), F.lit(r"<yt:videoId>([^<]+)</yt:videoId>"), F.lit(1)), 1, keep)
    return feeds.select("channel", F.posexplode(ids).alias("pos", "id"))


def new_items(feed: DataFrame, archive: DataFrame, keys: Sequence[str] = ("channel", "id")) -> DataFrame:
    return feed.join(archive.select(*keys).distinct(), list(keys), "left_anti")


def site_urls(seeds: DataFrame, cap: int) -> DataFrame:
    """(seed, url): addresses of a site from its saved sitemaps, or from the
    links of the start page when no sitemap lists any; same origin, capped.
    ``seeds(seed, robots, sitemaps, html)`` with sitemaps an array of texts."""
    from ..functions import html as H
    from ..functions import text as T
    locs = F.flatten(F.transform("sitemaps", lambda x: T.find_all(x, r"<loc>(.*?)</loc>", 1)))
    same = F.filter(locs, lambda u: H.origin(u) == H.origin(F.col("seed")))
    d = T.staged(seeds, listed=F.array_distinct(F.concat(F.array("seed"), same)))
    urls = F.when(F.size("listed") > 1, F.col("listed")).otherwise(
        F.array_distinct(F.concat(F.array("seed"), H.same_origin_links(F.col("html"), F.col("seed")))))
    return d.select("seed", F.posexplode(F.slice(urls, 1, cap)).alias("pos", "url"))


def sitemap_addresses(robots: Column, origin: Column) -> Column:
    """Sitemaps a robots file names, or the default place."""
    named = F.regexp_extract_all(robots, F.lit(r"(?i)Sitemap:\s*(\S+)"), F.lit(1))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(origin, F.lit("/sitemap.xml"))))
