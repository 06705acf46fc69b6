"""Relational work on results: survivors, shortlists, filters, orders, counts, comparisons."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.functions.text import bind, values_table

TIERS = {"Tier 1: Shortlist Ready": 1, "Tier 2: Needs Minor Polish": 2, "Tier 3: Overhaul Required": 3}


def file_key(name: str = "file_name") -> Column:
    return F.lower(F.trim(F.col(name)))


def with_file_key(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds file_key and submission_id."""
    safe = F.regexp_replace(file_key(name), r"[^a-z0-9._-]", "_")
    return df.withColumn("file_key", file_key(name)).withColumn("submission_id", F.url_encode(F.concat(F.lit("resume-"), safe)))


def survivors(df: DataFrame, order: Sequence[Column], key: Column | None = None) -> DataFrame:
    """The first row of each key in an order. Rows without a key go.

    A key's candidates are cut down before the window where Catalyst sees the rank limit, so that a hot key costs one row a task.
    """
    k = key if key is not None else file_key()
    return df.withColumn("_n", F.row_number().over(W.partitionBy(k).orderBy(*order))).where((F.col("_n") == 1) & k.isNotNull() & (k != "")).drop("_n")


def dedup_best(df: DataFrame) -> DataFrame:
    """By file: the highest effective score, of equal ones the later."""
    return survivors(df, (F.desc("effective_score"), F.desc("seq")))


def dedup_newest(df: DataFrame) -> DataFrame:
    """By file: the row updated last."""
    return survivors(df, (F.desc("updated_at"), F.desc("created_at"), F.desc("seq")))


def dedup_prefer_complete(df: DataFrame) -> DataFrame:
    """By file: a row with a score before one without, then the newest."""
    return survivors(df, (F.desc(F.col("overall_score").isNotNull()), F.desc("updated_at"), F.desc("seq")))


def dedup_first(df: DataFrame, key: str = "id") -> DataFrame:
    """By id: the first row."""
    return survivors(df, ("seq",), F.col(key))


def dedup_done(df: DataFrame) -> DataFrame:
    """By file: a finished row before another, then the first."""
    return survivors(df, (F.desc(F.col("status") == "done"), F.col("seq")))


def is_shortlisted(cutoff: float = 75) -> Column:
    return (F.col("effective_score") >= cutoff) & ~F.col("readiness_tier").startswith("Tier 3") & (F.col("n_critical") == 0)


def shortlist(df: DataFrame, cutoff: float = 75) -> DataFrame:
    return df.where(is_shortlisted(cutoff))


def tier_counts(df: DataFrame) -> DataFrame:
    """(tier, n), with a row `all`."""
    return df.rollup(F.substring("readiness_tier", 1, 6).alias("tier")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("tier", F.lit("all")).alias("tier"), "n")


def band_table(df: DataFrame) -> DataFrame:
    return values_table(df.sparkSession, lexicons.BANDS, "band, low, high, label")


def band_counts(df: DataFrame) -> DataFrame:
    """(band, n), empty bands with 0, and a row `all`. A score between two bands is in none of them.

    Scores are counted first; the bands then meet at most one row for each score.
    """
    scores = df.groupBy("effective_score").agg(F.count(F.lit(1)).alias("k"))
    bands = band_table(df).join(scores, F.col("effective_score").between(F.col("low"), F.col("high")), "left")
    each = bands.groupBy("band").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return each.union(df.select(F.lit("all"), F.lit(1).alias("n")).groupBy("all").agg(F.count("n")))


def filter_board(df: DataFrame, shortlisted: bool = False, tier: str = "all", band: str = "all", query: str = "", cutoff: float = 75, extra: Sequence[str] = ()) -> DataFrame:
    """Leaderboard filter; extra: further text columns that the query is searched in."""
    out = df.where(is_shortlisted(cutoff)) if shortlisted else df
    if tier != "all":
        out = out.where(F.col("readiness_tier").startswith(tier))
    if band != "all":
        low, high = next((b[1], b[2]) for b in lexicons.BANDS if b[0] == band)
        out = out.where(F.col("effective_score").between(low, high))
    q = query.strip().lower()
    if q:
        fields = [F.coalesce(F.col(c), F.lit("")) for c in ("candidate_name", "role", "assumed_role", "file_name")] + [F.array_join(c, " ") for c in extra]
        test = F.lit(False)
        for f in fields:
            test = test | F.lower(f).contains(q)
        out = out.where(test)
    return out


def search_master(df: DataFrame, query: str) -> DataFrame:
    """As the leaderboard's search, in matched and missing skills too."""
    return filter_board(df, query=query, extra=("matched", "missing"))


def filter_history(df: DataFrame, status: str = "active", tier: str = "all", query: str = "") -> DataFrame:
    out = df if status == "all" else df.where(F.col("is_deleted") if status == "deleted" else ~F.col("is_deleted"))
    if tier != "all":
        out = out.where(F.col("readiness_tier") == tier)
    q = query.strip().lower()
    if q:
        texts = F.lower(F.col("candidate_name")).contains(q) | F.lower(F.col("role")).contains(q) | F.lower(F.col("file_name")).contains(q)
        out = out.where(texts | F.exists("matched", lambda s: F.contains(F.lower(s), F.lit(q))) | F.exists("recommended", lambda s: F.contains(F.lower(s), F.lit(q))))
    return out


def sort_keys(key: str) -> Column:
    return {
        "score": F.col("effective_score"),
        "name": F.lower("candidate_name"),
        "file": F.lower("file_name"),
        "tier": F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in TIERS.items() for x in p)), F.col("readiness_tier")), F.lit(99)),
        "fit": F.col("fit"),
        "issues": F.col("n_issues") + 5 * F.col("n_critical"),
        "missing": F.size("missing"),
        "structure": F.coalesce(F.col("structure"), F.lit(0)) if key == "structure" else F.lit(0),
        "created": F.col("created_at"),
        "updated": F.col("updated_at"),
    }[key]


def sort_board(df: DataFrame, key: str = "score", asc: bool = False) -> DataFrame:
    """Order by one of the keys, ties by id."""
    k = sort_keys(key)
    return df.orderBy(k.asc() if asc else k.desc(), "id")


def range_slice(df: DataFrame, key: Column, n: int = 64) -> Column:
    """The range of a numeric key that a row lies in, from 0; bounds are approximate quantiles, so that no slice is much larger than the others."""
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 1000)).first()[0] or []
    bounds = sorted(set(found))
    return bind(key, lambda k: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= k))) if bounds else F.lit(0)


def _id_key(df: DataFrame, id_col: str) -> Column:
    """A number that rises with an id: itself, or the seven bytes of a text after what all ids have in common."""
    if dict(df.dtypes)[id_col] != "string":
        return F.col(id_col).cast("long")
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]).encode())
    return F.conv(F.hex(F.rpad(F.substring(F.encode(id_col, "utf-8"), shared + 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")


def with_rank(df: DataFrame, by: str = "effective_score") -> DataFrame:
    """Adds rank (1, 2, ... by falling score, ties by id). A score's rows are cut into ranges of ids, so that no single task orders all rows, nor a frequent score's.

    A row's rank is the count of higher scores, of its score's earlier ranges, and its place in its own range.
    """
    cut = df.withColumn("_slice", range_slice(df, _id_key(df, "id")))
    sizes = cut.groupBy(by, "_slice").agg(F.count(F.lit(1)).alias("_k"))
    within = F.coalesce(F.sum("_k").over(W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy(by).agg(F.sum("_k").alias("_k"))
    above = F.coalesce(F.sum("_k").over(W.orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over one row for each score
    places = sizes.withColumn("_within", within).drop("_k").join(totals.withColumn("_above", above).drop("_k"), by)
    own = F.row_number().over(W.partitionBy(by, "_slice").orderBy("id"))
    ranked = cut.withColumn("_own", own).join(places, [by, "_slice"])
    return ranked.withColumn("rank", (F.col("_above") + F.col("_within") + F.col("_own")).cast("int")).drop("_own", "_above", "_within", "_slice")


def top_n(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("effective_score"), "id").limit(n)


def batch_kpis(df: DataFrame) -> DataFrame:
    """One row: total, average, best, and tier counts with their shares in percent."""
    n = F.count(F.lit(1))
    tiers = {f"tier{k}": F.count_if(F.col("readiness_tier").startswith(f"Tier {k}")) for k in (1, 2, 3)}
    share = lambda c: F.when(n > 0, F.floor(c * 100 / F.greatest(n, F.lit(1)) + 0.5)).otherwise(0).cast("int")
    mean = F.coalesce(F.floor(F.avg("effective_score") + 0.5), F.lit(0)).cast("int")
    return df.agg(n.alias("total"), mean.alias("average"), F.coalesce(F.max("effective_score"), F.lit(0.0)).alias("best"), *(c.alias(k) for k, c in tiers.items()), *(share(c).alias(f"{k}_pct") for k, c in tiers.items()))


def skill_frequency(df: DataFrame, col: str, n: int) -> DataFrame:
    """(skill, n, share): the n most frequent skills of an array column, ties by name, share of all rows in percent."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.select(F.explode(F.array_distinct(F.col(col))).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill").limit(n)
    return top.crossJoin(F.broadcast(total)).select("skill", "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("int").alias("share"))  # one row


def skill_demand(df: DataFrame) -> DataFrame:
    return skill_frequency(df, "matched", 8)


def skill_gaps(df: DataFrame) -> DataFrame:
    return skill_frequency(df, "missing", 6)


def compare(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The candidates of ids side by side: score, whether leading, critical issues, skills, and how many skills all share."""
    some = select_ids(df, ids)
    n = some.agg(F.count(F.lit(1)).alias("n_all"))
    common = some.select("id", F.explode(F.array_distinct(F.col("matched"))).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n_all"))
    shared = common.agg(F.count(F.lit(1)).alias("n_common"))
    best = some.agg(F.max("effective_score").alias("best"))
    rows = some.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(best))  # one row each
    return rows.select("id", "effective_score", (F.col("effective_score") == F.col("best")).alias("leads"), "n_critical", F.size("matched").alias("n_skills"), "n_common")


def common_skills(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(skill): what all candidates of ids have."""
    some = select_ids(df, ids)
    n = some.agg(F.count(F.lit(1)).alias("n_all"))
    held = some.select("id", F.explode(F.array_distinct(F.col("matched"))).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("k"))
    return held.join(F.broadcast(n), F.col("k") == F.col("n_all")).select("skill")


def skill_overlap(df: DataFrame, group: str = "jd_id") -> DataFrame:
    """(group, profile_a, profile_b, common, pairs): for pairs of skill profiles of a cohort, how many skills they share and how many pairs of candidates that is.

    Candidates with equal skill sets are one profile, so that pairs grow with the profiles and not with the square of the candidates.
    """
    held = df.select(group, F.array_sort(F.array_distinct(F.col("matched"))).alias("skills")).where(F.size("skills") > 0)
    profiles = held.groupBy(group, "skills").agg(F.count(F.lit(1)).alias("k")).withColumn("profile", F.array_join("skills", "|"))
    each = profiles.select(group, "profile", "k", F.explode("skills").alias("skill"))
    a, b = (each.select(F.col(group), F.col("skill"), F.col("profile").alias(f"profile_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    pairs = a.join(b, [group, "skill"]).where(F.col("profile_a") <= F.col("profile_b"))
    n = F.when(F.col("profile_a") == F.col("profile_b"), F.col("k_a") * (F.col("k_a") - 1) / 2).otherwise(F.col("k_a") * F.col("k_b")).cast("long")
    return pairs.groupBy(group, "profile_a", "profile_b", n.alias("pairs")).agg(F.count(F.lit(1)).alias("common"))


def skill_partners(df: DataFrame, group: str = "jd_id", least: int = 2, n: int = 5) -> DataFrame:
    """(group, id, partner, common, rank): for each candidate the n others of its cohort with most skills in common, `least` or more, ties by id.

    A prefix-filtered set join: with skills in order of rarity, two sets share `least` skills only if they share one of their rarest |set| - least + 1, so that
    frequent skills are met only by sets that have little else. Candidates with equal sets are joined as one profile, which stands for its n + 1 first ids;
    a pair of profiles is found at its first common skill alone. Output is n rows a candidate at most.
    """
    held = df.select(group, "id", F.array_sort(F.array_distinct(F.col("matched"))).alias("skills")).where(F.size("skills") >= least).withColumn("profile", F.array_join("skills", "\u0000"))
    profiles = held.select(group, "profile", "skills").distinct()
    each = profiles.select(group, "profile", F.explode("skills").alias("skill"))
    rarity = each.groupBy(group, "skill").agg(F.count(F.lit(1)).alias("k"))
    ordered = each.join(rarity, [group, "skill"]).groupBy(group, "profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "skill"))), lambda x: x["skill"]).alias("s"))
    ordered = ordered.withColumn("prefix", F.slice("s", F.lit(1), F.size("s") - (least - 1)))
    a, b = (ordered.select(group, F.col("profile").alias(f"profile_{x}"), F.col("s").alias(f"s_{x}"), F.col("prefix").alias(f"prefix_{x}"), F.explode("prefix").alias("skill")) for x in "ab")
    met = a.join(b, [group, "skill"]).where(F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("skill"))
    pairs = met.select(group, "profile_a", "profile_b", F.size(F.array_intersect("s_a", "s_b")).alias("common")).where(F.col("common") >= least)
    first = held.withColumn("_n", F.row_number().over(W.partitionBy(group, "profile").orderBy("id"))).where(F.col("_n") <= n + 1)
    near = pairs.join(first.select(group, F.col("profile").alias("profile_b"), F.col("id").alias("partner")), [group, "profile_b"])
    near = near.withColumn("_n", F.row_number().over(W.partitionBy(group, "profile_a").orderBy(F.desc("common"), "partner"))).where(F.col("_n") <= n + 1)
    own = held.select(group, "id", F.col("profile").alias("profile_a")).join(near.select(group, "profile_a", "partner", "common"), [group, "profile_a"]).where(F.col("id") != F.col("partner"))
    return own.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("common"), "partner"))).where(F.col("rank") <= n).select(group, "id", "partner", "common", "rank")


def history_stats(df: DataFrame) -> DataFrame:
    """One row: total, active, deleted, average (deleted ones included)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_deleted")).alias("active"), F.count_if("is_deleted").alias("deleted"), F.floor(F.avg("effective_score") + 0.5).cast("int").alias("average"))


def select_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def pending(items: DataFrame, done: DataFrame, key: str = "file_key") -> DataFrame:
    """Items that no finished row answers."""
    return without_ids(items, done, key)


def in_flight(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("queued", "extracting", "analyzing", "retrying"))


def requeue_failed(items: DataFrame) -> DataFrame:
    return items.withColumn("status", F.when(F.col("status") == "error", "queued").otherwise(F.col("status")))


def batch_progress(items: DataFrame, statuses: Sequence[str] = ("queued", "analyzing", "retrying", "error", "done")) -> DataFrame:
    """One row: counts by status, total, and the share that is finished."""
    n = F.count(F.lit(1))
    ended = F.count_if(F.col("status").isin("done", "error"))
    return items.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), n.alias("total"), F.when(n > 0, F.floor(ended * 100 / F.greatest(n, F.lit(1)) + 0.5)).otherwise(0).cast("int").alias("percent"))


def cohort_cube(df: DataFrame) -> DataFrame:
    """(tier, arc, basis, n, average): all cross-tabs, `all` where a dimension is summed up."""
    dims = ("readiness_tier", "role_arc", "evaluation_basis")
    made = df.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("effective_score") * 10 + 0.5).cast("long").alias("average_x10"), F.grouping_id().alias("g"))
    names = [F.when(F.col("g").bitwiseAND(4 >> i) != 0, "all").otherwise(F.col(d)).alias(a) for i, (d, a) in enumerate(zip(dims, ("tier", "arc", "basis"), strict=True))]
    return made.select(*names, "n", "average_x10")


def ranking_quality(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives, mean scores and the rank-sum AUC of a score against a 0/1 label.

    Scores are counted by value first. The counts are cut into ranges of scores and summed up in each; the ranges before add their sums.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    counts = counts.withColumn("r", range_slice(counts, F.col("s").cast("double")))
    sums = counts.groupBy("r").agg(F.sum("q").alias("k"))
    lower = sums.select("r", F.coalesce(F.sum("k").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lower"))  # over one row for each range
    counts = counts.join(F.broadcast(lower), "r")
    below = F.col("lower") + F.coalesce(F.sum("q").over(W.partitionBy("r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("p") * (2 * below + F.col("q")))
    total = F.sum("p") * F.sum("q")
    mean = lambda c: F.floor(F.sum(F.col("s") * F.col(c)) / F.greatest(F.sum(c), F.lit(1)) * 1000 + 0.5).cast("long")
    return won.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), mean("p").alias("mean_positive_x1000"), mean("q").alias("mean_negative_x1000"), F.floor(F.sum("won") * 1000000 / (2 * F.greatest(total, F.lit(1)))).cast("long").alias("auc_x1e6"))
