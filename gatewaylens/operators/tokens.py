"""The pool of donated tokens: ranking, allocation, status, upserts, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators.ordered import numbered, with_next
from gatewaylens.operators.sweep import best_live
from gatewaylens.schemas import QUOTA_SNAPSHOT
from gatewaylens.session import written


def live_quota(tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """Live tokens times the quota categories; a token without a quota row has 0 left and no reset."""
    categories = F.array(*[F.lit(c) for c in C.CATEGORIES])
    wanted = tokens.where("NOT revoked").select(
        F.col("id").alias("token_id"), "last_ok_at", F.explode(categories).alias("category")
    )
    quota = limits.select("token_id", "category", "remaining", "reset")
    zero = F.lit(0).cast(limits.schema["remaining"].dataType)
    return wanted.join(quota, ["token_id", "category"], "left").withColumn("remaining", F.coalesce("remaining", zero))


def _token_order() -> list[Column]:
    return [
        F.col("reset").asc_nulls_first(),
        F.col("last_ok_at").asc_nulls_first(),
        F.col("token_id").asc(),
    ]


def rank_tokens(tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """Rank of every live token in each category: most quota left, then earliest reset."""
    quota = live_quota(tokens, limits)
    ranked = numbered(quota, ["category"], [F.col("remaining").desc(), *_token_order()], "rank")
    return ranked.select("category", "rank", "token_id", "remaining", "reset")


def choose_token(tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """The token each category would use now."""
    first = F.min_by(
        F.struct("token_id", "remaining", "reset"),
        F.struct(-F.col("remaining"), F.col("reset"), F.col("last_ok_at"), F.col("token_id")),
    )
    best = live_quota(tokens, limits).groupBy("category").agg(first.alias("best"))
    return best.select("category", "best.*")


def _parsed_quota(snapshots: DataFrame) -> DataFrame:
    """A row per category of each snapshot; a number that the JSON does not have is 0."""
    parsed = F.from_json("body", QUOTA_SNAPSHOT)["resources"]
    rows = snapshots.select("token_id", "fetched_at", "snap_id", F.explode(parsed).alias("category", "quota"))
    return rows.select(
        "token_id", "category", "fetched_at", "snap_id", F.coalesce("quota.remaining", F.lit(0)).cast("bigint").alias("remaining"),
        F.coalesce("quota.reset", F.lit(0).cast("bigint")).alias("reset_s"))


def quota_versions(snapshots: DataFrame) -> DataFrame:
    """(token_id, category, remaining, reset_s, begin, until): how long each quota that was read held, null for the newest.

    Of snapshots of a token at one time that with the largest id counts; those without a time do not.
    """
    keys = ["token_id", "category"]
    read = _parsed_quota(snapshots).where("fetched_at IS NOT NULL").groupBy(*keys, F.col("fetched_at").alias("begin")).agg(
        F.max(F.struct("snap_id", "remaining", "reset_s")).alias("newest"))
    flat = read.select(*keys, "begin", "newest.remaining", "newest.reset_s")
    return with_next(flat, keys, [F.col("begin")], "begin", "until")


def choose_token_as_of(requests: DataFrame, tokens: DataFrame, snapshots: DataFrame, partitions: int | None = None) -> DataFrame:
    """The token that each request (`id, category, created_at`) would use at its own time: of the quotas read before it and not yet
    read again, the most left, then the earliest reset, the least recently used and the smallest token id. Null where none was read.

    Scores change with every quota that is read, so each version of a quota is a span, and the best live one is found by a
    sweep per category: a row per request and version, however many tokens there are.
    """
    live = tokens.where("NOT revoked").select(F.col("id").alias("token_id"), C.micros(F.col("last_ok_at")).alias("used"))
    versions = quota_versions(snapshots).join(live, "token_id")
    first = F.lit(2**62)  # no time comes before all times
    rank = F.array("remaining", -F.col("reset_s"), F.coalesce(-F.col("used"), first), -F.col("token_id"))
    asked = requests.select("id", "category", "created_at")
    found = best_live(
        asked, versions, lambda: F.col("category"), "created_at", F.col("begin"), F.col("until"), rank, F.struct("token_id", "remaining"), "best",
        partitions)
    return found.select("id", "category", "best.token_id", "best.remaining")


def token_intervals(events: DataFrame) -> DataFrame:
    """(token_id, revoked, begin, until): the runs of equal state of each token by its events, `until` null for the state that still holds.

    A donation makes a token live, refused credentials revoke it. At one time the event with the largest id decides. Events
    without a time count for nothing.
    """
    changing = _changing_events(events).where("created_at IS NOT NULL")
    states = changing.groupBy("token_id", F.col("created_at").alias("begin")).agg(F.max(F.struct("id", "refused")).alias("last"))
    states = written(numbered(states.select("token_id", "begin", F.col("last.refused").alias("revoked")), ["token_id"], [F.col("begin")], "n_"), "states")
    before = states.select("token_id", (F.col("n_") + 1).alias("n_"), F.col("revoked").alias("was"))
    turns = states.join(before, ["token_id", "n_"], "left").where("was IS NULL OR was != revoked").select("token_id", "revoked", "begin")
    return with_next(turns, ["token_id"], [F.col("begin")], "begin", "until").select("token_id", "revoked", "begin", "until")


def _lowest_levels(quota: DataFrame, asked: DataFrame) -> DataFrame:
    """(category, lowest): the level of quota down to which a category's requests can reach.

    Tokens become one row per category and amount left. Between two amounts the number of tokens that still have a
    unit per level is constant, so a stretch of levels is one row, and the stretch in which the requests end gives the level.
    """
    amounts = quota.groupBy("category", F.col("remaining").cast("bigint").alias("top")).agg(F.count("*").alias("tokens"))
    falling = Window.partitionBy("category").orderBy(F.desc("top"))
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.lead("top").over(falling), F.lit(0).cast("bigint"))
    stretches = amounts.select("category", "top", F.sum("tokens").over(upto).alias("alive"), below.alias("below"))
    units = F.col("alive") * (F.col("top") - F.col("below"))
    stretches = stretches.withColumn("past", F.sum(units).over(upto)).withColumn("before", F.col("past") - units)
    wanted = asked.groupBy("category").agg(F.count("*").alias("requests"))
    reached = stretches.join(wanted, "category").where("before < requests")
    level = F.when(F.col("past") <= F.col("requests"), F.col("below") + 1).otherwise(
        F.col("top") - F.expr("(requests - 1 - before) div alive"))
    return reached.groupBy("category").agg(F.min(level).alias("lowest"))


def allocate_requests(requests: DataFrame, tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """Give each request (`id, category, created_at`) the token that depletes the pool evenly.

    Taking always the token with the most quota left, then the earliest reset, uses up units of quota in the
    order (level falling, reset, id): request n of a category gets unit n. Only levels that the requests reach become
    units, so there are no more of them than requests and tokens. Both sides are numbered without gathering a category
    in one task and met by an equi-join on (category, n), which is even by nature. Requests beyond the whole
    quota get no token.
    """
    asked = requests.select("id", "category", "created_at")
    # Read twice below, and never larger than the pool times the categories.
    quota = written(live_quota(tokens, limits).where("remaining > 0"), "quota")
    levels = F.explode(F.sequence(F.col("lowest"), F.col("remaining").cast("bigint"))).alias("level")
    reached = quota.join(_lowest_levels(quota, asked), "category").where("remaining >= lowest")
    units = reached.select("category", "token_id", "reset", "last_ok_at", levels)
    units = numbered(units, ["category"], [F.col("level").desc(), *_token_order()]).select("category", "n", "token_id")
    asked = numbered(asked, ["category"], [F.col("created_at"), F.col("id")]).select("id", "category", "n")
    return asked.join(units, ["category", "n"], "left").select("id", "category", "token_id")


def donor_attribution(allocated: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests per donor and category, through the token used."""
    used = allocated.where("token_id IS NOT NULL").groupBy("token_id", "category").agg(F.count("*").alias("requests"))
    owners = tokens.select(F.col("id").alias("token_id"), "github_user")
    return used.join(owners, "token_id").select("github_user", "category", "requests")


def ingest_rate_limits(snapshots: DataFrame) -> DataFrame:
    """The newest quota per (token, category) from snapshot JSON, by fetch time and then snapshot id.

    A number that the JSON does not have is 0.
    """
    parsed = F.from_json("body", QUOTA_SNAPSHOT)["resources"]
    rows = snapshots.select("token_id", "fetched_at", "snap_id", F.explode(parsed).alias("category", "quota"))
    # Time and id come first in the struct and decide; the rest goes along.
    newest = F.max(F.struct("fetched_at", "snap_id", "quota.limit", "quota.remaining", "quota.reset"))
    return rows.groupBy("token_id", "category").agg(newest.alias("newest")).select(
        "token_id", "category",
        F.coalesce("newest.limit", F.lit(0)).alias("rate_limit"),
        F.coalesce("newest.remaining", F.lit(0)).alias("remaining"),
        C.epoch_to_ntz(F.coalesce("newest.reset", F.lit(0).cast("bigint"))).alias("reset"),
        F.col("newest.fetched_at").alias("updated_at"),
    )


def merge_rate_limits(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The quota table after ingesting snapshots: a snapshot's row replaces the current one."""
    fresh = ingest_rate_limits(snapshots)
    keys = ["token_id", "category"]
    values = ["rate_limit", "remaining", "reset", "updated_at"]
    known = current.select(*keys, F.struct(*[F.col(v) for v in values if v in current.columns]).alias("old"))
    merged = known.join(fresh.withColumn("fresh", F.lit(True)), keys, "full_outer")
    old_fields = {v for v in values if v in current.columns}

    def pick(v: str) -> Column:
        old = F.col(f"old.{v}") if v in old_fields else F.lit(None)
        return F.when(F.col("fresh"), F.col(v)).otherwise(old).alias(v)

    return merged.select(*keys, *[pick(v) for v in values])


def touch_last_ok(tokens: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Tokens with `last_ok_at` set to their newest snapshot, where there is one."""
    seen = snapshots.groupBy(F.col("token_id").alias("id")).agg(F.max("fetched_at").alias("seen_at"))
    touched = tokens.join(seen, "id", "left")
    return touched.withColumn("last_ok_at", F.coalesce("seen_at", "last_ok_at")).select(*tokens.columns)


TOKEN_COLUMNS = ["github_user", "id", "token", "created_at", "revoked", "last_ok_at", "scopes"]


def upsert_tokens(pool: DataFrame, donations: DataFrame) -> DataFrame:
    """The pool after donations, one row per user.

    The newest donation of a user replaces token and scopes, makes the token live and sets `last_ok_at`;
    the id and creation time of a known user stay. A new user's id is made from the user's name where ids are
    texts (in the form of a UUID), else it lies above the pool's largest, offset by the id of the first donation.
    """
    newest = F.max_by(F.struct("token", "scopes"), F.struct("donated_at", "donation_id"))
    given = donations.groupBy("github_user").agg(
        newest.alias("new"),
        F.max("donated_at").alias("given_at"),
        F.min(F.struct("donated_at", "donation_id")).alias("first"),
    )
    if pool.schema["id"].dataType.typeName() == "string":
        new_id = F.regexp_replace(F.md5("github_user"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    else:
        top_id = pool.select(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
        new_id = top_id + 1 + F.col("first.donation_id")
    merged = pool.select(*TOKEN_COLUMNS).join(given, "github_user", "full_outer")
    donated = F.col("given_at").isNotNull()
    return merged.select(
        "github_user",
        F.coalesce(F.col("id"), new_id).alias("id"),
        F.when(donated, F.col("new.token")).otherwise(F.col("token")).alias("token"),
        # A donated row without an id in the pool is new; a known row keeps even a null creation time.
        F.when(F.col("id").isNull(), F.col("first.donated_at")).otherwise(F.col("created_at")).alias("created_at"),
        F.when(donated, F.lit(False)).otherwise(F.col("revoked")).alias("revoked"),
        F.coalesce("given_at", "last_ok_at").alias("last_ok_at"),
        F.when(donated, F.col("new.scopes")).otherwise(F.col("scopes")).alias("scopes"),
    )


def _changing_events(events: DataFrame) -> DataFrame:
    """Donations and refused credentials, the latter marked `refused`."""
    refused = (F.col("kind") == "response") & C.is_bad_credential(F.col("status"), F.col("body"))
    return events.withColumn("refused", refused).where(F.col("refused") | (F.col("kind") == "donation"))


def status_changes(events: DataFrame) -> DataFrame:
    """Per token the last status-changing event and the number of refused credentials.

    Donations bring a token back, bad credentials revoke it, all else changes nothing. The result is
    mergeable: the newest change and the sum of `revocations` over any split of the events.
    """
    changing = _changing_events(events)
    last = F.max(F.struct("created_at", "id", "refused"))
    found = changing.groupBy("token_id").agg(last.alias("last"), F.count_if("refused").alias("revocations"))
    return found.select("token_id", F.col("last.created_at").alias("changed_at"), F.col("last.refused").alias("refused"), "revocations")


def token_status(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each token's state after all events; without a changing event its own state holds."""
    return status_from_changes(status_changes(events), tokens)


def status_from_changes(changes: DataFrame, tokens: DataFrame) -> DataFrame:
    pool = tokens.select(F.col("id").alias("token_id"), "github_user", F.col("revoked").alias("was_revoked"))
    return pool.join(changes, "token_id", "left").select(
        "token_id", "github_user",
        F.coalesce("refused", "was_revoked").alias("revoked"),
        "changed_at",
        F.coalesce("revocations", F.lit(0).cast("bigint")).alias("revocations"),
    )


def token_age(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens by age in words."""
    age = C.humanize_age(C.age_seconds(F.col("created_at"), as_of))
    return tokens.groupBy(age.alias("age")).agg(
        F.count("*").alias("tokens"), F.count_if(~F.col("revoked")).alias("live_tokens")
    )


def donor_summary(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Number of live tokens and the newest donor, as one row."""
    newest = F.max(F.struct("created_at", "id", "github_user"))
    summary = tokens.where("NOT revoked").agg(F.count("*").alias("donors"), newest.alias("newest"))
    at = F.col("newest.created_at")
    return summary.select(
        "donors", F.col("newest.github_user").alias("last_user"), at.alias("last_at"),
        C.humanize_age(C.age_seconds(at, as_of)).alias("age"),
    )


def migrate_tokens(source: DataFrame, target: DataFrame, exclude: str) -> DataFrame:
    """The target table after merging the live tokens of the source, except one user's.

    A user present in both keeps the target's id and creation time and takes the source's token, times,
    scopes and state. Running it on its own output changes nothing.
    """
    moved = source.where(~F.col("revoked") & (F.col("github_user") != exclude)).select(
        "github_user", F.struct(*[c for c in TOKEN_COLUMNS if c != "github_user"]).alias("src")
    )
    merged = target.select(*TOKEN_COLUMNS).join(moved, "github_user", "full_outer")
    from_source = F.col("src").isNotNull()
    known = F.col("id").isNotNull()

    def kept(c: str) -> Column:
        return F.when(known, F.col(c)).otherwise(F.col(f"src.{c}")).alias(c)

    def taken(c: str) -> Column:
        return F.when(from_source, F.col(f"src.{c}")).otherwise(F.col(c)).alias(c)

    return merged.select(
        "github_user", kept("id"), taken("token"), kept("created_at"), taken("revoked"), taken("last_ok_at"), taken("scopes")
    )


def reconcile_tokens(source: DataFrame, target: DataFrame, exclude: str) -> DataFrame:
    """Counts on both sides, the verdict, live users missing from the target and live rows without scopes."""
    others = F.col("github_user") != exclude
    live = source.where(~F.col("revoked") & others).select("github_user", F.col("scopes").isNull().alias("no_scopes"))
    present = target.where(others).select("github_user", F.lit(True).alias("in_target"))
    both = live.withColumn("in_source", F.lit(True)).join(present, "github_user", "full_outer")
    source_live, target_total = F.count("in_source"), F.count("in_target")
    return both.agg(
        source_live.alias("source_live"),
        target_total.alias("target_total"),
        (target_total >= source_live).alias("ok"),
        F.count_if(F.col("in_target").isNull()).alias("missing_users"),
        F.count_if(F.col("no_scopes")).alias("null_scopes"),
    )


def migration_sample(target: DataFrame, exclude: str, n: int = 10) -> DataFrame:
    """The newest n users of the target (ties by id)."""
    newest = target.where(F.col("github_user") != exclude).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)
    return newest.select("github_user", F.to_date("created_at").alias("created_date"))
