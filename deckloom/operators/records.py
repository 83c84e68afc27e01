"""Operators over records of a service: users, jobs, versions, shares and its log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A job's record lives so many days; a finished job so many hours in the live store, which has room for so many.
KEEP_DAYS, LIVE_HOURS, LIVE_JOBS = 30, 6, 200
COOLDOWN_S, MOST_AN_HOUR = 30, 5


def with_profiles(users: DataFrame, profiles: DataFrame, user_key: str, profile_key: str) -> DataFrame:
    """Users with their profile: inner equi-join."""
    return users.join(profiles, users[user_key] == profiles[profile_key])


def with_decks(entries: DataFrame, decks: DataFrame, key: str) -> DataFrame:
    """Catalogue entries with their ready deck, if there is one, and whether there is."""
    return entries.join(decks, key, "left")


def live_and_saved(live: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Live rows, and saved ones whose key isn't live."""
    return live.unionByName(saved.join(live.select(key), key, "left_anti"))


def newest(rows: DataFrame, by: list[str], order: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each group, numbered by ``rank``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), tie))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def upsert(saved: DataFrame, new: DataFrame, key: str, kept: list[str], keep_if_blank: list[str]) -> DataFrame:
    """``saved`` with the rows of ``new`` put in: ``kept`` columns of an existing row stay, ``keep_if_blank`` ones unless the new value
    is not blank, the others are replaced."""
    old, fresh = saved.alias("o"), new.alias("n")
    columns = []
    for c in saved.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            columns.append(F.coalesce(n, o).alias(c))
        elif c in kept:
            columns.append(F.when(F.col(f"o.{key}").isNotNull(), o).otherwise(n).alias(c))
        elif c in keep_if_blank:
            columns.append(F.when(F.col(f"n.{key}").isNull() | (F.col(f"o.{key}").isNotNull() & (n == "")), o).otherwise(n).alias(c))
        else:
            columns.append(F.when(F.col(f"n.{key}").isNotNull(), n).otherwise(o).alias(c))
    return old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def recovered(jobs: DataFrame, message: str) -> DataFrame:
    """Running jobs become failed ones with ``message``."""
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, message).otherwise(F.col("error"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))


def live_store(jobs: DataFrame, now: str) -> DataFrame:
    """Finished jobs older than ``LIVE_HOURS`` go; of the rest running ones stay and the newest ``LIVE_JOBS``."""
    finished = F.col("status").isin("done", "failed", "awaiting_review")
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {LIVE_HOURS} HOURS")
    fresh = jobs.where(~(finished & old))
    newest_ids = fresh.orderBy(F.desc("created_at"), "id").limit(LIVE_JOBS).select(F.col("id").alias("_id"), F.lit(True).alias("_new"))
    return fresh.join(newest_ids, F.col("id") == F.col("_id"), "left").where((F.col("status") == "running") | F.col("_new")).drop("_id", "_new")


def latest_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key, and how many versions there are."""
    rest = [c for c in versions.columns if c not in (key, version)]
    last = F.max(F.struct(version, *rest)).alias("row")  # of equal versions the largest row
    return versions.groupBy(key).agg(last, F.count(F.lit(1)).alias("n_versions")).select(key, "row.*", "n_versions")


def restored(versions: DataFrame, key: str, version: str, wanted: int) -> DataFrame:
    """All versions, and a new highest one for each key that has version ``wanted``: a copy of that."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    again = versions.where(F.col(version) == wanted).join(top, key).withColumn(version, F.col("_top") + 1).select(*versions.columns)
    return versions.unionByName(again)


def numbered(decks: DataFrame) -> DataFrame:
    """Display numbers of each user's decks by age, and a permanent id by first appearance."""
    by_age = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "deck_id"))
    return decks.withColumn("display_number", by_age.cast("long")).withColumn("pres_id", F.concat(F.lit("PRES-"), F.lpad(F.col("display_number").cast("string"), 4, "0")))


def event_rows(events: DataFrame) -> DataFrame:
    """Events as they are logged: names cleaned to ``[A-Za-z0-9_.:-]`` and 60 characters, properties cut to 2,000."""
    name = F.substring(F.regexp_replace("event_type", r"[^A-Za-z0-9_.:\-]", ""), 1, 60)
    return events.select("event_id", "user_id", name.alias("name"), F.substring("props", 1, 2000).alias("props"))


def code_requests(events: DataFrame) -> DataFrame:
    """Of each event: seconds since the user's last one, events of the hour before, and whether it would be refused for either."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    mine = Window.partitionBy("user_id").orderBy("ts")
    hour = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000 + 1, -1)
    wait = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(mine))) / 1e6
    rows = events.select("event_id", "user_id", F.bround(wait, 3).alias("since_last"), F.count(F.lit(1)).over(hour).alias("in_hour"))
    return rows.withColumn("refused", F.coalesce(F.col("since_last") < COOLDOWN_S, F.lit(False)) | (F.col("in_hour") >= MOST_AN_HOUR))


def dashboard(decks: DataFrame) -> DataFrame:
    """Per user: decks, slides, mean of scores that exist, best and weakest deck, and last score less the first."""
    first, last = F.min_by("score", F.struct("created_at", "deck_id")), F.max_by("score", F.struct("created_at", "deck_id"))
    return decks.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_decks"),
        F.sum("n_slides").alias("n_slides"),
        (F.bround(F.sum(F.round(F.col("score") * 100).cast("long")).cast("double") / F.count("score"), 0) / 100.0).alias("mean_score"),
        F.max_by("deck_id", F.struct("score", "deck_id")).alias("best_deck"),
        F.min_by("deck_id", F.struct("score", "deck_id")).alias("weakest_deck"),
        F.bround(last - first, 2).alias("trend"),
    )
