"""Decisions on proposals, applied once, and report windows that follow each other without gaps."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.snapshots import Versioned

PROPOSALS = "proposal_id int, kind string, member_id string, title string, approved int, decided_at timestamp_ntz, applied_at timestamp_ntz, apply_result string"
WATCHLIST = "member_id string, added_at timestamp_ntz, reason string, active int, changed_at timestamp_ntz"
MARKERS = "source string, last_end timestamp_ntz"


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(proposal_id, state) of decisions (proposal_id, approved, decided_at): a decision can change until it has been applied."""
    state = F.when(F.col("_known").isNull(), "not found").when(F.col("applied_at").isNotNull(), "already applied").otherwise("decided")
    return decisions.join(proposals.select("proposal_id", "applied_at", F.lit(True).alias("_known")), "proposal_id", "left").select("proposal_id", state.alias("state"))


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """``proposals`` after the decisions."""
    d = decisions.select("proposal_id", F.col("approved").alias("_a"), F.col("decided_at").alias("_d"))
    free = F.col("applied_at").isNull() & F.col("_d").isNotNull()
    out = proposals.join(d, "proposal_id", "left")
    return out.withColumns({"approved": F.when(free, F.col("_a")).otherwise(F.col("approved")), "decided_at": F.when(free, F.col("_d")).otherwise(F.col("decided_at"))}).select(*proposals.columns)


def apply_approved(proposals: DataFrame, watchlist: DataFrame, now) -> DataFrame:
    """``proposals`` after the approved ones that haven't been applied are, in order of their numbers.

    Whether a removal finds its member watched depends only on the member's last change before, so an ordered window per member does without a loop.
    """
    due = (F.col("approved") == 1) & F.col("applied_at").isNull()
    pending = proposals.where(due).join(watchlist.select("member_id", F.col("active").alias("_active")), "member_id", "left")
    change = F.when(F.col("kind").isin("add", "remove"), F.col("kind"))
    last = F.last(change, ignorenulls=True).over(Window.partitionBy("member_id").orderBy("proposal_id").rowsBetween(Window.unboundedPreceding, -1))
    watched = F.coalesce(last == "add", F.col("_active") == 1, F.lit(False))
    result = (
        F.when(F.col("kind") == "note", "acknowledged").when((F.col("kind") == "add") | (F.col("kind") == "remove") & watched, "applied")
        .when(F.col("kind") == "remove", "failed: not on the watchlist any more").otherwise(F.concat(F.lit("failed: unknown kind "), F.col("kind")))
    )
    out = proposals.join(pending.select("proposal_id", result.alias("_result")), "proposal_id", "left")
    at = F.when(F.col("_result").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("applied_at"))
    return out.withColumns({"applied_at": at, "apply_result": F.coalesce("_result", "apply_result")}).select(*proposals.columns)


def reflected(watchlist: DataFrame, proposals: DataFrame) -> DataFrame:
    """``watchlist`` with what applied proposals have changed since each member's last change. Doing it again changes nothing."""
    done = proposals.where("apply_result = 'applied'").join(watchlist.select("member_id", F.col("changed_at").alias("_since")), "member_id", "left")
    new = done.where("_since is null or applied_at > _since")
    add = F.when(F.col("kind") == "add", F.col("proposal_id"))
    by = new.groupBy("member_id").agg(F.max_by("kind", "proposal_id").alias("_kind"), F.max("applied_at").alias("_at"), F.max_by("title", add).alias("_title"), F.max_by("applied_at", add).alias("_added"))
    out = watchlist.join(by, "member_id", "full_outer")
    active = F.when(F.col("_kind") == "add", 1).when(F.col("_kind") == "remove", 0).otherwise(F.col("active"))
    return out.select("member_id", F.coalesce("_added", "added_at").alias("added_at"), F.coalesce("_title", "reason").alias("reason"), active.alias("active"), F.coalesce("_at", "changed_at").alias("changed_at"))


class Desk:
    """Proposals and the watchlist as versioned tables.

    Of two that decide or apply at once the later starts over from the earlier one's result. Proposals are committed with their results first; the watchlist then follows them, at the next run if this one dies between.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.proposals = Versioned(spark, f"{path}/proposals", PROPOSALS, ["proposal_id"])
        self.watchlist = Versioned(spark, f"{path}/watchlist", WATCHLIST, ["member_id"])

    def decide(self, decisions: DataFrame) -> DataFrame:
        """What became of each decision, as of the version that it met."""
        seen: list[DataFrame] = []

        def change(p: DataFrame) -> DataFrame:
            seen.append(decided(p, decisions))
            return decide(p, decisions)

        self.proposals.update(change)
        return seen[-1]

    def apply(self, now) -> None:
        self.proposals.update(lambda p: apply_approved(p, reflected(self.watchlist.read(), p), now))
        self.watchlist.update(lambda w: reflected(w, self.proposals.read()))


def report_window(markers: Versioned, source: str, now: datetime, first: timedelta = timedelta(hours=24)) -> tuple[datetime, datetime]:
    """[since, until): from the end of the last report that was finished, or from ``first`` before now."""
    last = markers.read().where(F.col("source") == source).select("last_end").first()
    return (last[0] if last else now - first), now


def report(markers: Versioned, source: str, rows: DataFrame, moment: str, now: datetime, write: Callable[[DataFrame, str], None]) -> tuple[datetime, datetime]:
    """Writes the rows whose ``moment`` lies in the next window, then moves the mark.

    ``write`` gets a name that is the same when the window is tried again, so that what a failed run left is replaced. The mark moves only after that, and only from where it was.
    """
    version = markers.version()
    since, until = report_window(markers, source, now)
    if until <= since:
        return since, since
    at = F.col(moment).cast("timestamp_ntz")
    write(rows.where((at >= F.lit(since).cast("timestamp_ntz")) & (at < F.lit(until).cast("timestamp_ntz"))), f"{source}-{since:%Y%m%dT%H%M%S%f}")
    own = markers.spark.createDataFrame([(source, until)], MARKERS)
    markers.commit(markers.read(version).where(F.col("source") != source).unionByName(own), version)
    return since, until
