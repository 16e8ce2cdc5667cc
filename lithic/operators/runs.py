"""Records of analysis runs: failures with retries, where to resume, and how runs end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tries of a category, and seconds after which a repository's records expire.
RETRIES, TTL = 3, 86_400
#: Step at which an unfinished run of a status resumes; any other status begins anew.
RESUME = (("SCANNING", "scan"), ("PARSING", "ast"), ("ANALYZING_STRUCTURES", "frameworks"), ("ANALYZING_MODULES", "ai"), ("STORING", "store"))


def _alive(records: DataFrame, repo: str, at: str, ttl: float) -> DataFrame:
    """Records of each repository's last stretch without a gap over `ttl` seconds; __until is when that expires."""
    w = Window.partitionBy(repo).orderBy(at)
    marked = records.withColumn("__first", F.when(F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) > ttl), F.col(at)))
    whole = Window.partitionBy(repo)
    marked = marked.withColumns({"__start": F.max("__first").over(whole), "__until": F.max(at).over(whole) + ttl})
    return marked.where(F.col(at) >= F.col("__start")).drop("__first", "__start")


def failed_nodes(records: DataFrame, cleared: DataFrame, repo: str, category: str, at: str, tie: str, now: Column, ttl: float = TTL) -> DataFrame:
    """The last failure of each repository and category that is neither cleared later nor expired at `now` (seconds).

    A repository's failures expire together, `ttl` after its last one; cleared: (repo, category, at, tie).
    """
    alive = _alive(records, repo, at, ttl).where(now <= F.col("__until")).drop("__until")
    last = Window.partitionBy(repo, category).orderBy(F.desc(at), F.desc(tie))
    newest = alive.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    gone = cleared.groupBy(repo, category).agg(F.max(F.struct(at, tie)).alias("__gone"))
    later = F.col("__gone") > F.struct(at, tie)
    return newest.join(gone, [repo, category], "left").where(~F.coalesce(later, F.lit(False))).drop("__gone")


def retries(tries: DataFrame, repo: str, category: str, at: str, now: Column, ttl: float = TTL) -> DataFrame:
    """(repo, category, tries, can_retry): tries that have not expired at `now`; a repository's expire together."""
    alive = _alive(tries, repo, at, ttl).where(now <= F.col("__until"))
    return alive.groupBy(repo, category).agg(F.count("*").alias("tries")).withColumn("can_retry", F.col("tries") < RETRIES)


def resume_step(status: Column) -> Column:
    """Step at which an unfinished run goes on; null: from the beginning."""
    return F.coalesce(*(F.when(status == name, F.lit(step)) for name, step in RESUME))


def ended(runs: DataFrame, how: Column) -> DataFrame:
    """Runs (version_id, version_status, repo_status) after FAILED or CANCELLED in `how`; null leaves them as they are.

    A failure without a version still marks the repository; a cancelled run without one changes nothing.
    """
    version = F.col("version_id").isNotNull()
    return runs.withColumns({
        "version_status": F.when(how.isNotNull() & version, how).otherwise(F.col("version_status")),
        "repo_status": F.when((how == "FAILED") | (how.isNotNull() & version), how).otherwise(F.col("repo_status")),
    })
