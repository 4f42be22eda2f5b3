"""Gates over recorded answers: which questions pass, and whether enough of them do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of questions, in percent, that must pass.
BAR = 90


def last_results(log: DataFrame) -> DataFrame:
    """Each id's last row by ``seq`` of a log that only grows.

    The log is first reduced to the last ``seq`` of each id; only that row's texts are moved. Of rows with one seq the
    greatest counts.
    """
    last = log.groupBy("id").agg(F.max("seq").alias("seq"))
    return log.join(last, ["id", "seq"], "left_semi").groupBy("id").agg(F.max(F.struct("seq", "answer", "error", "sources")).alias("r")).select("id", "r.*")


def verdicts(entries: DataFrame, log: DataFrame) -> DataFrame:
    """(id, verdict, misses, hits, retrieval_ok, n_reasons) of every entry (id, expect, reject, source) by its last result (id, seq, answer, error, sources).

    ``expect`` are patterns that an answer must have, ``reject`` those that it must not, without regard to case;
    ``source`` must be part of the name of a cited source (null or blank: any). An error, a blank answer, a pattern
    missed or hit and a source not cited are one reason each against it. Entries without a result have the verdict
    'none'. Null lists count as empty; ids of the log that no entry has are left out.
    """
    none = F.array().cast("array<string>")
    given = entries.select("id", F.coalesce("expect", none).alias("expect"), F.coalesce("reject", none).alias("reject"), F.coalesce("source", F.lit("")).alias("source"))
    both = given.join(last_results(log.join(given.select("id"), "id", "left_semi")), "id", "left").withColumn("answer_", F.coalesce("answer", F.lit("")))
    has = lambda p: F.regexp_like("answer_", F.concat(F.lit("(?im)"), p))
    cited = F.exists(F.coalesce("sources", none), lambda s: F.contains(F.lower(s), F.lower("source")))
    judged = both.select(
        "id",
        F.col("seq").isNotNull().alias("there"),
        F.filter("expect", lambda p: ~has(p)).alias("misses"),
        F.filter("reject", has).alias("hits"),
        F.when(F.col("source") != "", F.coalesce(cited, F.lit(False))).alias("retrieval_ok"),
        (F.col("error").isNotNull().cast("int") + (F.trim("answer_") == "").cast("int")).alias("faults"),
    )
    reasons = F.size("misses") + F.size("hits") + F.coalesce((~F.col("retrieval_ok")).cast("int"), F.lit(0)) + F.col("faults")
    seen = lambda c: F.when(F.col("there"), c)
    verdict = F.when(~F.col("there"), "none").when(reasons == 0, "PASS").otherwise("FAIL")
    return judged.select("id", verdict.alias("verdict"), seen(F.col("misses")).alias("misses"), seen(F.col("hits")).alias("hits"), seen(F.col("retrieval_ok")).alias("retrieval_ok"), seen(reasons).alias("n_reasons"))


def gate(judged: DataFrame, bar: int = BAR) -> DataFrame:
    """(n, passed, failed, missing, needed, met): the gate over all entries; those without a result haven't passed, and none at all meet nothing."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    sums = judged.agg(F.count("*").alias("n"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("none").alias("missing"))
    needed = F.ceil(F.col("n") * bar / 100).cast("long")
    return sums.select("*", needed.alias("needed"), ((F.col("n") > 0) & (F.col("passed") >= needed)).alias("met"))
