"""Measurements of runs: two kinds of percentile, median, throughput, plans of requests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.sources.shared import kept


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that a share `p` of the values does not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def floor_index(rows: DataFrame, *, group: str, value: str, p: float, name: str) -> DataFrame:
    """group, `name`: the value at index floor((n - 1) * p) of the sorted values.

    Equal values are counted first, so what is put in order is one row for each.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    before = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumns({"_upto": F.sum("_c").over(before), "_n": F.sum("_c").over(W.partitionBy(group))})
    at = F.floor((F.col("_n") - 1) * F.lit(p))
    return placed.filter(F.col("_upto") > at).groupBy(group).agg(F.min(value).alias(name))


#: Buckets of a range histogram; values of a group that are sorted as they are; targets that are broadcast.
BUCKETS, FEW, BROADCAST = 1024, 10_000, 100_000
_EDGE = 1.7e308


def _linear(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-_EDGE)), F.lit(_EDGE)) / 4


def _by_magnitude(v: Column) -> Column:
    size = F.least(F.abs(v), F.lit(_EDGE))
    return F.signum(v) * F.when(size < 1, F.log1p(size * 1e308)).otherwise(F.log(F.greatest(size, F.lit(1.0))) + math.log1p(1e308))


def ranks(rows: DataFrame, *, group: str, value: str, shares: dict[str, float], path: str, rule: str = "nearest", few: int = FEW) -> DataFrame:
    """group and a column for each of `shares`: the exact value at that rank, for groups of any size and any number of distinct values.

    `rule`: `nearest` (rank ceil(n * p)) or `floor` (index floor((n - 1) * p)).
    Each round counts the values that are still in question in BUCKETS ranges of
    equal width and goes on with the range that holds the rank, by turns of the
    values and of their magnitudes, so a few rounds do for any spread. Once a range
    holds one value, or `few` rows, its value is picked. Nothing is sorted before
    that, and no task holds more than counts. Nulls are left out, NaN is greater
    than all; a group without values has no row. `path` is a folder for the rounds.
    """
    own = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()]))
    rank = F.greatest(F.ceil(F.col("n") * F.col("p")), F.lit(1)) if rule == "nearest" else F.floor((F.col("n") - 1) * F.col("p")) + 1
    todo = own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("*", wanted.alias("w"))
    todo = todo.select("g", "w.name", "w.p", "n", "lo", "hi").select("g", "name", rank.cast("long").alias("k"), F.lit(0).cast("long").alias("below"), "n", "lo", "hi")
    todo = kept(todo, f"{path}/round=0")
    done: list[DataFrame] = []
    turn = 0
    while True:
        single = F.col("lo").eqNullSafe(F.col("hi"))
        done.append(todo.filter(single).select("g", "name", F.col("lo").alias("found")))
        left = todo.filter(~single)
        count = left.count()
        if not count:
            break
        side = F.broadcast(left) if count <= BROADCAST else left
        met = own.join(side.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_g")
        small = met.filter(F.col("n") <= few)
        at = F.row_number().over(W.partitionBy("g", "name").orderBy("v"))
        done.append(kept(small.withColumn("at", at).filter(F.col("at") == F.col("k") - F.col("below")).select("g", "name", F.col("v").alias("found")), f"{path}/small={turn}"))
        scale = _by_magnitude if turn % 2 else _linear
        top = F.when(F.isnan("hi"), F.lit(_EDGE)).otherwise(F.col("hi"))
        width = scale(top) - scale(F.col("lo"))
        place = F.when(width > 0, F.floor((scale(F.col("v")) - scale(F.col("lo"))) / width * BUCKETS)).otherwise(0)
        # The ends have buckets of their own, so each round leaves less in question.
        bucket = F.when(F.col("v").eqNullSafe(F.col("lo")), -1).when(F.col("v").eqNullSafe(F.col("hi")), BUCKETS + 1).when(F.isnan("v"), BUCKETS + 1).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS)))
        held = met.filter(F.col("n") > few).groupBy("g", "name", "k", "below", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(W.partitionBy("g", "name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        upto = held.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        turn += 1
        todo = kept(upto.filter((F.col("below") < F.col("k")) & (F.col("below") + F.col("n") >= F.col("k"))).select("g", "name", "k", "below", "n", "lo", "hi"), f"{path}/round={turn}")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == n, F.col("found"))).alias(n) for n in shares])


def throughput(rows: DataFrame, *, group: str, amount: str, start: str, stop: str) -> DataFrame:
    """group, total, seconds, per_second."""
    out = rows.groupBy(group).agg(F.sum(amount).alias("total"), (F.max(F.unix_timestamp(stop)) - F.min(F.unix_timestamp(start))).alias("seconds"))
    return out.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")))


def request_plan(cases: DataFrame, endpoints: DataFrame, *, repetitions: int, seed: int) -> DataFrame:
    """Every case, endpoint and repetition once, with rank: the seeded order in which they are sent.

    `endpoints` is a configured list; the planner sends it to the tasks only below
    its own size limit.
    """
    numbers = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))
    plan = cases.crossJoin(endpoints).withColumn("repetition", numbers)
    told = F.concat_ws("\0", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plan.columns])
    # The first 60 bits of a digest that any engine can compute again.
    return plan.withColumn("rank", F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long"))


def case_pages(sources: DataFrame, *, pages: int, cycles: int) -> DataFrame:
    """position, source_index, source_page: the pages of the sources (source_index, n_pages), over and over, up to `pages`.

    Positions follow from running sums over the sources; only sources whose pages
    begin below `pages` are taken apart.
    """
    before = W.orderBy("source_index").rowsBetween(W.unboundedPreceding, -1)
    # No more than `pages` sources have a page to give.
    first = sources.select("source_index", "n_pages").filter("n_pages > 0").orderBy("source_index").limit(pages)
    total = sources.agg(F.sum("n_pages").alias("_total"))
    placed = first.withColumn("_at", F.coalesce(F.sum("n_pages").over(before), F.lit(0))).crossJoin(total)
    begun = placed.withColumn("_cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("_at", F.col("_cycle") * F.col("_total") + F.col("_at")).filter(F.col("_at") < pages)
    every = begun.select("_at", "source_index", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("source_page"))
    return every.select((F.col("_at") + F.col("source_page")).cast("int").alias("position"), "source_index", "source_page").filter(F.col("position") < pages)


def letters(text: Column) -> Column:
    """Code points that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", ""))


def has_text_layer(pages: DataFrame, *, text: str = "text", least: int = 32) -> DataFrame:
    """doc_id, n_letters, has_text: whether a document's pages hold `least` letters or more."""
    out = pages.groupBy("doc_id").agg(F.sum(letters(F.col(text))).alias("n_letters"))
    return out.withColumn("has_text", F.col("n_letters") >= least)


def pattern_faults(text: Column, *, required: list[str], forbidden: list[str]) -> Column:
    """struct(missing, forbidden, ok): required patterns that a text lacks and forbidden ones that it holds, in any letter case. A NULL text is empty."""
    text = F.coalesce(text, F.lit(""))
    chosen = lambda patterns, held: F.filter(F.array(*[F.when(text.rlike(f"(?i){p}") == held, F.lit(p)) for p in patterns]).cast("array<string>"), lambda x: x.isNotNull())
    missing, found = chosen(required, False), chosen(forbidden, True)
    return F.struct(missing.alias("missing"), found.alias("forbidden"), ((F.size(missing) == 0) & (F.size(found) == 0)).alias("ok"))


def endpoint_report(results: DataFrame, *, endpoint: str = "endpoint", ok: str = "ok", tokens: str = "completion_tokens") -> DataFrame:
    """endpoint, requests, passed, completion_tokens; unknown tokens count as none."""
    return results.groupBy(endpoint).agg(F.count("*").alias("requests"), F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("passed"), F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("completion_tokens"))


def file_summary(files: DataFrame, *, kind: str, size: Column) -> DataFrame:
    """kind, n_files, n_bytes: what a dry run would submit."""
    return files.groupBy(kind).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
