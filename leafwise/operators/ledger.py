"""The job ledger as tables: create once per key, fence generations, derive states, collect what is old, resume batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.identity import canonical_json, digest

TERMINAL = ("SUCCESS", "FAILURE", "EXPIRED")


def valid_key(c: Column | str) -> Column:
    """Idempotency keys: 1 to 200 visible ASCII characters."""
    return F.col(c).rlike(r"^[\x21-\x7E]{1,200}$") if isinstance(c, str) else c.rlike(r"^[\x21-\x7E]{1,200}$")


def valid_job_id(c: Column) -> Column:
    """Canonical UUIDs."""
    return c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def create_once(requests: DataFrame, *, key: str = "key", order: str = "ts", fingerprint: str = "fingerprint") -> DataFrame:
    """`requests` with outcome: created (the first of its key), same (equal fingerprint) or conflict."""
    first = F.min_by(F.col(fingerprint), F.col(order)).over(W.partitionBy(key))
    number = F.row_number().over(W.partitionBy(key).orderBy(order))
    return requests.withColumns({"_n": number, "_f": first}).withColumn("outcome", F.when(F.col("_n") == 1, "created").when(F.col("_f") == F.col(fingerprint), "same").otherwise("conflict")).drop("_n", "_f")


def fence(messages: DataFrame, *, job: str = "job_id", order: str = "ts", generation: str = "generation") -> DataFrame:
    """Messages that are not late: none of an older generation than the newest seen before them."""
    newest = F.max(generation).over(W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return messages.withColumn("_g", newest).filter(F.col(generation) >= F.col("_g")).drop("_g")


def latest_state(messages: DataFrame, *, job: str = "job_id", order: list[str], state: str = "state") -> DataFrame:
    """job, state and number of messages: the state of a job's last message."""
    return messages.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n_messages"))


def listing(jobs: DataFrame) -> DataFrame:
    """Jobs as a listing shows them: by job_id, without what went wrong."""
    return jobs.drop("error").orderBy("job_id")


def catalog(models: DataFrame, *, group: str, name: str) -> DataFrame:
    """group, models: the distinct model names of each group, sorted. Names are made distinct before they are gathered."""
    held = models.select(group, name).filter(F.col(name).isNotNull()).distinct()
    return held.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("models"))


def collectable(jobs: DataFrame, *, now: Column, retention_s: int) -> DataFrame:
    """Jobs in a final state whose completion (or last change) is `retention_s` or more ago."""
    since = F.coalesce("completed_at", "updated_at")
    return jobs.filter(F.col("state").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp(since) >= retention_s))


def expire(jobs: DataFrame, old: DataFrame) -> DataFrame:
    """`jobs` where the collected ones stay as tombstones."""
    gone = old.select("job_id").distinct().withColumn("_old", F.lit(True))
    return jobs.join(gone, "job_id", "left").withColumn("state", F.when(F.col("_old"), "EXPIRED").otherwise(F.col("state"))).drop("_old")


def to_submit(inputs: DataFrame, journal: DataFrame) -> DataFrame:
    """Inputs (key, sha256) that the journal doesn't hold as done with the same content."""
    done = journal.filter("state = 'SUCCESS'").select("key", "sha256")
    return inputs.join(done, ["key", "sha256"], "left_anti")


def journal_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("state").agg(F.count("*").alias("n"))


def queue_depth(messages: DataFrame, *, queue: str, priority: str, priorities: list) -> DataFrame:
    """queue, a column for each priority, total."""
    wide = messages.groupBy(queue).pivot(priority, priorities).agg(F.count(F.lit(1))).na.fill(0)
    total = F.lit(0).cast("long")
    for p in priorities:
        total = total + F.col(f"`{p}`")
    return wide.withColumn("total", total)


def unacked_queue(raw: Column) -> Column:
    """Queue name in an unacknowledged entry (third element of a JSON list), else NULL."""
    return F.get_json_object(raw, "$[2]")


#: Which states may follow which.
MOVES = {"PENDING": ("STARTED", "SUCCESS", "FAILURE"), "STARTED": ("SUCCESS", "FAILURE"), "FAILURE": ("PENDING", "EXPIRED"), "SUCCESS": ("EXPIRED",), "EXPIRED": ()}


def legal_move(before: Column, after: Column) -> Column:
    """Whether a job in state `before` (NULL: no job yet) may go to `after`; to stay is no move and always legal."""
    legal = F.create_map(*[x for state, nexts in MOVES.items() for x in (F.lit(state), F.array(*map(F.lit, nexts)).cast("array<string>"))])
    return F.when(before.isNull(), after == "PENDING").otherwise((before == after) | F.coalesce(F.array_contains(F.try_element_at(legal, before), after), F.lit(False)))


def apply_moves(messages: DataFrame, *, job: str = "job_id", order: list[str], state: str = "state") -> DataFrame:
    """job, state, n_applied, n_rejected: each job's state after its messages in order, where illegal moves are passed over."""
    seen = messages.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, state))).alias("ms"))
    step = lambda acc, m: F.when(legal_move(acc["state"], m[state]), F.struct(m[state].alias("state"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    done = F.aggregate("ms", F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("n")), step)
    return seen.withColumn("r", done).select(job, F.col("r.state").alias("state"), F.col("r.n").alias("n_applied"), (F.size("ms") - F.col("r.n")).alias("n_rejected"))


def unpublished(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Outbox rows (job_id, generation) without a receipt for the same generation, if theirs is the job's newest: what a recovery sends again."""
    newest = outbox.groupBy("job_id").agg(F.max("generation").alias("_g"))
    left = outbox.join(receipts.select("job_id", "generation").distinct(), ["job_id", "generation"], "left_anti")
    return left.join(newest, "job_id").filter(F.col("generation") == F.col("_g")).drop("_g")


def handoff(outbox: DataFrame, claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """job_id, generation, handoff of each outbox row: `published` with a receipt, `uncertain` once claimed for sending, else `pending`."""
    keys = ["job_id", "generation"]
    told = claims.select(*keys, F.lit(1).alias("_step")).unionByName(receipts.select(*keys, F.lit(2).alias("_step"))).groupBy(*keys).agg(F.max("_step").alias("_step"))
    state = F.when(F.col("_step") == 2, "published").when(F.col("_step") == 1, "uncertain").otherwise("pending")
    return outbox.select(*keys).distinct().join(told, keys, "left").select(*keys, state.alias("handoff"))


def checked_parts(manifest: DataFrame, parts: DataFrame, *, version: int = 1) -> DataFrame:
    """job_id, fault: NULL for a checkpoint that can be used again, else the first thing wrong with it.

    `manifest`: job_id, version, path, sha256 (a row for each part); `parts`:
    job_id, path, content. Paths must lie inside the job's folder.
    """
    met = manifest.join(parts.select("job_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("_found")), ["job_id", "path"], "left")
    outside = F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda p: p == "..")
    fault = F.when(F.col("version") != version, "version").when(outside, "path").when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "content")
    return met.withColumn("_fault", fault).groupBy("job_id").agg(F.min_by("_fault", F.struct(F.col("_fault").isNull(), "path")).alias("fault"))


def profile_sha(settings: Column) -> Column:
    """The hash of a job's settings (a map from names to JSON values) in canonical form."""
    return digest(canonical_json(settings))


def profile_fits(stored: Column, settings: Column, *, images: Column) -> Column:
    """Whether results made under the profile `stored` can be used under `settings`; with images, version 1 is as good as version 2."""
    older = F.map_concat(F.map_filter(settings, lambda k, v: k != "version"), F.create_map(F.lit("version"), F.lit("1")))
    return (stored == profile_sha(settings)) | (images & (stored == profile_sha(older)))


def progress(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """first key, images_total, images_completed, stage: `vision` while a result is missing, then `merge`."""
    done = results.select(*keys).distinct().withColumn("_done", F.lit(1))
    out = requests.join(done, keys, "left").groupBy(keys[0]).agg(F.count("*").alias("images_total"), F.count("_done").alias("images_completed"))
    return out.withColumn("stage", F.when(F.col("images_completed") < F.col("images_total"), "vision").otherwise("merge"))


def route(priority: Column, stage: Column, queues: dict[str, str]) -> Column:
    """The queue of a stage for a priority: `queues` names those of normal work by stage, urgent work has one with `_urgent` behind."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in queues.items() for x in pair]), stage)
    return F.when(priority == "urgent", F.concat(named, F.lit("_urgent"))).otherwise(named)


def queue_union(*lists: Column) -> Column:
    """Queues of several lists, each once, where it first stands."""
    return F.array_distinct(F.concat(*lists))


def failure_kinds(chain: Column, most: int = 8) -> Column:
    """The distinct kinds of the first `most` errors of a chain of causes, the outermost first (a bounded report)."""
    return F.array_distinct(F.slice(F.filter(chain, lambda k: k.isNotNull()), 1, most))


def round_robin(rows: DataFrame, *, within: str, order: str, n: int) -> DataFrame:
    """`rows` with slot 0..n-1, dealt in order within each group."""
    return rows.withColumn("slot", F.pmod(F.row_number().over(W.partitionBy(within).orderBy(order)) - 1, F.lit(n)))


def least_pending(loads: DataFrame, *, group: str, worker: str, pending: str) -> DataFrame:
    """group, worker: the worker with the fewest pending tasks; the smallest name on a tie."""
    return loads.groupBy(group).agg(F.min(F.struct(pending, worker)).alias("m")).select(group, F.col(f"m.{worker}").alias(worker), F.col(f"m.{pending}").alias(pending))


def verified(results: DataFrame, markers: DataFrame) -> DataFrame:
    """Results (job_id, body) whose completion marker (job_id, sha256) fits their content."""
    return results.join(markers, "job_id").filter(F.sha2("body", 256) == F.col("sha256")).drop("sha256")
