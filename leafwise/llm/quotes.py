r"""Chat formatting by quotation linking (operator 8), in DataFrame functions alone.

Lines of a message are parsed into quote levels (the `>` marks in front). Lines
are normalised (letters in lower case, white space and punctuation folded) and
hashed, and so are the runs of SHINGLE words that begin in a line and go on over
the line breaks of its passage (lines of one level that follow each other), as
mail programs rewrap what they quote. A quoted line is linked to the latest
earlier message of its conversation that holds the line at level zero, or else
to the latest that holds one of its runs; that is a running maximum over
(conversation, hash), so a line that very many messages share makes no pairs.

A message answers the message that most lines of its lowest linked level lead to
(the latest on a tie): what it quotes itself is at level one, and deeper levels
are quotes in that quote, which count only where no lower level leads anywhere.
A message that quotes nothing known answers nothing: it begins a thread.

The conversation is rebuilt from the messages without quotes, in reply order: a
message is followed by its answers, each with all answers to it, by turn. Each
message's follower in that order is found over its first answer, its next
sibling, or the next sibling of the nearest message above it that has one; its
place is its distance from the end. Both are pointers that double each round.

Defined results: null texts count as empty; messages without a quote keep their
text, but for white space at the ends; a message of quotes alone has an empty
body; a quote without an original stays out of the body and links to nothing;
rows with null conv_id or turn are returned with no links; repeated rows are
told apart and give repeated rows, and messages that share a turn share a place;
on a tie the latest original is answered; texts of any length are read whole;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_from, spool, table

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Introductions such as "On Monday, X wrote:" directly before a quote belong to it.
INTRO = r"(?i)^.{0,200}\b(?:wrote|said|schrieb|escribi[oó]|a [eé]crit)[ \t]*:[ \t]*$"

#: Words of a run that is sought across line breaks, and the lines after its first that it can reach.
SHINGLE = 5
REACH = SHINGLE - 1
#: Places of a thread in one list of chats().
PART = 1_000


def quote_level(line: Column) -> Column:
    """Number of `>` marks in front of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def normal(line: Column) -> Column:
    """A line without marks, in lower case, with runs of anything but letters and digits folded to a space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """id, conv_id, turn, role, body, lines (array of struct level, line): messages taken apart; `id` tells rows apart."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    # An introduction counts as quoted if the next line is a quote.
    cut = F.transform("cut", lambda x, i: F.struct(F.when((x["level"] == 0) & x["line"].rlike(INTRO) & (F.coalesce(F.get(F.col("cut.level"), i + 1), F.lit(0)) > 0), F.lit(-1)).otherwise(x["level"]).alias("level"), x["line"].alias("line")))
    first = F.transform(lines, lambda x: F.struct(quote_level(x).alias("level"), x.alias("line")))
    rows = messages.select(F.monotonically_increasing_id().alias("id"), "conv_id", "turn", "role", first.alias("cut")).withColumn("cut", cut)
    body = F.array_join(F.transform(F.filter("cut", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    hashed = F.transform("cut", lambda x: F.struct(x["level"].alias("level"), normal(x["line"]).alias("line")))
    kept = F.filter(hashed, lambda x: (x["level"] >= 0) & (x["line"] != ""))
    return rows.select("id", "conv_id", "turn", "role", F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), kept.alias("lines"), F.array_max(F.transform("cut", lambda x: x["level"])).alias("marks"))


def line_hashes(lines: Column) -> Column:
    """Array of struct level, line, whole, hash: the hash of every line (whole), and of the runs of words that begin in it."""

    def of(x: Column, i: Column) -> Column:
        level = x["level"]
        words = F.split(x["line"], " ")
        after = F.transform(F.filter(F.slice(lines, i + 2, REACH), lambda y: y["level"] == level), lambda y: F.split(y["line"], " "))
        both = F.concat(words, F.flatten(after))
        before = F.when(i > 0, F.get(lines, i - 1)["level"])
        # A passage of fewer words than a run is a run of all its words.
        starts = F.when(F.size(both) < SHINGLE, F.when(before.eqNullSafe(level), F.lit(0)).otherwise(F.lit(1))).otherwise(F.least(F.size(words), F.size(both) - SHINGLE + 1))
        runs = F.transform(F.slice(F.sequence(F.lit(1), F.size(words)), F.lit(1), starts), lambda j: F.xxhash64(F.array_join(F.slice(both, j, F.lit(SHINGLE)), " "), F.lit("run")))
        line = F.xxhash64(x["line"])
        out = lambda h, whole: F.struct(level.alias("level"), line.alias("line"), F.lit(whole).alias("whole"), h.alias("hash"))
        return F.concat(F.array(out(line, True)), F.transform(runs, lambda h: out(h, False)))

    return F.array_distinct(F.flatten(F.transform(lines, of)))


def quote_links(messages: DataFrame) -> DataFrame:
    """id, quoted_turn, n_lines: the earlier message that most quoted lines of a message's lowest linked level lead to. `messages`: see parsed()."""
    given = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # Only conversations that quote are looked into, and there only lines and runs that are quoted.
    given = given.join(given.filter("marks > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    lines = given.select("id", "conv_id", "turn", F.explode(line_hashes(F.col("lines"))).alias("l")).select("id", "conv_id", "turn", "l.*")
    quoted = lines.filter("level > 0").select("conv_id", "hash").distinct()
    asked = lines.join(quoted, ["conv_id", "hash"], "left_semi")
    earlier = W.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    led = asked.withColumn("source", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)).filter("level > 0 AND source IS NOT NULL")
    by_line = led.groupBy("id", "level", "line").agg(F.max(F.struct("whole", "source"))["source"].alias("source"))
    counted = by_line.groupBy("id", "level", "source").agg(F.count("*").alias("n_lines"))
    return counted.groupBy("id").agg(F.max(F.struct(-F.col("level"), "n_lines", "source")).alias("best")).select("id", F.col("best.source").alias("quoted_turn"), "best.n_lines")


def threads(answers: DataFrame, *, rounds: int = 40) -> DataFrame:
    """conv_id, turn, root, depth: the first message of the thread of each message and the steps to it.

    `answers`: conv_id, turn, quoted_turn, one row per message that quotes. Steps
    double each round, so a chain of a million answers takes twenty.
    """
    at = spool(answers.select("conv_id", "turn", F.col("quoted_turn").alias("root"), F.lit(1).cast("long").alias("depth")).dropDuplicates(["conv_id", "turn"]))
    for _ in range(rounds):
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        at = spool(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError(f"threads did not settle in {rounds} rounds")


def places(answers: DataFrame, *, rounds: int = 40) -> DataFrame:
    """conv_id, turn, place: where each message of a thread stands in its reply order, from 0.

    `answers`: conv_id, turn, quoted_turn, one row per message that answers one.
    """
    links = spool(answers.select("conv_id", "turn", F.col("quoted_turn").alias("up")).dropDuplicates(["conv_id", "turn"]))
    siblings = W.partitionBy("conv_id", "up").orderBy("turn")
    below = links.withColumn("beside", F.lead("turn").over(siblings))
    tops = links.select("conv_id", F.col("up").alias("turn")).distinct().join(links, ["conv_id", "turn"], "left_anti")
    nodes = spool(below.unionByName(tops.select("conv_id", "turn", F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("beside"))))
    first = links.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    # Where to go on after all answers below: the next sibling, else that of the message above, and so on; `up` is null when that is settled.
    at = spool(nodes.select("conv_id", "turn", F.when(F.col("beside").isNull(), F.col("up")).alias("up"), F.col("beside").alias("on")))
    for _ in range(rounds):
        if at.filter("up IS NOT NULL").isEmpty():
            break
        over = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("on").alias("found"))
        met = at.join(over, ["conv_id", "up"], "left")
        at = spool(met.select("conv_id", "turn", F.col("further").alias("up"), F.coalesce("on", "found").alias("on")))
    else:
        raise RuntimeError(f"reply order did not settle in {rounds} rounds")
    follow = at.join(first, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("child", "on").alias("on"))
    left = spool(follow.withColumn("n", F.col("on").isNotNull().cast("long")))
    for _ in range(rounds):
        if left.filter("on IS NOT NULL").isEmpty():
            break
        over = left.select("conv_id", F.col("turn").alias("on"), F.col("on").alias("further"), F.col("n").alias("more"))
        left = spool(left.join(over, ["conv_id", "on"], "left").select("conv_id", "turn", F.col("further").alias("on"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    else:
        raise RuntimeError(f"reply order did not settle in {rounds} rounds")
    roots = threads(answers).select("conv_id", "turn", "root").unionByName(tops.select("conv_id", "turn", F.col("turn").alias("root")))
    whole = left.select("conv_id", F.col("turn").alias("root"), F.col("n").alias("all"))
    return left.join(roots, ["conv_id", "turn"]).join(whole, ["conv_id", "root"]).select("conv_id", "turn", (F.col("all") - F.col("n")).alias("place"))


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, quote_depth, reply_to, n_quoted, thread_root, thread_depth, place.

    Sorted by conv_id, thread_root, place, the messages of a conversation stand in
    reply order.
    """
    rows = spool(parsed(messages))
    links = spool(quote_links(rows))
    placed = rows.select("id", "conv_id", "turn").join(links, "id")
    answers = spool(placed.groupBy("conv_id", "turn").agg(F.max_by("quoted_turn", F.struct("n_lines", "quoted_turn")).alias("quoted_turn")))
    out = rows.join(links, "id", "left").join(threads(answers), ["conv_id", "turn"], "left").join(places(answers), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", F.greatest("marks", F.lit(0)).alias("quote_depth"), F.col("quoted_turn").alias("reply_to"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("thread_depth"), F.coalesce("place", F.lit(0)).alias("place"),
    )


def chats(ordered: DataFrame, *, part: int = PART) -> DataFrame:
    """conv_id, thread_root, part, turns: the threads of reply_order() as lists of (role, body) in reply order.

    A thread of more than `part` places comes in several parts, counted from 0, so
    no list grows with a thread. Messages without a body are left out; those that
    share a place stand by turn; a part without any has no row.
    """
    said = ordered.filter(F.col("body") != "").withColumn("part", F.floor(F.col("place") / part))
    turns = F.array_sort(F.collect_list(F.struct("place", "turn", "role", "body")))
    return said.groupBy("conv_id", "thread_root", "part").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["body"].alias("body"))).alias("turns"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it answers and its place in the threads."""
    return kept_from(spark, lambda: reply_order(table(spark, sf_dir, "conversations")))
