"""Rate windows by list ranking: fixed windows that a key's first request opens, each next one by the first request after it.

Every moment of a key is linked to the first one at or after its window's end, whether or not a window begins
there. Windows begin at a key's first moment and after every pause as long as a window, whatever came before,
and from there at whatever the links reach: links are doubled in rounds until none is left, then the rounds
are walked back, each from all moments marked so far. That takes the logarithm of the longest chain of windows without
a pause, in joins on key and moment, so a key that never pauses is dealt over all tasks. Neighbours in
time are found inside blocks of time; between blocks there is one row for each key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed

#: Windows per block of time.
BLOCK = 16


def _block(t: Column, span: int) -> Column:
    return F.floor(t / F.lit(span * BLOCK)).cast("long")


def _moments(requests: DataFrame, span: int) -> DataFrame:
    """key, t, block and before, the moment before it."""
    at = requests.select("key", F.unix_micros("ts").alias("t")).distinct().withColumn("block", _block(F.col("t"), span))
    ends = at.groupBy("key", "block").agg(F.max("t").alias("end"))
    earlier = ends.select("key", "block", F.lag("end").over(Window.partitionBy("key").orderBy("block")).alias("earlier"))
    own = at.withColumn("own", F.lag("t").over(Window.partitionBy("key", "block").orderBy("t")))
    return own.join(earlier, ["key", "block"]).select("key", "t", "block", F.coalesce("own", "earlier").alias("before"))


def _links(moments: DataFrame, span: int) -> DataFrame:
    """key, t and to, the first moment ``span`` or more later; none leads to a moment after a pause, which is known to begin a window."""
    ends = moments.select("key", (F.col("t") + span).alias("t"), F.col("t").alias("of")).withColumn("block", _block(F.col("t"), span))
    both = moments.select("key", "block", "t", F.lit(None).cast("long").alias("of"), F.col("t").alias("at")).unionByName(ends.withColumn("at", F.lit(None).cast("long")))
    # from the latest moment back, requests before ends: the last request passed is the first at or after an end
    back = Window.partitionBy("key", "block").orderBy(F.desc("t"), F.col("of").isNotNull())
    inside = both.withColumn("to", F.last("at", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("of is not null")
    firsts = both.groupBy("key", "block").agg(F.min("at").alias("first"))
    later = firsts.select("key", "block", F.last("first", ignorenulls=True).over(Window.partitionBy("key").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    linked = inside.join(later, ["key", "block"]).select("key", F.col("of").alias("t"), F.coalesce("to", "later").alias("to")).where("to is not null")
    paused = moments.where(F.col("t") - F.col("before") >= span).select("key", F.col("t").alias("to"))
    return linked.join(paused, ["key", "to"], "left_anti").select("key", "t", "to")


def window_starts(requests: DataFrame, seconds: int) -> DataFrame:
    """key and t (microseconds) of each moment at which a window begins."""
    span = seconds * 1_000_000
    moments = checkpointed(_moments(requests, span))
    rounds = [checkpointed(_links(moments, span))]
    while rounds[-1].limit(1).count():
        last = rounds[-1]
        onward = last.select("key", F.col("t").alias("to"), F.col("to").alias("next"))
        rounds.append(checkpointed(last.join(onward, ["key", "to"]).select("key", "t", F.col("next").alias("to"))))
    marked = moments.where(F.col("before").isNull() | (F.col("t") - F.col("before") >= span)).select("key", "t")
    for links in reversed(rounds[:-1]):
        marked = checkpointed(marked.unionByName(marked.join(links, ["key", "t"]).select("key", F.col("to").alias("t"))))
    return marked


def rate_windows(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, event_id, ts, window_start, n, allowed and remaining of each request: the how manieth of its window it is.

    A request's window began less than its length ago, so in the request's block of time or the one before.
    Requests of one window are counted in order of time and id.
    """
    span = seconds * 1_000_000
    starts = window_starts(requests, seconds).withColumn("block", _block(F.col("t"), span))
    rows = requests.select("key", "event_id", "ts", F.unix_micros("ts").alias("t")).withColumn("block", _block(F.col("t"), span))
    both = rows.withColumn("start", F.lit(None).cast("long")).unionByName(starts.withColumn("start", F.col("t")), allowMissingColumns=True)
    upto = Window.partitionBy("key", "block").orderBy("t", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("own", F.last("start", ignorenulls=True).over(upto)).where("start is null")
    before = starts.groupBy("key", (F.col("block") + 1).alias("block")).agg(F.max("t").alias("before"))
    met = own.join(before, ["key", "block"], "left").select("key", "event_id", "ts", F.coalesce("own", "before").alias("start"))
    n = F.row_number().over(Window.partitionBy("key", "start").orderBy("ts", "event_id")).cast("long")
    out = met.select("key", "event_id", "ts", F.timestamp_micros("start").alias("window_start"), n.alias("n"))
    return out.withColumn("allowed", F.col("n") <= limit).withColumn("remaining", F.greatest(F.lit(limit) - F.col("n"), F.lit(0)))
