"""Reports over conversation logs (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import has_keyword
from marquee.functions.values import ratio


def exchanges(log: DataFrame, time: str | None = None) -> DataFrame:
    """One row per user turn with the assistant's answer in the next turn; with ``time``, also ``asked_at`` and ``answered_at``.

    Both turns get the user's turn number and are grouped by it: a long conversation is spread over
    its turns instead of being sorted in one task.
    """
    own = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    keyed = log.withColumn("_at", own).filter("_at IS NOT NULL")
    times = [] if time is None else [
        F.max(F.when(F.col("role") == "user", F.col(time))).alias("asked_at"),
        F.max(F.when(F.col("role") == "assistant", F.col(time))).alias("answered_at"),
    ]
    paired = keyed.groupBy("conv_id", "_at").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_message"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant_message"), *times,
    )
    return paired.filter("user_message IS NOT NULL").withColumnRenamed("_at", "turn")


def with_route(df: DataFrame, text: str = "user_message") -> DataFrame:
    """Add ``routed``: 1 where the text holds a catalog keyword."""
    return df.withColumn("routed", has_keyword(F.col(text)).cast("int"))


def conversation_stats(turns: DataFrame, called: Column, time: str = "turn") -> DataFrame:
    """Turns, turns with a call, efficiency in percent and first time of each conversation."""
    counted = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if(called).alias("database_accesses"),
        F.min(time).alias("started_at"),
    )
    share = ratio(F.col("total_turns") - F.col("database_accesses"), F.greatest("total_turns", F.lit(1)))
    return counted.withColumn("efficiency", F.round(share * 100, 1))


def last_turns(turns: DataFrame, n: int = 20, order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation; the rank limit applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(order)))
    return turns.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def prompt_messages(turns: DataFrame, current: DataFrame, system_text: str, n: int = 20) -> DataFrame:
    """(conv_id, messages): the system text, the last ``n`` exchanges and the current question, in order.

    ``current`` holds (conv_id, query). A conversation has at most 2 * n + 2 messages.
    """
    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    history = last_turns(turns, n).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "user_message", "assistant_message"))).alias("h")
    )
    spoken = F.flatten(F.transform("h", lambda t: F.array(
        message("user", t["user_message"]), message("assistant", F.coalesce(t["assistant_message"], F.lit("")))
    )))
    joined = current.join(history, "conv_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    messages = F.concat(
        F.array(message("system", F.lit(system_text))), F.coalesce(spoken, none), F.array(message("user", F.col("query")))
    )
    return joined.select("conv_id", messages.alias("messages"))


def retrieved_rows(results: Column) -> Column:
    """Rows in all results of a turn, given as an array of arrays; none give 0."""
    return F.coalesce(F.aggregate(results, F.lit(0), lambda n, r: n + F.greatest(F.size(r), F.lit(0))), F.lit(0))


def turn_record(exchange: DataFrame, retrieved: Column, calls: Column) -> DataFrame:
    """One record per exchange: question, answer, calls, whether the catalog was read, rows retrieved.

    Where the exchanges have times, also when it was asked and the seconds until the answer (null without one).
    """
    seconds = (F.col("answered_at").cast("timestamp").cast("double") - F.col("asked_at").cast("timestamp").cast("double"))
    times = [F.col("asked_at"), seconds.alias("processing_seconds")] if "asked_at" in exchange.columns else []
    return exchange.select(
        "conv_id", "turn", F.col("user_message").alias("query"), F.col("assistant_message").alias("response"),
        calls.alias("calls"), (calls > 0).cast("int").alias("database_accessed"),
        F.coalesce(retrieved, F.lit(0)).alias("num_retrieved"), *times,
    )
