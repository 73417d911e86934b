"""Chat tables: normalisation, lists, latest turns, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pultwerk.functions.text import strip

UUID = r"(?i)\A(?:urn:)?(?:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"
DEFAULT_TITLE = "Neuer Chat"
MAX_MESSAGES = 10_000


def normalise(chats: DataFrame) -> DataFrame:
    """Title, privacy mode, id and messages of saved chats brought into their allowed form.

    An invalid id is replaced by one made from the row's own content, so that a retried
    task produces the same id again.
    """
    made = F.md5(F.concat_ws("|", F.coalesce("chat_id", F.lit("")), F.col("created_at").cast("string")))
    cut = lambda a, n: F.substring(made, a, n)
    fresh = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    return chats.withColumns({
        "chat_id": F.when(F.coalesce("chat_id", F.lit("")).rlike(UUID), F.col("chat_id")).otherwise(fresh),
        "title": F.substring(F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)), 1, 100),
        "privacy_mode": F.when(F.col("privacy_mode") == "local_required", "local_required").otherwise("auto"),
        "messages": F.when(F.size("messages") > MAX_MESSAGES, F.slice("messages", 1, 0)).otherwise(F.coalesce("messages", F.array().cast("array<string>")))})


def overview(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("updated_at"))


def by_last_update(chats: DataFrame) -> DataFrame:
    return chats.orderBy(F.desc("updated_at"), "conv_id")


def latest_user_turn(turns: DataFrame) -> DataFrame:
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def recent_user_texts(turns: DataFrame, n: int = 20) -> DataFrame:
    """Last n non-blank user texts per chat as one bullet list, oldest first.

    The rank keeps n rows per chat before the shuffle; only those are gathered.
    """
    said = turns.filter("role = 'user'").withColumn("text", strip(F.col("text"))).filter("text <> ''")
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = said.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), F.concat(F.lit("- "), "text").alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("prompt"), F.count("*").alias("texts"))


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose columns contain the text, ignoring case; a blank search keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return rows
    hit: Column = F.lit(False)
    for name in columns:
        hit = hit | F.lower(F.col(name)).contains(wanted)
    return rows.filter(hit)


def last_lines(lines: DataFrame, group: str, order: list[str], n: int = 300) -> DataFrame:
    """Newest n lines of every log."""
    newest = W.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n).drop("rn")
