"""External channels: parsing of exports, roles, identities, threads, and collisions with native threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_blank

_COLUMNS = ("source", "message_id", "thread_id", "sender", "ts", "text", "subject")


def _external(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    cols = {"subject": F.lit(None).cast("string")} | cols
    rows = df.select(F.lit(source).alias("source"), *(cols[c].alias(c) for c in _COLUMNS[1:]))
    required = ("message_id", "thread_id", "sender", "text")
    return rows.where(~is_blank(F.col(required[0])) & ~is_blank(F.col(required[1])) & ~is_blank(F.col(required[2])) & ~is_blank(F.col(required[3])) & F.col("ts").isNotNull())


def parse_posts(df: DataFrame, source: str = "x") -> DataFrame:
    """Posts and mentions; the thread is the conversation, else the post itself."""
    return _external(df, source, message_id=F.col("id"), thread_id=F.coalesce("conversation_id", "id"), sender=F.col("author_id"), ts=F.col("created_at"), text=F.col("text"))


def parse_dms(df: DataFrame, source: str = "x") -> DataFrame:
    """Conversations with an array of messages (id, sender_id, text, created_at)."""
    rows = df.select("conversation_id", F.explode("messages").alias("m"))
    return _external(rows, source, message_id=F.col("m.id"), thread_id=F.col("conversation_id"), sender=F.col("m.sender_id"), ts=F.col("m.created_at"), text=F.col("m.text"))


def parse_mail(mails: DataFrame, threads: DataFrame, source: str = "gmail") -> DataFrame:
    """Mails left-joined to the subjects of their threads; the body, else the snippet."""
    subjects = threads.select(F.col("id").alias("thread_id"), F.col("subject").alias("thread_subject"))
    rows = mails.join(subjects, "thread_id", "left")
    body = F.when(~is_blank(F.col("body")), F.col("body")).otherwise(F.col("snippet"))
    return _external(
        rows, source, message_id=F.col("id"), thread_id=F.col("thread_id"), sender=F.col("from"), ts=F.col("timestamp"), text=body,
        subject=F.coalesce("subject", "thread_subject"),
    )


def label_roles(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds ``role``: a sender on the source's agent list (without case) is an agent, every other a customer."""
    listed = agents.select("source", F.lower("sender").alias("_agent"), F.lit(1).alias("_listed")).distinct()
    same = (messages["source"] == listed["source"]) & (F.lower(messages["sender"]) == listed["_agent"])
    return messages.join(listed, same, "left").select(
        *(messages[c] for c in messages.columns), F.when(F.col("_listed") == 1, "agent").otherwise("customer").alias("role")
    )


def identity_key(source: Column, sender: Column) -> Column:
    return F.when(source == "gmail", F.lower(F.trim(sender))).otherwise(F.trim(sender))


def resolve_identities(messages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``customer_id`` and ``error`` (code) and ``identity`` (hash, never the raw one) to customer messages."""
    keyed = mapping.select("source", identity_key(F.col("source"), F.col("identity")).alias("_key"), "customer_id")
    owners = keyed.groupBy("source", "_key").agg(F.countDistinct("customer_id").alias("_n"), F.min("customer_id").alias("_owner"))
    rows = messages.withColumn("_key", identity_key(F.col("source"), F.col("sender")))
    j = rows.join(owners, ["source", "_key"], "left")
    agent = F.col("role") != "customer"
    error = (
        F.when(agent, None).when(is_blank(F.col("sender")), "EXTERNAL_IDENTITY_MISSING").when(F.col("_n") > 1, "IDENTITY_MAPPING_AMBIGUOUS")
        .when(F.col("_n").isNull(), "UNMAPPED_EXTERNAL_IDENTITY")
    )
    digest = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat("source", F.lit(":"), "_key"), 256), 1, 12))
    return j.select(
        *messages.columns, F.when(~agent & (F.col("_n") == 1), F.col("_owner")).alias("customer_id"), error.alias("error"),
        F.when(error.isNotNull(), digest).alias("identity"),
    )


def build_threads(messages: DataFrame) -> DataFrame:
    """``(source, thread_id, customer_id, error, n_messages, subject, message_ids)`` by source and thread.

    No owner: UNRESOLVED_THREAD; several: CROSS_CUSTOMER_CONTAMINATION. Ids get the source as prefix.
    """
    prefix = lambda c: F.concat("source", F.lit(":"), c)
    order = F.struct("ts", "message_id")
    filled = F.when(~is_blank(F.col("subject")), F.col("subject"))
    grouped = messages.groupBy("source", "thread_id").agg(
        F.countDistinct("customer_id").alias("n"),
        F.min("customer_id").alias("owner"),
        F.count("*").alias("n_messages"),
        F.min_by(filled, F.when(filled.isNotNull(), order)).alias("subject"),
        F.transform(F.array_sort(F.collect_list(order)), lambda m: m["message_id"]).alias("ids"),
        F.min("ts").alias("created_at"),
    )
    error = F.when(F.col("n") == 0, "UNRESOLVED_THREAD").when(F.col("n") > 1, "CROSS_CUSTOMER_CONTAMINATION")
    return grouped.select(
        "source", prefix("thread_id").alias("thread_id"), F.when(F.col("n") == 1, F.col("owner")).alias("customer_id"), error.alias("error"),
        "n_messages", "subject", F.array_join(F.transform("ids", lambda i: F.concat("source", F.lit(":"), i)), ",").alias("message_ids"), "created_at",
    )


def id_collisions(native_ids: DataFrame, external: DataFrame) -> DataFrame:
    """Adds ``dropped``: a thread or message id exists natively (one set ``id``), or the thread id was kept before."""
    ids = external.select("thread_id", "position", F.explode(F.concat(F.array("thread_id"), F.split("message_ids", ","))).alias("id"))
    hit = ids.join(native_ids.select("id").distinct(), "id", "left_semi").select("thread_id", "position").distinct().withColumn("_hit", F.lit(1))
    rows = external.join(hit, ["thread_id", "position"], "left")
    free = F.row_number().over(Window.partitionBy("thread_id", F.col("_hit").isNull()).orderBy("position"))
    return rows.withColumn("_nth", free).withColumn(
        "dropped", F.when(F.col("_hit") == 1, "collision").when(F.col("_nth") > 1, "repeated")
    ).drop("_hit", "_nth")
