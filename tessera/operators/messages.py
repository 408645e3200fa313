"""Message transforms: whitelisted fields, previews, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields that can be written back.
WRITABLE = (
    "subject", "body", "from", "sender", "toRecipients", "ccRecipients", "bccRecipients", "replyTo", "receivedDateTime", "sentDateTime",
    "importance", "isRead", "isDraft", "flag", "categories", "internetMessageId", "internetMessageHeaders", "inferenceClassification",
    "singleValueExtendedProperties", "multiValueExtendedProperties",
)
#: Ids of the properties that override flags and times of a message that is written back.
FLAGS, RECEIVED, SENT = "Integer 0x0E07", "SystemTime 0x0E06", "SystemTime 0x0039"


def message_json(messages: DataFrame) -> DataFrame:
    """Messages of conversations as the JSON documents that a source gives, with fields that may and may not be written back."""
    at = F.concat(F.lit("2026-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    row = F.struct(
        F.col("text").alias("body"), F.col("role").alias("from"), F.col("role").alias("sender"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("subject"), (F.col("turn") % 2 == 0).alias("isRead"),
        F.lit(True).alias("isDraft"), F.when(F.col("turn") % 3 > 0, at).alias("receivedDateTime"), F.when(F.col("turn") % 5 > 0, at).alias("sentDateTime"), F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("@x>")).alias("internetMessageId"),
        F.col("conv_id").alias("id"), F.when(F.col("turn") % 4 > 0, F.concat(F.lit("folder-"), F.col("role"))).alias("parentFolderId"), F.lit("x").alias("@odata.etag"), F.lit("c").alias("changeKey"),
    )
    return messages.select("conv_id", "turn", F.to_json(row).alias("json"))


def sanitize(messages: DataFrame, json_col: str = "json") -> DataFrame:
    """The writable fields of a message, never a draft, its properties, and the flag that tells whether it was read.

    Overrides take the place of single-value properties; times are overridden where the message has them as strings.
    """
    raw = F.from_json(json_col, "map<string,string>")
    fields = F.map_filter(raw, lambda k, v: k.isin(*(f for f in WRITABLE if f not in ("isDraft", "singleValueExtendedProperties"))))
    out = messages.withColumn("_raw", raw).withColumn("fields", fields).withColumn("is_draft", F.lit(False))
    truthy = ~F.coalesce(F.col("_raw")["isRead"], F.lit("")).isin("", "false", "0")
    out = out.withColumn("read_flag", F.when(truthy, 1).otherwise(0))
    prop = lambda id_, value: F.when(value.isNotNull(), F.struct(F.lit(id_).alias("id"), value.alias("value")))
    text = lambda c: F.when(F.get_json_object(json_col, f"$.{c}").isNotNull() & F.col(json_col).rlike(f'"{c}"\\s*:\\s*"'), F.col("_raw")[c])
    overrides = F.array_compact(F.array(prop(FLAGS, F.col("read_flag").cast("string")), prop(RECEIVED, text("receivedDateTime")), prop(SENT, text("sentDateTime"))))
    return out.withColumn("overrides", overrides).drop("_raw")


def folder_of(json: Column) -> Column:
    """Folder of a message as stored, for snapshots that don't say it."""
    return F.coalesce(F.get_json_object(json, "$.parentFolderId"), F.lit("__unknown__"))


def stored_message(messages: DataFrame, json_col: str = "json") -> DataFrame:
    """Message rows of a source's documents: raw body, its bytes, and empty strings for what is missing."""
    text = lambda c: F.coalesce(F.get_json_object(json_col, f"$.{c}"), F.lit(""))
    return messages.select("*", text("subject").alias("subject"), text("parentFolderId").alias("folder_id"), text("receivedDateTime").alias("received_at"), F.col(json_col).cast("binary").alias("raw_body"), F.octet_length(json_col).cast("long").alias("size_bytes"))


def file_attachments(attachments: DataFrame) -> DataFrame:
    """Attachments that are files, with their bytes; missing bytes give a row with empty content."""
    data = F.coalesce(F.unbase64("contentBytes"), F.lit(b""))
    return attachments.where(F.col("type") == "#microsoft.graph.fileAttachment").select(*(c for c in attachments.columns if c not in ("type", "contentBytes")), data.alias("content"), F.coalesce(F.col("size"), F.octet_length(data)).cast("long").alias("size_bytes"))


def recipients(array: Column) -> Column:
    """Recipients (name, address), comma-joined."""
    from tessera.functions.scalars import format_recipient

    return F.array_join(F.transform(F.coalesce(array, F.array().cast("array<struct<name:string,address:string>>")), lambda r: format_recipient(r["name"], r["address"])), ", ")


def preview(kind: Column, content: Column, text_of_html: Column) -> Column:
    text = F.when(F.lower(kind) == "html", text_of_html).otherwise(content)
    return F.when(content.isNull(), "(no body)").when(F.trim(text) == "", "(empty body)").otherwise(text)


def archive_names(messages: DataFrame) -> DataFrame:
    """Distinct file names of messages in their folders (columns folder_id, ordinal, name, file_name)."""
    from tessera.operators.names import distinct_names

    return distinct_names(messages.select("folder_id", "ordinal", "name"))
