"""Identity registry with recycled addresses, and mailbox discovery with usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def registry(events: DataFrame) -> DataFrame:
    """Identities by e-mail address in order of registration: the last is active, the others are recycled and name their successor."""
    w = Window.partitionBy("email").orderBy("seq")
    x = events.withColumn("successor", F.lead("object_id").over(w))
    return x.select("email", "object_id", "seq", F.when(F.col("successor").isNull(), "active").otherwise("recycled").alias("status"), "successor")


def resolve(emails: DataFrame, remote: DataFrame, registered: DataFrame) -> DataFrame:
    """Each address's object id: the remote answer first, else the active registered one; null if neither has it."""
    active = registered.where(F.col("status") == "active").select("email", F.col("object_id").alias("cached"))
    x = emails.join(remote.select("email", F.col("object_id").alias("answer")), "email", "left").join(active, "email", "left")
    return x.select("email", F.coalesce("answer", "cached").alias("object_id"), F.when(F.col("answer").isNotNull(), "remote").when(F.col("cached").isNotNull(), "cached").alias("origin"))


def license_status(plans: Column) -> tuple[Column, Column]:
    """(licensed, status) of an array of plans (service, status): the first exchange plan that has a status; licensed if Enabled."""
    mail = F.filter(plans, lambda p: (F.lower(p["service"]) == "exchange") & (F.coalesce(p["status"], F.lit("")) != ""))
    status = F.get(mail, 0)["status"]
    return F.coalesce(status == "Enabled", F.lit(False)), status


def usage_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Usage by lower-cased principal from CSV lines (column line, order in seq): quoted fields, bad numbers 0, the last row of a principal."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    x = lines.select("seq", F.from_csv("line", F.lit(schema), {"quote": '"', "escape": '"'}).alias("r"))
    number = lambda c: F.coalesce(F.expr(f"try_cast(r.`{c}` as bigint)"), F.lit(0).cast("long"))
    x = x.select(F.lower("r.upn").alias("upn"), "seq", number("size").alias("mailbox_size_bytes"), number("items").alias("item_count"))
    return x.groupBy("upn").agg(F.max_by(F.struct("mailbox_size_bytes", "item_count"), "seq").alias("u")).select("upn", "u.*")


def with_usage(mailboxes: DataFrame, usage: DataFrame, licensed_only: bool = False) -> DataFrame:
    """Mailboxes with their usage, null where the report has none."""
    x = mailboxes.where("licensed") if licensed_only else mailboxes
    return x.join(usage, F.lower(x["mail"]) == usage["upn"], "left").drop("upn")


def mailboxes(users: DataFrame) -> DataFrame:
    """Mailboxes of users that have an id and an address: user_id, mail, display_name (the address for none), licensed, exchange_plan_status."""
    filled = F.col("id").isNotNull() & (F.coalesce("mail", F.lit("")) != "")
    licensed, status = license_status(F.coalesce("assignedPlans", F.array().cast("array<struct<service:string,status:string>>")))
    return users.where(filled).select(F.col("id").alias("user_id"), "mail", F.coalesce("displayName", "mail").alias("display_name"), licensed.alias("licensed"), status.alias("exchange_plan_status"))
