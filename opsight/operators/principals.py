"""Principal sync plan: what to create in the replica, and memberships in replica ids.

The plan only adds; principals or members missing in the primary are never removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions.relational import hot_key_join

UNNAMED = "Unnamed service principal"


def users_to_create(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Primary users whose name (case matters) the replica lacks, with a normalized payload.

    Display name and name are taken only together; if one is missing both are blank.
    """
    known = replica.filter("user_name is not null").select("user_name")
    both = F.col("display_name").isNotNull() & F.col("name").isNotNull()
    return primary.join(known, "user_name", "left_anti").select(
        "user_name",
        F.when(both, F.col("display_name")).otherwise("").alias("display_name"),
        F.when(both, F.col("name")).alias("name"),
        "active",
        "emails",
    )


def spn_payloads(primary: DataFrame) -> DataFrame:
    return primary.select(
        "application_id",
        F.coalesce("display_name", F.lit(UNNAMED)).alias("display_name"),
        F.lit(True).alias("active"),
    )


def groups_to_create(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Display names of primary groups the replica lacks; blank names are skipped."""
    named = primary.filter("display_name is not null and display_name <> ''").select("display_name").distinct()
    return named.join(replica.select("display_name"), "display_name", "left_anti")


def _by_name(primary: DataFrame, replica: DataFrame, key: str, id_name: str) -> DataFrame:
    """Primary id -> replica id through the natural key (null if the replica lacks it)."""
    mine = primary.filter(F.col("id").isNotNull() & F.col(key).isNotNull()).select("id", key).distinct()
    theirs = replica.filter(F.col("id").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("id").alias(id_name))
    return mine.join(theirs, key, "left").select(
        F.col("id").alias("value"), id_name, F.lit(True).alias(f"is_{id_name}")
    )


def translate_members(
    primary: dict[str, DataFrame], replica: dict[str, DataFrame], created: str = "new:"
) -> DataFrame:
    """Memberships of primary groups in replica ids, one row per resolved member.

    ``primary`` and ``replica`` hold ``users``, ``service_principals`` and ``groups``, and
    ``primary`` also ``members(group_id, position, value, ref)``, one row per member. The
    kind of a member is told by its reference or else by the id list it is in, users
    first, then service principals, then groups. Groups still to be created stand in as
    ``created`` + name. Members stay rows: a group may hold any share of them,
    so they meet its name and place in one join, in which large groups are dealt to several tasks.
    """
    groups = primary["groups"].filter("display_name is not null and display_name <> ''")
    fresh = groups_to_create(groups, replica["groups"]).select(
        F.concat(F.lit(created), "display_name").alias("id"), "display_name"
    )
    target_groups = replica["groups"].select("id", "display_name").unionByName(fresh)
    users = _by_name(primary["users"], replica["users"], "user_name", "user")
    spns = _by_name(primary["service_principals"], replica["service_principals"], "application_id", "spn")
    nested = _by_name(primary["groups"].select("id", "display_name"), target_groups, "display_name", "group")
    targets = target_groups.groupBy("display_name").agg(F.max("id").alias("target"))
    places = groups.select(F.col("id").alias("group_id"), "display_name").join(targets, "display_name")
    listed = primary["members"].filter("value is not null and value <> ''")
    members = hot_key_join(
        listed.select("group_id", "position", "value", F.coalesce("ref", F.lit("")).alias("ref")), places, "group_id"
    ).drop("group_id")
    ref = F.col("ref")
    resolved = (
        F.when(ref.startswith("Users/") | F.col("is_user"), F.col("user"))
        .when(ref.startswith("ServicePrincipals/") | F.col("is_spn"), F.col("spn"))
        .when(ref.startswith("Groups/") | F.col("is_group"), F.col("group"))
    )
    return (
        members.join(users, "value", "left")
        .join(spns, "value", "left")
        .join(nested, "value", "left")
        .withColumn("member_id", resolved)
        .filter("member_id is not null")
        .select("display_name", F.col("target").alias("group_id"), "position", "member_id")
    )
