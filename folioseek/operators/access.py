"""Reports on users and their credentials; the secret hash is compared, never shown."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import UNKNOWN_NAME
from ..functions.text import blank, trimmed
from .tables import delete_cascade, with_name

# --- fixed values ---
STATUS = ("missing", "unknown", "revoked", "expired", "disabled", "ok")
PUBLIC_USER = ["id", "username", "role", "disabled", "note", "created_at"]
PUBLIC_CREDENTIAL = ["id", "user_id", "kind", "name", "prefix", "last_used_at", "expires_at", "revoked", "created_at"]
BEARER = "(?i)^bearer "
# --- end of fixed values ---


def expiry(days: Column, issued: Column) -> Column:
    """When a credential ends; no days, or 0, means never."""
    return F.when(days > 0, issued + F.make_dt_interval(days=days))


def bearer_token(header: Column) -> Column:
    """The token of an Authorization header, null when there is none."""
    return F.when(header.rlike(BEARER), trimmed(F.substr(header, F.lit(len("bearer ") + 1))))


def credential_status(presented: DataFrame, credentials: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(request_id, token) with status and, when ok, the user id. The first failing check names the status."""
    held = credentials.select("secret_hash", "user_id", "revoked", "expires_at")
    owners = users.select(F.col("id").alias("user_id"), "disabled")
    hashed = presented.withColumn("secret_hash", F.sha2("token", 256))
    checked = hashed.join(held, "secret_hash", "left").join(owners, "user_id", "left")
    status = (
        F.when(blank(F.col("token")), "missing")
        .when(F.col("revoked").isNull(), "unknown")
        .when(F.col("revoked"), "revoked")
        .when(F.col("expires_at") < now, "expired")
        .when(F.coalesce("disabled", F.lit(True)), "disabled")
        .otherwise("ok")
    )
    return checked.select(
        *presented.columns, status.alias("status"), F.when(status == "ok", F.col("user_id")).alias("user_id")
    )


def visible_credentials(credentials: DataFrame, users: DataFrame, kind: str, viewer_id, viewer_is_admin: bool) -> DataFrame:
    """Credentials of a kind with their owner's name, newest first; only admins see those of others."""
    rows = credentials.filter(F.col("kind") == kind).select(*PUBLIC_CREDENTIAL)
    if not viewer_is_admin:
        rows = rows.filter(F.col("user_id") == viewer_id)
    names = users.select(F.col("id").alias("user_id"), "username")
    return with_name(rows, names, "user_id", "username", UNKNOWN_NAME).orderBy(F.col("created_at").desc(), "id")


def users_with_counts(users: DataFrame, credentials: DataFrame) -> DataFrame:
    """Users, oldest first, with their unrevoked app tokens and API keys."""
    counts = (
        credentials.filter(~F.col("revoked"))
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.count_if(F.col("kind") == "app").alias("tokens"), F.count_if(F.col("kind") == "api").alias("api_keys"))
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "api_keys")]
    return users.select(*PUBLIC_USER).join(counts, "id", "left").select(*PUBLIC_USER, *zero).orderBy("created_at", "id")


def store_counts(users: DataFrame, credentials: DataFrame) -> DataFrame:
    """One row: users, app tokens, API keys (revoked ones too)."""
    people = users.agg(F.count("*").alias("n"))
    return credentials.agg(
        F.count_if(F.col("kind") == "app").alias("tokens"), F.count_if(F.col("kind") == "api").alias("api_keys")
    ).select(people.scalar().alias("users"), "tokens", "api_keys")


def other_admins(users: DataFrame, exclude_id) -> DataFrame:
    """One row: enabled admins besides one user, who may only go while another remains."""
    admin = (F.col("role") == "admin") & ~F.col("disabled") & (F.col("id") != exclude_id)
    return users.agg(F.count_if(admin).alias("n"))


def delete_users(ids: DataFrame, users: DataFrame, credentials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users without the deleted ones, and credentials without theirs."""
    left = delete_cascade(ids.select("id"), {"users": users}, "id")["users"]
    owned = delete_cascade(ids.select(F.col("id").alias("user_id")), {"credentials": credentials}, "user_id")["credentials"]
    return left, owned
