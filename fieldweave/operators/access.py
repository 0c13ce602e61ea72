"""Who may see which source, and upserts of identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.skew import salted_join


def has_access(requests: DataFrame, users: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests ``(user_id, source_id)`` that are allowed: the user is a superuser or an edge exists."""
    rows = requests.join(users.select("user_id", F.coalesce("is_superuser", F.lit(False)).alias("_super")), "user_id")
    by_rank = rows.where("_super")
    by_edge = rows.where("not _super").join(edges.select("user_id", "source_id").distinct(), ["user_id", "source_id"], "left_semi")
    return by_rank.unionByName(by_edge).drop("_super")


def sources_of_user(user_id: int, users: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources one user may list: all for a superuser, the linked ones otherwise."""
    me = users.where(F.col("user_id") == user_id).agg(F.bool_or("is_superuser"))
    linked = edges.where(F.col("user_id") == user_id).select("source_id")
    all_if_super = sources.where(F.coalesce(me.scalar(), F.lit(False)))
    return all_if_super.unionByName(sources.join(linked, "source_id", "left_semi")).distinct()


def users_of_source(edges: DataFrame, users: DataFrame, source_id: int) -> DataFrame:
    linked = edges.where(F.col("source_id") == source_id).select("user_id")
    return users.join(linked, "user_id", "left_semi")


def stable_uuid(*parts: Column) -> Column:
    """Identifier in uuid form derived from the row's key, so that a recomputed task yields the same one."""
    h = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def get_or_create(rows: DataFrame, identities: DataFrame, row_id: Sequence[str], batch: str) -> tuple[DataFrame, DataFrame]:
    """Identity of each row by ``(name, country)``; returns (rows with ``field_code``, new identities).

    A complete key reuses the existing identity or shares one new identity per key; an incomplete key always
    gets its own. ``identities``: ``field_code, name, country``, of which the first per key (by code) counts.
    """
    known = (
        identities.where("name is not null and country is not null")
        .groupBy("name", "country")
        .agg(F.min("field_code").alias("_known"))
    )
    complete = F.col("name").isNotNull() & (F.col("name") != "") & F.col("country").isNotNull() & (F.col("country") != "")
    # one name may hold very many rows: they are split by row id
    joined = salted_join(rows, known, ["name", "country"], row_id, None, "left")
    shared = stable_uuid(F.lit(batch), F.col("name"), F.col("country"))
    own = stable_uuid(F.lit(batch), F.lit("row"), *[F.col(c) for c in row_id])
    code = F.when(complete, F.coalesce("_known", shared)).otherwise(own)
    out = joined.withColumn("field_code", code).withColumn("_new", F.col("_known").isNull() | ~complete)
    created = out.where("_new").select("field_code", "name", "country").distinct()
    return out.drop("_known", "_new").select(*rows.columns, "field_code"), created


def append_new(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not in the target yet, each key once."""
    return incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
