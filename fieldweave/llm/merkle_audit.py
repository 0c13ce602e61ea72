"""Merkle fixity audit of archive replicas.

A manifest lists an archive's records: offset, length, SHA-256 of the bytes. Records that begin in the same range of
``RANGE`` bytes are hashed, in offset order, into that range's node; ``FAN_OUT`` neighbouring ranges into their parent,
up to one node per archive, and archives likewise up to one root. Two replicas are compared from the root: only the
children of nodes that differ are looked at, down to ranges and then records.

Nodes are keyed by offset, so a missing or damaged record spoils its own branch only. A node never gathers more than
the records of one range or ``FAN_OUT`` children. Records that stand at one place more than once are compared as a
multiset. Empty manifests have no nodes; against an empty replica every record is missing. Null archives, offsets,
lengths or digests make a record unusable: such rows are left out of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import col
from fieldweave.operators.numbering import number_rows
from fieldweave.session import freeze

RANGE = 1 << 16
FAN_OUT = 16
RECORDS_PER_ARCHIVE = 1024


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """Bytes of a response record; nulls are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, order: list[str], length: str = "length", per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """``records`` with ``archive`` and ``offset``: archives of ``per_archive`` records, filled in the order given."""
    numbered = number_rows(records, order, "_n")
    rows = numbered.withColumn("archive", F.floor(F.col("_n") / per_archive).cast("bigint"))
    before = Window.partitionBy("archive").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint")).drop("_n")


def _differ() -> Column:
    return ~F.col("left_hash").eqNullSafe(F.col("right_hash"))


def _node(order: list[str], side: int, line: Column) -> Column:
    """Hash of one replica's entries of a node in order; null if it has none."""
    entry = F.struct(*[F.col(o) for o in order], line.alias("line"))
    lines = F.array_sort(F.collect_list(F.when(line.isNotNull() & ((F.col("side") == side) if side >= 0 else F.lit(True)), entry)))
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(F.transform(lines, lambda e: e["line"]), "\n").cast("binary"), 256))


def build_tree(both: DataFrame, range_bytes: int = RANGE, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels from ranges up to one root: ``archive``, ``place``, ``left_hash``, ``right_hash``, each written once.

    On the way up ``place`` is divided until every archive has one node, then ``archive`` is.
    """
    line = F.concat_ws(":", "offset", "length", "digest")
    ranges = both.withColumn("place", F.floor(F.col("offset") / range_bytes).cast("bigint")).groupBy("archive", "place")
    levels = [freeze(ranges.agg(_node(["offset", "length", "digest"], 0, line).alias("left_hash"), _node(["offset", "length", "digest"], 1, line).alias("right_hash")), "tree")]
    top = levels[0].agg(F.max("place").alias("place"), F.max("archive").alias("archive")).first()
    place, archive = top["place"] or 0, top["archive"] or 0
    while place or archive:
        inner = place > 0
        key = "place" if inner else "archive"
        up = {"place": F.floor(F.col("place") / fan_out), "archive": F.col("archive")} if inner else {"place": F.lit(0), "archive": F.floor(F.col("archive") / fan_out)}
        below = levels[-1].withColumn("child", F.col(key)).select(*[v.cast("bigint").alias(k) for k, v in up.items()], "child", "left_hash", "right_hash")
        hashes = [_node(["child"], -1, F.when(F.col(h).isNotNull(), F.concat_ws(":", "child", h))).alias(h) for h in ("left_hash", "right_hash")]
        levels.append(freeze(below.groupBy("archive", "place").agg(*hashes), "tree"))
        place, archive = (place // fan_out, archive) if inner else (0, archive // fan_out)
    return levels


def descend(levels: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """Ranges (``archive``, ``place``) that differ, found from the root down through differing nodes only."""
    bad = levels[-1].where(_differ()).select("archive", "place")
    for upper, lower in zip(levels[:0:-1], levels[-2::-1]):
        # one step down divides either the places or the archives
        inner = _divides_places(upper, lower)
        parent = [F.col("archive"), F.floor(F.col("place") / fan_out).cast("bigint")] if inner else [F.floor(F.col("archive") / fan_out).cast("bigint"), F.lit(0).cast("bigint")]
        marked = lower.where(_differ()).select("archive", "place", parent[0].alias("_a"), parent[1].alias("_p"))
        bad = marked.join(bad.select(F.col("archive").alias("_a"), F.col("place").alias("_p")), ["_a", "_p"], "left_semi").select("archive", "place")
    return bad


def _divides_places(upper: DataFrame, lower: DataFrame) -> bool:
    return (lower.agg(F.max("place")).first()[0] or 0) > 0


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """Places where two manifests (``archive``, ``offset``, ``length``, ``digest``) differ: ``archive``, ``offset``, the
    record's ``length`` (of the left replica where it has one) and ``kind``: missing or extra in the right replica, of
    another ``length``, or of other ``content``. Columns besides the four are ignored."""
    columns = [F.col("archive").cast("bigint").alias("archive"), F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"), F.col("digest")]
    both = left.select(F.lit(0).alias("side"), *columns).unionByName(right.select(F.lit(1).alias("side"), *columns)).na.drop()
    both = freeze(both, "manifests")
    bad = descend(build_tree(both, range_bytes, fan_out), fan_out)
    keyed = both.withColumn("place", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(bad, ["archive", "place"], "left_semi")
    count = lambda side: F.sum((F.col("side") == side).cast("int"))
    entries = keyed.groupBy("archive", "offset", "length", "digest").agg(count(0).alias("l"), count(1).alias("r")).where("l <> r")
    has = lambda side: F.max(F.when(F.col(side) > F.col("r" if side == "l" else "l"), F.col("length")))
    spots = entries.groupBy("archive", "offset").agg(has("l").alias("left"), has("r").alias("right"))
    kind = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").when(F.col("left") != F.col("right"), "length").otherwise("content")
    return spots.select("archive", "offset", F.coalesce("left", "right").alias("length"), kind.alias("kind"))


def page_manifests(pages: DataFrame, damaged: Column, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as archive records, and a replica in which ``damaged`` (the record as the replica has it, null if it is
    lost, over the column ``record``) was stored at the same offsets: records, left and right manifest.

    Each page is read and hashed once for both replicas; only hashes and lengths are ordered.
    """
    key = col(page_id)
    rows = pages.select(key.alias("page_id"), warc_record(key, col(url).cast("string"), col(html).cast("string")).alias("record")).withColumn("replica", damaged)
    light = rows.select(
        "page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"),
        F.octet_length("replica").cast("bigint").alias("r_length"), F.sha2(F.col("replica").cast("binary"), 256).alias("r_digest"),
    )
    placed = freeze(lay_out(light, ["page_id", "digest"]), "records")
    left = placed.select("archive", "offset", "length", "digest")
    right = placed.select("archive", "offset", F.col("r_length").alias("length"), F.col("r_digest").alias("digest"))
    return placed.select("page_id", "archive", "offset"), left, right
