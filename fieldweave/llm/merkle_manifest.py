"""Merkle manifest of a table, with an inclusion proof per row found by a recursive query.

Rows are leaves: SHA-256 of the row's columns, each as byte count, colon and value (``-`` if null). The leaves of one
group (null is a group) stand in the order of their key, null first, then of their hash; every two neighbours become
the hash of their hex digests, a last one without a neighbour the hash of its own, until one node is left: the group's
subroot (a lone leaf is its own). Subroots in the order of their groups, null first, become the root the same way.

Built levels are stored as node rows. A node row is linked to its ancestor ``stride`` levels up and holds the siblings on
the way there, so a recursive query climbs from every leaf to the root in few steps: each step joins a leaf's place to
the node row there, appends its siblings to the proof, folds the digest and moves to the row's ancestor. Nodes above
many leaves are stored in copies, one per ``LEAVES_PER_COPY`` leaves, so that no join key has more rows than that.

Levels are built from runs of ``2 ** stride`` neighbours; a group is never gathered. Repeated rows are leaves of their own.
An empty table has an empty manifest. Columns that are not named have no influence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import col
from fieldweave.operators.numbering import number_rows
from fieldweave.operators.skew import salted_join
from fieldweave.session import freeze

STRIDE = 12
LEAVES_PER_COPY = 1 << 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

# entries: (p, hash, ...) of one run in order; up: levels to climb in it. Digests are stored as bytes and hashed as hex text
_LEVELS = """
aggregate(if(up > 0, sequence(1, up), cast(array() AS array<int>)), array(transform(entries, e -> lower(hex(e.hash)))),
  (done, _) -> concat(done, array(transform(sequence(0, (size(element_at(done, -1)) - 1) div 2),
    j -> sha2(concat(element_at(done, -1)[2 * j], coalesce(get(element_at(done, -1), 2 * j + 1), '')), 256)))))
"""
_PATH = """
transform(if(up > 0, sequence(0, up - 1), cast(array() AS array<int>)), j -> named_struct(
  'l', if(shiftright(i, j) % 2 = 1, levels[j][shiftright(i, j) - 1], ''),
  'r', if(shiftright(i, j) % 2 = 0, coalesce(get(levels[j], shiftright(i, j) + 1), ''), '')))
"""
_FOLD = "aggregate({path}, {start}, (x, s) -> sha2(concat(s.l, x, s.r), 256))"
_SIBLINGS = "array_join(transform({path}, s -> concat(s.l, s.r)), '')"

_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT n, key, leaf, unhex({_FOLD.format(path="path", start="lower(hex(coalesce(start, leaf)))")}) AS folded, unhex({_SIBLINGS.format(path="path")}) AS proof,
    CAST(NULL AS BINARY) AS subroot, up_t, up_g, up_p, n % up_copies AS up_c FROM {{leaves}}
  UNION ALL
  SELECT c.n, c.key, c.leaf, unhex({_FOLD.format(path="x.path", start="lower(hex(c.folded))")}), concat(c.proof, unhex({_SIBLINGS.format(path="x.path")})),
    if(x.t = 0 AND x.g = 0, x.hash, c.subroot), x.up_t, x.up_g, x.up_p, c.n % x.up_copies
  FROM climb c JOIN {{nodes}} x ON c.up_t = x.t AND c.up_g = x.g AND c.up_p = x.p AND c.up_c = x.copy
)
SELECT key, leaf, subroot, proof, folded FROM climb WHERE up_t IS NULL
"""


def row_hash(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each as UTF-8 byte count, colon and text; ``-`` where null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _runs(nodes: DataFrame, stride: int, carry: Sequence[str]) -> DataFrame:
    """Runs of ``2 ** stride`` neighbours with the node above them.

    ``nodes``: tree ``t``, position ``p``, ``hash``, ``n_leaves`` below, ``size`` (nodes of this tree), and ``carry``.
    """
    entry = F.struct("p", "hash", "n_leaves", *carry)
    runs = nodes.groupBy("t", F.shiftright("p", stride).alias("q")).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.max("size").alias("size"))
    more = F.col("size") > (1 << stride)
    alone = F.expr("if(size(entries) > 1, length(bin(size(entries) - 1)), 0)")
    runs = runs.withColumn("more", more).withColumn("up", F.when(more, F.lit(stride)).otherwise(alone).cast("int"))
    total = F.expr("aggregate(entries, 0L, (x, e) -> x + e.n_leaves)")
    return runs.withColumn("top", F.unhex(F.element_at(F.expr(_LEVELS), -1)[0])).withColumn("total", total)


def _links(runs: DataFrame, stage: int, carry: Sequence[str]) -> DataFrame:
    """A row per entry of the runs with the siblings on its way and the place it comes to (none above the root)."""
    # paths are taken before the run is exploded, so that its levels are not copied to every row
    entry = F.expr(f"explode(transform(entries, (e, i) -> named_struct('e', e, 'path', {_PATH})))").alias("x")
    rows = runs.withColumn("levels", F.expr(_LEVELS)).select("t", "q", "more", "total", entry)
    out = rows.select("t", "q", "more", "total", "x.e", "x.path")
    more, leave = F.col("more"), F.col("t") > 0
    place = lambda inner, outer: F.when(more, inner).when(leave, outer).cast("bigint")
    return out.select(
        "t", F.lit(stage).cast("bigint").alias("g"), F.col("e.p").alias("p"), F.col("e.hash").alias("hash"), F.col("e.n_leaves").alias("n_leaves"),
        *[F.col(f"e.{c}").alias(c) for c in carry], "path",
        place(F.col("t"), F.lit(0)).alias("up_t"), place(F.lit(stage + 1), F.lit(0)).alias("up_g"), place(F.col("q"), F.col("t") - 1).alias("up_p"),
        F.ceil(F.col("total") / LEAVES_PER_COPY).cast("bigint").alias("up_copies"),
    )


def _tree(nodes: DataFrame, largest: int, stride: int, carry: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Link rows of every stage, the first with ``carry``, and the roots of all trees (``t``, ``hash``, ``n_leaves``)."""
    links, roots, stage = [], [], 0
    while True:
        runs = freeze(_runs(nodes, stride, carry if not stage else ()), "runs")
        links.append(_links(runs, stage, carry if not stage else ()))
        top = runs.select("t", "more", F.col("q").alias("p"), F.col("top").alias("hash"), F.col("total").alias("n_leaves"), F.ceil(F.col("size") / (1 << stride)).cast("bigint").alias("size"))
        roots.append(top.where("NOT more").select("t", "hash", "n_leaves"))
        if largest <= 1 << stride:
            break
        nodes, largest, stage = top.where("more").drop("more"), -(-largest >> stride), stage + 1
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return links, found


def build(rows: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, str] | None:
    """The manifest of ``rows`` (``grp``, ``key``, ``leaf``, ``start``: the digest to climb from, null if it is the leaf's): leaves
    with their first link, all node rows above them, and the root; None if there are no rows."""
    numbered = number_rows(rows, [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.coalesce("start", "leaf")], "n")
    groups = freeze(numbered.groupBy("grp").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    trees = freeze(number_rows(groups, [F.col("grp").asc_nulls_first()], "t", start=1).withColumnRenamed("grp", "g_grp"), "trees")
    bounds = trees.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    if not bounds["trees"]:
        return None
    placed = salted_join(numbered, trees.withColumnRenamed("g_grp", "grp"), ["grp"], ["n"], null_safe=True, right_bound=1)
    leaves = placed.select("t", (F.col("n") - F.col("first")).alias("p"), F.col("leaf").alias("hash"), F.lit(1).cast("bigint").alias("n_leaves"), "size", "n", "key", "start")
    lower, subroots = _tree(leaves, bounds["largest"], stride, ["n", "key", "start"])
    tops = subroots.select(F.lit(0).cast("bigint").alias("t"), (F.col("t") - 1).alias("p"), "hash", "n_leaves", F.lit(bounds["trees"]).cast("bigint").alias("size"))
    upper, root = _tree(tops, bounds["trees"], stride)
    nodes = None
    for part in [*lower[1:], *upper]:
        nodes = part if nodes is None else nodes.unionByName(part)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_leaves") / LEAVES_PER_COPY).cast("bigint") - 1))
    first = lower[0].select("n", "key", F.col("hash").alias("leaf"), "start", "path", "up_t", "up_g", "up_p", "up_copies")
    return first, freeze(nodes.withColumn("copy", copies), "nodes"), bytes(root.first()["hash"]).hex()


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``proof`` (siblings' digests up to the root) and ``folded`` of every leaf, as bytes: one
    recursive query.

    The session's limit on rows of recursive queries is lifted while it runs: the rows are a fixed number per leaf.
    """
    spark = leaves.sparkSession
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return freeze(spark.sql(_CLIMB, leaves=leaves, nodes=nodes), "climbed")
    finally:
        spark.conf.set(name, before)


def prove(docs: DataFrame, tampered: Mapping[str, Column], columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "lang", stride: int = STRIDE) -> DataFrame:
    """A row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, the ``proof`` (hex digests of all siblings up to the
    root, left to right per level), and ``folded``: the root that follows from the row with ``tampered`` columns."""
    own = {c: col(c) for c in columns}
    rows = docs.select(
        col(group).cast("string").alias("grp"), col(key).alias("key"),
        F.unhex(row_hash(list(own.values()))).alias("leaf"), F.unhex(row_hash(list((own | dict(tampered)).values()))).alias("start"),
    )
    rows = freeze(rows.withColumn("start", F.nullif("start", "leaf")), "leaves")
    built = build(rows, stride)
    if built is None:
        empty = F.lit(None).cast("string")
        return rows.select("key", *[empty.alias(c) for c in ("leaf", "subroot", "root", "proof", "folded")])
    leaves, nodes, root = built
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return climb(leaves, nodes).select("key", text("leaf"), text("subroot"), F.lit(root).alias("root"), text("proof"), text("folded"))
