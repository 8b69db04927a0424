"""Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups.

A row's leaf is the hash of its fields. In every level a node finds the others of its run by equijoins of the level with
itself on computed sibling indices: the index with its lowest bit flipped where runs have two nodes, the run's other
slots otherwise. The node in slot zero then emits the run's parent. Levels shrink by the arity, so all of them together
cost little more than the first. On the way down every node hands its siblings and those above to the nodes below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.llm.common import in_order

_STEP = "struct<before: string, after: string>"


@dataclass(frozen=True)
class Settings:
    arity: int = 3      # nodes of a run


def field(value: Column) -> Column:
    """A value as it goes into a leaf: '-' if null, else the bytes of its text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(proof, start, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"]))).cast("binary"), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (_group, _at, _hash and others) with _before and _after: hashes of the run's earlier and later nodes, in order."""
    slot = F.pmod(F.col("_at"), F.lit(arity))
    before, after, found = [], [], nodes
    for k in range(1, arity):
        sibling = F.col("_at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("_at") - slot + F.pmod(slot + k, F.lit(arity))
        other = nodes.select(F.col("_group").alias("_og"), F.col("_at").alias("_oa"), F.col("_hash").alias(f"_h{k}"))
        found = found.join(other, F.col("_group").eqNullSafe(F.col("_og")) & (sibling == F.col("_oa")), "left").drop("_og", "_oa")
        hash_ = F.coalesce(f"_h{k}", F.lit(""))
        before.append(F.when(slot + k >= arity, hash_).otherwise(""))
        after.append(F.when(slot + k < arity, hash_).otherwise(""))
    return found.select(*nodes.columns, F.concat(*before).alias("_before"), F.concat(*after).alias("_after"))


def _single() -> Column:
    """The only node of its group's level: the group's root. A lone node in a later run is none."""
    return (F.col("_at") == 0) & (F.col("_after") == "")


def tree(leaves: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, levels) of leaves: _group, _at (from 0 without gaps in its group), _hash and others.

    roots: _group and _hash of each group. levels: written tables with _before and _after, from the leaves up.
    """
    top = leaves.agg(F.max("_at")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        level = cut(_with_siblings(nodes, settings.arity))
        levels.append(level)
        if top == 0:
            break
        top //= settings.arity
        nodes = level.filter((F.pmod(F.col("_at"), F.lit(settings.arity)) == 0) & ~_single()).select(
            "_group", F.expr(f"_at div {settings.arity}").alias("_at"), digest(F.col("_hash"), F.col("_after")).alias("_hash"))
    roots = levels[0].filter(_single()).select("_group", "_hash")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter(_single()).select("_group", "_hash"))
    return cut(roots), levels


def proofs(levels: list[DataFrame], above: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """The leaves with _subroot (their group's root) and _proof: an array of (before, after) from their level to the root's.

    above: _group and _above, the steps beyond the root of a group.
    """
    paths = None
    for level in reversed(levels):
        ended = level.filter(_single()).withColumn("_subroot", F.col("_hash"))
        if above is None:
            ended = ended.withColumn("_proof", F.array().cast(f"array<{_STEP}>"))
        else:
            beyond = above.select(F.col("_group").alias("_og"), F.col("_above").alias("_proof"))
            ended = ended.join(beyond, F.col("_group").eqNullSafe(F.col("_og"))).drop("_og")
        done = ended.drop("_before", "_after")
        if paths is not None:
            up = paths.select(F.col("_group").alias("_og"), F.col("_at").alias("_oa"), "_subroot", F.col("_proof").alias("_up"))
            step = F.array(F.struct(F.col("_before").alias("before"), F.col("_after").alias("after")))
            below = level.filter(~_single()).join(
                up, F.col("_group").eqNullSafe(F.col("_og")) & (F.expr(f"_at div {settings.arity}") == F.col("_oa")))
            done = done.unionByName(below.withColumn("_proof", F.concat(step, "_up")).drop("_og", "_oa", "_up", "_before", "_after"))
        paths = done if level is levels[0] else cut(done)
    return paths


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column] | None = None,
             settings: Settings = Settings()) -> DataFrame:
    """A row per row of docs: its order column, its group, leaf, subroot, root, proof (array of before and after),
    proof_sha256, and, for a copy of the row in which ``tampered`` replaces fields, folded_root and verified.

    Leaves of a group ascend by ``order`` (null first), then by hash; groups by their bytes (null first, a group of its
    own). Repeated rows are leaves of their own, one after the other. A null field counts as '-', an empty one as '0:'. An empty
    table gives no row. Other columns of docs don't matter.
    """
    one = F.lit(1).cast("long").alias("_one")
    other = leaf(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    own = cut(docs.select(F.col(order).alias("_key"), F.col(group).alias("_group"), leaf(*map(F.col, fields)).alias("_hash"),
                          other.alias("_other"), one))
    placed = in_order(own, ["_group", "_key", "_hash", "_other"], {"_one": "_at"}, within=["_group"]).drop("_one")
    subroots, levels = tree(placed, settings)
    tops = in_order(subroots.select(F.col("_group").alias("_name"), "_hash", one), ["_name"], {"_one": "_at"})
    root, upper = tree(tops.select("_name", F.lit("").alias("_group"), "_at", "_hash"), settings)
    above = cut(proofs(upper, settings=settings).select(F.col("_name").alias("_group"), F.col("_proof").alias("_above")))
    last = root.first()
    done = proofs(levels, above, settings).withColumn("root", F.lit(last._hash if last else "")).withColumn(
        "folded_root", fold(F.col("_other"), F.col("_proof")))
    return done.select(F.col("_key").alias(order), F.col("_group").alias(group), F.col("_hash").alias("leaf"),
                       F.col("_subroot").alias("subroot"), "root", F.col("_proof").alias("proof"),
                       proof_digest(F.col("_proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
