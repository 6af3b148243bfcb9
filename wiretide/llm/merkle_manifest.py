"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups, proofs.

A row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, a colon
and the value. In a group, leaves ascend by id; while several nodes remain, every ``fan``
consecutive ones (the last run may be shorter, even one) become the digest of their digests.
What remains is the group's subroot; subroots, by group (null first, then bytewise), give the root
in the same way.

The tree is a nested-struct rollup. The rank of a leaf in its block (``fan ** LEVELS`` leaves) is
written as digit columns; grouping the lowest digit away nests the nodes of a run in their parent,
and after ``LEVELS`` such groupings a block is one row: the struct of its subtree. Blocks are the
leaves of the next band of levels, up to the groups' roots. Proofs then go down: a block unfolds its
nested structs by transforms, each child gets its siblings in front of its parent's path, and one
explode emits the leaves with their proofs. No join is made per leaf; a block meets its own path by
one join per block.

Scale: texts are read once and only digests move on. Leaves are dealt by ranges of (group, id), so a
group with all rows is many tasks; the groupings of a block need one shuffle, by (group, block). A
task holds one block's subtree at a time. The number of bands is the logarithm of the largest
group; of each band only its greatest height reaches the driver. Tables between steps are checkpoints.

Defined results: nulls of any field are part of the digest. A null id sorts first; equal ids are
ordered by digest, and equal rows are leaves of their own. An empty table has no rows. Only the named
columns are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import settled
from wiretide.llm.ranking import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
FAN = 2
#: Levels of the tree in one block of rows.
LEVELS = 10
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(_part, values)), 256)


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _height(total: Column, fan: int) -> Column:
    """How often runs must be joined until one node of so many remains."""
    powers = [fan**k for k in range(64) if fan**k < 2**62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < total))


def _joined(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda n: n["digest"]), "")


def _nested(nodes: DataFrame, fan: int, levels: int, base: int) -> DataFrame:
    """One row per block: ``group``, ``block``, ``height``, ``digest`` and ``run``, its subtree.

    Takes ``group``, ``height`` (of the group's tree), ``place``, ``digest`` and ``load`` of nodes at
    level ``base``. Levels at or above the tree's height pass their single node on.
    """
    size = fan**levels
    digits = [f"digit{k}" for k in range(levels)]
    rows = nodes.select(
        "group",
        "height",
        F.expr(f"place div {size}").alias("block"),
        *(F.expr(f"cast(place div {fan**k} % {fan} as int)").alias(d) for k, d in enumerate(digits)),
        "digest",
        "load",
    ).repartition("group", "block")
    inner = "load"
    for k, digit in enumerate(digits):
        rows = rows.groupBy("group", "block", "height", *digits[k + 1 :]).agg(
            F.array_sort(F.collect_list(F.struct(digit, "digest", inner))).alias("run")
        )
        own = F.when(F.col("height") > base + k, F.sha2(_joined(F.col("run")), 256))
        rows = rows.withColumn("digest", own.otherwise(F.col("run")[0]["digest"]))
        inner = "run"
    return rows


def _children(k: int, hashed: Column) -> Callable[[Column], Column]:
    """What maps a node above level ``k`` to its children, with their paths."""

    def children(node: Column) -> Column:
        run = node["run"]

        def child(n: Column, i: Column) -> Column:
            before = _joined(F.slice(run, F.lit(1), i))
            after = _joined(F.slice(run, i + 2, F.size(run)))
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            path = F.when(hashed, F.concat(step, node["path"])).otherwise(node["path"]).alias("path")
            if k:
                return F.struct(n["run"].alias("run"), path)
            return F.struct(n["digest"].alias("digest"), n["load"].alias("load"), path)

        return F.transform(run, child)

    return children


def _unfolded(blocks: DataFrame, levels: int, base: int, also: list[str]) -> DataFrame:
    """The nodes of blocks with their paths: ``digest``, ``load``, ``path`` and the columns ``also``."""
    nodes = F.array(F.struct("run", "path"))
    for k in reversed(range(levels)):
        nodes = F.flatten(F.transform(nodes, _children(k, F.col("height") > base + k)))
    return blocks.select(*also, F.inline(nodes))


def _proved(
    nodes: DataFrame, fan: int, levels: int, crown: Callable[[DataFrame], DataFrame], base: int = 0
) -> DataFrame:
    """``digest``, ``load`` and ``path`` of all nodes, with the columns that ``crown`` gives their group.

    ``crown`` takes one row per group (``group``, ``digest``) and returns ``group``, ``path`` (what
    follows the group's own levels) and further columns.
    """
    blocks = settled(_nested(nodes, fan, levels, base))
    tallest = blocks.agg(F.max("height")).first()[0] or 0
    if tallest <= base + levels:
        above = crown(blocks.select("group", "digest")).withColumn("block", F.lit(0).cast("long"))
    else:
        upper = blocks.select(
            "group", "height", F.col("block").alias("place"), "digest", F.struct("group", "block").alias("load")
        )
        above = _proved(upper, fan, levels, crown, base + levels).drop("digest").select("load.*", "*").drop("load")
    also = [c for c in above.columns if c not in ("group", "block", "path")]
    return _unfolded(blocks.drop("digest").join(above, ["group", "block"]), levels, base, also)


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    also: dict[str, Column] | None = None,
    fan: int = FAN,
    levels: int = LEVELS,
) -> DataFrame:
    """The id, ``leaf``, ``subroot``, ``root`` and ``path`` of every row, and the columns ``also``.

    ``path`` lists, from the leaf's run up to the root, the digests ``before`` and ``after`` the node
    in its run, each side concatenated; both are empty for a run of one. ``fan`` is at least 2.
    """
    if fan < 2 or levels < 1:
        raise ValueError(f"fan is {fan} and levels {levels}; a run has two nodes or more, a block one level or more")
    more = also or {}
    leaves = settled(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("group"),
            leaf_digest([F.col(c) for c in fields]).alias("digest"),
            F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in more.items())).alias("more"),
        )
    )
    placed = ranked(leaves, ["group"], ["id", "digest"]).select(
        "group",
        _height(F.col("total"), fan).alias("height"),
        F.col("rank").alias("place"),
        "digest",
        F.struct("id", "more").alias("load"),
    )

    def top(roots: DataFrame) -> DataFrame:
        none = F.array().cast(_PATH).alias("path")
        return roots.select("group", F.col("digest").alias("root"), none)

    def crown(subroots: DataFrame) -> DataFrame:
        named = subroots.select(F.lit("").alias("all"), "group", "digest")
        nodes = ranked(named, ["all"], ["group"]).select(
            F.col("all").alias("group"),
            _height(F.col("total"), fan).alias("height"),
            F.col("rank").alias("place"),
            "digest",
            F.struct("group").alias("load"),
        )
        proved = _proved(nodes, fan, levels, top)
        return proved.select("load.group", F.col("digest").alias("subroot"), "root", "path")

    proved = _proved(placed, fan, levels, crown)
    return proved.select(
        F.col("load.id").alias(id_col),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        *(F.col("load.more")[n].alias(n) for n in more),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path lead to."""
    return F.aggregate(path, leaf, lambda own, p: F.sha2(F.concat(p["before"], own, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def audit(
    docs: DataFrame, tampered: Column, changed: dict[str, Column], *, id_col: str = "doc_id", **options
) -> DataFrame:
    """The manifest of the documents held against leaves in which fields were ``changed``.

    Where ``tampered`` holds, the leaf is taken with the changed fields; the siblings stay. Returns the
    id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    fields = options.get("fields", FIELDS)
    after = leaf_digest([changed.get(c, F.col(c)) for c in fields])
    proofs = manifest(docs, id_col=id_col, also={"after": F.when(tampered, after)}, **options)
    end = folded(F.coalesce("after", "leaf"), F.col("path"))
    return proofs.select(
        id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), end.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
