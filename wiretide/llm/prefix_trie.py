"""Prefix trie of conversations: what they share from the first turn on, and what sharing would save.

Every distinct sequence of the first d turns (role, text) of a conversation is a node; conversations
that start with it are its members. A node is named by its depth and a 128-bit hash of the
sequence: the XOR of hashes of (depth, turn), so that the prefixes of a long conversation are running
XORs, taken in blocks of turns.

Totals over subtrees are a depth-band rollup. Depths are cut into bands of ``BAND`` levels. A node of
the band below depth t = k * BAND explodes only to its ancestors inside the band, at most ``BAND``. The
nodes at the depths t themselves, the band roots, form a contracted trie of 1 / BAND of the
depth, whose totals are completed first in the same way; then each band adds the completed totals of
the roots below it. So there are as many rounds as the logarithm of the depth, and no node
explodes to more than ``BAND`` rows a round.

Scale: texts are read once, only digests move on. Turns are ranked by ranges, so a conversation with
a third of all turns is many tasks; nodes with a third of all members or children are pre-aggregated,
children look their parent up by salted keys, and the ids that end at a node are joined in blocks
of ``ENDS`` ids. Only SHA-256 over the ids of one node is a sequence by nature: one task streams the
blocks of a node that has more than one. Of the data only the greatest depth reaches the driver.
Tables between steps are checkpoints.

Defined results: a null role or text is empty. Turns ascend by ``turn``, null first; ties by the
SHA-256 of the turn (role, text), equal turns stay apart. Rows without a conversation id belong to no
conversation and make no node. No conversations, no nodes. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.common import settled
from wiretide.llm.ranking import ranked

#: Levels of a band.
BAND = 8
#: Turns of a conversation whose running hash one window makes.
CHUNK = 1024
#: Ids that end at a node in one piece of text.
ENDS = 512
#: Pieces that the children of a node are dealt into to look up their parent.
SALTS = 64

_KEY = ["depth", "hash1", "hash2"]


def turns_of(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` (of role and text) and ``n_bytes`` (of the text)."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def as_they_are(turns: DataFrame) -> DataFrame:
    """Rows for ``trie``: each conversation's turns, from depth 1, and its root at depth 0."""
    placed = settled(ranked(turns, ["conv_id"], ["turn", "digest", "n_bytes"]))
    own = placed.select(
        "conv_id", (F.col("rank") + 1).alias("depth"), "digest", "n_bytes", F.col("total").alias("length")
    )
    return own.union(_roots(placed.where("rank = 0").select("conv_id", F.col("total").alias("length"))))


def _roots(ends: DataFrame) -> DataFrame:
    return ends.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(b"").alias("digest"),
        F.lit(0).cast("long").alias("n_bytes"),
        "length",
    )


def rebuilt(turns: DataFrame, *, family: int = 5, most_taken: int = 8) -> DataFrame:
    """Rows for ``trie`` of conversations that start like the first of their family.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all if fewer, none if it
    is absent) and then its own turns after its first h; h is the unsigned CRC-32 of the decimal c
    modulo ``most_taken`` + 1. A conversation that is left without turns has its root only.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string")) % (most_taken + 1)

    def starts(groups: DataFrame) -> DataFrame:
        # a family has fewer than 2 * family members
        bases = groups.where(F.col("conv_id") % family == 0)
        bases = bases.select(F.col("conv_id").alias("base"), F.col("total").alias("there"))
        taken = F.least("h", F.coalesce("there", F.lit(0)))
        return (
            groups.withColumns({"base": base, "h": h})
            .join(bases, "base", "left")
            .select("conv_id", "total", "h", taken.alias("taken"))
        )

    placed = settled(ranked(turns, ["conv_id"], ["turn", "digest", "n_bytes"], starts))
    length = (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")
    own = placed.where("rank >= h").select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "n_bytes", length
    )
    convs = placed.where("rank = 0").select("conv_id", "h", length, base.alias("base"))
    heads = placed.where((F.col("rank") < most_taken) & (F.col("conv_id") % family == 0))
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("rank") + 1).alias("depth"), "digest", "n_bytes")
    taken = convs.join(heads, "base").where("depth <= h")
    return own.unionByName(taken.select("conv_id", "depth", "digest", "n_bytes", "length")).unionByName(_roots(convs))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id``, the key of the prefix that ends with the row, ``n_bytes`` and ``last``."""
    rows = rows.select(
        "conv_id",
        "depth",
        F.expr(f"depth div {CHUNK}").alias("chunk"),
        F.xxhash64("depth", "digest").alias("one"),
        F.xxhash64("digest", "depth", F.lit("second")).alias("two"),
        "n_bytes",
        (F.col("depth") == F.col("length")).alias("last"),
    )
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"hash1": F.bit_xor("one").over(so_far), "hash2": F.bit_xor("two").over(so_far)})
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("conv_id", "chunk")
        .agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
        .select(
            "conv_id", "chunk", F.bit_xor("one").over(earlier).alias("past1"), F.bit_xor("two").over(earlier).alias("past2")
        )
        .where("chunk > 0")
    )
    whole = inside.join(chunks, ["conv_id", "chunk"], "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "conv_id",
        "depth",
        F.col("hash1").bitwiseXOR(F.coalesce("past1", zero)).alias("hash1"),
        F.col("hash2").bitwiseXOR(F.coalesce("past2", zero)).alias("hash2"),
        "n_bytes",
        "last",
    )


def _hash(one: Column, two: Column) -> Column:
    return F.struct(one.alias("hash1"), two.alias("hash2"))


def _banded(prefixes: DataFrame) -> DataFrame:
    """One row per node: its key, ``n_convs``, ``conv_id`` (smallest member), ``n_bytes`` and ``up``.

    ``up`` holds the hashes of the node's ancestors in its band and its own, from the band's root down;
    the depths follow from the node's.
    """
    band = F.expr(f"depth div {BAND}")
    root = (F.col("depth") % BAND == 0) & (F.col("depth") > 0)
    bands = F.when(root, F.array(band, band - 1)).otherwise(F.array(band))
    path = (
        prefixes.select("conv_id", F.explode(bands).alias("band"), F.struct("depth", "hash1", "hash2", "n_bytes").alias("node"))
        .groupBy("conv_id", "band")
        .agg(F.array_sort(F.collect_list("node")).alias("path"))
    )
    each = path.select("conv_id", "band", "path", F.posexplode("path").alias("place", "node"))
    # a band's root is a node of the band above; only the trie's root is in no other
    each = each.where((F.col("place") > 0) | (F.col("node.depth") == 0))
    hashes = F.transform(F.slice("path", F.lit(1), F.col("place") + 1), lambda n: _hash(n["hash1"], n["hash2"]))
    each = each.select("node.*", "conv_id", hashes.alias("up"))
    return (
        each.groupBy(*_KEY)
        .agg(F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("conv_id", "up", "n_bytes")).alias("first"))
        .select(*_KEY, "n_convs", "first.*")
    )


def _totals(prefixes: DataFrame, nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """Per node (key) the ``values`` summed over its subtree, itself included.

    Takes one row per prefix of each conversation, and all nodes with key, ``up`` and values. Of the
    result nodes whose subtree sums to nothing are left out.
    """
    some = " OR ".join(f"{v} <> 0" for v in values)
    sums = [F.sum(v).alias(v) for v in values]
    roots_up = F.col("depth") - F.col("depth") % BAND
    own_root = F.col("depth") % BAND == 0
    rootless = nodes.where(some).select(
        F.when(own_root, F.col("depth")).otherwise(roots_up).alias("depth"),
        F.when(own_root, _hash(F.col("hash1"), F.col("hash2"))).otherwise(F.col("up")[0]).alias("hash"),
        *values,
    )
    roots = rootless.groupBy("depth", "hash").agg(*sums).select("depth", "hash.*", *values)
    if deepest >= BAND:
        upper = prefixes.where(F.col("depth") % BAND == 0).withColumn("depth", F.expr(f"depth div {BAND}"))
        # also roots with nothing in their band: what is below them passes through
        contracted = _banded(upper).join(roots.withColumn("depth", F.expr(f"depth div {BAND}")), _KEY, "left")
        done = _totals(upper, settled(contracted.fillna(0, values)), values, deepest // BAND)
        roots = settled(done.withColumn("depth", F.col("depth") * BAND))
    # inside a band: nodes below its root, the roots of the next band with what they total
    inside = nodes.where(~own_root & F.expr(some)).select(*_KEY, "up", *values)
    ends = nodes.where(own_root & (F.col("depth") > 0)).select(*_KEY, "up").join(roots, _KEY)
    lifted = inside.unionByName(ends).select("depth", F.size("up").alias("n"), F.posexplode("up").alias("place", "hash"), *values)
    # the band's root is complete already, and so is a root of the next band
    lifted = lifted.withColumn("depth", F.col("depth") - F.col("n") + F.col("place") + 1)
    lifted = lifted.where(F.col("depth") % BAND != 0).groupBy("depth", "hash").agg(*sums)
    return lifted.select("depth", "hash.*", *values).unionByName(roots)


def _parents(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per node that has a parent its ``parent_conv_id``, and per node with children ``n_children``.

    A parent with many children is looked up once per salt.
    """
    above = F.col("up")[F.size("up") - 2]
    kids = nodes.where("depth > 0").select(
        *_KEY,
        (F.col("depth") - 1).alias("depth_up"),
        above["hash1"].alias("hash1_up"),
        above["hash2"].alias("hash2_up"),
        F.pmod(F.col("hash1"), F.lit(SALTS)).alias("salt"),
    )
    parent = ["depth_up", "hash1_up", "hash2_up"]
    salted = kids.groupBy(*parent, "salt").agg(F.count(F.lit(1)).alias("n"))
    count = salted.groupBy(*parent).agg(F.sum("n").alias("n_children")).toDF(*_KEY, "n_children")
    named = nodes.select(*(F.col(k).alias(p) for k, p in zip(_KEY, parent)), F.col("conv_id").alias("parent_conv_id"))
    found = salted.drop("n").join(named, parent)
    return kids.join(found, [*parent, "salt"]).select(*_KEY, "parent_conv_id"), count


def _ends(prefixes: DataFrame) -> DataFrame:
    """Per node at which conversations end ``ends_sha256``."""
    placed = ranked(prefixes.where("last").select(*_KEY, "conv_id"), _KEY, ["conv_id"])
    texts = (
        placed.groupBy(*_KEY, F.expr(f"rank div {ENDS}").alias("piece"))
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select(*_KEY, "piece", "total", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )
    short = texts.where(F.col("total") <= ENDS).select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    long = texts.where(F.col("total") > ENDS).select(*_KEY, "piece", "ids")
    sorted_pieces = long.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece")
    return short.unionByName(sorted_pieces.mapInArrow(_streamed, "depth long, hash1 long, hash2 long, ends_sha256 string"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order, joined by commas."""
    node, digest = None, None

    def out():
        return pa.RecordBatch.from_pylist([{**dict(zip(_KEY, node)), "ends_sha256": digest.hexdigest()}])

    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in _KEY)
            if key != node:
                if node is not None:
                    yield out()
                node, digest = key, hashlib.sha256(row["ids"].encode())
            else:
                digest.update(b"," + row["ids"].encode())
    if node is not None:
        yield out()


def trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (``as_they_are``, ``rebuilt``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (over the subtree, bytes of a node's
    last text for each member but one) and ``ends_sha256`` (ids of the members that end here,
    ascending, joined by commas).
    """
    prefixes = settled(_prefixes(rows))
    deepest = prefixes.agg(F.max("depth")).first()[0] or 0
    nodes = settled(_banded(prefixes))
    parents, children = _parents(nodes)
    own = nodes.join(children, _KEY, "left").select(
        *nodes.columns,
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    own = settled(own)
    sums = _totals(prefixes, own, ["n_leaves", "saved_tokens"], deepest)
    whole = own.drop("n_leaves", "saved_tokens", "up", "n_bytes")
    for more in (parents, sums, _ends(prefixes)):
        whole = whole.join(more, _KEY, "left")
    zero: Column = F.lit(0).cast("long")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
