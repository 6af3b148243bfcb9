"""Near-duplicate documents by MinHash, banding and odd sketches, confirmed on full shingle sets.

1. One pass over the texts makes, per document, its set of word shingles (as 64-bit hashes), a
   digest of the whole set, ``BANDS`` keys of ``BAND_ROWS`` MinHash values each, and an odd sketch:
   every (position, MinHash value) flips one bit of a bitmap, so the XOR of two bitmaps counts the
   positions that differ, and from that count follows an estimate of the similarity.
2. Documents of equal sets are one node, whatever their number, named by a long number.
3. Nodes that share a band key are a bucket. In each bucket the hub, the node that meets most other
   nodes over all its buckets, is paired with the others (a star: as many pairs as nodes). Pairs
   whose sketches rule the threshold out go; the others are possible links. Each node keeps the hub
   that meets most as its own and turns its other hubs into pairs of hubs, so only hubs take part in
   the search for the provisional clusters. In buckets that hold nodes of several clusters, the
   nodes outside the largest meet each other and, once per cluster, the largest, on sketches.
4. A true link thus lies inside one cluster. In a cluster each node is first tested against the
   cluster's hub, exactly on full sets. Nodes that are not linked to it then meet all nodes of the
   cluster whose set sizes allow a link, in pairs of blocks: from the most similar sketches down, and a
   pair that earlier links have joined needs no test. Links come out as a forest per pair of blocks,
   so a cluster of thousands of copies is never written out as all its pairs.
5. The links make the components, by the smallest id.

Bands: two sets of similarity 0.8 share no bucket with probability (1 - 0.8^BAND_ROWS)^BANDS, under
2e-7 here; an estimate misses a true link by ``MARGIN``, nearly five standard deviations, in about one
of a million. Confirmation is exact on the sets of 64-bit shingle hashes.

Scale: sketches are made where the texts are read. The texts of nodes in clusters are read again by
a join on their ids (Spark broadcasts these where they are few). What a hot bucket, hub or cluster
says to its members is looked up by salted keys. A cluster costs its nodes once, and once more per 256
nodes that are not linked to its hub. Components contract: a round names each node by the first, in
a random order, among it and its neighbours, and only edges between different names go on. No
links or components reach the driver, only counts. Tables between steps are checkpoints.

Defined results: a text without words, or null, has an empty set and is linked with nothing; with
fewer words than a shingle, the whole sequence is its one shingle. Every row is judged by its own
text, rows with equal ids too. A null id takes part, but names a component only if all ids in it are
null. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretide.llm.common import settled, slices, spaced_words, tidy
from wiretide.llm.ranking import spread_lookup
from wiretide.session import drop_written, scratch_folder, written

BAND_ROWS = 5
BANDS = 40
SAMPLES = BAND_ROWS * BANDS
SKETCH_BITS = 1024
#: How far below the threshold an estimate may lie before a pair is given up.
MARGIN = 0.14
#: The lowest threshold for which bands and margin keep the chances stated above.
LEAST_PERCENT = 80
#: Nodes of a bucket or cluster in one block; a group of rows is two blocks, one of them asking.
BLOCK = 256

_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _WordHash(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of that many words."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count = max(1, len(values) - size + 1)
    rolled = np.full(count, np.uint64(min(size, len(values))))
    for k in range(min(size, len(values))):
        rolled = _mixed(rolled + values[k : k + count])
    return np.unique(rolled)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the ``SAMPLES`` hash orders."""
    out = np.full(SAMPLES, np.uint64(2**64 - 1))
    for start in range(0, len(shingles), 256):
        part = shingles[start : start + 256]
        np.minimum(out, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmap of parities: each (position, sample) flips one of ``SKETCH_BITS`` bits."""
    place = _mixed(samples ^ _PLUS) % np.uint64(SKETCH_BITS)
    parity = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8))


def estimate(differing_bits):
    """Similarity from the number of bits in which two odd sketches differ."""
    full = np.minimum(2 * np.asarray(differing_bits) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-full)


def _most_bits(threshold: float) -> int:
    """The largest number of differing bits at which a pair may still be a link."""
    return int((estimate(np.arange(SKETCH_BITS // 2)) >= threshold - MARGIN).sum()) - 1


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """``id``, ``n`` (set size), ``node`` (digest), ``bands``, ``sketch`` of rows of id and text."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in slices(batches):
            counts, nodes, bands, sketches = [], [], [], []
            for text in batch["text"].to_pylist():
                shingles = shingle_set(text, size, hashes)
                counts.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = minhash(shingles)
                keys = np.zeros(BANDS, np.uint64)
                for column in samples.reshape(BANDS, BAND_ROWS).T:
                    keys = _mixed(keys + column)
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(_mixed(keys + _PLUS[:BANDS]).view(np.int64))
                sketches.append(odd_sketch(samples).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array(counts, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["id", "n", "node", "bands", "sketch"],
            )

    return rows.mapInArrow(work, f"id {kind}, n long, node binary, bands array<long>, sketch binary")


def _sets(clusters: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``number`` and ``shingles`` (its full set) of clustered nodes, from one document's text each."""
    first = nodes.join(clusters.select("number"), "number").select("number", "node", F.col("first").alias("id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in slices(batches):
            sets = [shingle_set(t, size, hashes).tobytes() for t in batch["text"].to_pylist()]
            # rows with one id may hold several texts: only the text of the node's own set speaks for it
            own = pa.array([xxhash.xxh3_128_digest(x) == n for x, n in zip(sets, batch["node"].to_pylist())], pa.bool_())
            found = pa.RecordBatch.from_arrays([batch["number"], pa.array(sets, pa.binary())], ["number", "shingles"])
            yield found.filter(own)

    texts = rows.join(first, rows["id"].eqNullSafe(first["id"])).select("number", "node", "text")
    return texts.mapInArrow(work, "number long, shingles binary").dropDuplicates(["number"])


class _Forest:
    """Union-find over places."""

    def __init__(self, count: int) -> None:
        self.up = list(range(count))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _dealt(rest: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both tables by pairs of blocks (``low`` of ``rest``, ``high`` of ``others``) of a group.

    ``asks`` marks the rows of ``rest``. Each of them meets all ``others`` of its group ``by``.
    """

    def blocks(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    counts = blocks(rest, "lows").join(blocks(others, "highs"), by)
    own, every = (
        lambda n: F.pmod(F.xxhash64("number"), n).cast("int"),
        lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)),
    )
    one = rest.join(counts, by).select(*rest.columns, own("lows").alias("low"), every("highs").alias("high"))
    two = others.join(counts, by).select(*rest.columns, every("lows").alias("low"), own("highs").alias("high"))
    return one.withColumn("asks", F.lit(True)).unionByName(two.withColumn("asks", F.lit(False)))


def _close_pairs(group, labels: np.ndarray, most_bits: int):
    """Places (a, b) of asking rows and others with different labels and few differing bits.

    Yields them in parts, the fewest bits first in each part.
    """
    asks = group["asks"].to_numpy()
    first, second = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(first) or not len(second):
        return
    sketches = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(asks), -1)
    for start in range(0, len(first), 64):
        part = first[start : start + 64]
        bits = np.bitwise_count(sketches[part][:, None, :] ^ sketches[second][None, :, :]).sum(2, dtype=np.int32)
        bits[labels[part][:, None] == labels[second][None, :]] = SKETCH_BITS
        x, y = np.nonzero(bits <= most_bits)
        order = np.argsort(bits[x, y], kind="stable")
        yield from zip(part[x[order]].tolist(), second[y[order]].tolist())


def _joined(dealt: DataFrame, by: list[str], most_bits: int, percent: int | None = None) -> DataFrame:
    """Pairs of labels (``a``, ``b``) that possible links join, or links if ``percent`` is given.

    They are a forest per pair of blocks.
    """

    def compare(group):
        import pandas as pd

        names, labels = np.unique(group["label"].to_numpy(), return_inverse=True)
        sets = None if percent is None else [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        forest, a_side, b_side = _Forest(len(names)), [], []
        for a, b in _close_pairs(group, labels, most_bits):
            if forest.root(labels[a]) == forest.root(labels[b]):
                continue
            if sets is None or _linked(sets[a], sets[b], percent):
                forest.join(labels[a], labels[b])
                a_side.append(names[labels[a]])
                b_side.append(names[labels[b]])
        return pd.DataFrame({"a": np.array(a_side, np.int64), "b": np.array(b_side, np.int64)})

    return dealt.groupBy(*by, "low", "high").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (a node's name) of the nodes of ``edges`` (``a``, ``b``, longs).

    Randomised contraction: each round names every node by the first, in an order drawn anew, among it
    and its neighbours; edges between different names make the next round's graph, which is a
    fraction of the last in expectation, whatever the shape. The names are put together at the end.
    """

    held: list[str] = []

    def kept(table: DataFrame) -> DataFrame:
        # written, not checkpointed: a checkpoint hands on what is known of its columns, round upon round
        table, folder = written(table, scratch_folder(table.sparkSession))
        held.append(folder)
        return table

    def distinct(table: DataFrame) -> DataFrame:
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return kept(table.where("a <> b").select(low, high).distinct())

    rounds: list[DataFrame] = []
    edges = distinct(edges)
    while edges.limit(1).count():
        order = lambda c, k=len(rounds): F.xxhash64(F.lit(k), c)
        both = edges.union(edges.select("b", "a")).select(F.col("a").alias("node"), "b", order("b").alias("place"))
        first = both.groupBy("node").agg(F.min_by("b", "place").alias("b"), F.min("place").alias("place"))
        name = F.when(F.col("place") < order("node"), F.col("b")).otherwise(F.col("node"))
        named = kept(first.select("node", name.alias("name")))
        rounds.append(named)
        for side in ("a", "b"):
            found = named.select(F.col("node").alias(side), F.col("name").alias("new"))
            edges = spread_lookup(edges, side, found, "b" if side == "a" else "a").drop(side).withColumnRenamed("new", side)
        edges = distinct(edges)
    label = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if rounds:
        label = rounds.pop().select("node", F.col("name").alias("component"))
    while rounds:
        label = spread_lookup(rounds.pop(), "name", label.withColumnRenamed("node", "name"), "node", "left")
        label = kept(label.select("node", F.coalesce("component", "name").alias("component")))
    label = settled(label)
    for folder in held:
        drop_written(label.sparkSession, folder)
    return label


def _clusters(near: DataFrame) -> DataFrame:
    """``number`` and ``label`` of nodes that possible links between nodes and hubs join.

    Takes ``a``, its hub ``b`` and ``top``, the hub that meets most among those of ``a``.
    """
    own = near.where("b = top").select(F.col("a").alias("number"), F.col("top"))
    hubs = settled(near.select(F.col("b").alias("number")).distinct())
    edges = near.where("b <> top").select(F.col("top").alias("a"), "b").distinct()
    edges = edges.union(own.join(hubs, "number", "left_semi"))
    found = components(edges).select(F.col("node").alias("top"), "component")
    lone = hubs.join(own, "number", "left_anti").select("number", F.col("number").alias("top"))
    named = spread_lookup(own.union(lone), "top", found, "number", "left")
    return settled(named.select("number", F.coalesce("component", "top").alias("label")))


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels joined by links between them; a node that only links name joins with its own number."""
    found = components(links)
    single = found.join(label, found["node"] == label["number"], "left_anti")
    label = label.union(single.select("node", F.col("node").alias("label")))
    named = spread_lookup(label, "label", found.withColumnRenamed("node", "label"), "number", "left")
    return settled(named.select("number", F.coalesce("component", "label").alias("label")))


def _bridges(members: DataFrame, looks: DataFrame, label: DataFrame, most_bits: int) -> DataFrame:
    """Pairs of clusters with a possible link between nodes that meet in a bucket."""
    named = members.select("key", "number").join(label, "number", "left")
    named = named.withColumn("label", F.coalesce("label", "number"))
    mixed = (
        named.groupBy("key", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1 AND size > 2")  # of two nodes the star has seen the only pair
        .select("key", F.col("most.label").alias("largest"), "kinds")
    )
    met = settled(named.join(mixed, "key"))
    rest = met.where("label <> largest")
    wanted = ["number", "label", "sketch"]
    inside = rest.where("kinds > 2").join(looks, "number").select("key", *wanted)
    outside = rest.select("largest", "number", "label").distinct().join(looks, "number").select("largest", *wanted)
    largest = met.where("label = largest").select("largest", "number", "label").distinct()
    largest = largest.join(looks, "number").select("largest", *wanted)
    return _joined(_dealt(inside, inside, ["key"]), ["key"], most_bits).union(
        _joined(_dealt(outside, largest, ["largest"]), ["largest"], most_bits)
    )


def _confirmed(
    label: DataFrame, reach: DataFrame, looks: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, percent: int,
    most_bits: int,
) -> DataFrame:
    """``number`` and ``label`` of the nodes of clusters, joined by links exact on full sets only."""
    sets = settled(_sets(label, nodes, rows, size))
    hubs = label.join(reach, "number").groupBy("label").agg(
        F.max(F.struct("reach", "number"))["number"].alias("hub"), F.count(F.lit(1)).alias("size")
    )
    hubs = settled(hubs.withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")))
    placed = settled(spread_lookup(label, "label", hubs, "number"))
    chunk = F.pmod(F.xxhash64("number"), F.col("chunks")).cast("int")
    tested = placed.where("number <> hub").select("number", "label", chunk.alias("chunk"), F.lit(False).alias("is_hub"))
    asked = hubs.select(
        F.col("hub").alias("number"), "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(True).alias("is_hub"),
    )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk's rows come together, its cluster's hub first
        hub, own = None, None
        for batch in slices(batches):
            linked, to = [], []
            for number, is_hub, held in zip(*(batch[c].to_pylist() for c in ("number", "is_hub", "shingles"))):
                values = np.frombuffer(held, np.uint64)
                if is_hub:
                    hub, own = number, values
                elif _linked(own, values, percent):
                    linked.append(number)
                    to.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array(to, pa.int64())], ["number", "to"])

    order = ["label", "chunk", F.desc("is_hub")]
    pairs = tested.unionByName(asked).join(sets, "number").repartition("label", "chunk").sortWithinPartitions(*order)
    linked = pairs.mapInArrow(star, "number long, to long")
    joined = placed.join(linked, "number", "left").select(
        "number", F.coalesce("to", "number").alias("label"), F.col("label").alias("cluster"), "hub", "size"
    )
    joined = settled(joined)
    # of two nodes the only pair is tested; else those not linked to the hub meet the cluster
    rest = joined.where("label <> hub AND size > 2").select("number", "label", "cluster")
    open_clusters = rest.select("cluster").distinct()
    everyone = joined.join(open_clusters, "cluster", "left_semi").select("number", "label", "cluster")
    # sets whose sizes are two classes apart differ by more than the threshold allows
    n = F.length("shingles") / 8
    sized = lambda t: t.join(sets, "number").join(looks, "number").withColumn(
        "class", F.floor(F.log(n) / float(1.001 * np.log(100 / percent) if percent < 100 else 1)).cast("int")
    )
    around = F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))
    dealt = _dealt(sized(rest), sized(everyone).withColumn("class", around), ["cluster", "class"])
    links = _joined(dealt, ["cluster", "class"], most_bits, percent)
    return _relabelled(joined.select("number", "label"), links)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per row the id, ``n_shingles``, ``component_id`` and ``kept`` (is it the component's id).

    Documents are linked if their sets share ``percent`` of a hundred of their union.
    """
    made, named = _judged(_texts(docs, id_col, text_col), shingle, percent)
    return _verdicts(made, named, id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _judged(rows: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and per node its ``component`` and the ``least`` id of that."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; bands and sketches find links from {LEAST_PERCENT} to 100 only")
    made = settled(_sketches(rows, shingle).withColumn("row", F.monotonically_increasing_id()))
    nodes = made.where("node IS NOT NULL").groupBy("node")
    nodes = settled(nodes.agg(F.min("id").alias("first"), F.min("row").alias("number")))
    label = _components(made, nodes, rows, shingle, percent)
    tidy(rows.sparkSession)
    named = nodes.join(label, "number", "left").select(
        "node", "first", F.coalesce("label", "number").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    return made, spread_lookup(named, "component", least, "node").select("node", "component", "least")


def _verdicts(made: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    out = spread_lookup(made.select("id", "n", "node", "row"), "node", named.select("node", "least"), "row", "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def _components(made: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``number`` and ``label`` of the nodes that share a bucket with others, by confirmed links."""
    most_bits = _most_bits(percent / 100)
    one_each = made.withColumnRenamed("row", "number").join(nodes.select("number"), "number", "left_semi")
    banded = one_each.select("number", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settled(banded.join(full, "key"))
    reach = settled(members.groupBy("number").agg(F.sum("size").alias("reach")))
    looks = settled(one_each.join(reach, "number").select("number", "sketch"))
    hubs = members.join(reach, "number").groupBy("key").agg(F.max(F.struct("reach", "number")).alias("hub"))
    star = (
        members.join(hubs, "key")
        .select(F.col("number").alias("a"), F.col("hub.number").alias("b"), F.col("hub.reach").alias("reach"))
        .where("a <> b")
        .distinct()
    )
    one = looks.select(F.col("number").alias("a"), F.col("sketch").alias("x"))
    two = looks.select(F.col("number").alias("b"), F.col("sketch").alias("y"))
    near = spread_lookup(star.join(one, "a"), "b", two, "a").where(_differ("x", "y") <= most_bits)
    widest = Window.partitionBy("a").orderBy(F.desc("reach"), F.desc("b"))
    near = settled(near.select("a", "b", F.first("b").over(widest).alias("top")))
    tidy(near.sparkSession)
    label = _clusters(near)
    label = _relabelled(label, _bridges(members, looks, label, most_bits))
    tidy(near.sparkSession)
    return _confirmed(label, reach, looks, nodes, rows, shingle, percent, most_bits)


@F.pandas_udf(T.IntegerType())
def _differ(x, y):
    import pandas as pd

    if not len(x):
        return pd.Series([], dtype="int32")
    first = np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1)
    second = np.frombuffer(b"".join(y), np.uint64).reshape(len(y), -1)
    return pd.Series(np.bitwise_count(first ^ second).sum(1).astype(np.int32))


def keep_one(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    single: bool = False,
) -> DataFrame:
    """The documents that are the first of their component, all columns as they were.

    Rows with one id stay or go together: they stay if one of them is the first of its component.
    With ``single``, one row of each component stays, also where ids are repeated: of the rows with
    its least id the first by a settled number.
    """
    made, named = _judged(_texts(docs, id_col, text_col), shingle, percent)
    judged = _verdicts(made, named, id_col)
    gone = judged.groupBy(F.col(id_col).alias("gone")).agg(F.max("kept").alias("kept")).where("NOT kept")
    apart = docs
    if single:
        twice = settled(made.groupBy(F.col("id").alias("twice")).count().where("count > 1").select("twice"))
        again = docs[id_col].eqNullSafe(twice["twice"])
        if not twice.limit(1).count():
            single = False
        else:
            apart = docs.join(twice, again, "left_anti")
    left = apart.join(gone, apart[id_col].eqNullSafe(gone["gone"]), "left_anti")
    if not single:
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.join(twice, again, "left_semi").select(row, F.monotonically_increasing_id().alias("number"))
    held = settled(held)
    numbers = held.select(F.col("number").alias("id"), F.col("row")[text_col].cast("string").alias("text"))
    place = _sketches(numbers, shingle).select(F.col("id").alias("number"), "node").join(named, "node", "left")
    place = held.select("number", F.col("row")[id_col].alias("id")).join(place, "number")
    first = place.where(F.col("node").isNotNull() & F.col("id").eqNullSafe(F.col("least")))
    first = first.groupBy("component").agg(F.min("number").alias("number")).select("number")
    stay = first.union(place.where("node IS NULL").select("number"))
    return left.union(held.join(stay, "number", "left_semi").select("row.*"))
