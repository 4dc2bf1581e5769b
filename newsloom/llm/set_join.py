"""Exact Jaccard self-join of documents as sets of word shingles, with skipping by set relations.

1. Each text becomes a set of hashes of five words. Texts with the same set are one class.
2. A class enters the index under the rarest quarter of its shingles (its prefix): sets with a
   similarity of ``PERCENT`` or more share one of these. The order follows a table of counts of fixed
   size, by parts of the hashes; it only steers the work, any order gives the same result.
3. Index lists are divided into blocks by set size. Sets that differ too much in size never meet, as
   their blocks are skipped.
4. In each list every class is paired with the first one only, its leader. Verified pairs join a class
   to the group of its leader. This is done in turns, with another order of classes each time and only
   over lists that still hold several components, so a group of near copies costs a few pairs per
   member.
5. For the rest, groups are compared by their leaders. Each member's answers follow from its leader's:
   a member shares at most as much with another set as its leader does, plus what it does not share
   with its leader. Pairs of groups that cannot reach the similarity are skipped as a whole, as are
   pairs of classes that are connected already. So are, before they are made, pairs of groups whose
   leaders' signatures differ in too many bits: a signature has the parities of a set's shingles by a hash,
   so that sets differ in as many shingles at least (a bitmap filter, which never skips a link).
6. The pairs of sets left over pass the positional bound on their shared prefix, are counted exactly,
   and components are formed over all links.

Lower case is A-Z only; words are runs of bytes other than ASCII white space. Null and empty texts have
no shingles, link with nothing and are their own component. A text of one to four words is one shingle.
Repeated rows are separate documents of one class. Rows without an id take part; a component without
any id is null. Sets are recognised by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.staging import small_batches, stage
from newsloom.llm.graph import connected_components
from newsloom.llm.text import free_names, mix, pieces, shingles, words

WIDTH = 5
PERCENT = 75
# The table that steers the order: counts from here on, and the logarithm of its size.
MIN_FREQUENT = 3
TABLE_BITS = 24
# Turns of pairing classes with leaders; the next one pays while one pair in ``FEW`` is a link.
TURNS = 12
FEW = 20
# A class is paired with a leader it meets under one in ``ENOUGH`` of its shingles.
ENOUGH = 20
# Bits of a set that say how far it is from another one at least, in words of 64.
SIGNATURE_WORDS = 4
SIGNATURE = tuple(f"bits_{k}" for k in range(SIGNATURE_WORDS))
FILTER_BITS = 1 << 24
BITMAP = 1 << 15
# Texts whose sets are made at once; a task needs about twenty times as much while it makes them.
PIECE_BYTES = 2 << 20


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, one after the other; offsets of the rows; set ids."""
    runs, bounds = shingles(*words(texts), width)
    parts = [np.unique(runs[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    out = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat, 21), dtype=np.uint64)))
        ids = mix(sums[out[1:]] - sums[out[:-1]] + counts.astype(np.uint64), 22)
    return flat, out, ids.view(np.int64)


def _signatures(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each set as parities of its shingles by a hash: sets differ in as many shingles at least as their
    signatures differ in bits."""
    place = mix(flat, 24) % np.uint64(64 * SIGNATURE_WORDS)
    bit = np.uint64(1) << (place & np.uint64(63))
    filled = np.flatnonzero(np.diff(bounds))
    out = []
    for k in range(SIGNATURE_WORDS):
        word = np.zeros(len(bounds) - 1, dtype=np.uint64)
        if len(filled):
            own = np.where(place >> np.uint64(6) == k, bit, np.uint64(0))
            word[filled] = np.bitwise_xor.reduceat(own, bounds[filled])
        out.append(word.view(np.int64))
    return out


def shingle_weights(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How frequent the shingles are that share the first ``TABLE_BITS`` bits of their hash.

    All shingles are counted, by the first 32 bits of their hashes; each task sends these sorted and
    packed, about two bytes each. The table keeps the logarithm of the largest count of a slot, 0 below
    ``MIN_FREQUENT``, and has a fixed size however many shingles there are.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(TABLE_BITS, max(8, (2 * partitions - 1).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            heads = np.sort((_sets(batch.column(1), width)[0] >> np.uint64(32)).astype(np.uint32))
            cuts = np.searchsorted(heads, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).tolist()
            parts = [heads[i:j] for i, j in zip(cuts, [*cuts[1:], len(heads)], strict=True)]
            ranges = [k for k, part in enumerate(parts) if len(part)]
            steps = [np.diff(parts[k], prepend=np.uint32(0)).tobytes() for k in ranges]
            packed = [len(x).to_bytes(4, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in steps]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(packed, pa.binary())], names=["range", "steps"])

    def count(blobs: pd.DataFrame) -> pd.DataFrame:
        steps = [pa.decompress(x[4:], int.from_bytes(x[:4], "little"), codec="zstd", asbytes=True) for x in blobs["steps"]]
        heads = np.concatenate([np.cumsum(np.frombuffer(x, np.uint32), dtype=np.uint32) for x in steps])
        found, n = np.unique(heads, return_counts=True)
        found, n = found[n >= MIN_FREQUENT], n[n >= MIN_FREQUENT]
        slots = np.zeros(1 << (TABLE_BITS - bits), dtype=np.uint8)
        first = int(blobs["range"].iloc[0]) << (TABLE_BITS - bits)
        np.maximum.at(slots, (found >> np.uint32(32 - TABLE_BITS)).astype(np.int64) - first, np.minimum(8 * np.log2(n), 255).astype(np.uint8))
        return pd.DataFrame({"range": blobs["range"].iloc[:1], "slots": [slots.tobytes()]})

    counted = (
        _texts(docs)
        .mapInArrow(pack, "range long, steps binary")
        .groupBy("range")
        .applyInPandas(count, "range long, slots binary")
        .collect()
    )
    table = np.zeros((1 << bits, 1 << (TABLE_BITS - bits)), dtype=np.uint8)
    for row in counted:
        table[row["range"]] = np.frombuffer(row["slots"], np.uint8)
    return table.reshape(-1)


def _document_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, set_id, n)`` of every document, and the signature of its set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            flat, bounds, ids = _sets(batch.column(1), width)
            columns = [batch.column(0), pa.array(ids), pa.array(np.diff(bounds)), *map(pa.array, _signatures(flat, bounds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "n", *SIGNATURE])

    return _texts(docs).mapInArrow(sets, "doc_id long, set_id long, n long, " + ", ".join(f"{name} long" for name in SIGNATURE))


def _postings(docs: DataFrame, weights: Broadcast, buckets: int, percent: int, width: int) -> DataFrame:
    """Packed postings by bucket: the prefixes of all sets, each set once per piece of the input."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in pieces(batches, 1, PIECE_BYTES):
            flat, bounds, ids = _sets(batch.column(1), width)
            sizes = np.diff(bounds)
            _, first = np.unique(ids, return_index=True)
            weight = table[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            kept, places, owners = [], [], []
            for row in np.sort(first[sizes[first] > 0]).tolist():
                own, n = slice(bounds[row], bounds[row + 1]), int(sizes[row])
                prefix = n - -(-percent * n // 100) + 1
                kept.append(flat[own][np.argsort(weight[own], kind="stable")[:prefix]])
                places.append(np.arange(1, prefix + 1))
                owners.append(np.full(prefix, row))
            if not kept:
                continue
            shingle, place, owner = (np.concatenate(x) for x in (kept, places, owners))
            bucket = (mix(shingle, 23) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            shingle, place, owner, bucket = (x[order] for x in (shingle, place, owner, bucket))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if high > low:
                    of, runs = np.unique(owner[low:high], return_counts=True)
                    packed = [shingle[low:high], place[low:high].astype("<u4"), ids[of], sizes[of], runs.astype("<u4")]
                    columns = [pa.array([x.tobytes()], pa.binary()) for x in packed]
                    yield pa.RecordBatch.from_arrays([pa.array([b]), *columns], names=["bucket", *PACKED])

    return _texts(docs).mapInArrow(index, "bucket long, " + ", ".join(f"{name} binary" for name in PACKED))


PACKED = ("shingles", "places", "owners", "sizes", "runs")


def _shared_postings(blobs: pd.DataFrame) -> pd.DataFrame:
    """Unpack the postings of a bucket and keep the lists that hold two classes or more."""
    kinds = {"shingles": np.uint64, "places": "<u4", "owners": np.int64, "sizes": np.int64, "runs": "<u4"}
    shingle, place, owner, size, runs = (
        np.concatenate([np.frombuffer(x, kinds[name]) for x in blobs[name]]) for name in PACKED
    )
    owner, size = np.repeat(owner, runs), np.repeat(size, runs)
    order = np.lexsort((owner, shingle))
    shingle, place, owner, size = (x[order] for x in (shingle, place, owner, size))
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, place, owner, size = (x[new] for x in (shingle, place, owner, size))
    same = np.zeros(len(shingle) + 1, dtype=bool)
    same[1:-1] = shingle[1:] == shingle[:-1]
    shared = same[1:] | same[:-1]
    return pd.DataFrame(
        {
            "shingle": shingle[shared].view(np.int64),
            "set_id": owner[shared],
            "n": size[shared],
            "place": place[shared].astype(np.int64),
        }
    )


def _block(n: Column | str, percent: int) -> Column:
    """Sets whose sizes fit each other are in the same block or in neighbouring ones."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of these sizes need."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _prefix_rest(n: Column, percent: int) -> Column:
    """How many shingles of a set of this size are outside its prefix."""
    return F.ceil(F.lit(percent) * n / F.lit(100.0) - 1e-9) - 1


class _Sets:
    """The sets of some classes, made from the texts when they are first asked for and then kept."""

    def __init__(self, docs: DataFrame, width: int, signatures: DataFrame):
        self.docs, self.width = docs, width
        self.signatures = signatures.dropDuplicates(["set_id"])
        self.parts: list[DataFrame] = []

    def fetch(self, wanted: DataFrame) -> None:
        """Make the sets of the classes of ``wanted(set_id)`` that are not kept yet.

        A bitmap of the wanted ids, of fixed size, keeps most other texts from being moved; the join
        then decides.
        """
        wanted = wanted.distinct()
        for part in self.parts:
            wanted = wanted.join(part, "set_id", "left_anti")
        wanted = stage(wanted, "wanted")
        maps = (
            wanted.select(F.col("set_id").bitwiseAND(FILTER_BITS - 1).alias("bit"))
            .groupBy(F.expr(f"bit div {BITMAP}").alias("bitmap"))
            .agg(F.expr(f"bitmap_construct_agg(bit % {BITMAP})").alias("bits"))
            .collect()
        )
        if not maps:
            return
        table = np.zeros((FILTER_BITS // BITMAP, BITMAP // 8), dtype=np.uint8)
        for row in maps:
            table[row["bitmap"]] = np.frombuffer(row["bits"], np.uint8)
        sent = self.docs.sparkSession.sparkContext.broadcast(table.reshape(-1))
        width = self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in pieces(batches, 1, PIECE_BYTES):
                flat, bounds, ids = _sets(batch.column(1), width)
                at = ids & (FILTER_BITS - 1)
                hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                _, first = np.unique(ids, return_index=True)
                rows = first[hit[first]]
                values = [flat[bounds[r] : bounds[r + 1]].view(np.int64) for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(values, pa.list_(pa.int64()))], names=["set_id", "members"]
                )

        found = _texts(self.docs).mapInArrow(sets, "set_id long, members array<long>")
        found = found.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.first("members").alias("members"))
        self.parts.append(stage(found, "sets"))

    def with_overlaps(self, pairs: DataFrame) -> DataFrame:
        """Add ``overlap``, the exact number of shared shingles, to ``pairs(a, b, ...)``."""
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("set_id")))
        if not self.parts:
            return pairs.withColumn("overlap", F.lit(0).cast("long"))
        known = self.parts[0]
        for part in self.parts[1:]:
            known = known.unionByName(part)
        first = known.select(F.col("set_id").alias("a"), F.col("members").alias("_a"))
        second = known.select(F.col("set_id").alias("b"), F.col("members").alias("_b"))
        joined = pairs.join(first, "a").join(second, "b")
        return joined.withColumn("overlap", F.size(F.array_intersect("_a", "_b")).cast("long")).drop("_a", "_b")


def _is_link(percent: int) -> Column:
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return F.lit(100) * F.col("overlap") >= F.lit(percent) * union


def _open_lists(lists: DataFrame, known: DataFrame | None) -> DataFrame:
    """Lists with the component of each class, without those that hold one component only."""
    if known is None:
        return lists.withColumn("component", F.col("set_id"))
    named = lists.join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    several = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(several.where("low < high").select("shingle"), "shingle", "left_semi")


def _leader_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """One likely pair per class: of the leaders that are not connected to it yet, the one it meets most
    often, if in enough lists. The first leader of a list is its most central class, the one that shares
    most of its prefix; later turns take others."""
    place = -F.col("central") if turn == 0 else F.xxhash64("set_id", F.lit(turn))
    leader = F.min(F.struct(place.alias("place"), F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of")))
    leaders = lists.groupBy("shingle", "block").agg(leader.alias("leader"))
    met = (
        lists.join(leaders, ["shingle", "block"])
        .where("leader.of <> component")
        .groupBy("set_id", "n", "leader.b", "leader.n_b")
        .agg(F.count("*").alias("shared"))
    )
    best = met.groupBy("set_id", "n").agg(F.max(F.struct("shared", "b", "n_b")).alias("best"))
    enough = F.col("best.shared") * ENOUGH >= F.col("n")
    return best.where(enough).select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "best.b", "best.n_b")


def _follow_leaders(lists: DataFrame, sets: _Sets, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of classes to leaders, in turns until few are found, and the components they form."""
    sets.fetch(lists.where(F.col("met") * ENOUGH >= F.col("n")).select("set_id"))
    fields = "a long, n_a long, b long, n_b long, overlap long"
    links, known = lists.sparkSession.createDataFrame([], fields), None
    for turn in range(TURNS):
        pairs = stage(_leader_pairs(_open_lists(lists, known), turn), "leader_pairs")
        found = stage(sets.with_overlaps(pairs).where(_is_link(percent)), "led")
        links = stage(links.unionByName(found), "led")
        tried, linked = pairs.count(), found.count()
        if linked:
            components = connected_components(links.select("a", "b"))
            known = stage(components.withColumnRenamed("node", "set_id"), "known")
        if linked * FEW <= tried:
            break
    return links, known


def _far_apart(percent: int) -> Column:
    """Whether the signatures of two groups' leaders differ in more bits than members that link allow.

    Sets that link differ in ``(n_a + n_b) (100 - percent) / (100 + percent)`` shingles at most, and each
    member differs from its leader in ``slack`` at most.
    """
    allowed = (F.col("high") + F.col("high_b")) * F.lit((100 - percent) / (100 + percent)) + F.col("slack") + F.col("slack_b")
    return _bits_apart("", "_b") > allowed + 1e-6


def _group_pairs(entries: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share an index list, in fitting blocks, and are not connected yet.

    Pairs whose signatures are too far apart are skipped before they are made. ``shared`` counts common
    entries, ``last_a`` and ``last_b`` are the last places of these.
    """
    once = entries.groupBy("shingle", "block", "group", "component").agg(F.max("place").alias("place"))
    once = stage(once.join(groups.select("group", "high", "slack", *SIGNATURE), "group"), "once")
    kept = ("component", "place", "high", "slack", *SIGNATURE)
    left = once.select("shingle", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("block").alias("own"), "group", *kept)
    right = once.select("shingle", "block", F.col("group").alias("group_b"), *[F.col(c).alias(f"{c}_b") for c in kept])
    met = left.join(right, ["shingle", "block"])
    met = met.where((F.col("own") < F.col("block")) | (F.col("group") < F.col("group_b")))
    met = met.where((F.col("component") != F.col("component_b")) & ~_far_apart(percent))
    first = F.col("group") < F.col("group_b")
    return met.groupBy(F.least("group", "group_b").alias("a"), F.greatest("group", "group_b").alias("b")).agg(
        F.count("*").alias("shared"),
        F.max(F.when(first, F.col("place")).otherwise(F.col("place_b"))).alias("last_a"),
        F.max(F.when(first, F.col("place_b")).otherwise(F.col("place"))).alias("last_b"),
    )


def link_classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, set_id, n)`` of every document, and links ``(a, b)`` between set ids that connect
    the same classes as all links together."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(docs, width))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = stage(_document_sets(docs, width), "document_sets")
    blobs = _postings(docs, weights, buckets, percent, width)
    fields = "shingle long, set_id long, n long, place long"
    shared = blobs.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared_postings, fields)
    shared = stage(shared.withColumn("block", _block("n", percent)), "shared")
    prefix = F.col("n") - _prefix_rest(F.col("n"), percent)
    central = shared.groupBy("set_id", "n").agg(F.count("*").alias("met"))
    central = central.select("set_id", "met", (F.col("met") / prefix).alias("central"))
    lists = stage(shared.join(central, "set_id"), "lists")

    known_sets = _Sets(docs, width, sets.where("n > 0").select("set_id", *SIGNATURE))
    led, known = _follow_leaders(lists, known_sets, percent)
    differ = F.col("n_a") + F.col("n_b") - 2 * F.col("overlap")
    nearest = F.min(F.struct((F.col("n_a") - F.col("overlap")).alias("apart"), "b", differ.alias("slack")))
    followers = led.groupBy(F.col("a").alias("set_id")).agg(nearest.alias("led"))
    followers = followers.select("set_id", F.col("led.b").alias("leader"), F.col("led.apart").alias("apart"), F.col("led.slack").alias("slack"))
    opened = stage(_open_lists(lists, known), "open_lists")
    classes = (
        opened.select("set_id", "n", "component")
        .distinct()
        .join(followers, "set_id", "left")
        .select(
            "set_id",
            "n",
            "component",
            F.coalesce("leader", "set_id").alias("group"),
            F.coalesce("apart", F.lit(0)).alias("apart"),
            F.coalesce("slack", F.lit(0)).alias("slack"),
        )
    )
    classes = stage(classes, "classes")
    leaders = classes.select("group").distinct()
    signatures = stage(known_sets.signatures.withColumnRenamed("set_id", "group").join(leaders, "group", "left_semi"), "signatures")
    entries = stage(opened.join(classes.select("set_id", "group"), "set_id"), "entries")
    later = _links_between_groups(entries, classes, signatures, known_sets, percent)
    return sets, led.select("a", "b").unionByName(later)


def _may_reach(shared: Column, n_a: Column, n_b: Column, last_a: Column, last_b: Column, percent: int) -> Column:
    """Whether two sets can reach the similarity, given what their prefixes share and where that ends."""
    rests = F.greatest(_prefix_rest(n_a, percent), _prefix_rest(n_b, percent))
    return shared + F.least(rests, n_a - last_a, n_b - last_b) >= _least_overlap(n_a, n_b, percent)


def _links_between_groups(entries: DataFrame, classes: DataFrame, signatures: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links between classes that the leaders have not connected."""
    groups = classes.groupBy("group").agg(
        F.count("*").alias("members"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max("apart").alias("apart"),
        F.max("slack").alias("slack"),
        F.min("set_id").alias("only"),
    )
    groups = stage(groups, "groups")
    pairs = _group_pairs(entries, groups.join(signatures, "group"), percent)
    for side in "ab":
        named = groups.select(F.col("group").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in groups.columns if c not in ("group", "slack")])
        pairs = pairs.join(named, side)
    single = (F.col("members_a") == 1) & (F.col("members_b") == 1)
    alone = _may_reach(F.col("shared"), F.col("low_a"), F.col("low_b"), F.col("last_a"), F.col("last_b"), percent)
    fit = (F.lit(100) * F.col("high_a") >= F.lit(percent) * F.col("low_b")) & (
        F.lit(100) * F.col("high_b") >= F.lit(percent) * F.col("low_a")
    )
    pairs = stage(pairs.where(fit & (~single | alone)), "group_pairs")
    between = pairs.where(single).select(
        F.col("only_a").alias("a"), F.col("only_b").alias("b"), F.col("low_a").alias("n_a"), F.col("low_b").alias("n_b")
    )
    # Pairs with larger groups: skipped as a whole if their leaders are too far apart.
    wide = pairs.where(~single).select("a", "b", "low_a", "low_b", "apart_a", "apart_b", "members_a", "members_b")
    reach = F.col("overlap") + F.col("apart_a") + F.col("apart_b")
    near = sets.with_overlaps(wide).where(reach >= _least_overlap(F.col("low_a"), F.col("low_b"), percent))
    swapped = F.col("members_a") > F.col("members_b")
    turned = F.when(swapped, F.struct(F.col("b").alias("few"), F.col("a").alias("many"))).otherwise(F.struct(F.col("a").alias("few"), F.col("b").alias("many")))
    near = stage(near.select(turned.alias("t")).select("t.few", "t.many"), "near_groups")
    inner = _pairs_of_members(near, classes, groups.join(signatures, "group"), sets, percent)
    possible = stage(between.unionByName(inner), "possible")
    return sets.with_overlaps(possible).where(_is_link(percent)).select("a", "b")


def _bits_apart(left: str, right: str) -> Column:
    """In how many bits the signatures of two sides of a row differ."""
    return sum((F.bit_count(F.col(f"{name}{left}").bitwiseXOR(F.col(f"{name}{right}"))) for name in SIGNATURE), F.lit(0))


def _pairs_of_members(near: DataFrame, classes: DataFrame, groups: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Pairs ``(a, b, n_a, n_b)`` of members of near groups ``(few, many)`` that may link.

    Each member of the smaller group is counted against the leader of the larger one. What it shares with
    the leader's members follows: as much at most, and what the member does not share with its leader.
    Only members of the larger group that can reach the similarity by this, and by signature, make a pair.
    """
    spread = (100 - percent) / (100 + percent)
    own = classes.select("set_id", "n", "component", "group", "apart")
    own = stage(own.join(sets.signatures, "set_id"), "members")
    members = own.select(F.col("group").alias("few"), F.col("set_id").alias("a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in SIGNATURE])
    leaders = groups.select(F.col("group").alias("many"), "low", "high", F.col("apart").alias("most_apart"), "slack", *[F.col(c).alias(f"{c}_l") for c in SIGNATURE])
    # Members differ from a set as much at least as their leader does, less their distance to it.
    within = _bits_apart("_a", "_l") <= (F.col("n_a") + F.col("high")) * F.lit(spread) + F.col("slack") + 1e-6
    fit = (F.lit(100) * F.col("n_a") >= F.lit(percent) * F.col("low")) & (F.lit(100) * F.col("high") >= F.lit(percent) * F.col("n_a"))
    asked = near.join(leaders, "many").join(members, "few").where(within & fit).withColumn("b", F.col("many"))
    counted = sets.with_overlaps(stage(asked.drop("few", *[f"{c}_l" for c in SIGNATURE]), "asked"))
    counted = counted.where(F.col("overlap") + F.col("most_apart") >= _least_overlap(F.col("n_a"), F.greatest("low", F.ceil(F.lit(percent) * F.col("n_a") / 100)), percent))
    counted = stage(counted.select("many", "a", "n_a", "overlap", *[f"{c}_a" for c in SIGNATURE]), "counted")
    others = own.select(F.col("group").alias("many"), F.col("set_id").alias("b"), F.col("n").alias("n_b"), "apart", *[F.col(c).alias(f"{c}_b") for c in SIGNATURE])
    reached = F.col("overlap") + F.col("apart") >= _least_overlap(F.col("n_a"), F.col("n_b"), percent)
    close = _bits_apart("_a", "_b") <= (F.col("n_a") + F.col("n_b")) * F.lit(spread) + 1e-6
    found = counted.join(others, "many").where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent) & reached & close)
    return found.select("a", "b", "n_a", "n_b")


def group_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, set_id)`` of every document."""
    return _grouped(docs, percent, width).drop("component")


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """What ``group_documents`` gives, and the ``component`` itself, which ids that repeat or are missing do not name."""
    with small_batches(docs.sparkSession):
        sets, links = link_classes(docs, percent, width)
    components = connected_components(links)
    of_class = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = of_class.join(components.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "set_id")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("set_id", "component_id", "component")
    found = sets.join(of_class, "set_id", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "set_id",
        "component",
    )


NO_ID = -(1 << 63)


def keep_one_per_group(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one row of each group of similar texts: the one with the smallest id,
    or a row without id where no row has one. Of rows equal in id those count whose set has the smallest
    hash, and of these the row with the smallest text, then the smallest other columns. Texts without
    words are no copies of each other and all stay."""
    own_id, own_set, row = free_names(docs.columns, "_id", "_set", "_row")

    @F.pandas_udf(T.LongType())
    def set_of(texts: pd.Series) -> pd.Series:
        out = [pd.Series([], dtype="Int64")]
        for piece in pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])], 0, PIECE_BYTES):
            _, bounds, ids = _sets(piece.column(0), width)
            # With a dtype that has nulls: as floats, ids would lose their last bits.
            out.append(pd.Series(ids, dtype="Int64").mask(np.diff(bounds) == 0))
        return pd.concat(out, ignore_index=True)

    text = F.coalesce("text", F.lit("")).cast("binary")
    named = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own_set, set_of(text))
    # Both kinds of rows, with and without words, are read from it.
    with small_batches(docs.sparkSession):
        named = stage(named, "named")
    last = F.lit((1 << 63) - 1)
    chosen = (
        _grouped(docs, percent, width)
        .where("n_shingles > 0")
        .groupBy("component")
        .agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "set_id")).alias("kept"))
        .select(F.when(F.col("kept.id") == last, F.lit(NO_ID)).otherwise(F.col("kept.id")).alias(own_id), F.col("kept.set_id").alias(own_set))
    )
    keys = [own_id, own_set]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(whole, F.struct(F.col("text"), F.to_json(whole)))
    kept = named.where(F.col(own_set).isNotNull()).join(stage(chosen, "kept"), keys, "left_semi").groupBy(*keys).agg(first.alias(row))
    rest = named.where(F.col(own_set).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]).unionByName(rest)
