"""SimHash near-duplicates by meeting in the middle: variants of fingerprints within part of the radius collide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintarium.llm.common import forget, fresh, release, ship, text_of, written
from lintarium.llm.components import components

#: Radius; words of a shingle.
RADIUS, SHINGLE = 3, 3
#: Of near copies: words of a shingle, least Jaccard index, least and most bits of a sketch, and frequent shingles that all workers know.
SIMILAR_SHINGLE, SIMILARITY, SKETCH, SKETCH_MOST, FREQUENT = 5, 0.8, 512, 1 << 16, 100_000
#: Bits of the filter that says which texts a comparison wants.
WANTED = 1 << 24
_SEED = 42


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the shingles' XXH64; fewer words are one shingle, none gives zero."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, _SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], _SEED) for a, b in zip(starts, (ends - 1).tolist()[words - 1 :])], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(_id, _digest, fp) of every document: its text's MD5, and fp as a signed 64-bit number; null text counts as empty."""
    ship(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("_id"), F.md5(text).alias("_digest"), text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["_id", "_digest", "fp"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _digest string, fp bigint")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join exactly those within ``radius`` bits, directly or by steps.

    Every fingerprint emits its ball of radius 1, all 65 variants. That is half the radius, rounded down, and meets for
    pairs within 2 bits. Fingerprints at 3 bits have ones of different parity, so there one side must go 2 bits, half the
    radius rounded up, and it is the side with an odd number of ones. Of three bits two lie in the same half of the 64,
    so of the pairs of bits only the 992 inside a half are needed. Variants are shuffled; where some fingerprint is within
    1 bit of a variant, all others of the variant, which are within 2, are within the radius of it and are hung on the
    least such one. So each collision is a link without comparing pairs, a variant has at most some thousand distinct
    fingerprints around it, and the method is the same for crowds and for single texts. ``nodes`` holds distinct ``fp``.
    """
    if radius != 3:
        raise ValueError("the balls are made for a radius of 3")
    near = [0, *[1 << i for i in range(64)]]
    wide = [(1 << i) | (1 << j) for h in (0, 32) for i, j in combinations(range(h, h + 32), 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.lit([signed(x) for x in near + wide]).cast("array<bigint>")
    odd = F.bit_count("fp").bitwiseAND(F.lit(1)) == 1
    balls = nodes.select("fp", F.posexplode(F.when(odd, masks).otherwise(F.slice(masks, 1, len(near)))).alias("i", "mask"))
    # The number of the mask goes along instead of the fingerprint, which follows from it: rows are as small after a shuffle
    # into many partitions as into few.
    rows = balls.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("v"), F.col("i").cast("smallint").alias("i"))
    least = F.min(F.when(F.col("i") < len(near), F.col("v").bitwiseXOR(F.get(masks, F.col("i"))))).over(Window.partitionBy("v"))
    hung = rows.withColumn("u", least).where("u is not null").select("u", F.col("v").bitwiseXOR(F.get(masks, F.col("i"))).alias("v")).where("u <> v")
    return written(hung.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct(), "simhash-links")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _digest, fp) of every row, written, and (f, best) of every fingerprint, where ``best`` is the row that its component goes by.

    That is the row with the least id and, among rows that share it, the least digest of the text.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_digest").alias("digest")))
    nodes = written(prints.groupBy("fp").agg(least.alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"))
    # The balls that were shuffled are no longer needed.
    release(prints.sparkSession)
    groups = components(edges)
    placed = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-placed")
    roots = written(placed.groupBy("root").agg(F.min("least").alias("best")).withColumnRenamed("root", "r"), "simhash-roots")
    ids = written(placed.join(roots, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "best"), "simhash-ids")
    forget(nodes, edges, placed, roots)
    return prints, ids


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every document.

    A-Z is lower-cased; fingerprints of 3-word shingles link at 3 or fewer differing bits; component_id is the smallest
    id that is reachable. Null and empty texts have fingerprint zero, which links like any other. Repeated rows stay
    rows of one component; null ids are never the smallest. An empty table gives an empty result; other columns are
    ignored, whatever their names. Equal fingerprints are one node, so copies cost nothing after the first pass.
    """
    prints, ids = _grouped(docs, id_col, text_col)
    out = prints.join(ids, F.col("fp") == F.col("f"))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, with all its columns.

    A row is told from others by its id and its text: rows that share both stay or go together, of rows of one id with
    different texts in one group the text with the smallest digest stays, and rows without an id stay only where a whole
    group has none. Null texts count as empty. What goes is written first: where it is little, the planner sees its size
    and the texts are not moved. Columns of any name are kept; an empty table gives an empty result.
    """
    prints, ids = _grouped(docs, id_col, text_col)
    same = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_digest") == F.col("best.digest"))
    gone = prints.join(ids, F.col("fp") == F.col("f")).where(~same).select("_id", "_digest").distinct()
    gone_id, gone_digest = fresh(docs, "gone_id"), fresh(docs, "gone_digest")
    gone = written(gone.toDF(gone_id, gone_digest), "simhash-gone")
    forget(prints, ids)
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone_id]) & (F.md5(text_of(docs, text_col)) == gone[gone_digest]), "left_anti")


def shingles(text: str, words: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words are one shingle, no word is none."""
    parts = text.encode("utf-8", "replace").lower().split()
    line, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, _SEED)] if parts else [], np.uint64)
    starts = [0, *ends[:-1].tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], _SEED) for a, b in zip(starts, (ends - 1).tolist()[words - 1 :])], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def rare_first(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a sorted set of shingles in an order that all texts share: those that aren't ``frequent``, then the others by count.

    As many are taken as a set must have, so that any set with a Jaccard index of ``similarity`` or more has one of them
    among its own: of n shingles at least ``similarity`` times n are shared, so not all of the n - ceil(similarity * n) + 1
    first ones of both can be without a partner, in whatever order.
    """
    size = len(found)
    if size and len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.argsort(np.where(frequent[at] == found, counts[at], 0), kind="stable")]
    return found[: size - math.ceil(similarity * size - 1e-9) + 1]


def sketch(found: np.ndarray) -> np.ndarray:
    """Of each class of hashes one bit, the parity of its shingles: two sets differ in as many shingles as bits, or more.

    Classes are hashes modulo a power of two, at least ``SKETCH`` and as many as shingles up to ``SKETCH_MOST``, since with
    far fewer any two long sets differ in about half of the bits. The longer of two sketches is folded by ``differing``.
    """
    classes = min(SKETCH_MOST, max(SKETCH, 1 << max(len(found) - 1, 0).bit_length()))
    return np.packbits((np.bincount((found % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).astype(bool), bitorder="little").view("<i8")


def differing(one: str, two: str) -> Column:
    """Bits in which two sketches differ, of which one is at most twice as long; the halves of the longer are added first."""
    words = F.least(F.size(one), F.size(two))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = [F.when(F.size(x) > words, F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, words), xor)).otherwise(F.col(x)) for x in (one, two)]
    return F.aggregate(F.zip_with(*folded, xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted by shingle: the most frequent ones of (_text), at most ``FREQUENT``.

    They only order shingles, so nothing depends on the list being whole: shingles that occur once among some thousand
    texts that lie together aren't counted there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(found[times > 1].view(np.int64)), pa.array(times[times > 1].astype(np.int64))], names=["h", "times"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(shingles(t, words))
                size += len(held[-1])
                if size > 1 << 21:
                    yield repeated()
                    held, size = [], 0
        yield repeated()

    counted = rows.select("_text").mapInArrow(count, "h bigint, times bigint").groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= 8)
    top = written(counted.orderBy(F.desc("times"), "h").limit(FREQUENT), "similar-frequent")
    found = top.toArrow()
    forget(top)
    h, times = found.column("h").to_numpy().view(np.uint64), found.column("times").to_numpy()
    order = np.argsort(h)
    return h[order], times[order]


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, copies, best) of every text that has a near copy: its MD5, its rows, and the (id, digest) that its group goes by.

    Two texts are near copies when the Jaccard index of their sets of ``words``-word shingles is ``similarity`` or more;
    shingles are told apart by 64 bits. All links count, none is left out: texts of one set are one node, every node
    gives the first of its shingles, rare ones first (``rare_first``), and two nodes that are near copies share one of them.
    The first shingle that two sets share, where u + v - apart shared ones begin, stands so early in both that each size is
    within the other's ``reach`` there, and in the smaller set so early that its reach is not below its own size. Such a
    set leads: only those are hubs, and pairs of two that don't lead are never looked at, so texts that share a passage but
    for which it comes late cost nothing together. Each node is first compared with one partner, then with two hubs for each
    of its first shingles. At last all pairs that share one are made, but for those inside a group that is found already,
    which can't change it, and those that can't reach ``similarity``, which the join itself tells by reach, and then sizes
    and ``sketch``. What is left is compared in full. No shingle is left out because many have it.
    """
    ship(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("_id"), F.md5(text).alias("_digest"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    frequent, counts = _frequent(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = set(), np.zeros(0, np.int64)
        for b in batches:
            nodes, sizes, firsts, bits = [], [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t, words)
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                # Texts of one set are one node, so a task gives shingles and sketch of a set once.
                new = nodes[-1] not in seen
                firsts.append(rare_first(found, frequent, counts, similarity) if new and len(found) else none.view(np.uint64))
                bits.append(sketch(found) if new else none)
                if len(seen) < 1 << 20:
                    seen.add(nodes[-1])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([none, *(y.view(np.int64) for y in x)]))) for x in (firsts, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *lists], names=["_id", "_digest", "n", "size", "first", "bits"])

    prints = written(rows.mapInArrow(run, f"_id {kind}, _digest string, n bigint, size int, first array<bigint>, bits array<bigint>"), "similar")
    ratio = (1 + similarity) / similarity
    reach = F.floor((F.col("size") - F.col("pos")) * F.lit(ratio) - F.col("size") + 1e-6).cast("int")
    index = prints.select("n", "size", F.posexplode("first").alias("pos", "h")).select("h", "n", "size", reach.alias("reach"))
    # Of each shingle two hubs. Mixed with the shingle, numbers have another order for each, so a group has many hubs. The
    # index moves once: what its window needs of a shingle are numbers, and shingles of one set or without a leading one end here.
    bucket, mixed = Window.partitionBy("h"), F.when(F.col("reach") >= F.col("size"), F.col("n").bitwiseXOR(F.col("h")))
    shared = index.select("*", *[f(x).over(bucket).alias(y) for f, x, y in ((F.min, mixed, "low"), (F.max, mixed, "high"), (F.min, F.col("n"), "one"), (F.max, F.col("n"), "two"))])
    shared = shared.where("low is not null and one <> two").select("h", "n", "size", "reach", *[F.col(x).bitwiseXOR(F.col("h")).alias(x) for x in ("low", "high")])
    shared = written(shared.distinct(), "similar-shared")
    del index
    release(docs.sparkSession)
    some = shared.select(F.col("n").alias("w")).distinct()
    facts = written(prints.where(F.size("bits") > 0).join(some, F.col("n") == F.col("w"), "left_semi").select("n", "size", "bits").distinct(), "similar-facts")

    def apart(one: Column, two: Column) -> Column:
        """In how many shingles two sets of these sizes may differ."""
        return one + two - 2 * F.ceil((one + two) * F.lit(similarity / (1 + similarity)) - 1e-9)

    def likely(pairs: DataFrame) -> DataFrame:
        one, two = facts.toDF("un", "us", "ub"), facts.toDF("vn", "vs", "vb")
        both = pairs.join(one, F.col("u") == F.col("un")).join(two, F.col("v") == F.col("vn"))
        most = apart(F.col("us"), F.col("vs"))
        # Sizes first: sketches of sets that they let through are of one length, or one is twice as long.
        pairs = both.where(F.when(F.abs(F.col("us") - F.col("vs")) <= most, differing("ub", "vb") <= most).otherwise(F.lit(False)))
        return written(pairs.select("u", "v"), "similar-pairs")

    slot = F.pmod(F.xxhash64("_digest"), F.lit(WANTED))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(n, set) of the texts with these digests, of few others too. Texts stay where they are read; a filter of ``WANTED`` bits goes to them."""
        found = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
        marks = np.zeros(WANTED >> 6, np.int64)
        marks[found.column("w").to_numpy()] = found.column("b").to_numpy()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                s = b.column(0).to_numpy()
                some = b.filter(pa.array((marks[s >> 6] >> (s & 63)) & 1 == 1))
                sets = []
                for d, t in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    if d not in seen:
                        sets.append(shingles(t, words))
                        seen.add(d)
                n = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([x.tobytes() for x in sets], pa.binary())], names=["n", "set"])

        sets = rows.select(slot, "_digest", "_text").mapInArrow(cut, "n bigint, set binary")
        return written(sets.groupBy("n").agg(F.first("set").alias("set")), "similar-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3))
            alike = np.array([jaccard(x, y) >= similarity for x, y in zip(a, c)], bool)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(alike)) for k in (0, 1)], names=["u", "v"])

    def verified(pairs: DataFrame) -> DataFrame:
        # One text for each node that has a pair.
        ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
        wanted = written(prints.join(ends, F.col("n") == F.col("u")).groupBy("n").agg(F.min("_digest").alias("_digest")), "similar-wanted")
        sets = sets_of(wanted)
        both = pairs.join(sets.toDF("un", "us"), F.col("u") == F.col("un")).join(sets.toDF("vn", "vs"), F.col("v") == F.col("vn"))
        links = written(both.select("u", "v", "us", "vs").mapInArrow(compare, "u bigint, v bigint"), "similar-links")
        forget(wanted, sets)
        release(docs.sparkSession)
        return links

    hubs = shared.select("n", F.explode(F.array("low", "high")).alias("hub")).where("n <> hub").select(F.least("n", "hub").alias("u"), F.greatest("n", "hub").alias("v")).distinct()
    hubs = written(hubs, "similar-hubs")
    first = likely(hubs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    links_1 = verified(first)
    known = written(components(links_1), "similar-groups")
    one, two = known.toDF("un", "ur"), known.toDF("vn", "vr")
    second = hubs.join(one, F.col("u") == F.col("un"), "left").join(two, F.col("v") == F.col("vn"), "left")
    second = likely(second.where(F.coalesce("ur", "u") != F.coalesce("vr", "v")).select("u", "v"))
    links_2 = verified(second)
    forget(known)
    known = written(components(links_1.unionByName(links_2)), "similar-groups")
    placed = shared.join(known, F.col("n") == F.col("node"), "left").select("h", "n", "size", "reach", F.coalesce("root", "n").alias("root"))
    placed = written(placed, "similar-placed")
    # Groups that meet on a shingle are paired first, so pairs inside a group of any size are never made. One of the two has a
    # member that leads; where both have, the lower one stands on the left.
    crowds = placed.groupBy("h", "root").agg(F.min("size").alias("least"), F.max("reach").alias("most"), F.max(F.col("reach") >= F.col("size")).alias("leads"))
    crowds = written(crowds, "similar-crowds")
    left, right = crowds.where("leads").toDF("h", "ur", "ul", "um", "lead"), crowds.toDF("vh", "vr", "vl", "vm", "leads")
    within = (F.col("ul") <= F.col("vm")) & (F.col("vl") <= F.col("um"))
    once = F.when(F.col("leads"), F.col("ur") < F.col("vr")).otherwise(F.col("ur") != F.col("vr"))
    meet = written(left.join(right, (F.col("h") == F.col("vh")) & once & within).select("h", "ur", "vr", "vl", "vm"), "similar-meet")
    one, two = placed.toDF("uh", "u", "us", "um", "r"), placed.toDF("vh", "v", "vs", "vm", "q")
    within = (F.col("us") <= F.col("vm")) & (F.col("vl") <= F.col("um"))
    across = meet.join(one, (F.col("h") == F.col("uh")) & (F.col("ur") == F.col("r")) & within).select("h", "vr", "u", "us", "um")
    # On the first shingle that two sets share, all others that they share come after it in both.
    within = (F.col("us") <= F.col("vm")) & (F.col("vs") <= F.col("um"))
    across = across.join(two, (F.col("h") == F.col("vh")) & (F.col("vr") == F.col("q")) & within)
    rest = across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = likely(rest)
    links_3 = verified(rest)
    # Links between groups that were found and the groups themselves, as stars.
    stars = known.select(F.col("node").alias("u"), F.col("root").alias("v"))
    groups = written(components(stars.unionByName(links_3)), "similar-groups")

    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    texts = prints.groupBy("_digest").agg(least.alias("least"), F.min("n").alias("n"), F.count("*").alias("copies"))
    texts = texts.join(groups, F.col("n") == F.col("node"), "left").select(F.col("_digest").alias("digest"), "least", "copies", F.coalesce("root", "n").alias("root"))
    texts = written(texts, "similar-texts")
    many = texts.groupBy(F.col("root").alias("r")).count().where("count > 1").select("r")
    members = written(texts.join(many, F.col("root") == F.col("r"), "left_semi"), "similar-members")
    best = members.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("least", "digest")).alias("best"))
    out = members.join(best, F.col("root") == F.col("r")).select("digest", "copies", F.struct(F.col("best.least.id").alias("id"), F.col("best.digest").alias("digest")).alias("best"))
    out = written(out, "similar-out")
    forget(prints, shared, facts, hubs, first, links_1, second, links_2, known, placed, crowds, meet, rest, links_3, groups, texts, members)
    return out


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies by ``similar_groups`` the document with the smallest id, with all its columns.

    Equal texts belong together but only near copies go: of a text that has several rows and no near copy all stay. Of a
    group one text stays, in every row of its smallest id; a null id is never the smallest. Null texts count as empty;
    texts of fewer than ``words`` words are one shingle, so they are near copies only of texts with the same words.
    Columns of any name are kept; an empty table gives an empty result.
    """
    groups = similar_groups(docs, similarity, words, id_col, text_col)
    digest, stays = fresh(docs, "near_digest"), fresh(docs, "near_stays")
    # A text that stays does so in the rows of one id; for all others the digest is all that is needed, as 16 bytes. So that the
    # list is small where little goes, and the texts needn't be moved, a text that stays is listed only if it has other rows.
    groups = groups.where("best.digest <> digest or copies > 1").select(F.unhex("digest").alias(digest), F.when(F.col("best.digest") == F.col("digest"), F.struct(F.col("best.id").alias("id"))).alias(stays))
    groups = written(groups, "similar-gone")
    own = groups[stays].isNotNull() & docs[id_col].eqNullSafe(groups[stays]["id"])
    return docs.join(groups, (F.unhex(F.md5(text_of(docs, text_col))) == groups[digest]) & ~own, "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
