"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A coordinate is a pair of min-hashes, so two sets of Jaccard similarity J agree in it with probability J * J, and a
document is posted under each (coordinate, value).  A pair counts when it collides in at least ``matches`` of
``coordinates``; with 10 of 48 a pair at 0.8 is missed with probability below 1e-9.  A pair with 10 collisions must
collide within the 39 rarest coordinates of either document (prefix), and a document with fewer than 10 coordinates that
anything else shares is skipped before any list is merged.  Pairs are confirmed on the full shingle sets.

Copies do not multiply: documents with equal sets are one class; posting lists first tie their members to two hubs of
the list; after that only members outside a list's largest component are compared with the others, block against block
within tasks, so that pairs which are no links never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, cut, doc_bytes, small_batches, spread_join
from .components import components, extended

#: Words whose hashes a task keeps at most.
CACHE_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words are one shingle, none are none."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - size + 1 + k])
    return np.unique(out)


def _factors(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240817)
    return rng.integers(1, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coordinates, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each coordinate (two hash functions each) the least values over the shingles, mixed into an int32."""
    out = np.full(len(a), ~np.uint64(0), np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[at : at + 2048, None] * a + b).min(axis=0), out=out)
    pairs = _mix(out[0::2] ^ (out[1::2] * np.uint64(0x9E3779B97F4A7C15)))
    return (pairs >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): k1 and k2 name the set; an empty set has a null sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (a, b) = _WordHashes(), _factors(2 * coordinates)
        for batch in batches:
            n, k1, k2, sigs = [], [], [], []
            for data in batch.column(1):
                s = shingle_set(data.as_py(), width, hashes)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                sigs.append(signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sets(docs: DataFrame, wanted: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(id, items) for the documents whose id is wanted: the full shingle set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            items = [shingle_set(x.as_py(), width, hashes).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["id", "items"])

    wanted, n = scratch.counted("wanted", wanted)
    if n <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return doc_bytes(docs).join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "data").mapInArrow(run, "id long, items binary")


def _confirm(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), n of them, with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate((s, t))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return spread_join(pairs, right, ["b"], ["a"], n).join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _colliding(pairs: DataFrame, n: int, reps: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b, hits) of the n pairs that collide often enough and whose set sizes allow the similarity."""
    one = lambda end: reps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"s_{end}"))
    near = spread_join(pairs, one("b"), ["b"], ["a"], n).join(one("a"), "a").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    hits = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda same: same))
    return near.select("a", "b", hits.alias("hits")).where(F.col("hits") >= matches)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs outside ASCII white space with A-Z lower-cased.  component_id is the least doc_id linked through
    pairs with Jaccard similarity of at least ``percent`` / 100; kept says that it is the document's own.  Null and
    empty texts have no shingles and stand alone; repeated rows give repeated results; an empty table an empty one.  Rows
    that share a doc_id but not their text count as linked.
    """
    scratch = Scratch(docs.sparkSession)
    signed = cut(signatures(docs, width, coordinates))
    reps = cut(signed.where("n_shingles > 0").groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    n_reps = reps.count()
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = reps.select("id", F.posexplode("sig").alias("at", "value")).select("id", token.alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = Window.partitionBy("id")
    ranked = (
        spread_join(posted, shared, ["token"], ["id"], coordinates * n_reps)
        .withColumn("found", F.count("*").over(by_doc))
        .where(F.col("found") >= matches)
        .withColumn("rank", F.row_number().over(by_doc.orderBy("df", "token")))
        .withColumn("centre", F.sum("df").over(by_doc))
        # coordinates that nothing shares are the rarest and take their places in the prefix first
        .where(F.col("rank") <= F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.col("found")))
    )
    lists, n_lists = scratch.counted("lists", ranked.select("token", "id", "centre"))
    hubs = lists.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max(F.struct("centre", (-F.col("id")).alias("id"))).alias("top")).where("n > 1")
    hubs = scratch.table("hubs", hubs)
    hubs_of = hubs.select("token", (-F.col("top.id")).alias("hub"))
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array("low", -F.col("top.id")))).alias("hub"))
    stars = spread_join(lists, hubs, ["token"], ["id"], n_lists).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    stars = scratch.table("stars", _colliding(*scratch.counted("pairs", stars.distinct()), reps, matches, percent))
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = scratch.table("sets", _sets(docs, ends(stars), width, scratch))
    best = stars.groupBy("a").agg(F.max(F.struct("hits", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    best, n_best = scratch.counted("best", best)
    found = scratch.table("found", components(_confirm(best, n_best, sets, percent)))
    tried = stars.select("a", "b").join(best, ["a", "b"], "left_anti")
    found = extended(found, _confirm(*scratch.counted("tried", _apart(tried, found)), sets, percent), scratch)
    signed_reps = reps.select("id", "n", "sig")
    members = spread_join(lists, hubs_of, ["token"], ["id"], n_lists).select("hub", "id").distinct()
    groups, n_groups = scratch.counted("groups", _mixed(members, found, reps, scratch))
    if n_groups:
        near = _block_links(groups.join(signed_reps, "id"), groups, n_groups, matches, percent, exact=False)
        # only members with a partner in a group go on to the full sets there
        members = near.select("hub", F.explode(F.array("a", "b")).alias("id")).distinct()
        groups, n_groups = scratch.counted("partners", _mixed(members, found, reps, scratch))
        full = scratch.table("full", _sets(docs, groups.select("id").distinct(), width, scratch))
        packed = groups.join(signed_reps, "id").join(full, "id")
        found = extended(found, _block_links(packed, groups, n_groups, matches, percent, exact=True).select("a", "b"), scratch)
    found = scratch.last(found, n_reps)
    classes = reps.join(found, "id", "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    out = signed.drop("sig").join(classes, ["k1", "k2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


#: Members of a hub's group in one block, and shingles of theirs.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000


def _mixed(members: DataFrame, found: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, id, c, apart, blocks): the groups of more than one component; apart says that c is not the group's largest."""
    placed = members.join(reps.select("id", "n"), "id").join(found, "id", "left")
    placed, n = scratch.counted("placed", placed.select("hub", "id", F.coalesce("component", "id").alias("c"), "n"))
    counts = placed.groupBy("hub", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    largest = counts.groupBy("hub").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "c")).alias("top")).where("parts > 1")
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int")
    largest = largest.select("hub", F.col("top.c").alias("most"), blocks.alias("blocks"))
    return spread_join(placed, largest, ["hub"], ["id"], n).select("hub", "id", "c", (F.col("c") != F.col("most")).alias("apart"), "blocks")


def _block_links(members: DataFrame, groups: DataFrame, n_groups: int, matches: int, percent: int, exact: bool) -> DataFrame:
    """(hub, a, b) for the members of groups (``n_groups`` rows) in different components that collide often enough; ``exact``: that are linked.

    Members are dealt over blocks by a hash.  Each block meets every block of those that stand apart, in a row of block
    numbers; without ``exact`` one pair for each member says that it has a partner.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    items = F.col("items") if exact else F.lit(None).cast("binary").alias("items")
    rows = members.select("hub", "id", "c", "n", "sig", items, "apart", "blocks", block.alias("own"))
    left = rows.where("apart").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(True).alias("left"), "id", "c", "n", "sig", "items")
    theirs, sizes = groups.where("apart").select("hub", block.alias("x")).distinct(), groups.groupBy("hub").agg(F.count("*").alias("n"))
    right = spread_join(rows, theirs, ["hub"], ["id"], n_groups, sizes=sizes).select("hub", "x", F.col("own").alias("y"), F.lit(False).alias("left"), "id", "c", "n", "sig", "items")

    def meet(own: list, other: list) -> tuple[list, list]:
        if not own or not other:
            return [], []
        (i, c, n, s, t), (j, d, m, u, v) = zip(*own, strict=True), zip(*other, strict=True)
        i, c, n, j, d, m = (np.array(k, np.int64) for k in (i, c, n, j, d, m))
        s, u = np.array(s, np.int32), np.array(u, np.int32)
        hits = np.zeros((len(i), len(j)), np.int16)
        for k in range(s.shape[1]):
            hits += s[:, k, None] == u[None, :, k]
        ok = (hits >= matches) & (c[:, None] != d) & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m))
        if not exact:
            rows_, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            return [*i[rows_], *i[ok[:, columns].argmax(axis=0)]], [*j[ok[rows_].argmax(axis=1)], *j[columns]]
        sets = [np.frombuffer(x, np.uint64) for x in v]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        out_a, out_b = [], []
        for k in np.flatnonzero(ok.any(axis=1)):
            x = np.frombuffer(t[k], np.uint64)
            where = np.minimum(np.searchsorted(known, x), len(known) - 1)
            has = np.zeros(len(known), bool)
            has[where[known[where] == x]] = True
            common = np.bincount(owner[has[at]], minlength=len(sets))
            linked = np.flatnonzero(ok[k] & (100 * common >= percent * (n[k] + m - common)))
            out_a += [i[k]] * len(linked)
            out_b += list(j[linked])
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, other = None, [], []

        def done() -> pa.RecordBatch:
            a, b = meet(own, other)
            hub = [key[0]] * len(a) if key else []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hub, a, b)], names=["hub", "a", "b"])

        for batch in batches:
            for hub, x, y, is_left, *row in zip(*(k.to_pylist() for k in batch.columns), strict=True):
                if (hub, x, y) != key:
                    yield done()
                    key, own, other = (hub, x, y), [], []
                (own if is_left else other).append(row)
        yield done()

    dealt = left.unionByName(right).repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return dealt.select("hub", "x", "y", "left", "id", "c", "n", "sig", "items").mapInArrow(run, "hub long, a long, b long")
