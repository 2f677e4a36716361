"""Near-duplicate documents by MinHash with tensored banding.

Two collections of M hashes each, every one made of ROWS minima, give M * M table keys (u_i, v_j):
2 * M * ROWS minima are computed instead of M * M * 2 * ROWS. A pair of similarity s shares a key
with chance (1 - (1 - s**ROWS)**M)**2; at 0.8 and the defaults that is 0.9999.

The keys are never formed for all documents: a document can share (u_i, v_j) with another only if it
shares u_i and shares v_j, so single hashes are counted first, and only shared ones are combined.

Texts with equal shingle sets are one node. No pairs within a group are listed: in each round every
group names one center, and its members in other components are compared with it on their full
sets; links join components. What is still apart after the rounds is grouped anew by rare shingles,
exactly (see prefix_keys), and compared with centers and then across components, a bounded number
of members at a time, so that no link between two texts of one table key is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _constants, arrow_batch, gram_hasher, join_split, materialise, mix, release, signed, text_chunks, text_key, workspace

SHINGLE = 5
PERCENT = 80
M = 14
ROWS = 3
ROUNDS = 1
#: Rows of a group that all its others are compared with in a turn, and turns with one center each for groups that are larger.
PIVOTS, CENTERS = 2048, 4
#: Keys of 8 or 16 bytes that are broadcast, by count; more of them are shuffled.
BROADCAST_KEYS = 1_000_000

SIGNED_SCHEMA = "doc_id long, tk long, n_shingles long, s1 long, s2 long, u array<long>, v array<long>"
_LONGS = pa.list_(pa.int64())
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("u", _LONGS), ("v", _LONGS)])
SET_SCHEMA = "node long, shingles array<long>"
_SET_ARROW = pa.schema([("node", pa.int64()), ("shingles", _LONGS)])


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) of every text, A-Z lower-cased."""
    for row, stop, words in text_chunks(column, lower=True):
        hashes = words.hashes()
        gram = gram_hasher(hashes)
        starts = np.arange(max(0, len(hashes) - k + 1))
        grams = gram(starts, starts + k)
        for r in range(row, stop):
            a, b = words.first[r - row], words.first[r - row + 1]
            if b - a >= k:
                yield r, np.unique(grams[a : b - k + 1])
            else:
                yield r, gram(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(flips), ~np.uint64(0))
    for at in range(0, len(shingles), 1 << 14):  # bounds memory for very long texts
        part = shingles[at : at + (1 << 14)]
        np.minimum(out, ((part[None, :] ^ flips[:, None]) * factors[:, None]).min(1), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch], k: int, m: int, rows: int) -> Iterator[pa.RecordBatch]:
    flips, factors = _constants(20_031, 2 * m * rows), _constants(20_032, 2 * m * rows) | np.uint64(1)
    for batch in batches:
        out = []
        for _, shingles in shingle_sets(batch.column(2), k):
            if not len(shingles):
                out.append((0, 0, 0, [], []))
                continue
            least = mix(minima(shingles, flips, factors)).reshape(2 * m, rows)
            bands = np.zeros(2 * m, np.uint64)
            for j in range(rows):
                bands = mix(bands * np.uint64(3) + least[:, j])
            s1, s2 = mix(shingles).sum(dtype=np.uint64), mix(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
            bands = signed(bands).tolist()
            out.append((len(shingles), int(s1.view(np.int64)), int(s2.view(np.int64)), bands[:m], bands[m:]))
        columns = [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]
        yield arrow_batch(_SIGNED_ARROW, [batch.column(0), batch.column(1), *columns])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [signed(s) for _, s in shingle_sets(batch.column(1), k)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield arrow_batch(_SET_ARROW, [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))])


def signed_documents(docs: DataFrame, k: int = SHINGLE, m: int = M, rows: int = ROWS) -> DataFrame:
    """doc_id, tk, set size, a 128-bit hash of the set, and the two collections u and v, of each row."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    return cols.mapInArrow(lambda it: _sign(it, k, m, rows), SIGNED_SCHEMA)


def table_keys(nodes: DataFrame, path: str) -> DataFrame:
    """key, node, n for each table key that two nodes or more share. ``nodes`` has node, n, u, v."""

    def single(side: str) -> DataFrame:
        return nodes.select("node", F.lit(side).alias("side"), F.posexplode(side).alias("i", "h"))

    singles = single("u").unionByName(single("v"))
    counts = singles.groupBy("side", "i", "h").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
    counts = materialise(counts, f"{path}/singles")
    total = counts.agg(F.sum("times")).first()[0] or 0
    shared = join_split(singles, counts, ["side", "i", "h"], "times", total, grows=True).groupBy("node").pivot("side", ["u", "v"]).agg(F.collect_list(F.struct("i", "h")))
    shared = shared.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    # (u_i, v_j) for the shared ones of each side: at most M * M keys a node
    keyed = shared.select("node", F.explode("u").alias("a"), "v").select("node", "a", F.explode("v").alias("b"))
    keyed = keyed.select(F.xxhash64("a.i", "b.i", "a.h", "b.h").alias("key"), "node").join(nodes.select("node", "n"), "node")
    keyed = materialise(keyed, f"{path}/keyed")
    # keys with the same members say the same; one of them is enough
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("low"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("who")).filter(F.col("times") > 1)
    groups = groups.groupBy("times", "low", "who").agg(F.min("key").alias("key")).select("key", "times")
    groups = materialise(groups, f"{path}/groups")
    return materialise(join_split(keyed, groups, ["key"], "times", keyed.count(), grows=True).select("key", "node", "n"), f"{path}/members")


def similar(pairs: DataFrame, total: int, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, ok: whether 100 * intersection >= percent * union of the full sets of x and y.

    ``pairs`` has each of ``total`` pairs (a, b) once, with x and y as its ends in any order. A y of
    many pairs is dealt over several tasks, its set going to each; the keys for that are fewer than 1000.
    """
    if 2 * total <= BROADCAST_KEYS:  # few pairs: only the sets they need are shuffled
        needed = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        sets = sets.join(F.broadcast(needed), "node", "left_semi")
    share = max(100, total // 1000)
    busy = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > share)
    busy = F.broadcast(busy.select("y", F.ceil(F.col("times") / share).cast("long").alias("parts")))

    def dealt(rows: DataFrame, part) -> DataFrame:
        return rows.join(busy, "y", "left").withColumn("part", part(F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")

    left = dealt(pairs, lambda n: F.pmod(F.xxhash64("x"), n)).join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
    right = dealt(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    both = F.size(F.array_intersect("sx", "sy")).cast("long")
    judged = left.join(right, ["y", "part"]).withColumn("both", both)
    return judged.select("a", "b", (100 * F.col("both") >= percent * (F.size("sx") + F.size("sy") - F.col("both"))).alias("ok"))


def _can(na: Column, nb: Column, percent: int) -> Column:
    """The smaller set has to have percent of the larger one's size."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def components(edges: DataFrame, path: str) -> DataFrame:
    """node, comp: the smallest node that each end of the ``edges`` (a, b) reaches.

    Each node takes the least label around it, then its label's label, until nothing changes.
    A node with many edges is joined by broadcast (see join_split).
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, f"{path}/both")
    total = both.count()
    labels = materialise(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.least("a", F.min("b")).alias("comp")), f"{path}/labels-0")
    step, nodes = 0, labels.count()
    while True:
        step += 1
        near = join_split(both, labels, ["a"], "degree", total).groupBy("b").agg(F.min("comp").alias("least"))
        joined = labels.join(near, labels.a == near.b).select("a", "degree", "comp", F.least("comp", "least").alias("next"))
        up = labels.select(F.col("a").alias("next"), F.col("comp").alias("up"))
        joined = materialise(joined, f"{path}/least-{step}")
        # a label that many nodes have is one node
        named = up.join(joined.groupBy("next").agg(F.count(F.lit(1)).alias("having")), "next")
        moved = join_split(joined, named, ["next"], "having", nodes).select("a", "degree", F.least("next", "up").alias("comp"), (F.col("comp") != F.least("next", "up")).alias("moved"))
        moved = materialise(moved, f"{path}/labels-{step}")
        labels = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return labels.select(F.col("a").alias("node"), "comp")


def prefix_keys(nodes: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """key, node, n, place: groups in which any two of ``nodes`` that are similar enough meet.

    In one order of all shingles, two sets of the wanted similarity share one of the first
    n - ceil(percent * n / 100) + 1 of each. The order is by rising document frequency, so what many
    texts share comes last, and a passage common to thousands of different texts makes no group.
    Shingles of one document come first of all; they have places, but can't be shared.
    """
    own = sets.join(nodes.select("node").distinct(), "node", "left_semi")
    tokens = own.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    common = materialise(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1), f"{path}/frequencies")
    total = common.agg(F.sum("df")).first()[0] or 0
    listed = join_split(tokens, common, ["key"], "df", total).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ks"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    alone = F.col("n") - F.size("ks")
    rows = listed.select("node", F.col("n").cast("long").alias("n"), alone.alias("alone"), F.posexplode(F.slice("ks", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))).alias("i", "k"))
    return materialise(rows.select("k.key", "node", "n", (F.col("alone") + F.col("i")).alias("place")), f"{path}/prefixes")


class _Links:
    """The components as they stand, and the pairs that were found not to be linked."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int, path: str):
        self.sets, self.percent, self.path, self.turn, self.total, self.largest = sets, percent, path, 0, 0, 0
        self.comps = materialise(nodes.select("node").distinct().select("node", F.col("node").alias("comp")), f"{path}/comps-start")
        self.tested = nodes.sparkSession.createDataFrame([], "a long, b long")

    def apart(self, members: DataFrame) -> DataFrame | None:
        """The members (key, node, n, maybe place) of groups in several components, with comp, times and a center.

        ``largest`` is then the number of rows of the largest group, and ``total`` that of all.
        """
        self.turn += 1
        # a node is in a bounded number of groups: M * M, or as many as a prefix is long
        known = materialise(members.join(self.comps, "node"), f"{self.path}/known-{self.turn}")
        order = F.col("node") if self.turn == 1 else F.xxhash64(F.lit(self.turn), "node")
        groups = known.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by(F.struct("node", "n", "comp"), order).alias("center"))
        groups = materialise(groups.filter(F.col("c0") != F.col("c1")).select("key", "times", "center"), f"{self.path}/groups-{self.turn}")
        self.total, self.largest = (x or 0 for x in groups.agg(F.sum("times"), F.max("times")).first())
        return materialise(join_split(known, groups, ["key"], "times", self.total), f"{self.path}/apart-{self.turn}") if self.total else None

    def to_centers(self, apart: DataFrame) -> DataFrame:
        """One pair for each member that is not in its center's component."""
        other = (F.col("comp") != F.col("center.comp")) & _can(F.col("n"), F.col("center.n"), self.percent)
        return apart.filter(other).select(F.col("node").alias("x"), F.col("center.node").alias("y"))

    def _fits(self, mate: Column) -> Column:
        """Whether x and a mate are in different components, and their places (see prefix_keys) leave room for similarity.

        The overlap has to be percent / (100 + percent) of both sizes together. The smaller set of a
        pair so has a common shingle among fewer of its first ones still, and after the first common
        one, at places p and q, at most min(n - p, m - q) can be common.
        """
        percent, n, m, p, q = self.percent, F.col("n"), mate["m"], F.col("place"), mate["q"]
        small = (n < m) | ((n == m) & (F.col("x") < mate["y"]))
        least, at = F.when(small, n).otherwise(m), F.when(small, p).otherwise(q)
        early = at < least - F.ceil(F.lit(2 * percent) * least / (100 + percent)) + 1
        room = F.least(n - p, m - q) * (100 + percent) >= percent * (n + m)
        return (F.col("x") != mate["y"]) & (F.col("comp") != mate["other"]) & _can(n, m, percent) & early & room

    def across(self, apart: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(pairs to compare, rows still to be dealt with) of groups in several components.

        Groups of up to PIVOTS rows are compared within. Of larger ones about so many rows, the pivots,
        are compared with all others and then leave the group. Only pairs that fit become rows.
        """
        rows = apart.withColumnRenamed("node", "x").drop("center")
        mate = F.struct(F.col("x").alias("y"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("place").alias("q"))
        pivot = (F.col("times") <= PIVOTS) | (F.pmod(F.xxhash64(F.lit(self.turn), "key", "x"), F.col("times")) < PIVOTS)
        mates = rows.filter(pivot).groupBy("key", "times").agg(F.collect_list(mate).alias("mates"))
        met = join_split(rows.drop("times"), mates, ["key"], "times", self.total)
        pairs = met.select("x", F.explode(F.transform(F.filter("mates", self._fits), lambda m: m["y"])).alias("y"))
        return pairs, rows.filter(~pivot).select("key", F.col("x").alias("node"), "n", "place") if self.largest > PIVOTS else None

    def judge(self, pairs: DataFrame) -> None:
        """Compares full sets and joins the components of the similar."""
        path, comps = self.path, self.comps
        pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("y").alias("y")).join(self.tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs.withColumn("x", F.when(F.col("y") == F.col("a"), F.col("b")).otherwise(F.col("a"))), f"{path}/pairs-{self.turn}")
        total = pairs.count()
        if not total:
            return
        judged = materialise(similar(pairs, total, self.sets, self.percent), f"{path}/judged-{self.turn}")
        release(pairs.sparkSession)
        links = judged.filter("ok").select("a", "b")
        self.tested = self.tested.unionByName(judged.filter(~F.col("ok")).select("a", "b"))
        if not links.limit(1).count():
            return
        # links between components, by their current names
        named = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        renamed = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b"), f"{path}/cc-{self.turn}").withColumnRenamed("comp", "to").withColumnRenamed("node", "comp")
        self.comps = materialise(_renamed(comps, renamed).select("node", "comp"), f"{path}/comps-{self.turn}")


def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with comp replaced by ``to`` of names (comp, to) where it is named there."""
    weights = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("w")).join(names, "comp")
    moved = join_split(rows, weights, ["comp"], "w", rows.count()).drop("comp", "w").withColumnRenamed("to", "comp")
    return moved.unionByName(rows.join(names, "comp", "left_anti"))


def linked(members: DataFrame, sets: DataFrame, percent: int, rounds: int, path: str) -> DataFrame:
    """node, comp over the nodes of ``members`` (key, node, n); every link within a group is found.

    ``rounds`` comparisons with centers settle what is near. Of what is still apart, the groups are
    formed anew by prefix_keys(), which parts texts that only share passages, and compared with
    centers once more; then across components, turn by turn until no group has rows left.
    """
    state = _Links(members, sets, percent, path)
    for _ in range(rounds):
        apart = state.apart(members)
        if apart is None:
            return state.comps
        state.judge(state.to_centers(apart))
        members = apart.select("key", "node", "n")
    apart = state.apart(members)
    if apart is None:
        return state.comps
    members = prefix_keys(apart.select("node"), sets, percent, path)
    for _ in range(CENTERS):
        apart = state.apart(members)
        if apart is None:
            return state.comps
        state.judge(state.to_centers(apart))
        members = apart.select(*members.columns)
        if state.largest <= PIVOTS:
            break
    while members is not None and (apart := state.apart(members)) is not None:
        pairs, members = state.across(apart)
        state.judge(pairs)
    return state.comps


def _one_per_document(rows: DataFrame, path: str) -> DataFrame:
    """Joins the components of rows that share a doc_id with different texts; mostly there are none."""
    several = rows.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).filter("low < high")
    several = materialise(several.select("doc_id", "low"), f"{path}/several")
    if not several.limit(1).count():
        return rows
    edges = rows.join(several, "doc_id").select(F.col("component_id").alias("a"), F.col("low").alias("b")).filter("a <> b")
    names = components(edges, f"{path}/cc-rows").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return _renamed(rows.withColumnRenamed("component_id", "comp"), names).select("doc_id", "tk", "n_shingles", F.col("comp").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, m: int = M, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tk of each row.

    Two documents are linked where 100 * intersection >= percent * union of their sets of k-word
    shingles; a text of fewer words is one shingle; null and empty texts have none and are linked
    with nothing. component_id is the smallest doc_id reachable. Rows that share a doc_id are one
    document, linked if one of their texts is. A null doc_id is linked with nothing, has a null
    component_id and is kept. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = workspace(spark, "near")
    found = materialise(signed_documents(docs, k, m, rows), f"{path}/signed")
    full = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("times"), F.min_by(F.struct("u", "v", "tk"), "doc_id").alias("x"))
    same = materialise(same, f"{path}/same")
    members = table_keys(same.select("node", F.col("n_shingles").alias("n"), "x.u", "x.v"), path)
    release(spark)
    wanted = members.select("node").distinct().join(same.select("node", "x.tk"), "node").select(F.col("node").alias("doc_id"), "tk")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    wanted = materialise(wanted.distinct(), f"{path}/wanted")
    if wanted.count() <= BROADCAST_KEYS:  # so texts need not be shuffled
        wanted = F.broadcast(wanted)
    sets = texts.join(wanted, ["doc_id", "tk"], "left_semi").select("doc_id", "text").mapInArrow(lambda it: _sets(it, k), SET_SCHEMA)
    sets = materialise(sets, f"{path}/sets")
    release(spark)
    comps = linked(members, sets, percent, rounds, path)
    reps = same.join(comps, "node", "left").select("s1", "s2", "n_shingles", "times", F.coalesce("comp", "node").alias("component_id"))
    rows_of = join_split(full.select("doc_id", "tk", "s1", "s2", "n_shingles"), reps, ["s1", "s2", "n_shingles"], "times", full.count(), grows=True).select("doc_id", "tk", "n_shingles", "component_id")
    rows_of = _one_per_document(materialise(rows_of, f"{path}/rows"), path)
    rest = found.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "tk", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows_of.unionByName(rest)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "tk")
