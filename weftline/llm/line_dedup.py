"""Line dedup with levelled sorted runs of line hashes.

What has been seen is kept as sorted runs: tables of (h1, h2, n_docs), bucketed and sorted by the
line hash (h1, h2). A new batch is merge-joined to the runs without shuffling them, which tells its
new lines (anti-join) from known ones, and then adds a run of its own at level 0. When a level holds
``fanout`` runs they are merged into one run of the next level.

Batches come in falling order of doc_id. So a line that some run knows has a larger holder, and goes
if it is common; a line that no run knows keeps its largest holder in the batch. What is common by
the counts of the runs and the batch is decided with the batch. Lines that could still become common
wait, and are the only ones that are looked up again in the end. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, delete_path, join_split, let, materialise, text_key, workspace

MIN_POINTS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
HASH = ["h1", "h2"]


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, tk, pos, h1, h2, first for each line whose key has ``min_points`` code points or more.

    tk tells rows apart that repeat a doc_id; pos counts lines from 0; first is 1 at a key's first
    line in its text, else 0, so that its sum counts documents.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def entry(line, pos):
        return let(F.btrim(line, F.lit(SPACES)), lambda k: F.when(F.char_length(k) >= min_points, let(ascii_lower(k), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), pos.alias("pos")))))

    entries = F.sort_array(F.filter(F.transform(lines, entry), lambda e: e.isNotNull()))
    marked = let(
        entries,
        lambda es: F.transform(
            es,
            lambda e, i: F.struct(
                e["pos"].alias("pos"),
                e["h1"].alias("h1"),
                e["h2"].alias("h2"),
                F.when((i > 0) & (F.get(es, i - 1)["h1"] == e["h1"]) & (F.get(es, i - 1)["h2"] == e["h2"]), 0).otherwise(1).alias("first"),
            ),
        ),
    )
    return docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.inline(marked))


def key_counts(keys: DataFrame) -> DataFrame:
    """h1, h2, n_docs, n_lines, max_doc; summed in each task before the shuffle."""
    return keys.groupBy(*HASH).agg(F.sum("first").cast("long").alias("n_docs"), F.count(F.lit(1)).alias("n_lines"), F.max("doc_id").alias("max_doc"))


class LineRuns:
    """The runs of one collection, in tables whose files lie below ``path``."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"weft_run_{uuid.uuid4().hex[:16]}"
        rows = rows.select(*HASH, "n_docs").repartition(self.buckets, *HASH)
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash is in no run: a merge anti-join with each run in turn."""
        for run in self.runs():
            keys = keys.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with before: the number of documents that the runs count for each, 0 for new ones."""
        keys = keys.withColumn("before", F.lit(0).cast("long"))
        for run in self.runs():
            # a run has a row per hash; no union of runs, as a grouping above it would trust the buckets too far
            keys = keys.join(run.select(*HASH, F.col("n_docs").alias("more")).hint("merge"), HASH, "left").withColumn("before", F.col("before") + F.coalesce("more", F.lit(0))).drop("more")
        return keys

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's counts as a run."""
        self.levels[0].append(self._write(counts))
        self.compact()

    def clear(self) -> None:
        """Drops all runs, with their files."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]

    def compact(self, everything: bool = False) -> None:
        level = 0
        while level < len(self.levels):
            names = [n for ns in self.levels for n in ns] if everything else self.levels[level]
            if len(names) >= (2 if everything else self.fanout):
                merged = self._write(self._merged(names))
                for name in names:
                    self._drop(name)
                if everything:
                    self.levels = [[] for _ in self.levels] + [[merged]]
                    return
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """Merges sorted runs pairwise."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*HASH, F.col("n_docs").alias("n"))
            n_docs = F.coalesce(F.col("n_docs"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))
            rows = rows.join(other.hint("merge"), HASH, "full").select(*HASH, n_docs.alias("n_docs"))
        return rows

    def totals(self) -> DataFrame:
        """One row per line hash over all batches."""
        self.compact(everything=True)
        return self.runs()[0]


def novel_lines(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """doc_id, tk, pos of the lines of a batch that no earlier batch had; the batch joins the runs."""
    keys = materialise(line_keys(docs), f"{runs.path}/keys-{uuid.uuid4().hex[:12]}")
    out = materialise(runs.unseen(keys).select("doc_id", "tk", "pos"), f"{runs.path}/novel-{uuid.uuid4().hex[:12]}")
    runs.add(key_counts(keys))
    return out


def _ranges(keys: DataFrame, batches: int) -> list:
    """Conditions that deal the ``keys`` with a doc_id into batches of falling doc_id."""
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    out = []
    for upper, lower in zip([None, *cuts], [*cuts, None]):
        here = F.col("doc_id").isNotNull()
        here = here if upper is None else here & (F.col("doc_id") < upper)
        out.append(here if lower is None else here & (F.col("doc_id") >= lower))
    return out


def lost_lines(keys: DataFrame, runs: LineRuns, min_docs: int, batches: int, path: str) -> DataFrame:
    """doc_id, tk, pos of the lines of ``keys`` that go."""
    lost = None
    spot = ["doc_id", "tk", "pos"]
    for i, here in enumerate(_ranges(keys, batches)):
        batch = keys.filter(here)
        counts = materialise(key_counts(batch), f"{path}/counts-{i}")
        if not counts.limit(1).count():
            continue
        # a new line keeps its largest holder here; a known one has a larger holder in some run
        new = runs.unseen(counts).filter(F.col("n_lines") > 1).select(*HASH, "n_lines", F.col("n_docs").alias("so_far"), F.col("max_doc").alias("keeper"))
        known = runs.seen(counts).filter(F.col("before") > 0).select(*HASH, "n_lines", (F.col("before") + F.col("n_docs")).alias("so_far"), F.lit(None).cast("long").alias("keeper"))
        judged = materialise(new, f"{path}/new-{i}").unionByName(materialise(known, f"{path}/known-{i}"))
        total = judged.agg(F.sum("n_lines")).first()[0] or 0
        rows = join_split(batch.select(*spot, *HASH), judged, HASH, "n_lines", total, grows=True).filter(F.col("keeper").isNull() | (F.col("doc_id") < F.col("keeper")))
        rows = materialise(rows.select(*spot, *HASH, (F.col("so_far") >= min_docs).alias("common")), f"{path}/judged-{i}")
        lost = rows if lost is None else lost.unionByName(rows)
        runs.add(counts)
    runs.add(key_counts(keys.filter(F.col("doc_id").isNull())))  # they lose nothing, but count
    if lost is None:
        return keys.select(*spot).limit(0)
    waiting = lost.filter(~F.col("common")).select(*spot, *HASH)
    still = materialise(waiting.groupBy(*HASH).agg(F.count(F.lit(1)).alias("rows")), f"{path}/waiting")
    late = materialise(runs.seen(still).filter(F.col("before") >= min_docs).select(*HASH, "rows"), f"{path}/late")
    total = still.agg(F.sum("rows")).first()[0] or 0
    return lost.filter("common").select(*spot).unionByName(join_split(waiting, late, HASH, "rows", total).select(*spot))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept, kept_sha256 of each row.

    A line's key is the line without spaces around it and A-Z lower-cased. Keys of ``min_points``
    code points or more that ``min_docs`` documents hold go, but for the largest doc_id that holds
    them, which keeps all its lines of that key. A null or empty text is one empty line. Rows that
    share a doc_id count as documents of their own, and if it is the largest all of them keep the
    line; a null doc_id counts as a document but never loses a line. Texts are split whole, however
    long. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = workspace(spark, "lines")
    keys = materialise(line_keys(docs, min_points), f"{path}/keys")
    runs = LineRuns(spark, path)
    lost = lost_lines(keys, runs, min_docs, batches, path)
    lost = materialise(lost.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("lost")), f"{path}/lost")
    runs.clear()
    rows = docs.withColumn("tk", text_key(F.col("text")))
    # null doc_ids lose nothing, so they need no join; what is lost grows with the corpus
    rows = rows.filter(F.col("doc_id").isNotNull()).join(lost.hint("merge"), ["doc_id", "tk"], "left").unionByName(rows.filter(F.col("doc_id").isNull()), allowMissingColumns=True)
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def kept(ls, gone):
        # what stays between one lost line and the next
        first = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
        last = F.concat(gone, F.array(F.size(ls)))
        return F.array_join(F.flatten(F.zip_with(first, last, lambda a, b: F.slice(ls, a + 1, b - a))), "\n")

    whole = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), whole).otherwise(let(lines, lambda ls: kept(ls, F.col("lost")))).alias("kept"),
    ).withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))
