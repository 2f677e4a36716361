"""Substring dedup by seed and extend.

Seeds: of the SEED-word sequences in each window of LENGTH words, the winnowing rule picks one (the
least hash; of equal ones the last), so that two equal windows pick the same seed at the same
place. Each window belongs to the seed it picks, which makes a seed's windows an interval.

Extend: a seed's reach is the word sequence that its windows cover, to both sides. Seeds with equal
reach match as a whole, so one grouping settles them: all but those of the smallest doc_id are
repeats. Where a seed occurs with several reaches, the match ends within them. There each reach,
once per distinct one, is extended word by word: its windows' hashes are grouped, and the smallest
doc_id owns them. No pair of documents is ever formed.

Maximal repeats: the windows found in a document are merged into its longest spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, gram_hasher, join_split, materialise, release, signed, text_chunks, text_key, workspace

LENGTH = 50
SEED = 10

SEED_SCHEMA = "doc_id long, tk long, seed long, reach long, lo int, n int"
WINDOW_SCHEMA = "doc_id long, tk long, seed long, win long, at int"
KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<first:int,end:int>>"
_SEED_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("seed", pa.int64()), ("reach", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])
_WINDOW_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("seed", pa.int64()), ("win", pa.int64()), ("at", pa.int32())])
_SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32())])
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN))])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def picked(word_hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each seed, place of the seed that the window starting at each word picks)."""
    n = len(word_hashes)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(n - seed + 1)
    seeds = gram_hasher(word_hashes)(starts, starts + seed)
    low = np.uint64(0xFFFFFFFF)
    ranked = (seeds & ~low) | (low - starts.astype(np.uint64))
    return seeds, (low - (sliding_least(ranked, length - seed + 1) & low)).astype(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, words in text_chunks(batch.column(2)):
            hashes = words.hashes()
            seeds, pick = picked(hashes, length, seed)
            if not len(pick):
                continue
            owner = words.owner()
            whole = owner[: len(pick)] == owner[length - 1 :]
            start = np.flatnonzero(whole)
            if not len(start):
                continue
            place = pick[start]
            head = np.ones(len(start), bool)
            head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(head)
            lo, n = start[first], np.diff(np.append(first, len(start)))
            text = owner[lo]
            reach = gram_hasher(hashes)(lo, lo + n - 1 + length)
            yield arrow_batch(_SEED_ARROW, [ids[row + text], keys[row + text], signed(seeds[place[first]]), signed(reach), (lo - words.first[text]).astype(np.int32), n.astype(np.int32)])


def seeds(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Every seed of every text with the interval of its windows: first window lo, n of them."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("tk"), "text")
    return rows.mapInArrow(lambda it: _seeds(it, length, seed), SEED_SCHEMA)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (first, end) joined where they touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)
    return np.stack([spans[head, 0], reach[last]], 1)


def _cut(text: str | None, spans: np.ndarray, texts: bool) -> tuple:
    words = (text or "").encode().split()  # of bytes: at exactly the six separators
    spans = _merged(spans) if len(spans) else spans
    kept = words
    if len(spans):
        kept, at = [], 0
        for first, end in spans.tolist():
            kept += words[at:first]
            at = end
        kept += words[at:]
    out = b" ".join(kept)
    return len(words), len(words) - len(kept), out.decode() if texts else None, hashlib.sha256(out).hexdigest(), [{"first": a, "end": b} for a, b in spans.tolist()]


_PASS_ARROW = pa.schema([*_KEPT_ARROW, ("tk", pa.int64()), ("text", pa.string()), ("todo", pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32()), ("own", pa.bool_())])))])
PASS_SCHEMA = KEPT_SCHEMA + ", tk long, text string, todo array<struct<lo:int,n:int,own:boolean>>"


def _first_pass(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Cuts the texts whose repeats are all known; passes on those with seeds still to extend."""
    for batch in batches:
        rows = []
        for doc_id, tk, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
            if todo and any(x["own"] for x in todo):
                rows.append((doc_id, None, None, None, None, None, tk, text, todo))
            else:
                spans = np.array([(x["lo"], x["lo"] + x["n"] - 1 + length) for x in todo or ()], np.int64).reshape(-1, 2)
                rows.append((doc_id, *_cut(text, spans, texts), tk, None, None))
        yield arrow_batch(_PASS_ARROW, [list(c) for c in zip(*rows)] if rows else [[] for _ in _PASS_ARROW])


def _windows(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The hash of each window of the seeds to extend."""
    for batch in batches:
        ids, keys, todos = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        for row, stop, words in text_chunks(batch.column(2)):
            hashes = words.hashes()
            seed_hashes, pick = picked(hashes, length, seed)
            owned = [(r, words.first[r - row] + x["lo"], x["n"]) for r in range(row, stop) for x in todos[r] if x["own"]]
            if not owned:
                continue
            n = np.array([x[2] for x in owned])
            start = np.repeat(np.array([x[1] for x in owned]) - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            text = np.repeat(np.array([x[0] for x in owned]), n)
            win = gram_hasher(hashes)(start, start + length)
            yield arrow_batch(_WINDOW_ARROW, [np.array(ids)[text], np.array(keys)[text], signed(seed_hashes[pick[start]]), signed(win), (start - words.first[text - row]).astype(np.int32)])


def _second_pass(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, todo, more in zip(*(c.to_pylist() for c in batch.columns)):
            spans = [(x["lo"], x["lo"] + x["n"] - 1 + length) for x in todo if not x["own"]] + [(at, at + length) for at in more or ()]
            rows.append((doc_id, *_cut(text, np.array(spans, np.int64).reshape(-1, 2), texts)))
        yield arrow_batch(_KEPT_ARROW, [list(c) for c in zip(*rows)] if rows else [[] for _ in _KEPT_ARROW])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256, spans of each row.

    Removed is each word in a window of ``length`` words whose word sequence also starts in a
    document with a smaller doc_id, judged on the input. Words are what stands between spaces and
    the control characters 9 to 13; kept joins the rest by one space (null unless ``texts``); spans
    are the maximal removed stretches of words. Null and empty texts have no words. Rows that share
    a doc_id are the same document: they don't repeat each other. A row with a null doc_id keeps all
    and makes no other lose anything. Of equal seed hashes in a window the last is picked, which
    changes no result. A text is read whole, however long, by one task. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    path = workspace(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialise(seeds(docs, length, seed), f"{path}/seeds")
    classes = found.groupBy("seed", "reach").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times"))
    classes = materialise(classes, f"{path}/classes")
    several = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("reaches")).filter(F.col("reaches") > 1)
    several = materialise(several, f"{path}/several")
    release(spark)
    open_classes = join_split(classes, several, ["seed"], "reaches", classes.count()).select("seed", "reach", "first", "times", F.lit(True).alias("open"))
    closed = classes.filter(F.col("times") > 1).join(several, "seed", "left_anti").select("seed", "reach", "first", "times", F.lit(False).alias("open"))
    settled = materialise(open_classes.unionByName(closed), f"{path}/settled")
    todo = (
        join_split(found, settled, ["seed", "reach"], "times", found.count())
        .filter(F.col("open") | (F.col("first") < F.col("doc_id")))
        .groupBy("doc_id", "tk")
        .agg(F.collect_list(F.struct("lo", "n", (F.col("first") == F.col("doc_id")).alias("own"))).alias("todo"))
    )
    todo = materialise(todo, f"{path}/todo")
    release(spark)
    rows = docs.withColumn("tk", text_key(F.col("text")))
    # null doc_ids lose nothing, so they need no join
    rows = rows.filter(F.col("doc_id").isNotNull()).join(todo, ["doc_id", "tk"], "left").unionByName(rows.filter(F.col("doc_id").isNull()), allowMissingColumns=True).select("doc_id", "tk", "text", "todo")
    passed = materialise(rows.mapInArrow(lambda it: _first_pass(it, length, texts), PASS_SCHEMA), f"{path}/passed")
    release(spark)
    done = passed.filter(F.col("n_words").isNotNull()).drop("tk", "text", "todo")
    pending = passed.filter(F.col("n_words").isNull()).select("doc_id", "tk", "text", "todo")
    windows = materialise(pending.mapInArrow(lambda it: _windows(it, length, seed), WINDOW_SCHEMA), f"{path}/windows")
    owners = windows.groupBy("seed", "win").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
    owners = materialise(owners, f"{path}/owners")
    more = (
        join_split(windows, owners, ["seed", "win"], "times", windows.count())
        .filter(F.col("first") < F.col("doc_id"))
        .groupBy("doc_id", "tk")
        .agg(F.collect_set("at").alias("more"))
    )
    last = pending.join(more, ["doc_id", "tk"], "left").select("doc_id", "text", "todo", "more").mapInArrow(lambda it: _second_pass(it, length, texts), KEPT_SCHEMA)
    return done.unionByName(last)
