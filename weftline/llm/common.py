"""Helpers that every corpus operator uses: shared folders, whole-text word hashing, packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.scratch import delete_path, materialise, shared_root, workspace

__all__ = ["delete_path", "materialise", "shared_root", "workspace"]

# The word separators of every contract: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1 << 21


def text_key(col):
    """Tells rows apart that repeat a doc_id with another text; null and empty differ."""
    return F.coalesce(F.xxhash64(col), F.lit(0).cast("long"))


# --------------------------------------------------------------------------- 64-bit hashing
def _constants(seed: int, n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


_PAIR, _SPAN = (np.uint64(int(x) | 1) for x in _constants(20_012, 2))
_CHAIN_A, _CHAIN_B, _STEP_B = _constants(20_013, 3)
#: Words under SHORT bytes are hashed as one number, those of LONG bytes or more by digest.
SHORT, LONG = 8, 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end].

    Words under SHORT bytes all differ in it, as bytes and length fit into the number. Those under LONG
    go 8 bytes at a time through two chains of mix(), which end as one number. Longer ones have the
    first 64 bits of a digest. Nothing in it is linear, so two words agree by chance alone.
    """
    size = end - start
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next 8 bytes, or as many as are left."""
        return lanes[at] & ~np.uint64(0) >> np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)

    out = np.zeros(len(size), np.uint64)
    short = np.flatnonzero(size < SHORT)
    out[short] = mix(lane(start[short], size[short]) | size[short].astype(np.uint64) << np.uint64(56))
    rest = np.flatnonzero((size >= SHORT) & (size < LONG))
    at, left = start[rest], size[rest]
    a, b = (mix(left.astype(np.uint64) ^ c) for c in (_CHAIN_A, _CHAIN_B))
    while len(rest):
        x = lane(at, left)
        a, b = mix(a ^ x), mix((b + x) * (_STEP_B | np.uint64(1)))
        at, left = at + 8, left - 8
        out[rest[left <= 0]] = mix(a * _SPAN + b)[left <= 0]
        more = left > 0
        rest, at, left, a, b = rest[more], at[more], left[more], a[more], b[more]
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of some whole texts, held as arrays.

    start, end: byte places of each word in ``data``; first: of each text, the number of its
    first word, and one more entry for the end; hash: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~_IS_SPACE[data]
        cut = np.zeros(n + 1, bool)  # a text begins at this byte
        cut[offsets] = True
        self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
        self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end)

    def owner(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)


def gram_hasher(hashes: np.ndarray):
    """A function (start, end) -> hash of the word sequence [start, end), given the words' hashes.

    Sequences of 1, 2, 4, ... words are hashed from two of half the length; any other is hashed from
    the longest such at its start and at its end, which overlap, and its length. Only the sequences
    of one length are held at a time.
    """

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, size = np.asarray(start), np.asarray(end) - start
        out = np.zeros(len(size), np.uint64)
        level, width, longest = hashes, 1, int(size.max(initial=0))
        while width <= longest:
            here = np.flatnonzero((size >= width) & (size < 2 * width))
            if len(here):
                s, n = start[here], size[here]
                out[here] = mix(mix(level[s] + n.astype(np.uint64)) * _SPAN + level[s + n - width])
            if 2 * width <= longest:
                level = mix(mix(level[:-width]) * _PAIR + level[width:])
            width *= 2
        return out

    return of


def text_chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their Words) over all rows; null counts as empty.

    The texts of a chunk have ``limit`` bytes together, or it holds one longer text.
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        yield row, stop, Words(LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row])
        row = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


# --------------------------------------------------------------------------- native building blocks
def let(value, body):
    """Evaluates ``value`` once and gives it to ``body``, inside one expression."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(col):
    """A string equal for two inputs exactly if they differ in the case of A-Z alone.

    Each UTF-8 byte becomes one Latin-1 character and lower() runs on that. It also turns the first
    byte of two-byte characters into one of longer characters, but how many following bytes there
    are still tells them apart, so nothing else becomes equal.
    """
    return F.lower(F.decode(F.encode(col, "UTF-8"), "ISO-8859-1"))


def join_split(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, parts: int = 1000, grows: bool = False) -> DataFrame:
    """Inner join in which no key of ``left`` gathers in one task.

    ``right`` has one row per key, and ``weight`` says how many rows of ``left`` have it, of
    ``total`` altogether. Keys with a share over 1/parts number fewer than ``parts``: they are
    broadcast under that bound. The rest is shuffled; where ``right`` ``grows`` with the corpus that is
    said to Spark, so that the plan is the same at every size.
    """
    at = max(1000, total // parts)
    heavy = F.broadcast(right.filter(F.col(weight) > at))
    light = right.filter(F.col(weight) <= at)
    light = light.hint("merge") if grows else light
    rest = left.join(heavy.select(*keys), keys, "left_anti")
    return left.join(heavy, keys).unionByName(rest.join(light, keys))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that have been materialised."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def keep_rows(docs: DataFrame, decided: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, tk) is in ``decided`` (left_semi) or not in it (left_anti).

    Whatever the columns of ``docs`` are called, they come back as they were; null doc_ids match.
    """
    named = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    keys = decided.select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"))
    same = rows[named["doc_id"]].cast("long").eqNullSafe(keys["__id"]) & (text_key(rows[named["text"]]) == keys["__tk"])
    return rows.join(keys, same, how).select(*[F.col(n).alias(c) for c, n in named.items()])
