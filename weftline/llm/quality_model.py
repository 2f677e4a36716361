"""Quality classifier of supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, of its hashed pairs of
neighbouring words in their order, and of its hashed sequences of three to five characters, which
don't go beyond a word but mark where it begins and ends. A word that repeats the one before it is
read as one token, "again", so that what is learned of repetition holds for all words. PRIOR zero vectors join the average, so that
short texts stay near the bias. A softmax layer makes class chances of it. Vectors, layer and bias are
trained together by stochastic gradient descent in numpy, on the driver, over a sample of labelled
rows whose number and bytes are bounded by parameters. As softmax over two classes depends on the
difference of the two class weights alone, scoring needs one number per bucket: the vector's product
with that difference. That table has a fixed size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_batch, mix, text_chunks

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
AGAIN = np.uint64(0xA9A1_0000_0000_0001)
PRIOR = 50
EPOCHS = 5
RATE = 0.5
#: The bias moves slower: it is all that a text without features has.
BIAS_RATE = 0.01
SEED = 20_061
#: Labelled rows of each class that training takes at most, those with the least hash of doc_id.
SAMPLE_PER_CLASS = 3000
#: Bytes of all their texts together; of longer samples the rows with the least hash are taken.
SAMPLE_BYTES = 1 << 26
THRESHOLD = 0.3

SCORE_SCHEMA = "doc_id long, score double"
_SCORE_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Model:
    """weight of each bucket, and the bias, of the log-odds of class 1."""

    weight: np.ndarray
    bias: float

    def score(self, words: Words) -> np.ndarray:
        """The chance of class 1 for each text; a text without features gets that of the bias."""
        n = len(words.offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for buckets, text in features(words):
            total += np.bincount(text, self.weight[buckets], n)
            count += np.bincount(text, minlength=n)
        return 1 / (1 + np.exp(-(total / (count + PRIOR) + self.bias)))


def characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text of each), a space before each text and after the last; all white space is a space."""
    data = words.data
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    codes[(codes == 32) | ((codes >= 9) & (codes <= 13))] = 32
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[words.offsets]
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    n = len(places) - 1
    return np.insert(codes, places, 32), np.insert(owner, places, np.arange(n + 1))


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every word, word pair and character sequence; none spans two texts.

    A word equal to the one before it is the token AGAIN, whichever word it is.
    """
    size = np.uint64(BUCKETS)
    hashes, text = words.hashes(), words.owner()
    pair = text[1:] == text[:-1]
    hashes[1:][pair & (hashes[1:] == hashes[:-1])] = AGAIN
    yield (hashes % size).astype(np.int64), text
    yield (mix(hashes[:-1][pair] * np.uint64(3) + hashes[1:][pair]) % size).astype(np.int64), text[1:][pair]
    codes, owner = characters(words)
    if len(codes) < max(GRAMS):
        codes, owner = np.pad(codes, (0, max(GRAMS)), constant_values=32), np.pad(owner, (0, max(GRAMS)), mode="edge")
    space, code = codes == 32, mix(codes)
    inner = np.concatenate([[0], np.cumsum(space)])
    for n in range(2, max(GRAMS) + 1):
        code = mix(code[:-1] * np.uint64(3) + codes[n - 1 :])
        if n in GRAMS:
            m = len(code)
            # white space only at the ends, where it marks those of the word
            whole = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : m + 1])
            yield (code[whole] % size).astype(np.int64), owner[whole + 1]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, class) of the sample, and how many labelled doc_ids each class has.

    Held-out doc_ids and null labels don't count; a doc_id labelled twice has its lowest quality, and
    of rows that share a doc_id one is taken, that with the least hash of its text. A text that
    alone is over the bytes of its class is not trained on.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").agg(F.count(F.lit(1))).collect()}
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    chosen = None
    for quality in sorted(counts):
        part = known.filter(F.col("quality") == quality).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return [], counts
    # at most two classes of per_class doc_ids, so broadcast and driver hold a bounded number
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text"))
    each = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "size")).alias("x")).select("doc_id", "quality", "x.h", "x.size").collect()
    taken, room = [], dict.fromkeys(counts, most_bytes // 2)
    for r in sorted(each, key=lambda r: (mixed_id(r.doc_id), r.doc_id)):
        if r["size"] <= room[r.quality]:
            room[r.quality] -= r["size"]
            taken.append((r.doc_id, r.h))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, h long")
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"]).select("doc_id", "text", "quality").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("x"))
    return [(r[1], r[2]) for r in sorted(rows.select("doc_id", "x.text", "x.quality").collect())], counts


def mixed_id(doc_id: int) -> int:
    """An order of doc_ids that has nothing to do with their size."""
    return int(mix(np.array([doc_id], np.int64).view(np.uint64))[0])


def train(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """Classes sampled at different rates are weighted back to their shares in ``counts``."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    present = {c: sum(q == c for _, q in rows) for c in (0, 1)}
    if not present[0] or not present[1]:
        share = 0.5 if not rows else float(np.clip(present[1] / len(rows), 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    documents = []
    for text, quality in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [b for b, _ in features(Words(raw, np.array([0, len(raw)])))]
        buckets, times = np.unique(np.concatenate(found), return_counts=True)
        if len(buckets):
            documents.append((buckets.astype(np.int32), (times / (times.sum() + PRIOR)).astype(np.float32), quality))
    scale = {c: counts[c] / present[c] for c in (0, 1)}
    mean = sum(scale[q] for _, _, q in documents) / max(1, len(documents))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.log(np.array([counts[0], counts[1]], np.float32) / (counts[0] + counts[1]))
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(documents)):
            buckets, shares, quality = documents[d]
            rate = RATE * (1 - done / steps) * min(scale[quality] / mean, 4.0)
            done += 1
            own = vectors[buckets]
            hidden = shares @ own
            z = hidden @ layer + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[quality] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= BIAS_RATE * rate * error
            # each vector moves by its share of the document, scaled so that long texts train as fast as short ones
            vectors[buckets] = own - (rate * shares / max(float(shares @ shares), 1e-3) * 0.05)[:, None] * back
    difference = layer[:, 1] - layer[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for row, stop, words in text_chunks(batch.column(1), limit=1 << 20):
            out[row:stop] = model.score(words)
        yield arrow_batch(_SCORE_ARROW, [batch.column(0), out])


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Only the text enters a score; labels of held-out doc_ids (crc32 of the decimal doc_id divisible
    by 5) are never read for training. Null and empty texts get the score of the bias; a null doc_id
    is not held out. Repeated rows are scored one by one, and equal texts score the same; a text is read
    whole, however long. A score of the threshold counts as class 1. An empty table gives no rows; without
    labels of both classes every score is the share of class 1, or 0.5. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, per_class)))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _score(it, model), SCORE_SCHEMA)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
