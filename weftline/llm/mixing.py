"""Mixing sources to target weights by iterative proportional fitting.

Topics are clusters of the word profiles of all documents, each taken relative to its language's mean;
every document has the topic nearest to its own profile. Tokens are summed per cell of (source, language, topic). Raking scales the cells' weights in turn
until the weighted tokens meet the target share of every source, every language and every topic.
Documents are then sampled with probabilities proportional to their cell's weight, calibrated so
that the expected tokens are what was asked for and no probability exceeds one. Where cells would
exceed one, the margins are raked again with those held at one.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Words, arrow_batch, materialise, mix, signed, text_chunks, text_key, workspace

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Hashed words that a profile has, and turns of k-means at most.
TOPIC_WORDS, TOPIC_TURNS = 1 << 13, 15
#: Languages with under this share of the documents have one mean profile together.
OWN_MEAN = 0.001
#: Sums over documents are of whole numbers, so that no order of adding changes them: shares and directions times this.
SHARE_UNIT, UNIT = 1 << 32, 1 << 24
#: Targets where none are given: the shares found, to this power, as shares again.
TEMPERATURE = 0.7
#: Expected tokens of the sample as a share of all.
KEEP = 0.5
SEED = 20_081
ROUNDS, TOLERANCE = 200, 1e-9
#: Cells are a product of category counts, not of documents; raking on the driver takes this many.
MAX_CELLS = 500_000
OTHER = ""

# Profiles of many texts are one row, which holds their entries as arrays: how many each text has, then of each its word and value.
PROFILE_SCHEMA = "langs array<string>, counts binary, words binary, shares binary"
DIRECTION_SCHEMA = "least long, langs binary, less binary, counts binary, words binary, parts binary"
_PROFILE_ARROW = pa.schema([("langs", pa.list_(pa.string())), *((x, pa.binary()) for x in ("counts", "words", "shares"))])
_DIRECTION_ARROW = pa.schema([("least", pa.int64()), *((x, pa.binary()) for x in ("langs", "less", "counts", "words", "parts"))])
_SUMS_ARROW = pa.schema([("key", pa.string()), ("sums", pa.binary())])


def _profile_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashed word, text) of the words of five bytes and more: shorter ones are in every text."""
    longer = words.end - words.start >= 5
    return (words.hashes()[longer] % np.uint64(TOPIC_WORDS)).astype(np.int64), words.owner()[longer]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of the hashed words in each text that has any: a bounded number, however long the text."""
    for batch in batches:
        for row, stop, words in text_chunks(batch.column(1), lower=True):
            bucket, text = _profile_words(words)
            found, times = np.unique(text * TOPIC_WORDS + bucket, return_counts=True)
            of = found // TOPIC_WORDS
            n, counts = np.bincount(text, minlength=stop - row), np.bincount(of, minlength=stop - row)
            if len(found):
                langs = batch.column(0).slice(row, stop - row).filter(pa.array(n > 0)).to_pylist()
                shares = (times / n[of]).astype(np.float32)
                parts = counts[n > 0].astype(np.int32), (found % TOPIC_WORDS).astype(np.uint16), shares
                yield arrow_batch(_PROFILE_ARROW, [[langs], *([x.tobytes()] for x in parts)])


@dataclass
class Topics:
    """weight of each hashed word for each topic, and per language what the mean profile gets; rest: languages without their own."""

    weight: np.ndarray
    usual: dict[str, np.ndarray]
    rest: np.ndarray

    def of(self, words: Words, langs: list[str]) -> np.ndarray:
        """The topic of each text: the highest score, the lowest of equal ones; 0 without words."""
        bucket, text = _profile_words(words)
        n = np.bincount(text, minlength=len(langs))
        score = np.stack([np.bincount(text, w[bucket], len(langs)) for w in np.ascontiguousarray(self.weight.T)], 1) / np.maximum(n, 1)[:, None]
        score -= np.array([self.usual.get(lang, self.rest) for lang in langs]).reshape(score.shape)
        return np.where(n > 0, score.argmax(1), 0)


@dataclass
class _Space:
    """Where profiles are compared: shares times how rare a word is, less the mean of the language.

    mean: a row per language of ``code``, the last for all others; unit and size: these as directions and lengths.
    """

    rare: np.ndarray
    code: dict[str, int]
    mean: np.ndarray

    def __post_init__(self):
        self.size = np.sqrt((self.mean**2).sum(1))
        self.unit = np.divide(self.mean, self.size[:, None], out=np.zeros_like(self.mean), where=self.size[:, None] > 0)


@dataclass
class _Directions:
    """Of each text its language, where its entries begin, and how much of its language's mean is taken off; of each entry word and part."""

    lang: np.ndarray
    less: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    parts: np.ndarray

    def near(self, centers: np.ndarray, usual: np.ndarray) -> np.ndarray:
        """The products with centers; usual: those of the languages' mean directions."""
        return np.stack([np.add.reduceat(c[self.words] * self.parts, self.first) for c in centers], 1) - self.less[:, None] * usual[self.lang]


def _content(first: np.ndarray, words: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the entries of each text."""
    return signed(np.add.reduceat(mix(mix(words.astype(np.uint64) ^ np.uint64(seed)) ^ parts.view(np.uint32)), first))


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts)[:-1]).astype(np.int64)


def _arrays(batches: Iterator[pa.RecordBatch], *kinds) -> Iterator[tuple]:
    """The rows of batches, with binary columns as arrays of these kinds (None: as they are)."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield tuple(x if kind is None else np.frombuffer(x, kind) for x, kind in zip(row, kinds))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Directions]:
    for _, lang, less, counts, words, parts in _arrays(batches, None, np.int32, np.float64, np.int32, np.uint16, np.float32):
        yield _Directions(lang, less, _begins(counts), counts, words.astype(np.int64), parts)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole numbers with the same key."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = np.frombuffer(raw, np.int64)
            total[key] = total[key] + new if key in total else new
    yield arrow_batch(_SUMS_ARROW, [list(total), [x.tobytes() for x in total.values()]])


def _summed(profiles: DataFrame, sums) -> dict[str, np.ndarray]:
    """What ``sums`` gives per partition, added in two steps: the driver gets about as many parts as the root of their number."""
    parts = profiles.mapInArrow(sums, "key string, sums binary")
    middle = max(2, math.isqrt(parts.rdd.getNumPartitions()))
    out: dict[str, np.ndarray] = {}
    for key, raw in parts.repartition(middle).mapInArrow(_added, "key string, sums binary").collect():
        out[key] = out.get(key, 0) + np.frombuffer(raw, np.int64)
    return out


def _space(profiles: DataFrame) -> _Space:
    """Counts and mean shares over all profiles."""
    rows = profiles.select(F.explode("langs").alias("lang")).groupBy("lang").count()
    total = rows.agg(F.sum("count")).first()[0] or 0
    own = {r.lang: i for i, r in enumerate(rows.filter(F.col("count") >= OWN_MEAN * total).orderBy("lang").collect())}  # 1000 at most

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, have = np.zeros(len(own) + 1, np.int64), np.zeros(TOPIC_WORDS, np.int64)
        by: dict[int, np.ndarray] = {}
        for langs, counts, words, shares in _arrays(batches, None, np.int32, np.uint16, np.float32):
            lang = np.array([own.get(x, len(own)) for x in langs], np.int64)
            of, whole = np.repeat(lang, counts), np.rint(shares.astype(np.float64) * SHARE_UNIT)
            n += np.bincount(lang, minlength=len(n))
            have += np.bincount(words, minlength=TOPIC_WORDS)
            for i in np.unique(lang).tolist():  # whole numbers below 2^53: exact
                by[i] = by.get(i, 0) + np.bincount(words[of == i], whole[of == i], TOPIC_WORDS).astype(np.int64)
        yield arrow_batch(_SUMS_ARROW, [["n", "have", *map(str, by)], [x.tobytes() for x in (n, have, *by.values())]])

    got = _summed(profiles, sums)
    n, have = got.get("n", np.zeros(len(own) + 1)), got.get("have", np.zeros(TOPIC_WORDS))
    rare = np.log((1 + total) / (1 + have))
    mean = np.stack([rare * got.get(str(i), np.zeros(TOPIC_WORDS)) / (SHARE_UNIT * max(1, n[i])) for i in range(len(own) + 1)])
    return _Space(rare, own, mean)


def _directions(profiles: DataFrame, space: _Space, seed: int) -> DataFrame:
    """The profiles less the means, with length one; without those that are their mean, but for a thousandth. least: of their hashes."""
    shared = profiles.sparkSession.sparkContext.broadcast(space)

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, counts, words, shares in _arrays(batches, None, np.int32, np.uint16, np.float32):
            space = shared.value
            lang = np.array([space.code.get(x, len(space.mean) - 1) for x in langs], np.int64)
            first, size, x = _begins(counts), space.size[lang], shares * space.rare[words]
            own = np.add.reduceat(x * x, first)
            square = own - 2 * np.add.reduceat(x * space.mean[np.repeat(lang, counts), words], first) + size**2
            clear = square > 1e-6 * (own + size**2)
            length, held = np.sqrt(np.where(clear, square, 1)), np.repeat(clear, counts)
            if clear.any():
                parts = (x / np.repeat(length, counts))[held].astype(np.float32)
                out = lang[clear].astype(np.int32), (size / length)[clear], counts[clear], words[held], parts
                least = _content(_begins(counts[clear]), words[held], parts, seed).min()
                yield arrow_batch(_DIRECTION_ARROW, [[int(least)], *([c.tobytes()] for c in out)])

    return profiles.mapInArrow(directed, DIRECTION_SCHEMA)


_ONE_ARROW = pa.schema([("near", pa.float64()), ("content", pa.int64()), ("lang", pa.int32()), ("less", pa.float64()), ("words", pa.list_(pa.int32())), ("parts", pa.list_(pa.float32()))])


def _one(batches: Iterator[pa.RecordBatch], centers: np.ndarray, usual: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """The direction that is least near to all centers, of several the one with the least hash."""
    best = None
    for d in _read(batches):
        near = d.near(centers, usual).max(1)
        if best is None or near.min() <= best[0]:
            even = np.flatnonzero(near == near.min())
            content = _content(d.first, d.words, d.parts, seed)[even]
            i = int(even[content.argmin()])
            if best is None or (near[i], content.min()) < best[:2]:
                entries = slice(int(d.first[i]), int(d.first[i] + d.counts[i]))
                best = float(near[i]), int(content.min()), int(d.lang[i]), float(d.less[i]), d.words[entries].tolist(), d.parts[entries].tolist()
    if best:
        yield arrow_batch(_ONE_ARROW, [[x] for x in best])


def _farthest(directions: DataFrame, space: _Space, centers: np.ndarray, seed: int) -> np.ndarray | None:
    """The direction farthest from all centers; None if there is none."""
    shared = directions.sparkSession.sparkContext.broadcast((centers, space.unit @ centers.T))
    found = directions.mapInArrow(lambda it: _one(it, *shared.value, seed), "near double, content long, lang int, less double, words array<int>, parts array<float>").orderBy("near", "content", "lang").first()
    shared.destroy()
    if not found:
        return None
    x = -found.less * space.unit[found.lang]
    x[found.words] += np.array(found.parts)
    return x / np.linalg.norm(x)


def _turn(directions: DataFrame, space: _Space, centers: np.ndarray) -> dict[str, np.ndarray]:
    """Per center the sum of the directions nearest to it: of profiles, and of the means to be taken off."""
    shared = directions.sparkSession.sparkContext.broadcast((centers, space.unit @ centers.T))
    k, langs = len(centers), len(space.mean)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, less = np.zeros(k * TOPIC_WORDS, np.int64), np.zeros(k * langs, np.int64)
        for d in _read(batches):
            own = d.near(*shared.value).argmax(1)
            to += np.bincount(np.repeat(own * TOPIC_WORDS, d.counts) + d.words, np.rint(d.parts * np.float64(UNIT)), len(to)).astype(np.int64)
            less += np.bincount(own * langs + d.lang, np.rint(d.less * UNIT), len(less)).astype(np.int64)
        yield arrow_batch(_SUMS_ARROW, [["to", "less"], [to.tobytes(), less.tobytes()]])

    got = _summed(directions, sums)
    shared.destroy()
    return got


def clustered(profiles: DataFrame, path: str, topics: int, seed: int = SEED) -> Topics:
    """Spherical k-means over profiles, weighted by how few of them have a word, less their language's mean.

    Every pass reads all profiles, whose directions are written below ``path``. The first center is the one
    with the least hash, each next one the farthest from those before; then centers become the mean direction
    of what is nearest to them.
    """
    space, centers = _space(profiles), np.zeros((topics, TOPIC_WORDS))
    directions = materialise(_directions(profiles, space, seed), f"{path}/directions")
    least = directions.agg(F.min("least")).first()[0]  # one column; the next line reads the texts beside it alone
    first = None if least is None else _farthest(directions.filter(F.col("least") == least), space, centers[:1], seed)
    if first is not None:
        centers[0] = first
        for k in range(1, topics):
            centers[k] = _farthest(directions, space, centers[:k], seed)
        before: dict[str, np.ndarray] = {}
        for _ in range(TOPIC_TURNS):
            got = _turn(directions, space, centers)
            if before and all((got[x] == before[x]).all() for x in got):
                break
            before = got
            mean = got["to"].reshape(topics, -1) - got["less"].reshape(topics, -1) @ space.unit
            length = np.linalg.norm(mean, axis=1, keepdims=True)
            centers = np.where(length > 0.5, mean / np.maximum(length, 0.5), centers)
    usual = space.mean @ centers.T
    return Topics((centers * space.rare).T.copy(), {lang: usual[i] for lang, i in space.code.items()}, usual[-1])


def _category(name: str, have: set[str]) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(OTHER)) if name in have else F.lit(OTHER)


def fit_topics(docs: DataFrame, topics: int = TOPICS, seed: int = SEED) -> Topics:
    """Topics of all documents; those without a word of five bytes have no say. Whatever the order of rows, the same."""
    path = workspace(docs.sparkSession, "topics")
    rows = docs.filter(F.col("text").isNotNull()).select(_category("lang", set(docs.columns)).alias("lang"), "text")
    return clustered(materialise(rows.mapInArrow(_profiles, PROFILE_SCHEMA), f"{path}/profiles"), path, topics, seed)


def _fields(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds tokens and topic to rows that end with lang and text."""
    for batch in batches:
        tokens, topic = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        langs = batch.column(batch.num_columns - 2).to_pylist()
        for row, stop, words in text_chunks(batch.column(batch.num_columns - 1), lower=True):
            tokens[row:stop] = words.count
            topic[row:stop] = shared.value.of(words, langs[row:stop])
        yield arrow_batch(schema, [*batch.columns[:-1], tokens, pa.array(topic.astype(str).tolist(), pa.string())])


def described(docs: DataFrame, topics: Topics, carried: dict[str, str] | None = None) -> DataFrame:
    """doc_id, tk, source, topic, lang, n_tokens of each row; null categories are ''.

    Where the table has a topic column, that is taken instead of the fitted ones. ``carried`` maps
    columns of ``docs`` to names under which they come along.
    """
    have, spark = set(docs.columns), docs.sparkSession
    carried = carried or {}
    extra = [F.col(f"`{c}`").alias(n) for c, n in carried.items()]
    rows = docs.select(*extra, F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), _category("source", have).alias("source"), _category("topic", have).alias("given"), _category("lang", have).alias("lang"), "text")
    schema = StructType([*rows.schema[:-1], StructField("n_tokens", LongType()), StructField("fitted", StringType())])
    shared, arrow = spark.sparkContext.broadcast(topics), to_arrow_schema(schema)
    out = rows.mapInArrow(lambda it: _fields(it, shared, arrow), schema)
    return out.withColumn("topic", F.col("given") if "topic" in have else F.col("fitted")).drop("given", "fitted")


@dataclass
class Raked:
    """cells: (source, lang, topic) -> weight; gap: the largest difference of a margin's share from its target."""

    cells: dict[tuple, float]
    gap: float
    rounds: int


def tempered(tokens: Mapping[tuple, float], margin: int, power: float = TEMPERATURE) -> dict[str, float]:
    sums: dict[str, float] = {}
    for cell, n in tokens.items():
        sums[cell[margin]] = sums.get(cell[margin], 0.0) + n
    raised = {c: n**power for c, n in sums.items() if n > 0}
    return {c: x / sum(raised.values()) for c, x in raised.items()}


def rake(tokens: Mapping[tuple, float], targets: list[Mapping[str, float]]) -> Raked:
    """Weights w with sum of w * tokens over a category = its target share, in each margin.

    Categories without tokens can't be met; the rest of a margin's targets are scaled to one.
    Categories without a target get weight 0. Margins whose structural zeros contradict each other
    leave a gap, which is returned.
    """
    cells = sorted(c for c, n in tokens.items() if n > 0)
    if not cells:
        return Raked({}, 0.0, 0)
    mass = np.array([float(tokens[c]) for c in cells])
    mass /= mass.sum()
    codes, wanted = [], []
    for m, target in enumerate(targets):
        names = sorted({c[m] for c in cells})
        want = np.array([max(0.0, float(target.get(n, 0.0))) for n in names])
        if want.sum() <= 0:
            raise ValueError("no category of a margin has both tokens and a target")
        codes.append(np.array([names.index(c[m]) for c in cells]) if len(names) < 64 else np.searchsorted(names, [c[m] for c in cells]))
        wanted.append(want / want.sum())
    weight = np.ones(len(cells))
    for done in range(1, ROUNDS + 1):
        for code, want in zip(codes, wanted):
            now = np.bincount(code, weight * mass, len(want))
            weight *= np.divide(want, now, out=np.zeros_like(want), where=now > 0)[code]
        gap = max(float(np.abs(np.bincount(code, weight * mass, len(want)) - want).max()) for code, want in zip(codes, wanted))
        if gap < TOLERANCE:
            break
    return Raked(dict(zip(cells, weight.tolist())), gap, done)


def probabilities(weights: Mapping[tuple, float], tokens: Mapping[tuple, float], keep: float) -> dict[tuple, float]:
    """min(1, c * weight) per cell, with c such that the expected tokens are ``keep`` of all.

    If the cells with any weight hold fewer tokens than that, all of theirs are kept.
    """
    cells = [c for c in weights if weights[c] > 0]
    goal, free = keep * sum(tokens.values()), sum(tokens[c] for c in cells)
    if goal >= free:
        return {c: 1.0 if weights[c] > 0 else 0.0 for c in weights}
    cells.sort(key=lambda c: (-weights[c], c))
    rest = sum(weights[c] * tokens[c] for c in cells)
    fixed = 0.0
    scale = 0.0
    for c in cells:  # heaviest first: those that reach one are kept whole, and the goal shrinks
        scale = (goal - fixed) / rest
        if scale * weights[c] < 1:
            break
        fixed += tokens[c]
        rest -= weights[c] * tokens[c]
    return {c: min(1.0, scale * weights[c]) for c in weights}


def _within(want: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Amounts of the same sum, none above ``most``: what is too much for one goes to the others by their share."""
    out = want.copy()
    while (over := out > most * (1 + 1e-12)).any():
        out[over] = most[over]
        free = (out < most) & (want > 0)
        spare = want.sum() - out.sum()
        if not free.any() or spare <= 0:
            break
        out[free] += spare * want[free] / want[free].sum()
    return out


def _factors(code: np.ndarray, u: np.ndarray, tokens: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Per category the factor f with sum of min(1, f * u) * tokens = want; infinite where all cells have to be full."""
    order = np.lexsort((-u, code))
    c, v, t = code[order], u[order], tokens[order]
    first = np.searchsorted(c, np.arange(len(want)))
    full = np.concatenate([[0], np.cumsum(t)])[:-1]
    full -= full[first][c]  # tokens of the heavier cells of the category
    scaled = np.concatenate([[0], np.cumsum((v * t)[::-1])])[::-1]
    scaled = scaled[:-1] - np.append(scaled[first], 0)[c + 1]  # what this cell and lighter ones have
    f = np.divide(want[c] - full, scaled, out=np.full(len(c), np.inf), where=scaled > 0)
    fits = np.flatnonzero(f * v <= 1 + 1e-12)
    found, at = np.unique(c[fits], return_index=True)
    out = np.full(len(want), np.inf)
    out[found] = np.maximum(f[fits[at]], 0)
    return out


def sampled(fitted: Raked, tokens: Mapping[tuple, float], targets: list[Mapping[str, float]], keep: float) -> tuple[dict[tuple, float], list[float]]:
    """The probability of each cell, and per margin the largest difference of a share from its target.

    The shares are those of the expected tokens. Where no cell is full the weights are scaled.
    Otherwise the probabilities are min(1, product of a factor per category), raked margin by margin.
    A category that has fewer tokens than its target asks for is kept whole, and the rest of its
    target goes to the others.
    """
    chances = probabilities(fitted.cells, tokens, keep)
    cells = sorted(c for c in chances if chances[c] > 0)
    if not cells:
        return chances, [0.0] * len(targets)
    mass = np.array([float(tokens[c]) for c in cells])
    p = np.array([chances[c] for c in cells])
    goal = float(p @ mass)
    codes, wanted = [], []
    for m, target in enumerate(targets):
        names, code = np.unique([c[m] for c in cells], return_inverse=True)
        want = np.array([max(0.0, float(target.get(str(n), 0.0))) for n in names])
        codes.append(code)
        wanted.append(want / want.sum())
    if p.max() >= 1 and p.min() < 1:
        within = [_within(w * goal, np.bincount(c, mass, len(w))) for c, w in zip(codes, wanted)]
        u = np.array([fitted.cells[c] for c in cells]) * keep
        for _ in range(ROUNDS):
            for code, want in zip(codes, within):
                f = _factors(code, u, mass, want)[code]
                u = np.where(np.isfinite(f), u * np.where(np.isfinite(f), f, 1), np.maximum(u, 1))
            p = np.minimum(u, 1)
            if max(float(np.abs(np.bincount(c, p * mass, len(w)) - w).max()) for c, w in zip(codes, within)) < TOLERANCE * goal:
                break
        chances = {**chances, **dict(zip(cells, p.tolist()))}
    got = float(p @ mass)
    return chances, [float(np.abs(np.bincount(c, p * mass, len(w)) / got - w).max()) for c, w in zip(codes, wanted)]


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that doc_id and seed alone decide."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(1 << 52)).cast("double") / float(1 << 52)


def weighed(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, keep: float, seed: int) -> DataFrame:
    """Adds weight, probability and kept to described() rows, which are read twice."""
    spark = rows.sparkSession
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    taken = cells.limit(MAX_CELLS + 1).collect()
    if len(taken) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic; give coarser categories")
    tokens = {tuple(r[:3]): float(r[3]) for r in taken}
    wanted = [dict((targets or {}).get(name) or tempered(tokens, m)) for m, name in enumerate(MARGINS)]
    fitted = rake(tokens, wanted) if any(tokens.values()) else Raked({}, 0.0, 0)
    chances, gaps = sampled(fitted, tokens, wanted, keep) if fitted.cells else ({}, [])
    for name, gap in zip(MARGINS, gaps):
        if gap > 1e-4:
            logging.getLogger(__name__).warning("shares of %s miss their targets by up to %.4f", name, gap)
    table = spark.createDataFrame([(*c, float(w), float(chances[c])) for c, w in fitted.cells.items()], "source string, lang string, topic string, weight double, probability double")
    out = rows.join(F.broadcast(table), list(MARGINS), "left")  # MAX_CELLS rows at most
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.withColumn("kept", chance(F.col("doc_id"), seed) < F.col("probability"))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """doc_id, tk, source, lang, topic, n_tokens, weight, probability, kept of each row.

    ``targets`` maps source, lang and topic to shares per category; a margin left out gets the shares
    found, tempered. A cell is kept whole at most, so a category can miss its target where its tokens are
    too few; the gap of a margin is logged. Tokens are words, of texts of any length. Null categories are
    a category of their own, ''. Texts without words follow their cell; in a cell without tokens nothing
    is kept. Rows that share a doc_id draw one number, so equal rows are kept or dropped together; so do
    null doc_ids, like the text 'null'. Equal scores of topics go to the lowest. An empty table gives no
    rows. Other columns are not read.
    """
    rows = materialise(described(docs, fit_topics(docs)), f"{workspace(docs.sparkSession, 'mix')}/described")
    return weighed(rows, targets, keep, seed).select("doc_id", "tk", *MARGINS, "n_tokens", "weight", "probability", "kept")


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that mixed() keeps, with all their columns and no shuffle of texts."""
    named = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    rows = materialise(described(docs, fit_topics(docs), named), f"{workspace(docs.sparkSession, 'mix')}/described")
    return weighed(rows, targets, keep, seed).filter("kept").select(*[F.col(n).alias(c) for c, n in named.items()])
