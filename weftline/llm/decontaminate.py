"""Benchmark decontamination by template canonicalisation.

Numbers, names and units in a text become typed placeholders; what they held is kept aside as slots.
Windows of the templates are hash-joined with those of the benchmark items. Windows of one item that
match at one displacement form an alignment. It counts as a leak if it covers enough of the item, or
a long enough stretch, and its slots are consistent: one value of the item always became one value
of the document, and two values of the item never the same one. So a question with other numbers
or names is caught, and chance agreement of placeholders is not.

Windows of the plain words, whatever their case, are joined in the same way, without slots: they find
verbatim copies whose letters changed case. An item without a window of templates is searched for whole,
at its own length: as a template, with consistent slots, if it has a word that is no placeholder, and
word for word if it is shorter than a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, _constants, arrow_batch, gram_hasher, materialise, signed, text_chunks, text_key, word_hashes, workspace

WINDOW = 5
#: Words of a window that must not be placeholders.
LITERALS = 3
#: Share of an item's windows that an alignment has to match, as for other stages on five-word shingles.
COVERAGE = 0.8
#: Or so many words of the item in a row.
STRETCH = 13
#: Benchmark windows that are broadcast at once, some 100 bytes each; more are joined in several passes.
BLOCK = 1_000_000

#: Fixed words taken for units of measure.
UNITS = """
mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams ton tons lb lbs pound pounds oz ounce ounces
ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks
month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kph hz khz mhz ghz v w kw kwh
volt volts watt watts j joule joules n newton newtons pa kb mb gb tb byte bytes
""".split()

_SLOT = {"number": 1, "name": 2, "unit": 3}
_SLOT_HASH = _constants(20_051, 4)
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT, _UPPER, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_STOP[[ord(c) for c in ".!?:;\"|"]] = True

#: What is compared: windows of templates and of plain words, and whole items as templates and as plain words.
TEMPLATE, PLAIN, WHOLE_TEMPLATE, WHOLE_PLAIN = range(4)

MATCH_SCHEMA = "doc_id long, tk long, item_id long, view int, at int, place int, slots array<struct<a:long,b:long>>"
_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_MATCH_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("item_id", pa.int64()), ("view", pa.int32()), ("at", pa.int32()), ("place", pa.int32()), ("slots", _PAIRS)])
WINDOW_SCHEMA = "item_id long, view int, at int, size int, lead long, win long, n_windows int, slots array<long>, kinds array<int>"
_WINDOW_ARROW = pa.schema([("item_id", pa.int64()), ("view", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("lead", pa.int64()), ("win", pa.int64()), ("n_windows", pa.int32()), ("slots", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32()))])


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return word_hashes(LOWER[data], start, end)


def _lower_table() -> np.ndarray:
    """Of each code point up to 0xFFFF its lower case, where that takes as many bytes in UTF-8."""
    out = np.arange(1 << 16)
    for c in range(0x80, 1 << 16):
        low = chr(c).lower()
        if not 0xD800 <= c < 0xE000 and len(low) == 1 and len(low.encode()) == len(chr(c).encode()):
            out[c] = ord(low)
    out[0x3C2] = 0x3C3  # the two small sigmas have one capital
    return out


_LOWER_CODES = _lower_table()


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes of UTF-8 text with letters of up to three bytes in lower case, and 'ss' for 'ß', as its capitals have it."""
    out = data.copy()
    two, three = np.flatnonzero((data >= 0xC2) & (data <= 0xDF)), np.flatnonzero((data & 0xF0) == 0xE0)
    code = _LOWER_CODES[((data[two] & 31).astype(np.int64) << 6) | (data[two + 1] & 63)]
    out[two], out[two + 1] = 0xC0 | code >> 6, 0x80 | code & 63
    sharp = two[code == 0xDF]
    out[sharp] = out[sharp + 1] = ord("s")
    code = _LOWER_CODES[((data[three] & 15).astype(np.int64) << 12) | ((data[three + 1] & 63).astype(np.int64) << 6) | (data[three + 2] & 63)]
    out[three], out[three + 1], out[three + 2] = 0xE0 | code >> 12, 0x80 | code >> 6 & 63, 0x80 | code & 63
    return out


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(_hash_words(raw, ends - [len(u) for u in UNITS], ends))


class Templates:
    """Template tokens of some texts: value is the hash of the word, kind its slot type or 0, plain its hash whatever its case."""

    def __init__(self, words):
        data, start, end = words.data, words.start.copy(), words.end.copy()
        owner = words.owner()
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.ones(len(start), bool)  # first of a text, a line or a sentence: capitals mean nothing
        opens[1:] = (owner[1:] != owner[:-1]) | (lines[start[1:]] != lines[end[:-1]]) | _STOP[last[:-1]]
        move = np.arange(len(start))
        while len(move):
            move = move[(start[move] < end[move])]
            move = move[_PUNCT[data[start[move]]]]
            start[move] += 1
        move = np.arange(len(start))
        while len(move):
            move = move[(start[move] < end[move])]
            move = move[_PUNCT[data[end[move] - 1]]]
            end[move] -= 1
        keep = np.flatnonzero(start < end)
        start, end, owner, opens = start[keep], end[keep], owner[keep], opens[keep]

        def inside(flags):
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[end] - sums[start]

        self.value = _hash_words(data, start, end)
        self.plain = _hash_words(_folded(data), start, end) if len(data) and data.max() >= 0x80 else self.value
        letters, digits, uppers = inside(_LETTER[data]), inside(_DIGIT[data]), inside(_UPPER[data])
        first = data[start] if len(start) else np.zeros(0, np.uint8)
        second = data[np.minimum(start + 1, len(data) - 1)] if len(start) else first
        # A-Z, or the capitals of Latin-1 in UTF-8; words in capitals throughout are plain words
        capital = (_UPPER[first] & (uppers == 1) & (letters > 1)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (uppers == 0) & (letters > 2))
        self.kind = np.zeros(len(start), np.int64)
        self.kind[np.isin(self.value, _unit_hashes())] = _SLOT["unit"]
        self.kind[capital & ~opens] = _SLOT["name"]
        self.kind[(letters == 0) & (digits > 0)] = _SLOT["number"]
        self.token = np.where(self.kind > 0, _SLOT_HASH[self.kind], self.value)
        self.first = np.searchsorted(owner, np.arange(len(words.offsets)))
        self.owner = owner

    def windows(self, size: int, literals: int, view: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows within one text; those of templates have enough plain words."""
        n = len(self.token) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = self.owner[:n] == self.owner[size - 1 :]
        if view == TEMPLATE:
            words = np.concatenate([[0], np.cumsum(self.kind == 0)])
            ok &= words[size:] - words[:n] >= literals
        at = np.flatnonzero(ok)
        return at, gram_hasher(self.tokens(view))(at, at + size)

    def tokens(self, view: int) -> np.ndarray:
        return self.token if view in (TEMPLATE, WHOLE_TEMPLATE) else self.plain


def _item_windows(batches: Iterator[pa.RecordBatch], size: int, literals: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, _, words in text_chunks(batch.column(1)):
            t = Templates(words)
            n_texts = len(words.offsets) - 1
            length = np.diff(t.first)

            def rows(view: int, at: np.ndarray, win: np.ndarray, sizes: np.ndarray, slots: bool):
                text = t.owner[at]
                total = np.bincount(text, minlength=n_texts)
                value, kind = ([x[a : a + n].tolist() if slots else [] for a, n in zip(at, sizes)] for x in (signed(t.value), t.kind))
                lead = signed(t.tokens(view)[at])
                return arrow_batch(_WINDOW_ARROW, [ids[row + text], np.full(len(at), view, np.int32), (at - t.first[text]).astype(np.int32), sizes.astype(np.int32), lead, signed(win), total[text].astype(np.int32), value, kind])

            at, win = t.windows(size, literals)
            yield rows(TEMPLATE, at, win, np.full(len(at), size), True)
            bare = np.setdiff1d(np.flatnonzero(length > 0), t.owner[at])
            at, win = t.windows(size, literals, PLAIN)
            yield rows(PLAIN, at, win, np.full(len(at), size), False)
            worded = bare[np.bincount(t.owner, t.kind == 0, n_texts)[bare] > 0]
            for view, text in ((WHOLE_TEMPLATE, worded), (WHOLE_PLAIN, bare[length[bare] < size])):
                at = t.first[text]
                yield rows(view, at, gram_hasher(t.tokens(view))(at, at + length[text]), length[text], view == WHOLE_TEMPLATE)


def item_windows(benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Every window of the benchmark items with its place, hash, words and slot types, by view; whole items count as one window.

    Null items and those of punctuation alone have none: there is nothing to search for.
    """
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(lambda it: _item_windows(it, size, literals), WINDOW_SCHEMA)


def _spots(table: dict, t: Templates, view: int, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text that may be those of a benchmark window."""
    if view in (TEMPLATE, PLAIN):
        return t.windows(size, literals, view)
    tokens = t.tokens(view)
    begin = np.flatnonzero(table["lead"][np.minimum(np.searchsorted(table["lead"], tokens), len(table["lead"]) - 1)] == tokens)
    span, ats, wins = gram_hasher(tokens), [], []
    for n in table["sizes"].tolist():
        at = begin[begin + n <= len(tokens)]
        at = at[t.owner[at] == t.owner[at + n - 1]]
        ats.append(at)
        wins.append(span(at, at + n))
    return np.concatenate(ats), np.concatenate(wins)


def _matches(batches: Iterator[pa.RecordBatch], shared, size: int, literals: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, words in text_chunks(batch.column(2)):
            t = Templates(words)
            for view, table in shared.value.items() if len(t.owner) else ():
                known, first, items, places, begin = (table[k] for k in ("win", "first", "item", "at", "begin"))
                at, win = _spots(table, t, view, size, literals)
                spot = np.minimum(np.searchsorted(known, win), len(known) - 1)
                hit = np.flatnonzero(known[spot] == win)
                if not len(hit):
                    continue
                at, spot = at[hit], spot[hit]
                # a window of several items matches each of them
                n = first[spot + 1] - first[spot]
                entry = np.repeat(first[spot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                here = np.repeat(at, n)
                text = t.owner[here]
                value, values, kinds = signed(t.value), table["values"], table["kinds"]
                slots = [[{"a": int(values[e]), "b": int(value[h + j])} for j, e in enumerate(range(begin[e], begin[e + 1])) if kinds[e]] for e, h in zip(entry, here)]
                yield arrow_batch(_MATCH_ARROW, [ids[row + text], keys[row + text], items[entry], np.full(len(entry), view, np.int32), places[entry], (here - t.first[text]).astype(np.int32), slots])


def _table(part: pa.Table) -> dict:
    """The windows of one view as arrays, sorted by hash; values and kinds of entry i lie from begin[i] to begin[i + 1]."""
    item, at, win = part["item_id"].to_numpy(), part["at"].to_numpy(), part["win"].to_numpy().view(np.uint64)
    order = np.lexsort((at, item, win))
    win = win[order]
    known, first = np.unique(win, return_index=True)
    slots, kinds = (part[c].combine_chunks().take(pa.array(order)) for c in ("slots", "kinds"))
    return {
        "win": known,
        "first": np.append(first, len(win)),
        "item": item[order],
        "at": at[order],
        "lead": np.unique(part["lead"].to_numpy().view(np.uint64)),
        "sizes": np.unique(part["size"].to_numpy()).astype(np.int64),
        "begin": np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64),
        "values": slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        "kinds": kinds.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
    }


def matches(docs: DataFrame, windows: DataFrame, block: int = BLOCK, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """The hash join of all document windows with the benchmark's, broadcast about ``block`` windows at a time.

    Each pass ends as a table, and its broadcast with it, so driver and executors hold those of one pass.
    """
    spark = docs.sparkSession
    path = workspace(spark, "matches")
    passes = max(1, -(-windows.count() // block))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    out = None
    for i in range(passes):
        part = windows.filter(F.pmod(F.xxhash64("win"), F.lit(passes)) == i).select("win", "view", "item_id", "at", "size", "lead", "slots", "kinds").toArrow()
        views = part["view"].to_numpy()
        shared = spark.sparkContext.broadcast({int(view): _table(part.filter(pa.array(views == view))) for view in np.unique(views)})
        found = materialise(rows.mapInArrow(lambda it, shared=shared: _matches(it, shared, size, literals), MATCH_SCHEMA), f"{path}/{i}")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, stretch: int = STRETCH) -> DataFrame:
    """doc_id, tk, item_id, covered of each consistent alignment that counts as a leak (the best per item)."""
    path = workspace(docs.sparkSession, "leaks")
    windows = materialise(item_windows(benchmark), f"{path}/windows")
    found = matches(docs, windows).withColumn("shift", F.col("place") - F.col("at"))
    groups = found.groupBy("doc_id", "tk", "item_id", "view", "shift").agg(F.sort_array(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("pairs"))
    # the longest run of neighbouring windows: places minus ranks are equal within a run
    ranks = F.transform("ats", lambda a, i: a - i)
    runs = F.transform(F.array_distinct(ranks), lambda r: F.size(F.filter(ranks, lambda x: x == r)))
    whole = windows.groupBy("item_id", "view").agg(F.max("n_windows").alias("n_windows"))
    judged = groups.join(whole, ["item_id", "view"]).withColumn("covered", F.size("ats") / F.col("n_windows"))
    consistent = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))) & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))))
    long_enough = F.col("view").isin(TEMPLATE, PLAIN) & (F.array_max(runs) + (WINDOW - 1) >= stretch)
    return judged.filter(consistent & ((F.col("covered") >= coverage) | long_enough)).groupBy("doc_id", "tk", "item_id").agg(F.max("covered").alias("covered"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, covered of each row.

    item_ids lists the items found, in rising order; covered is the largest share of an item's
    windows, of templates or of plain words. Null and empty texts contain nothing; a row with a null doc_id is judged like others;
    rows that share a doc_id are judged one by one. A text is read whole, however long. Of alignments of
    one item that tie in what they cover, which are one result, it doesn't matter which is meant. An empty
    benchmark marks nothing; an empty table gives no rows. Other columns are not read.
    """
    found = leaks(docs, benchmark).groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"))
    found = found.withColumnRenamed("doc_id", "d").withColumnRenamed("tk", "k")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k")), "left")
    n = F.coalesce(F.size("item_ids"), F.lit(0)).cast("long")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), n.alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))
