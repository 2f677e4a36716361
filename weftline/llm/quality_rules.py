"""Quality rules with risk-controlled thresholds.

Each rule is a measure of a text and a grid of cutoffs from lenient to strict; a text over the
cutoff is rejected. The labelled documents are split in a tuning and a holdout half. Per stratum,
the tuning half says which rules pay and how strict each is wanted. The holdout half then says how
strict each may be: along the grid, a cutoff is allowed while the exact binomial test rejects "it
rejects more than alpha of the good documents" at level delta / tests (Bonferroni over all strata
and rules in use; along one grid, testing in fixed order needs no further correction). alpha is
the risk of the stratum divided by its rules in use, so their sum bounds false rejections. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, materialise, workspace

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK = 0.05
DELTA = 0.05
#: What one wrongly rejected good document weighs against rejected bad ones in the tuning half.
GOOD_WEIGHT = 10
MAX_BROADCAST_STRATA = 20_000

#: Cutoffs of each rule, from lenient to strict.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "capital_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bang_share": [0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02, 0.01],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "mean_word_chars": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0],
    "word_density": [0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
}


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more."""

    def covered(windows):
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(es, a, b):
            return F.coalesce(F.get(es, a)["h"] == F.get(es, b)["h"], F.lit(False))

        places = let(ordered, lambda es: F.sort_array(F.transform(F.filter(es, lambda e, k: ((k > 0) & same(es, k, F.greatest(k - 1, F.lit(0)))) | same(es, k, k + 1)), lambda e: e["i"])))
        steps = let(places, lambda ps: F.transform(ps, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, k + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(hashes):
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))
        return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(covered(ws)))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), counted))


def measures(text: Column) -> Column:
    """A struct with the base counts and every rule's measure of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def only(chars: str) -> Column:
        return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")

    def of_words(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    solid = F.btrim(text, F.lit(SPACES))
    words = F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(
        F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), only("#*$%&|<>").alias("symbols"), only("\\p{Lu}").alias("capitals"), only("!?").alias("bangs")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            x["w"]["word_chars"].alias("word_chars"),
            x["symbols"].alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((x["w"]["n_words"] < MIN_WORDS) | (100 * x["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * x["w"]["n_words"])).alias("base_failed"),
            _share(x["symbols"], x["w"]["word_chars"]).alias("symbol_share"),
            _share(x["capitals"], x["w"]["word_chars"]).alias("capital_share"),
            _share(x["bangs"], x["w"]["word_chars"]).alias("bang_share"),
            _share(x["l"]["n_dup_lines"], x["l"]["n_lines"]).alias("dup_line_share"),
            _share(x["w"]["n_repeat_words"], x["w"]["n_words"]).alias("repeat_share"),
            _share(x["w"]["word_chars"], x["w"]["n_words"]).alias("mean_word_chars"),
            _share(x["w"]["n_words"], x["w"]["word_chars"]).alias("word_density"),
        ),
    )


def _share(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X of n trials with chance p, summed term by term in logarithms; 1 where k >= n p."""
    odds = F.log(p / (1 - p))
    zero = F.struct((n * F.log(1 - p)).alias("t"), F.exp(n * F.log(1 - p)).alias("s"))

    def step(acc, j):
        return let(acc["t"] + F.log((n - j + 1) / j) + odds, lambda t: F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s")))

    total = F.when(k < 1, zero["s"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), zero, step)["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def _level(value: Column, grid: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in grid]), lambda c: value <= c))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs: a map from rule to the cutoff chosen; rules that reject nothing are left out.

    ``measured`` has doc_id, stratum, and m (see measures()). Counts come from all labelled rows; a
    doc_id labelled twice counts with its lowest quality. Null labels and null doc_ids don't count.
    """
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.filter(~F.col("m.base_failed")).join(known, "doc_id")
    # a text is rejected by the cutoffs from its level on
    levels = F.array(*[F.struct(F.lit(rule).alias("rule"), _level(F.col(f"m.{rule}"), grid).alias("level")) for rule, grid in GRIDS.items()])
    counts = (
        rows.select("stratum", "quality", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0).alias("tune"), F.inline(levels))
        .groupBy("stratum", "rule", "quality", "tune", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def listed(tune: bool, good: bool) -> Column:
        return F.collect_list(F.when((F.col("tune") == tune) & ((F.col("quality") > 0) == good), F.struct("level", "n")))

    def upto(pairs: Column, t: Column) -> Column:
        return F.aggregate(F.filter(pairs, lambda p: p["level"] <= t), F.lit(0).cast("long"), lambda a, p: a + p["n"])

    grid_of = F.create_map(*[x for rule, grid in GRIDS.items() for x in (F.lit(rule), F.array(*[F.lit(c) for c in grid]))])
    by_rule = counts.groupBy("stratum", "rule").agg(listed(True, True).alias("good"), listed(True, False).alias("bad"), listed(False, True).alias("held"))
    by_rule = by_rule.withColumn("grid", grid_of[F.col("rule")])
    gains = F.transform("grid", lambda c, t: F.struct((upto(F.col("bad"), t) - GOOD_WEIGHT * upto(F.col("good"), t)).alias("gain"), (-t).alias("least")))
    # the most gain; of equal ones the most lenient
    by_rule = by_rule.withColumn("best", F.array_max(gains)).filter(F.col("best.gain") > 0)
    by_rule = materialise(by_rule, f"{workspace(measured.sparkSession, 'rules')}/wanted")
    tests = by_rule.count()
    used = by_rule.groupBy("stratum").agg(F.count(F.lit(1)).alias("used"))
    by_rule = by_rule.join(used, "stratum").withColumn("alpha", F.lit(risk) / F.col("used")).withColumn("size", upto(F.col("held"), F.lit(1 << 30)))
    trail = F.transform(
        F.sequence(F.lit(0), -F.col("best.least")),
        lambda t: F.struct((binomial_tail(upto(F.col("held"), t), F.col("size"), F.col("alpha")) <= delta / max(1, tests)).alias("ok"), t.alias("t")),
    )
    allowed = F.aggregate(trail, F.lit(0), lambda a, x: F.when(x["ok"] & (a == x["t"]), a + 1).otherwise(a))
    return (
        by_rule.withColumn("allowed", allowed)
        .filter(F.col("allowed") > 0)
        .groupBy("stratum")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", F.get("grid", F.col("allowed") - 1).alias("cutoff"))))).alias("cutoffs"))
    )


def stratum_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds kept. A stratum without cutoffs rejects what fails the base rules only."""
    path = f"{workspace(measured.sparkSession, 'rules')}/cutoffs"
    chosen = materialise(chosen, path).withColumnRenamed("cutoffs", "__cutoffs")
    if chosen.count() <= MAX_BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    over = F.lit(False)
    for rule in GRIDS:
        over = over | F.coalesce(F.col(f"m.{rule}") > F.col("__cutoffs")[rule], F.lit(False))
    return measured.join(chosen, "stratum", "left").withColumn("kept", ~F.col("m.base_failed") & ~over).drop("__cutoffs")


def measure_documents(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, m of every row, as a table below the shared folder."""
    rows = docs.select("doc_id", stratum_of(docs).alias("stratum"), measures(F.col("text")).alias("m"))
    return materialise(rows, f"{workspace(docs.sparkSession, 'rules')}/measures")


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row.

    The strata are the values of lang (one stratum if there is no such column). Null and empty texts
    have no words and fail the base rules; a text is measured whole, however long. Of cutoffs of equal
    gain the most lenient is wanted, and a measure equal to a cutoff is kept. Repeated rows are judged
    one by one; an empty table gives no rows; without labels only the base rules reject. Other columns
    are not read.
    """
    measured = measure_documents(docs)
    out = judged(measured, thresholds(measured, labels))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and no shuffle of texts.

    The rows are written once together with their measures, which are read again for the verdict. Odd
    rows are judged as in apply_rules().
    """
    named = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], "doc_id", stratum_of(docs).alias("stratum"), measures(F.col("text")).alias("m"))
    rows = materialise(rows, f"{workspace(docs.sparkSession, 'rules')}/measured")
    return judged(rows, thresholds(rows, labels)).filter("kept").select(*[F.col(n).alias(c) for c, n in named.items()])
