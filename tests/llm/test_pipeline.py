import random
import string
import unicodedata
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontaminate, mixing, near_dedup, quality_rules, token_tables
from weftline.llm.common import Words, workspace
from weftline.llm.queries import tokenizer_path

from .conftest import SCHEMA, prose, rows
from .test_corpus import WORD, components_of


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The tables a run reads, with junk, copies and a leaked benchmark item."""
    folder = str(tmp_path_factory.mktemp("sf"))
    item = "Which of the many small rivers of the north is the one that all the old maps forget to name at last?"
    data = [*rows(7, 80), *((200 + i, f"tail {item} number {i}", "en", "src1", 5, 1, "x", 1) for i in range(3))]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    """Each stage against the operator's own decisions on that stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    path = workspace(spark, "t")
    checks = {
        "quality_rules": lambda d: {r.doc_id for r in quality_rules.apply_rules(d, labels).filter("kept").collect()},
        "near_duplicates": lambda d: {r.doc_id for r in near_dedup.near_duplicates(d).filter("kept").collect()},
        "decontamination": lambda d: {r.doc_id for r in decontaminate.contaminated(d, bench).filter("not contaminated").collect()},
        "mixture": lambda d: {r.doc_id for r in mixing.mixed(d).filter("kept").collect()},
        "token_output": lambda d: {r.doc_id for r in d.collect()},
    }
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        assert {r.doc_id for r in out.collect()} == checks[name](docs), name
        if name != "token_output":
            assert out.columns == docs.columns
            assert set(out.collect()) <= set(docs.collect())
            docs = out
    assert not {200, 201, 202} & {r.doc_id for r in docs.collect()}


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty documents, labels and benchmark; and odd rows through every stage."""
    folder = str(tmp_path)
    odd = spark.createDataFrame(rows(), SCHEMA)
    odd.write.parquet(f"{folder}/full/documents.parquet")
    odd.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for place in ("full", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{place}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/{place}/benchmark.parquet")
    before = spark.read.parquet(f"{folder}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, spark.read.parquet(f"{folder}/none/documents.parquet"), f"{folder}/none")
        assert none.count() == 0
        if name != "token_output":
            assert none.columns == before.columns
            assert not Counter(stage(spark, before, f"{folder}/full").collect()) - Counter(before.collect()), name
    assert stage(spark, before, f"{folder}/full").count() == before.count()


def test_ids_survive_the_file():
    assert np.frombuffer(token_tables.encoder(open(tokenizer_path(), encoding="utf-8").read()).encode(["a b"])[0], "<u2").tolist()[-1] == 0


# ------------------------------------------------------------------ all stages in plain Python
def plain_cutoffs(measures, strata, quality, tune):
    """{(stratum, rule): cutoff} of labelled texts; each argument maps doc_id."""
    wanted = {}
    for stratum in set(strata.values()):
        known = [d for d in quality if strata[d] == stratum and not measures[d]["base_failed"]]
        for rule, grid in quality_rules.GRIDS.items():
            def over(t, which):
                return sum(measures[d][rule] > grid[t] for d in which)

            bad = [d for d in known if tune[d] and not quality[d]]
            good = [d for d in known if tune[d] and quality[d]]
            gains = [over(t, bad) - quality_rules.GOOD_WEIGHT * over(t, good) for t in range(len(grid))]
            if known and max(gains) > 0:
                held = [d for d in known if not tune[d] and quality[d]]
                wanted[stratum, rule] = (gains.index(max(gains)), [over(t, held) for t in range(len(grid))], len(held))
    out = {}
    for (stratum, rule), (best, rejected, n) in wanted.items():
        p = quality_rules.RISK / sum(s == stratum for s, _ in wanted)
        for t in range(best + 1):
            k = rejected[t]
            tail = 1.0 if k >= n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            if tail > quality_rules.DELTA / len(wanted):
                break
            out[stratum, rule] = quality_rules.GRIDS[rule][t]
    return out


def plain_measures(text):
    w = WORD.findall(text)
    chars, lines = sum(map(len, w)), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = len({j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
    return {
        "base_failed": len(w) < 20 or 100 * repeated > 30 * len(w),
        "symbol_share": sum(text.count(c) for c in "#*$%&|<>") / max(1, chars),
        "capital_share": sum(unicodedata.category(c) == "Lu" for c in text) / max(1, chars),
        "bang_share": sum(text.count(c) for c in "!?") / max(1, chars),
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "repeat_share": repeated / max(1, len(w)),
        "mean_word_chars": chars / max(1, len(w)),
        "word_density": len(w) / max(1, chars),
    }


def plain_leak(text, item):
    """For texts without numbers, names and units."""
    w, x = ([t.strip(string.punctuation).lower() for t in WORD.findall(s)] for s in (text, item))
    for shift in range(-len(x), len(w)):
        same = [0 <= shift + i and x[i : i + 5] == w[shift + i : shift + i + 5] for i in range(len(x) - 4)]
        runs = "".join("x" if s else " " for s in same).split()
        if sum(same) >= 0.8 * len(same) or max(map(len, runs), default=0) + 4 >= 13:
            return True
    return False


def plain_chances(cells, keep):
    """min(1, product of a factor per category) with tempered margins, each factor found by bisection."""
    total, u = sum(cells.values()), dict.fromkeys(cells, keep)
    for _ in range(60):
        for m in range(3):
            sums = Counter()
            for c, n in cells.items():
                sums[c[m]] += n
            raised = {c: n**mixing.TEMPERATURE for c, n in sums.items()}
            for name in sums:
                goal, own = keep * total * raised[name] / sum(raised.values()), [c for c in cells if c[m] == name]
                low, high = 0.0, 1e6
                for _ in range(70):
                    f = (low + high) / 2
                    low, high = (f, high) if sum(min(1, f * u[c]) * cells[c] for c in own) < goal else (low, f)
                u.update({c: u[c] * low for c in own})
    return {c: min(1.0, x) for c, x in u.items()}


def test_run_against_plain_python(spark, tmp_path_factory):
    """All rows of run(), each stage written out in plain Python; doc_ids are distinct."""
    from tokenizers import Tokenizer

    folder = str(tmp_path_factory.mktemp("plain"))
    rng = random.Random(11)
    texts = {i: prose(rng, rng.randint(15, 60)) for i in range(700)}
    for i in range(0, 700, 4):
        texts[i] = texts[i].replace("e", "e%%%")  # bad ones
    item = prose(rng, 24)
    for i in range(5, 700, 40):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts[i + 1] = " ".join(words) if i % 80 == 5 else texts[i]
        texts[i + 6] += f" {item} and more of it"
    meta = {i: ("en" if i % 7 else "fr", f"src{min(2, i % 5)}") for i in texts}
    quality = {i: int(i % 4 > 0) for i in texts if i % 10}
    spark.createDataFrame([(i, t, *meta[i], len(t), 7, "x", 1) for i, t in texts.items()], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    drawn = spark.range(700).select("id", mixing.chance(F.col("id")).alias("chance"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)) == 0).alias("tune")).collect()
    chance, tune = {r.id: r.chance for r in drawn}, {r.id: r.tune for r in drawn}

    measures = {i: plain_measures(t) for i, t in texts.items()}
    cutoffs = plain_cutoffs(measures, {i: m[0] for i, m in meta.items()}, quality, tune)
    assert cutoffs
    left = [i for i in texts if not measures[i]["base_failed"] and not any(measures[i][rule] > x for (s, rule), x in cutoffs.items() if s == meta[i][0])]
    sizes = [len(texts), len(left)]
    kept = components_of([(i, texts[i]) for i in left])
    left = [i for i in left if kept[i][2]]
    sizes.append(len(left))
    left = [i for i in left if not plain_leak(texts[i], item)]
    sizes.append(len(left))
    cell, cells = {}, Counter()
    fitted = mixing.fit_topics(spark.createDataFrame([(i, texts[i], meta[i][0]) for i in left], "doc_id long, text string, lang string"))
    for i in left:
        raw = np.frombuffer(texts[i].lower().encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        buckets = [int(h % np.uint64(mixing.TOPIC_WORDS)) for h, n in zip(words.hashes(), words.end - words.start) if n >= 5]
        scores = [sum(fitted.weight[x, k] for x in buckets) / max(1, len(buckets)) - fitted.usual[meta[i][0]][k] for k in range(mixing.TOPICS)]
        cell[i] = (meta[i][1], meta[i][0], str(max(range(mixing.TOPICS), key=lambda k: (scores[k], -k))) if buckets else "0")
        cells[cell[i]] += len(WORD.findall(texts[i]))
    chances = plain_chances(cells, mixing.KEEP)
    left = [i for i in left if chance[i] < chances[cell[i]]]
    sizes.append(len(left))
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and left

    coder, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in sorted(left):
        ids = [*coder.encode(texts[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
