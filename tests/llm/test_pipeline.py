from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_mixing
import test_quality_rules as tq
import test_simhash

from deckframe.llm import decontaminate, quality_rules
from deckframe.plans import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(20)) + ". " + " ".join(some(6)) + ".") for i in range(10)]
    rows = []
    for i in range(300):
        lines = [" ".join(some(rnd.choice([6, 30, 60]))) for _ in range(rnd.randrange(1, 5))]
        if rnd.random() < 0.3:
            lines.append("read more on our site")
        if i % 17 == 0:
            lines.insert(0, rnd.choice(items)[1])
        text = "\n".join(lines)
        if i % 9 == 0:
            text = " ".join(f"{w}$$$" for w in text.split())
        if i % 13 == 0 and rows:
            text = rows[-2][1]
        rows.append((i, text, "en", rnd.choice(["a", "a", "b", None]), len(text), 1))
    rows += [(None, "no id " + " ".join(some(40)), None, None, None, None), (500, None, "en", "a", 0, 1), (501, "", "en", "a", 0, 1), rows[4], rows[4], (502, " ".join(some(40000)), "en", "b", 9, 2)]
    out = tmp_path_factory.mktemp("pipeline")
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{out}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars long, size int", "documents")
    write([(i, int(i % 9 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return str(out), items


def test_stages_against_brute_force(spark, folder):
    out, items = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{out}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        sizes.append(len(before))
        docs = stored(stage(spark, docs, out), f"test-{name}")
        after = [tuple(r) for r in docs.collect()]
        if name != "mixing":
            assert docs.columns == COLUMNS
        if name == "quality_rules":
            raw, target = Counter(), Counter()
            for r in before:
                raw.update(tq.grams(r[1]))
                if labels.get(r[0]) == 1:
                    target.update(tq.grams(r[1]))
            ratio = lambda b: tq.math.log((target[b] + 1) / (sum(target.values()) + 2 * quality_rules.BUCKETS)) - tq.math.log((raw[b] + 1) / (sum(raw.values()) + 2 * quality_rules.BUCKETS))  # noqa: E731, B023
            table = {b: ratio(b) for b in raw}
            want = [r for r in before if not tq.base(r[1])[-1] and sum(table[b] for b in tq.grams(r[1])) / len(tq.grams(r[1])) >= quality_rules.MIN_LLR]
        elif name == "line_dedup":
            cleaned = test_line_dedup.brute([(i, r[3], r[1]) for i, r in enumerate(before)])
            new = {i: (t, gone) for i, t, _, gone in cleaned}
            want = [(r[0], new[i][0], r[2], r[3], len(new[i][0]) if new[i][1] else r[4], r[5]) for i, r in enumerate(before)]
            assert any(gone for _, gone in new.values())
        elif name == "simhash_near_dedup":
            groups = test_simhash.brute([(r[0], r[1]) for r in before])
            keep = {c for _, _, c in groups if c is not None}
            want = list({repr(r): r for r in before if r[0] in keep or r[0] is None}.values())
        elif name == "benchmark_decontamination":
            hits = test_decontaminate.brute(items, [(i, r[1]) for i, r in enumerate(before)])
            want = [r for i, r in enumerate(before) if not hits[i]]
            assert len(want) < len(before)
        else:
            assert docs.columns[:6] == COLUMNS and len(docs.columns) == 10
            size = Counter()
            for r in before:
                size[r[3]] += len((r[1] or "").split())
            targets = test_mixing.targets(size)
            taken = Counter()
            for r in after:
                assert r[6] == len(r[1].split()) and r[8] == pytest.approx(targets[r[3]]) and r[9] in (r[6], 2 * r[6])
                taken[r[3]] += r[9]
            longest = max(len((r[1] or "").split()) for r in before)
            assert all(abs(taken[s] - targets[s]) <= 2 * longest for s in size)
            assert {repr(r[:6]) for r in after} <= {repr(r) for r in before}
            continue
        assert sorted(map(repr, after)) == sorted(map(repr, want))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]


def test_empty_tables_stay_empty(spark, folder):
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, out), "test-empty")
        assert docs.count() == 0
    assert decontaminate.MIN_OVERLAP == 0.8


def test_run_is_the_stages_in_a_row(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and {"doc_id", "text", "taken"} <= set(df.columns)
