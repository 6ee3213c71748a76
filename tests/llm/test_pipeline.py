"""The pipeline stage by stage against brute force, and registered queries on a small folder of tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm import crf, packing
from plumbline.llm.common import FIT_BYTES, counted, labelled_sample, settled
from plumbline.llm.registry import QUERIES

from .test_operators import brute_jaccard, fill

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(8), tmp_path_factory.mktemp("tables")
    words = ["the", "river", "runs", "to", "seas", "and", "hills", "green", "under", "sky", "old", "stone", "bridge"]
    good = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randint(6, 40))) + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(" ".join(rng.choices(["BUYING!!", "LOUDER###", "winner$$$"], k=9)) for _ in range(4))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", f"s{i % 3}", 0) for i in range(160)]
    rows += [(200 + i, rows[4 * i + 1][1], "en", "s0", 0) for i in range(9)]
    rows += [(220 + i, rows[4 * i + 2][1].replace("river", "rivers", 1), "en", "s1", 0) for i in range(9)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n ", "en", None, 3)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", "<p>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    field = crf.fit(labelled_sample(docs, spark.read.parquet(f"{tables}/labels.parquet"), "quality", crf.MOD, crf.HELD, crf.FIT_ROWS))
    stages, kept = dict(corpus_pipeline.STAGES), docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]

    kept = stages["quality"](spark, docs, tables).cache()
    want = {r.doc_id for r in docs.collect() if field.score([r.text])[0] >= crf.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns and 0 < len(want) < docs.count()
    assert all(i % 4 for i in want if i < 160)

    before = {r.doc_id: r.text for r in kept.collect()}
    kept = stages["lines"](spark, kept, tables).cache()
    assert kept.columns == docs.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    assert not {200 + i for i in range(9) if 4 * i + 1 in before and count(before[4 * i + 1]) >= 25} & set(after)
    lines = lambda texts: {x for t in texts for x in (t or "").split("\n") if x.strip()}
    assert lines(after.values()) == lines(before.values())

    kept = stages["near_duplicates"](spark, kept, tables).cache()
    root = brute_jaccard({t or "" for t in after.values()})
    leads = {}
    for i, t in sorted(after.items()):
        leads.setdefault(root[t or ""], i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(leads.values())

    sizes, largest = Counter(), Counter()
    for r in kept.collect():
        sizes[r.source] += count(r.text)
        largest[r.source] = max(largest[r.source], count(r.text))
    kept = stages["mix"](spark, kept, tables).cache()
    taken, target = Counter(), fill(dict(sizes))
    for r in kept.collect():
        taken[r.source] += count(r.text)
    assert kept.columns == docs.columns and all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)

    encoder = packing.Encoder(packing.tokenizer_path())
    tokens = sum(len(encoder.encode(r.text or "")) // 4 + 1 for r in kept.collect())
    assert sum(r.length for r in stages["pack"](spark, kept, tables).collect()) == tokens
    assert sum(r.length for r in corpus_pipeline.run(spark, tables).collect()) == tokens


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries(spark, tables):
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    for name, query in QUERIES.items():
        rows = query(spark, tables).count()
        assert rows == (1 if name.startswith("op1_") else n), name


def test_settled_counts_without_a_query(spark):
    """Each query with an exchange keeps threads, and so memory, of the driver for a minute; counts of checkpoints need none."""
    store = spark._jsparkSession.sharedState().statusStore()
    for rows, parts in ((0, 1), (7, 1), (7, 4)):
        frame, before = spark.range(rows).repartition(2), store.executionsCount()
        got = settled(frame, rows // parts + 1 if parts > 1 else 100)
        assert counted(got) == rows and got.rdd.getNumPartitions() <= parts
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert store.executionsCount() - before == 1  # the checkpoint itself
        assert sorted(r.id for r in got.collect()) == list(range(rows))


def test_near_duplicates_queries(spark, tables):
    """Steps that have nothing to do aren't run: no pairs, no links, or one partner each."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(30)), "en", "s", 0) for i in range(12)], COLUMNS)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    kept = corpus_pipeline.near_duplicates(spark, docs, tables)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before <= 20
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))


def test_sample_of_long_texts(spark):
    """Rows alone don't bound a sample: texts of 1 MB, one of 9, and a label of which no text fits."""
    length = "case when id = 5 then 9000000 when id % 2 = 1 then 1000000 + id else 10000000 + id end"
    docs = spark.range(1, 41).selectExpr("id as doc_id", f"repeat('a', int({length})) as text")
    labels = spark.range(1, 41).selectExpr("id as doc_id", "int(id % 2) as quality")
    got = labelled_sample(docs, labels, "quality", crf.MOD, -1, crf.FIT_ROWS)
    assert got["text"].str.len().where(got["label"] == 1, 0).sum() <= FIT_BYTES // 2
    assert sorted(got["label"]) == [0] + [1] * 8 and got["doc_id"].where(got["label"] == 0).min() == 2
    few = labelled_sample(docs.where("doc_id in (1, 3)"), labels, "quality", crf.MOD, -1, crf.FIT_ROWS)
    assert few["doc_id"].tolist() == [1, 3] and few["text"].str.len().tolist() == [1_000_001, 1_000_003]
