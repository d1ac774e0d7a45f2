"""Nearest neighbours, the quality classifier and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import ann, cotrain, queries
from llm_words import prose


def nearest_by_hand(rows, every, k):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in {(i, tuple(v)): (i, v) for i, v in valid if i % every == 0}.values():
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in valid if i != q)
        yield q, near[:k]


def check_search(spark, rows, every=5, k=10, least=0.9):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vector string, part int")
    found = {}
    for r in ann.search(df, every, k).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = wanted = 0
    for q, near in nearest_by_hand(rows, every, k):
        mine = sorted(found.pop(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
        wanted += len(near)
    assert not found and hits >= least * wanted


def test_search_finds_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 2000)] + 0.3 * rng.standard_normal((2000, 16))).astype(np.float32)
    x[500:900] = x[500]  # a vector that a fifth of all rows share
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_search(spark, rows, every=7)


def test_search_of_odd_rows(spark):
    rows = [(i, [float(i % 4), 1.0]) for i in range(12)] + [(5, None), (10, [0.0, 0.0]), (15, [1.0, None]), (20, [float("nan"), 1.0]),
                                                           (25, [float("inf"), 1.0]), (None, [1.0, 1.0]), (30, []), (35, [2.0, 1.0])]
    check_search(spark, rows, least=1.0)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    check_search(spark, [(0, [1.0, 2.0])], least=1.0)


def test_balanced_parts_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.1 * rng.standard_normal((64, 4)) for c in 10 * rng.standard_normal((8, 4))])
    graph = ann.neighbours(x, x, 9)[:, 1:]
    part = ann.balanced_parts(graph, 3, rng)
    assert np.bincount(part).tolist() == [64] * 8
    assert (part[graph] == part[:, None]).mean() > 0.9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        text, good, toxic = prose(rng, rng.randint(20, 120)), 1, 0
        if i % 7 == 0:
            text, good = " | ".join(text.split()) + " $$$ ###", 0
        if i % 8 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
            text, toxic = " ".join(words), 1
        rows.append((i, text, "en", f"src{i % 5}", len(text), "x"))
        labels.append((i, good, toxic))
    rows += [(900, None, None, None, None, None), (None, "an idiot | $$$", None, "src1", 3, None), (901, "", "en", None, 0, None)]
    known = [x for x in labels if x[0] % 3] + [(None, 0, 1), (1, None, None), (2, 1, 0), (5000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, judged string").repartition(3)
    return docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), labels


def test_classifier_is_right_on_held_out_rows(labelled):
    docs, known, labels = labelled
    rows = {r["doc_id"]: r for r in cotrain.score_quality(docs, known).collect()}
    assert len(rows) == docs.count()
    unseen = [x for x in labels if x[0] % 3 == 0]
    for column, at in (("quality", 1), ("toxic", 2)):
        right = [(rows[x[0]][column] >= 0.5) == bool(x[at]) for x in unseen]
        assert sum(right) >= 0.97 * len(right)
    assert all(rows[x[0]]["keep"] for x in unseen if x[1] and not x[2]) and not any(rows[x[0]]["keep"] for x in unseen if x[2])
    assert not rows[None]["keep"] and 0 <= rows[900]["score"] <= 1


def test_classifier_without_labels_keeps_all(labelled):
    docs, known, _ = labelled
    assert cotrain.keep_good(docs, known.limit(0)).count() == docs.count()
    assert cotrain.keep_good(docs, known.where("quality = 1 AND toxic = 0")).columns == docs.columns
    assert cotrain.score_quality(docs.limit(0), known).collect() == []


def test_classifier_takes_large_batches_in_pieces():
    """A task holds what Python makes of few rows at a time; a text beyond the size is a piece of its own."""
    texts = ["x" * (cotrain.CHUNK_BYTES // 4), None, ""] * 9 + ["y" * (2 * cotrain.CHUNK_BYTES)] + ["z"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    pieces = list(cotrain._pieces([batch, batch.slice(0, 0)], "text"))
    assert [x for p in pieces for x in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert [x for p in pieces for x in p.column("text").to_pylist()] == texts
    for p in pieces:
        assert sum(len(x or "") for x in p.column("text").to_pylist()[1:]) < cotrain.CHUNK_BYTES


def test_views_teach_each_other():
    """The metadata view learns a mark that labelled rows lack, from rows that the content view is sure of."""
    rng = random.Random(4)
    rows, labels, pool = [], [], []
    for i in range(300):
        bad = i % 2
        rows.append(({"junk", f"w{rng.randint(0, 50)}"} if bad else {f"w{rng.randint(0, 50)}"}, {f"s{rng.randint(0, 9)}"}))
        labels.append(1 - bad)
        pool.append((set(rows[-1][0]), {"site=spam" if bad else "site=fine"}))
    model = cotrain.co_train(rows, np.array(labels), pool, list(range(600)), 2)
    assert model.metadata.weights["site=spam"] < 0 < model.metadata.weights["site=fine"]
    alone = cotrain.co_train(rows, np.array(labels), pool, list(range(600)), 0)
    assert "site=spam" not in alone.metadata.weights


def test_listed_and_tabled_pools_teach_the_same(spark):
    rng = random.Random(5)
    rows = [(cotrain.slots({"junk" if i % 2 else "fine", f"w{rng.randint(0, 50)}"}), cotrain.slots({f"s{rng.randint(0, 9)}"})) for i in range(300)]
    labels, groups = np.array([1 - i % 2 for i in range(300)]), list(range(300))
    # Every listed row is a group of its own; all but the last two thousand are rare words only. The mark lies far beyond any sample.
    pool = [(cotrain.slots({f"x{i}"}), cotrain.slots({"site=plain"})) for i in range(6000)]
    pool += [(cotrain.slots({"junk" if i % 2 else "fine"}), cotrain.slots({"site=spam" if i % 2 else "site=fine"})) for i in range(2000)]
    table = spark.createDataFrame([([i], list(c), list(m)) for i, (c, m) in enumerate(pool, 1000)],
                                  "bands array<long>, content array<int>, metadata array<int>").repartition(5)
    listed = cotrain.co_train(rows, labels, pool, groups + list(range(1000, 9000)), 2)
    tabled = cotrain.co_train(rows, labels, lambda held: cotrain._tabled(table, [g for g, h in zip(groups, held) if h]), groups, 2)
    spam, fine = (cotrain.slots({x})[0] for x in ("site=spam", "site=fine"))
    assert tabled.metadata.weights[spam] < 0 < tabled.metadata.weights[fine]
    for a, b in ((listed.content, tabled.content), (listed.metadata, tabled.metadata)):
        assert a.weights == b.weights and (a.scale, a.shift) == (b.scale, b.shift)
    # Rows that share a band with a held one teach nothing.
    none = cotrain.co_train(rows, labels, lambda held: cotrain._tabled(table, list(range(1000, 9000))), groups, 2)
    assert spam not in none.metadata.weights


def test_pipeline_stages(spark, labelled, tmp_path):
    docs, known, labels = labelled
    rng = random.Random(12)
    item = prose(rng, 30)
    more = [(2000, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (2001, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(rng, 60)), (2002, "") ]
    more[2] = (2002, more[1][1] + " ")
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t), None) for i, t in more], docs.schema)
    docs.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        ids.append({r["doc_id"] for r in rows.select("doc_id").collect()})
    clean = {i for i, good, toxic in labels if good and not toxic}
    assert clean <= ids[0] and not ids[0] & {i for i, _, toxic in labels if toxic}
    assert {2001} <= ids[1] and 2002 not in ids[1] and 2000 in ids[1]
    assert ids[2] == ids[1] - {2000} and ids[3] == ids[2]
    assert "04dbebab" not in rows.where("doc_id = 2001").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[3]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_every_operator_is_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in queries.QUERIES}) == list(range(1, 14))
