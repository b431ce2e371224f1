"""Operators 4 and 10, and the pipeline."""
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from revspark.llm import ann, toxicity
from revspark.llm.exact_dedup import exact_dedup
from test_dedup import brute_near


def in_order(a, b):
    """Inner product in double precision, added up from the first component on (sum() would compensate)."""
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        out += x * y
    return out


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).astype("f4")
    v[50] = v[60] = v[70]
    v[90] *= 1000
    v[100:110] *= 1e-30
    rows = [(int(k), [float(x) for x in r], "a") for k, r in enumerate(v)]
    rows += [(1000, None, "b"), (1020, [], "b"), (1040, [0.0] * 16, "b"), (1060, [1.0] * 15 + [float("nan")], "b"), (1080, [1.0] * 15 + [float("inf")], "b"),
             (1100, [None] + [1.0] * 15, "b"), (None, [1.0] * 16, "b"), (1120, [1.0, 2.0], "c"), (1121, [3.0, 4.0], "c"), (5, [float(x) for x in v[5]], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    ann_cells, ann.CELL_CANDIDATES = ann.CELL_CANDIDATES, 100 * 16
    try:
        got = ann.nearest(df, k=20, every=20).collect()
    finally:
        ann.CELL_CANDIDATES = ann_cells
    want = []
    for q in range(0, 400, 20):
        # row 5 stands in the table twice
        s = [(-in_order(v[q], v[c]), c) for c in [*range(400), 5] if c != q]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(sorted(s)[:20])]
    want += [(1120, 1, 1121, 11.0)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert ann.nearest(df.limit(0)).collect() == []


def test_nearest_of_repeated_rows_and_overflow(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 1.0]), (20, [1e200, 1.0]), (21, [-1e200, 1.0]), (22, [1e200, 5.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 20, 1e200 + 2), (2, 22, 1e200 + 10), (3, 1, 5.0), (4, 1, 5.0)]
    assert sorted(got[20])[:3] == [(1, 22, float("inf")), (2, 1, 3e200 + 1), (3, 1, 3e200 + 1)]


def toxic_corpus(spark, label=lambda insult, group: insult and group):
    """A label that depends on a pair: an insult counts only where a group is named."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1500):
        ws = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 80))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws += ["insultxx"] * insult + ["groupyyy"] * group
        rng.shuffle(ws)
        rows.append((k, " ".join(ws)))
        labels.append((k, int(label(insult, group))))
    rows += [(5000, None), (5001, ""), (5002, "groupyyy " * 20000 + "insultxx"), (None, "insultxx")]
    labels += [(None, 1), (5001, None), (9999, 1)]
    return (spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_learns_a_pair_and_never_the_held_out_labels(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.toxicity(docs, docs, labels).collect()
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict((r.doc_id, r.toxic) for r in labels.collect())
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # Held-out labels turned round change nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, docs, turned).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_toxicity_learns_what_only_the_pair_decides(spark):
    """Either word alone says nothing: the label is that exactly one of them is there."""
    docs, labels = toxic_corpus(spark, lambda insult, group: insult != group)
    truth = dict((r.doc_id, r.toxic) for r in labels.collect())
    held = [r for r in toxicity.toxicity(docs, docs, labels).collect() if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_toxicity_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 3 * F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, rows=100).collect()
    assert 0 < len(got) <= 100


def test_factorization_machine_score_and_gradient():
    """Scores by the double sum over pairs; the first training step follows the numerical gradient."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(np.arange(6), rng.normal(size=7), rng.normal(size=(7, toxicity.FACTORS)))
    rows = [np.array([0, 2, 5]), np.array([], np.int64), np.array([1]), np.array([0, 1, 2, 3, 4, 5])]

    def plain(w, v, f):
        f = [*f, 6]
        z = sum(w[i] for i in f) + sum(float(v[f[i]] @ v[f[j]]) for i in range(len(f)) for j in range(i))
        return 1 / (1 + np.exp(-z))

    assert np.allclose(model.scores(rows), [plain(model.w, model.v, f) for f in rows])
    y = np.array([True, False, True, False])
    idx, seg, starts = toxicity._flat(rows, 6)
    gw, gv = toxicity.gradient(model.w, model.v, idx, seg, starts, y)

    def loss(w, v):
        p = np.array([plain(w, v, f) for f in rows])
        return -np.mean(np.where(y, np.log(p), np.log(1 - p)))

    for at in [(3,), (6,), (0,)]:
        step = np.zeros_like(model.w)
        step[at] = 1e-6
        assert abs((loss(model.w + step, model.v) - loss(model.w - step, model.v)) / 2e-6 - gw[at]) < 1e-5
    for at in [(2, 1), (5, 7), (1, 0)]:
        step = np.zeros_like(model.v)
        step[at] = 1e-6
        assert abs((loss(model.w, model.v + step) - loss(model.w, model.v - step)) / 2e-6 - gv[at]) < 1e-5


def test_toxicity_without_labels_or_documents(spark, empty):
    docs, labels = toxic_corpus(spark)
    assert {r.score for r in toxicity.toxicity(docs.limit(5), docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, docs, labels).collect() == []


def test_pipeline_stages_keep_columns_and_clean_rows(spark, messy, tmp_path):
    docs, labels = toxic_corpus(spark)
    both = docs.select("doc_id", "text").withColumn("lang", F.lit("en")).unionByName(messy.select((F.col("doc_id") + 20000).alias("doc_id"), "text").withColumn("lang", F.lit("xx")))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang"], name
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now)
    assert seen[0].filter("doc_id is null or doc_id in (5000, 5001)").count() == 3
    groups = exact_dedup(seen[0]).select("text_sha256").distinct().count()
    assert seen[1].count() == groups
    kept = {r.doc_id for r in seen[2].collect()}
    rows = [(r.doc_id, r.text) for r in seen[1].collect()]
    want = {c for _, c in brute_near([r for r in rows if r[0] is not None], 5, 80).values()}
    assert kept == want | {i for i, _ in rows if i is None} and len(kept) < len(rows)
    assert seen[3].count() == seen[2].count()
    assert {r.doc_id for r in seen[4].collect()} == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_near_stage_compares_rows_not_ids(spark):
    rng = random.Random(17)
    a, b, c, d = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(4))
    text = lambda ws, *more: " ".join([*ws, *more])
    rows = [
        (5, text(a)), (5, text(b)),               # one id, two texts: both are looked at
        (7, text(a, "x")), (8, text(b, "x")),     # near copies of one and of the other
        (3, text(c)), (9, text(c, "y")), (9, text(d)),  # id 9: one text is a near copy, the other is not
        (None, text(d, "z")),                     # near copy of a row with an id
        (None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 n6"),  # near copies among rows without an id
        (None, None), (None, ""), (11, None),     # no words: alone
    ]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_stage(spark, df, "")
    assert out.columns == df.columns
    want = [rows[k] for k in (0, 1, 4, 6, 8, 10, 11, 12)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
