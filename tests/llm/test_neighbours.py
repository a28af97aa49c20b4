"""Learned partitions against brute force; the pipeline against its stages."""

import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from test_dedup import brute as plain_groups
from test_dedup import plain_lines
from test_models import plain_cutoffs
from test_tokens import plain_best_fit

from lumenspan.llm import langid, neighbours, packing, quality, simhash
from lumenspan.llm.common import read
from lumenspan.llm.queries import tokenizer_file


def brute(rows, asks, top=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for k in np.flatnonzero(asks(ids)):
        s = (x * x[k]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark):
    e = read(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got: dict = {}
    for r in neighbours.search(e, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1))
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in found if v in exact)
        assert found == sorted(found, key=lambda x: (-x[2], x[1])) or [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)


def test_parts_grow_with_the_rows(spark):
    """Two levels: recall stays, and with every part probed the result is brute force."""
    e = read(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    for goal, least in ((0.95, 0.9), (1.0, 1.0)):
        got: dict = {}
        for r in neighbours.search(e, F.col("vec_id") % 20 == 0, goal=goal, part_rows=120, most_parts=4).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= least * sum(map(len, want.values()))


def test_probes_go_on_until_enough_rows_are_covered():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    child = {p: neighbours.fit(x[p::4], 100, 0.5, 25, 4) for p in range(4)}
    tree = neighbours.Tree(neighbours.fit(x, 400, 0.5, 100, 4), child)
    sizes = np.bincount(tree.home(x), minlength=4 * tree.stride)
    assert sizes.sum() == 400
    for need in (1, 30, 150, 400, 1000):
        for found in tree.probe(x[:20], sizes, np.full(20, need)):
            assert len(set(found.tolist())) == len(found) and sizes[found].sum() >= min(need, 400)


def test_ties_odd_vectors_and_few_rows(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(200, 260)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    odd = [(1000, None), (1020, [0.0] * 3), (1040, [1.0, None, 2.0]), (1060, [1.0, float("nan"), 2.0]), (1080, [float("inf"), 1.0, 1.0]), (None, same), (1100, [1.0, 2.0]), (1120, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("part", F.lit(1)).withColumn("score", F.lit(3))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, goal=1.0).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [v for _, v in sorted(found[200])] == list(range(201, 221))
    assert set(found) == {0, 20, 200, 220, 240}
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]
    assert neighbours.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_get_all_neighbours_there_are(spark):
    # Four far clusters, one of 20 rows: its part alone holds 19 neighbours, enough for the goal in the mean.
    rng = np.random.default_rng(5)
    centres = 20 * np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0]])
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=3)]) for i in range(83)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def counts(d):
        return {r["query_id"]: r["count"] for r in neighbours.search(d, F.col("vec_id") >= 0).groupBy("query_id").count().collect()}

    assert counts(df) == {i: 20 for i in range(83)}
    # Rows of a query's own id are none of its neighbours.
    same = df.withColumn("vec_id", F.expr("if(vec_id % 4 = 0 and vec_id < 40, 500, vec_id)"))
    got = neighbours.search(same, F.col("vec_id") == 500)
    assert {r["query_id"] for r in got.collect()} == {500} and got.where("vec_id = 500").count() == 0 and got.where("rank = 20").count() == 1
    few = neighbours.search(df.where("vec_id < 15"), F.col("vec_id") == 0)
    assert few.count() == 14


def test_recall_on_rows_the_router_has_not_seen():
    if not os.path.isdir("/root/testdata/check_l"):
        pytest.skip("no check_l")
    e = pq.read_table("/root/testdata/check_l/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    x = np.asarray(e["embedding"].combine_chunks().flatten(), np.float64).reshape(e.num_rows, -1)[:12_000]
    router = neighbours.fit(x[::4], len(x), part_rows=750)
    asked = np.flatnonzero(np.arange(len(x)) % 4 == 1)[::10]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    truth = np.argsort(-s, axis=1)[:, : neighbours.TOP]
    ranked = np.argsort(-router.scores(x[asked]), axis=1)[:, : router.probes]
    assert router.probes < len(router.b2) and (router.scores(x).argmax(1)[truth][:, :, None] == ranked[:, None, :]).any(2).mean() >= 0.95


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    graph = neighbours.neighbour_graph(x, 5)
    parts = neighbours.balanced_parts(x, graph, 8)
    assert set(np.bincount(parts)) <= {74, 75, 76}
    cut = lambda p: (p[:, None] != p[graph]).mean()
    assert cut(parts) < 0.8 * cut(np.random.default_rng(1).permutation(parts))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        kept.append(out.cache())
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    counts = [d.count() for d in kept]
    assert counts[1] > 0.98 * counts[0] and counts[2] > 0.8 * counts[1] and counts[3] == counts[2] and counts[4] <= counts[3]
    good = read(spark, sf, "labels").where("quality = 1").join(docs.where("length(text) > 500"), "doc_id")
    stay = good.join(kept[2], "doc_id", "left_semi").count()
    assert stay > 0.95 * good.count()
    assert kept[5].select("doc_id").distinct().count() == counts[4]
    again = pipeline.run(spark, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, kept[5].select(columns).collect()))
    assert again.agg(F.max("sequence_id")).first() == kept[5].agg(F.max("sequence_id")).first()
    assert sorted(map(tuple, again.select(columns).collect())) == plain_pipeline(docs, read(spark, sf, "labels"))
    lengths = [r["length"] for r in again.select("length").collect()]
    assert again.select("sequence_id").distinct().count() == len(plain_best_fit(lengths, 2048))


def plain_pipeline(docs, labels):
    """All five stages in plain code, on rows: only the language model and the tokenizer are the library's own."""
    net, rows = langid.train(docs), {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    said = {i: langid.predict_texts(net, [t]) for i, (t, _) in rows.items()}
    rows = {i: r for i, r in rows.items() if said[i][0][0] != "und" and said[i][1][0] >= 0.5}
    good, judged = {r["doc_id"] for r in labels.where("quality = 1").collect()}, {}
    for i, (t, lang) in rows.items():
        words, chars, symbols, dup, repeat, shouts = quality.base_counts(t)
        n = max(1, words)
        values = {"symbol_share": symbols / n, "repeat_share": repeat / n, "dup_line_share": dup / max(1, t.count("\n") + 1), "long_word": chars / n, "shout_share": shouts / n}
        judged[i] = lang, values, words < quality.MIN_WORDS or 100 * repeat > quality.REPEAT_PERCENT * words
    cutoffs = plain_cutoffs([(s, v) for i, (s, v, failed) in judged.items() if i in good and not failed], good)
    texts = [(i, rows[i][0]) for i, (s, v, failed) in judged.items() if not failed and not any(v[r] > cutoffs.get((s, r), float("inf")) for r in v)]
    texts = [(i, t) for i, t, _, _ in plain_lines(texts)]
    marks = {i: simhash.fingerprint(t) for i, t in texts}
    fps = sorted(set(marks.values()))
    group, least = plain_groups(fps), {}
    for i, m in marks.items():
        c = group[fps.index(m)]
        least[c] = min(least.get(c, i), i)
    encode, out = packing.document_ids(tokenizer_file("word_bpe_49k.json")), []
    for i, t in texts:
        if i in set(least.values()):
            ids = encode([t])[0]
            out += [(i, n, at // 4, len(c) // 4, zlib.crc32(c)) for n, at in enumerate(range(0, len(ids), 8192)) for c in [ids[at : at + 8192]]]
    return sorted(out)
