import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from prosemill.llm import common
from prosemill.llm.common import components
from prosemill.llm.op6_url_lists import judge
from prosemill.llm.op7_minhash import VALUES, _least, band_keys, jaccard_at_least, near_duplicates, rows_for, shingle_set, signature
from prosemill.llm import op8_embeddings
from prosemill.llm.op8_embeddings import near_vectors
from prosemill.llm.op10_chat import digests, format_conversations, read_turns, render
from tests.llm.conftest import SF
from tests.oracle import compare


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", ["op6_url_filter", "op10_chat_format"])
def test_sql_says_the_same(spark, name):
    got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    f = Forest({x for e in edges for x in e})
    for a, b in edges:
        f.union(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: f.find(n) for n in f.up if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [40, 100_000])
def test_components_of_few_and_of_many_vertices(spark, monkeypatch, most):
    """Chains against the order of ids, trees and a hub, with and without minima that are broadcast."""
    monkeypatch.setattr(common, "HUBS_MOST", most)
    monkeypatch.setattr(common, "HUB", 8)
    rng = random.Random(3)
    order = rng.sample(range(1000), 80)
    edges = [*zip(order, order[1:]), *((2000 + i, 2000 + i // 3) for i in range(1, 90)), *((3500, 3500 + i) for i in range(-40, 40)), (2050, 3470)]
    rng.shuffle(edges)
    f = Forest({x for e in edges for x in e})
    for a, b in edges:
        f.union(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted((n, f.find(n)) for n in f.up)


def test_rounds_of_components_end_with_stars_and_shuffle_little(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, path=None, lasting=False, f=common.materialize: (written.append(df._jdf.queryExecution().executedPlan().toString()), f(df, path, lasting))[1])
    stars = [(10 * i + k, 10 * i) for i in range(30) for k in range(1, 9)]
    assert components(spark.createDataFrame(stars, "a long, b long")).count() == 270
    assert len(written) == 1  # united within tasks, and no round
    written.clear()
    chain = [(i, i + 1) for i in range(60)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long").repartition(20)).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(written) > 1 and not any("SortMergeJoin" in plan for plan in written)  # few vertices: minima go to the edges


def by_all_pairs(rows, n, percent):
    """(doc_id, n_shingles, component_id, kept) from all pairs of rows; rows of one id are one vertex."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    f = Forest({i for i, _ in rows})
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if f.find(i) != f.find(j) and jaccard_at_least(a, b, percent):
                f.union(i, j)
    return sorted((i, len(s), f.find(i), f.find(i) == i) for i, s in sets)


def copies(rng, words, groups, each, edits):
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n,percent,block", [(3, 85, 512), (5, 80, 512), (3, 85, 4), (5, 80, 3)])
def test_near_duplicates_against_all_pairs(spark, n, percent, block):
    rng = random.Random(n + block)
    docs = copies(rng, [f"w{i}" for i in range(4000)], 12, 8, 8) + [None, "", "  \n", "One two", "one TWO", "one"]
    rows = [(100 - i, t) for i, t in enumerate(docs)]
    rows += [(1, rows[20][1]), (1, rows[60][1]), (50, docs[3]), (50, docs[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in near_duplicates(df, n, percent, block=block).collect())
    assert got == by_all_pairs(rows, n, percent)


def test_scratch_tables_are_deleted(spark):
    """Only what the returned plans read is left in the shared folder."""
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    rows = near_duplicates(spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(30)], "doc_id long, text string"), 3, 60)
    vectors = near_vectors(spark.createDataFrame([(i, [1.0, i / 100.0], 1) for i in range(30)], "vec_id long, embedding array<double>, label int"))
    assert len([x for x in set(os.listdir(base)) - before if not x.startswith(".")]) == 3 and rows.count() == 30 and vectors.count() == 30


def test_rows_of_one_id_join_their_texts(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(120)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "apart from all others")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_a_large_group_of_several_blocks(spark):
    """1,300 different near copies around three texts that share a third of their words, and chains at the threshold."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for g, m in enumerate((1100, 150, 50)):
        base = shared + [rng.choice(words) for _ in range(60)]
        for _ in range(m):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(60, len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in near_duplicates(df, 3, 85, block=200).collect())
    assert got == by_all_pairs(rows, 3, 85)


def test_bands_and_estimate_lose_less_than_stated():
    from math import comb

    for percent in (80, 85, 90):
        t, r = percent / 100, rows_for(percent)
        assert (1 - t**r) ** (VALUES // r) <= 1e-6
        for n in (VALUES, VALUES // 3):
            assert sum(comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(int(np.ceil(_least(percent, n))))) < 2e-6


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.doc_id in (3, 4)} == {3} and all(r.kept for r in rows if r.doc_id in (0, 1, 2))
    assert near_duplicates(empty).count() == 0


def test_min_max_signature_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.15 and band_keys(np.stack([signature(a), signature(b)]), 5).shape == (2, 24)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (1, 2):
        for c in range(25):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, (base + rng.standard_normal(16) * 0.15 * rng.random()).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 1), (n + 1, None, 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None, 1.0], 1), (n + 5, rows[0][1], None), (n + 6, [1.0, 0.0], 1), (n + 7, [1e300] * 16, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), passes=6).collect()}
    good = {i: (np.array(v) / np.abs(v).max(), l) for i, v, l in rows if l is not None and v is not None and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    f, links = Forest([r[0] for r in rows]), {r[0]: 0 for r in rows}
    ids = list(good)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (x, l), (y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                f.union(a, b)
                links[a] += 1
                links[b] += 1
    assert got == {i: (links[i], f.find(i), f.find(i) == i) for i in links}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), passes=2).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int"


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_dense_group_keeps_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    x = unit_rows(base / np.linalg.norm(base) + rng.standard_normal((10_000, 64)) * 0.015)
    assert (x[:2000] @ x.T).min() > 0.93 and op8_embeddings.plan(10_000, 0.93)[1] > 2
    rows = near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(9999, 0)} and len(rows) == 10_000


def test_large_label_finds_its_pairs(spark):
    """20,000 vectors in groups around the threshold, in the passes that a label of this size has: recall against all pairs."""
    rng = np.random.default_rng(9)
    x = unit_rows(np.concatenate([rng.standard_normal((1, 64)) + rng.standard_normal((8, 64)) * 0.26 for _ in range(2500)]))
    true = np.concatenate([(x[k : k + 2000] @ x.T >= 0.93).sum(1) - 1 for k in range(0, len(x), 2000)])
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert true.sum() > 20_000 and (found <= true).all() and found.sum() >= 0.999 * true.sum()


@pytest.mark.parametrize(("block", "compare"), [(64, 3.0), (8, 0.03), (16, 30.0)])
def test_passes_and_windows_find_all_pairs(spark, monkeypatch, block, compare):
    monkeypatch.setattr(op8_embeddings, "COMPARE", compare)
    monkeypatch.setattr(op8_embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = unit_rows(np.concatenate([rng.standard_normal((1, 32)) + rng.standard_normal((k, 32)) * 0.2 for k in rng.integers(1, 60, 30)]))
    near = x @ x.T >= 0.93
    assert op8_embeddings.plan(len(x), 0.93)[1] > 2
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)).collect()}
    assert near.sum() > 2 * len(x) and [got[i] for i in range(len(x))] == (near.sum(1) - 1).tolist()


def test_windows_alone_count_a_pair_once(spark, monkeypatch):
    """Codes so long that near vectors rarely share one: pairs come from the windows of several passes."""
    monkeypatch.setattr(op8_embeddings, "BLOCK", 16)
    monkeypatch.setattr(op8_embeddings, "plan", lambda n, threshold, passes=1: (32, 9))
    rng = np.random.default_rng(6)
    x = unit_rows(np.concatenate([rng.standard_normal((1, 32)) + rng.standard_normal((4, 32)) * 0.2 for _ in range(40)]))
    near = (x @ x.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist(), i % 1) for i, v in enumerate(x)], VECTORS)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near).all() and found.sum() >= 0.9 * near.sum() > 100


def test_rows_that_repeat_an_id_keep_their_links(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1), (5, None, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (5, 0, 5, True)]


@pytest.mark.parametrize("n", [2 * 10**3, 10**5, 10**7, 10**9])
def test_passes_follow_the_size(n):
    bits, passes = op8_embeddings.plan(n, 0.93)
    agree = 1 - np.arccos(0.93) / np.pi
    assert (1 - agree**bits) ** passes <= 1e-6 and bits >= op8_embeddings.BITS_LEAST and op8_embeddings.plan(10, 0.93)[1] == op8_embeddings.PASSES_LEAST


def test_opposite_vectors_link_at_the_lowest_threshold(spark):
    rows = near_vectors(spark.createDataFrame([(i, [float(i % 2 * 2 - 1), i / 5000], 1) for i in range(1100)], VECTORS), threshold=-1.0).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(1099, 0)}


def test_url_lists_as_of(spark):
    caps = [(1, "http://a.x.org/p", 9), (2, "http://a.x.org/p", 10), (3, "https://u@A.x.ORG:80", 20), (4, "http://b.x.org", 15), (5, None, 15), (6, "nonsense", 15), (7, "http://a.x.org/p", None), (8, "http://x.org./", 10), (8, "http://x.org./", 10)]
    entries = [("x.org", 10, "block"), ("a.x.org", 20, "allow"), ("a.x.org", 20, "allow"), ("x.org", 30, "allow"), (None, 1, "block"), ("x.org", None, "block")]
    df = spark.createDataFrame(caps, "page_id long, url string, fetch_day int").withColumn("host", judge.__globals__["F"].lit("mine"))
    out = judge(df, spark.createDataFrame(entries, "domain string, day int, action string"))
    rows = sorted((r.page_id, r.blocked, r.listed_domain) for r in out.collect())
    assert [r[:2] for r in rows] == [(1, False), (2, True), (3, False), (4, True), (5, False), (6, False), (7, False), (8, True), (8, True)]
    assert {r[0]: r[2] for r in rows}[3] == "a.x.org" and out.columns.count("host") == 1


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi <||"), (1, 2, "assistant", "<|im_start|>yes"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "alone"), (3, 5, None, "a"), (3, 5, "assistant", "b"), (None, 0, "as\nsistant<|", "c"), (1, 9, "assistant", "end")]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = sorted(((r.conv_id, r.pos, r.role, r.text, r.loss) for r in read_turns(made.turns).collect()), key=repr)
    want, n = [], {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        n[c] = n.get(c, 0) + 1
        want.append((c, n[c], role or "", text or "", (text or "") if role == "assistant" else None))
    assert back == sorted(want, key=repr)
    shown = {(r.conv_id, r.target): r for r in render(made).collect()}
    assert len(shown) == 4 and shown[1, 3].text[shown[1, 3].loss_start : shown[1, 3].loss_end] == "<||im_start|>yes"
    assert shown[1, 6].text.startswith(shown[1, 5].text[: shown[1, 5].loss_start]) and shown[1, 3].text.count("<|im_start|>") == 3
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).examples.count() == 0


def test_chat_examples_are_written_and_checked(spark, tmp_path):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|x") for i in range(6)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "é")]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), str(tmp_path))
    turns = {(r.conv_id, r.pos): r.formatted for r in made.turns.collect()}
    files = spark.read.parquet(f"{tmp_path}/examples")
    got = {(r.conv_id, r.target): (r.context, (r.context + r.formatted)[r.mask.start : r.mask.end]) for r in files.collect()}
    assert got == {(1, k): ("".join(turns[1, i] for i in range(1, k)), f"turn {k - 1} <||x") for k in (2, 4, 6)} | {(None, 1): ("", "é")}
    assert {r.conv_id: r.loss_chars for r in digests(made).collect()} == {1: 30, 2: 0, None: 1}
    for wrong in (files.where("target <> 4"), files.withColumn("context", files.formatted)):
        with pytest.raises(Exception, match="wrong examples"):
            digests(made._replace(examples=wrong)).collect()


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        assert 0.7 * kept < out.count() <= kept
    odd_docs = odd.drop("print")
    assert corpus_pipeline.language(spark, docs.unionByName(odd_docs), SF).where("text is null or text = ''").count() == 0
    assert corpus_pipeline.near_dedup(spark, odd_docs, SF).count() == 10
    assert corpus_pipeline.pii(spark, odd_docs, SF).count() == 11
    left = corpus_pipeline.run(spark, SF)
    assert left.count() > 0 and left.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
