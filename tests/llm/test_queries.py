"""The registered queries and the pipeline's stages against plain versions on the small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from prosemill.llm import op4_pii, op5_packing
from prosemill.llm.op3_decontam import build_index, matches
from prosemill.llm.op5_packing import digests, pack, sum_of_squares
from prosemill.llm.op6_url_lists import judge
from prosemill.llm.op7_minhash import jaccard_at_least, shingle_set
from prosemill.llm.op8_embeddings import unit
from prosemill.llm.op9_language import DICTIONARY_BYTES, SAMPLE_TEXTS, classify, has_letter, sizes, train, _compressors
from prosemill.llm.tokens import tokenizer_path
from tests.llm.conftest import SF


def components_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in up}


def plain_dedup(rows, n, percent):
    """(n_shingles, component) by id, from all pairs whose sizes allow the threshold."""
    sets = sorted(((i, shingle_set(t, n)) for i, t in rows), key=lambda x: len(x[1]))
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if jaccard_at_least(a, b, percent):
                links.append((i, j))
    return {i: len(s) for i, s in sets}, components_of([i for i, _ in rows], links)


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


def test_op7_query(spark, texts):
    count, component = plain_dedup(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in entry.queries()["op7_minhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (count[i], component[i], component[i] == i) for i in count} and len(set(component.values())) < len(component)


def test_op8_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [(r.vec_id, r.label, unit([float(x) for x in r.embedding] if r.embedding else None)) for r in rows]
    links, n = [], {r.vec_id: 0 for r in rows}
    for label in {x for _, x, _ in good if x is not None}:
        own = [(i, v) for i, x, v in good if x == label and v is not None]
        near = np.argwhere(np.triu(np.stack([v for _, v in own]) @ np.stack([v for _, v in own]).T >= 0.93, 1)) if own else []
        for a, b in near:
            links.append((own[a][0], own[b][0]))
            n[own[a][0]] += 1
            n[own[b][0]] += 1
    component = components_of(n, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in entry.queries()["op8_embedding_near_dedup"](spark, SF).collect()}
    assert got == {i: (n[i], component[i], component[i] == i) for i in n}


def test_op3_query(spark, texts):
    index = build_index(sorted(tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()))
    got = sorted(tuple(r) for r in entry.queries()["op3_decontamination"](spark, SF).collect())
    assert got and got == sorted((i, *m) for i, t in texts for m in matches(index, t or "", 0.5, 0.8))


def test_op4_query(spark, texts):
    spark.conf.set(op4_pii.KEY_SETTING, "a key for tests")
    try:
        key = op4_pii.key_of(spark)
        got = {r.doc_id: (r.text, r.spans) for r in entry.queries()["op4_pii_pseudonyms"](spark, SF).collect()}
    finally:
        spark.conf.unset(op4_pii.KEY_SETTING)
    want = {}
    for i, t in texts:
        new, spans = op4_pii.pseudonymized(t, key) if t else (t, [])
        want[i] = (new, ",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    assert got == want and any(s for _, s in got.values())


def test_op5_query(spark, texts):
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts}
    rows = entry.queries()["op5_best_fit_packing"](spark, SF).collect()
    want = sorted((i, k, at, len(v[at : at + 4096]), zlib.crc32(v[at : at + 4096].tobytes())) for i, v in ids.items() for k, at in enumerate(range(0, len(v), 4096)))
    assert sorted(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_packing_in_two_groups(spark, monkeypatch):
    monkeypatch.setattr(op5_packing, "GROUP", 150)
    docs = spark.createDataFrame([(i, "word " * (1 + i * 37 % 900)) for i in range(300)], "doc_id long, text string")
    rows = digests(pack(docs, capacity=1000)).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert len(rows) == 300 and max(used.values()) <= 1000 and len(used) <= -(-sum(used.values()) // 1000) + 4


def test_sum_of_squares_by_its_definition():
    rng = np.random.default_rng(2)
    for capacity in (5, 12, 40):
        lengths = rng.integers(1, capacity, 60)
        bins, _ = sum_of_squares(lengths, capacity)
        gaps: list[int] = []
        for i in np.argsort(-lengths, kind="stable").tolist():
            s = int(lengths[i])
            room = sorted({g for g in gaps if g >= s})

            def squares(g):
                after = list(gaps)
                after[after.index(g)] -= s
                return sum(after.count(x) ** 2 for x in set(after) if x)

            if not room:
                gaps.append(capacity - s)
                assert bins[i] == len(gaps) - 1
                continue
            best = min(room, key=lambda g: (squares(g), g))
            assert gaps[bins[i]] == best
            gaps[bins[i]] -= s


def test_op9_query(spark, corpus):
    labelled = corpus.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = train(labelled)
    again = train(labelled.repartition(7))
    assert model == again and set(model.languages) == {r.lang for r in labelled.where("lang is not null and text is not null").select("lang").distinct().collect()}
    compressors = _compressors(model)
    for r in entry.queries()["op9_language_id"](spark, SF).join(corpus.select("doc_id", "text"), "doc_id").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        by = sorted((n, k) for k, n in enumerate(sizes(r.text, compressors))) if has_letter(r.text) else None
        assert r.lang_pred == (model.languages[by[0][1]] if by else "und")


def test_any_number_of_languages_and_long_texts(spark):
    """A hundred languages, one of them of a single text of 60,000 letters; each has a bounded dictionary."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(1)
    rows, words = [], {}
    for k in range(100):
        words[k] = ["".join(rng.choice(list(alphabet), 6)) for _ in range(40)]
        rows += [(len(rows) + j, f"l{k:02d}", " ".join(rng.choice(words[k], 60))) for j in range(3)] if k else [(0, "l00", " ".join(rng.choice(words[0], 9000)))]
    model = train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.languages) == 100 and all(0 < len(d) <= DICTIONARY_BYTES for d in model.dictionaries) and SAMPLE_TEXTS > 3
    asked = spark.createDataFrame([(k, " ".join(rng.choice(words[k], 50))) for k in range(100)], "doc_id long, text string")
    assert sum(r.lang_pred == f"l{r.doc_id:02d}" for r in classify(asked, model).collect()) >= 99


def test_url_list_precedence_names_and_addresses(spark):
    caps = [(1, "http://a.org/", 5), (2, "http://10.2.3.4/x", 5), (3, "http://[::1]:80/", 5), (4, "http://x.a.org", 4), (5, "http://b.org", 9)]
    entries = [("a.org", 5, "allow"), ("a.org", 5, "block"), ("3.4", 1, "block"), ("[::1]", 1, "block"), ("b.org", 1, "block"), ("b.org", 9, "allow"), ("b.org", 9, "other")]
    df = spark.createDataFrame(caps, "page_id long, url string, fetch_day int")
    for c in ("_day", "_host", "row", "day", "domain", "v", "entry", "until", "action"):
        df = df.withColumn(c, F.lit(c))
    out = judge(df, spark.createDataFrame(entries, "domain string, day int, action string"))
    got = {r.page_id: (r.blocked, r.listed_domain, r.since, r["_day"], r["domain"]) for r in out.collect()}
    assert got == {1: (True, "a.org", 5, "_day", "domain"), 2: (False, None, None, "_day", "domain"), 3: (True, "[::1]", 1, "_day", "domain"), 4: (False, None, None, "_day", "domain"), 5: (False, "b.org", 9, "_day", "domain")}


def test_each_stage_of_the_pipeline(spark, corpus):
    """Every stage's rows are those that its plain version keeps of the same input."""
    spark.conf.set(op4_pii.KEY_SETTING, "a key for tests")
    try:
        key, docs, columns = op4_pii.key_of(spark), corpus, corpus.columns
        bench = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect())
        for name, stage in corpus_pipeline.STAGES:
            before = {r.doc_id: r for r in docs.collect()}
            docs = corpus_pipeline.materialize(stage(spark, docs, SF))
            if name == "packing":
                t = Tokenizer.from_file(tokenizer_path())
                assert sum(r.length for r in docs.collect()) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.values())
                break
            after = {r.doc_id: r for r in docs.collect()}
            assert docs.columns == columns and set(after) <= set(before)
            if name == "language":
                model = train(spark.createDataFrame([r for i, r in before.items() if zlib.crc32(str(i).encode()) % 4 != 2], corpus.schema))
                compressors = _compressors(model)
                keep = set()
                for i, r in before.items():
                    if has_letter(r.text):
                        first, second = sorted(sizes(r.text, compressors))[:2]
                        if (second - first) / second >= 0.02:
                            keep.add(i)
            elif name == "near_dedup":
                _, component = plain_dedup([(i, r.text) for i, r in before.items()], 5, 80)
                keep = {i for i, c in component.items() if i == c}
            elif name == "decontamination":
                index = build_index(bench)
                keep = {i for i, r in before.items() if not matches(index, r.text or "", 0.5, 0.8)}
            else:
                keep = set(before)
                assert all(after[i].text == op4_pii.pseudonymized(r.text, key)[0] and after[i].n_chars == (len(after[i].text) if after[i].text != r.text else r.n_chars) for i, r in before.items())
            assert set(after) == keep, name
            assert name == "pii" or all(after[i] == before[i] for i in after)
    finally:
        spark.conf.unset(op4_pii.KEY_SETTING)
