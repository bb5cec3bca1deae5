"""op11, op12 and op13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import __spark_entry__ as entry
from prosemill.llm import op11_divergence, op13_vector_codes
from prosemill.llm.op11_divergence import divergence, terms
from prosemill.llm.op12_compression import CHUNK, assess, counts, within
from prosemill.llm.op13_vector_codes import compress, cut, exact, nearest, restored, tree, with_label_errors
from tests.llm.conftest import SF
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op11 ---------------------------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least, top=10):
    """Rows by the definition: every term of a language for every two of its groups."""
    found = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {f[0] for f in found}:
        docs = [f for f in found if f[0] == lang]
        df, total = Counter(), Counter()
        by = defaultdict(Counter)
        for _, source, words in docs:
            df.update(set(words))
            total.update(words)
            by[source].update(words)
        kept = sorted(t for t in df if df[t] >= least)
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(n) for s, n in by.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in by if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ordered)]
    return sorted(out)


def said(df):
    return sorted(tuple(r) for r in df.collect())


def random_groups(seed, groups, docs):
    """Sources of one hot group and many small ones; words that all use, that few use and that one uses."""
    r = random.Random(seed)
    common, rare = ["the", "The", "é", "naïve", "x"], [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = []
    for _ in range(docs):
        g = 0 if r.random() < 0.4 else r.randrange(groups)
        own = rare[(7 * g) % 100 : (7 * g) % 100 + 12]
        rows.append((r.choice(["en", "fr"]), f"s{g}", " ".join(r.choice(common + own) for _ in range(r.randrange(40)))))
    return rows


def test_terms_are_runs_of_letters_and_of_other_scripts():
    text = "Don't stop_NOW 3d É漢字-b\x7fc\x85d  [x]^y"
    assert [t.decode() for t in terms(text)] == [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert terms(None) == [] == terms("")


@pytest.mark.parametrize("sizes", [{}, {"TILE": 4, "TERMS": 8, "HEAVY": 3, "LIGHT": 2, "HELD": 50}, {"HEAVY": 1}, {"HEAVY": 10**6}, {"TILE": 1, "TERMS": 1}])
def test_divergence_is_that_of_all_terms_beside_all_groups(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(op11_divergence, k, v)
    rows = random_groups(3, 14, 260) + [("en", "bare", "123"), ("en", "none", None), ("fr", None, "the é"), (None, "s1", "the the"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert said(divergence(docs, least_docs=5)) == plain_divergence(rows, 5)


def test_divergence_without_kept_terms_documents_or_other_groups(spark, odd, empty):
    assert divergence(empty).collect() == []
    assert divergence(odd).collect() == []  # one group and no kept term
    rows = [("en", s, "one two") for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert said(divergence(docs)) == plain_divergence(rows, 10) and {r["value"] for r in divergence(docs).collect()} == {0}
    repeated = spark.createDataFrame([("a", "x x"), ("a", "x x"), ("b", "x y")], "source string, text string").selectExpr("source", "text", "'en' as lang", "1 as term", "2 as salt", "3 as n")
    assert said(divergence(repeated, least_docs=2)) == plain_divergence([("en", "a", "x x"), ("en", "a", "x x"), ("en", "b", "x y")], 2)


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, kept = 4 * 10**12, 9 * 10**13, 10**6
    got = spark.range(1).selectExpr(f"{op11_divergence._p(f'{n}L', f'{total}L', f'{kept}L')} as p").first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# --- op12 ---------------------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, before = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in before
            before.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)]


TEXTS = ["", " \n\t", "one", "a b c a b c", "x x x x", "a\x0bb\x0cc\x1cd\xa0e\x85f", "é 漢字 é 漢字 é 漢字", "# a\n\n# a\n  \n# a \n* b|c <d>", "a b c\nd a b c", "a b\nc a\nb c", "the end\r\nthe end\r\n"]


def test_counts_by_their_definition(corpus):
    texts = TEXTS + [r["text"] or "" for r in corpus.select("text").collect()] + ["lorem ipsum dolor " * 50_000]
    got = counts([t.encode() for t in texts])
    for t, row in zip(texts, got.tolist()):
        assert row == plain_counts(t), t[:50]
    # Equal windows of two texts are no repeat, and a window doesn't cross a border.
    assert counts([b"a b c", b"a b c", b"b c a b"])[:, 4].tolist() == [0, 0, 0]


def test_verdicts_by_their_definition(spark, corpus):
    r = random.Random(5)
    noise = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000))
    rows = [(1, " ".join(noise[i : i + 60] for i in range(0, 60_000, 60))), (2, "\n".join(f"the;total;of;the;whole;table;by;row;and;by;column;is;given;here;as;{i} row{i}" for i in range(4000))), (3, None), (4, ""), (5, " ".join(["go"] * 100))]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in rows], "doc_id long, text string"))
    z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    seen = 0
    for row in assess(docs).collect():
        raw = (row["text"] or "").encode()
        n = plain_counts(row["text"] or "")
        chunks = [len(z.compress(raw[i : i + CHUNK])) / len(raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK) if len(raw) - i >= CHUNK / 2]
        ratio = len(z.compress(raw)) / len(raw) if raw else 1.0
        fine, odd_chunks = within(len(raw), ratio, chunks)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == n
        assert (row["base_failed"], row["ratio"], row["n_chunks"], row["odd_chunks"], row["kept"]) == (failed, ratio, len(chunks), odd_chunks, fine and not failed)
        seen += 1
    assert seen == docs.count()
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in assess(docs).where("doc_id < 0").collect()}
    assert verdict[-1] == (False, False) and verdict[-2] == (False, False)  # noise, and a table that says one thing
    assert verdict[-3] == verdict[-4] == verdict[-5] == (True, False)


def test_clean_documents_stay(corpus, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    rows = assess(corpus.join(labels, "doc_id")).where("not base_failed").collect()
    assert rows and all(r["kept"] for r in rows)


def test_assess_odd_rows_and_clashing_columns(odd, empty):
    assert assess(empty).collect() == [] and "kept" in assess(empty).columns
    got = assess(odd.selectExpr("*", "'x' as KEPT", "1 as ratio", "2 as n_words"))
    assert [c.lower() for c in got.columns].count("kept") == 1 and got.count() == odd.count()
    assert {r["kept"] for r in got.collect()} == {False}  # all are short or repeat themselves


# --- op13 ---------------------------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error, digest), by every part beside every entry in Python's integers; vectors of one length."""
    fine = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return []
    places = cut(len(fine[0][2]), parts)
    by_id = {i: min(v for j, _, v in fine if j == i) for i in sorted({i for i, _, _ in fine if i is not None})[:entries]}
    books = [[v[p] for v in by_id.values()] for p in places]

    def assign(v):
        out = []
        for p, book in zip(places, books):
            out.append(min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(book)))
        return out

    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, v in fine:
            for k, (p, (_, e)) in enumerate(zip(places, assign(v))):
                held[k, e].append(v[p])
        for (k, e), own in held.items():
            books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    done = [(i, label, assign(v)) for i, label, v in fine]
    by_label = Counter()
    for _, label, a in done:
        by_label[label] += sum(d for d, _ in a)
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), by_label[label], sha) for i, label, a in done), key=repr)


def coded(df, **settings):
    done = compress(df, **settings)
    return sorted(map(tuple, with_label_errors(done.rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_nearest_keeps_the_lower_of_equal_entries():
    rng = np.random.default_rng(1)
    for _ in range(60):
        d, k = int(rng.integers(0, 4)), int(rng.integers(1, 70))
        book, x = rng.integers(-3, 4, (k, d)), rng.integers(-4, 5, (200, d))
        for kind in (np.int64, object):
            at, far = nearest(x.astype(kind), book.astype(kind), tree(book.astype(kind)))
            all_ = ((x[:, None] - book[None]) ** 2).sum(2)
            assert (at == all_.argmin(1)).all() and (far == all_.min(1)).all()


def test_codes_by_their_definition(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(rng.integers(3)) if rng.random() < 0.8 else None) for i in rng.permutation(400)]
    rows += [(1000, None, 1), (1001, [None] + [0.5] * 31, 1), (1002, [float("nan")] * 32, None), (1003, [float("inf")] * 32, 2), (1004, [0.0] * 32, 2), (None, [0.25] * 32, None)]
    rows += [rows[5], rows[6], (rows[7][0], rows[8][1], 1)]  # repeated rows, and an id with two vectors
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert coded(df) == plain_codes(rows)


def test_codes_of_few_and_of_equal_vectors(spark):
    rows = [(3, [1.0] * 16, None), (1, [1.0] * 16, None), (2, [-1.0] * 16, 7)]
    assert coded(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)
    assert coded(spark.createDataFrame([], VECTORS)) == []
    assert coded(spark.createDataFrame([(1, None, 1)], VECTORS)) == []


def test_large_components_are_exact_until_64_bits(spark):
    rows = [(i, [float(x) * 2.0**21 for x in np.random.default_rng(i).normal(0, 1, 16)], 0) for i in range(90)]
    assert coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain_codes(rows)
    huge = spark.createDataFrame([(1, [1e308, -1e308] * 8, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert len(coded(huge)) == 2


def test_lengths_have_codebooks_of_their_own(spark):
    rows = [(1, [0.5] * 20, 1), (2, [0.1] * 20, 1), (3, [], 1), (4, [0.3] * 5, 1), (5, [0.2] * 32, None)]
    done = compress(spark.createDataFrame(rows, VECTORS))
    assert sorted(done.codebooks) == [0, 5, 20, 32]
    got = {r["vec_id"]: r for r in done.rows.collect()}
    assert len(got) == 5 and got[3]["code"] == "00" * 16 and all(r["error"] == 0 for r in got.values())
    back = {r["vec_id"]: r["embedding"] for r in restored(done.rows, done.codebooks).collect()}
    assert back[1] == [0.5] * 20 and back[3] == [] and back[4] == [math.floor(256 * float(np.float32(0.3))) / 256] * 5


def test_codebooks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op13_vector_codes, "CODEBOOK_MOST", 20)
    with pytest.raises(ValueError, match="codebooks"):
        compress(spark.createDataFrame([(1, [0.5] * 32, 1)], VECTORS))


def test_label_errors_of_hot_and_of_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(op13_vector_codes, "HOT_MOST", 3)
    rows = [(i, "a" if i < 40 else None if i < 50 else f"l{i}", i) for i in range(60)]
    want = Counter()
    for _, label, e in rows:
        want[label] += e
    got = with_label_errors(spark.createDataFrame(rows, "vec_id long, label string, error long"))
    assert sorted((r["vec_id"], r["label_error"]) for r in got.collect()) == [(i, want[label]) for i, label, _ in rows]


def test_components_by_floor():
    x = pa.array([[0.5, -0.001], None, [1.0, None], [float("nan")], [], [2.0**60, -(2.0**60)]], pa.list_(pa.float64()))
    got = [None if v is None else [int(k) for k in v] for v in op13_vector_codes._whole(x, 256)]
    assert got == [[128, -1], None, None, None, [], [op13_vector_codes.MOST, -op13_vector_codes.MOST]]
    assert exact(np.array([[1 << 40]])).dtype == object


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    ours, theirs = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ours == theirs and ours
