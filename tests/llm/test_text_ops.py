import base64
import hashlib
import json
import random
import re
import time

import numpy as np
import pytest

from prosemill.llm import op2_secrets as sec
from prosemill.llm import op4_pii as pii
from prosemill.llm.op3_decontam import build_index, contaminated, decontaminated, passages, wand, words_of
from prosemill.llm.op9_language import classify, held_out, op9_language_id, train
from tests.llm.conftest import SF


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | ((n.bit_length() + 7) // 8)]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


RSA = der(0x30, *[der(2, b"\0")], *[der(2, bytes([1 + i] * 20)) for i in range(8)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48")), der(4, RSA))
JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1234567890"})) + ".c2lnbmF0dXJl"


def kinds(text):
    return [k for k, _, _ in sorted(sec.confirmed_spans(text), key=lambda s: s[1])]


def test_structures_are_confirmed():
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(PKCS8).decode() + "-----END PRIVATE KEY-----"
    assert "pem" in kinds(f"é {pem} tail")
    assert kinds(f"key {base64.b64encode(PKCS8).decode()} end") == ["der"]
    assert kinds(f"key {RSA.hex()} end") == ["der"]
    assert kinds(f"Bearer {JWT}") == ["jwt"]
    text = f"漢 {JWT}."
    assert [text[a:b].rstrip(".") for _, a, b in sec.confirmed_spans(text)] == [JWT]


def test_keys_in_strings_wrapped_and_encoded():
    rng = random.Random(1)
    key = der(0x30, der(2, b"\0"), *[der(2, bytes([1]) + rng.randbytes(100 + i)) for i in range(8)])
    lines = base64.encodebytes(PKCS8).decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + lines + "-----END PRIVATE KEY-----\n"
    for text in (json.dumps({"private_key": pem}), json.dumps(json.dumps({"k": pem})), json.dumps(pem.replace("\n", "\r\n")).replace("/", "\\/")):
        found = [text[a:b] for k, a, b in sec.confirmed_spans(text) if k == "pem"]
        assert len(found) == 1 and found[0].startswith("-----BEGIN") and found[0].endswith("KEY-----")
    for raw in (pem, "a: b\n" + pem):
        assert kinds("tls.key: " + base64.b64encode(raw.encode()).decode()) == ["pem"]
        assert kinds("key\n" + base64.encodebytes(raw.encode()).decode() + "Thanks\n") == ["pem"]
    for k in (PKCS8, RSA, key):
        wrapped = base64.encodebytes(k).decode()
        for text in (f"key\n{wrapped}Thanks\nall", f"key: {wrapped}", "x = " + json.dumps(wrapped), "  " + wrapped.replace("\n", "\r\n  "), wrapped.replace("=", "") + "words"):
            assert kinds(text) == ["der"], text
            ((_, a, b),) = sec.confirmed_spans(text)
            assert base64.b64decode(re.sub(r"\\n|\s|=", "", text[a:b]) + "==") == k
    assert kinds(json.dumps("x\n" + base64.b64encode(PKCS8).decode())) == ["der"] and kinds(json.dumps("x\n" + JWT)) == ["jwt"]
    assert kinds(base64.encodebytes(rng.randbytes(20_000)).decode()) == []


def test_lookalikes_are_left():
    assert kinds(base64.b64encode(PKCS8[:-5]).decode()) == [] and kinds("eyJhbGciOiJub25lIn.x.y" + "z" * 40) == []
    assert kinds("-----BEGIN PRIVATE KEY----- AAAA -----END PRIVATE KEY-----") == [] and kinds("-----BEGIN PRIVATE KEY-----" * 50) == []
    assert kinds("a" * 100_000) == []
    key = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(PKCS8).decode()
    assert kinds(key + key + "-----END PRIVATE KEY-----").count("pem") == 1
    began = time.process_time()
    kinds("-----BEGIN PRIVATE KEY-----" * 40_000 + "-----END PRIVATE KEY-----")
    kinds("-----BEGIN " * 40_000)
    assert time.process_time() - began < 5


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(4)
    parts = ["token", "API_KEY", "apikey", "paSSword", "secret", "ſecret", "toKen", '"', "'", " ", "=", ":", "==", "abcdefgh", "deadbeef" * 4, "DEADBEEF", "AKIA", "AKIA0123456789AB", "x", "-", ".", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [("assign", *m.span()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sec.joined(sec.base_spans(t)) == sec.joined(want), repr(t)


def test_secret_query_and_odd_rows(spark, odd, empty):
    rows = sec.op2_secret_scan(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        base = sec.base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(sec.joined(base).encode()).hexdigest() and r.n_hex == sum(k == "hex" for k, _, _ in base)
    assert sec.find_secrets(odd).count() == 11 and sec.find_secrets(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000, 4097])
def test_feistel_permutes(size):
    assert sorted(pii.feistel(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pii_keeps_formats_and_links():
    text = "Card 4539 1488 0343 6467, mail a.Bc9@x.org, 2020-02-29 and 29.2.2020, ip 10.2.3.4, ssn 123-45-6789, call +1 (555) 123-4567; GB82 WEST 1234 5698 7654 32."
    new, spans = pii.pseudonymized(text, b"key")
    assert [k for k, _, _ in spans] == ["card", "email", "date", "date", "ip", "ssn", "phone", "iban"]
    assert re.sub(r"\d", "0", new.split("mail")[0]) == "Card 0000 0000 0000 0000, " and pii.luhn(re.sub(r"\D", "", new.split(",")[0]))
    for k, a, b in spans:
        assert text[a:b] not in new
    again, _ = pii.pseudonymized("x 4539-1488-0343-6467", b"key")
    assert re.sub(r"\D", "", again) == re.sub(r"\D", "", new.split(",")[0]) and pii.pseudonymized(text, b"other")[0] != new
    iban = re.search(r"GB\d\d[ A-Z0-9]+", new)[0].rstrip(".")
    assert pii._mod97(iban.replace(" ", "")) == 1
    found = re.search(r"(\d{4})-(\d\d)-(\d\d) and (\d\d)\.(\d)\.(\d{4})", new).groups()
    assert [int(x) for x in found[:3]] == [int(x) for x in found[:2:-1]]


def test_pii_leaves_what_does_not_validate():
    text = "4539 1488 0343 6468, 300.1.2.3, 2021-02-30, 000-12-3456, v1.2.3.4.5, GB00 WEST 1234 5698 7654 32, 0000000000000000"
    assert pii.pseudonymized(text, b"k") == (text, [])


@pytest.mark.parametrize("text,value", [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX", "DE89 3704 0044 0532 0130 00"), ("DE89370400440532013000 BIC", "DE89370400440532013000"),
    ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111"), ("4111 1111 1111 1111 123", "4111 1111 1111 1111"), ("No 7 4539 1488 0343 6467.", "4539 1488 0343 6467"),
    ("at 1984-03-05T00:00:00Z", "1984-03-05"), ("at 1984-03-05t10:20", "1984-03-05"),
])
def test_pii_inside_a_longer_match(text, value):
    new, spans = pii.pseudonymized(text, b"key")
    at = text.index(value)
    assert [s[1:] for s in spans] == [(at, at + len(value))] and value not in new
    assert new[:at] == text[:at] and new[at + len(value) :] == text[at + len(value) :]
    assert pii.pseudonymized("1984-03-05Tx and 1984-03-05-", b"key")[1] == []


VALUES = ["4539 1488 0343 6467", "GB82 WEST 1234 5698 7654 32", "(555) 323-4567", "+1 555-323-4567", "123-45-6789", "ann.b@x.org", "10.2.3.4", "8.8.4.4", "2020-02-29", "3.2.2020", "12/25/1999"]
BESIDE = ["", " ", "x ", " BIC WESTGB22", " 12/27 ", " 123", ", ", "(", ")", ": ", "é ", "\n", " CVV 1", "; ", " 7 "]


def test_values_are_found_beside_anything():
    """Each value between neighbours of every kind; a neighbour that touches the value with a letter or digit makes another value."""
    for value in VALUES:
        for before in BESIDE:
            for after in BESIDE:
                if before[-1:].isalnum() or after[:1].isalnum():
                    continue
                text = f"{before}{value}{after}"
                if (before.strip().isdigit() and before[-1:] == " " or after.strip().isdigit()) and value[:2] in ("45", "GB", "(5", "+1"):
                    continue  # digits and a blank: read as groups of the number by its own rule, tested above
                new, spans = pii.pseudonymized(text, b"key")
                assert any(text[a:b] == value for _, a, b in spans) and value not in new, text


def test_formats_and_ranges_stay():
    for text in ("2/3/2020", "12/3/2020", "02.03.2020", "1999-1-31", "10.200.3.4", "192.168.7.7", "127.0.0.1", "8.8.8.8", "172.20.1.1", "224.0.0.9"):
        new, spans = pii.pseudonymized(text, b"k")
        assert len(spans) == 1 and new != text
        if spans[0][0] == "date":
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        else:
            a, b = (pii._range(int.from_bytes(bytes(map(int, t.split("."))), "big")) for t in (new, text))
            assert a == b
    assert pii.pseudonymized("2/3/2020", b"k")[0] == "/".join(str(int(x)) for x in pii.pseudonymized("02/03/2020", b"k")[0].split("/"))
    assert pii.pseudonymized("000-000-0001, 155 323 4567, 555-023-4567", b"k")[1] == []
    seen = {pii.pseudonymized(f"(555) 323-{i:04d}", b"k")[0] for i in range(2000)}
    assert len(seen) == 2000 and all(re.fullmatch(r"\([2-9]\d\d\) [1-9]\d\d-\d{4}", x) for x in seen)


def test_the_key_comes_from_the_session(spark):
    assert pii.key_of(spark) != pii.key_of(spark)
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        assert pii.key_of(spark) == pii.key_of(spark)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pii_rows(spark, odd, empty):
    out = pii.pseudonymize(odd, b"k")
    assert out.columns == [*odd.columns, "pii_spans"] and out.count() == 11 and out.where("text is null").count() == 1
    assert pii.pseudonymize(empty, b"k").count() == 0
    assert pii.op4_pii_pseudonyms(spark, SF).where("n_values > 0").count() > 0


ITEMS = [(1, "What grows in a wide green valley of the north? A tall silver birch with thin white bark."), (2, "The old river bends twice below the mill. It then meets the calm sea near seven grey stones."), (3, None), (4, "")]


def test_wand_equals_a_full_scan(corpus):
    items = [(r.doc_id, r.text[:300]) for r in corpus.limit(60).collect()]
    index = build_index(items)
    none = len(index.terms)
    dense = np.zeros((none + 1, len(index.unit_item)))
    for block in index.blocks:
        for t, (u, w) in block.items():
            dense[t, u] = w
    for r in corpus.limit(80).collect():
        rows = passages(np.array([index.terms.get(w, none) for w in words_of(r.text)], np.int32), none)
        for least in (0.2, 0.5, 0.9):
            got = {(a, b) for a, b, _ in wand(index, rows, least)}
            assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(dense[rows].sum(1) >= least - 1e-5))}


def test_leaks_are_found_and_clean_texts_left(spark, odd, empty):
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 30
    docs = [(1, noise + ITEMS[0][1] + noise), (2, noise + ITEMS[0][1].split("?")[1] + noise), (3, noise), (4, ITEMS[1][1].upper().replace("seven", "nine")), (5, None), (6, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == {(1, 1), (4, 2)}
    assert sorted(r.doc_id for r in decontaminated(df, bench).collect()) == [2, 3, 5, 6]
    assert decontaminated(odd, bench).count() == 11 and contaminated(empty, bench).count() == 0 and decontaminated(odd, bench.limit(0)).count() == 11


def test_shards_give_the_scores_of_the_whole(spark, corpus, monkeypatch):
    from prosemill.llm import op3_decontam

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, contaminated(corpus, bench).collect()), key=repr)
    monkeypatch.setattr(op3_decontam, "INDEX_BYTES", bench.selectExpr("sum(octet_length(text))").first()[0] // 3)
    assert whole and sorted(map(tuple, contaminated(corpus, bench).collect()), key=repr) == whole


def plain_matches(items, text, threshold=0.5, overlap=0.8):
    """Scores of every unit for every passage of 80 words, and shingles around the passages, without an index."""
    from prosemill.llm.op3_decontam import B, K1, counted, question_and_answer, units_of

    counts, words = counted([t for _, t in items]), words_of(text)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for item, t in items:
        own = words_of(t or "")
        hits = []
        for u in units_of(t):
            idf = {x: np.log(1 + (counts.units - counts.holding[x] + 0.5) / (counts.holding[x] + 0.5)) for x in u}
            norm = K1 * (1 - B + B * u.total() / counts.mean)
            weight = {x: idf[x] * f * (K1 + 1) / (f + norm) for x, f in u.items()}
            for at in range(0, max(1, len(words) - 40), 40):
                if sum(weight[x] for x in set(words[at : at + 80]) if x in weight) >= threshold * sum(weight.values()):
                    hits.append(at)
        runs = []
        for at in sorted(set(hits)):
            lo, hi = max(0, at - len(own)), min(len(words), at + 80 + len(own))
            if runs and lo <= runs[-1][1]:
                lo = runs.pop()[0]
            runs.append((lo, hi))
        q = grams(own[: max(5, len(words_of(question_and_answer(t or "")[0])))])
        for lo, hi in runs:
            held = grams(words[lo:hi])
            if len(held & grams(own)) >= overlap * len(grams(own)) and held & q and (held & (grams(own) - q) or not grams(own) - q):
                out.add(item)
    return out


def test_query_equals_plain_scoring(spark, corpus):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {}
    for r in contaminated(corpus, spark.read.parquet(f"{SF}/benchmark.parquet")).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    short = [r for r in corpus.collect() if r.text and len(r.text) < 6000]
    assert len(short) > 100 and {r.doc_id: m for r in short if (m := plain_matches(items, r.text))} == {r.doc_id: got[r.doc_id] for r in short if r.doc_id in got}


def test_an_item_is_confirmed_in_one_place_and_with_its_question():
    from prosemill.llm.op3_decontam import matches

    rng = random.Random(5)
    fill = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    item = "Why so? " + " ".join(f"k{i}" for i in range(30)) + "."
    index = build_index([(1, item), (2, "Who? " + fill(12))])
    words = item.split()
    assert [m[0] for m in matches(index, f"{fill(300)} {item} {fill(300)}", 0.5, 0.8)] == [1]
    scattered = (" " + fill(400) + " ").join(" ".join(words[i : i + 12]) for i in range(0, len(words) - 4, 8))
    assert matches(index, scattered, 0.2, 0.8) == [] and matches(index, fill(50) + " " + " ".join(words[2:]), 0.5, 0.8) == []


def test_language_accuracy_and_odd_rows(spark, corpus, odd, empty):
    rows = op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.03
    model = train(corpus.where(~held_out(corpus.doc_id)))
    out = classify(odd, model)
    assert {r.lang_pred for r in out.where("text is null or text = '' or doc_id = 9").collect()} == {"und"} and out.count() == 11
    assert classify(odd, train(empty)).where("lang_pred <> 'und'").count() == 0 and classify(empty, model).count() == 0
