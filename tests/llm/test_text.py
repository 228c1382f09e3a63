"""Tokenizer, decontamination, URL rules, chat, revisits and classifiers."""

import random
import re

import pytest
from helpers import SF, duck_rows, rows_of

from millrace.llm import chat, decontaminate, learn, pieces, quality, toxicity, url_rules, warc_revisit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- SentencePiece --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceModel(f.read())


def test_pieces_match_the_library(library, model):
    rng = random.Random(1)
    vocabulary = [p for p in model.pieces if not p.startswith("<")]
    texts = ["", " ", "  ", "   a", "a ", "a  b", "a" * 3000, " " * 2000, "ab" * 1500, "<s>", "<0x41>", "▁", "▁▁a", "x\x00y", "<unk>", "😀" * 60, "\n\n", "é\u0301\u200b"]
    for _ in range(1500):
        texts.append("".join(rng.choice([rng.choice(vocabulary), rng.choice(["a", " ", "  ", "\n", "é", "漢", "▁", "\x00", "😀", "the", "seen"])]) for _ in range(rng.randint(0, 40))))
    words = pieces.WordCache(model, decimal=True)
    words.MOST = 700  # both generations and the clearing occur
    for _ in range(2):
        for lo in range(0, len(texts), 50):
            part = texts[lo : lo + 50]
            for text, (i, d) in zip(part, pieces.encoded(part, words), strict=True):
                want = library.encode(text)
                assert (i.decode(), d.decode()) == ("".join(f"{x}," for x in want), library.decode(want)), text[:80]
                assert model.decode(want) == d.decode()


def test_pieces_any_text(library, model):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        want = library.encode(text)
        assert model.encode(text) == want and model.decode(want) == library.decode(want)

    check()


def test_decode_any_ids(library, model):
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_encode_documents(spark, odd_docs, no_docs, library):
    want = sorted((str(i), len(library.encode(t)), library.encode(t), library.decode(library.encode(t))) for i, t in plain(odd_docs))
    got = pieces.encode_documents(odd_docs, pieces.default_model(), ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids"], r["decoded"]) for r in got) == want
    got = pieces.encode_documents(odd_docs, pieces.default_model(), ["doc_id"], give="round_trip").collect()
    texts = {str(i): t for i, t in plain(odd_docs)}
    assert sorted((str(r["doc_id"]), r["ids"], r["round_trip"]) for r in got) == sorted((i, ids, d == texts[i]) for i, _, ids, d in want)
    for give in pieces.GIVES:
        assert pieces.encode_documents(no_docs, pieces.default_model(), ["doc_id"], give=give).count() == 0


def test_pieces_query_against_the_library(spark, library):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in plain(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = library.encode(t)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.op8_pieces(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


# -- decontamination ------------------------------------------------------------------------


def hits_expected(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def test_decontaminate(spark, odd_docs, no_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    w = item.split()
    extra = [
        (50, item), (51, "x " + " ".join(w[2:12]) + " y"), (52, "x " + " ".join(w[2:11]) + " y"), (53, "Short ITEM, here"), (54, "a short item hers"),
        (55, " ".join(w[:10]) + " q " + " ".join(w[3:])), (56, " ".join(["same"] * 40)), (56, item), (57, "one"), (None, item),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    items = [(1, item), (2, item.upper()), (3, "short item"), (4, None), (5, ""), (6, " ".join(["same"] * 15)), (7, "one"), (8, "the quick brown fox jumps over the lazy dog"), (10, " ".join(f"w{i}" for i in range(100, 130)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted(_expected_any(docs, items), key=str)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(odd_docs, bench.limit(0)).collect()} == {0}


def _expected_any(docs, items):
    """hits_expected, also for null doc_ids."""
    return [(r["doc_id"], *hits_expected([(0, r["text"])], items)[0][1:]) for r in docs.collect()]


def test_decontaminate_sql(spark):
    assert rows_of(decontaminate.op9_decontaminate(spark, SF)) == duck_rows(decontaminate.SQL)


# -- URL rules --------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        "http://a.net/x", "http://NET/", "http://net", "http://xnet/", "https://www.Example.NET/en/a?b", "http://example.net/en", "http://example.com/de/#x", "http://example.org/fr/",
        "ftp://b.org/fra", None, "", "no scheme", "http://", "x://y://net/", "http://a.net?x/", "http://example.net./en/", "http://u@a.b.c.d.net/" + "p" * 5000, "http://a.net/x",
    ]
    pages = spark.createDataFrame([(None if i == 3 else i, u, None) for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")

    def want(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    expected = sorted((i, *want(u)) for i, u in enumerate(urls) if i != 3)
    got = [tuple(r) for r in url_rules.url_rules(pages, rules).collect()]
    assert sorted(x for x in got if x[0] is not None) == expected and [x for x in got if x[0] is None] == [(None, *want(urls[3]))]
    assert sorted(tuple(r) for r in url_rules.url_rules(pages, rules, max_bytes=1).collect() if r[0] is not None) == expected  # a full filter changes nothing
    assert {r["verdict"] for r in url_rules.url_rules(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.url_rules(pages.limit(0), rules).count() == 0


def test_bloom_filters_out_most(spark):
    listed = spark.range(2000).selectExpr("concat('h', id, '/') AS rule")
    blocks = 2000 * 12 // 256 + 1
    bloom = url_rules.bloom_blocks(listed, "rule", blocks)
    assert url_rules.passing(listed, "rule", bloom, blocks).count() == 2000
    assert url_rules.passing(spark.range(10_000).selectExpr("concat('g', id, '/') AS rule"), "rule", bloom, blocks).count() < 400


def test_url_sql(spark):
    assert rows_of(url_rules.op10_url_rules(spark, SF)) == duck_rows(url_rules.SQL)


# -- chat -----------------------------------------------------------------------------------


def test_chat_collapse(spark):
    talk = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    rows = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "b", "c") + talk(5, "a", "x") + talk(6, "z") + [(7, None, None, None), (7, 1, "user", "q"), (None, 0, "user", "a"), (8, 0, "user", "m"), (8, 0, "assistant", "m")]
    turns = spark.createDataFrame([(*r, None) for r in rows], "conv_id long, turn long, role string, text string, h1 string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.render(turns).collect()}
    say = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3] == (3, 2, say(("user", "a"), ("assistant", "b"), ("user", "c")))
    assert got[7] == (2, 1, say(("", ""), ("user", "q"))) and got[8] == (2, 1, say(("assistant", "m"), ("user", "m")))
    assert chat.render(turns.limit(0)).count() == 0
    assert rows_of(chat.op2_chat_collapse(spark, SF)) == duck_rows(chat.SQL)


# -- revisits ---------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "response", "http://H/a", 10, 200, {"etag": '"1"', "server": "s", "last-modified": "d1"}, "one"),
        (2, "response", "http://h/a/", 20, 200, {"etag": '"2"'}, "two"),
        (3, "response", "http://h/a", 30, 404, {"etag": '"3"'}, "gone"),
        (4, "revisit", "https://h:443/a#x", 15, 304, {"etag": 'W/"1"', "date": "now", "server": "t"}, None),
        (5, "revisit", "http://h/a?utm_source=q", 200_000, 304, {"etag": '"2"'}, None),
        (6, "revisit", "http://h/a", 25, 304, {"etag": '"1"'}, None),
        (7, "revisit", "http://h/a", 5, 304, None, None),
        (8, "revisit", None, 5, 304, None, None),
        (9, "revisit", "http://h/a", 20, 304, None, None),
        (10, "revisit", "http://h/b", None, 304, None, None),
        (11, "revisit", "http://h/a", 12, 304, {"last-modified": "d1"}, None),
        (12, "revisit", "http://h/a", 12, 304, {"last-modified": "d2"}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, status int, headers map<string,string>, payload string")
    got = {r["record_id"]: (r["state"], r["source_id"], r["payload"]) for r in warc_revisit.resolve(records).collect()}
    assert got == {
        4: ("resolved", 1, "one"), 5: ("resolved", 2, "two"), 6: ("unresolved", None, None), 7: ("unresolved", None, None), 8: ("unresolved", None, None),
        9: ("resolved", 2, "two"), 10: ("unresolved", None, None), 11: ("resolved", 1, "one"), 12: ("unresolved", None, None),
    }
    headers = {r["record_id"]: r["headers"] for r in warc_revisit.resolve(records).collect()}
    assert headers[4] == {"etag": 'W/"1"', "server": "s", "last-modified": "d1", "date": "now"}
    assert warc_revisit.resolve(records.limit(0)).count() == 0
    assert rows_of(warc_revisit.op4_warc_revisits(spark, SF)) == duck_rows(warc_revisit.SQL)


# -- classifiers --------------------------------------------------------------------------------


@pytest.mark.parametrize(("query", "column", "parts", "held", "least"), [(toxicity.op6_toxicity, "toxic", 4, 2, 0.93), (quality.op1_quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, column, parts, held, least):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in query(spark, sf).collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [m for m in marks if got[m["doc_id"]]["held_out"]]
    import zlib

    assert {m["doc_id"] for m in out} == {m["doc_id"] for m in marks if zlib.crc32(str(m["doc_id"]).encode()) % parts == held}
    assert sum(got[m["doc_id"]]["predicted"] == m[column] for m in out) / len(out) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd_inputs(spark, odd_docs, no_docs, module):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 0, 0), (3, 1, 1), (None, 1, 1), (99, 0, 0), (7, 0, 0), (9, 0, 0)], "doc_id long, toxic int, quality int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = module.train(odd_docs, marks)
        rows = module.scored(odd_docs, model, ["doc_id"]).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert module.scored(no_docs, model, ["doc_id"]).count() == 0


def test_factorization_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together: additive weights can't tell."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([t for t, on in ((11, a), (22, b)) if on] + [33])
        labels.append(int(a == b))
    model = toxicity.fit(pd.DataFrame({"rank": range(1200), "label": labels, "x": rows}), least_z=-1.0, epochs=60)
    at = {int(p): i for i, p in enumerate(model["place"])}

    def score(*terms):
        x = np.zeros((1, len(at)), np.float32)
        x[0, [at[t] for t in terms if t in at]] = 1
        return learn.sigmoid(toxicity.logits(model, x))[0]

    assert score(11, 22, 33) > 0.8 and score(11, 33) < 0.2 and score(22, 33) < 0.2


def test_attention_gradient():
    """The written-out gradients against differences."""
    import numpy as np

    rng = np.random.default_rng(1)
    p = {"W": rng.normal(size=(5, 4)), "a": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "b": np.array([0.3])}
    x, count, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        q = quality._forward(p, x, count)["p"]
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    grads = quality._gradients(p, x, quality._forward(p, x, count), y)
    for k, g in grads.items():
        flat, gf = p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in range(len(flat)):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - gf[i]) < 1e-6, (k, i)


def test_toxicity_query_against_all_pairs(spark):
    """Every score of the registered query from the sum over all pairs of terms, one by one."""
    import math

    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    row = {int(p): k for k, p in enumerate(model["place"])}
    got = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, SF).collect()}
    texts = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.keys() == {i for i, _ in texts}
    for i, text in texts:
        times = {}
        for word in set(re.findall(r"\w+", text.lower())):
            for place in toxicity.terms_of(word):
                times[place] = times.get(place, 0) + 1
        places = {int(toxicity.counted(p, k)) for p, n in times.items() for k in (1, 2, 3) if n >= k}
        at = [row[p] for p in sorted(places) if p in row]
        w, v = model["w"][at].astype(float), model["v"][at].astype(float)
        logit = float(model["b"][0]) + w.sum() + sum(float(v[a] @ v[a + 1 :].sum(0)) for a in range(len(at)))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, logit))))) < 2e-3, i


def test_quality_query_against_single_passages(spark):
    """Every score of the registered query from its passages, one after the other."""
    import math

    import numpy as np

    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    m = {k: np.asarray(x, float) for k, x in model.items()}
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    got = {r["doc_id"]: r["score"] for r in quality.op1_quality(spark, SF).collect()}
    for i, text in plain(spark.read.parquet(f"{SF}/documents.parquet")):
        words = text.split()
        passages = [words[k : k + quality.PASSAGE] for k in range(0, len(words), quality.PASSAGE)] or [[]]
        embedded, weight = [], []
        for p in passages:
            x = np.zeros(quality.WIDTH)
            if p:
                x[:-4] = np.mean([quality.word_vector(w) for w in p], axis=0)
                x[-4], x[-3], x[-2] = len(set(p)) / len(p), sum(a == b for a, b in zip(p, p[1:], strict=False)) / len(p), math.log1p(len(p)) / 4
            x[-1] = math.log1p(len(passages)) / 4
            h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["a"])
            embedded.append(h)
            weight.append(math.exp(float((np.tanh(h @ m["V"]) * sig(h @ m["U"])) @ m["w"])))
        z = sum(a * h for a, h in zip(weight, embedded, strict=True)) / sum(weight)
        assert abs(got[i] - float(sig(z @ m["c"] + m["b"][0]))) < 2e-3, i


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, "you idiot"), (None, "you idiot"), (3, "a fine text"), (3, "another text"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    frames = [toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]), quality.scored(docs, quality.train(docs, labels), ["doc_id"]), pieces.encode_documents(docs, pieces.default_model(), ["doc_id"])]
    for df in frames:
        assert sorted(str(r["doc_id"]) for r in df.collect()) == sorted(str(i) for i, _ in rows)
    assert len({r["score"] for r in frames[0].collect()}) == 1  # labels of one kind: the share
    empty = pieces.encode_documents(docs.where("coalesce(text, '') = ''"), pieces.default_model(), ["doc_id"]).collect()
    assert [(r["n_tokens"], r["ids"], r["decoded"]) for r in empty] == [(0, [], "")] * 2


def test_shape_looks_at_whole_words():
    assert quality._shape("a" * 40 + "1") != quality._shape("a" * 40) and quality._shape("a" * 40) == "a"


def test_revisits_of_a_hot_response_and_ties(spark):
    """One response with many revisits, some at one time; equal times of several responses; repeated rows; clashing columns."""
    rows = [(i, "response", "http://h/a", 10, 200, {"etag": '"1"'}, f"p{i}") for i in range(3)]
    rows += [(10 + i, "revisit", "http://h/a", 10 + i % 7, 304, {"etag": '"1"'} if i % 2 else None, None) for i in range(200)]
    rows += [rows[-1], (500, "revisit", "http://h/a", 9, 304, None, None), (501, "response", "http://h/a", 13, 200, {}, "late")]
    records = spark.createDataFrame([(*r, "x", "y") for r in rows], "record_id long, kind string, url string, time long, status int, headers map<string,string>, payload string, bucket string, source_id string")
    got = sorted((r["record_id"], r["state"], r["source_id"], r["payload"]) for r in warc_revisit.resolve(records).collect())
    want = [(500, "unresolved", None, None)]
    for i in [*range(200), 199]:
        if 10 + i % 7 < 13:
            want.append((10 + i, "resolved", 2, "p2"))
        else:
            want.append((10 + i, *(("unresolved", None, None) if i % 2 else ("resolved", 501, "late"))))
    assert [str(x) for x in got] == [str(x) for x in sorted(want, key=lambda x: x[0])]


def test_session_bounds_are_kept(spark):
    from millrace.llm import common

    keys = list(common._FOR_TEXTS)
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        common.bound_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["4m", "512"]
        spark.conf.set(keys[0], "64mb")
        spark.conf.set(keys[1], "1000")
        common.bound_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["64mb", "1000"]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
