"""The pipeline's stages against brute force on the documents of sf0.01."""

import importlib.util
from pathlib import Path

import corpus_pipeline

from millrace.llm import common, exact_dedup, pieces, toxicity

SF = "/root/testdata/sf0.01"


def _load(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages(spark):
    dedup, text = _load("test_dedup"), _load("test_text")
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = dict(text.plain(docs))
        out = common.materialise(stage(spark, docs, SF), f"test-{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert out.count() == len(ids)
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.train(docs, common.table(spark, SF, "labels")))
            assert ids == {i for i, t in before.items() if scorer.score(t) < 0.3}
        elif name == "exact_dedup":
            assert ids == {k for (_, k, _, _) in dedup.exact_expected(before.items())}
        elif name == "ngram_jaccard_join":
            assert ids == {i for i, _, c in dedup.near_expected(list(before.items()), 5, 80) if i == c}
        elif name == "benchmark_decontamination":
            assert ids == {i for i, _, n, _ in text.hits_expected(before.items(), bench) if not n}
        else:
            assert ids == set(before) and out.where("not round_trip").count() == 0
            with open(pieces.default_model(), "rb") as f:
                model = pieces.PieceModel(f.read())
            assert all(list(r["ids"]) == model.encode(before[r["doc_id"]]) for r in out.limit(20).collect())
        assert name == "sentencepiece" or out.columns == columns
        assert name in ("sentencepiece", "benchmark_decontamination") or len(ids) < len(before)
        docs = out


def test_run(spark):
    """run() as a whole against brute force over the smallest tables."""
    sf = "/root/testdata/sf0.001"
    dedup, text = _load("test_dedup"), _load("test_text")
    scorer = toxicity.Scorer(toxicity.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels")))
    left = {i: t for i, t in text.plain(common.table(spark, sf, "documents")) if scorer.score(t) < 0.3}
    left = {k: left[k] for _, k, _, _ in dedup.exact_expected(left.items())}
    left = {i: left[i] for i, _, c in dedup.near_expected(list(left.items()), 5, 80) if i == c}
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    clean = {i for i, _, n, _ in text.hits_expected(left.items(), bench) if not n}
    with open(pieces.default_model(), "rb") as f:
        model = pieces.PieceModel(f.read())
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(clean) and 0 < len(clean) < len(left)
    assert all(list(r["ids"]) == model.encode(left[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in rows)


def test_rows_with_null_and_repeated_ids(spark):
    """A row is judged by its id and its text together."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:40], "other", *words[41:]])
    rows = [
        (None, " ".join(words)), (None, " ".join(words)), (None, "  ".join(words)), (5, "  ".join(words)), (5, " ".join(reversed(words))), (5, near), (None, near),
        (None, "own words of a text of its own"), (None, None), (7, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())
    apart = common.materialise(corpus_pipeline.drop_copies(spark, docs, SF), "odd-exact")
    assert pairs(apart) == sorted(str(x) for x in [(5, "  ".join(words)), (5, near), (5, " ".join(reversed(words))), (None, "own words of a text of its own"), (7, None)])
    for given in (apart, docs):
        kept = pairs(corpus_pipeline.drop_near_copies(spark, given, SF))
        # 5 with 60 words and `near` are linked; of two rows of id 5 the one with the smaller text hash stays.
        assert len([x for x in kept if "w1 " in x or "w1'" in x or "w3" in x]) == 2 and any("own words" in x for x in kept)
    item = common.table(spark, SF, "benchmark").where("length(text) > 200").first()["text"]
    mixed = spark.createDataFrame([(None, item, "en", "s", 0), (9, item, "en", "s", 0), (9, "clean", "en", "s", 0), (None, "clean", "en", "s", 0)], docs.schema)
    assert pairs(corpus_pipeline.drop_contaminated(spark, mixed, SF)) == sorted([str((9, "clean")), str((None, "clean"))])


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    assert exact_dedup.exact_dedup(odd_docs).count() == odd_docs.count()
    kept = common.materialise(corpus_pipeline.drop_copies(spark, odd_docs, SF), "odd")
    assert kept.columns == odd_docs.columns
    rows = sorted(r["doc_id"] for r in kept.collect())
    # 3 has the most code points of 1 to 3; 17 and 5 lose to 6; 10 to 9. The two rows of 1 are gone.
    assert rows == [3, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 18, 19]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialise(stage(spark, docs, SF), f"odd-{name}")
            assert out.count() <= docs.count() and (name == "sentencepiece" or out.columns == docs.columns)
