import pytest

CLASH = ["digest", "node", "text_hash", "score", "label", "_bucket", "block", "rule", "kept", "_gone"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog and runs away from all of the loud hounds"
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (4, None), (5, ""), (6, "  \n\t "), (7, base + " today"), (8, "Ünï côdé ÀÉ İ ß 漢字 😀 ▁x"),
        (9, "one two"), (10, "one two"), (11, "x" * 30_000), (12, " ".join(f"w{i}" for i in range(6000))), (13, " ".join(f"w{i}" for i in range(6000)) + " end"),
        (14, "A repeated line of text\nshort\nA repeated line of text"), (15, "  a REPEATED line of text \nother line number two"), (16, "a repeated line of text"),
        (17, "\n\n\n"), (1, base), (18, "idiot"), (19, "a\x0bb\x0cc\rd"),
    ]
    rows = [(i, t, "en", None if i % 3 else "s", None if i % 4 else 1, *[None] * len(CLASH)) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
