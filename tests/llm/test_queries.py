"""Every registered query: against its SQL on the small tables, and on tables of odd rows with extra columns."""

import os

import pytest
from pyspark.sql import types as T

pytest.importorskip("public_tokenizers")
import oracle  # noqa: E402
from freightloom.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(3000))
TEXTS = [None, "", " \n\t", "x", "One line.\nAnother line.\nA third line.\nA fourth.", "One line.\nAnother line.\nA third line.\nOther end.", LONG, LONG + " end", "日本語 é", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of odd rows, with repeated ones, and columns named like the operators' own; and the same tables empty."""
    extra = "key long, print long, fp long, text_ string, score double, lang_pred string, measures int, kept int, ids string, n long, _key int, _shard int, listed int"
    own = (1, 2, 3, "mine", 0.5, "mine", 1, 1, "mine", 7, 1, 1, 1)
    documents = [(k, t, "en" if k % 2 else None, "s", len(t or ""), *own) for k, t in enumerate(TEXTS)] + [(3, "x", "en", "s", 1, *own), (None, "null id", "en", "s", 7, *own)]
    vectors = [(0, [0.5, 1.0]), (100, [0.5, -1.0]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, []), (7, [0.25, 0.125]), (7, [0.25, 0.125]), (None, [1.0, 1.0])]
    pages = [(0, None, None), (1, "", ""), (2, "http://A.casino-win.example.com/en/1?x", "<p>One</p><p>Two"), (2, "http://A.casino-win.example.com/en/1?x", "<p>One</p><p>Two"), (None, "no scheme", "<"), (4, "https://example.org/es/" + "a" * 5000, "<div>" * 300 + LONG)]
    folders = []
    for rows in (True, False):
        folder = str(tmp_path_factory.mktemp("odd"))
        for name, data, schema in (
            ("documents", documents, f"doc_id long, text string, lang string, source string, n_chars long, {extra}"),
            ("embeddings", [(*v, k % 2 or None, *own) for k, v in enumerate(vectors)], f"vec_id long, embedding array<double>, label int, {extra}"),
            ("pages", [(*p, *own) for p in pages], f"page_id long, url string, html string, {extra}"),
        ):
            spark.createDataFrame(data if rows else [], schema).write.parquet(f"{folder}/{name}.parquet")
        folders.append(folder)
    return folders


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_rows_and_empty_tables(spark, odd, name):
    full, empty = odd
    source = "embeddings" if "topk" in name or "codes" in name else "pages" if "urls" in name or "html" in name else "documents"
    got, n = queries.QUERIES[name](spark, full).collect(), spark.read.parquet(f"{full}/{source}.parquet").count()
    if name == "op4_topk":
        assert {r["query_id"] for r in got} == {0, 100, 500} and all(r["rank"] <= 10 for r in got) and sum(r["vec_id"] == 7 for r in got) == 6
    elif name == "op12_phrases":
        assert {(r["lang"], r["phrase"]) for r in got} <= {("en", "word0"), ("und", "word0")}  # the long texts have 3,000 words once each
    elif name == "op13_codes":
        # Of the odd vectors four are null or hold a null or a NaN.
        assert len(got) == 6 and all(len(r["code"]) == 8 and r["error"] == 0 for r in got) and len({r["codebooks_sha256"] for r in got}) == 1
    elif name == "op8_packing":
        assert {r["doc_id"] for r in got} == {*range(len(TEXTS)), None} and sum(r["length"] for r in got if r["doc_id"] == 0) == 1
    else:
        assert len(got) == n
    none = queries.QUERIES[name](spark, empty)
    assert none.collect() == [] and isinstance(none.schema, T.StructType)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the small tables")
@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_equal_their_sql(spark, name):
    oracle.assert_equal(queries.QUERIES[name](spark, FOLDER), oracle.connection(FOLDER), queries.ORACLES[name])
