"""The pipeline's stages against plain versions on one small table."""

import os
import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from freightloom.llm import quality  # noqa: E402
from freightloom.llm.common import unit_encoder  # noqa: E402
from test_groups import slow_deduped  # noqa: E402
from test_rows import measured, words  # noqa: E402
from test_shingles import components  # noqa: E402

RANDOM = random.Random(11)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, stems):
    return " ".join("".join(RANDOM.choice(stems) for _ in range(RANDOM.randint(1, 3))) for _ in range(n))


def corpus():
    en, de = ["the", "ing", "of", "and", "er", "th"], ["der", "sch", "ung", "ei", "ge", "und"]
    texts = ["\n".join(prose(RANDOM.randint(8, 14), s) for _ in range(8)) for s in [en, de] * 30]
    texts += [texts[0], texts[4], texts[5], texts[1] + " extra", texts[2].replace(" ", "  ", 1)]
    texts += ["\n".join([*texts[3].split("\n")[:4], prose(30, en), prose(30, en)])]
    texts += ["### $$$ " * 30, "too short", "same same " * 60, None, "", "!! 12 34 " * 20]
    return [(k, t, "en" if k % 2 == 0 else "de", "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def staged(spark):
    rows, out = corpus(), []
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema) if name != "packing" else stage(spark, docs, "")
        out.append(docs.collect())
    return rows, out


def test_quality(staged):
    rows, (kept, *_) = staged
    ids = {r["doc_id"] for r in kept}
    assert ids <= {k for k, t, *_ in rows if len(words(t)) >= 20 and 100 * measured(t)[4] <= 30 * measured(t)[0]}
    assert ids >= set(range(60)) and not ids & {k for k, t, *_ in rows if t in (None, "", "too short") or t.startswith(("###", "same"))}


def test_language(staged):
    _, (before, after, *_) = staged
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert not gone & set(range(60))
    assert sorted(map(tuple, after), key=str) == sorted((tuple(r) for r in before if r["doc_id"] not in gone), key=str)


def test_lines(staged):
    _, (_, before, after, *_) = staged
    want = slow_deduped([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after) and any(want[r["doc_id"]] != r["text"] for r in before)


def test_near(staged):
    _, (*_, before, after, _) = staged
    kept = {g[0] for g in components([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"] for r in after} == kept and len(after) < len(before)


def test_near_dedup_keeps_columns_with_its_names(spark):
    rows = [(k, t, "own", "s", 1, "mine") for k, t in [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "other words"), (3, None), (3, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _print string, _null int, n string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_packed(staged):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    _, (*_, before, pieces) = staged
    encode = unit_encoder(public_tokenizers.path("word_bpe_49k.json"))
    sums = {}
    for p in pieces:
        sums[p["doc_id"]] = sums.get(p["doc_id"], 0) + p["length"]
    assert sums == {r["doc_id"]: len(encode(r["text"])) // 2 + 1 for r in before}


def test_run_is_the_stages_in_turn(spark, tmp_path, staged):
    rows, (*_, last) = staged
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sum(r["length"] for r in got) == sum(r["length"] for r in last) and {r["doc_id"] for r in got} == {r["doc_id"] for r in last}
    assert len(got) == len({key(r) for r in got})


def test_quality_module_is_native():
    path = os.path.join(os.path.dirname(quality.__file__), "{}.py")
    for name in ("quality", "linededup"):
        text = open(path.format(name), encoding="utf-8").read()
        assert not any(w in text for w in ("pandas", "pyarrow", "mapIn", "applyIn", "udf(", ".rdd"))


def test_language_model_is_learned_in_little_driver_memory(spark):
    """The examples' counts are held once, in two bytes each; before, in eight, and several times over."""
    import random
    import tracemalloc

    from freightloom.llm import langid

    rnd, each = random.Random(5), 200
    rows = [(k, " ".join(rnd.choice(letters) + rnd.choice("xyz") + rnd.choice(letters) for _ in range(60)), letters) for k, letters in enumerate(["abcd", "efgh", "ijkl"] * each)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = langid.fitted(docs, langid.F.lit(True))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < len(rows) * langid.SIZE * 8
    assert {(r["lang"], r["lang_pred"]) for r in langid.identified(docs, model).collect()} == {(x, x) for x in ("abcd", "efgh", "ijkl")}
