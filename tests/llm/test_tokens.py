"""Operators on token ids: planes, pieces, packing."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from freightloom.llm import packing, pieces, tokens  # noqa: E402
from freightloom.llm.common import unit_encoder  # noqa: E402

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
RANDOM = random.Random(6)
ALPHABET = "ab c'sé\n\n \t\r\xa0 1,.!\x1c\0日ﬁİΣA<|>́　▁😀"
TEXTS = ["".join(RANDOM.choice(ALPHABET) for _ in range(RANDOM.randint(0, 40))) for _ in range(800)]
TEXTS += ["", " ", "plain words, and more.\nNext line of words.", "<|endoftext|> <|startoftext|>", "don't  stop", "long" * 500]
ROWS = [(None, None), (None, "null id"), *enumerate(TEXTS), (3, TEXTS[3])]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("room", [1_000_000, 10])
def test_units_give_the_ids_of_whole_texts(path, room):
    tokenizer = Tokenizer.from_file(path)
    encode = unit_encoder(path, room)
    for text, e in zip(TEXTS, tokenizer.encode_batch(TEXTS, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u2").tolist() == e.ids, text


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 256), (100, 300), (5000, 60000), (777, 1 << 20), (64, 1 << 32)])
def test_planes_round_trip(bits, n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    width, planes = tokens.to_planes(ids, bits, block=128)
    assert len(planes) == width * (8 if bits else 1)
    assert (tokens.from_planes(planes, n, width, bits, 128) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, tmp_path, bits):
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, part int")
    tokens.write(tokens.encoded(docs, BYTES, 0, parts=3, chunk_ids=500, bits=bits), str(tmp_path / "t"))
    got = sorted(tokens.read_documents(tokens.read(spark, str(tmp_path / "t")), with_ids=True).collect(), key=lambda r: r["start"])
    tokenizer = Tokenizer.from_file(BYTES)
    assert len(got) == len(ROWS)
    start, texts = 0, {}
    for k, t in ROWS:
        texts.setdefault(k, set()).add((*tokenizer.encode(t or "", add_special_tokens=False).ids, 0))
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    for r in got:
        ids = np.array(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        assert tuple(r["ids"]) in texts[r["key"]]
        start += len(ids)
    tokens.write(tokens.encoded(docs.limit(0), BYTES, 0), str(tmp_path / "none"))
    assert tokens.read_documents(tokens.read(spark, str(tmp_path / "none"))).collect() == []


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = pieces.Vocabulary.load(PIECES)
    texts = [t.replace("\0", "") for t in TEXTS] + ["   many   spaces   ", "tab\tand\nline", "<s> </s> <0x41>", "aaaaaaaaaaaaaaa", "-------====", "𝔘𝔫𝔦"]
    for text, ids in zip(texts, vocab.encode_texts(texts)):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == sp.encode(text), text
        assert vocab.decode(got) == sp.decode(got.tolist())
        assert vocab.decode(got) == text.replace("▁", " ")


def test_unigram_walk_is_viterbi():
    rnd = random.Random(8)
    names = ["a", "b", "ab", "ba", "aab", "bb", "abab", "▁", "▁a"]
    vocab = pieces.Vocabulary([f"<{k}>" for k in range(256)] + names, [0.0] * 256 + [-rnd.random() * 5 for _ in names], list(range(256)), kind="unigram")

    def best(unit):
        if not unit:
            return 0.0
        options = [best(unit[len(p) :]) + vocab.scores[vocab.ids[p]] for p in names if unit.startswith(p)]
        return max(options, default=-np.inf) if unit[0] in vocab.chars else best(unit[1:]) + vocab.unknown

    units = {"".join(rnd.choice("▁abx") for _ in range(rnd.randint(1, 9))) for _ in range(200)}
    for unit, ids in vocab.encode(units).items():
        got = np.frombuffer(ids, "<u4").tolist()
        assert vocab.decode(np.array(got)) == unit.replace("▁", " ").removeprefix(" ")
        score = sum(vocab.scores[k] if k > 255 else vocab.unknown for k in got)
        assert score == pytest.approx(best(unit))


def test_piece_rows(spark):
    rows = [(k, t.replace("\0", "") if t else t, 1) for k, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = pieces.encoded(docs, PIECES, batch_chars=300)
    back = pieces.decoded(coded, PIECES).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((k, t if t is None else t.replace("▁", " ")) for k, t, _ in rows), key=str)
    assert pieces.encoded(docs.limit(0), PIECES).collect() == []


@pytest.mark.parametrize("size", [16, 64])
def test_every_id_lies_in_one_piece(spark, size):
    docs = spark.createDataFrame([(k, t, "own") for k, t in ROWS[2:-1]], "doc_id long, text string, start string")
    got = packing.packed(docs, WORDS, 1, size=size, shard_ids=3000, with_ids=True).collect()
    encode = unit_encoder(WORDS)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert set(by_doc) == {k for k, _ in ROWS if k is not None}
    for k, rs in by_doc.items():
        rs.sort(key=lambda r: r["start"])
        ids = [i for r in rs for i in r["ids"]]
        assert ids == [*np.frombuffer(encode(TEXTS[k]), "<u2").tolist(), 1] and {r["doc_tokens"] for r in rs} == {len(ids)}
        assert [r["start"] for r in rs] == np.cumsum([0, *[r["length"] for r in rs][:-1]]).tolist()
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in rs)
        assert [r["offset"] for r in rs] == np.cumsum([0, *[r["length"] for r in rs][:-1]]).tolist()
        assert total <= size and total & (total - 1) == 0


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "long text " * 3000)], "doc_id long, text string")
    got = packing.packed(docs, WORDS, 1).collect()
    assert sum(r["length"] for r in got) == 3 + 6001
    assert packing.packed(docs.limit(0), WORDS, 1).collect() == []


def test_neighbours_come_first():
    alike = [np.array([1, 2, 3, 4, 5, 6] * 3, np.uint16), np.array([1, 2, 3, 4, 5, 9] * 3, np.uint16)]
    others = [np.arange(20 * k, 20 * k + 18).astype(np.uint16) for k in range(2, 8)]
    sequences = list(packing.filled([alike[0], *others, alike[1]], 36))
    assert {d for d, _, _ in sequences[0]} == {0, 7}


def test_texts_together_give_the_ids_of_each():
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(TEXTS, add_special_tokens=False)]
    assert [np.frombuffer(got, "<u2").tolist() for got in unit_encoder(WORDS, 500).many(TEXTS, 700)] == want


def test_python_sees_only_distinct_words():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    encode = unit_encoder(WORDS, 501)
    encode.known = Counted()
    assert len(encode("Some words, more words. " * 2000)) == 2 * 12_000 and 0 < Counted.asked < 20
