"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text is marked (a space becomes U+2581, one goes in front) and cut into units that no piece of the vocabulary
crosses. The distinct units of a batch are sorted, which lays them out as a depth-first walk of their trie: what a
unit shares with the one before it keeps its forward values, only the rest is computed.

The forward value of a prefix is the last piece of its best segmentation and what that segmentation scores. For a
unigram model the best is the largest sum of scores (Viterbi). For a BPE model sums of scores would not give the
model's own result; there a piece may follow another only if merging their joined text leaves exactly those two, which
singles out one last piece for every prefix, and the same walk over the same trie gives the library's ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightloom.llm.common import fresh

MARK = "▁"
_UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with their scores, as the model file gives them; characters without a piece fall back to bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: Iterable[int] = (), kind: str = "bpe"):
        special = set(special) | set(byte_ids)
        self.pieces, self.kind, self.byte_ids = pieces, kind, byte_ids
        self.ids = {p: k for k, p in enumerate(pieces) if k not in special and p}
        self.scores = scores
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.unknown = min((scores[k] for k in self.ids.values()), default=0.0) - _UNKNOWN_PENALTY
        # A unit ends before a mark that follows anything else, and at characters of no piece.
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        alone = "".join(c for c in map(chr, range(32)) if c not in self.chars)
        stop = re.escape(alone)
        self.unit = re.compile(f"(?s:.+)" if crossing else f"{MARK}*[^{MARK}{stop}]+|[{stop}]|{MARK}+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.raw = [p.replace(MARK, " ").encode() for p in pieces]
        for value, k in enumerate(byte_ids):
            self.raw[k] = bytes([value])
        for k in set(special) - set(byte_ids):
            self.raw[k] = b""

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.vocab_size())
        special = [k for k in every if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)]
        byte_ids = [k for k in every if sp.is_byte(k)]
        return cls([sp.id_to_piece(k) for k in every], [sp.get_score(k) for k in every], byte_ids, special, kind)

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: the best-scored joint first, ties to the left."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                joint = ids.get(parts[k] + parts[k + 1])
                if joint is not None and scores[joint] > best:
                    best, at = scores[joint], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """May piece `right` come after piece `left` (-1: at the start)?"""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = "" if left < 0 else self.pieces[left], self.pieces[right]
            known = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct units, as little-endian unsigned 32-bit integers."""
        ids, suffixes, chars, pairs, follows = self.ids, self.suffixes, self.chars, self.pairs, self.follows
        bpe, piece_scores = self.kind == "bpe", self.scores
        out: dict[str, bytes] = {}
        before = ""
        last, back, total = [-1], [0], [0.0]  # by prefix length: the last piece, where it starts, the sum of scores
        for unit in sorted(units):
            shared = 0
            for x, y in zip(unit, before):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], back[shared + 1 :], total[shared + 1 :]
            before = unit
            for end in range(shared + 1, len(unit) + 1):
                if unit[end - 1] not in chars and bpe:
                    last.append(-2)  # bytes: nothing joins them
                    back.append(end - 1)
                    total.append(0.0)
                    continue
                found = []
                start = end - 1
                while start >= 0 and (s := unit[start:end]) in suffixes:
                    if (k := ids.get(s)) is not None:
                        found.append((k, start))
                    start -= 1
                if bpe:
                    for k, start in reversed(found):
                        left = last[start] if start and last[start] != -2 else -1
                        if (known := pairs.get((left, k))) or (known is None and follows(left, k)):
                            last.append(k)
                            back.append(start)
                            total.append(total[start] + piece_scores[k])
                            break
                    else:  # no piece ends here: the vocabulary has pieces that merging doesn't make
                        break
                else:
                    best, place, piece = total[end - 1] + self.unknown, end - 1, -2
                    if unit[end - 1] in chars:
                        best = -np.inf
                    for k, start in reversed(found):
                        if (score := total[start] + piece_scores[k]) > best:
                            best, place, piece = score, start, k
                    last.append(piece)
                    back.append(place)
                    total.append(best)
            if len(last) <= len(unit):
                out[unit] = np.array([k for p in self.merged(unit) for k in ([ids[p]] if p in ids else [self.byte_ids[v] for v in p.encode()])], "<u4").tobytes()
                continue
            path, at = [], len(unit)
            while at:
                if last[at] == -2:
                    path.extend(self.byte_ids[v] for v in reversed(unit[back[at] : at].encode()))
                else:
                    path.append(last[at])
                at = back[at]
            out[unit] = np.array(path[::-1], "<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: bytes that aren't UTF-8 become U+FFFD, the mark in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; the units of all of them are encoded in one walk."""
        cut = [self.unit.findall((MARK + t.replace(" ", MARK)) if t else "") for t in texts]
        known = self.encode({u for units in cut for u in units})
        return [b"".join(map(known.__getitem__, units)) for units in cut]


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, kind: str) -> Vocabulary:
    """Loaded once in a worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Vocabulary.load(path, kind)
    return _LOADED[path, kind]


def encoded(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None, kind: str = "bpe", digest: bool = False, batch_chars: int = 4_000_000) -> DataFrame:
    """The columns in `carry` (default: all) of every row, with `ids` (array of ints), or with `digest` only
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and decoded_crc32 (of the text that
    the ids decode to, in UTF-8).

    A null text has null ids (digest: 0 tokens); an empty text has none. Repeated rows get equal ids, an empty table
    stays empty, long texts are taken whole. Texts are taken together up to about
    `batch_chars` characters; a longer one is taken alone. Input columns with the new names are replaced.
    """
    new = ["n_tokens", "ids_crc32", "decoded_crc32"] if digest else ["ids"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    t = fresh(docs.select(*carry), "_text")
    source = docs.select(*carry, F.col(text).alias(t))
    schema = source.select(*carry).schema
    for c in new:
        schema = schema.add(c, T.LongType() if digest else T.ArrayType(T.IntegerType()))

    def results(texts: list[str | None]) -> list[list]:
        vocab = vocabulary(model, kind)
        got = vocab.encode_texts([x or "" for x in texts])
        if not digest:
            return [[None if x is None else np.frombuffer(g, "<u4").astype(np.int32) for x, g in zip(texts, got)]]
        decoded = [vocab.decode(np.frombuffer(g, "<u4")).encode() for g in got]
        return [[len(g) // 4 for g in got], [zlib.crc32(g) for g in got], [zlib.crc32(d) for d in decoded]]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start = 0
            while start < batch.num_rows:
                stop, size, some = start, 0, []
                while stop < batch.num_rows and (stop == start or size < batch_chars):
                    some.append(texts[stop].as_py())
                    size += len(some[-1] or "")
                    stop += 1
                part = batch.slice(start, stop - start)
                kind_of = pa.int64() if digest else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c, kind_of) for c in results(some)]], names=[*carry, *new])
                start = stop

    return source.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, ids: str = "ids", out: str = "text", kind: str = "bpe") -> DataFrame:
    """All rows and columns but `ids`, with the text of the ids in `out` (null for null)."""
    carry = [c for c in rows.columns if c.lower() not in (ids.lower(), out.lower())]
    source = rows.select(*carry, F.col(ids))
    schema = source.select(*carry).schema.add(out, "string")

    def run(batches):
        vocab = vocabulary(model, kind)
        for batch in batches:
            texts = [None if x is None else vocab.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*carry, out])

    return source.mapInArrow(run, schema)


def op10_pieces(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of every document's ids, and round_trip: the ids decode to the text itself. A null text counts as an
    empty one with no ids, repeated rows get equal digests, an empty table gives no rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"))
    out = encoded(docs, model or public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "text_crc32"], digest=True)
    return out.select("doc_id", "n_tokens", "ids_crc32", (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))
