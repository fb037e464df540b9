"""What several corpus operators share: words, column names and tokenizer caches."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.operators.scratch import dropped, written  # noqa: F401  (used by the operators here)

#: The separators of words: space, and tab to carriage return.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    spaced = F.coalesce(text, F.lit(""))
    for mark in WORD_SEPARATORS[1:]:
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it until no column of `df` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def sliced(sizes: list[int], bound: int) -> Iterator[range]:
    """Runs of positions whose sizes sum to about `bound` at most; a larger one is alone."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > bound:
            yield range(start, k)
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield range(start, len(sizes))


#: White space to the patterns of the tokenizers, as far as texts that are cut have it.
_SPACES = "\t-\r \x85\xa0"
#: Letters up to U+052F that lower-casing and normal forms treat one by one.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff" + "".join(
    c for c in map(chr, range(0x100, 0x530)) if c.isalpha() and is_normalized("NFC", c) and len(c.lower()) == 1 and c != "Σ"
)
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A text with any other character than these is encoded whole.
_OTHER = re.compile(f"[^\0-\xff‐-‧€{_LETTERS}]")
#: What Arrow takes for white space and the patterns don't.
_MARKS = "\x1c\x1d\x1e\x1f"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"


class UnitEncoder:
    """Ids of whole texts through the tokenizers library, which sees each distinct unit of a text once.

    A unit is a word of the tokenizer's own pattern, so the ids of a text are those of its units in order. `cut` gives
    the units of a text, `learn` the ids of distinct units, `whole` those of texts that aren't cut: such as `uncut`
    tells. In place of `cut`, `space` may give texts with white space between all units, of which units have none: then
    Arrow cuts, and Python sees what is distinct in the texts taken together. At most about `room` units are remembered in a worker; a full memory is emptied. Ids are little-endian
    unsigned integers of the numpy type `dtype`.
    """

    def __init__(self, cut: Callable[[str], list[str]] | None, learn: Callable[[list[str]], dict[str, bytes]], whole: Callable[[list[str]], list[bytes]], uncut: Callable[[str], bool], dtype: str, room: int, space: Callable[[list[str]], pa.Array] | None = None):
        self.cut, self.learn, self.whole, self.uncut, self.dtype, self.room, self.space = cut, learn, whole, uncut, dtype, room, space
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """The ids of `text`."""
        return self.together([text])[0]

    def together(self, texts: list[str]) -> list[bytes]:
        """The ids of each of the texts; units that are new to the worker are encoded in one go."""
        apart = [k for k, t in enumerate(texts) if self.uncut(t)]
        if apart:
            out: list[bytes] = [b""] * len(texts)
            rest = sorted(set(range(len(texts))).difference(apart))
            for some, found in ((apart, self.whole([texts[k] for k in apart])), (rest, self.together([texts[k] for k in rest]))):
                for k, ids in zip(some, found):
                    out[k] = ids
            return out
        if self.space:
            return self._gathered(self.space(texts))
        units = list(map(self.cut, texts))
        self._met(units)
        return [b"".join(map(self.known.__getitem__, u)) for u in units]

    def _met(self, units: list[list[str]]) -> None:
        """Learns what is new among the units."""
        if new := set().union(*units).difference(self.known):
            if len(self.known) + len(new) > self.room:
                self.known.clear()
                new = set().union(*units)
            self.known.update(self.learn(list(new)))

    def _gathered(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of the spaced texts, from those of their distinct units."""
        runs = pc.utf8_split_whitespace(texts)
        codes = runs.flatten().dictionary_encode()
        units = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._met([units])
        found = list(map(self.known.__getitem__, units))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        ids = np.frombuffer(b"".join(found), self.dtype)
        at = codes.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(np.append(0, n))
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[runs.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def many(self, texts: Iterable[str], chars: int = 4_000_000) -> Iterator[bytes]:
        """The ids of each text in turn, taking texts of about `chars` characters together."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= chars:
                yield from self.together(held)
                held, size = [], 0
        if held:
            yield from self.together(held)


#: How the two kinds of tokenizer files whose texts can be cut prepare them.
_LEADING_SPACES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_BARE_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def unit_encoder(path: str, room: int = 1_000_000) -> UnitEncoder:
    """The encoder for a tokenizer file: ids as the library's `encode` gives them with add_special_tokens=False.

    The files of byte-level BPE with leading spaces and of bare words are known, their texts are cut into units; texts
    with one of the file's added tokens or letters beyond U+052F, and all texts of any other file, are encoded whole.
    One for each worker process, so that what it remembers serves all its tasks.
    """
    if (path, room) not in _ENCODERS:
        _ENCODERS[path, room] = _loaded(path, room)
    return _ENCODERS[path, room]


def _loaded(path: str, room: int) -> UnitEncoder:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    model = parts["model"]
    dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    batch = tokenizer.encode_batch_fast

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in batch(texts, add_special_tokens=False)]

    prepared = (parts["normalizer"], parts["pre_tokenizer"])
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not parts["post_processor"]
    bare = prepared == _BARE_WORDS and bool(model.get("end_of_word_suffix"))
    if not plain or not (bare or prepared == _LEADING_SPACES):
        return UnitEncoder(list, dict, whole, lambda text: True, dtype.str, room)
    # In the ids of a line of units, bare ones end with a piece of the suffix, ones behind a space start with a piece
    # that has it, ones behind a line feed have its id before them.
    last, first, feed = np.zeros((3, tokenizer.get_vocab_size()), bool)
    for piece, k in tokenizer.get_vocab(with_added_tokens=False).items():
        last[k] = bare and piece.endswith(model["end_of_word_suffix"])
        first[k], feed[k] = piece[0] == "Ġ", piece == "Ċ"

    def lined(units: list[str], before: str, marks: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """The ids of units from lines of them, cut where the marked ids are."""
        for k in range(0, len(units), 16384):
            some = units[k : k + 16384]
            ids = np.array(batch([before + before.join(some)], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(marks[ids])
            starts, ends = (np.append(0, at[:-1] + 1), at + 1) if bare else (at + len(before), np.append(at[1:], len(ids)))
            raw, wide = ids.astype(dtype).tobytes(), dtype.itemsize
            yield from zip(some, [raw[a * wide : b * wide] for a, b in zip(starts.tolist(), ends.tolist())])

    if bare:
        # Letters are what lies between these units.
        others = f"{_ENDINGS}|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+"
        cut, space = None, lambda texts: pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.string()), others, r" \0 ")
        # Beside white space at an end there is an empty unit.
        learn = lambda new: {"": b""} | dict(lined(list(filter(None, new)), " ", last))
    else:
        pattern = re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        blank = re.compile(f"[{_SPACES}]+")
        cut, space = pattern.findall, None

        def learn(new: list[str]) -> dict[str, bytes]:
            gaps = [u for u in new if blank.fullmatch(u)]
            behind = [u for u in new if u[0] == " " and not blank.fullmatch(u)]
            others = [u for u in new if not blank.match(u)]
            return dict(zip(gaps, whole(gaps))) | dict(lined(behind, "", first)) | dict(lined(others, "\n", feed))

    kept = [t["content"] for t in parts["added_tokens"]] + [*_MARKS] * bare

    def uncut(text: str) -> bool:
        if any(map(text.__contains__, kept)):
            return True
        try:
            text.encode("latin-1")  # most texts; they have no other character
            return False
        except UnicodeEncodeError:
            return bool(_OTHER.search(text))

    return UnitEncoder(cut, learn, whole, uncut, dtype.str, room, space)
