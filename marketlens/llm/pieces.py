"""Texts cut into the pieces that a BPE tokenizer encodes one by one, on whole Arrow batches.

The two patterns are those of the tokenizer files; their character classes are asked of the tokenizers
library itself, once for each character met, so that they cannot differ from it.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from marketlens.llm.common import ragged

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
_LAST = 0x110000
_SHORT = [ord(c) for c in "stmd"]
_LONG = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


class Classes:
    """The class of each code point, filled in as code points are met."""

    def __init__(self) -> None:
        self.table = np.full(_LAST, UNKNOWN, np.uint8)
        self._tests = [Split(Regex(p), "removed", invert=True) for p in (r"\p{L}", r"\p{N}", r"\s")]

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                hits = [i for i, test in enumerate(self._tests) if test.pre_tokenize_str(chr(point))]
                self.table[point] = hits[0] if hits else OTHER
            found = self.table[points]
        return found


def contractions(points: np.ndarray, starts: np.ndarray, single: np.ndarray, doc_end: np.ndarray) -> None:
    """Cut 's 't 'm 'd 're 've 'll after a lone apostrophe that begins a piece; changes starts in place."""
    at = np.flatnonzero((points == 39) & starts & single)
    at = at[at + 1 < doc_end[at]]
    if not len(at):
        return
    short = at[np.isin(points[at + 1], _SHORT)]
    two = at[at + 2 < doc_end[at]]
    long = [two[(points[two + 1] == a) & (points[two + 2] == b)] for a, b in _LONG]
    for found, width in [(short, 2), *((x, 3) for x in long)]:
        starts[found + 1] = False
        after = found + width
        starts[after[after < len(starts)]] = True


def piece_starts(points: np.ndarray, doc_starts: np.ndarray, classes: Classes, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mask of code points that begin a piece, class of each code point).

    spaced: a blank goes with the run after it and runs of digits stay whole (byte-level pattern);
    otherwise white space forms pieces to be dropped and each digit is one piece (word pattern).
    """
    n = len(points)
    kind = classes.of(points)
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[doc_starts[doc_starts < n]] = True
    bounds = np.append(doc_starts[doc_starts < n], n)
    doc_end = np.repeat(bounds[1:], np.diff(bounds))
    run = np.flatnonzero(starts)
    run_end = np.append(run[1:], n)
    single = np.zeros(n, bool)
    single[run[run_end - run == 1]] = True
    if spaced:
        follow = (kind[run] == SPACE) & (run_end < doc_end[run])
        last = run_end[follow] - 1
        starts[last] = True
        glued = last[points[last] == 32]
        starts[glued + 1] = False
    else:
        starts |= kind == NUMBER
    contractions(points, starts, single, doc_end)
    return starts, kind


def text_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together and where each text starts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)))[:-1]


def pieces(texts: list[str], classes: Classes, spaced: bool) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(all pieces in order, number of pieces of each text, mask of pieces that are white space)."""
    points, doc_starts = text_points(texts)
    if not len(points):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64), np.zeros(0, bool)
    starts, kind = piece_starts(points, doc_starts, classes, spaced)
    at = np.flatnonzero(starts)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.concatenate(([0], np.cumsum(width)))
    data = "".join(texts).encode("utf-8", "surrogatepass")
    cuts = offset[np.append(at, len(points))].astype(np.int32)
    array = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(data))
    ends = np.append(doc_starts[1:], len(points))
    counts = np.searchsorted(at, ends) - np.searchsorted(at, doc_starts)
    blank = np.zeros(len(at), bool) if spaced else kind[at] == SPACE
    return array, counts, blank


class WordIds:
    """Ids of pieces, remembered in one buffer; past `limit` pieces only those of the chunk at hand are kept.

    encode: pieces -> (ids of all of them in order, number of ids of each).
    """

    def __init__(self, encode, limit: int = 800_000) -> None:
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._flat, self._size, self._start = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)
        self._used = 0

    @staticmethod
    def _room(buffer: np.ndarray, used: int, more: int) -> np.ndarray:
        """The buffer, at least doubled where `more` elements do not fit behind `used` ones."""
        if used + more <= len(buffer):
            return buffer
        grown = np.zeros(max(2 * len(buffer), used + more), buffer.dtype)
        grown[:used] = buffer[:used]
        return grown

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        known, used = len(self._place), self._used
        self._flat = self._room(self._flat, used, len(flat))
        self._size, self._start = (self._room(b, known, len(words)) for b in (self._size, self._start))
        self._flat[used : used + len(flat)] = flat
        self._size[known : known + len(words)] = sizes
        self._start[known : known + len(words)] = used + np.cumsum(sizes) - sizes
        self._place.update(zip(words, range(known, known + len(words)), strict=True))
        self._used += len(flat)

    def ids(self, array: pa.StringArray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        if not len(array):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = array.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._place) + len(words) > self._limit:
            kept = [w for w in words if w in self._place]
            at = np.fromiter(map(self._place.__getitem__, kept), np.int64, len(kept))
            start, sizes, flat = self._start[at], self._size[at], self._flat
            self._clear()
            self._add(kept, flat[ragged(start, sizes.astype(np.int64))], sizes)
        at = list(map(self._place.get, words))
        new = [i for i, place in enumerate(at) if place is None]
        if new:
            first = len(self._place)
            self._add(fresh := [words[i] for i in new], *self._encode(fresh))
            for place, i in enumerate(new, first):
                at[i] = place
        place = np.array(at, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = np.where(blank, 0, self._size[place]).astype(np.int64)
        return self._flat[ragged(self._start[place], lengths)].astype(np.int64), lengths


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """Text parts and special ids in order; at one place the longest special string wins, the first place first."""
    parts: list[str | int] = []
    while text:
        hits = [(text.find(s), -len(s), s) for s in special if s and s in text]
        if not hits:
            parts.append(text)
            break
        at, _, s = min(hits)
        if at:
            parts.append(text[:at])
        parts.append(special[s])
        text = text[at + len(s) :]
    return parts


class BatchEncoder:
    """Ids of whole texts from ids of pieces. normalise: str -> str, applied between special tokens."""

    def __init__(self, encode_words, special: dict[str, int], spaced: bool, normalise=None) -> None:
        self.classes, self.words = Classes(), WordIds(encode_words)
        self._special, self._spaced, self._normalise = special, spaced, normalise

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        whole = "".join(texts)
        if any(s in whole for s in self._special):
            split = [split_special(t, self._special) for t in texts]
            parts = [p for row in split for p in row]
            ids, sizes = self._plain([p if isinstance(p, str) else "" for p in parts])
            cut = np.cumsum(sizes)
            given = np.flatnonzero([not isinstance(p, str) for p in parts])
            ids = np.insert(ids, cut[given], [parts[i] for i in given])
            sizes[given] = 1
            rows = np.asarray([len(r) for r in split], np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            bounds = np.concatenate(([0], np.cumsum(rows)))
            return ids, ends[bounds[1:]] - ends[bounds[:-1]]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._normalise:
            texts = [self._normalise(t) for t in texts]
        array, counts, blank = pieces(texts, self.classes, self._spaced)
        ids, lengths = self.words.ids(array, blank)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids, ends[bounds[1:]] - ends[bounds[:-1]]


def byte_level_encoder(path: str) -> BatchEncoder:
    """Ids as the tokenizers library gives them for a byte-level file: it encodes every distinct piece."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(found.ids, np.int32), np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(words))

    return BatchEncoder(encode, special_tokens(path), True)


class LowerNfc:
    """NFC, then lower case per character as the library's normaliser has it.

    Characters that the library lower-cases differently from Python (known after one look at each) send
    the text to the library's normaliser.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self._library = tokenizer.normalizer
        self._same: dict[str, bool] = {}

    def _as_python(self, text: str) -> bool:
        for c in set(text):
            if c not in self._same:
                self._same[c] = c.isspace() or self._library.normalize_str(c) == unicodedata.normalize("NFC", c).lower() or c == "Σ"
            if not self._same[c]:
                return False
        return True

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not self._as_python(text):
            return self._library.normalize_str(text)
        # A sigma at a word's end has a lower case of its own in Python only.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
