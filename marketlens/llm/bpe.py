"""BPE encoding and decoding: propose by greedy longest match, verify all adjacent pairs, merge what fails.

A sequence of tokens is what the merge list produces exactly if every two neighbours alone would stay
apart. Distinct words of a batch are proposed and tested together in numpy; only words with a failing
pair are merged one by one. The end-of-word mark is a symbol of its own that belongs to the last byte.

Defined results: null text is an empty text with no ids; an empty text decodes to an empty text; rows
with equal ids are encoded row by row; other columns pass through untouched, and columns named as a result are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from marketlens.llm.common import chunks, utf8
from marketlens.llm.pieces import BatchEncoder, LowerNfc, special_tokens

#: Stands for the end-of-word mark in a word's symbols.
_END = 256


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Merger:
    """A merge list: exact merging of one word, and the greedy proposal with its pair test for many."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        letters = byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters])
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters])
        value = {c: b for b, c in enumerate(letters)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), (i, vocab[a + b]))
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        # Symbols of each token; a token with a character outside the byte letters can't occur.
        self.symbols: dict[int, tuple[int, ...]] = {}
        for token, i in vocab.items():
            ended = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ended else token
            if body and all(c in value for c in body):
                self.symbols[i] = (*(value[c] for c in body), *([_END] if ended else ()))
        self.by_symbols = {s: i for i, s in self.symbols.items()}
        self.longest = max(map(len, self.symbols.values()))
        # Filled on demand: parts of a token, and when it comes to be (letters: -1; -2: merging never gives it).
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.made, self.known = np.full(self.size, -1), np.zeros(self.size, bool)

    def start(self, word: bytes) -> list[int]:
        return [int(self.first[b]) for b in word[:-1]] + [int(self.last[word[-1]])]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ranks first."""
        return self._merge(ids)[0]

    def _merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int]]:
        ids, final = [i for i in ids if i >= 0], (-1, -1, -1)
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            final = (ids[k], ids[k + 1], best[0])
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids, final

    def learn(self, tokens: np.ndarray) -> None:
        """Fill in the parts of these tokens and of their parts."""
        todo = [t for t in np.unique(tokens).tolist() if not self.known[t]]
        while todo:
            t = todo.pop()
            if self.known[t]:
                continue
            self.known[t] = True
            body = self.symbols[t]
            ids, (a, b, when) = self._merge(self.start(bytes(body[:-1])) if body[-1] == _END else [int(self.first[s]) for s in body])
            if ids != [t]:
                self.made[t] = -2
            elif a >= 0:
                self.left[t], self.right[t], self.made[t] = a, b, when
                todo += [a, b]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging their joined letters give just these two?

        Undo merges, latest first. While a pair of parts faced each other, no merge of the two may have
        been due before the merge that ended that state; at equal ranks the left one comes first.
        """
        a, b = a.copy(), b.copy()
        good = (self.made[a] > -2) & (self.made[b] > -2)
        limit = np.full(len(a), 1 << 40)
        live = np.flatnonzero(good)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            good[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            on_left = self.made[x] > self.made[y]
            ended = np.where(on_left, self.made[x], self.made[y])
            live_on = ended >= 0
            limit[live] = np.where(on_left, ended, ended + 1)
            a[live] = np.where(on_left & live_on, self.right[x], x)
            b[live] = np.where(~on_left & live_on, self.left[y], y)
            live = live[live_on]
        return good

    def greedy(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Longest-match proposals, and which words have one."""
        done, ok = [], np.ones(len(words), bool)
        for k, word in enumerate(words):
            symbols, ids, i = (*word, _END), [], 0
            while i < len(symbols):
                for j in range(min(len(symbols), i + self.longest), i, -1):
                    token = self.by_symbols.get(symbols[i:j]) if j != len(symbols) - 1 else None
                    if token is not None:
                        ids.append(token)
                        i = j
                        break
                else:
                    ok[k] = False
                    break
            done.append(ids)
        return done, ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed, ok = self.greedy(raw)
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        self.learn(flat)
        owner = np.repeat(np.arange(len(words)), sizes)
        if len(flat):
            ok[owner[self.made[flat] == -2]] = False
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            good = self.apart(pairs // self.size, pairs % self.size)[back]
            ok[owner[inner[~good]]] = False
        return [p if fine else self.merge(self.start(w)) for p, fine, w in zip(proposed, ok, raw, strict=True)]


    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        found = self.encode_words(words)
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))


class Codec:
    """Encoder and decoder of one tokenizer file of the word kind."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        special = special_tokens(path)
        self.merger = Merger(path)
        self.encode = BatchEncoder(self.merger.encode_flat, special, False, LowerNfc(tokenizer))
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"] | special
        names = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            names[i] = token
        self.names = pa.array(names, pa.large_string())

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Token strings joined by blanks, as a tokenizer file without a decoder is decoded."""
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with ids (array<int>) and decoded (string) instead of its text; a narrow step without a shuffle."""
    if {"ids", "decoded"} & set(docs.columns) - {text}:
        raise ValueError("docs has columns with names of this operator's results")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(len(kept))
            _, offsets = utf8(column)
            for start, stop in chunks(offsets):
                ids, sizes = c.encode([t or "" for t in column.slice(start, stop - start).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, lists, c.decode(ids, sizes).cast(pa.string())], names=schema.names)

    return docs.select(*[f.name for f in kept], text).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without carrying ids out of the tasks."""
    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for start, stop in chunks(offsets):
                ids, sizes = c.encode([t or "" for t in column.slice(start, stop - start).to_pylist()])
                raw, ends = ids.astype("<u4"), np.concatenate(([0], np.cumsum(sizes)))
                of_ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                plain, cut = utf8(c.decode(ids, sizes))
                of_text = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["k", "n", "i", "d"])

    return docs.selectExpr(f"cast({key} as long) as {key}", text).mapInArrow(run, schema)
