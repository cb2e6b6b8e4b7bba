"""Byte-pair encoding and decoding of whole texts with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hushlake.llm.token_ids import TOKENIZER, may_lower, pieces_of, text_chunks

HELD_WORDS = 350_000  # remembered by a worker in each of two generations
#: Texts where the pattern of the vocabulary file leaves no question of Unicode: their characters are printable ASCII or
#: letters of Latin-1, which every edition has as letters that compose with nothing here.
LATIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Words of such a text, lowered, as UTF-8: all bytes beyond ASCII are of letters.
PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9 \x80-\xff]+")
#: The printable letter that the vocabulary file has for each byte: itself where it is printable, else the next beyond 255.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: chr(b) for b in SHOWN} | {b: chr(0x100 + n) for n, b in enumerate(sorted({*range(0x100)} - {*SHOWN}))}
SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Generations:
    """Remembers up to twice ``size`` values: what has not been asked for since the newer half filled up is forgotten."""

    def __init__(self, size: int) -> None:
        self._size, self._new, self._old = size, {}, {}

    def get(self, key):
        found = self._new.get(key)
        if found is None and (found := self._old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self._new) >= self._size:
            self._old, self._new = self._new, {}
        self._new[key] = value
        return value


class Codec:
    """Word-level BPE as the vocabulary file describes it; the merges of a word and the way back are made here."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self._special).items()}
        self._byte = {ord(letter): b for b, letter in LETTERS.items()}
        #: Ids of a byte within a word and at its end; bytes that the vocabulary lacks are left out.
        self._within = [ids.get(LETTERS[b]) for b in range(0x100)]
        self._last = [ids.get(LETTERS[b] + end) for b in range(0x100)]
        #: By left and right id: the rank of their merge, by rank: what they merge to.
        self._ranks: dict[int, dict[int, int]] = {i: {} for i in self.tokens}
        self._merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self._ranks[ids[left]][ids[right]] = rank
            self._merged.append(ids[left + right])
        self._digits = {i: b"%d " % i for i in self.tokens}
        self._strings = {i: token.encode() + b" " for i, token in self.tokens.items()}
        self._known, self._written = Generations(HELD_WORDS), Generations(HELD_WORDS)
        self._marks = re.compile("|".join(map(re.escape, self._special)))
        #: Only cuts texts into words: which characters are letters depends on the library's edition of Unicode.
        self._library = Tokenizer.from_file(path)

    def _plain(self, text: str) -> list[bytes]:
        """Normalised words of a text without special tokens."""
        if LATIN.fullmatch(text):
            return PLAIN.findall(text.lower().encode())
        normal = self._library.normalizer.normalize_str(text)
        return [word.translate(self._byte).encode("latin-1") for word, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _words(self, text: str) -> list[bytes | str]:
        """Normalised words of a text; strings of special tokens in it stay strings."""
        if "<|" not in text:
            return self._plain(text)
        words, at = [], 0
        for mark in self._marks.finditer(text):
            words += [*self._plain(text[at : mark.start()]), mark.group()]
            at = mark.end()
        return words + self._plain(text[at:])

    def _merge(self, word: bytes | str) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged first, of equal ranks the leftmost."""
        if isinstance(word, str):
            return [self._special[word]]
        ranks_of, merged_of = self._ranks, self._merged
        symbol = [*map(self._within.__getitem__, word)]
        symbol[-1] = self._last[word[-1]]
        if None in symbol:
            symbol = [s for s in symbol if s is not None]
        n = len(symbol)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        #: Rank of each symbol with the one that stands to its right now, -1 for none.
        ranks = [ranks_of[left].get(right, -1) for left, right in pairwise(symbol)]
        ranks.append(-1)
        queue = [rank * n + left for left, rank in enumerate(ranks) if rank >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, left = entry // n, entry % n
            if ranks[left] != rank:
                continue  # stale: one of the two has changed since
            merged = symbol[left] = merged_of[rank]
            right = after[left]
            symbol[right] = ranks[right] = ranks[left] = -1
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                if (rank := ranks_of[merged].get(symbol[right], -1)) >= 0:
                    ranks[left] = rank
                    heappush(queue, rank * n + left)
            left = before[left]
            if left >= 0:
                rank = ranks[left] = ranks_of[symbol[left]].get(merged, -1)
                if rank >= 0:
                    heappush(queue, rank * n + left)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens in it are those tokens."""
        ids = []
        for word in self._words(text):
            if (found := self._known.get(word)) is None:
                found = self._known.put(word, tuple(self._merge(word)))
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids; the file names no decoder, so blanks stand between them."""
        return " ".join([self.tokens[i] for i in ids])

    def _write(self, word: bytes | str) -> tuple[int, bytes, bytes]:
        if (found := self._written.get(word)) is None:
            ids = self._merge(word)
            digits, strings = map(self._digits.__getitem__, ids), map(self._strings.__getitem__, ids)
            found = self._written.put(word, (len(ids), b"".join(digits), b"".join(strings)))
        return found

    def written(self, piece: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids of a text, and as :func:`encode` and :func:`decode` have them its decimal ids and its decoded text, with a blank after each id."""
        if piece.isalpha() and piece.islower():  # of bytes: a-z alone
            return self._write(piece)
        words = self._words(piece.decode("utf-8", "replace"))
        if len(words) == 1:
            return self._write(words[0])
        found = [*map(self._write, words)]
        return sum(w[0] for w in found), b"".join([w[1] for w in found]), b"".join([w[2] for w in found])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids of rows and the pieces between ASCII blanks of their texts; no word goes over a blank."""
    for whole in batches:
        for cut in range(0, whole.num_rows, size):
            batch = whole.slice(cut, size)
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield batch.column("doc_id").to_pylist(), [(text.lower() if may_lower(text) else text).split() for text in texts]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])


def encode_decode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``docs``; a null or empty text has no ids and decodes to ``''``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for doc_ids, texts in _rows(batches, 64):
            known: dict[bytes, list[int]] = {}
            ids = []
            for pieces in texts:
                for piece in pieces:
                    if piece not in known:
                        known[piece] = own.encode(piece.decode("utf-8", "replace"))
                ids.append([i for piece in pieces for i in known[piece]])
            fields = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "ids", "decoded"])

    return _source(docs).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: what :func:`encode_decode` returns, as digests.

    Digests are of the decimal ids with a blank between and of the decoded text. Arrow splits the texts, numbers their
    pieces and strings together what is written for each; only distinct pieces become Python's. A worker remembers both
    strings of the words it has met, within a bound, so a word is merged once and not once a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for doc_ids, texts in text_chunks(batches):
            split = pieces_of(texts)
            coded = split.values.dictionary_encode()
            pieces = coded.dictionary.cast(pa.large_binary()).to_pylist()
            counts, ids, strings = zip(*map(own.written, pieces), strict=True) if pieces else ((), (), ())
            counts, numbers = np.array(counts, np.int64), coded.indices.to_numpy()
            cuts = split.offsets.to_numpy()
            totals = np.diff(np.concatenate([[0], np.cumsum(counts[numbers])])[cuts])
            fields = [pa.array(doc_ids, pa.int64()), pa.array(totals), _sha256(ids, coded.indices, cuts), _sha256(strings, coded.indices, cuts)]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(run, DIGESTS)


def _sha256(written: Sequence[bytes], numbers: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Digest of each text: the strings of its numbered pieces in a row, but for the blank at the end."""
    row = pa.array(written, pa.large_binary()).take(numbers)
    _, ends, held = row.buffers()
    places = np.frombuffer(ends, np.int64)[cuts].tolist()
    held = memoryview(held or b"")
    return pa.array([hashlib.sha256(held[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(places)], pa.string())
