"""Token ids of texts by a public tokenizer, with one call of the tokenizer for each distinct piece between blanks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
HELD_PIECES = 600_000  # remembered by a worker; beyond it the half that was not asked for the longest is forgotten
LINE = 256  # pieces that the tokenizer gets at once; longer lines cost it more a piece
CHUNK = 8 << 20  # bytes of text that are split and looked up together


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def may_lower(text: bytes) -> bool:
    """Whether A-Z can be lowered before the tokenizer composes and lowers characters: no mark to compose with (U+0300 to
    U+036F) and no special token."""
    return b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text


def pieces_of(texts: list[bytes]) -> pa.ListArray:
    """Pieces between ASCII blanks of each text, with an empty one where a blank begins or ends it."""
    lowered = pa.array([text.lower() if may_lower(text) else text for text in texts], pa.large_binary())
    return pc.ascii_split_whitespace(lowered.view(pa.large_string()))  # not a cast: texts need not be valid UTF-8


class PieceEncoder:
    """Encodes whole texts. Only for tokenizers that drop white space, as pieces between ASCII blanks then stand alone."""

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._model = self._tokenizer.model if self._keeps_letters() else None
        self._number: dict[bytes, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._starts, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._asked, self._clock = np.zeros(0, np.int64), 0  # the call that last asked for a piece

    def _keeps_letters(self) -> bool:
        """Whether a piece of a-z alone is one word of the model, spelled as it is."""
        normalizer, cutter = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer
        if cutter is None or any(set(t.content) <= set(LETTERS) for t in self._tokenizer.get_added_tokens_decoder().values()):
            return False
        normal = normalizer.normalize_str(LETTERS) if normalizer else LETTERS
        return cutter.pre_tokenize_str(normal) == [(LETTERS, (0, len(LETTERS)))]

    def _forget(self, kept: int) -> None:
        """Keeps the pieces that were asked for last."""
        numbers = np.sort(np.argpartition(self._asked, len(self._asked) - kept)[len(self._asked) - kept :])
        place = np.full(len(self._counts), -1)
        place[numbers] = np.arange(kept)
        self._number = {piece: now for piece, old in self._number.items() if (now := place[old]) >= 0}
        counts, starts = self._counts[numbers], self._starts[numbers]
        ends = np.cumsum(counts)
        self._ids = self._ids[np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if kept else 0)]
        self._counts, self._starts, self._asked = counts, ends - counts, self._asked[numbers]

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces: words of a-z by the tokenizer's model at once, others in lines, which costs less than one call
        each; a token's place tells its piece."""
        words, others = [], []
        for piece in pieces:
            (words if self._model and piece.isalpha() and piece.islower() else others).append(piece)
        pieces = words + others
        of_words = [[token.id for token in self._model.tokenize(word.decode())] for word in words]
        flat = [self._ids, np.fromiter(chain.from_iterable(of_words), np.uint32)]
        counts = [self._counts, np.fromiter(map(len, of_words), np.int64, len(words))]
        for at in range(0, len(others), LINE):
            texts = [p.decode("utf-8", "replace") for p in others[at : at + LINE]]
            line = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
            flat.append(np.array(line.ids, np.uint32))
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            counts.append(np.diff(np.searchsorted(np.array([begin for begin, _ in line.offsets], np.int64), begins)))
        self._number.update(zip(pieces, range(len(self._counts), len(self._counts) + len(pieces)), strict=True))
        self._ids, self._counts = np.concatenate(flat), np.concatenate(counts)
        self._starts = np.cumsum(self._counts) - self._counts
        self._asked = np.concatenate([self._asked, np.zeros(len(pieces), np.int64)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8). Arrow splits the texts and numbers their pieces; only distinct pieces become Python's."""
        if len(self._number) > HELD_PIECES:
            self._forget(HELD_PIECES // 2)
        split = pieces_of(texts)
        coded = split.values.dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if new := [piece for piece in pieces if piece not in self._number]:
            self._learn(new)
        numbers = np.fromiter(map(self._number.__getitem__, pieces), np.int64, len(pieces))
        self._clock += 1
        self._asked[numbers] = self._clock
        numbers = numbers[coded.indices.to_numpy()]
        counts = self._counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(self._starts[numbers] - ends + counts, counts) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of neighbouring rows of ``doc_id, text``, no more than ``CHUNK`` and one text at a time; null texts are empty."""
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        doc_ids = batch.column("doc_id").to_pylist()
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(ends)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield doc_ids[a:b], column[a:b].fill_null(b"").to_pylist()


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """``doc_id`` and ids of every row of ``doc_id, text``; null texts have none."""
    encoder = piece_encoder(path)
    for doc_ids, texts in text_chunks(batches):
        yield from zip(doc_ids, encoder.encode(texts), strict=True)
