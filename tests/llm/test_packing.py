from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushlake.llm import token_ids
from hushlake.llm.best_fit import Capacities, best_fit, matrices
from hushlake.llm.cost_packing import CAPACITY, cost, pack, packed
from hushlake.llm.token_ids import TOKENIZER, piece_encoder
from tests.llm.conftest import words

LENGTHS = st.lists(st.integers(1, 70), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def whole(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end])


@settings(deadline=None)
@given(LENGTHS)
def test_cost_packing_places_every_token_once(lengths):
    placed = pack(np.array(lengths, int), 16)
    used, parts = defaultdict(int), defaultdict(list)
    for doc, start, length, sequence, offset in placed:
        assert used[sequence] == offset and 0 < length <= 16
        used[sequence] += length
        parts[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(parts[doc]):
            assert start == at
            at += n
        assert at == length
    assert len(used) == -(-sum(lengths) // 16) and all(n <= 16 for n in used.values())


def test_costs_are_balanced():
    lengths = np.random.default_rng(2).integers(1, 300, 2000)
    costs = defaultdict(float)
    for _, _, length, sequence, _ in pack(lengths):
        costs[sequence] += cost(length)
    values = np.array(list(costs.values()))
    assert values.std() < 0.05 * values.mean()


@settings(deadline=None)
@given(LENGTHS)
def test_best_fit_equals_a_plain_search(lengths):
    pieces = sorted(((d, s, min(16, n - s)) for d, n in enumerate(lengths) for s in range(0, n, 16)), key=lambda p: (-p[2], p[0], p[1]))
    rooms = []
    for _, _, n in pieces:
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(16 - n)
    got = best_fit(np.array(lengths, int), 16)
    assert sorted(16 - sum(n for *_, n in row) for row in got) == sorted(rooms)
    assert sorted(p for row in got for p in row) == sorted(pieces)


def test_capacities_find_the_least_room():
    rooms = Capacities(10)
    for row, room in enumerate([3, 7, 7, 10, 0]):
        rooms.add(room, row)
    assert [rooms.take(n) for n in (4, 4, 4, 4, 1, 1)] == [(7, 2), (7, 1), (10, 3), None, (3, 0), None]


def test_pieces_of_odd_documents(tokenizer, odd_documents, odd_rows, no_documents):
    rows = packed(odd_documents).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        of_doc[r.doc_id, r.doc_tokens].append((r.start, ids.tolist()))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    want = defaultdict(list)
    for i, t, *_ in odd_rows:
        ids = whole(tokenizer, t, 1).tolist()
        want[i, len(ids)] += ids
    for key, ids in want.items():
        assert sorted(x for _, part in of_doc[key] for x in part) == sorted(ids)
    twelve = [ids for _, ids in sorted(of_doc[next(k for k in of_doc if k[0] == 12)])]
    assert [x for part in twelve for x in part] == next(v for k, v in want.items() if k[0] == 12)
    assert packed(no_documents).count() == matrices(no_documents).count() == 0


def test_matrices_give_documents_back(tokenizer, odd_documents, odd_rows):
    parts = defaultdict(list)
    for row in matrices(odd_documents).collect():
        ids, positions = np.frombuffer(row.ids, "<u2"), np.frombuffer(row.position_ids, "<u2")
        assert len(ids) == len(positions) == CAPACITY and row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens
        for n, (doc_id, start) in enumerate(zip(row.doc_ids, row.starts, strict=True)):
            span = slice(row.cu_seqlens[n], row.cu_seqlens[n + 1])
            assert positions[span].tolist() == list(range(span.stop - span.start))
            parts[doc_id].append((start, ids[span].tolist()))
        assert positions[row.n_tokens :].tolist() == list(range(CAPACITY - row.n_tokens))
    for i, t, *_ in odd_rows:
        if i not in (8, 9, None):
            assert [x for _, part in sorted(parts[i]) for x in part] == whole(tokenizer, t, 49407).tolist()
    repeated = whole(tokenizer, next(t for i, t, *_ in odd_rows if i == 8), 49407).tolist()
    assert sorted(x for _, part in parts[8] for x in part) == sorted(2 * repeated)


TEXTS = st.lists(
    st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "'ll", "ΑΣ", " \t", "　", "é", "I'M", "\x1c", "\x85"])), max_size=12
).map("".join)


@settings(deadline=None, max_examples=300)
@given(TEXTS)
def test_pieces_encode_as_whole_texts(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert piece_encoder(TOKENIZER).encode([text.encode(), b""])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 70), max_size=25))
def test_cost_packing_equals_a_plain_search(lengths):
    """Longest piece first, each into the cheapest sequence with room; where none has room, the roomiest is filled."""
    n, capacity = -(-sum(lengths) // 20), 20
    held = [[0.0, 0] for _ in range(n)]  # cost and tokens
    pieces = sorted((-min(capacity, size - at), doc, at) for doc, size in enumerate(lengths) for at in range(0, size, capacity))
    want = []
    for less, doc, at in pieces:
        left = -less
        while left:
            open_ = [s for s in range(n) if capacity - held[s][1] >= left]
            to = min(open_, key=lambda s: (held[s][0], s)) if open_ else max(range(n), key=lambda s: (capacity - held[s][1], -s))
            part = min(left, capacity - held[to][1])
            want.append((doc, at, part, to, held[to][1]))
            held[to][0] += float(cost(part))
            held[to][1] += part
            at, left = at + part, left - part
    assert pack(np.array(lengths, np.int64), capacity) == want


def test_a_worker_that_forgets_encodes_alike(tokenizer, monkeypatch):
    monkeypatch.setattr(token_ids, "HELD_PIECES", 10)
    encoder = token_ids.PieceEncoder(TOKENIZER)
    for n in range(30):
        texts = [" ".join(words(n + k, 9)) + " the and" for k in (0, 1)]
        for ids, text in zip(encoder.encode([t.encode() for t in texts]), texts, strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder._number) == len(encoder._counts) <= 10 + 2 * 10


def test_a_piece_is_looked_up_once_a_call(tokenizer):
    """However often it stands in the texts."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encoder, text = token_ids.PieceEncoder(TOKENIZER), "The cat, the cât\tand THE cat. " * 500
    encoder._number = Counted()
    got = encoder.encode([text.encode(), b"", b" and\n"])
    assert encoder._number.asked <= 7  # the cat, cât and cat. and what stands before or after a blank at an end
    assert [ids.tolist() for ids in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", " and\n")]


def test_words_of_letters_do_not_go_through_lines(tokenizer, monkeypatch):
    encoder, lines = token_ids.PieceEncoder(TOKENIZER), []
    library = encoder._tokenizer

    class Spy:
        def encode(self, line, **options):
            lines.append(line)
            return library.encode(line, **options)

    monkeypatch.setattr(encoder, "_tokenizer", Spy())
    text = " ".join([*words(5, 300), "x" * 3000, "don't", "42nd", "é", "<|endoftext|>", "A<|startoftext|>b"])
    assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(" ".join(lines).split()) == sorted(["don't", "42nd", "é", "<|endoftext|>", "A<|startoftext|>b"])


def test_texts_are_encoded_a_chunk_of_bytes_at_a_time(tokenizer, monkeypatch):
    """Nulls, texts longer than a chunk, and a batch that is cut out of a longer one."""
    monkeypatch.setattr(token_ids, "CHUNK", 100)
    encoder, sizes = token_ids.piece_encoder(TOKENIZER), []
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda texts: sizes.append([len(t) for t in texts]) or encode(texts))
    texts = [None, "", *(" ".join(words(k, k)) for k in range(60)), None, "ÀB " * 400, "Ab cd\x00", b"\xff\xfe Ab".decode("utf-8", "replace"), None]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(len(texts) - 1), None]), "text": pa.array(texts, pa.string())})
    for batch in (rows, rows.slice(20), rows.slice(0, 0)):
        got = [(i, ids.tolist()) for i, ids in token_ids.encoded(iter([batch]), TOKENIZER)]
        assert got == [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in batch.to_pylist()]
    assert max(sum(s) - max(s, default=0) for s in sizes) <= 100 < max(map(sum, sizes))
