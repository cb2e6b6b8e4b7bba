import hashlib
import math
import random
from zlib import crc32

import pytest

from hushlake.llm.prefix_trie import _medians, conversation_trie, prefix_trie

ROWS = "conv_id long, turn long, role string, text string, code string, shard string, key string"


def slow(paths):
    """Nodes by the rule, from ``conv_id -> [(turn, bytes)]``."""
    members, kids = {}, {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        return [node, *(n for kid in kids.get(node, []) for n in below(kid))]

    rows = []
    for node, convs in members.items():
        tree = below(node)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        saved = sum((len(members[n]) - 1) * (n[-1][1] if n else 0) for n in tree)
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(n not in kids for n in tree)
        rows.append((min(convs), len(node), parent, len(convs), len(kids.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, len(text.encode())))
    own = {c: [(t[2], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    h = {c: crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(math.fmod(c, 5)), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def nodes(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[1], r[0]))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS).repartition(3)


@pytest.mark.parametrize(("most", "turns", "fan"), [(1, 10**9, 2), (3, 10**9, 2), (10**9, 8, 3), (10**6, 10**6, 64)])
def test_equals_brute_force_for_any_shards(spark, most, turns, fan):
    rng = random.Random(most + fan)
    paths = {i: [(rng.randrange(3), 5) for _ in range(rng.randrange(6))] for i in rng.sample(range(-100, 1000), 120)}
    paths |= {i: [(1, 5), (2, 5)] for i in range(2000, 2060)}  # a hot conversation
    paths[-7] = [(k % 2, 5) for k in range(80)]  # a long one
    frame = spark.createDataFrame([(c, [a for a, _ in p], [b for _, b in p]) for c, p in paths.items()], "conv_id long, codes array<long>, sizes array<long>")
    assert nodes(prefix_trie(frame, most, turns, fan)) == slow(paths)


def test_rebuilt_conversations_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "", "long " * 40])) for c in range(-12, 40) for t in range(rng.randrange(1, 12)) if rng.random() < 0.9]
    rows += [(3, None, None, None), (3, None, "user", None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(7, 5, "us", "era"), (7, 5, "user", "a"), (100, 0, "user", "y" * 50_000), (2**62, 0, "user", "far")]
    assert nodes(conversation_trie(table(spark, rows))) == slow(rebuilt(rows))


def test_turnless_and_empty(spark):
    h = {c: crc32(str(c).encode()) % 9 for c in range(1, 500)}
    alone = next(c for c in h if c % 5 and h[c] >= 2)  # its family's first conversation is absent, and its turns are all cut
    found = nodes(conversation_trie(table(spark, [(alone, 0, "user", "x")])))
    assert found == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert nodes(conversation_trie(table(spark, []))) == []


def test_medians_come_first():
    for n in (0, 1, 2, 7, 100):
        assert sorted(_medians(n)) == list(range(n))
    assert next(_medians(7)) == 3
