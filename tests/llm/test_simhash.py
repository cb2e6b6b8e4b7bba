import random
import re

import numpy as np
import xxhash

from hushlake.llm.components import cell_links, components, roots
from hushlake.llm.simhash import drop_near_duplicates, fingerprint, near, simhash_components
from tests.llm.conftest import documents


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def slow_components(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_fingerprints_and_components_equal_brute_force(odd_documents, odd_rows):
    got = simhash_components(odd_documents).collect()
    assert len(got) == len(odd_rows)
    prints = {(i, t): slow_print(t) for i, t, *_ in odd_rows}
    ids = [(i, p) for (i, _), p in prints.items()]
    distinct = sorted(set(prints.values()))
    edges = [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 3]
    label = slow_components(distinct, edges)
    smallest = {}
    for i, p in ids:
        if i is not None:
            smallest[label[p]] = min(i, smallest.get(label[p], i))
    want = sorted(((i, prints[i, t], smallest.get(label[prints[i, t]])) for i, t, *_ in odd_rows), key=str)
    assert sorted(((r.doc_id, r.bits % 2**64, r.component_id) for r in got), key=str) == want


def test_one_row_of_a_component_stays(odd_documents, no_documents):
    kept = [r.doc_id for r in drop_near_duplicates(odd_documents).collect()]
    assert {1, 4, 8, 9, 11, 12, 13}.issubset(kept) and 2 not in kept and kept.count(8) == 1
    assert drop_near_duplicates(odd_documents).columns == odd_documents.columns
    assert simhash_components(no_documents).count() == drop_near_duplicates(no_documents).count() == 0


def test_pivot_table_finds_all_near_pairs():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = [prints[i % 300] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 6, replace=False))) for i in range(600)]
    prints = np.unique(np.concatenate([prints, np.array(flips, np.uint64)]))
    left, right = near(prints)
    got = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if int(prints[a] ^ prints[b]).bit_count() <= 3}
    assert got == want


def test_a_crowded_cell_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("hushlake.llm.components.BLOCK", 16)
    rows = spark.createDataFrame([(7, i) for i in range(0, 400, 2)] + [(8, 1), (9, 401)], "cell long, id long")

    def neighbours(table):
        ids = table.column("id").to_numpy()
        return np.nonzero((ids[:, None] - ids[None, :]) == 2)

    found = {(r.node, r.component) for r in components(cell_links(rows, neighbours)).collect()}
    assert found == {(i, 0) for i in range(0, 400, 2)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(9, 9)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    nodes = {n for e in edges for n in e}
    want = {(n, c) for n, c in slow_components(nodes, edges).items() if any(n in e and e[0] != e[1] for e in edges)}
    assert {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert roots(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_short_texts():
    assert fingerprint(b"") == fingerprint(b" \n") == 0
    assert fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_many_copies_are_one_row(spark):
    docs = documents(spark, [(n, "the same text of five words and more") for n in range(300)])
    assert {r.component_id for r in simhash_components(docs).collect()} == {0}


def test_texts_of_near_fingerprints_go_whatever_their_jaccard_similarity(spark):
    often = "one two three " * 200
    rows = [(1, often + "four five six seven eight"), (2, often + "nine ten eleven twelve"), (3, "some other text of seven plain words"), (4, None), (5, ""), (6, "the last text")]
    rows += [(None, often + "nine ten eleven twelve")] * 2
    docs = documents(spark, rows)
    ids = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    assert ids[1] == ids[2] == 1 and ids[3] == 3
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [1, 3, 4, 6]
