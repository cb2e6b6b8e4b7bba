import random
import re
from collections import defaultdict

import pytest

from hushlake.llm.paragraphs import brief_paragraphs, drop_repeated_paragraphs, repeated_paragraphs
from hushlake.llm.queries import QUERIES
from tests.llm.conftest import documents, words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def order(place):
    return (place[0] is not None, *place)


def slow_lines(rows):
    """``{(doc_id, line): (n_words, doc_id and line of the cluster's first place)}`` of every repeated line but the first."""
    places, sets = defaultdict(list), {}
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if parts := tuple(words_of(line)):
                places[parts].append((i, n))
                sets[parts] = {parts[k : k + 5] for k in range(len(parts) - 4)}
    label = {t: n for n, t in enumerate(places)}
    for a in places:
        for b in places:
            both = len(sets[a] & sets[b])
            if label[a] != label[b] and both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                label = {t: label[a] if n == label[b] else n for t, n in label.items()}
    clusters = defaultdict(list)
    for t, found in places.items():
        clusters[label[t]] += [(*p, len(t)) for p in found]
    out = {}
    for found in clusters.values():
        first = min(found, key=order)[:2]
        out |= {p[:2]: (p[2], first) for p in found if p[:2] != first}
    return out


def check(spark, rows):
    docs = documents(spark, rows)
    found, brief = repeated_paragraphs(docs).collect(), brief_paragraphs(docs).collect()
    units = [r for r in found if r.paragraph is None]
    slow = slow_lines(rows)
    company = {r.doc_id for r in units} | {i for (i, _), (n, _) in slow.items() if n >= 16}
    lines = lambda rs: {(r.doc_id, r.paragraph): (r.n_words, (r.cluster_doc_id, r.cluster_paragraph)) for r in rs if r.paragraph is not None}
    assert lines(found) == {p: v for p, v in slow.items() if p[0] in company}
    assert lines(brief) == {p: v for p, v in slow.items() if p[0] not in company}
    # a unit stands word for word at an earlier place
    texts = defaultdict(list)
    for i, text, *_ in rows:
        texts[i].append(words_of(text or ""))
    for r in units:
        here = {tuple(t[r.start : r.start + 16]) for t in texts[r.doc_id]}
        there = {tuple(t[r.cluster_start : r.cluster_start + 16]) for t in texts[r.cluster_doc_id]}
        assert r.n_words == 16 and here & there and order((r.cluster_doc_id, r.cluster_start)) < order((r.doc_id, r.start))
    # 51 words in a row that stand at an earlier place hold one
    starts, first = {(r.doc_id, r.start) for r in units}, {}
    for i, k, run in sorted(((i, k, tuple(t[k : k + 51])) for i, ts in texts.items() for t in ts for k in range(len(t) - 50)), key=order):
        if first.setdefault(run, (i, k)) != (i, k):
            assert any((i, k + s) in starts for s in range(51 - 16 + 1)), (i, k)
    return units


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, odd_rows, block):
    monkeypatch.setattr("hushlake.llm.components.BLOCK", block)
    base = words(20, 60)
    rows = [r for r in odd_rows if r[0] not in (11, 12)]
    for n in range(40):  # a chain of edits, one more word each
        edited = [*words(30, n // 2), *base[n // 2 :]]
        rows.append((100 + n, "\n".join([" ".join(words(200 + n, 12)), " ".join(edited), "short line"])))
    rows += [(300, "a a a a a a a a"), (301, "a a a a a a a a a"), (302, "B a a a a a a a a")]
    rows += [(400 + n, "\n".join([" ".join(words(50, k)) for k in range(1, 12)])) for n in range(3)]
    rows += [(500 + n, "a " * n + "\nshort line\n" + f"own {n}") for n in range(4, 11)] + [(600, "Menu\nmenu\nx y z u v w"), (601, "x y z u v")]
    check(spark, rows)


def test_passages_within_lines_are_met(spark):
    rng, rows = random.Random(3), []
    for n in range(40):
        passage = words(1000 + n, 51)
        if n % 4 == 0:  # over line ends
            passage = [w + "\n" if k in (9, 30) else w for k, w in enumerate(passage)]
        for side in range(2):
            around = [words(2000 + 4 * n + 2 * side + part, rng.randint(0, 80)) for part in range(2)]
            rows.append((2 * n + side, " ".join([*around[0], *passage, *around[1]])))
    rows += [(900 + n, " ".join(words(9000 + n, 300))) for n in range(10)]  # clean
    units = check(spark, rows)
    assert {r.doc_id for r in units} == {2 * n + 1 for n in range(40)}
    assert {(r.doc_id, r.cluster_doc_id) for r in units} == {(2 * n + 1, 2 * n) for n in range(40)}


def test_removal_and_empty_tables(spark, odd_documents, no_documents):
    docs = documents(spark, [(1, "keep\n" + " ".join(words(1, 60))), (2, " ".join(words(1, 60)) + "\nown line\n\nend"), (3, None), (4, "")])
    cut = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs).collect()}
    assert cut == {1: "keep\n" + " ".join(words(1, 60)), 2: "own line\n\nend", 3: None, 4: ""}
    assert drop_repeated_paragraphs(odd_documents).columns == odd_documents.columns
    assert repeated_paragraphs(no_documents).count() == drop_repeated_paragraphs(no_documents).count() == 0


def test_removal_cuts_units_out_of_lines(spark):
    passage, own = words(5, 120), words(6, 30)
    docs = documents(spark, [(1, " ".join(passage)), (2, "  " + " ".join([*own[:10], *passage, *own[10:]]) + "\n\tend  of it")])
    cut = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs).collect()}
    gone = {k for r in repeated_paragraphs(docs).collect() for k in range(r.start, r.start + r.n_words)}
    left = [w for k, w in enumerate([*own[:10], *passage, *own[10:]]) if k not in gone]
    assert cut == {1: " ".join(passage), 2: "  " + " ".join(left) + "\n\tend  of it"} and 16 <= len(gone) <= 120


def test_brief_lines_need_company(spark, tmp_path):
    menu, passage = "home | about\none two three four five six", " ".join(words(1, 60))
    docs = documents(spark, [(1, f"{menu}\n{passage}"), (2, f"Home | About\nown\n{menu[13:]}"), (3, f"{menu}\n{passage}\nend")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op1_repeated_paragraphs"](spark, str(tmp_path)).filter("paragraph is not null").collect()
    assert sorted((r.doc_id, r.paragraph) for r in found) == [(3, 0), (3, 1), (3, 2)]
    assert sorted((r.doc_id, r.paragraph) for r in brief_paragraphs(docs).collect()) == [(2, 0), (2, 2)]
    cut = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs).collect()}
    assert cut == {1: f"{menu}\n{passage}", 2: f"Home | About\nown\n{menu[13:]}", 3: "end"}
