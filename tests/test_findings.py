"""Label pairing and the classifier: known layouts, and random ones against brute force."""

import random
import re

import pytest

from hushlake.operators import findings as D
from hushlake.operators import pairing as G

SCHEMA = "session_id long, frame_id long, region_id long, text string, x int, y int, width int, height int, confidence double"


def column(*texts):
    return [(t, 17, 10 + 25 * i, 170, 18) for i, t in enumerate(texts)]


def frame(spark, *frames):
    rows = [(1, f, n, *r, 0.91) for f, regions in enumerate(frames) for n, r in enumerate(regions)]
    return spark.createDataFrame(rows, SCHEMA)


def values(found):
    return {(r.kind, r.value) for r in found.collect()}


def test_contact_and_credentials(spark):
    got = values(D.classify_frames(frame(spark, column("Full name: Mira Talbot", "mt.5@mail.example", "+1 (402) 555-0163", "Password: quiet-lantern-88"))))
    assert {("NAME", "Mira Talbot"), ("EMAIL", "mt.5@mail.example"), ("PHONE", "+1 (402) 555-0163"), ("SECRET", "quiet-lantern-88")} <= got


def test_multiline_address(spark):
    found = D.classify_frames(frame(spark, column("Shipping address", "Mira Talbot", "47 Harbor Lane", "Dover, DE 19901", "Continue")))
    address = [r for r in found.collect() if r.source == "visible-label"]
    assert [(r.kind, r.value, r.y, r.height) for r in address] == [("ADDRESS", "Mira Talbot\n47 Harbor Lane\nDover, DE 19901", 35, 68)]


def test_side_by_side(spark):
    found = D.classify_frames(frame(spark, [("Name", 10, 10, 60, 20), ("Ines Okafor", 130, 10, 130, 20)])).collect()
    assert [(r.value, r.x) for r in found] == [("Ines Okafor", 130)]


def test_plain_name_needs_context_or_the_vault(spark):
    rows = frame(spark, column("Ines Okafor", "Namesake", "Addressed parcels"))
    assert D.classify_frames(rows).count() == 0
    known = spark.createDataFrame([(1, "NAME", "Ines  Okafor", False)], "session_id long, kind string, value string, explicit_secret boolean")
    found = D.classify_frames(rows, known).collect()
    assert [(r.kind, r.value, r.source) for r in found] == [("NAME", "Ines  Okafor", "local-vault")]


def test_values_are_found_again_in_later_frames(spark):
    rows = frame(spark, column("Deliver to: 12 Cedar Lane", "Boise, ID 83702"), column("Boise, ID 83702", "Continue"))
    later = [r for r in D.detect_sessions(rows).collect() if r.frame_id == 1]
    # The label's block and the street line's block are two known values that share the city line.
    assert {(r.kind, r.source, r.y, r.value) for r in later} == {
        ("ADDRESS", "local-vault", 10, "12 Cedar Lane\nBoise, ID 83702"),
        ("ADDRESS", "local-vault", 10, "Deliver to: 12 Cedar Lane\nBoise, ID 83702"),
    }


def test_helper_text_is_no_secret(spark):
    helper = D.classify_frames(frame(spark, column("Forgot password?", "Password requirements")))
    assert helper.count() == 0
    masked = D.classify_frames(frame(spark, [("Password", 17, 10, 90, 18), ("Show password", 200, 10, 90, 18), ("••••", 17, 40, 90, 18)])).collect()
    assert [(r.kind, r.value) for r in masked] == [("SECRET", "••••")]


def test_explicit_label_marks_equal_secrets(spark):
    found = D.classify_frames(frame(spark, column("Secret: sk-demo12345678"))).collect()
    assert {(r.kind, r.value, r.explicit_secret) for r in found} == {("SECRET", "sk-demo12345678", True)}
    assert len(found) == 1


def test_bad_region_withholds_its_frame(spark):
    rows = frame(spark, column("Email: a@b.example"), [("Email: c@d.example", 5, 5, 0, 9)])
    scanned = D.region_scan(rows)
    assert {r.status for r in scanned.filter("frame_id = 1").collect()} == {"empty_region"}
    assert {r.frame_id for r in D.fail_closed(scanned).collect()} == {0}


LABELS = ("name", "password", "ship to", "email")
LABEL = re.compile(r"^(name|password|ship to|email)(?=[:\s]|$)\s*:?\s*(.*)$", re.I)


def regions_of(frames):
    """Per frame, the regions by id as dicts."""
    names = ("text", "x", "y", "width", "height")
    return [{n: dict(zip(names, r, strict=True)) | {"id": n} for n, r in enumerate(regions)} for regions in frames]


def reading(region):
    return region["y"], region["x"], region["id"]


def in_column(top, other):
    """Far enough down and close enough sideways to belong to what starts at ``top``."""
    sideways = abs(other["x"] - top["x"])
    return other["id"] != top["id"] and 2 * (other["y"] - top["y"]) >= top["height"] and sideways <= max(32, 2 * top["height"])


def check_chain(frame, top, members, limit):
    """A chain holds just the regions of the column up to the first that must end it."""
    column_ = sorted((r for r in frame.values() if in_column(top, r)), key=reading)
    chain = [frame[m] for m in members]
    assert chain == column_[: len(chain)] and len(chain) <= limit  # none is skipped, none is added
    assert not any(LABEL.match(r["text"]) for r in chain)
    reach = max(36, 2.8 * top["height"])
    for above, below in zip([top, *chain], chain, strict=False):
        assert below["y"] - above["y"] - above["height"] <= reach
    if len(chain) < min(limit, len(column_)):  # it ended early: the next one is a label or too far down
        last, following = ([top, *chain])[-1], column_[len(chain)]
        assert LABEL.match(following["text"]) or following["y"] - last["y"] - last["height"] > reach


def on_the_right(label, other):
    gap = other["x"] - label["x"] - label["width"]
    level = 2 * abs(other["y"] - label["y"]) <= max(label["height"], other["height"])
    return other["id"] != label["id"] and level and 0 <= gap <= 240 and not LABEL.match(other["text"])


@pytest.mark.parametrize("seed", range(3))
def test_pairs_keep_the_rules_of_pairing(spark, seed):
    rng = random.Random(seed)
    frames = []
    for _ in range(25):
        n = rng.randrange(2, 40)
        texts = [rng.choice(LABELS) if rng.random() < 0.3 else f"value{rng.randrange(99)}" for _ in range(n)]
        frames.append([(t, rng.randrange(0, 400), rng.randrange(0, 700), rng.randrange(10, 120), rng.choice([8, 12, 18, 30, 90])) for t in texts])
    pairs = G.pair_labels(G.clean(frame(spark, *frames))).collect()
    known = regions_of(frames)
    assert {(p.frame_id, p.region_id) for p in pairs} == {(f, n) for f, r in enumerate(known) for n in r if LABEL.match(r[n]["text"])}
    for pair in pairs:
        own = known[pair.frame_id]
        label = own[pair.region_id]
        check_chain(own, label, [b.region_id for b in pair.below], 5)
        beside = [r for r in own.values() if on_the_right(label, r)]
        assert bool(pair.right) == bool(beside)
        if beside:  # the nearest, of equally near ones the first in reading order
            assert own[pair.right.region_id] == min(beside, key=lambda r: (r["x"], reading(r)))
        selected = pair.right or (pair.below[0] if pair.below else None)
        assert (pair.selected and pair.selected.region_id) == (selected and selected.region_id)


@pytest.mark.parametrize("seed", range(2))
def test_address_blocks_keep_the_rules_of_addresses(spark, seed):
    rng = random.Random(100 + seed)
    frames = []
    for _ in range(40):
        n = rng.randrange(2, 25)
        texts = [rng.choice(("ship to", "ship to 5", "Dover, DE 19901", "name", f"line {i}")) for i in range(n)]
        frames.append([(t, rng.randrange(0, 60), rng.randrange(0, 400), 40, rng.choice([8, 18])) for t in texts])
    blocks = {(r.frame_id, r.region_id): r.address_block for r in G.label_blocks(G.clean(frame(spark, *frames))).collect()}
    pairs = {(p.frame_id, p.region_id): p for p in G.pair_labels(G.clean(frame(spark, *frames))).collect()}
    checked = 0
    for f, own in enumerate(regions_of(frames)):
        for n, label in own.items():
            match = LABEL.match(label["text"])
            if not match or match[1] != "ship to":
                continue
            block, chosen = blocks.get((f, n)), pairs[f, n].selected
            if not match[2] and chosen is None:
                assert block is None
                continue
            lines = block.value.split("\n")
            top = label if match[2] else own[chosen.region_id]
            assert lines[0] == (match[2] or top["text"])
            postal = [i for i, line in enumerate(lines) if "DE 19901" in line]
            assert postal in ([], [len(lines) - 1]) and len(lines) <= 4  # nothing follows the city line or a fourth line
            column_ = sorted((r for r in own.values() if in_column(top, r)), key=reading)
            below = column_[: len(lines) - 1]
            assert [r["text"] for r in below] == lines[1:]
            ends_early = not postal and len(lines) < 4
            check_chain(own, top, [r["id"] for r in below], 4 if ends_early else len(below))
            checked += 1
    assert checked > 50


def test_a_huge_region_stays_within_its_frame(spark):
    plain = [("Name", 10, 10, 60, 20), ("Ines Okafor", 130, 10, 130, 20)]
    huge = [*plain, ("far", 10, 900, 10, 10_000_000), ("Email", 10, 9_000_000, 50, 20)]
    found = D.classify_frames(frame(spark, huge, *[plain] * 3)).collect()
    assert sorted((r.frame_id, r.value) for r in found) == [(n, "Ines Okafor") for n in range(4)]


def test_labels_without_a_session_or_a_frame_keep_their_own_value(spark):
    rows = [(s, f, 0, "Password: quiet-lantern-88", 17, 10, 170, 18, 0.91) for s, f in ((None, 1), (1, None), (None, None), (1, 1))]
    found = G.pair_labels(G.clean(spark.createDataFrame(rows, SCHEMA))).collect()
    got = sorted(((r.session_id, r.frame_id, r.label_value, r.selected.region_id) for r in found), key=str)
    assert got == sorted(((s, f, "quiet-lantern-88", 0) for s, f, *_ in rows), key=str)
    kinds = [(r.session_id, r.frame_id, r.kind) for r in D.classify_frames(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kinds, key=str) == sorted(((s, f, "SECRET") for s, f, *_ in rows), key=str)


@pytest.mark.parametrize("keys", [(None, 1), (1, None), (None, None), (1, 1)])
def test_values_on_the_next_line_of_frames_with_null_keys(spark, keys):
    rows = [(*keys, 0, "Password:", 17, 10, 170, 18, 0.9), (*keys, 1, "hunter22x", 17, 35, 170, 18, 0.9)]
    rows += [(*keys, 2, "Shipping address", 17, 200, 170, 18, 0.9), (*keys, 3, "47 Harbor Lane", 17, 225, 170, 18, 0.9), (*keys, 4, "Dover, DE 19901", 17, 250, 170, 18, 0.9)]
    rows += [(*keys, 5, "Name", 400, 10, 60, 20, 0.9), (*keys, 6, "Ines Okafor", 520, 10, 130, 20, 0.9)]
    got = values(D.classify_frames(spark.createDataFrame(rows, SCHEMA)))
    assert {("SECRET", "hunter22x"), ("ADDRESS", "47 Harbor Lane\nDover, DE 19901"), ("NAME", "Ines Okafor")} <= got


def test_one_bad_region_withholds_a_frame_with_null_keys(spark):
    rows = [(None, 1, 0, "a", 1, 1, 5, 5, 0.9), (None, 1, 1, "b", 1, 1, 0, 5, 0.9), (None, 2, 0, "c", 1, 1, 5, 5, 0.9), (1, None, 0, "d", 1, 1, 5, 5, 0.9)]
    kept = D.fail_closed(D.region_scan(spark.createDataFrame(rows, SCHEMA)))
    assert {r.text for r in kept.collect()} == {"c", "d"}


def plain_neighbours(start, frame):
    """What ``neighbours`` finds for a region that is no secret, by looking at every other region of its frame."""
    n, _, x, y, w, h = start
    others = [r for r in frame if r[0] != n]
    gap, edge, chain = max(36, h * 2.8), y + h, []
    for r in sorted((r for r in others if r[3] >= y + h * 0.5 and abs(r[2] - x) <= max(32, 2 * h)), key=lambda r: (r[3], r[2], r[0]))[:5]:
        if r[3] - edge > gap or r[1].endswith(":"):
            break
        chain.append(r[0])
        edge = r[3] + r[5]
    beside = [r for r in others if r[2] >= x + w and abs(r[3] - y) <= max(h, r[5]) * 0.5 and r[2] - x - w <= 240 and not r[1].endswith(":")]
    return chain, min(((r[2], r[3], r[0]) for r in beside), default=(None,))[-1]


@pytest.mark.parametrize("height", [2000, 60_000, 1_000_000])
def test_neighbours_of_low_and_tall_regions(spark, height):
    draw = random.Random(height)
    tall = [18, 40, 256, 257, 300, 512, 513, 1024, 5000, height // 2, height]
    rows = []
    for f in range(6):
        for n in range(150):
            h = draw.choice(tall) if n % 25 == 0 else draw.choice((18, 18, 40, 256)) if n % 5 == 0 else 18
            text = "Name:" if draw.random() < 0.2 else f"w{n}"
            rows.append((None if f == 5 else 1, f, n, text, draw.randrange(0, 900, 30), draw.randrange(-300, height // (1 if f % 2 else 20)), 60, h, 0.9))
    frames = spark.createDataFrame(rows, SCHEMA)
    near = G.neighbours(G.anchors_of(G.clean(frames)), G.clean(frames)).select("frame_id", "region_id", "below.region_id", "right.region_id")
    got = {(f, n): (below, right) for f, n, below, right in near.collect()}
    of = lambda f: [(r[2], r[3], *r[4:8]) for r in rows if r[1] == f]
    assert got == {(r[1], r[2]): plain_neighbours((r[2], r[3], *r[4:8]), of(r[1])) for r in rows if r[3] == "Name:"}
    assert any(right is not None for _, right in got.values()) and any(len(below) > 2 for below, _ in got.values())


def test_a_huge_region_costs_its_frame_little(spark):
    def probes(*more):
        low = [(1, 1, n, "Name:" if n % 2 else "x", 40 * (n % 25), 1000 + n * 20, 30, 18, 0.9) for n in range(4000)]
        cleaned = G.clean(spark.createDataFrame([*low, *more], SCHEMA))
        return G.probes_of(G.anchors_of(cleaned), cleaned).count()

    plain = probes()
    assert probes((1, 1, 9999, "page", 0, 0, 900, 1_000_000, 0.9)) < 2 * plain
    assert probes((1, 1, 9999, "page", 0, 40_000, 900, 1_000_000, 0.9)) < 4 * plain


def test_only_frames_after_the_first_sighting_count(spark):
    rows = frame(spark, column("Ines Okafor", "Continue"), column("Name", "Ines Okafor"), column("Ines Okafor", "Continue"))
    found = {(r.frame_id, r.source, r.y) for r in D.detect_sessions(rows).collect()}
    assert found == {(1, "visible-label", 35), (2, "local-vault", 10)}
    known = spark.createDataFrame([(1, "NAME", "Ines Okafor", False, 1)], "session_id long, kind string, value string, explicit_secret boolean, since long")
    again = lambda known: {r.frame_id for r in D.vault_findings(D.G.clean(rows), known).collect()}
    assert again(known) == {2} and again(known.drop("since")) == {0, 1, 2}
