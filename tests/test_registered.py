"""Registered queries without SQL, against brute force over their whole tables at a small scale."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations, permutations

import pytest

from deckframe.plans.views import view
from deckframe.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def boxes(spark):
    out = {}
    for r in view(spark, SMALL, "elements").select("slide_id", "pos", "x", "y", "w", "h", "r").collect():
        out.setdefault(r.slide_id, []).append((r.pos, (r.x, r.y, r.x + r.w, r.y + r.h), r.r / 256))
    return out


def iou(a, b):
    area = lambda v: max(0, v[2] - v[0]) * max(0, v[3] - v[1])
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = area(a) + area(b) - shared
    return shared / union if union > 0 else 0.0


def test_nms(spark):
    want = set()
    for slide, rows in boxes(spark).items():
        kept = []
        for pos, box, score in sorted(rows, key=lambda r: (-r[2], r[0])):
            if all(iou(k, box) < 0.3 for k in kept):
                kept.append(box)
                want.add((slide, pos, score))
    assert {(r.image, r.ord, r.score) for r in QUERIES["nms"](spark, SMALL).collect()} == want


def test_recovery_fidelity(spark):
    """The matching of the largest total overlap among all matchings, pairs below the least overlap not counted."""
    got = {r.image: r for r in QUERIES["recovery_fidelity"](spark, SMALL).collect()}
    checked = 0
    for slide, rows in boxes(spark).items():
        rows.sort()
        true = [b for _, b, _ in rows]
        found = [(b[0] + 12 * (p % 5), b[1], b[2] + 12 * (p % 5), b[3]) for p, b, _ in rows]
        assert got[slide].n_true == len(true)
        if len(true) > 5:
            continue
        checked += 1
        best = max(sum(iou(f, true[j]) for f, j in zip(found, p, strict=True)) for p in permutations(range(len(true))))
        hits = [[iou(f, true[j]) for f, j in zip(found, p, strict=True)] for p in permutations(range(len(true)))]
        top = [[v for v in h if v >= 0.5] for h in hits if abs(sum(h) - best) < 1e-9]
        assert any(got[slide].matched == len(h) and got[slide].mean_iou == pytest.approx(sum(h) / len(h) if h else 0.0) for h in top)
    assert checked > 500 and len(got) == len(boxes(spark))


def test_term_variants(spark):
    from deckframe.operators import text as wording
    from deckframe.queries import _as_slides

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_deck = {}
    for r in wording.occurrences(_as_slides(docs)).collect():
        by_deck.setdefault(r.deck, []).append((r.term, r.slides))
    stem = lambda t: t.lower().rstrip("".join(chr(c) for c in range(128) if not chr(c).isalpha()))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    want = set()
    for deck, terms in by_deck.items():
        for (a, sa), (b, sb) in combinations(sorted(t for t in terms if len(t[0]) >= 4), 2):
            alike = stem(a) == stem(b) or (edits(a.lower(), b.lower()) <= 2 and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.8)
            if not alike or abs(len(stem(a)) - len(stem(b))) > 2 or sa == sb or max(sa, sb) < 2:
                continue
            want.add((deck, a, b) if sa > sb else (deck, b, a))
    got = {(r.deck, r.canonical, r.variant) for r in QUERIES["term_variants"](spark, SMALL).collect()}
    assert got == want
