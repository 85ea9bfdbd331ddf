"""The search for near-duplicate images against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from verdict_lake.operators import duplicates as D

PRINT = "post_id string, exact_hash string, dhash string, ahash string, width int, height int"
RASTER = "post_id string, raster binary"


def images(seed=3):
    """Prints and rasters: a template with many near images, shapes around the tolerance, and images alone."""
    draw = random.Random(seed)
    hexa = lambda x: f"{x & (2**64 - 1):016x}"
    base = [(draw.getrandbits(64), draw.getrandbits(64), bytes(draw.randrange(256) for _ in range(3 * 40))) for _ in range(6)]
    prints, rasters = {"q": [], "r": []}, []
    for side, count in (("q", 120), ("r", 60)):
        for k in range(count):
            d, a, pixels = base[0] if k % 2 else base[draw.randrange(6)]
            for _ in range(draw.choice((0, 0, 1, 3, 6, 9))):
                d ^= 1 << draw.randrange(64)
            for _ in range(draw.choice((0, 0, 1, 2, 3))):
                a ^= 1 << draw.randrange(64)
            w, h = draw.choice(((100, 100), (100, 100), (102, 100), (103, 100), (204, 200), (0, 5), (100, 0)))
            prints[side].append((f"{side}{k}", f"f{draw.randrange(400)}", hexa(d), hexa(a), w, h))
            if draw.random() < 0.95:
                step = draw.choice((0, 0, 2, 4, 5, 9))
                shown = bytes(min(255, x + draw.randrange(step + 1)) for x in pixels) if draw.random() < 0.9 else pixels[:60]
                rasters.append((f"{side}{k}", bytearray(shown)))
    return prints["q"], prints["r"], rasters


def brute(pending, reviewed, rasters):
    pixels = {i: bytes(r) for i, r in rasters}
    bits = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    out = {}
    for q in pending:
        for r in reviewed:
            dh, ah = bits(q[2], r[2]), bits(q[3], r[3])
            shape = min(q[4], q[5], r[4], r[5]) > 0 and abs(q[4] / q[5] - r[4] / r[5]) <= 0.02
            near = shape and (dh <= 4 or dh <= 8 and ah <= 2)
            diff = D.difference(pixels.get(q[0]), pixels.get(r[0])) if near else None
            if q[1] == r[1]:
                out.setdefault(q[0], []).append((0, 0, r[0], 0, 0))
            elif diff is not None and diff <= 4.0:
                out.setdefault(q[0], []).append((1, dh + ah, r[0], dh, ah))
    return {q: (r, not inexact, dh, ah) for q, best in out.items() for inexact, _, r, dh, ah in [min(best)]}


def test_near_duplicates_equal_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(D, "GROUP", 3)
    pending, reviewed, rasters = images()
    want = brute(pending, reviewed, rasters)
    best = D.near_duplicates(frame(PRINT, *pending), frame(PRINT, *reviewed), frame(RASTER, *rasters))
    got = {r.pending_id: (r.reviewed_id, r.exact, r.dh, r.ah) for r in best.collect()}
    assert len(want) > 50 and any(not exact for _, exact, _, _ in want.values()) and got == want
    assert D.near_duplicates(frame(PRINT, *pending), frame(PRINT), frame(RASTER)).count() == 0


def test_candidates_list_every_member_of_a_class(frame):
    zero = "0" * 16
    reviewed = [(f"r{k}", f"f{k}", zero, zero, 9, 9) for k in range(3)]
    found = D.candidate_pairs(frame(PRINT, ("q", "x", zero, zero, 9, 9)), frame(PRINT, *reviewed))
    assert sorted(r.reviewed_id for r in found.collect()) == ["r0", "r1", "r2"]


def test_keys_of_fingerprints_are_not_broadcast(frame):
    zero = "0" * 16
    prints = [D.written(frame(PRINT, *((f"{side}{k}", f"{side}{k}", zero, zero, 9, 9) for k in range(9)))) for side in "qr"]
    pairs = D.near_pairs(*prints)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert pairs.count() == 81


def test_the_bound_is_never_above_the_difference(frame):
    draw = np.random.default_rng(7)
    rows = []
    for n in (1, 5, 16, 40, 100):
        for spread in (1, 6, 80, 255):
            a = draw.integers(0, 256, 3 * n)
            b = np.clip(a + draw.integers(-spread, spread + 1, 3 * n), 0, 255)
            a, b = a.astype(np.uint8).tobytes(), b.astype(np.uint8).tobytes()
            rows.append((n, D.block_sums(a), D.block_sums(b), D.difference(a, b)))
    got = frame("n long, a array<long>, b array<long>, diff double", *rows).select("diff", D.least_difference(F.col("n"), F.col("a"), F.col("b")).alias("least")).collect()
    assert all(r.least <= r.diff + 1e-9 for r in got) and max(r.least for r in got) > 4


def test_aspect_in_the_key_meets_fewer_rows_and_large_bands_are_named(frame):
    zero = "0" * 16
    flat = [(f"r{k}", f"f{k}", zero, f"{k:016x}", 100 + 5 * k, 100) for k in range(40)]
    reviewed = frame(PRINT, *flat)
    asked, held = D.banded(reviewed, "q", 4, 2, around=1), D.banded(reviewed, "r", 4, 2)
    met = asked.join(held, ["tag", "band", "bucket"]).count()
    assert met < asked.drop("bucket").distinct().join(held.drop("bucket"), ["tag", "band"]).count() / 5
    assert D.large_bands(reviewed, least=2).count() == 0
    assert {r.n for r in D.large_bands(frame(PRINT, *((f"r{k}", "f", zero, f"{k:016x}", 10, 10) for k in range(9))), least=9).collect()} == {9}
