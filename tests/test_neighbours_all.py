"""Neighbour queries over all points against brute force."""

import numpy as np

from stratavox.plans.queries import QUERIES
from stratavox.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_joins_of_all_points(spark):
    rows = A.points(spark, SF).select("scan_id", "idx", "x", "y", "z").collect()
    ids = [(r.scan_id, r.idx) for r in rows]
    x = np.array([(r.x, r.y, r.z) for r in rows], np.int64)
    near, pairs, boxes, full = set(), set(), set(), set()
    for i, p in enumerate(x):
        off = x - p
        d2 = (off * off).sum(1)
        for rank, (d, key) in enumerate(sorted((int(d2[j]), ids[j]) for j in np.flatnonzero(d2 <= 3000**2))[:5], 1):
            near.add((*ids[i], *key, d, rank))
            if rank == 5:
                full.add(ids[i])
        pairs |= {(*ids[i], *ids[j]) for j in np.flatnonzero(d2 <= 1500**2)}
        boxes |= {(*ids[i], *ids[j]) for j in np.flatnonzero((np.abs(off) <= 1000).all(1))}
    got = {(r.q_scan_id, r.q_idx, r.p_scan_id, r.p_idx, r.d2, r["rank"]) for r in QUERIES["knn5_points"](spark, SF).collect()}
    assert got == near
    for name, want in (("radius_join", pairs), ("box_join", boxes)):
        assert {(r.q_scan_id, r.q_idx, r.p_scan_id, r.p_idx) for r in QUERIES[name](spark, SF).collect()} == want
    assert full and {(r.q_scan_id, r.q_idx) for r in QUERIES["plane_fit"](spark, SF).collect()} == full
