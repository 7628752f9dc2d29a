"""The catalog over a tall table, against brute force; a file name of its own, so that it is collected beside tests/llm."""

import math

from quadrille.plans import queries as Q


def test_mixed_crs_takes_the_newer_item_on_all_rows(spark, tmp_path):
    parts = [(k, 900.0 + k * 37 % 1009, k % 47 + 1) for k in range(50 * 690, 50 * 760)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    base = {(k % 50, k // 50): price if size % 7 else None for k, price, size in parts}
    want, half, radius = dict(base), 20037508.342789244, 6378137.0
    for gx, gy in ((x, y) for x in range(50) for y in range(760)):
        lon, lat = math.radians(7.0 + (gx + 0.5) * 0.01), math.radians(47.0 - (gy + 0.5) * 0.01)
        u, v = (lon * radius + half) / 1500.0 - 0.5 - 13880, (half - math.log(math.tan(lat / 2 + math.pi / 4)) * radius) / 1500.0 - 0.5 - 9420
        fx, fy = u - math.floor(u), v - math.floor(v)
        taps = [((math.floor(u) + k % 2, math.floor(v) + k // 2), (fx if k % 2 else 1 - fx) * (fy if k // 2 else 1 - fy), k) for k in range(4)]
        found = [(w, k, base[at] + 5000) for at, w, k in taps if base.get(at) is not None]
        if len(found) == 4:
            want[gx, gy] = sum(w * b for w, _, b in found)
        elif heavy := [x for x in found if x[0] > 1e-6]:
            want[gx, gy] = max(heavy)[2]
        elif any(at in base for at, _, _ in taps):
            want.setdefault((gx, gy), None)
    df = Q.QUERIES["catalog_mixed_crs"](spark, str(tmp_path))
    got = {(r.gx, r.gy): r.b0 for r in df.collect()}
    # Rows 700 and on lie south of 40 degrees.
    assert got.keys() == want.keys() and sum(b is not None and b > 5000 for (_, y), b in got.items() if y > 710) > 1000
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 2e-4) for k in want)
    # Cells aren't broadcast to the pixels, nor the stack to its items.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft" not in plan and not any("BroadcastHashJoin" in line and "sx#" in line for line in plan.splitlines())
