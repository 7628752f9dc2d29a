"""Registered raster queries over whole inputs, against brute force on small written tables."""

import math

from quadrille.plans import queries as Q


def write(spark, d, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")


def test_mosaic_takes_the_whole_second_layer(spark, tmp_path):
    parts = [(k, 900.0 + k, k % 50 + 1) for k in range(1, 400, 3)]
    orders = [(k, 10.0 * k) for k in range(1, 9000, 7)]
    write(spark, tmp_path, "part", "p_partkey long, p_retailprice double, p_size int", parts)
    write(spark, tmp_path, "orders", "o_orderkey long, o_totalprice double", orders)
    want = {(k % 125, k // 125): v for k, v in orders}
    for k, price, size in parts:
        at = (k % 50, k // 50)
        want[at] = price if size % 7 else want.get(at)
    got = {(r.gx, r.gy): r.b0 for r in Q.QUERIES["mosaic_first_wins"](spark, str(tmp_path)).collect()}
    assert got == want and max(x for x, _ in got) > 60 and max(y for _, y in got) > 30


def test_idw_takes_points_of_all_values(spark, tmp_path):
    rows = [(i, i * 7 % 30, (i * 37 % 2000) / 10.0, "2024-01-01 00:00:00") for i in range(1, 400)]
    write(spark, tmp_path, "events", "event_id long, user_id long, value double, ts string", rows)
    near = {}
    for i, x, y, _ in rows:
        px, py = int(x // 2), int((40 - y) // 2)
        for gx in range(px - 2, px + 3):
            for gy in range(py - 2, py + 3):
                if (d := math.hypot(x - (2 * gx + 1), y - (40 - (2 * gy + 1)))) <= 3:
                    near.setdefault((gx, gy), []).append((d, i, float(i % 97)))
    want = {}
    for at, points in near.items():
        if len(points) > 1:
            exact = [(i, z) for d, i, z in points if d == 0]
            want[at] = min(exact)[1] if exact else sum(z / d**2 for d, _, z in points) / sum(1 / d**2 for d, _, _ in points)
    got = {(r.gx, r.gy): r.b0 for r in Q.QUERIES["idw_grid"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and min(y for _, y in got) < -70
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
