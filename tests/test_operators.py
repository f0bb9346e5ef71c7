"""Operators without SQL, edges of rules, and the driver's geometry, against brute force in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, rings, text
from geoloom.operators import cards, graph, identity, manifest, pixels, ranges, scenes
from geoloom.plans import record_queries
from geoloom.plans.views import view
from geoloom import request
from geoloom.request import BBox, Polygon, PullRequest, segments_meet
from geoloom.sources import listings, payloads, registry, sinks, stac
from geoloom.sources.families import Source

SF = "/root/testdata/sf0.001"


def test_box_rules():
    assert BBox(170, -20, -170, -10).span == 20
    assert [p.edges for p in BBox(170, -20, -170, -10).parts] == [(170, -20, 180.0, -10), (-180.0, -20, -170, -10)]
    assert BBox.enclosing([(170, -10), (-170, -20)]).edges == (170, -20, -170, -10)
    with pytest.raises(ValueError):
        BBox(0, 10, 1, 5)
    with pytest.raises(ValueError):
        PullRequest(dt.date(2024, 2, 1), dt.date(2024, 1, 1), BBox(0, 0, 1, 1))
    with pytest.raises(ValueError):
        PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 1), BBox(0, 0, 1, 1), min_cloud=50, max_cloud=10)


def test_rings_are_checked_and_turned():
    ring = Polygon(((0, 0), (0, 2), (2, 2), (2, 0), (0, 0)))
    assert ring.ring[1] == (2.0, 0.0)
    again = Polygon(((2, 2), (2, 0), (0, 0), (0, 2), (2, 2)))
    assert ring.signature == again.signature
    for bad in ([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (1, 1), (0, 0)], [(0, 0), (1, 0), (2, 0), (0, 0)]):
        with pytest.raises(ValueError):
            Polygon(tuple(bad))


def test_ring_across_the_dateline_in_pieces():
    ring = Polygon(((170, -10), (-170, -10), (-170, 10), (170, 10), (170, -10)))
    areas = []
    for piece in ring.pieces:
        lons = [p[0] for p in piece]
        assert min(lons) >= -180 and max(lons) <= 180 and piece[0] == piece[-1]
        areas.append(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(piece, piece[1:], strict=False)) / 2))
    assert areas == [200, 200]
    spikes = Polygon(((170, -10), (-175, -8), (175, -5), (-175, 5), (170, 10), (170, -10)))
    assert len(spikes.pieces) == 3


def test_ring_contains_points_and_meets_boxes(spark):
    rng = random.Random(5)
    ring = Polygon(((170.0, -10.0), (-170.0, -10.0), (-175.0, 0.0), (-170.0, 10.0), (170.0, 10.0), (170.0, -10.0)))
    points = [(round(rng.uniform(160, 200), 2), round(rng.uniform(-15, 15), 2)) for _ in range(300)]
    back = [(x if x <= 180 else round(x - 360, 2), y) for x, y in points]
    got = [r[0] for r in spark.createDataFrame(back, "lon double, lat double").coalesce(1).select(rings.ring_contains(ring, F.col("lon"), F.col("lat"))).collect()]

    def inside(p):
        hits = 0
        for (x1, y1), (x2, y2) in zip(ring.plane, ring.plane[1:], strict=False):
            hits += (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1
        return hits % 2 == 1

    assert got == [inside((x, y)) for x, y in points]
    boxes = [(x, y, round(x + rng.uniform(0.1, 6), 2), round(y + rng.uniform(0.1, 6), 2)) for x, y in points]
    rows = [(w if w <= 180 else w - 360, s, e if e <= 180 else e - 360, n) for w, s, e, n in boxes]
    got = [r[0] for r in spark.createDataFrame(rows, "west double, south double, east double, north double").coalesce(1).select(rings.ring_meets_box(ring, geo.Box.col())).collect()]

    def meets(b):
        w, s, e, n = b
        corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
        edges = list(zip(ring.plane, ring.plane[1:], strict=False))
        return (
            any(segments_meet(a, b_, c, d) for a, b_ in edges for c, d in zip(corners, corners[1:], strict=False))
            or inside((w, s)) or any(w <= x <= e and s <= y <= n for x, y in ring.plane)
        )

    assert got == [meets(b) for b in boxes]


def test_limits_pick_in_order_of_time(spark):
    rows = [(i, f"s{i}", "a", dt.datetime(2024, 1, 1 + d)) for i, d in enumerate((2, 0, 3, 1))]
    df = spark.createDataFrame(rows, "ord long, id string, source string, ts timestamp_ntz")
    ids = lambda n, m: sorted(r.id for r in scenes.picked(df, n, m).collect())
    assert ids(2, "first") == ["s1", "s3"] and ids(2, "last") == ["s0", "s2"] and ids(3, "even") == ["s0", "s1", "s2"]
    assert ids(1, "even") == ["s1"] and len(ids(9, "last")) == 4
    assert scenes.picked(df.limit(0), 3, "even").count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_claims_as_one_after_another(spark):
    stored, found = view(spark, SF, "stored"), record_queries._matched(spark, SF)
    rows = sorted(found.collect(), key=lambda r: (r.old_ord, r.id))
    one = {r.old_id: (r.n, r.new_id) for r in identity.chosen(found).collect()}
    taken, want = set(), {}
    for old in sorted({(r.old_ord, r.old_id) for r in rows}):
        left = [r for r in rows if r.old_id == old[1] and r.id not in taken]
        if not left:
            want[old[1]] = ("no match", None)
        elif len(left) == 1:
            want[old[1]] = ("replaced", left[0].id)
            taken.add(left[0].id)
        else:
            new = one[old[1]][1] if len(left) == one[old[1]][0] else identity.chosen(found.filter((F.col("old_id") == old[1]) & ~F.col("id").isin([*taken]))).first().new_id
            want[old[1]] = ("replaced" if new else "ambiguous", new)
            taken |= {new} if new else set()
    got = {r.old_id: (r.outcome, r.new_id) for r in identity.claimed(stored, found).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == ("no match", None) for k, v in got.items() if k not in want) and len(got) == stored.count()


def test_card_expiry_as_a_clock_runs(spark):
    rng = random.Random(7)
    log = [(i, float(t), "put" if rng.random() < 0.3 else "lookup", f"c{rng.randrange(6)}", "one") for i, t in enumerate(sorted(rng.uniform(0, 8000) for _ in range(900)))]
    put, end, gone, want = {}, {}, set(), []
    for seq, t, op, key, _ in log:
        for k in [k for k in end if t >= end[k]]:
            del end[k]
            gone.add(k)
        if op == "put":
            put[key], end[key] = t, min(t + 300, t + 1800)
            gone.discard(key)
        elif key in end:
            end[key] = min(t + 300, put[key] + 1800)
            want.append((seq, "found"))
        else:
            want.append((seq, "expired" if key in gone else "missing"))
    df = spark.createDataFrame(log, "seq long, t double, op string, index_id string, store string")
    assert sorted((r.seq, r.status) for r in cards.replay(df).collect()) == want


def test_manifest_merge(spark):
    row = lambda **x: {"source": "a", "ord": 1, "request_hash": "h", "collection": "c", "next_cursor": None, "error": None, "cursor_rejected": False, "scene_ids": [], "saved": [], "skipped": [], "previews": [], "failed": [], "windows": []} | x
    old = spark.createDataFrame([row(saved=["x", "y"], next_cursor="p2", failed=[("f", "one"), ("g", "one")], windows=[("w", 1, 2)]), row(source="b", ord=2)], manifest.SCHEMA)
    new = spark.createDataFrame([row(saved=["y", "z"], error="HTTP 500", failed=[("f", "two")], windows=[("w", 9, 9)])], manifest.SCHEMA)
    got = {r.source: r for r in manifest.merged(old, new).collect()}
    assert got["a"].saved == ["x", "y", "z"] and got["a"].next_cursor == "p2" and got["a"].error == "HTTP 500"
    assert [tuple(f) for f in got["a"].failed] == [("f", "two"), ("g", "one")] and tuple(got["a"].windows[0]) == ("w", 1, 2)
    assert got["b"].error is None
    rejected = manifest.merged(old, new.withColumn("cursor_rejected", F.lit(True))).filter("source = 'a'").first()
    assert rejected.next_cursor is None


def test_blobs_of_a_ring_and_a_speck(spark):
    ring = [(1, r, c) for r in range(6) for c in range(6) if r in (0, 5) or c in (0, 5)]
    df = spark.createDataFrame([*ring, (1, 2, 2), (2, 0, 0)], "image long, row long, col long")
    got = [tuple(r) for r in pixels.blobs(df, 2).select("image", "area", "row0", "col0", "row1", "col1").collect()]
    assert got == [(1, 20, 0, 0, 5, 5)]
    hull = pixels.hulls(df, 2).collect()
    assert [(r.image, r.area, r.points) for r in hull] == [(1, 20, [0, 0, 5, 0, 5, 5, 0, 5])]


def test_stac_odd_items(spark):
    items = [
        (1, '{"id":"a","bbox":[-190,-5,-170,5],"properties":{"datetime":"2024-01-01T00:00:00"}}'),
        (2, '{"id":"b","bbox":[-200,-5,200,5],"properties":{"datetime":"2024-01-01 00:00:00Z","eo:cloud_cover":"140"}}'),
        (3, '{"id":"c","bbox":[1,2,3],"properties":{"datetime":"2024-01-01T00:00:00Z"}}'),
        (4, '{"id":"d","geometry":{"type":"Point","coordinates":[180,1]},"properties":{"start_datetime":"2024-01-01T00:00:00Z"}}'),
        (5, "not json"),
        (6, None),
    ]
    got = {r.id: r for r in stac.scenes(spark.createDataFrame(items, "ord long, item string")).collect()}
    assert sorted(got) == ["a", "b", "d"]
    assert (got["a"].west, got["a"].east) == (170, -170) and (got["b"].west, got["b"].east, got["b"].cloud) == (-180, 180, 100)
    assert (got["d"].geometry_kind, got["d"].east) == ("point", 180)


def test_cursor_replay_and_bodies():
    request = PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 2), BBox(0, 0, 1, 1), max_cloud=20)
    body = stac.search_body(request, "c", "optical", 10)
    assert body["query"] == {"eo:cloud_cover": {"lte": 20}} and body["datetime"] == "2024-01-01T00:00:00Z/2024-01-02T23:59:59Z"
    assert "query" not in stac.search_body(request, "c", "sar", 10)
    method, href, merged = stac.replayed('{"method":"POST","href":"u","merge":true,"body":"{\\"token\\":1}"}', body)
    assert (method, href, merged["token"], merged["limit"]) == ("POST", "u", 1, 10)
    assert payloads.cmr_params(request, "S", "1", "optical", 5)["cloud_cover"] == "0,20"


def test_registry_of_sources(spark):
    assert len(registry.rows()) == 61
    assert {r.source for r in registry.resolved(spark, "Sentinel-2", "OPTICAL").collect()} >= {"sentinel2", "hls_sentinel"}
    with pytest.raises(KeyError):
        registry.sources(spark, "nowhere")


def test_gateway_grid_text(spark):
    said = 'Dataset: x\nX, 10.0, 10.1\nY, 50.0, 50.1\nV.V[0][50.0], 1, 2\nV.V[0][50.1], 3, -9999.0\n'
    got = {(r.name): (r.dims, r["values"]) for r in payloads.grids(spark.createDataFrame([("f", said), ("g", None)], "file string, text string")).collect()}
    assert got["V"] == ([1, 2, 2], [1.0, 2.0, 3.0, -9999.0]) and got["X"] == ([2], [10.0, 10.1])


def test_classic_grid_text(spark):
    said = (
        'Dataset {\n} x;\nV.V[2][2];\n[0], 1, 2\n[1] , 3.5, -1e2\n\nV.X[2]\n7, 8\nX.X[2]\n10.0, 10.1\nnote\n99, 98\n'
        'Q.Q[1]\n"5, 6"\nV.V[1][1]\n[0], 4\nW[2]\n1 2\n'
    )
    rows = payloads.grids(spark.createDataFrame([("f", said), ("g", ""), ("h", 'A[1]\r\n3\r\n')], "file string, text string")).collect()
    got = {(r.file, r.name): (r.dims, r["values"]) for r in rows}
    assert got == {
        ("f", "V"): ([2, 2], [1.0, 2.0, 3.5, -100.0]), ("f", "V.X"): ([2], [7.0, 8.0]), ("f", "X"): ([2], [10.0, 10.1]),
        ("f", "Q"): ([1], []), ("f", "W"): ([2], [1.0, 2.0]), ("h", "A"): ([1], [3.0]),
    }


def test_gateway_rows_of_unlike_lengths_are_no_array(spark):
    said = "Dataset: x\nV.V[a][1], 1, 2\nV.V[a][2], 3\nV.X, 1, 2\nV.X, 1, 2, 3\nlabel, 5\n"
    got = {r.name: (r.dims, r["values"]) for r in payloads.grids(spark.createDataFrame([("f", said)], "file string, text string")).collect()}
    assert got == {"X": ([3], [1.0, 2.0, 3.0])}


def test_redaction_rules(spark):
    cases = {
        "https://user:pw@host.x/a?sig=1&b=2#f": "https://host.x/a?***#***",
        "GET /api/Country/csv/SECRET/X failed": "GET /api/Country/csv/***/X failed",
        "monkey=1 key=2 my_token=3 x-amz-date=4": "monkey=1 key=*** my_token=3 x-amz-date=***",
        "Authorization: Basic abc== and bearer a.b-c": "Authorization: Basic *** and bearer ***",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(text.redacted(F.col("t"))).collect()] == [*cases.values(), None]
    said = df.select(text.error_text(F.lit("Timeout"), F.col("t"))).collect()
    assert said[-1][0] == "Timeout" and said[-2][0] == "Timeout: plain"


def test_file_names(spark):
    import hashlib

    long, key = "S" * 300, "k" * 300
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()[:8]
    cases = [
        ("a b", "B04", "tif", "a_b_B04.tif"), ("x_c1.nc", "data", ".nc", "x_c1_data.nc"), ("x.BIN", "data", ".bin", "x.BIN_data.bin"),
        (".nc", "data", ".nc", ".nc_data.nc"), ("con.1", "b", ".tif", "_con.1_b.tif"), ("é..", "", ".tif", "___.tif"),
        (long, "b", ".tif", "S" * (240 - 6 - 9) + "~" + digest(long) + "_b.tif"),
        ("s", key, ".tif", "s_" + "k" * (240 - 24 - 4 - 9) + "~" + digest(key) + ".tif"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "i string, k string, s string").coalesce(1)
    got = [r[0] for r in df.select(text.scene_filename(F.col("i"), F.col("k"), F.col("s"))).collect()]
    assert got == [c[3] for c in cases] and all(len(x.encode()) <= 240 for x in got)


def test_reads_within_the_cap(spark):
    rng = random.Random(4)
    spans = [(i % 3, a, a + rng.randrange(1, 900)) for i, a in enumerate(rng.randrange(0, 60_000) for _ in range(300))]
    spans += spans[:20] + [(0, 100_000, 109_000)]
    want: dict = {}
    for f in range(3):
        out = []
        for a, b in sorted({(a, b) for g, a, b in spans if g == f}):
            n = spans.count((f, a, b))
            if out and a <= out[-1][1] + 50 and max(out[-1][1], b) - out[-1][0] <= 4000:
                out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
            else:
                out.append((a, b, n))
        want[f] = out
    df = spark.createDataFrame(spans, "file long, start long, stop long")
    got = ranges.coalesced(df, ["file"], gap=50, most=4000, block=1 << 12).collect()
    assert {f: sorted((r.start, r.stop, r.n) for r in got if r.file == f) for f in range(3)} == want


def test_request_texts():
    assert request.parse_dates(" 2024-07-01 / 2024-07-03") == (dt.date(2024, 7, 1), dt.date(2024, 7, 3))
    assert request.parse_box("170,-20,-170,-10").span == 20
    assert request.parse_names(" a, ,b ,") == ["a", "b"]
    ring = request.parse_polygon("0,0; 2,0; 2,2")
    assert ring.ring == ((0, 0), (2, 0), (2, 2), (0, 0))
    assert request.parse_polygon('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0,5],[2,0],[2,2],[0,0,7]]]}}') == ring
    assert request.parse_polygon("[[0,0],[2,0],[2,2]]") == ring
    for call, bad in (
        (request.parse_dates, "2024-07-03:2024-07-01"), (request.parse_dates, "2024-07-03"), (request.parse_box, "1,2,1,3"), (request.parse_box, "1,2,3"),
        (request.parse_box, "1,5,2,3"), (request.parse_polygon, '{"type":"Point"}'), (request.parse_polygon, "0,0;1"), (request.parse_polygon, ""),
    ):
        with pytest.raises(ValueError):
            call(bad)


def test_grid_axes_and_windows(spark):
    assert payloads.axis(-179.95, 179.95, 3600)[1] == -179.85 and payloads.axis(1.0, 1.0, 1) == [1.0]
    assert payloads.cell_window(10.1, 10.35, 10.0, 0.1, 6) == (1, 3)
    with pytest.raises(ValueError):
        payloads.cell_window(10.11, 10.12, 10.0, 0.1, 6)
    cells = spark.createDataFrame([(x, y) for x in range(6) for y in range(5)], "x int, y int")
    grid = (10.0, 0.1, 6, 50.0, 0.1, 5)
    ask = lambda *edges: PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 1), BBox(*edges))
    assert sorted(map(tuple, payloads.cells_within(cells, ask(10.1, 50.0, 10.2, 50.1), grid).collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    for refuse in (lambda: payloads.cells_within(cells, ask(170, 0, -170, 1), grid), lambda: payloads.model_granules(cells, "M", ask(170, 0, -170, 1))):
        with pytest.raises(ValueError):
            refuse()


def test_targets_of_geostationary_searches():
    ask = lambda first, last, *edges: listings.goes_targets(PullRequest(first, last, BBox(*edges)))
    over = ask(dt.date(2025, 4, 1), dt.date(2025, 4, 8), -90, 30, -80, 40)
    assert [x[:3] for x in over] == [("noaa-goes16", "east", "ABI-L2-MCMIPC"), ("noaa-goes19", "east", "ABI-L2-MCMIPC")]
    both = ask(dt.date(2024, 1, 1), dt.date(2024, 1, 2), 170, -20, -150, 10)
    assert [x[:3] for x in both] == [("noaa-goes18", "west", "ABI-L2-MCMIPF")]
    assert ask(dt.date(2024, 1, 1), dt.date(2024, 1, 2), 10, 0, 20, 5) == []
    with pytest.raises(ValueError):
        ask(dt.date(2000, 1, 1), dt.date(2000, 1, 2), -90, 30, -80, 40)


def test_fire_requests(spark):
    r = PullRequest(dt.date(2026, 9, 1), dt.date(2026, 9, 18), BBox(170, -20, -170, -10))
    rows = [tuple(x) for x in listings.fire_requests(spark, r, dt.date(2026, 9, 18)).orderBy("turn").collect()]
    spans = [(dt.date(2026, 9, 17), 10), (dt.date(2026, 9, 7), 7)]
    assert [x[2:] for x in rows] == spans * 2 and {x[1] for x in rows} == {"170,-20,180.0,-10", "-180.0,-20,-170,-10"}
    today = PullRequest(dt.date(2026, 9, 18), dt.date(2026, 9, 18), BBox(0, 0, 1, 1))
    assert listings.fire_requests(spark, today, dt.date(2026, 9, 18)).count() == 0


def test_resumed_runs(spark):
    row = lambda **x: {"source": "a", "ord": 1, "request_hash": "h", "collection": "c", "next_cursor": None, "error": None, "cursor_rejected": False, "scene_ids": [], "saved": [], "skipped": [], "previews": [], "failed": [], "windows": []} | x
    rows = [row(next_cursor="p"), row(source="b"), row(source="c", error="x"), row(source="d", request_hash="other", next_cursor="q"), row(source="e", error="x", next_cursor="r")]
    got = {r.source: (r.action, r.cursor) for r in manifest.resumed_from(spark.createDataFrame(rows, manifest.SCHEMA), F.lit("h")).collect()}
    assert got == {"a": ("resume", "p"), "b": ("exhausted", None), "c": ("restart", None), "d": ("restart", None), "e": ("resume", "r")}


def test_manifests_that_are_none(spark):
    texts = [None, "", "[]", '{"sources":1}', '{"sources":[3,{"source":""},{"source":"a","request":5}]}']
    got = manifest.source_rows(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r.ord, r.source, r.request) for r in got] == [(2, "a", None)]
    rows = spark.createDataFrame([("s", '{"scenes":["x",{"id":"y","footprint":[1,2,3,4]},{"id":7}],"scene_ids":["y","z",5]}'), ("t", "{}")], "source string, row string")
    assert sorted((r.source, r.ord, r.id, r.west) for r in manifest.stored_scenes(rows).collect()) == [("s", 0, "x", None), ("s", 1, "y", 1.0), ("s", 4, "z", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    sinks.write_new(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="exist"):
        sinks.write_new(df, f"{tmp_path}/t")
    sinks.write_new(df.union(df), f"{tmp_path}/t", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1), "tool", 3)], "time timestamp, event string, n int")
    for _ in range(2):
        sinks.append_events(events, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    sinks.write_traces(spark.createDataFrame([("r", "{}")], "run_id string, run string"), f"{tmp_path}/traces")
    spark.createDataFrame([("old", "{}", 0)], "run_id string, run string, schema_version int").write.mode("append").json(f"{tmp_path}/traces")
    assert [r.run_id for r in sinks.read_traces(spark, f"{tmp_path}/traces").collect()] == ["r"]
    weights = spark.createDataFrame([("a", "p", bytearray(b"x")), ("b", "q", bytearray(b"y")), ("c", "r", bytearray(b"z"))], "name string, path string, content binary")
    import hashlib

    pins = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest().upper()), ("b", "bad"), ("c", None)], "name string, sha256 string")
    assert [r.name for r in sinks.pinned(weights, pins).collect()] == ["a"]
    assert sorted(r.name for r in sinks.pinned(weights, pins, allow_unpinned=True).collect()) == ["a", "c"]


def test_layers_of_several_channels(spark):
    rng = random.Random(6)
    pixels_ = {(r, c): (rng.randrange(-5, 9), rng.randrange(9)) for r in range(-3, 9) for c in range(-2, 11) if rng.random() < 0.8}
    kernels = [[[[rng.randrange(-3, 4) for _ in range(3)] for _ in range(3)] for _ in range(2)] for _ in range(3)]
    want = {}
    for r, c in pixels_:
        sums = [b + sum(k[ch][i][j] * pixels_.get((r + i - 1, c + j - 1), (0, 0))[ch] for ch in range(2) for i in range(3) for j in range(3)) for k, b in zip(kernels, (0.5, -1.0, 2.0), strict=True)]
        want[r, c] = [max(0.0, x) for x in sums]
    df = spark.createDataFrame([("t", r, c, float(a), float(b)) for (r, c), (a, b) in pixels_.items()], "image string, row long, col long, x double, y double")
    out = pixels.layer(df, kernels, [0.5, -1.0, 2.0], ["x", "y"], ["p", "q", "z"], side=4)
    assert {(r.row, r.col): [r.p, r.q, r.z] for r in out.collect()} == want
    got = {(r.row, r.col): r.label for r in pixels.labelled(out, ["p", "q", "z"]).collect()}
    assert got == {at: x.index(max(x)) for at, x in want.items()}


def test_enclosing_boxes_of_many_points(spark):
    rng = random.Random(3)
    sets = [[(rng.choice([-179.5, 179.25, 10.0, 10.5]) + rng.randrange(3) / 8, rng.randrange(-9, 9)) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    df = spark.createDataFrame([(i, min(180.0, float(x)), float(y)) for i, own in enumerate(sets) for x, y in own], "k int, lon double, lat double")
    got = {r.k: (r.west, r.south, r.east, r.north) for r in scenes.enclosing_boxes(df, ["k"]).collect()}
    assert got == {i: BBox.enclosing([(min(180.0, float(x)), float(y)) for x, y in own]).edges for i, own in enumerate(sets)}


def test_enclosing_boxes_whose_gaps_tie_but_for_rounding(spark):
    """Both gaps are 107.28 degrees: the one across 180 degrees wins, though it comes out a few last digits less."""
    lons = [-120.54, -66.9, 40.38, 132.18]
    assert 0 < (40.38 - -66.9) - (360.0 - (132.18 - -120.54)) < 1e-12
    r = scenes.enclosing_boxes(spark.createDataFrame([(1, x, 0.0) for x in lons], "k int, lon double, lat double"), ["k"]).first()
    assert (r.west, r.east) == (-120.54, 132.18)


def test_sources_by_name(spark):
    item = '{"id":"%s","bbox":[1,1,2,2],"properties":{"datetime":"2024-07-01T12:00:00Z","platform":"%s","eo:cloud_cover":%d},"assets":{%s}}'
    asset = lambda *keys: ",".join(f'"{k}":{{"href":"https://x/{k}"}}' for k in keys)
    r = PullRequest(dt.date(2024, 7, 1), dt.date(2024, 7, 1), BBox(0, 0, 3, 3), max_cloud=50)
    rows = [(1, item % ("a", "landsat-8", 5, "")), (2, item % ("b", "landsat-9", 5, "")), (3, item % ("c", "landsat-8", 90, "")), (4, item % ("a", "landsat-8", 1, ""))]
    df = spark.createDataFrame(rows, "ord long, item string")
    assert [(x.id, x.cloud, x.source) for x in Source.of("landsat8").search(df, r).collect()] == [("a", 5, "landsat8")]
    assert [x.id for x in Source.of("landsat9").search(df, r).collect()] == ["b"]
    goes = spark.createDataFrame([(1, item % ("g", "G16", 1, asset("C02_0.5km", "C02_2km", "C03_2km_wm", "C03_2km")))], "ord long, item string")
    assert Source.of("goes_cmi").search(goes, r).first().band_aliases == {"red": "C02_2km", "nir": "C03_2km_wm"}
    days = Source.of("gibs_snow").search(df, PullRequest(dt.date(2024, 7, 1), dt.date(2024, 7, 3), BBox(170, 0, -170, 3)))
    assert days.count() == 6
    with pytest.raises(KeyError):
        Source.of("nowhere")
    with pytest.raises(ValueError):
        Source.of("goes").search(df, r)
    assert {Source.of(x[0]).family for x in registry.rows()} == {"stac", "gibs", "firms", "cmr", "listing", "tree", "grid"}


def test_an_item_is_parsed_once_and_only_what_is_asked_for(spark):
    """Each asset's text once, whatever the number of bands; no assets at all where nobody asks for them."""
    df = spark.createDataFrame([(1, '{"id":"a"}')], "ord long, item string")
    parses = lambda d: sum(d._jdf.queryExecution().optimizedPlan().toString().count(f) for f in ("from_json(", "parse_json(", "parseJson("))
    assert 0 < parses(stac.scenes(df).select("id", "cloud", "platform")) <= 4
    assert 0 < parses(stac.scenes(df).select("ord", "assets", "band_aliases")) <= 6


def test_merged_lists_of_runs_are_never_one_cell(spark):
    """By rows as by arrays: an id at the place of its first, its error that of the last; and no list is gathered in the plan."""
    import hashlib

    from geoloom.operators import states
    from geoloom.plans.record_queries import QUERIES

    schema = "source string, state string, id string, pos long, detail string"
    one = spark.createDataFrame([("a", "failed", "f", 0, "one"), ("a", "failed", "g", 1, "two"), ("a", "saved", "x", 0, None)], schema)
    two = spark.createDataFrame([("a", "failed", "f", 0, "three"), ("a", "failed", "e", 1, "four"), ("a", "saved", "b", 0, None), ("a", "saved", "x", 1, None)], schema)
    got = {r.state: (r.n, r.digest) for r in states.listed(states.resumed([one, two]), F.concat_ws(":", "id", "detail")).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {"failed": (3, md5("f:three,g:two,e:four")), "saved": (2, md5("x,b"))}
    assert "collect_list" not in QUERIES["snk02_resume_merge"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["w05_claims", "w05_claim_chains"])
def test_claims_send_nothing_through_the_driver(spark, name):
    """No side of a join is broadcast, however small it looks once it is written."""
    from geoloom.plans.record_queries import QUERIES

    plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
