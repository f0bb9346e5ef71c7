"""Which sources one call searches, and the order of its lists."""

import datetime as dt

import pytest

from geoloom.operators import cards, pull
from geoloom.request import BBox, PullRequest
from geoloom.sources import registry

ASKED = PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 31), BBox(0.0, 0.0, 10.0, 10.0))


def item(name, day, cloud, size):
    return f'{{"type":"Feature","id":"{name}","bbox":[1,1,2,2],"properties":{{"datetime":"2024-01-{day:02d}T00:00:00Z","eo:cloud_cover":{cloud}}},"assets":{{"B04":{{"href":"https://e.x/{name}.tif","type":"image/tiff","roles":["data"],"file:size":{size}}}}}}}'


def test_sources_of_a_call():
    sar = [r[0] for r in registry.rows() if r[5] == "sar"]
    assert pull.chosen("sar") == sar and pull.chosen("sar", [sar[0], sar[0]]) == sar[:1]
    for kind, names in (("sar", ["nowhere"]), ("sar", ["sentinel2"]), ("pictures", None), ("landsurface", None)):
        with pytest.raises(ValueError):
            pull.chosen(kind, names)


def test_one_call(spark):
    items = spark.createDataFrame([(1, item("a", 3, 50, 100)), (2, item("b", 5, 10, "null")), (3, item("c", 9, 10, 7)), (4, item("late", 31, 0, 1).replace("2024-01", "2024-02"))], "ord long, item string")
    scenes, errors = pull.search({"sentinel2": items}, ASKED, "optical", ["sentinel2", "naip"])
    assert [(r.id, r.rank) for r in scenes.orderBy("rank").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    present = spark.createDataFrame([("sentinel2", "c")], "source string, scene string")
    rows = {r.source: r.asDict() for r in pull.estimated(scenes, errors, present).collect()}
    assert rows["naip"]["error"] and rows["naip"]["n_scenes"] is None
    own = rows["sentinel2"]
    assert (own["n_scenes"], own["cloud"], own["scene_count"], own["known_bytes"], own["unknown_scenes"], own["already_present"]) == (3, 10.0, 2, 100, 1, 1)
    with pytest.raises(ValueError):
        pull.search({}, ASKED, "optical", ["naip"])


def test_cards_are_listed_by_time_and_id(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a")], "ts int, index_id string").repartition(3)
    assert [tuple(r) for r in cards.listed(df).collect()] == [(1, "z"), (2, "a"), (2, "b")]
