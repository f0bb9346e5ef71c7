"""Searches over landed listings and area feeds: which files, slots and detections answer a request.

Whoever needs the present passes it in. What is fetched stays a connector's business: these take the keys and lines that
have landed and choose among them by Spark columns; the requests that a search makes come as a small literal table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.request import BBox, PullRequest
from geoloom.sources import payloads

OPEN = dt.date.max
#: Buckets of the two geostationary satellites and the days, both inclusive, on which each was in service.
GOES_SERVICE = {
    "east": (("noaa-goes16", dt.date(2017, 12, 18), dt.date(2025, 4, 6)), ("noaa-goes19", dt.date(2025, 4, 7), OPEN)),
    "west": (
        ("noaa-goes15", dt.date(2012, 1, 1), dt.date(2019, 2, 11)),
        ("noaa-goes17", dt.date(2019, 2, 12), dt.date(2023, 1, 3)),
        ("noaa-goes18", dt.date(2023, 1, 4), OPEN),
    ),
}
#: Areas that the products show, and the meridian between the two satellites.
GOES_CONUS = BBox(-125.0, 24.0, -66.0, 50.0)
GOES_DISK = {"east": BBox(-135.0, -50.0, -15.0, 50.0), "west": BBox(-180.0, -50.0, -105.0, 60.0)}
GOES_MERIDIAN = -105.0
CONUS_PRODUCT, DISK_PRODUCT = "ABI-L2-MCMIPC", "ABI-L2-MCMIPF"
#: The area of the third one's disk, its bands by common name, and hours until a slot's files are all there.
HIMAWARI_DISK = BBox(80.0, -60.0, -160.0, 60.0)
HIMAWARI_ALIASES = {"blue": "B01", "green": "B02", "red": "B03", "nir": "B04"}
HIMAWARI_SETTLE = 3
#: Fixed value: days of one area request.
FIRE_DAYS = 10


def _meets(a: BBox, b: BBox) -> bool:
    return any(p.west <= q.east and q.west <= p.east and p.south <= q.north and q.south <= p.north for p in a.parts for q in b.parts)


def goes_side(box: BBox) -> str:
    """The satellite that a box without a crossing is seen by: by its centre."""
    return "east" if (box.west + box.east) / 2 >= GOES_MERIDIAN else "west"


def goes_product(box: BBox) -> str:
    """The product of the smaller area if it holds the box."""
    c = GOES_CONUS
    return CONUS_PRODUCT if c.west <= box.west and box.east <= c.east and c.south <= box.south and box.north <= c.north else DISK_PRODUCT


def goes_targets(request: PullRequest) -> list[tuple[str, str, str, dt.date, dt.date]]:
    """(bucket, side, product, first, last) for each side of the box that its product's area meets, and each satellite
    that was in service within the dates. A side that is seen but had none is an error, not an empty answer."""
    found: dict[tuple, None] = {}
    for part in request.bbox.parts:
        side, product = goes_side(part), goes_product(part)
        if not _meets(GOES_CONUS if product == CONUS_PRODUCT else GOES_DISK[side], part):
            continue
        own = [x for x in GOES_SERVICE[side] if x[1] <= request.end and request.start <= x[2]]
        if not own:
            raise ValueError(f"no satellite was in service on the {side} side from {request.start} to {request.end}")
        found |= {(bucket, side, product, first, last): None for bucket, first, last in own}
    return list(found)


def newest(scenes: DataFrame, limit: int | None) -> DataFrame:
    """The newest scenes, as many as the limit says, in order of time. A top-k: each task keeps no more than the limit."""
    return scenes.orderBy("ts", "id") if limit is None else scenes.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit).orderBy("ts", "id")


def goes_search(keys: DataFrame, request: PullRequest, now: dt.datetime) -> DataFrame:
    """Scenes of a listing (bucket, key) that answer a request: those of the targets' products, within the days, of hours
    that were over by now, the newest ones if there is a limit. A key that is listed twice counts once."""
    last = F.lit(now) - F.expr("interval 1 hour")
    found = None
    for bucket, side, product, _, _ in goes_targets(request):
        own = keys.filter((F.col("bucket") == bucket) & F.col("key").startswith(f"{product}/")).withColumn("ord", F.lit(0))
        seen = payloads.goes(own, bucket, side, product).drop("ord")
        found = seen if found is None else found.unionByName(seen)
    if found is None:
        return payloads.goes(keys.withColumn("ord", F.lit(0)).limit(0), "", "east", "").drop("ord")
    day = F.to_date("ts")
    kept = found.filter(day.between(F.lit(request.start), F.lit(request.end)) & (F.date_trunc("hour", "ts") <= last))
    return newest(kept.dropDuplicates(["id"]), request.limit)


def himawari_search(keys: DataFrame, request: PullRequest, now: dt.datetime) -> DataFrame:
    """Slots of a listing (key) that answer a request whose box meets the disk: settled ones, the newest if limited."""
    slots = payloads.himawari(keys)
    if not _meets(HIMAWARI_DISK, request.bbox):
        return slots.limit(0)
    settled = F.col("ts") <= F.lit(now) - F.expr(f"interval {HIMAWARI_SETTLE} hours")
    return newest(slots.filter(F.to_date("ts").between(F.lit(request.start), F.lit(request.end)) & settled), request.limit)


def fire_window(request: PullRequest, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """The days that a feed has published: up to yesterday; none if the request begins later."""
    last = min(request.end, today - dt.timedelta(days=1))
    return (request.start, last) if request.start <= last else None


def fire_requests(spark: SparkSession, request: PullRequest, today: dt.date) -> DataFrame:
    """turn, area, last, days of the area requests of a search, in the order in which they are sent: each side of 180
    degrees, and for each, spans of up to FIRE_DAYS days from the newest back."""
    rows, window = [], fire_window(request, today)
    for part in request.bbox.parts if window else []:
        area, last = ",".join(map(str, part.edges)), window[1]
        while last >= window[0]:
            days = min(FIRE_DAYS, (last - window[0]).days + 1)
            rows.append((len(rows), area, last, days))
            last -= dt.timedelta(days=days)
    return spark.createDataFrame(rows, "turn int, area string, last date, days int")


def fire_search(answers: DataFrame, request: PullRequest, source: str, today: dt.date, **named) -> DataFrame:
    """Point scenes of the answers (area, last, line_no, line) to a search's requests: each id once, as the first request
    that gave it has it; the first ones in that order if there is a limit, so what a later request would add is not read."""
    asked = fire_requests(answers.sparkSession, request, today)
    # As many rows as requests are sent: days over ten, on two sides at most.
    lines = answers.join(F.broadcast(asked.select("turn", "area", "last")), ["area", "last"])
    lines = lines.select(F.struct("turn", "line_no").alias("ord"), "line")
    found = payloads.fires(lines, source, **named)
    row = F.struct(*[c for c in found.columns])
    first = found.groupBy("id").agg(F.min_by(row, "ord").alias("s")).select("s.*")
    return first.orderBy("ord") if request.limit is None else first.orderBy("ord").limit(request.limit)
