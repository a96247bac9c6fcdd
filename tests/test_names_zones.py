from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import zones
from marquee.operators import names


def test_times_with_zones(spark):
    texts = [
        ("12 - 6pm PDT", "2025-03-09 19:00", "2025-03-10 01:00", "12:00:00", "18:00:00", "PDT"), ("Doors  9:30-11:45 PM est", "2025-03-10 02:30", "2025-03-10 04:45", "21:30:00", "23:45:00", "EST"), ("12-1 am MST", "2025-03-09 07:00", "2025-03-09 08:00", "00:00:00", "01:00:00", "MST"),
        ("10 - 2pm CDT", "2025-03-10 03:00", "2025-03-10 19:00", "22:00:00", "14:00:00", "CDT"), ("Sat, May 3, 2025 at 7:05 PM", "2025-05-03 19:05", None, "19:05:00", None, None), ("Sept 3, 2025 7:05 PM", None, None, None, None, None), ("25 - 26pm PST", None, None, None, None, None), (None, None, None, None, None, None), ("2/30/2025 7:05 pm", None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, said string")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    got = zones.instants(rows, "said", F.lit("2025-03-09").cast("date")).select("id", stamp("start"), stamp("end"), "start_time", "end_time", "zone").orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [t[1:] for t in texts]
    # 02:30 on the night of the change is an instant of either zone.
    assert zones.OFFSETS["PDT"] - zones.OFFSETS["PST"] == 1


def test_names_cut_out_of_titles(spark):
    known = [("San Jose", "place"), ("San", "place"), ("San Jose Bay Area", "place"), ("Bay Area", "place"), ("CA", "region"), ("New Mexico", "region"), ("New York", "place"), ("St. Louis", "place"), ("  ", "place")]
    titles = [
        ("Jazz, San Jose, CA", "Jazz"), ("San Jose Bay Area Band", "Band"), ("CA Dreams in San", "CA Dreams in"), ("New York New York", "New York New York"), ("Night New Mexico", "Night New Mexico"), ("Ball, New York New Mexico live", "Ball live"), ("'Quoted' show at the Theatre", "Quoted show"),
        ("St Louis Blues", "Blues"), ("Santa Fe Song", "Santa Fe Song"), ("", ""), (None, None), ("Rock 2024-05-06 -", "Rock"), ("sAN jOSE", "sAN jOSE"), ("CA", "CA"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(titles)], "id long, title string")
    got = names.without_names(rows, "id", "title", spark.createDataFrame(known, "name string, kind string")).orderBy("id").collect()
    assert [r.cleaned for r in got] == [w for _, w in titles]
    none = names.without_names(rows, "id", "title", spark.createDataFrame([], "name string, kind string"))
    assert none.filter("id = 0").first().cleaned == "Jazz, San Jose, CA"
