from __future__ import annotations

import json

import pytest

from marquee.functions import trees
from marquee.operators import structured


def test_nodes_in_reading_order(spark):
    text = '{"b":{"y":[1,{"x":null}],"a":"{\\"no\\":1}"},"a":[],"k.k":{},"é":2.5}'
    rows = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, "7"), (5, "[[[[1]]]]")], "id long, j string")
    got = trees.nodes(rows, ["id"], "j").orderBy("id", "path").collect()
    assert [(r.names, r.kind) for r in got if r.id == 1] == [
        ([], "object"), (["b"], "object"), (["b", "y"], "list"), (["b", "y", None], "value"), (["b", "y", None], "object"), (["b", "y", None, "x"], "value"), (["b", "a"], "value"), (["a"], "list"), (["k.k"], "object"), (["é"], "value"),
    ]
    assert [json.loads(r.raw) for r in got if r.id == 1 and r.raw] == [json.loads(text), json.loads(text)["b"], [1, {"x": None}], {"x": None}, [], {}]
    assert {r.id for r in got} == {1, 4, 5} and sum(r.id == 5 for r in got) == 5


def deep(target, source):
    if not isinstance(source, dict) or not isinstance(target, dict):
        return source
    return {**target, **{k: deep(target.get(k), v) for k, v in source.items()}}


PAIRS = [
    ('{"a":{"b":{"c":1,"d":[1,2]}},"z":0}', '{"a":{"b":{"d":[3],"e":null}},"y":{"n":{}}}'), ('{"a":{"b":1}}', '{"a":5}'), ('{"a":5,"b":[1]}', '{"a":{"b":{"c":1}},"b":{"x":[{"y":1}]}}'), ('{"a":{"b":1}}', "{}"), ("{}", '{"a":{}}'), ('{"a":{"b":{"c":1}}}', '{"a":{"b":[]}}'),
    ('{"a":1}', "[1]"), ('{"q\\"uote":{"x.y":1}}', '{"q\\"uote":{"x.y":"é\\n","new":true}}'), ('{"a":{"b":1},"ab":{"b":2}}', '{"a":false}'),
]


def test_merge_like_a_fold(spark):
    side = lambda i: spark.createDataFrame([(n, p[i]) for n, p in enumerate(PAIRS)], "id long, j string")
    got = {r.id: r.j for r in trees.merged(side(0), side(1), ["id"], "j").collect()}
    want = {n: deep(json.loads(a), json.loads(b)) for n, (a, b) in enumerate(PAIRS)}
    assert {n: json.dumps(json.loads(j)) for n, j in got.items()} == {n: json.dumps(w) for n, w in want.items()}  # order of keys too
    lonely = trees.merged(side(0).filter("id < 2"), side(1).filter("id > 0 and id < 3"), ["id"], "j")
    assert {r.id: json.loads(r.j) for r in lonely.collect()} == {0: json.loads(PAIRS[0][0]), 1: {"a": 5}, 2: json.loads(PAIRS[2][1])}


def test_images_outer_objects_first(spark):
    text = '{"in":{"logo":"/in.png"},"banner":{"url":"b.jpg","caption":"C","photo":"deep.jpg"},"image":["i.jpg",["no.jpg"],{"url":"data:image/png;base64,x"},"",null]}'
    rows = spark.createDataFrame([(1, text, "http://h.example/d/"), (2, '"image"', "http://h.example/"), (3, None, None), (4, '{"image":"x.jpg"}', None)], "id long, j string, url string")
    got = structured.json_images(rows, ["id"], "j", "url").orderBy("id", "position").collect()
    assert [(r.id, r.position, r.url, r.alt, r.selector) for r in got] == [
        (1, 1, "http://h.example/d/i.jpg", "image", "json_ld.image[]"), (1, 2, "http://h.example/d/b.jpg", "C", "json_ld.banner.url"), (1, 3, "http://h.example/in.png", "logo", "json_ld.logo"), (1, 4, "http://h.example/d/deep.jpg", "photo", "json_ld.photo"),
    ]


@pytest.mark.parametrize(("text", "errors"), [("{}", 3), ('{"extraction":1,"hashApp":{"a":1},"confidence":{"excellent":101,"good":-1,"acceptable":5,"poor":0}}', 2), ('{"extraction":1,"hashApp":0,"confidence":{"excellent":1,"good":1,"acceptable":5,"poor":0},"layers":{"x":{"timeout":"5"},"y":{"timeout":5},"z":{}}}', 2)])
def test_config_errors(spark, text, errors):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "j string").select(structured.config_errors(F.parse_json("j")).alias("e")).first().e
    assert len(got) == errors, got


def test_repeated_sites_are_rows_of_their_own(spark):
    defaults = spark.createDataFrame([('{"a":{"x":1,"y":[1]}}',)], "config string")
    sites = spark.createDataFrame([("s", '{"a":{"x":2}}'), ("s", '{"a":{"y":1.50,"k\\u0041":"\\/"}}'), ("t", None), ("s", '{"a":{"x":2}}')], "site string, config string")
    got = sorted(r.config for r in structured.configurations(defaults, sites).collect())
    assert [json.loads(c) for c in got] == [{"a": {"x": 1, "y": 1.5, "kA": "/"}}, {"a": {"x": 2, "y": [1]}}, {"a": {"x": 2, "y": [1]}}]


def test_any_depth_is_one_pass(spark):
    """No table is written for a level, and a text of 900 levels is read like one of three."""
    rows = spark.createDataFrame([(1, '{"a":[' * 450 + ' "x" ' + "]}" * 450), (2, '[1 , {"b" : "q\\\\\\"]}" } ]')], "id long, j string")
    spark.sparkContext.setJobGroup("trees", "trees")
    try:
        found = trees.nodes(rows, ["id"], "j")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("trees")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = found.select("id", "kind", "raw", "value").selectExpr("id", "kind", "raw", "to_json(value) AS value").collect()
    assert sum(r.id == 1 for r in got) == 901
    assert [(r.kind, r.raw, r.value) for r in got if r.id == 2] == [("list", '[1 , {"b" : "q\\\\\\"]}" } ]', '[1,{"b":"q\\\\\\"]}"}]'), ("value", None, "1"), ("object", '{"b" : "q\\\\\\"]}" }', '{"b":"q\\\\\\"]}"}'), ("value", None, '"q\\\\\\"]}"')]
