"""Plans whose rows cost far more than their bytes: they run in as many tasks as the session asks for, and what a row needs is computed once."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import schemas, validation
from loomery.plans import load_all
from loomery.plans.registry import PLANS

load_all()
HEAVY = ["publish_steps_json", "hash_art_geometry", "manifest_rules_json", "schema_shape_faults", "input_validation", "schema_fields_json", "hash_art_bits", "input_accepted"]


@pytest.mark.parametrize("name", HEAVY)
def test_heavy_rows_are_dealt_out(spark, sf, name):
    assert PLANS[name].plan(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("art,n", [(text.hash_bits, 1), (text.hash_art, 1)])
def test_a_fingerprint_is_hashed_once(spark, art, n):
    df = spark.range(1).select(art(F.md5(F.col("id").cast("string").cast("binary"))).alias("a"))
    assert _optimized(df).count("md5(") == n


def test_odd_fingerprints(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "f"), (3, "f0a"), (4, "0f" * 16)], "i int, h string")
    got = {r.i: r for r in df.select("i", text.hash_bits(F.col("h"), 12).alias("b"), text.hash_art(F.col("h")).alias("a")).collect()}
    assert got[0].b == [None] * 12 and got[3].b == [True] * 4 + [False] * 8
    assert [got[i].a is None for i in range(5)] == [True, True, True, False, False]
    # A short hash starts over: every byte is f0, so the left four of each eight cells are on.
    assert [(d.cx, d.cy) for d in got[3].a.dots[:5]] == [(25, 28), (75, 28), (125, 28), (175, 28), (425, 28)] and len(got[3].a.dots) == 64


def test_many_properties_read_their_texts_once(spark):
    n = 800
    schema = {"type": "object", "properties": {f"p{i}": {"type": "integer", "maximum": 5} for i in range(n)}, "required": ["p1"], "additionalProperties": False}
    df = spark.createDataFrame([(json.dumps(schema), json.dumps({f"p{i}": i for i in range(n)}))] * 4, "s string, g string").repartition(1).cache()
    df.count()
    s, g = F.try_parse_json("s"), F.try_parse_json("g")
    began = time.perf_counter()
    r = df.select(F.size(validation.accepted_input(s, g)).alias("n"), F.size(validation.input_faults(s, g)).alias("bad")).collect()
    assert {(x.n, x.bad) for x in r} == {(n, n - 6)}
    # A loose guard: the old code, which read both texts anew for each property, took 18 s for accepted_input alone in a fresh session.
    assert time.perf_counter() - began < 30


def test_fields_read_the_rows_once(spark):
    schema = {"type": "object", "properties": {"o": {"type": "object", "properties": {"a": {"type": "string", "default": "x"}}, "required": ["a"]}, "b": {"description": "no type"}, "c": {"type": "object"}}, "required": ["o"]}
    df = spark.createDataFrame([(1, json.dumps(schema)), (2, "{}"), (3, None)], "id int, s string")
    out = schemas.fields(df, "id", "s")
    assert _optimized(out).count("LogicalRDD") == 1
    want = [("b", None, False, None, "no type"), ("c", "object", False, None, None), ("o", "object", True, None, None), ("o.a", "string", True, '"x"', None)]
    assert sorted((r.name, r.type, r.required, r.default, r.description) for r in out.collect()) == want
