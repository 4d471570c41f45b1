"""Schemas, inputs and manifests at their edges, and the texts of requests."""

import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from loomery.functions import crypto, text, web
from loomery.operators import manifests, publishing, schemas, validation
from loomery.operators.catalog import search, storefront

SCHEMA = {
    "type": "object",
    "properties": {
        "a": {"type": "string", "enum": ["x", "y"], "minLength": 9}, "u": {"type": "string", "format": "uri", "maxLength": 2}, "m": {"type": "string", "format": "email", "minLength": 50},
        "d": {"type": "string", "format": "date", "maxLength": 4}, "n": {"type": "integer", "minimum": 2, "maximum": 5}, "f": {"type": "boolean", "default": True}, "w": {"type": "string", "minLength": 3},
        "l": {"type": "array", "items": {"type": "number", "maximum": 9}, "minItems": 2, "maxItems": 3}, "e": {"type": "string", "enum": []},
        "o": {"type": "object", "properties": {"p": {"type": "string", "default": "z"}, "q": {"type": "integer"}}, "required": ["q", "p"], "additionalProperties": False},
    },
    "required": ["a", "f", "o"],
    "additionalProperties": False,
}
GOOD = {"a": "x", "o": {"q": 1, "p": "s"}}
INPUTS = [
    (GOOD | {"more": 1}, []),
    (GOOD | {"a": "xy", "u": "nope", "m": "a@b", "d": "12345", "n": 2.5, "f": "t"}, ["a:enum", "d:maxLength", "f:type", "m:email", "n:integer", "u:uri"]),
    (GOOD | {"u": "https://a.example/long", "m": "a.b@c.example", "d": "1234", "n": 5, "f": False, "e": ""}, []),
    (GOOD | {"m": "a..b@c.example", "n": 1, "l": [1]}, ["l:minItems", "m:email", "n:minimum"]),
    (GOOD | {"m": ".a@c.example", "n": 9007199254740993, "l": [1, "x", None, 10]}, ["l:maxItems", "l[1]:type", "l[2]:type", "l[3]:maximum", "m:email", "n:integer"]),
    (GOOD | {"n": 1e3, "l": {}}, ["l:type", "n:maximum"]),
    ({"a": None, "f": None, "n": None, "l": None, "o": None}, ["a:enum", "f:type", "l:type", "n:type", "o:type"]),
    ({"o": {"r": 1, "q": "1"}}, ["a:required", "o.p:required", "o.q:type", "o.r:unknown"]),
    ({}, ["a:required", "o:required"]),
    (GOOD | {"w": "😀"}, ["w:minLength"]), (GOOD | {"w": "😀x"}, []), (GOOD | {"w": "ab"}, ["w:minLength"]),  # UTF-16 units
    ([1], [":type"]), (5, [":type"]), (None, [":type"]),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_inputs(spark):
    df = spark.createDataFrame([(i, json.dumps(SCHEMA), json.dumps(x)) for i, (x, _) in enumerate(INPUTS)] + [(97, json.dumps(SCHEMA), "{x"), (98, json.dumps(SCHEMA), None), (99, None, "{}")], "id int, s string, g string")
    found = validation.checked_inputs(df, "id", "s", "g").groupBy("id").agg(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "rule"))).alias("f"))
    got = {r.id: r.f for r in found.collect()}
    assert got.pop(97) == [":json"]
    assert got == {i: want for i, (_, want) in enumerate(INPUTS) if want}
    taken = {r.id: r.a for r in df.select("id", validation.accepted_input(F.try_parse_json("s"), F.try_parse_json("g")).alias("a")).collect()}
    assert taken[0] == {"a": '"x"', "f": "true", "o": '{"p":"s","q":1}'} and taken[6] == dict.fromkeys("afnlo", "null") and taken[8] == {"f": "true"}


@pytest.mark.parametrize("uri,ok", [("https://a.b", 1), ("http://", 0), ("https://a b", 0), ("mailto:x@y", 1), ("abc", 0), ("//x", 0), ("https://[::1]/", 1), ("http://u@h:80/?q#f", 1), ("https://:80", 0), (" https://x.y/z w ", 1)])
def test_uris(spark, uri, ok):
    assert one(spark, F.lit(uri).rlike(validation.URI)) == bool(ok)


SHAPES = [
    (SCHEMA, ["e:enum"], ["e:enum"]),
    ({"type": "object", "properties": {}, "additionalProperties": False}, [], []),
    ({"type": "object", "properties": {}, "required": "a"}, [":additionalProperties", ":required"], None),
    ({"type": "object", "properties": [], "additionalProperties": True}, [":additionalProperties", ":properties"], None),
    ({"type": "object", "properties": {"a": {"type": "string", "minLength": "3", "maxLength": 0, "format": "ipv4", "default": 1, "description": 5, "minimum": "any"}}, "additionalProperties": False}, ["a:default", "a:description", "a:format", "a:maxLength", "a:minLength"], None),
    ({"type": "object", "properties": {"a": {"type": "array"}, "b": {"type": "array", "items": {"type": "array"}, "minItems": -1, "maxItems": 1.5}, "g": 5, "h": None}, "additionalProperties": False}, ["a:items", "b.items:type", "b:maxItems", "b:minItems", "g:type", "h:type"], None),
    ({"type": "object", "properties": {"c": {"type": "object", "properties": {"d": {"type": "object"}}, "additionalProperties": False}, "e": {"type": "number", "default": "1", "minimum": None}, "f": {"type": "boolean", "default": "no"}}, "additionalProperties": False}, ["c.d:type", "e:default", "e:minimum", "f:default"], None),
    ({"type": "object", "properties": {"r": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "date"}}, "additionalProperties": False}}}, "additionalProperties": False}, ["r.items:type"], ["r.items.x:type"]),
    ({"type": "object", "properties": {"r": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "string"}}}}}, "additionalProperties": False}, ["r.items:type"], ["r.items:additionalProperties"]),
    ({"type": "array"}, [":additionalProperties", ":properties", ":type"], None), (None, [":additionalProperties", ":properties", ":type"], None),
]


def test_shapes(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _, _) in enumerate(SHAPES)], "id int, s string")
    faults = lambda o: F.transform(validation.schema_faults(F.try_parse_json("s"), o), lambda x: F.concat(x["path"], F.lit(":"), x["rule"]))
    for r in df.select("id", faults(False).alias("i"), faults(True).alias("o")).collect():
        _, want, output = SHAPES[r.id]
        assert sorted(r.i) == sorted(want) and sorted(r.o) == sorted(want if output is None else output), SHAPES[r.id][0]


SOUND = {
    "name": "page_reader", "version": "1.2.0", "title": "Page reader", "description": "Reads a page and gives its text.", "category": "content",
    "logo": {"label": "Reader", "svg": "<svg viewBox='0 0 1 1'><path d='M0 0'/></svg>", "sourceUrl": "https://a.example"},
    "seo": {
        "title": "Read any page as plain text", "description": "d" * 80, "intro": "i" * 160, "useCases": [{"title": "Use", "description": "u" * 40}] * 2,
        "faqs": [{"question": "Does it read?", "answer": "a" * 40}] * 2, "keywords": ["read", "page", "text"],
    },
    "creditsEstimate": 2, "inputSchema": {"type": "object", "properties": {"n": {"type": "integer"}}, "additionalProperties": False}, "examples": [{"name": "one", "input": {}}], "entry": "src/index.ts",
}
MANIFESTS = [
    ({}, []), ({"popularity": {"score": True}}, ["popularity"]), ({"popularity": {"rank": 3, "score": -1}}, ["popularity"]), ({"popularity": None}, ["popularity"]), ({"popularity": {"rank": 10_000, "score": 0}}, []),
    ({"popularity": {}}, ["popularity"]), ({"examples": [{"name": "a", "expect": 5}]}, ["examples"]), ({"examples": [{"name": "a", "expect": {"outputMatches": []}}]}, ["examples"]),
    ({"examples": [{"name": "a", "expect": {"outputMatches": {"b": 1}}}]}, []), ({"examples": [{"name": "a", "expect": None}]}, ["examples"]), ({"examples": []}, ["examples"]),
    ({"name": "page_reader\n", "version": "1.2", "entry": "src/a.py"}, ["name", "version", "entry"]), ({"title": 5, "creditsEstimate": 2.5, "maxEngineCalls": 51}, ["title", "creditsEstimate", "maxEngineCalls"]),
    ({"inputSchema": {"type": "object", "properties": {"a": {"type": "string", "minLength": "1"}}, "additionalProperties": False}, "outputSchema": None}, ["inputSchema", "outputSchema"]),
    ({"seo": SOUND["seo"] | {"keywords": ["read", 5, "text"], "faqs": [{"question": "Why?", "answer": "a" * 40}] * 2}}, ["seo.faqs", "seo.keywords"]), ({"logo": SOUND["logo"] | {"sourceUrl": "no url"}}, ["logo.sourceUrl"]),
]


def test_manifests(spark):
    df = spark.createDataFrame([(i, json.dumps(SOUND | x)) for i, (x, _) in enumerate(MANIFESTS)], "id int, m string")
    got = {r.id: r.v for r in df.select("id", manifests.manifest_violations(F.try_parse_json("m")).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MANIFESTS)}
    sent = {"manifest": SOUND, "repo": "acme/page-reader", "channel": "live", "bundle_b64": base64.b64encode(b"bundle").decode(), "bundle_sha256": "0" * 64}
    steps = [(sent, "sha_mismatch"), (sent | {"repo": "acme/tools", "source_dir": "tools/other"}, "name_mismatch"), (sent | {"manifest": SOUND | {"name": "list_tools"}, "repo": "acme/list-tools"}, "reserved_name"), (sent | {"bundle_b64": None}, "bad_payload"), ({"repo": "acme/x", "channel": "delist"}, "ok")]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(steps)], "id int, p string")
    assert {r.id: r.e for r in df.select("id", manifests.publish_error(F.try_parse_json("p"), "acme").alias("e")).collect()} == {i: want for i, (_, want) in enumerate(steps)}


def test_schema_texts(spark):
    shown = lambda s: one(spark, schemas.output_names(F.lit(json.dumps(s))))
    lists = {"type": "object", "properties": {"ok": {"type": "boolean"}, "found": {"type": "array", "items": {"type": "object", "properties": {"z": {}, "a": {}}}}, "more": {"type": "array", "items": {"type": "object", "properties": {"x": {}}}}}}
    assert shown(lists) == ["z", "a"] and shown({"type": "object", "properties": {}}) == []
    value = lambda x: one(spark, schemas.example_value(F.lit(json.dumps(x))))
    assert [value(x) for x in ([{"input": {"max": 3, "q": "cats"}}], [{"input": {"query": 7, "b": "second"}}], [{"input": {"n": 1}}], [], [{"name": "no input"}])] == ["cats", "second", None, None, None]
    fields = lambda b, j=False: one(spark, web.form_fields(F.lit(b), F.lit(j)))
    assert fields("a=1&b=x%20y&a=2") == {"b": "x y", "a": "2"} and fields("") == {} and fields('{"a": "j"}', True) == {"a": "j"} and fields("a=+%2B&&c") == {"a": " +", "c": ""}


def test_request_texts(spark):
    encode = lambda t: one(spark, text.percent_encode(F.lit(t)))
    assert encode("a ~!'()*-_.é+&") == "a%20~!'()*-_.%C3%A9%2B%26"
    put = lambda u, v: one(spark, web.set_query(F.lit(u), "state", F.lit(v).cast("string")))
    assert put("https://h/?state=1", "2 é") == "https://h/?state=2+%C3%A9" and put("https://h/p", "x") == "https://h/p?state=x"
    assert put("https://h/?a=%20&state=1&b&state=3#f", "2") == "https://h/?a=+&state=2&b=#f" and put("https://h/?a=1", "") == put("https://h/?a=1", None) == "https://h/?a=1"
    safe = lambda t: one(spark, publishing.safe_svg(F.lit(t)))
    assert safe("<svg><path/></svg>") and not safe("<svg  onload='x'></svg>") and not safe("<svg>< scripté></svg>") and not safe("<svg éhref =x></svg>") and not safe("<svg>url( x)</svg>")
    signed = lambda i, h: one(spark, crypto.signature_ok("whsec_" + base64.b64encode(b"k").decode(), F.lit(i).cast("string"), F.lit("1"), F.lit("{}"), F.lit(h)))
    import hashlib
    import hmac

    unsigned = base64.b64encode(hmac.new(b"k", b"1.{}", hashlib.sha256).digest()).decode()
    assert signed(None, f"v1,{unsigned}") is False
    hint = web.error_text(F.lit("late"), F.lit(None).cast("string"), {"late": "Try again."})
    assert one(spark, hint) == "late: request failed Try again."


def test_long_runs_of_blanks_are_linear(spark):
    blanks = " \t " * 50_000
    df = spark.createDataFrame([(f"a{blanks}b", f"{blanks}x{blanks}", f"a{' ' * 150_000}b\n" * 3)], "inner string, outer string, lines string").cache()
    began = time.perf_counter()
    r = df.select(text.trim(F.col("inner")).alias("i"), text.trim(F.col("outer")).alias("o"), text.normalize_body(F.col("lines")).alias("l"), text.normalize_body(F.col("inner")).alias("n")).first()
    assert (r.i, r.o) == (f"a{blanks}b", "x") and r.l == "a\n..." and r.n == "a\n..."
    # A search that starts anew at each blank takes minutes.
    assert time.perf_counter() - began < 20


def test_storefront_and_search_terms(spark):
    df = spark.createDataFrame([(i, f"n{i}", "T", "d", "c1" if i < 3 else "c2", None, i, 1.0) for i in range(12)], "id int, name string, title string, description string, category string, featured int, popularity_rank int, popularity_score double")
    sections = lambda rows: sorted((r.id, r.section) for r in rows.collect())
    assert [s for _, s in sections(storefront(df))] == ["popular"] * 6 + ["grid"] * 6 and sections(storefront(df, "c1")) == [(0, "grid"), (1, "grid"), (2, "grid")]
    assert sections(storefront(df, "none")) == sections(storefront(df)) and {s for _, s in sections(storefront(df.limit(8)))} == {"grid"}
    assert [r.id for r in search(df, "﻿n11 ", limit=1).collect()] == [11] and search(df, "n1\x1cn2").count() == 0
