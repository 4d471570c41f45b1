"""Boundary rows, properties, and stream against batch."""

import base64
import datetime
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import crypto, text
from loomery.operators import catalog, metering, publishing, stateful
from loomery.sources.posts import read_posts, write_listing, write_once
from loomery.streaming.limits import keep_latest, rate_limit_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_alert_thresholds(spark):
    rows = [(c, 100, a, b) for c in (79, 80, 99, 100, 150) for a in (False, True) for b in (False, True)]
    df = spark.createDataFrame(rows, "calls int, quota int, n80 boolean, n100 boolean").withColumn("s", metering.alert_state(F.col("calls"), F.col("quota"), F.col("n80"), F.col("n100")))
    for r in df.collect():
        want = "cap" if r.calls >= 100 and not r.n100 else "nudge" if 80 <= r.calls < 100 and not r.n80 else None
        assert r.s == want


def test_ranking_scales(spark):
    df = spark.createDataFrame([(1, "b", 5, None, 1.0), (2, "a", None, 1, 1.0), (3, "c", None, None, 9.0), (4, "d", None, None, None), (5, "a2", None, 1, 1.0)], "id int, title string, featured int, popularity_rank int, popularity_score double").withColumn("name", F.col("title"))
    assert [r.id for r in df.orderBy(*catalog.merged_rank()).collect()] == [2, 5, 1, 3, 4]
    assert [r.id for r in df.orderBy(*catalog.stored_order()).collect()] == [1, 2, 5, 3, 4]


def test_text_edges(spark):
    lit = F.lit
    assert one(spark, text.html_to_text(lit("a<br>b<br/>c</P>&amp;lt;&NBSP;&#39;"))) == "a\nb c\n< '"
    assert one(spark, text.normalize_body(lit("a \r\n\r\n\r\n\r\nb```  "))) == "a\n\nb'''"
    assert one(spark, text.normalize_body(lit("  \n"))) is None
    assert one(spark, F.length(text.normalize_body(lit("x" * 3000)))) == 3000 and one(spark, text.normalize_body(lit("x" * 3001))).endswith("x\n...")
    assert one(spark, text.body_of(lit(None).cast("string"), lit("<p></p>"), lit("preview"))) is None
    for raw, ok in (("no header", False), ("---\r\na: 1\r\n---\r\nbody", True), ("---\nbad\n---\n", False), ("---\n# c\n\na: \"x\"\na: 2\n---\nb", True)):
        assert (one(spark, text.frontmatter(lit(raw))) is not None) == ok, raw
    assert one(spark, text.frontmatter(lit("---\na: 1\na: 'x y'\n---\nb\n"))).data == {"a": "x y"}
    assert one(spark, text.json_or_text(lit("null"), lit("t"))) == "t" and one(spark, text.json_or_text(lit('{"a": 1}'), lit("t"))) == '{"a":1}'
    for uri, ok in (("https://a.b/c", True), ("https://a.b/#f", False), ("http://localhost:3/x", True), ("http://a.b", False), ("nonsense", False), ("http://127.0.0.1/", True), (None, False), ("http://evil.com\\@localhost/", False), ("https://a b/", False), ("http://localhost@evil.com/", False), ("HTTP://u:p@LocalHost:8080", True), ("https://a.b/#", True), ("https://a.b\n", False), ("https:///x", False), ("https://[::1]/x", True)):
        assert one(spark, text.allowed_redirect(lit(uri).cast("string"))) == ok, uri


def test_boundaries_of_texts(spark):
    lit = F.lit
    assert one(spark, text.trim(lit("\u0085\ufeff\u00a0 x \u3000\u0085"))) == "\u0085\ufeff\u00a0 x \u3000\u0085"
    assert one(spark, text.trim(lit("\ufeff\u00a0\u2028 x \u3000\n"))) == "x"
    for pattern, sound in ((publishing.NAME, "good_name"), (publishing.VERSION, "1.0.0"), (publishing.CATEGORY, "a-b"), (publishing.ENTRY, "src/a.ts"), (publishing.SLUG, "a-b"), (publishing.DATE, "2024-01-01"), (publishing.SHA256, "0" * 64), (publishing.UUID, "A" * 36)):
        assert one(spark, lit(sound).rlike(pattern)) and not one(spark, lit(sound + "\n").rlike(pattern)), pattern
    assert one(spark, text.json_text(lit(' {"b": 1, "a": {"z": [1, 2], "y": null}}'))) == '{"b":1,"a":{"z":[1,2],"y":null}}'
    assert [one(spark, text.json_text(lit(x))) for x in ('"s"', "5", "null", "{x", "[]")] == ['"s"', "5", "null", None, "[]"]
    pick = lambda j: one(spark, text.pick_string([F.try_parse_json(lit(j))], ("text", "body")))
    assert [pick(j) for j in ('{"text": 5}', '{"text": {"a": 1}, "body": "b"}', '{"text": " ", "body": ["x"]}', '{"body": "5"}', "[]", "x")] == [None, "b", None, "5", None, None]
    mail = lambda j: one(spark, text.mail_body(F.try_parse_json(lit(j))))
    assert mail('{"data": "{\\"text\\": \\"no\\"}", "content": {"raw_html": "<b>x</b>"}}') == "x"
    numbers = {"NaN": None, "1d": None, " 1.5 ": 1.5, "": None, "  ": None, "0x1F": 31.0, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "-Infinity": float("-inf"), "1 2": None, "+7": 7.0, "1f": None}
    assert {k: one(spark, publishing.number_of(lit(k))) for k in numbers} == numbers
    typed = lambda v, k, i="string": one(spark, publishing.coerce(lit(v), lit(k), lit(i))).asDict()
    set_ = lambda v, k, i="string": {n: x for n, x in typed(v, k, i).items() if x is not None}
    assert set_(" a ", "string") == {"as_string": "a"} and set_("  ", "string") == {} and set_("x", "integer") == {} and set_("no", "boolean") == {"as_boolean": False}
    assert set_("1\n x\n\n2 ", "array", "number") == {"as_numbers": [1.0, 2.0]} and set_("true\nno", "array", "boolean") == {"as_booleans": [True, False]} and set_(" \n", "array") == {}
    assert one(spark, publishing.semver(lit("1.99999999999.3"))) == [1, 99999999999, 3]


def test_titles_in_locale_order(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["b", "a", "B", "A", "á", "Z", "c"])], "id int, title string, featured int, popularity_rank int, popularity_score double")
    assert [r.title for r in df.orderBy(*catalog.merged_rank()).collect()] == ["a", "A", "á", "b", "B", "c", "Z"]
    fields = F.array(*[F.lit(x) for x in ("zeta", "Beta", "alpha", "name")])
    assert one(spark, publishing.leading_fields(fields)) == ["name", "alpha", "Beta", "zeta"]


def test_cancel_clears_the_subscription(spark):
    row = "customer_id long, user_id long, tier string, status string, quota int, idle_days int, period_start timestamp_ntz, period_end timestamp_ntz, subscription_id string, session_limit int"
    at = datetime.datetime(2024, 1, 1)
    current = spark.createDataFrame([(1, 10, "pro", "active", 100_000, 7, at, at, "s1", 50), (2, 20, "internal", "active", 1, 1, at, at, "s2", 9), (3, 30, "free", "active", 50, 7, None, None, None, 1)], row)
    changes = spark.createDataFrame([(1, "canceled", None, None, at, at, "s1"), (2, "canceled", None, None, at, at, "s2"), (3, "active", "scale", None, at, at, "s3")], "customer_id long, status string, tier string, user_id long, period_start timestamp_ntz, period_end timestamp_ntz, subscription_id string")
    got = {r.customer_id: (r.tier, r.period_end, r.subscription_id, r.session_limit) for r in stateful.apply_subscription_changes(current, changes).collect()}
    assert got == {1: ("free", None, None, 1), 2: ("internal", at, "s2", 9), 3: ("scale", at, "s3", 250)}


def test_a_key_of_most_rows(spark):
    rnd = random.Random(3)
    rows = [(0 if k % 10 else k, rnd.randrange(5_000_000), k) for k in range(30_000)]
    df = spark.createDataFrame(rows, "user int, us long, id int")
    got = {r.user: (r.accepted, r.rejected) for r in stateful.rate_limit(df, "user", "us", "id", 5, 1000).collect()}
    own = plain_limit([t for u, t, i in sorted(rows, key=lambda r: r[1:]) if u == 0], 5, 1000)
    assert got[0] == (sum(own), len(own) - sum(own)) and len(got) == 3000
    calls = metering.admit(df, 100, ["user"], ["us", "id"], F.floor(F.col("us") / 100_000)).filter("user = 0").orderBy("us", "id").collect()
    assert [r.call for r in calls] == list(range(1, len(own) + 1)) and sum(r.admitted for r in calls) == 100
    assert metering.admit(df.limit(0), 1, ["user"], ["us"], F.col("us")).count() == 0 and stateful.rate_limit(df.limit(0), "user", "us", "id", 1, 1).count() == 0


def test_publish_versions(spark):
    v = lambda old, h, new, s: one(spark, publishing.publish_verdict(F.lit(old).cast("string"), F.lit(h).cast("string"), F.lit(new), F.lit(s)))
    assert [v(None, None, "1.0.0", "a"), v("1.9.9", "a", "1.10.0", "b"), v("1.10.0", "a", "1.9.9", "a"), v("1.0.0", "a", "1.0.0", "a"), v("1.0.0", "a", "1.0.0", "b")] == ["created", "updated", "version_not_newer", "unchanged", "version_exists"]


def test_signatures(spark):
    key = b"secret key"
    secret = "whsec_" + base64.b64encode(key).decode()
    sig = base64.b64encode(hmac.new(key, b"id.1700000000.{}", hashlib.sha256).digest()).decode()
    ok = lambda h: one(spark, crypto.signature_ok(secret, F.lit("id"), F.lit("1700000000"), F.lit("{}"), F.lit(h).cast("string")))
    assert ok(f"v1,bad v1,{sig}") and not ok("v1,bad") and not ok("") and not ok(None)
    assert one(spark, F.hex(crypto.hmac_sha256(F.lit("m"), b"k" * 100))).lower() == hmac.new(b"k" * 100, b"m", hashlib.sha256).hexdigest()
    assert one(spark, crypto.fresh(F.lit(1300), F.lit(1000))) and not one(spark, crypto.fresh(F.lit(1301), F.lit(1000)))
    k = F.lit("0123456789abcdef0123456789abcdef")
    assert one(spark, crypto.unseal(crypto.seal(F.lit("héllo"), k), k)) == "héllo"
    assert one(spark, text.sha256_base64url(F.lit("dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"))) == "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, x string")
    once = stateful.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, stateful.upsert(once, new, ["id"]).collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]


def plain_limit(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if t - x < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


@pytest.fixture(scope="module")
def bursts(spark):
    rnd, rows = random.Random(5), []
    for user in range(6):
        t = 0
        for i in range(40):
            t += rnd.choice([0, 1, 1, 5, 60])
            rows.append((user, t, user * 1000 + i))
    return rows


def test_rate_limit_fold(spark, bursts):
    df = spark.createDataFrame(bursts, "user int, us long, id int").repartition(4)
    got = {r.user: (r.accepted, r.rejected) for r in stateful.rate_limit(df, "user", "us", "id", 10, 60).collect()}
    for user in range(6):
        ok = plain_limit([t for u, t, _ in bursts if u == user], 10, 60)
        assert got[user] == (sum(ok), len(ok) - sum(ok))


def test_streams_equal_batch(spark, bursts, tmp_path):
    for k in range(3):
        spark.createDataFrame([r for r in bursts if r[2] % 1000 * 3 // 40 == k], "user int, us long, id int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("user int, us long, id int").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        for name, df in (("limit", rate_limit_stream(stream, "user", "us", "id", 10, 60)), ("cdc", stream)):
            w = df.writeStream.option("checkpointLocation", f"{tmp_path}/cp/{name}").trigger(availableNow=True)
            q = w.format("parquet").start(f"{tmp_path}/out") if name == "limit" else w.foreachBatch(keep_latest(f"{tmp_path}/state", ["user"], ["us", "id"])).start()
            q.awaitTermination()
    got = {r.id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for user in range(6):
        own = [(t, i) for u, t, i in bursts if u == user]
        assert [got[i] for _, i in own] == plain_limit([t for t, _ in own], 10, 60)
    last = spark.read.parquet(f"{tmp_path}/state/2").collect()
    assert {(r.user, r.us, r.id) for r in last} == {max((x for x in bursts if x[0] == u), key=lambda x: (x[1], x[2])) for u in range(6)}


def test_sources_and_sinks(spark, tmp_path):
    posts = tmp_path / "posts"
    posts.mkdir()
    (posts / "2024-01-02-first.md").write_text("---\ntitle: A\ndescription: d\ndate: 2024-01-02\n---\nbody\n")
    (posts / "b.md").write_text("---\r\ntitle: B\r\ndescription: d\r\ndate: 2024-02-02\r\nslug: own\r\n---\r\nx")
    (posts / "c.md").write_text("---\ntitle: C\ndescription: d\ndate: 2024-03-02\npublished: false\n---\nx")
    (posts / "d.md").write_text("no header")
    (posts / "e.txt").write_text("---\ntitle: E\n---\n")
    assert [(r.slug, r.title) for r in read_posts(spark, str(posts)).collect()] == [("own", "B"), ("first", "A")]
    blobs = spark.createDataFrame([("k1", "x"), ("k2", "y")], "sha string, data string")
    for rows in (blobs, blobs.withColumn("data", F.lit("changed")), spark.createDataFrame([("k3", "z")], "sha string, data string")):
        write_once(rows, f"{tmp_path}/blobs", "sha")
    assert sorted((r.sha, r.data) for r in spark.read.parquet(f"{tmp_path}/blobs").collect()) == [("k1", "x"), ("k2", "y"), ("k3", "z")]
    write_listing(spark.createDataFrame([("b", "n2", "T2"), ("a", "n1", "T1")], "category string, name string, title string"), f"{tmp_path}/list")
    assert {r.value for r in spark.read.text(f"{tmp_path}/list").collect()} == {"## a", "- T1", "## b", "- T2"}


#: Plans whose operator is a fold, or user code: Python by their nature.
PYTHON = {"rate_limit_fold", "cache_status_log", "cache_coalesced", "tool_results"}


def test_plans_have_no_products_and_python_only_where_said(spark, sf):
    from loomery.plans import load_all
    from loomery.plans.registry import PLANS

    load_all()
    for e in PLANS.values():
        plan = e.plan(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, e.name
        assert (e.name in PYTHON) == any(x in plan for x in ("Python", "InArrow", "InPandas")), e.name


def test_places_of_a_hot_category(spark):
    rnd = random.Random(4)
    rows = [(k, f"n{rnd.randrange(50)}", rnd.choice(["a", "B", "á"]), "hot" if k % 5 else f"c{k % 3}", None if k % 3 else k % 4, None if k % 7 else k % 9, rnd.choice([None, 0.0, -2.5, 1.0, 1e9, 1.0001, rnd.random()])) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, name string, title string, category string, featured int, popularity_rank int, popularity_score double").repartition(5)
    assert [r.id for r in catalog.placed(df).orderBy("place").collect()] == [r.id for r in df.orderBy(*catalog.stored_order()).collect()]
    got = {r.id: r.place for r in catalog.categories(df).collect()}
    want = {r.id: r.p for r in df.withColumn("p", F.row_number().over(catalog.Window.partitionBy("category").orderBy(*catalog.merged_rank()))).collect()}
    assert got == want and catalog.placed(df.limit(0)).count() == 0


def test_first_attempts(spark):
    rows = [(i, i % 3 if i % 4 else 0, (i * 7) % 11, float(i)) for i in range(60)] + [(99, None, 1, 0.0)]
    df = spark.createDataFrame(rows, "id int, code int, at int, value double")
    plain, numbered = (stateful.redeem_once(df, "code", ["at", "id"], F.col("value") < 30, n) for n in (False, True))
    assert {r.id: r.verdict for r in plain.collect()} == {r.id: r.verdict for r in numbered.collect()}


def test_art_of_short_hashes(spark):
    assert one(spark, text.hash_art(F.lit(""))) is None and one(spark, text.hash_art(F.lit("f"))) is None
    art = one(spark, text.hash_art(F.lit("ff")))
    assert len(art.dots) == 128 and len(art.blobs) == 3 and {(b.r, b.color) for b in art.blobs} == {(225, 7), (225, 0), (225, 1)}
