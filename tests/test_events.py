"""Deliveries, codes, quotas, caches, tools, owners, snapshots and cardinality: streams against batch, and plain Python."""

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import captured, cardinality, deliveries, metering, stateful
from loomery.operators.tools import Field, Tool, run_tool, table_function
from loomery.sources import deliveries as source
from loomery.sources import posts
from loomery.sources.snapshots import Snapshot, latest_sink
from loomery.sources.tables import Scope
from loomery.streaming.codes import admit_stream, redeem_stream

KEY = b"key of the tests"
SECRET = "whsec_" + base64.b64encode(KEY).decode()


def delivery(id_, stamp, body, received=1000.0, signed=True):
    text = body if isinstance(body, str) else json.dumps(body)
    mac = base64.b64encode(hmac.new(KEY, f"{id_}.{stamp}.{text}".encode(), hashlib.sha256).digest()).decode()
    return {"id": id_, "timestamp": stamp, "signature": f"v1,{mac}" if signed else "v1,AAAA", "body": text, "received": received}


MAIL = {"type": "mail", "n": 1}
DELIVERIES = [
    (delivery("a", "1000", MAIL), "accepted"), (delivery("b", "1300", MAIL), "accepted"), (delivery("c", "1301", MAIL), "stale_timestamp"), (delivery("d", "now", MAIL), "stale_timestamp"), (delivery("e", "Infinity", MAIL), "stale_timestamp"),
    (delivery("f", "1000", MAIL, signed=False), "bad_signature"), (delivery("g", "1000", {"type": "other"}), "ignored"), (delivery("h", "1000", "[1]"), "bad_body"), (delivery("i", "1000", "{x"), "bad_body"), (delivery("j", "1000", {"n": 1}), "ignored"),
    (delivery("k", "", MAIL), "missing_headers"), (delivery(None, "1000", MAIL), "missing_headers"), (delivery("l", "1000", MAIL) | {"signature": ""}, "missing_headers"), (delivery("m", "1000", MAIL) | {"received": None}, "stale_timestamp"),
    (delivery("a", "1001", MAIL, 1001.0), "accepted"), (delivery("n", "999.5", MAIL), "accepted"),
]


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))


def test_delivery_source_and_guards(spark, tmp_path):
    source.register(spark)
    log = tmp_path / "log"
    rows = [d for d, _ in DELIVERIES]
    write_lines(log, "001.jsonl", [*rows[:5], "\n", "not json\n", "[5]\n"])
    write_lines(log, "002.jsonl", rows[5:9])
    (log / "skipped.txt").write_text("x")
    got = source.judged(spark.read.format("deliveries").load(str(log)), SECRET, "mail").collect()
    assert [(r.file, r.line, r.reason) for r in got if r.file == "001.jsonl"] == [("001.jsonl", i, w) for i, w in enumerate([w for _, w in DELIVERIES[:5]])] + [("001.jsonl", 6, "missing_headers"), ("001.jsonl", 7, "missing_headers")]

    def run(name, frame):
        q = frame.writeStream.option("checkpointLocation", f"{tmp_path}/{name}-cp").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/{name}")
        q.awaitTermination()

    stream = lambda: spark.readStream.format("deliveries").load(str(log))
    for k in (1, 2):
        # The second run starts at the first one's offset.
        run("all", source.judged(stream(), SECRET, "mail"))
        run("once", source.accepted_stream(stream(), SECRET, "mail"))
        if k == 1:
            write_lines(log, "003.jsonl", [*rows[9:], rows[0]])
    all_ = spark.read.parquet(f"{tmp_path}/all").collect()
    assert len(all_) == len(rows) + 3
    want = {(d["id"], d["timestamp"], w) for d, w in DELIVERIES}
    assert {(r.id, r.timestamp, r.reason) for r in all_ if r.id or r.timestamp} == {(i, t, w) for i, t, w in want if i or t}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/once").collect()) == ["a", "b", "n"]
    batch = source.judged(spark.read.format("deliveries").load(str(log)), SECRET, "mail").filter("reason = 'accepted'")
    assert sorted((r.id, r.timestamp) for r in deliveries.first_deliveries(batch, "id", ["received", "file", "line"]).collect()) == [("a", "1000"), ("b", "1300"), ("n", "999.5")]


def challenge(v):
    return base64.urlsafe_b64encode(hashlib.sha256(v.encode()).digest()).decode().rstrip("=")


@pytest.fixture(scope="module")
def codes_and_attempts():
    rnd, codes, attempts = random.Random(9), [], []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k in range(40):
        at = rnd.randrange(0, 3000)
        codes.append((sha(f"c{k}"), at, at + 400, rnd.choice(["x", "y"]), rnd.choice(["r1", None]), challenge(f"v{k}")))
    for i in range(400):
        k = rnd.randrange(45) if i % 3 else 3
        attempts.append((i, rnd.randrange(0, 4000), rnd.choice([f"c{k}"] * 9 + [None, ""]), rnd.choice([f"v{k}", f"v{k}", "bad", ""]), rnd.choice(["x", "x", "y", None]), rnd.choice(["r1", None])))
    return codes, attempts


def plain_redeem(codes, attempts):
    by, used, out = {c[0]: c for c in codes}, set(), {}
    for i, at, code, verifier, client, redirect in sorted(attempts, key=lambda a: (a[1], a[0])):
        if not (code and verifier and client):
            out[i] = "invalid_request"
            continue
        h = hashlib.sha256(code.encode()).hexdigest()
        c = by.get(h)
        if not c or c[1] > at or h in used:
            out[i] = "unknown_or_used"
            continue
        used.add(h)
        out[i] = "expired" if c[2] < at else "other_client" if c[3] != client else "other_redirect" if c[4] != redirect else "pkce_failed" if challenge(verifier) != c[5] else "ok"
    return out


CODES = "code_hash string, issued_at timestamp, expires_at timestamp, client_id string, redirect_uri string, challenge string"
ATTEMPTS = "attempt_id long, at timestamp, code string, verifier string, client_id string, redirect_uri string"


def timed(spark, rows, schema, times):
    """Rows whose time columns are given in seconds."""
    plain = schema.replace("timestamp", "long")
    df = spark.createDataFrame(rows, plain)
    return df.withColumns({c: F.timestamp_seconds(c) for c in times})


def test_codes_are_redeemed_once(spark, codes_and_attempts, tmp_path):
    codes, attempts = codes_and_attempts
    c, a = timed(spark, codes, CODES, ["issued_at", "expires_at"]), timed(spark, attempts, ATTEMPTS, ["at"])
    want = plain_redeem(codes, attempts)
    assert len(set(want.values())) == 7
    assert {r.attempt_id: r.verdict for r in deliveries.redeem_codes(c, a).collect()} == want
    for name, edges in (("few", [0, 5000]), ("many", [0, 900, 901, 2500, 5000])):
        folder = f"{tmp_path}/{name}"
        for lo, hi in zip(edges, edges[1:], strict=False):
            within = lambda col, lo=lo, hi=hi: (F.unix_seconds(col) >= lo) & (F.unix_seconds(col) < hi)
            c.filter(within("issued_at")).coalesce(1).write.mode("append").parquet(f"{folder}/codes")
            a.filter(within("at")).coalesce(1).write.mode("append").parquet(f"{folder}/attempts")
            in_codes, in_attempts = (spark.readStream.schema(s).parquet(f"{folder}/{p}") for s, p in ((CODES, "codes"), (ATTEMPTS, "attempts")))
            q = redeem_stream(in_codes, in_attempts).writeStream.option("checkpointLocation", f"{folder}/cp").format("parquet").trigger(availableNow=True).start(f"{folder}/out")
            q.awaitTermination()
        assert {r.attempt_id: r.verdict for r in spark.read.parquet(f"{folder}/out").collect()} == want, name


def test_quota_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    day = 86_400
    rows = sorted({(rnd.randrange(0, 100 * day)) for _ in range(500)})
    events = [(i, rnd.randrange(4), t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(events, "id long, user long, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    batch = metering.admit(df.withColumn("month", F.date_trunc("MONTH", "at")), 20, ["user", "month"], ["at", "id"], F.to_date("at"))
    want = {r.id: (r.call, r.admitted) for r in batch.collect()}
    for name, edges in (("one", [0, 500]), ("cut", [0, 3, 4, 100, 333, 500])):
        for lo, hi in zip(edges, edges[1:], strict=False):
            df.filter((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}/in")
            q = admit_stream(stream, 20, "user", "at", "id").writeStream.option("checkpointLocation", f"{tmp_path}/{name}/cp").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/{name}/out")
            q.awaitTermination()
        assert {r.id: (r.call, r.admitted) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()} == want, name
        # Counters of months that the watermark has passed are gone.
        kept = spark.read.format("statestore").option("stateVarName", "calls").load(f"{tmp_path}/{name}/cp").count()
        assert kept <= 8


def test_cache_log(spark):
    rnd, rows = random.Random(1), []
    for i in range(3000):
        t = rnd.randrange(0, 40_000)
        rows.append((i, 0 if i % 3 else rnd.randrange(20), t, t + rnd.randrange(0, 60), rnd.choice([0, 5, 50, 500, None])))
    df = spark.createDataFrame(rows, "id long, key int, a long, b long, ttl long").withColumns({c: F.timestamp_seconds(c) for c in "ab"}).repartition(7)
    want, last = {}, {}
    for i, k, a, b, ttl in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if not ttl:
            want[i] = "bypass"
        elif k in last and a < last[k]:
            want[i] = "coalesced"
        elif k in last and a - last[k] < ttl:
            want[i] = "hit"
        else:
            want[i], last[k] = "miss", b
    got = {r.id: r.status for r in stateful.cache_log(df, ["key"], "a", "b", "id", F.col("ttl") * 1_000_000).collect()}
    assert got == want and set(want.values()) == {"bypass", "coalesced", "hit", "miss"}
    assert stateful.cache_log(df.limit(0), ["key"], "a", "b", "id", F.col("ttl")).count() == 0


def test_tools(spark):
    def run(price: float, size: int, note: str | None):
        if size == 3:
            raise ValueError("three")
        return [{"total": price * size, "label": note or "none"}] * (size % 3)

    tool = Tool("t", run, {"price": Field("number", 0, 100), "size": Field("integer", 1, 9, default=2), "note": Field("string", choices=("a", "b"), needed=False)}, {"total": Field("number"), "label": Field("string", high=5)})
    rows = [(1, 5.0, 2, None), (2, None, 1, None), (3, 5.0, 3, "a"), (4, 101.0, 10, "c"), (5, 1.0, None, "b"), (6, float("nan"), 1, "a"), (7, 1.0, 6, "a")]
    df = spark.createDataFrame(rows, "id int, price double, size long, note string")
    got = run_tool(df, tool)
    assert got.columns == ["id", "ok", "error", "message", "total", "label"]
    found = {r.id: (r.error, r.message) for r in got.filter("not ok").collect()}
    assert found == {2: ("invalid_input", "price is required"), 3: ("tool_failed", "ValueError: three"), 4: ("invalid_input", "price is out of bounds; size is out of bounds; note is none of its choices"), 6: ("invalid_input", "price is no number")}
    assert [tuple(r) for r in got.filter("ok").groupBy("id", "total", "label").count().orderBy("id").collect()] == [(1, 10.0, "none", 2), (5, 2.0, "b", 2)]
    bad = Tool("bad", lambda x: {"y": "s"}, {"x": Field("integer")}, {"y": Field("integer")})
    assert {r.error for r in run_tool(spark.range(3).withColumnRenamed("id", "x"), bad).collect()} == {"bad_output"}
    spark.udtf.register("apply_tool", table_function([tool, bad]))
    df.createOrReplaceTempView("tool_rows")
    assert spark.sql("SELECT count_if(ok) AS n FROM apply_tool(TABLE(tool_rows), 't')").first().n == 4
    for sql in ("SELECT * FROM apply_tool(TABLE(tool_rows), 'none')", "SELECT * FROM apply_tool(TABLE(tool_rows), 'bad')"):
        with pytest.raises(Exception, match="no such tool|lacks x"):
            spark.sql(sql)
    with pytest.raises(ValueError):
        Tool("t", run, {"ok": Field("number")}, {})


def test_owner_scope(spark, sf):
    scope = Scope(spark, sf, 5)
    for table in ("customer", "orders", "events"):
        plan = scope.table(table)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(" in plan and ",5)]" in plan.replace(" ", ""), plan
    assert {r.o_custkey for r in scope.table("orders").collect()} == {5}
    own = {r.o_orderkey for r in scope.table("orders").collect()}
    assert {r.l_orderkey for r in scope.table("lineitem").collect()} <= own and scope.table("nation").count() == 25
    with pytest.raises(PermissionError):
        scope.table("labels")
    with pytest.raises(ValueError):
        Scope(spark, sf, None)


def test_cardinality(spark):
    n = lambda k: spark.range(k).select("id", (F.col("id") * 2).alias("x y"))
    assert [tuple(r) for r in cardinality.exactly_one(n(1)).collect()] == [(0, 0)] and cardinality.maybe_one(n(0)).collect() == [] and cardinality.maybe_one(n(1)).count() == 1
    for breach in (cardinality.exactly_one(n(0)), cardinality.exactly_one(n(2)), cardinality.maybe_one(n(9))):
        with pytest.raises(Exception, match="row for the query"):
            breach.collect()
    parents, rows = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (3, "c"), (3, "d")], "k int, v string")
    # A key that no parent asks for may have more.
    assert sorted(map(tuple, cardinality.one_for_each(parents, rows, ["k"]).collect()), key=str) == [(1, "a"), (2, None), (2, None)]
    with pytest.raises(Exception, match="no row for 2"):
        cardinality.one_for_each(parents, rows, ["k"], need=True).collect()
    with pytest.raises(Exception, match="more than one row for 1"):
        cardinality.one_for_each(parents, rows.union(rows), ["k"]).count()


def test_snapshots_rewrite_only_what_changed(spark, tmp_path):
    table = Snapshot(spark, f"file://{tmp_path}/t", "k long, v string, n long", ["k"], buckets=8)
    assert table.read().count() == 0
    start = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(0).cast("long").alias("n"))
    assert table.upsert(start) == 0
    before = table._log()
    assert table.upsert(spark.createDataFrame([(3, "b"), (500, "c")], "k long, v string")) == 1
    after = table._log()
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2 and len(after) == 8
    rows = {r.k: (r.v, r.n) for r in table.read().collect()}
    assert len(rows) == 201 and rows[3] == ("b", 0) and rows[500] == ("c", None) and {r.v for r in table.read(0).collect()} == {"a"}
    # A repeated number changes nothing; another goes on from there.
    assert table.delete(spark.range(100).select(F.col("id").alias("k")), number=5) == 5 and table.delete(spark.range(200).select(F.col("id").alias("k")), number=5) == 5
    assert {r.k for r in table.read().collect()} == {*range(100, 200), 500}
    assert table.delete(spark.createDataFrame([(500,)], "k long")) == 6 and table.delete(spark.range(0).select(F.col("id").alias("k"))) == 7 and table.read().count() == 100
    table.clean(keep=1)
    assert table.versions() == [7] and table.read().count() == 100
    with pytest.raises(ValueError):
        Snapshot(spark, f"file://{tmp_path}/t", "k long, v string, n long", ["k"], buckets=4).read()
    late = Snapshot(spark, f"file://{tmp_path}/late", "k long, v string, n long", ["k"], buckets=4)
    sink = latest_sink(late, ["n"])
    batches = [[(1, "x", 5), (2, "y", 1)], [(1, "old", 3), (3, "z", 9)], [(2, "new", 2)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            sink(spark.createDataFrame(rows, "k long, v string, n long"), number)
    assert sorted(map(tuple, late.read().collect())) == [(1, "x", 5), (2, "new", 2), (3, "z", 9)]


def test_bytes_of_values(spark):
    values = ["aé日😀z".encode(), b"\xff\xfe\x00ab", b"", "😀😀".encode(), b"abc\xe6"]
    df = spark.createDataFrame([(values,)], "v array<binary>")
    for most in range(0, 14):
        got = df.select(captured.bounded_values(F.col("v"), 9, most).alias("x")).first().x
        for v, r in zip(values, got, strict=True):
            try:
                v.decode()
                want = v[:most].decode(errors="ignore"), None
            except UnicodeDecodeError:
                want = None, base64.b64encode(v[:most]).decode()
            assert (r.value, r.value_base64, r.bytes, r.truncated) == (*want, len(v), len(v) > most), (most, v)


def test_headed_files(spark, tmp_path):
    posts.register(spark)
    files = {"a.md": "---\ntitle: 'A b'\ndate: 2024-01-02\n---\nbody\n", "b.md": "---\r\ntitle: B\r\nextra: x: y\r\n# c\r\n---\r\nx", "c.md": "no header", "d.md": "---\nbad\n---\n", "e.md": "---\ntitle: 1\ntitle: 2\nlate: z\n---", "f.txt": "---\na: b\n---\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = spark.read.format("headed").option("sampled", 2).option("filesPerPartition", 2).load(str(tmp_path))
    assert got.columns == ["file", "hash", "title", "date", "extra", "others", "body"] and got.rdd.getNumPartitions() == 3
    rows = {r.file: r for r in got.collect()}
    assert {k: (r.title, r.date, r.extra, r.others, r.body) for k, r in rows.items()} == {"a.md": ("A b", "2024-01-02", None, {}, "body\n"), "b.md": ("B", None, "x: y", {}, "x"), "e.md": ("2", None, None, {"late": "z"}, "")}
    assert rows["a.md"].hash == hashlib.sha256(files["a.md"].encode()).hexdigest()
    # The same fields as the column form finds.
    column = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), posts.frontmatter(F.col("value")).alias("f")).filter("f is not null")
    assert {r.file: (dict(r.f.data), r.f.body) for r in column.collect()} == {n: posts.parse_headed(files[n].encode()) for n in rows}


def test_live_tools_and_reports(spark):
    from loomery.operators import catalog

    tools = spark.createDataFrame([(1, "a", "live", 10, None), (2, "b", "live", 11, 1), (3, "c", "off", 10, 2), (4, "d", "live", None, 1), (5, "e", "live", 99, 1)], "id int, name string, status string, live_version_id int, featured int").withColumn("popularity_rank", F.lit(None).cast("int")).withColumn("popularity_score", F.lit(1.0))
    versions = spark.createDataFrame([(10, "x", "V"), (11, "y", "V")], "id int, entry string, name string")
    assert [(r.id, r.name, r.entry, r.place) for r in catalog.live_tools(tools, versions).orderBy("place").collect()] == [(2, "b", "y", 1), (1, "a", "x", 2)]


def test_look_ups(spark):
    from loomery.operators import accounts

    tools = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "b", 8)], "id int, name string, user_id int")
    assert [r.id for r in accounts.tool_by_name(tools, "a").collect()] == [1] and accounts.tool_by_name(tools, "none").collect() == []
    assert accounts.version_by_id(tools, 2).first().name == "b" and accounts.key_by_id(tools, 3, 7).collect() == [] and accounts.key_by_id(tools, 3, 8).count() == 1
    for breach, message in ((accounts.tool_by_name(tools, "b"), "more than one row for tool b"), (accounts.version_by_id(tools, 9), "no row for version 9")):
        with pytest.raises(Exception, match=message):
            breach.collect()
    got = accounts.tagged(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, tag string"), F.col("tag"), {"x": F.lit("done")}).collect()
    assert [(r.id, r.handled, r.outcome) for r in got] == [(1, True, "done"), (2, False, None), (3, False, None)]
