"""Text, HTML and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import captured as K
from ..sources.tables import read, spread
from .registry import query


def _html_sql(c: str) -> str:
    for pattern, to, flag in (
        ("<style.*?</style>", " ", "gis"), ("<script.*?</script>", " ", "gis"), ("<(br|/p|/div|/li)>", "\n", "gi"), ("<[^>]+>", " ", "gs"), ("&nbsp;", " ", "gi"),
        ("&amp;", "&", "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi"), ("&quot;", '"', "gi"), ("&#39;", "''", "gi"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', '{flag}')"
    return c


_WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _body_sql(c: str, most: int = 3000) -> str:
    for pattern, to in ((r"\r\n", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    t = f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    return f"(SELECT nullif(replace(CASE WHEN length(t) > {most} THEN regexp_replace(left(t, {most}), '{_WS}+$', '') || chr(10) || '...' ELSE t END, '```', ''''''''), '') FROM (SELECT {t} AS t))"


@query("html_to_text", f"SELECT page_id, {_html_sql('html')} AS body FROM pages")
def html_to_text(spark, d):
    """Markup, scripts and styles out, entities decoded."""
    return read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))


@query("body_normalize", f"SELECT doc_id, {_body_sql('text')} AS body FROM documents")
def body_normalize(spark, d):
    """Line ends, blank lines, trimming, clipping at 3000."""
    return read(spark, d, "documents").select("doc_id", T.normalize_body(F.col("text")).alias("body"))


@query("body_preview", "SELECT doc_id, left(text, 400) AS preview, length(text) > 400 AS preview_truncated, CASE WHEN length(text) > 48 THEN left(text, 47) || '…' ELSE text END AS chip FROM documents")
def body_preview(spark, d):
    """Cut texts with flags, and the chip form."""
    cut, flag = T.truncated(F.col("text"), 400)
    return read(spark, d, "documents").select("doc_id", cut.alias("preview"), flag.alias("preview_truncated"), F.when(F.length("text") > 48, F.concat(F.left("text", F.lit(47)), F.lit("…"))).otherwise(F.col("text")).alias("chip"))


@query("fetch_result_projection", "SELECT page_id, url, left(html, 60000) AS html, length(html) > 60000 AS html_truncated, octet_length(encode(html))::INT AS body_bytes FROM pages")
def fetch_result_projection(spark, d):
    """Captured pages in the shape of a fetch result."""
    return K.fetch_result(read(spark, d, "pages"))


_JSON = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{broken' WHEN 2 THEN 'null' ELSE 'text' END"


def _json():
    k = F.col("event_id") % 4
    return F.when(k == 0, F.col("props")).when(k == 1, "{broken").when(k == 2, "null").otherwise("text")


@query("json_result_projection", f"SELECT event_id, json_valid(b) AS json_parse_ok, CASE WHEN json_valid(b) THEN json(b)::VARCHAR END AS json, CASE WHEN NOT json_valid(b) THEN b END AS body_text FROM (SELECT event_id, {_JSON} AS b FROM events)")
def json_result_projection(spark, d):
    """JSON bodies parsed, others as text."""
    return K.json_result(read(spark, d, "events").select("event_id", _json().alias("body")), "body").select("event_id", "json_parse_ok", "json", "body_text")


_GET = "CASE WHEN event_id % 4 = 0 THEN json(props)::VARCHAR ELSE event_type || repeat('x', 20) END"


@query("network_calls_projection", f"SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, list({{'method': 'GET', 'url': '/' || event_type, 'status': 200 + event_id % 2, 'body': left({_GET}, 4000), 'body_truncated': length({_GET}) > 4000}} ORDER BY event_id)[1:500] AS calls FROM events GROUP BY ALL")
def network_calls_projection(spark, d):
    """A session's first 500 network calls with bodies: the JSON value, else the text."""
    e = read(spark, d, "events")
    call = F.struct("event_id", F.lit("GET").alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("url"), (200 + F.col("event_id") % 2).alias("status"), _json().alias("json"), F.concat("event_type", F.lit("x" * 20)).alias("body_text"))
    e = K.first_events(e.withColumn("day", F.date_trunc("DAY", "ts").cast("timestamp_ntz")), ["user_id", "day"], ["event_id"], 500)
    kept = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(call)).alias("c"))
    return kept.select("user_id", "day", K.network_calls(F.transform("c", lambda x: x.withField("json", F.when(x["json"] != "text", x["json"]))), True).alias("calls"))


@query("stream_values_projection", "SELECT conv_id, list_transform(v[1:100], lambda t: {'value': left(t, 4000), 'truncated': length(t) > 4000}) AS values_ FROM (SELECT conv_id, list(text ORDER BY turn, text) AS v FROM conversations GROUP BY conv_id)")
def stream_values_projection(spark, d):
    """The first hundred values of each stream, cut at 4,000 characters. A stream's later values are ranked out before any are gathered."""
    first = K.first_events(read(spark, d, "conversations"), ["conv_id"], ["turn", "text"], 100)
    c = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("v"))
    return c.select("conv_id", K.stream_values(F.col("v"), 100, 4000).alias("values_"))


# Each page as one of six events: values that aren't strings, blank ones and markup alone are passed over.
@query(
    "first_nonblank_body",
    f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN {_body_sql("html")} WHEN 1 THEN {_body_sql(_html_sql("html"))} WHEN 2 THEN NULL WHEN 3 THEN {_body_sql("url")} WHEN 4 THEN {_body_sql("html")} END AS body FROM pages""",
)
def first_nonblank_body(spark, d):
    """The body of each mail event: text, else HTML as text, else the preview, from the event and its nested objects."""
    k, html, url = F.col("page_id") % 6, F.col("html"), F.col("url")
    event = (
        F.when(k == 0, F.to_json(F.struct(F.lit(5).alias("text"), F.struct(html.alias("plain")).alias("data"))))
        .when(k == 1, F.to_json(F.struct(F.lit(" ").alias("text"), F.struct(html.alias("body_html")).alias("email"))))
        .when(k == 2, F.to_json(F.struct(F.lit("<p></p>").alias("html"), F.struct(url.alias("preview")).alias("data"))))
        .when(k == 3, F.to_json(F.struct(F.struct(url.alias("summary")).alias("body"), F.lit("\u00a0").alias("text"))))
        .when(k == 4, F.to_json(F.struct(F.struct(html.alias("snippet")).alias("content"))))
        .otherwise(F.to_json(F.struct(html.alias("message"))))
    )
    return read(spark, d, "pages").select("page_id", F.try_parse_json(event).alias("event")).select("page_id", T.mail_body(F.col("event")).alias("body"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha, rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') AS pkce FROM documents")
def content_hash(spark, d):
    """SHA-256 in hex and in base64url."""
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.sha256_base64url(F.col("text")).alias("pkce"))


@query("session_key_canonical", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '', 'g') AS session_key FROM pages")
def session_key_canonical(spark, d):
    """Session names reduced to letters and digits."""
    return read(spark, d, "pages").select("page_id", T.session_key(F.col("url")).alias("session_key"))


_REDIRECT = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'http://localhost:80/x?' || page_id WHEN 2 THEN 'http://127.0.0.1' WHEN 3 THEN 'not a uri' ELSE 'https://u@h.example/cb' END"


@query("url_parts_allowlist", f"SELECT page_id, uri, regexp_matches(uri, '^(https://|http://(localhost|127[.]0[.]0[.]1)([:/?]|$))') AND NOT regexp_matches(uri, '#.') AS allowed FROM (SELECT page_id, {_REDIRECT} AS uri FROM pages)")
def url_parts_allowlist(spark, d):
    """Redirect targets: https, or http on loopback, without fragment."""
    k = F.col("page_id") % 5
    uri = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("http://localhost:80/x?"), "page_id")).when(k == 2, "http://127.0.0.1").when(k == 3, "not a uri").otherwise("https://u@h.example/cb")
    return read(spark, d, "pages").select("page_id", uri.alias("uri")).withColumn("allowed", T.allowed_redirect(F.col("uri")))


@query("percent_encode", """SELECT page_id, url_encode(url || ' é+') || '*~!''()' AS encoded FROM pages""")
def percent_encode(spark, d):
    """Texts as components of a URI."""
    return read(spark, d, "pages").select("page_id", T.percent_encode(F.concat("url", F.lit(" é+*~!'()"))).alias("encoded"))


@query("hash_art_bits", "SELECT p_partkey, list_transform(range(128), lambda i: (('0x' || substr(md5(p_name), (i // 8 * 2 + 1)::INT, 2))::INT >> (7 - i % 8)::INT) & 1 = 1) AS bits, ('0x' || left(md5(p_name), 2))::INT % 14 AS color FROM part")
def hash_art_bits(spark, d):
    """A fingerprint grid: one bit for each cell, and a palette entry."""
    h = F.md5("p_name")
    return spread(spark, d, "part", "p_partkey").select("p_partkey", T.hash_bits(h).alias("bits"), (F.conv(F.left(h, F.lit(2)), 16, 10).cast("int") % 14).alias("color"))


_B = "(('0x' || substr(md5(p_name), (({0}) % 16 * 2 + 1)::INT, 2))::INT)"
_BLOB = f"""{{'cx': round(800.0::DOUBLE / 6 * (1 + 2 * i) + ({_B.format("1 + 3 * i")} - 128)::DOUBLE / 128 * 80)::INT, 'cy': round(450.0::DOUBLE / 4 * (1 + {_B.format("2 + 3 * i")} % 3) + ({_B.format("3 + 3 * i")} - 128)::DOUBLE / 128 * 56.25)::INT,
  'r': round(126.0::DOUBLE + {_B.format("4 + 3 * i")}::DOUBLE / 255 * 450 * 0.22::DOUBLE)::INT, 'color': (({_B.format("0")} + i) % 8)::INT}}"""
_DOT = "{'cx': round((i % 16 + 0.5::DOUBLE) * 50)::INT, 'cy': round((i // 16 + 0.5::DOUBLE) * 56.25::DOUBLE)::INT}"


@query("hash_art_geometry", f"SELECT p_partkey, list_transform(range(3), lambda i: {_BLOB}) AS blobs, list_transform(list_filter(range(128), lambda i: {_B.format('i // 8')} >> (7 - i % 8)::INT & 1 = 1), lambda i: {_DOT}) AS dots FROM part")
def hash_art_geometry(spark, d):
    """Blobs and dots of each name's fingerprint."""
    return spread(spark, d, "part", "p_partkey").select("p_partkey", T.hash_art(F.md5("p_name")).alias("a")).select("p_partkey", "a.blobs", "a.dots")


@query(
    "frontmatter_parse",
    """
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'T: ' || source END AS title, CASE WHEN doc_id % 4 < 2 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date,
       CASE WHEN doc_id % 4 < 2 THEN lang END AS body, 'post-' || doc_id AS slug FROM documents""",
)
def frontmatter_parse(spark, d):
    """Header fields and body of text files; files without a sound header give nulls."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    k = F.col("doc_id") % 4
    full = lambda eol: F.concat(F.lit(f"---{eol}# note{eol}title: old{eol}title: 'T: "), F.col("source"), F.lit(f"'{eol}{eol}date:  "), day, F.lit(f"{eol}---{eol}"), F.col("lang"))
    raw = F.when(k == 0, full("\n")).when(k == 1, full("\r\n")).when(k == 2, F.lit("---\nno colon\n---\nx")).otherwise(F.col("lang"))
    f = read(spark, d, "documents").select("doc_id", T.frontmatter(raw).alias("f"), T.slug_of(F.concat(day, F.lit("-post-"), F.col("doc_id"), F.lit(".md"))).alias("slug"))
    return f.select("doc_id", F.try_element_at("f.data", F.lit("title")).alias("title"), F.try_element_at("f.data", F.lit("date")).alias("date"), F.col("f.body").alias("body"), "slug")
