"""Text, HTML and JSON shaping over columns. Lengths count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of the trimming rules (U+0085 is none of it), as it stands in a character class, and as a text.
WHITE_INNER = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE = f"[{WHITE_INNER}]"
WHITE_TEXT = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Replacements from HTML to text, in this order (so doubly escaped entities decode twice).
HTML_STEPS = (
    (r"(?is)<style.*?</style>", " "),
    (r"(?is)<script.*?</script>", " "),
    (r"(?i)<(br|/p|/div|/li)>", "\n"),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&#39;", "'"),
)

#: Line ends, blanks before them, empty lines in a row. A run of blanks is tried from its start alone, so long runs cost no more than their length.
LINE_ENDS = ((r"\r\n", "\n"), (r"(?<![ \t])[ \t]++\n", "\n"), (r"\n{3,}", "\n\n"))
#: Where a mail event may nest its content, and the names of text, markup and preview, in order.
NESTED = ("data", "email", "message", "body", "content")
TEXT_KEYS = ("text", "plain", "plaintext", "text_body", "body_text", "raw_text", "body")
HTML_KEYS = ("html", "html_body", "body_html", "raw_html")
PREVIEW_KEYS = ("snippet", "preview", "summary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes value once and uses it in body any number of times; keeps generated code small."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trim(c: Column) -> Column:
    """Unicode white space off both ends (Spark's own trim takes spaces only). Looks at the ends alone."""
    return F.btrim(c, F.lit(WHITE_TEXT))


def html_to_text(c: Column) -> Column:
    for pattern, to in HTML_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalize_body(c: Column, most: int = 3000) -> Column:
    """Unix line ends, no blanks at line ends, at most one empty line in a row, trimmed, clipped, fences defused; null if nothing is left."""
    for pattern, to in LINE_ENDS:
        c = F.regexp_replace(c, pattern, to)

    def clip(t: Column) -> Column:
        cut = F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most)), F.lit(WHITE_TEXT)), F.lit("\n..."))).otherwise(t)
        return F.replace(cut, F.lit("```"), F.lit("'''"))

    return let(trim(c), lambda t: F.when(t != "", clip(t)))


def body_of(text: Column, html: Column, preview: Column, most: int = 3000) -> Column:
    """The first of the three that isn't blank, normalised. The choice is on the raw value: markup without text gives null."""
    blank_to_null = lambda c: let(c, lambda v: F.when(trim(v) != "", v))
    # Only the raw value of the first stage that isn't blank goes on, so it is normalised once.
    chosen = let(
        F.array(*[F.struct(blank_to_null(c).alias("t"), F.lit(m).alias("markup")) for c, m in ((text, False), (html, True), (preview, False))]),
        lambda all_: F.get(F.filter(all_, lambda x: x["t"].isNotNull()), F.lit(0)),
    )
    return let(chosen, lambda x: normalize_body(F.when(x["markup"], html_to_text(x["t"])).otherwise(x["t"]), most))


def pick_string(records: list[Column], keys: tuple[str, ...]) -> Column:
    """The first string that isn't blank: record by record, and key by key in each. Records are variants; other kinds of values are passed over."""

    def found(r: Column, k: str) -> Column:
        # Numbers would be cast to strings, so the kind is asked for first.
        is_text = F.schema_of_variant(F.try_variant_get(r, f"$.{k}", "variant")) == "STRING"
        return F.when(is_text, let(F.try_variant_get(r, f"$.{k}", "string"), lambda v: F.when(trim(v) != "", v)))

    return F.coalesce(*[found(r, k) for r in records for k in keys])


def records_of(event: Column) -> list[Column]:
    """A variant and the objects nested in it under NESTED."""
    return [event, *[F.try_variant_get(event, f"$.{k}", "variant") for k in NESTED]]


def mail_body(event: Column, most: int = 3000) -> Column:
    """The body of a mail event (a variant): text, else markup as text, else the preview, from the event and its nested objects."""
    records = records_of(event)
    return body_of(*[pick_string(records, keys) for keys in (TEXT_KEYS, HTML_KEYS, PREVIEW_KEYS)], most)


def truncated(c: Column, most: int) -> tuple[Column, Column]:
    """The first `most` characters, and whether anything was cut."""
    return F.left(c, F.lit(most)), F.coalesce(F.length(c) > most, F.lit(False))


def json_text(json: Column) -> Column:
    """A JSON text written compactly, its keys in the order they came in; null if it doesn't parse."""
    value = F.try_parse_json(json)
    nested = F.ltrim(json).rlike(r"^\s*[\[{]")
    return F.when(value.isNotNull(), F.when(nested, F.get_json_object(json, "$")).otherwise(F.to_json(value)))


def json_or_text(json: Column, text: Column) -> Column:
    """A JSON value that parses and isn't null, else the text."""
    value = F.try_parse_json(json)
    return F.coalesce(F.when(value.isNotNull() & ~F.is_variant_null(value), json_text(json)), text)


# What a component of a URI keeps besides letters, digits and -._*
UNESCAPED = {"%20": "+", "~": "%7E", "!": "%21", "'": "%27", "(": "%28", ")": "%29"}


def percent_encode(c: Column) -> Column:
    """A text as a component of a URI."""
    out = F.url_encode(c)
    for to, written in UNESCAPED.items():
        out = F.replace(out, F.lit(written), F.lit(to))
    return out


def sha256_base64url(c: Column) -> Column:
    digest = F.base64(F.unhex(F.sha2(c, 256)))
    return F.regexp_replace(F.translate(digest, "+/", "-_"), "=+$", "")


def session_key(c: Column) -> Column:
    """Letters and digits only, case kept."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def allowed_redirect(uri: Column) -> Column:
    """https anywhere, http on loopback hosts, never with a fragment. White space, backslashes and hosts of odd characters are refused, not repaired."""
    shape = r"^(?i)(https?)://(?:[^/?#@\\\s\p{Cntrl}]*@)?([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?|\[[0-9a-f:.]+\])(?::\d{0,5})?(?:[/?][^#\\\s\p{Cntrl}]*)?#?\z"
    scheme, host = (F.lower(F.regexp_extract(uri, shape, k)) for k in (1, 2))
    return F.coalesce((scheme == "https") | ((scheme == "http") & host.isin("localhost", "127.0.0.1")), F.lit(False))


def _bytes(hex_: Column, n: int, wrap: bool = False) -> Column:
    """The first n bytes of a hex string, which start over at its end if they wrap, and else are null there."""
    size = F.floor(F.length(hex_) / 2)
    at = lambda i: i % size if wrap else i
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substr(hex_, (at(i) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))


def hash_bits(hex_: Column, n: int = 128) -> Column:
    """The first n bits of a hex string, the highest bit of each byte first."""
    bits = lambda bytes_: F.flatten(F.transform(bytes_, lambda b: F.array(*[F.getbit(b, F.lit(7 - k)) == 1 for k in range(8)])))
    return F.slice(let(hex_, lambda h: bits(_bytes(h, -(-n // 8)))), 1, n)


# The canvas of a fingerprint, its blobs and its grid.
ART_WIDTH, ART_HEIGHT, ART_BLOBS, ART_COLUMNS, ART_ROWS = 800, 450, 3, 16, 8


def hash_art(hex_: Column, colors: int = 8) -> Column:
    """A picture's geometry from a hash in hex: blobs (cx, cy, r and the number of their color, of so many) and dots (cx, cy), one for each bit that is set.

    Places are whole numbers. Byte i counts from the hash's start again once it is used up; a hash without a whole byte gives null.
    """
    whole = lambda x: F.round(x).cast("int")

    def blob(i: Column, byte: Callable[[Column], Column]) -> Column:
        third, row = ART_WIDTH / 6 * (1 + 2 * i), ART_HEIGHT / 4 * (1 + byte(2 + 3 * i) % 3)
        cx, cy = third + (byte(1 + 3 * i) - 128) / 128 * (ART_WIDTH / 10), row + (byte(3 + 3 * i) - 128) / 128 * (ART_HEIGHT / 8)
        r = ART_HEIGHT * 0.28 + byte(4 + 3 * i) / 255 * ART_HEIGHT * 0.22
        return F.struct(whole(cx).alias("cx"), whole(cy).alias("cy"), whole(r).alias("r"), ((byte(F.lit(0)) + i) % colors).alias("color"))

    # The grid's places are the same for all hashes, so they are literals; halves round up.
    place = lambda k, step: F.lit(int((k + 0.5) * step + 0.5))
    grid = F.array(*[F.struct(place(c, ART_WIDTH / ART_COLUMNS).alias("cx"), place(r, ART_HEIGHT / ART_ROWS).alias("cy")) for r in range(ART_ROWS) for c in range(ART_COLUMNS)])

    def art(bytes_: Column) -> Column:
        byte = lambda i: F.get(bytes_, i)
        blobs = F.transform(F.sequence(F.lit(0), F.lit(ART_BLOBS - 1)), lambda i: blob(i, byte))
        return F.struct(blobs.alias("blobs"), F.filter(grid, lambda _, i: F.getbit(byte(F.shiftright(i, 3)), 7 - i % 8) == 1).alias("dots"))

    n = ART_COLUMNS * ART_ROWS // 8
    return let(hex_, lambda h: F.when(F.length(h) > 1, let(_bytes(h, n, wrap=True), art)))


def frontmatter(raw: Column) -> Column:
    """A struct of data (map) and body, null without a block or with a line that has no colon. Comments and blank lines are skipped; the last of equal keys counts."""
    # Fixed value: the shape of a file with a header.
    block = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    lines = F.filter(F.transform(F.split(F.regexp_extract(raw, block, 1), r"\r?\n"), trim), lambda x: (x != "") & ~x.startswith("#"))

    def entry(x: Column) -> Column:
        at = F.instr(x, ":")
        value = F.regexp_replace(trim(F.substr(x, at + 1)), r"""^["'](.*)["']$""", "$1")
        return F.struct(trim(F.left(x, at - 1)).alias("key"), value.alias("value"))

    def last_wins(pairs: Column) -> Column:
        later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))

    ok = raw.rlike(block) & F.forall(lines, lambda x: F.instr(x, ":") > 0)
    return F.when(ok, F.struct(last_wins(F.transform(lines, entry)).alias("data"), F.regexp_extract(raw, block, 2).alias("body")))


def slug_of(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.md$", ""), r"^\d{4}-\d{2}-\d{2}-", "")
