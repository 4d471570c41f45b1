"""Manifests and publish payloads as JSON texts, checked rule by rule.

Each rule is a column over the text; a missing or wrongly typed value breaks the rules that need it. violations lists the rules broken, publish_error the first
step of a publish that fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import let
from .publishing import CATEGORY, DIRECTORY, ENTRY, MOST_BUNDLE, NAME, RESERVED, SHA256, VERSION, first_failing, repo_tool_name, safe_svg, tool_name, violations
from .validation import URI, schema_faults

# Least and most length of a manifest's texts.
LENGTHS = {
    "title": (3, 80), "description": (20, 500), "logo.label": (2, 80), "logo.svg": (20, 20_000),
    "seo.title": (20, 90), "seo.description": (80, 320), "seo.intro": (160, 1200),
}
# Lists: least and most entries, then lengths of each entry's texts.
LISTS = {
    "seo.useCases": (2, 6, {"title": (3, 80), "description": (40, 320)}),
    "seo.faqs": (2, 6, {"question": (10, 140), "answer": (40, 500)}),
}
KEYWORDS = (3, 16, 2, 60)
PATTERNS = {"name": NAME, "version": VERSION, "category": CATEGORY, "entry": ENTRY}
CHANNELS = ("live", "staging", "delist")


def _whole(json: Column, path: str, low: int, high: int) -> Column:
    """A number without a fraction within bounds."""
    return V.is_whole(V.number(json, path), low, high)


def _url(c: Column) -> Column:
    return c.rlike(URI)


def rules(json: Column) -> dict[str, Column]:
    """The rules of a manifest (a variant), by name, in their order. JSON's null is a value: an optional field may be left out, but not be null."""
    out = {name: V.text(json, name).rlike(pattern) for name, pattern in PATTERNS.items()}
    out |= {path: F.length(V.text(json, path)).between(low, high) for path, (low, high) in LENGTHS.items()}
    out["logo.svg.safe"] = safe_svg(V.text(json, "logo.svg"))
    out["logo.sourceUrl"] = V.absent(json, "logo.sourceUrl") | _url(V.text(json, "logo.sourceUrl"))
    for path, (low, high, texts) in LISTS.items():
        out[path] = let(V.items(json, path), lambda each, low=low, high=high, texts=texts: F.size(each).between(low, high) & F.forall(each, _entry(texts)))
    low, high, short, long_ = KEYWORDS
    out["seo.keywords"] = let(V.strings(json, "seo.keywords"), lambda words: F.size(words).between(low, high) & F.forall(words, lambda x: F.length(x).between(short, long_)))
    rank, score = V.absent(json, "popularity.rank"), V.absent(json, "popularity.score")
    one = V.members(json, "popularity").isNotNull() & ~(rank & score) & (rank | _whole(json, "popularity.rank", 1, 10_000)) & (score | V.number(json, "popularity.score").between(0, 1e9))
    out["popularity"] = V.absent(json, "popularity") | one
    out["creditsEstimate"] = _whole(json, "creditsEstimate", 1, 50)
    out["maxEngineCalls"] = V.absent(json, "maxEngineCalls") | _whole(json, "maxEngineCalls", 1, 50)
    out["inputSchema"] = F.size(schema_faults(V.member(json, "inputSchema"))) == 0
    out["outputSchema"] = V.absent(json, "outputSchema") | (F.size(schema_faults(V.member(json, "outputSchema"), output=True)) == 0)
    out["examples"] = let(V.items(json, "examples"), lambda named: (F.size(named) >= 1) & F.forall(named, _example))
    return out


def _example(x: Column) -> Column:
    """A name, and if anything is expected, an object, in which outputMatches is one too."""
    expected = V.absent(x, "expect") | (V.members(x, "expect").isNotNull() & (V.absent(x, "expect.outputMatches") | V.members(x, "expect.outputMatches").isNotNull()))
    return _all([F.length(V.text(x, "name")) >= 1, expected])


def _entry(texts: dict[str, tuple[int, int]]):
    return lambda x: _all(F.length(V.text(x, k)).between(*bounds) for k, bounds in texts.items())


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def manifest_violations(json: Column) -> Column:
    """The names of the rules that a manifest (a variant) breaks."""
    return let(json, lambda j: violations(rules(j)))


def publish_error(payload: Column, org: str) -> Column:
    """The first step of a publish (a variant) that fails, else ok; a delisting needs no manifest.

    Steps: payload, manifest, name by repository or directory, reserved names, bundle present, its size in bytes, its hash.
    """
    return let(payload, lambda p: _publish_error(p, org))


def _publish_error(payload: Column, org: str) -> Column:
    repo, folder, channel = V.text(payload, "repo"), V.text(payload, "source_dir"), V.text(payload, "channel")
    sha, packed, manifest = V.text(payload, "bundle_sha256"), V.text(payload, "bundle_b64"), V.member(payload, "manifest")
    optional = lambda path, ok: V.absent(payload, path) | ok
    sound = (
        repo.rlike(rf"^\Q{org}\E/[A-Za-z0-9._-]+\z") & channel.isin(*CHANNELS) & optional("source_dir", folder.rlike(DIRECTORY)) & optional("bundle_sha256", sha.rlike(SHA256))
        & optional("bundle_b64", packed.isNotNull()) & optional("commit_sha", V.text(payload, "commit_sha").isNotNull())
    )
    expected = F.when(folder.isNotNull(), tool_name(folder)).otherwise(repo_tool_name(repo))
    name, bundle = V.text(manifest, "name"), F.try_to_binary(packed, F.lit("base64"))
    later = {
        "invalid_manifest": F.size(manifest_violations(manifest)) == 0,
        "name_mismatch": name == expected,
        "reserved_name": ~name.isin(*RESERVED),
        "missing_bundle": (packed != "") & (sha != ""),
        "bad_bundle_size": F.octet_length(bundle).between(1, MOST_BUNDLE),
        "sha_mismatch": F.sha2(bundle, 256) == sha,
    }
    return F.when(~F.coalesce(sound, F.lit(False)), "bad_payload").when(channel == "delist", "ok").otherwise(first_failing(later, F.lit("ok")))
