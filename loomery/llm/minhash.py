"""Near-duplicate documents by one-permutation hashing.

Sets: the distinct word shingles of a text (fewer words: the whole sequence as one shingle; no words: the empty set, linked with
nothing). Rows of equal sets form a class, which is found by grouping and stands for all its rows from then on.

Signatures: one hash for each shingle; its high part picks one of bands * rows bins, each bin keeps its least hash. Empty bins
copy a bin that their own random permutation of the bins reaches first among the full ones (optimal densification). Bins are
cut into bands, and a bucket is the classes that agree in a band.

Candidates: every bucket is a star, one centre linked with each other member, so a bucket of n members gives n - 1 pairs. The centre is the
least id in half of the buckets and the least hash in the others, so that a class meets different centres. Pairs are confirmed on the
full sets, which are kept for classes that share a bucket.

Finish: a bucket that still holds several components (members like each other, but not like the centre) is checked through: all its pairs across
components, each in the first bucket that both share. Members are dealt by hash into blocks, each packed into one row, and each pair of blocks is a group of its own. It first
compares sketches (a byte for each bin) and then, for members with a candidate left, counts the common shingles of all pairs. Of the links of two classes that
share a bucket, a sketch at the threshold loses one in about a billion, and one is lost where 32 bits of two bands' hashes agree by chance, so that the pair seems to have
met in a bucket before (one in four billion for each band). What a block emits is a forest, never its pairs; only the compared bytes grow with the square of a mixed bucket.

Components: alternating large-star and small-star steps over the confirmed links. Least neighbours are broadcast while they are few, and else joined
with tables that adaptive execution can split at a hub.

Ids are integers. Null ids: such rows are linked with nothing, have no component and are kept. Rows of one id count as one node. Null and empty texts
have empty sets. Very long texts are used whole. Ties have no order: equal sets are one class, and the least id names a component. Extra columns
of any name are ignored; an empty table gives an empty result. Equal inputs give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import free, stash

#: At a similarity of 0.8 a pair misses all 40 bands of 6 bins with a chance of 5 in a million; at 0.85, of 6 in a billion.
BANDS, ROWS = 40, 6
#: Rows that are broadcast at most (two longs each).
MOST_SENT = 1_000_000
#: Parts of a class's rows where they meet the class.
SALTS = 16
#: Members and shingles of a block in the finish, on average; columns of a dense product; pairs expanded at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES, DENSE, EXPANDED = 512, 500_000, 2048, 1 << 20
#: Members of a block while sketches alone are compared, in tiles of BLOCK_MEMBERS.
SIFTED_MEMBERS = 4096
#: Standard deviations that a sketch may fall short of the threshold.
DEVIATIONS = 6
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within each text, and the number of the text of each."""
    flat, n = words.split(text, words.byte_table(lower=True))
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    h = words.hash_strings(coded.dictionary)[coded.indices.to_numpy()]
    doc, begin = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
    place, size = np.arange(len(h)) - begin, np.repeat(n, n)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        rolled *= _MUL
        rolled[: len(h) - k] += h[k:]
    whole = place + width <= size
    # A text of fewer words has one shingle, marked by its length.
    short = (place == 0) & (size < width)
    for at in np.flatnonzero(short):
        x = np.uint64(size[at])
        with np.errstate(over="ignore"):
            for v in h[at : at + size[at]]:
                x = x * _MUL + v
        rolled[at] = x ^ np.uint64(0x5851F42D4C957F2D)
    use = whole | short
    doc, out = doc[use], words.mix64(rolled[use])
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], doc[new]


def _probes(bins: int) -> np.ndarray:
    rnd = np.random.default_rng(7)
    return np.argsort(rnd.random((bins, bins)), axis=1)


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each text and a hash of each band; rows of texts with empty sets have no meaning. h ascends within each text."""
    bins = bands * rows
    sig, full = np.zeros((n_docs, bins), np.uint64), np.zeros((n_docs, bins), bool)
    which = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    # Bins follow the order of the hashes, so the first of a run is the least of its bin.
    first = np.ones(len(h), bool)
    first[1:] = (which[1:] != which[:-1]) | (doc[1:] != doc[:-1])
    at = (doc[first], which[first].astype(np.int64))
    sig[at], full[at] = h[first], True
    probes = _probes(bins)
    has = full.any(axis=1)
    row, col = np.nonzero(~full & has[:, None])
    for t in range(bins):
        if not len(row):
            break
        source = probes[col, t]
        ok = full[row, source]
        sig[row[ok], col[ok]] = sig[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    out = np.zeros((n_docs, bands), np.uint64)
    for k in range(rows):
        out = words.mix64(out * _MUL + sig.reshape(n_docs, bands, rows)[:, :, k] + np.uint64(k))
    return sig, out


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, k1, k2 (a 128-bit digest of the set) and bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                h, doc = shingle_sets(words.texts(part, "text"), width)
                m = part.num_rows
                count = np.bincount(doc, minlength=m)
                total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[np.concatenate([[0], np.cumsum(count)])])  # noqa: B023, E731
                keys = [total(words.mix64(h ^ np.uint64(c))).view(np.int64) for c in (0x1234567, 0x7654321ABCDEF)]
                band = signatures(h, doc, m, bands, rows)[1].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * bands, pa.int32()), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], ["id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(sign, f"id {kind}, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, ends: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, h (the set) and sketch (a byte of each bin, then four bytes of each band) of the given ids; a row for each text of an id."""
    own = docs.join(_sent(ends), "id", "left_semi").select("id", "text").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 20):
                h, doc = shingle_sets(words.texts(part, "text"), width)
                m = part.num_rows
                bins, band = signatures(h, doc, m, bands, rows)
                sketch = np.hstack([bins.astype(np.uint8), band.astype("<u4").view(np.uint8).reshape(m, 4 * bands)])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(m + 1)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "h", "sketch"])

    return own.mapInArrow(sets, "id long, h array<long>, sketch binary")


def _sent(few: DataFrame) -> DataFrame:
    """The table itself, marked for broadcast if it is a stash of at most MOST_SENT rows."""
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("h").alias(f"h_{x}"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.size("h_a") + F.size("h_b")).alias("both"), F.size(F.array_intersect("h_a", "h_b")).alias("common"))
    return counted.filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")


def common_counts(ha: np.ndarray, da: np.ndarray, n_a: int, hb: np.ndarray, db: np.ndarray, n_b: int) -> np.ndarray:
    """How many hashes each of n_a sets shares with each of n_b others; d is the number of the set that each hash h belongs to."""
    both = np.intersect1d(ha, hb)
    out = np.zeros((n_a, n_b), np.float32)
    if not len(both):
        return out

    def columns(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        held = both[at] == h
        order = np.argsort(at[held], kind="stable")
        at, d = at[held][order], d[held][order]
        return at, d, np.bincount(at, minlength=len(both))

    (ca, da, fa), (cb, db, fb) = columns(ha, da), columns(hb, db)
    # Frequent hashes are multiplied as dense columns, the pairs of the others are listed.
    frequent = np.flatnonzero(fa * fb * 64 > n_a * n_b)
    for at in range(0, len(frequent), DENSE):
        place = np.full(len(both), -1)
        place[frequent[at : at + DENSE]] = np.arange(len(frequent[at : at + DENSE]))
        x, y = (np.zeros((n, DENSE), np.float32) for n in (n_a, n_b))
        for m, c, d in ((x, ca, da), (y, cb, db)):
            use = place[c] >= 0
            m[d[use], place[c[use]]] = 1
        out += x @ y.T
    rare = np.ones(len(both), bool)
    rare[frequent] = False
    use = rare[ca]
    ca, da = ca[use], da[use]
    n, begin = fb[ca], (np.cumsum(fb) - fb)[ca]
    done, at = np.cumsum(n), 0
    while at < len(ca):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + EXPANDED, side="right")))
        k = n[at:to]
        other = db[np.repeat(begin[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        pair, times = np.unique(np.repeat(da[at:to], k) * np.int64(n_b) + other, return_counts=True)
        out.ravel()[pair] += times
        at = to
    return out


def _candidates(sketch: np.ndarray, size: np.ndarray, component: np.ndarray, a: np.ndarray, b: np.ndarray, before: int, bins: int, percent: int) -> np.ndarray:
    """Which of the members a may be linked with which of b: of other components, of like size, of like sketch, and not together in a band before."""
    na, nb = size[a][:, None], size[b]
    ok = (component[a][:, None] != component[b]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    band = sketch[:, bins:].copy().view("<u4")
    for k in range(before):
        ok &= band[a, k][:, None] != band[b, k]
    if not ok.any():
        return ok
    x, y = np.ascontiguousarray(sketch[a, :bins].T), np.ascontiguousarray(sketch[b, :bins].T)
    agree = np.zeros(ok.shape, np.uint16)
    for k in range(bins):
        agree += x[k][:, None] == y[k]
    # Small sets fill few bins with hashes of their own, so their sketches vary more.
    p, n = percent / 100, 1 / (1 / bins + 1 / np.maximum(1, np.minimum(na, nb)))
    return ok & (agree >= bins * (p - DEVIATIONS * np.sqrt(p * (1 - p) / n)))


def _block(rows: pa.Table) -> tuple[dict[str, np.ndarray], pa.StructArray]:
    """The members of a pair of blocks by column, with those of either side (a, b), and as they came."""
    lists = pa.concat_arrays(rows.column("members").chunks)
    members = lists.flatten()
    out = {c: members.field(c).to_numpy() for c in ("id", "n", "component")}
    out["sketch"] = np.frombuffer(b"".join(members.field("sketch").to_pylist()), np.uint8).reshape(len(members), -1)
    s, (i, j, band) = np.repeat(rows.column("s").to_numpy(), pc.list_value_length(lists).to_numpy()), (rows.column(c)[0].as_py() for c in "i j band".split())
    return out | {"a": np.flatnonzero(s == i), "b": np.flatnonzero(s == j), "band": band, "same": i == j}, members


def _dealt(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Packs the members of each bucket into blocks of about most of them, a row for each block, and deals the blocks out to all pairs (i, j) of them; s is a block's number."""
    blocks = sizes.select("key", F.ceil(F.greatest(F.col("m") / most, F.col("total") / (most * (BLOCK_SHINGLES // BLOCK_MEMBERS)))).alias("g"))
    own = members.join(blocks, "key").withColumn("s", F.pmod(F.xxhash64("id"), "g"))
    packed = own.groupBy("key", "band", "g", "s").agg(F.collect_list(F.struct(*[c for c in members.columns if c not in ("key", "band")])).alias("members"))
    return packed.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).withColumn("i", F.least("s", "t")).withColumn("j", F.greatest("s", "t")).drop("g", "t")


def _finished(named: DataFrame, sets: DataFrame, bins: int, percent: int) -> DataFrame | None:
    """Links (a, b) of components, from all pairs across components in the buckets of named (key, band, id, n, component); None if no bucket is mixed."""
    sized = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("total"))
    # The one pair of a bucket of two was that of its star.
    mixed = stash(sized.filter("lo <> hi and m > 2").select("key", "m", "total"), "mixed")
    if mixed.isEmpty():
        free(mixed)
        return None

    def sift(rows: pa.Table) -> pa.Table:
        x, members = _block(rows)
        alive = np.zeros(len(members), bool)
        for u in range(0, len(x["a"]), BLOCK_MEMBERS):
            for v in range(u if x["same"] else 0, len(x["b"]), BLOCK_MEMBERS):
                a, b = x["a"][u : u + BLOCK_MEMBERS], x["b"][v : v + BLOCK_MEMBERS]
                ok = _candidates(x["sketch"], x["n"], x["component"], a, b, x["band"], bins, percent)
                alive[a[ok.any(axis=1)]] = True
                alive[b[ok.any(axis=0)]] = True
        left = [x[c][alive] for c in ("id", "n", "component")]
        return pa.table([np.full(alive.sum(), rows.column("key")[0].as_py()), np.full(alive.sum(), x["band"], np.int32), *left], ["key", "band", "id", "n", "component"])

    def compare(rows: pa.Table) -> pa.Table:
        x, members = _block(rows)
        ok = _candidates(x["sketch"], x["n"], x["component"], x["a"], x["b"], x["band"], bins, percent)
        names, at = np.unique(x["component"], return_inverse=True)
        if ok.any():
            a, b = x["a"][ok.any(axis=1)], x["b"][ok.any(axis=0)]
            ok = ok[ok.any(axis=1)][:, ok.any(axis=0)]
            lists = members.field("h")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            n = np.diff(offsets)
            sides = []
            for side in (a, b):
                each = [flat[offsets[k] : offsets[k + 1]] for k in side]
                sides += [np.concatenate(each), np.repeat(np.arange(len(side)), [len(h) for h in each]), len(side)]
            common = common_counts(*sides)
            u, v = np.nonzero(ok & (100 * common >= percent * (n[a][:, None] + n[b] - common)))
            u, v, label = at[a][u], at[b][v], np.arange(len(names))
            while True:  # the least component that each is linked with, within the block
                new = label.copy()
                np.minimum.at(new, u, label[v])
                np.minimum.at(new, v, label[u])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            at = label
        else:
            at = np.arange(len(names))
        linked = np.flatnonzero(at != np.arange(len(names)))
        return pa.table({"a": names[linked], "b": names[at[linked]]})

    light = sets.select("id", "sketch")
    sifted = _dealt(named.join(mixed.select("key"), "key", "left_semi").join(light, "id"), mixed, SIFTED_MEMBERS).groupBy("key", "i", "j").applyInArrow(sift, "key long, band int, id long, n long, component long").distinct()
    alive = stash(sifted, "alive")
    sizes = stash(alive.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "alive_sizes")
    links = stash(_dealt(alive.join(sets, "id"), sizes, BLOCK_MEMBERS).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "more")
    free(mixed, alive, sizes)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and the least node it is connected with (component), for all nodes of the links (a, b) that aren't the least themselves."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.select("u", "v", F.lit(True).alias("down")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("down")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if("down").alias("below"), F.count_if(~F.col("down")).alias("above"))
        least = stash(least, "least")
        # Done when every node has one edge to a least node, or is one.
        if least.filter("below > 1 or (below = 1 and above > 0)").isEmpty():
            free(least)
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.behind = [edges]
            return out
        moved = stash(least.filter("m <> u and above > 0").select(F.col("u").alias("v"), "m"), "moved")
        large = stash(edges.join(_sent(moved), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(_sent(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        free(edges, least, moved, large, low)
        edges = new


def _starred(classes: DataFrame, bands: int) -> DataFrame:
    """key, band, id, n, centre and n_centre of every member of a bucket of two or more."""
    # A least value of id XOR a mask of the bucket: the mask is 0 in half of the buckets, and gives the id back. All sums are of plain longs, so they hash.
    mask = F.when(F.col("key") % 2 == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("key"))
    places = classes.select("id", "n", F.posexplode("bands").alias("band", "hash")).select("id", "n", "band", F.xxhash64("band", "hash").alias("key"))
    order = F.col("id").bitwiseXOR(mask)
    best = places.groupBy("key").agg(F.min(order).alias("best"), F.min_by("n", order).alias("n_centre"), F.count("*").alias("c")).filter("c > 1")
    stars = places.join(best.select("key", F.col("best").bitwiseXOR(mask).alias("centre"), "n_centre"), "key")
    return stars.select("key", "band", "id", "n", "centre", "n_centre")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id reachable) and kept (id = component_id) of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = own.filter(F.col("id").isNotNull())
    signed = stash(_signed(own, width, bands, rows), "signed")
    key = ["k1", "k2", "n_shingles"]
    one = signed.filter("id is not null and n_shingles > 0")
    classes = stash(one.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("c")), "classes")
    reps = one.join(classes.select("id", *key), ["id", *key], "left_semi").dropDuplicates(["id", *key])
    stars = stash(_starred(reps.select("id", F.col("n_shingles").alias("n"), "bands"), bands), "stars")
    ends = stash(stars.select("id").distinct(), "ends")
    sets = stash(_sets(known, ends, width, bands, rows), "sets")
    like = F.least("n", "n_centre") * 100 >= F.greatest("n", "n_centre") * percent  # sets of too unlike sizes can't be linked
    pairs = stars.filter((F.col("id") != F.col("centre")) & like).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    pairs = stash(pairs.distinct(), "pairs")
    found = components(_confirmed(pairs, sets, percent))
    named = stars.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    named = stash(named, "named")
    more = _finished(named, sets, bands * rows, percent)
    free(stars, ends, sets, pairs, named)
    own_stashes = found.behind
    if more is not None:
        further = components(more)
        own_stashes += [more, *further.behind]
        joined = further.select(F.col("node").alias("component"), F.col("component").alias("next"))
        both = found.join(joined, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        # A component's own name is no node of the stars' components.
        found = both.union(joined)
    label = stash(found.select(F.col("node").alias("id"), F.col("component").alias("final")), "label")
    free(*own_stashes)
    # Classes of one row that are linked with no other name themselves; the rows of the others meet their class in SALTS parts.
    named = classes.join(label, "id", "left").filter("c > 1 or final is not null").select(*key, F.coalesce("final", "id").alias("final"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows_ = signed.select("id", *key, F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows_.join(named, [*key, "salt"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("final", "id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
    out.behind = [signed, classes, label]
    return out
