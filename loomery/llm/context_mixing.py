"""Language-model scores by online logistic context mixing over bits.

A text is its lower-cased words (A-Z; words are runs of characters other than space and 0x09-0x0D) and one end token. A token is coded in bits: the HEAD
most frequent training words that occur twice or more have a prefix code (Huffman's, by their training counts), each bit of which is a choice at a node of
the code's tree; any other word is an escape sign, then what its contexts tell of it (beside_costs). A word that they don't tell costs its share of the training tokens if it
occurs twice or more; one that is new but for its own occurrence its UTF-8 bytes and a space, each byte as 8 bits from the highest.

Predictors: counts of bits in contexts. Bits of the prefix code are predicted by the node alone, by the previous word with the node, and by the
two previous words with the node; bits of a spelt byte by the last byte, the last three bytes, and the whole word so far, with the bits already known.
Each longer context leans on the shorter one where it has seen little. Counts are exact sums over sorted runs of a part; contexts are told apart by hashes of 64 bits (24 of them for
the word before the last one).
The stretched predictions are mixed in the logistic domain by weights that gates choose: how often the two longest contexts were seen. A refining
stage corrects the mixed probability by what bits followed such probabilities. Weights and refinement are learnt online: a batch of bits is predicted, then
learnt from; the first bits of all tokens of a part come first, contexts in the order of their hashes. A training token is predicted without its own occurrence, as if it were new. A text's score is the log10 of its probability.

Scale: nothing is held in one place. Tokens go by their previous word to parts of about PART_TOKENS tokens (frequent ones are dealt on by the word before it,
and very frequent ones by the document too), so each part holds all that its contexts have seen (of a frequent word alone, its share); the number of parts grows
with the corpus. A bit is predicted once for all tokens of a part that share its longest seen context and the bits before it. A part answers with one number for each document of each
slice of text. Words outside the code have a cost of their own once each, joined to their texts; spellings are learnt in parts of about PART_WORDS words. What is sent to all tasks
is the code (at most HEAD words); the words beyond it meet their contexts in the parts, in any number. Parts follow the number of tokens alone, so scores don't depend on the number of cores.

Null and empty texts have only an end token; very long texts are whole. A null id counts as the empty text when texts are dealt to training or held-out. Repeated
rows stay rows of their own, with equal scores; ties in frequency are broken by the word. With no training text all words are unknown. Extra columns of any
name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import batches_of, free, stash

END = "\n"
HEAD = 1 << 19
PART_TOKENS, PART_WORDS = 250_000, 100_000
#: Bits that are predicted, then learnt from, at a time.
BATCH = 1 << 14
#: Documents of a slice at most: two bytes hold a document's place and whether it is for training.
SLICE_DOCS, SLICE_BYTES = 1 << 15, 8 << 20
#: Sightings that a longer context's shorter one is worth.
LEAN = 0.5
#: Levels of how often a context was seen.
_SEEN = np.array([1, 2, 4, 16], np.float32)
GATES = (len(_SEEN) + 1) ** 2
STEPS = 33  # of the stretched probability, in the refining stage
_MUL, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Code:
    """A prefix code of words by their counts. The last symbol is the escape sign; symbol and node numbers share one range, symbols first."""

    def __init__(self, names: pa.StringArray, counts: np.ndarray, escape: int):
        self.names = names
        n = self.n = len(names) + 1
        weight = np.zeros(max(1, 2 * n - 1))
        weight[:n] = np.append(counts, escape)
        parent, bit = np.zeros(len(weight), np.int32), np.zeros(len(weight), np.int8)
        heap = [(float(w), i) for i, w in enumerate(weight[:n])]
        heapq.heapify(heap)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            bit[j], weight[node] = 1, a + b
            heapq.heappush(heap, (a + b, node))
        self.parent, self.bit, self.root = parent, bit, len(weight) - 1
        self.depth = np.zeros(len(weight), np.int64)
        for node in range(self.root - 1, -1, -1):
            self.depth[node] = self.depth[parent[node]] + 1
        ones = np.zeros(len(weight))
        at = np.flatnonzero(bit)
        ones[parent[at]] = weight[at]
        h = words.hash_strings(names)
        self.order = np.argsort(h, kind="stable").astype(np.int32)
        self.hashes = h[self.order]
        self.by_symbol = np.append(h, np.uint64(0))
        #: The chance of a one at each node, by the counts of words alone.
        self.one = (ones / np.maximum(weight, 1e-9)).astype(np.float32)

    def symbols(self, names: pa.StringArray, h: np.ndarray) -> np.ndarray:
        """The symbols of words with these hashes; the escape sign for words outside the code."""
        at = self.order[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)]
        same = pc.equal(self.names.take(pa.array(at)), names).to_numpy(zero_copy_only=False)
        return np.where(same, at, self.n - 1).astype(np.int64)

    def path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all bits of all symbols: which symbol of the list, node and bit."""
        which, at, out = np.arange(len(symbols)), symbols, []
        while len(at):
            live = at != self.root
            which, at = which[live], at[live]
            up = self.parent[at]
            out.append((which, up, self.bit[at]))
            at = up
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, the keys ascending; which of them each place holds; and how often each occurs."""
    order = np.argsort(key)
    new = np.concatenate([np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1]])
    start, which = np.flatnonzero(new), np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[start], which, np.diff(start, append=len(key))


def agreed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How many first bits the code word of each sorted item shares with that of the item before; -1 where the context is a new one."""
    differ = word[1:] ^ word[:-1]
    for k in (1, 2, 4, 8, 16, 32):
        differ |= differ >> np.uint64(k)
    out = np.full(len(word), -1, np.int8)
    out[1:] = np.where(context[1:] != context[:-1], -1, 64 - np.bitwise_count(differ).astype(np.int8))
    return out


def ordered(context: np.ndarray, rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items sorted by context and code word, and how many first bits each shares with the one before it (agreed). rank: by code word."""
    room = np.uint64(max(1, int(rank.max()).bit_length()))
    order = np.argsort(context >> room << room | rank.astype(np.uint64))
    c = context[order]
    if ((c[1:] != c[:-1]) & (c[1:] >> room == c[:-1] >> room)).any():  # contexts that differ in their last bits alone
        order = np.lexsort((rank, context))
        c = context[order]
    return order.astype(np.int32), agreed(c, word[order])


def sightings(context: np.ndarray, rank: np.ndarray, word: np.ndarray, weight: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each item's context was followed by code words that agree with its own in the first 0, 1, ... bits (columns), and the row of each item.

    Items that share a context and so many bits lie together when sorted, so every count is the sum of a run; nothing is hashed into slots. These are the counts
    of all items; Runs gives those of each run once.
    """
    order, agree = ordered(context, rank, word)
    total, row = np.append(0.0, np.cumsum(weight[order], dtype=float)), np.empty(len(word), np.int32)
    row[order] = np.arange(len(word), dtype=np.int32)
    starts = [np.flatnonzero(agree < bits) for bits in range(deepest + 1)]
    return np.stack([np.repeat(np.diff(total.take(x), append=total[-1]), np.diff(x, append=len(word))) for x in starts], axis=1).astype(np.float32), row


class Runs:
    """The runs of sorted items that share a context and their first bits, one bit after another: each parts into those with a zero and those with a one.

    start, end: places of a run's items; whole, same: how many training tokens the run it came from and the run itself stand for; up: the run of the next
    shorter context that holds it; acc: costs so far, of an item that isn't learnt from and of one that is.
    """

    def __init__(self, context: np.ndarray, rank: np.ndarray, word: np.ndarray, symbol: np.ndarray, learnt: np.ndarray, training: np.ndarray, shorter: Runs | None):
        self.order, agree = ordered(context, rank[symbol], word[symbol])
        self.symbol = symbol[self.order].astype(np.int32)
        self.total, self.held = (np.append(0, np.cumsum(x[self.order])) for x in (learnt, ~training))
        self.places = np.argsort(agree, kind="stable").astype(np.int32)
        self.cuts = np.cumsum(np.bincount(agree.astype(np.int64) + 1, minlength=65))
        self.start = self.places[: self.cuts[0]]
        self.end = np.append(self.start[1:], np.int32(len(symbol)))
        self.same = np.diff(self.total[self.start], append=self.total[-1])
        self.acc, self.done, self.shorter = np.zeros((len(self.start), 2), np.float32), [], shorter
        self.root = np.empty(len(symbol), np.int32)
        self.root[self.order] = np.repeat(np.arange(len(self.start), dtype=np.int32), self.end - self.start)
        self.up = None if shorter is None else shorter.root[self.order[self.start]]

    def part(self, number: int, bits: np.ndarray) -> None:
        """Parts the runs of items that share this many bits by the bit that follows."""
        new = self.places[self.cuts[number] : self.cuts[number + 1]]
        inside = np.searchsorted(self.start, new, side="right") - 1
        kept = (inside >= 0) & (new < self.end.take(inside)) if len(self.start) else np.zeros(len(new), bool)
        new, many = new[kept], np.ones(len(self.start), np.int64)
        many[inside[kept]] = 2
        parent = np.repeat(np.arange(len(self.start), dtype=np.int32), many)
        first = np.flatnonzero(parent[1:] == parent[:-1])
        self.start, self.end = self.start.take(parent), self.end.take(parent)
        self.start[first + 1] = self.end[first] = new
        self.whole, self.same, self.n_held = self.same.take(parent), self.total.take(self.end) - self.total.take(self.start), self.held.take(self.end) - self.held.take(self.start)
        self.s, self.acc = self.symbol.take(self.start), self.acc.take(parent, axis=0)
        self.bit = bits.take(self.s)
        if self.shorter is not None:
            self.up = self.shorter.child.take(self.up.take(parent) * 2 + self.bit)
        self.child = np.zeros(2 * len(many), np.int32)
        self.child[parent * 2 + self.bit] = np.arange(len(parent), dtype=np.int32)

    def leave(self, live: np.ndarray) -> None:
        """Keeps these runs; what the items of the others cost is known."""
        gone, kept = np.flatnonzero(~live), np.flatnonzero(live)
        self.done.append((self.start.take(gone), self.end.take(gone), self.acc.take(gone, axis=0)))
        self.place = np.cumsum(live, dtype=np.int32) - 1
        self.start, self.end, self.same, self.acc = self.start.take(kept), self.end.take(kept), self.same.take(kept), self.acc.take(kept, axis=0)
        if self.shorter is not None:
            self.up = self.shorter.place.take(self.up.take(kept))

    def costs(self, training: np.ndarray) -> np.ndarray:
        start, end, acc = (np.concatenate(x) for x in zip(*self.done, strict=True))
        by = np.argsort(start)
        run, out = np.repeat(by, (end - start)[by]), np.empty(len(training))
        out[self.order] = acc.ravel().take(run * 2 + training[self.order])
        return out


def chained(p: np.ndarray, seen: list[tuple[np.ndarray, np.ndarray]], unseen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of ever longer contexts, from p on, and the gate of each bit. unseen: how many longer contexts were never seen; they predict as the last one."""
    x, gate = np.empty((len(seen) + 1, len(p)), np.float32).T, np.zeros(len(p), np.int8)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    x[:, 0] = np.log(p / (1 - p))
    for k, (zero, one) in enumerate(seen):
        n = zero + one
        p = (one + LEAN * p) / (n + LEAN)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        x[:, k + 1] = np.log(p / (1 - p))
        gate = gate * (len(_SEEN) + 1) % GATES + sum((n >= level).view(np.int8) for level in _SEEN)
    return x, gate.astype(np.int64) * (len(_SEEN) + 1) ** unseen % GATES


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def _step(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


class Mixer:
    """Gated weights, learnt online, and the refining stage's counts. Where x has fewer columns than there are inputs, the last one stands for the rest too."""

    def __init__(self, inputs: int):
        self.weights = np.zeros((GATES, inputs), np.float32)
        self.weights[:, -1], self.weights[:, -2] = 0.7, 0.3
        self.speed = np.full((GATES, inputs), 1e-2)
        self.refine = np.zeros(GATES * STEPS * 2)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        last = x.shape[1] - 1
        return sum((self.weights[:, j] if j < last else self.weights[:, j:].sum(axis=1)).take(gate) * x[:, j] for j in range(last + 1))

    def cost(self, z: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The cost of each bit, in bits."""
        at = (gate * STEPS + _step(z)) * 2
        refine, p = self.refine.astype(np.float32), _squash(z)
        zero, one = refine.take(at), refine.take(at + 1)
        p = np.clip((p + (one + 20 * p) / (zero + one + 20)) / 2, 1e-7, 1 - 1e-7)
        return np.log(np.where(bit == 1, p, 1 - p)) * np.float32(-1 / math.log(2))

    def learn(self, x: np.ndarray, z: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Moves the weights along the coding-cost gradient of each gate; weight: how many tokens a bit stands for."""
        self.refine += np.bincount((gate * STEPS + _step(z)) * 2 + bit, weight, len(self.refine))
        error, total = weight * (bit - _squash(z)), np.bincount(gate, weight, GATES)
        for j in range(len(self.weights[0])):
            if j < x.shape[1]:
                g = np.bincount(gate, error * x[:, j], GATES) / np.maximum(total, 1e-9)
            self.speed[:, j] += g * g
            self.weights[:, j] += 0.05 * g / np.sqrt(self.speed[:, j])


def mix(symbol: np.ndarray, chance: np.ndarray, bits: np.ndarray, depth: np.ndarray, contexts: list[np.ndarray], weight: np.ndarray, training: np.ndarray) -> np.ndarray:
    """Costs of items in bits. An item is a symbol in contexts, the shortest first; a longer context implies the shorter ones.

    By bit (rows) and symbol: the first probability of the bit that follows, and this bit. By symbol: how many bits it has. weight: how often an item occurs;
    training: whether it is learnt from. A bit whose shortest context was never seen has no longer one that was, nor have the bits after it, so what is mixed depends on
    the bits before it alone: such bits meet in the empty context, which counts nothing.

    What is predicted of a bit depends on its longest seen context, the bits before it and whether the item is learnt from. So it is predicted once for the
    run of items that share these, and learnt from as often as they occur. Bits are taken one after another, the first ones of all items first.
    """
    if not len(symbol):
        return np.zeros(0)
    word = np.zeros(len(depth), np.uint64)
    for number, row in enumerate(bits):
        word |= row.astype(np.uint64) << np.uint64(63 - number)
    rank = np.empty(len(word), np.int64)
    rank[np.argsort(word)] = np.arange(len(word))
    views = []
    for c in (np.zeros(len(symbol), np.uint64), *contexts):
        views.append(Runs(c, rank, word, symbol, weight * training, training, views[-1] if views else None))
    mixer, waiting = Mixer(len(views)), []
    for number in range(len(chance)):
        for v in views:
            v.part(number, bits[number])
            v.p, v.seen = chance[number].take(v.s), np.empty((len(v.s), 2), bool)
            # An item that is learnt from doesn't see itself.
            v.seen[:, 0], v.seen[:, 1] = (v.whole > 0) & (v.n_held > 0), (v.whole > 1) & (v.same > 0)
        shorter_cost = np.log(views[0].p) * np.float32(-1 / math.log(2))
        shorter_cost = np.stack([shorter_cost, shorter_cost], axis=1)
        for k, v in enumerate(views):
            cost, used, times, held = shorter_cost.take(v.up, axis=0) if k else shorter_cost, v.seen, v.same, v.n_held
            if k:
                v.acc -= cost
            if k + 1 < len(views):
                # Those whose longer context was seen are learnt from there.
                longer = views[k + 1]
                times = times - np.bincount(longer.up, longer.same * longer.seen[:, 1], len(v.s))
                held = held - np.bincount(longer.up, longer.n_held * longer.seen[:, 0], len(v.s))
            if not k:
                used = np.stack([held > 0, times > 0], axis=1)
            pick = np.flatnonzero(used)
            for lo in range(0, len(pick), BATCH):
                some = pick[lo : lo + BATCH]
                run, less, counts = some >> 1, (some & 1).astype(np.float32), []
                at, bit = run, v.bit.take(run)
                for x in views[k:0:-1]:
                    whole, same = x.whole.take(at).astype(np.float32), x.same.take(at).astype(np.float32)
                    counts.append((np.maximum(whole - np.maximum(same, less), 0), np.maximum(same - less, 0)))
                    at = x.up.take(at)
                # Predictions of the bit that follows are turned to those of a one.
                x, gate = chained(v.p.take(run), counts[::-1], len(views) - 1 - k)
                x *= (2 * bit - 1).astype(np.float32)[:, None]
                z = mixer.mixed(x, gate)
                cost.ravel()[some] = mixer.cost(z, gate, bit)
                waiting.append((x, z, gate, bit, less * times.take(run)))
                if sum(len(w[1]) for w in waiting) >= BATCH:
                    for w in waiting:
                        mixer.learn(*w)
                    waiting.clear()
            v.acc += cost
            shorter_cost = cost
        for k, v in enumerate(views):
            more = depth.take(v.s) > number + 1
            v.leave(more & ((v.same > 1) | (v.same > 0) & (v.n_held > 0)) if k else more)
    return sum(v.costs(training) for v in views)


def token_costs(code: Code, symbol: np.ndarray, before: np.ndarray, two_before: np.ndarray, weight: np.ndarray, training: np.ndarray) -> np.ndarray:
    """Bits of each coded token in its context (hashes of the word before, and of the two words before)."""
    some = np.flatnonzero(np.bincount(symbol, minlength=code.n))
    which = np.zeros(code.n, np.int64)
    which[some] = np.arange(len(some))
    depth = code.depth[some].astype(np.int8)
    chance, bits = np.full((int(depth.max(initial=1)), len(some)), 0.5, np.float32), np.zeros((int(depth.max(initial=1)), len(some)), np.int8)
    at, item = some, np.arange(len(some))
    while len(at):
        live = at != code.root
        at, item = at[live], item[live]
        up, bit = code.parent[at], code.bit[at]
        level, one = code.depth[up], code.one[up]
        chance[level, item], bits[level, item] = np.where(bit == 1, one, 1 - one), bit
        at = up
    return mix(which[symbol], np.clip(chance, 1e-7, 1 - 1e-7), bits, depth, [before, two_before], weight, training)


def beside_costs(contexts: list[np.ndarray], word: np.ndarray, weight: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits by which contexts, the longest first, tell words outside the code, and whether they tell all of a word. word, contexts: hashes.

    A context asks whether the word is one of those outside the code that have followed it, and if so, which, by their counts; if not, the next shorter one
    asks. The question is predicted by how many of the context's sightings were of words that had followed it already, and mixed like a bit. Where nothing
    was seen but the token itself, nothing is asked. What no context tells is left to the word's own cost. All counts are exact, of any number of words.
    """
    cost, open_ = np.zeros(len(word)), np.ones(len(word), bool)
    learnt, less = weight * training, training.astype(np.int64)
    for context in contexts:
        first, own, _ = distinct(words.mix64(context + word * _NODE))
        _, at, _ = distinct(context)
        mixer, same = Mixer(2), np.bincount(own, learnt)
        n, kinds = np.bincount(at, learnt), np.bincount(at[first], same > 0, int(at.max(initial=-1)) + 1)
        same = same[own]
        kinds, n, same = kinds[at] - (training & (same == 1)), n[at] - less, same - less
        asked, hit = np.flatnonzero(open_ & (n > 0)), open_ & (same > 0)
        for lo in range(0, len(asked), BATCH):
            some = asked[lo : lo + BATCH]
            x, gate = chained(np.full(len(some), 0.5, np.float32), [(kinds[some].astype(np.float32), (n - kinds)[some].astype(np.float32))])
            z, bit = mixer.mixed(x, gate), hit[some].astype(np.int8)
            cost[some] += mixer.cost(z, gate, bit)
            mixer.learn(x, z, gate, bit, learnt[some].astype(np.float32))
        cost[hit] -= np.log2(same[hit] / n[hit])
        open_ &= ~hit
    return cost, ~open_


def word_costs(some_words: pa.StringArray, weight: np.ndarray, training: np.ndarray) -> np.ndarray:
    """Bits of the spelling of each word. A byte that follows the same bytes in several words is an item that occurs several times."""
    spaced = pc.binary_join_element_wise(some_words.cast(pa.binary()), b" ", b"")
    size = pc.binary_length(spaced).to_numpy().astype(np.int64)
    begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(spaced.to_pylist()), np.uint8).astype(np.uint64)
    place = np.arange(len(flat)) - np.repeat(begin, size)
    last = []
    for k in range(1, 4):
        x = np.full(len(flat), 0x20, np.uint64)
        x[k:] = np.where(place[k:] >= k, flat[:-k], 0x20)
        last.append(x)
    # A hash of all bytes of the word before each one.
    power, total = np.cumprod(np.full(int(place.max(initial=0)) + 1, _MUL, np.uint64)), np.zeros(len(flat) + 1, np.uint64)
    total[1:] = np.cumsum((flat + np.uint64(1)) * power[place], dtype=np.uint64)
    prefix = words.mix64(total[:-1] - np.repeat(total[begin], size) + place.astype(np.uint64) * _NODE)
    key = words.mix64(prefix + (flat * 2 + np.repeat(training, size)).astype(np.uint64) * _NODE)
    first, which, _ = distinct(key)
    last = [x[first] for x in last]
    contexts = [words.mix64(last[0]), words.mix64(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)), prefix[first]]
    byte, often, learnt = flat[first].astype(np.int64), np.bincount(which, np.repeat(weight, size), len(first)), np.repeat(training, size)[first]
    del spaced, flat, begin, place, last, x, total, prefix, key, first
    even, full = np.full((8, 256), 0.5, np.float32), np.full(256, 8, np.int8)
    cost = mix(byte, even, (np.arange(256) >> np.arange(7, -1, -1)[:, None] & 1).astype(np.int8), full, contexts, often, learnt)
    return np.bincount(np.repeat(np.arange(len(size)), size), cost[which], len(size))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (occurrences) and c (those in training texts) from id, text and training; the end token is a word too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.byte_table(lower=True)
        for batch in batches:
            for part in words.slices(batch, "text", 8 << 20):
                flat, n = words.split(words.texts(part, "text"), table)
                coded, train = flat.dictionary_encode(), part.column("training").to_numpy(zero_copy_only=False)
                at = coded.indices.to_numpy()
                total = np.bincount(at, minlength=len(coded.dictionary))
                known = np.bincount(at[np.repeat(train, n)], minlength=len(coded.dictionary))
                names = pa.concat_arrays([coded.dictionary, pa.array([END])])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(total, len(n)).astype(np.int64)), pa.array(np.append(known, train.sum()).astype(np.int64))], ["word", "n", "c"])

    return docs.select("text", "training").mapInArrow(count, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def packed(x: bytes) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(x, "zstd", asbytes=True)


def unpacked(x: bytes) -> bytes:
    return pa.decompress(x[4:], int.from_bytes(x[:4], "little"), "zstd", asbytes=True)


def planes(x: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each number, the lowest of all first, packed."""
    return packed(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())


def unplaned(x: bytes, n: int) -> np.ndarray:
    lanes = np.frombuffer(unpacked(x), np.uint8).reshape(n, -1)
    return sum(lanes[k].astype(np.uint64) << np.uint64(8 * k) for k in range(n))


def _events(rows: DataFrame, sent, parts: int) -> DataFrame:
    """Tokens by part: for each slice of texts and part, the tokens in the order of the word before.

    before: distinct words before, as symbols of 3 bytes, before_h: hashes of those outside the code, 8 bytes; times: how many tokens follow each; two: symbols of the
    word before that, two_h: 3 bytes of a hash of those outside; symbol: 3 bytes; other: 6 bytes of the hashes of those outside, if some occur more than once; doc: 2
    bytes, the place in the slice, and the highest bit for training. A row of part -1 - p has what is known of the slice's documents instead, and passes through p:
    ids, facts (training, n_tokens, bytes, known, base, and how many different words it has outside the code, 8 bytes each), these words, joined by spaces (spelt),
    and how often each occurs. All but ids are packed.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, salts, base, known, beside = sent.value
        table, number = words.byte_table(lower=True), 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_DOCS):
                for part in words.slices(whole.slice(at, SLICE_DOCS), "text", SLICE_BYTES):
                    flat, n = words.split(words.texts(part, "text"), table)
                    coded = pa.concat_arrays([flat, pa.array([END])]).dictionary_encode()
                    hashes = words.hash_strings(coded.dictionary)
                    symbols = code.symbols(coded.dictionary, hashes)
                    index, closing = coded.indices.to_numpy(), np.cumsum(n)
                    doc, m, end = np.repeat(np.arange(len(n), dtype=np.int32), n), len(n), symbols[index[-1]]
                    of = lambda x: np.bincount(doc, x[index[:-1]], m)  # noqa: E731, B023
                    outside = symbols == code.n - 1
                    size = of(pc.binary_length(coded.dictionary).to_numpy()).astype(np.int64) + n + 1
                    facts = [part.column("training").to_numpy(zero_copy_only=False), n + 1, size, of(known[symbols]) + known[end], (of(np.where(outside, 0, base[symbols])) + base[end]).view(np.int64)]
                    rest = np.flatnonzero(outside[index[:-1]])
                    each, _, often = distinct(doc[rest] * np.int64(len(symbols)) + index[rest])
                    spelt = b" ".join(coded.dictionary.take(pa.array(index[rest[each]])).cast(pa.binary()).to_pylist())
                    facts.append(np.bincount(doc[rest[each]], minlength=m))
                    told = [packed(x) for x in (np.stack([x.astype(np.int64) for x in facts]).tobytes(), spelt, often.astype(np.int32).tobytes())]
                    del facts, rest, each, often, size, outside
                    # The end token closes every text, and stands before the first word of each.
                    use = np.insert(index[:-1], closing, index[-1])
                    begin = closing - n + np.arange(len(n))
                    doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
                    last = np.full(len(use), index[-1], np.int32)
                    last[1:] = use[:-1]
                    last[begin] = index[-1]
                    two = np.full(len(use), index[-1], np.int32)
                    two[1:] = last[:-1]
                    two[begin] = index[-1]
                    short = (words.mix64(hashes) & np.uint64(0xFFFFFF)).astype(np.uint32)
                    k1 = part.column("k1").to_numpy()
                    # Where the tokens after each word go; those after frequent words are dealt on.
                    to = (words.mix64(hashes) % np.uint64(parts)).astype(np.int64)[last]
                    shares = salts[symbols]
                    dealt = np.flatnonzero((shares > 1)[last])
                    share = shares[last[dealt]]
                    owner = np.abs(k1)[doc[dealt]] % np.maximum(1, share // 64) * 64
                    salt = (short[two[dealt]].astype(np.int64) % np.minimum(share, 64) + owner).astype(np.uint64)
                    to[dealt] = (words.mix64(hashes[last[dealt]] + salt * _NODE) % np.uint64(parts)).astype(np.int64)
                    one, symbol = hashes[last], symbols.astype(np.int32)[use]
                    del index, dealt, share, owner, salt, flat, coded
                    # By part, the word before and the symbol (what is alike lies together, which packs well): the part in the highest bits, the symbol in the
                    # lowest, and as many of the hash as there is room for between. Where that is too few, a word before is listed more than once.
                    room, low = np.uint64(max(1, parts - 1).bit_length()), np.uint64(max(1, code.n).bit_length())
                    order = np.argsort(to.astype(np.uint64) << (np.uint64(64) - room) | one >> (room + low) << low | symbol.astype(np.uint64))
                    to, one, last, two, use, symbol = to[order], one[order], last[order], two[order], use[order], symbol[order]
                    mark = (doc | part.column("training").to_numpy(zero_copy_only=False).astype(np.int32)[doc] << 15)[order]
                    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                    slice_id = (TaskContext.get().partitionId() << 32) + number
                    number += 1
                    out = {c: [] for c in ("part", "before", "before_h", "times", "two", "two_h", "symbol", "other", "doc")}
                    for lo, hi in zip(cut, np.append(cut[1:], len(to)), strict=True):
                        start = np.flatnonzero(np.concatenate([[True], one[lo + 1 : hi] != one[lo : hi - 1]]))
                        out["part"].append(to[lo])
                        for c, x, h, n in (("before", last[lo:hi][start], hashes, 8), ("two", two[lo:hi], short, 3)):
                            out[c].append(planes(symbols[x], 3))
                            out[f"{c}_h"].append(planes(h[x[symbols[x] == code.n - 1]], n))
                        out["times"].append(planes(np.diff(np.append(start, hi - lo)), 4))
                        out["symbol"].append(planes(symbol[lo:hi], 3))
                        out["other"].append(planes(hashes[use[lo:hi][symbol[lo:hi] == code.n - 1]], 6) if beside else None)
                        out["doc"].append(planes(mark[lo:hi], 2))
                    m = len(cut)
                    cols = [pa.array([slice_id] * (m + 1), pa.int64()), pa.array([-1 - slice_id % parts, *out.pop("part")], pa.int64())]
                    cols += [pa.array([None, *x], pa.binary()) for x in out.values()]
                    cols += [pa.array([x, *[None] * m], pa.binary()) for x in told]
                    cols.append(pa.ListArray.from_arrays(pa.array([0, *[len(part)] * (m + 1)], pa.int32()), part.column("id")))
                    yield pa.RecordBatch.from_arrays(cols, ["slice", "part", *out, "facts", "spelt", "often", "ids"])

    return rows.select("id", "k1", "training", "text").mapInArrow(deal, f"slice long, part long, before binary, before_h binary, times binary, two binary, two_h binary, symbol binary, other binary, doc binary, facts binary, spelt binary, often binary, ids array<{kind}>")


def _model_costs(events: DataFrame, sent) -> DataFrame:
    """id, training, row (a number of its own), n_tokens, bytes, known, base, cost (bits of the coded tokens, and of what contexts tell of others) and tail (words outside the code, how often each occurs, and how often without being
    told by its contexts) of every document."""
    kind = events.schema["ids"].dataType.elementType.simpleString()
    passed = ["slice", "part", "facts", "spelt", "often", "ids"]

    def model(rows: pa.Table) -> pa.Table:
        code, beside = sent.value[0], sent.value[-1]
        short = words.mix64(code.by_symbol) & np.uint64(0xFFFFFF)
        out = {"slice": [], "part": [], "docs": [], "costs": [], "told": []}

        def hashes(r: dict, c: str, table: np.ndarray, n: int) -> np.ndarray:
            symbols = unplaned(r[c], 3).astype(np.int64)
            h = table[symbols]
            h[symbols == code.n - 1] = unplaned(r[f"{c}_h"], n)
            return h

        told = rows.filter(pc.is_valid(rows.column("facts"))).select(passed)
        rows = rows.filter(pc.is_null(rows.column("facts"))).drop_columns(passed[2:])
        rows = sorted(rows.to_pylist(), key=lambda r: (r["slice"], r["part"]))
        if rows:
            before = np.concatenate([np.repeat(hashes(r, "before", code.by_symbol, 8), unplaned(r["times"], 4).astype(np.int64)) for r in rows])
            two = np.concatenate([hashes(r, "two", short, 3) for r in rows])
            marks = [unplaned(r["doc"], 2).astype(np.int64) for r in rows]
            symbol, mark = np.concatenate([unplaned(r["symbol"], 3) for r in rows]).astype(np.int64), np.concatenate(marks)
            lens = np.array([len(x) for x in marks])
            training = mark >> 15 == 1
            near = words.mix64(before * _MUL + two)
            key = words.mix64(near + (symbol * 2 + training).astype(np.uint64) * _NODE)
            first, which, count = distinct(key)
            cost = token_costs(code, symbol[first], before[first], near[first], count, training[first])[which]
            doc, row = mark & 0x7FFF, np.repeat(np.arange(len(rows)), lens)
            found = np.zeros((2, 0), np.uint64)  # by row
            if beside:
                outside, other = np.flatnonzero(symbol == code.n - 1), np.concatenate([unplaned(r["other"], 6) for r in rows])
                first, which, count = distinct(words.mix64(near[outside] + (other * np.uint64(2) + training[outside]) * _NODE))
                more, whole = beside_costs([near[outside[first]], before[outside[first]]], other[first], count, training[outside[first]])
                cost[outside] += more[which]
                whole = whole[which]
                found = np.stack([row[outside[whole]].astype(np.uint64), doc[outside[whole]].astype(np.uint64) << np.uint64(48) | other[whole]])
            place = row << 15 | doc
            each, at, _ = distinct(place)
            place = place[each]
            # Sums of such fractions are exact in any order, so equal rows get equal costs.
            total = np.bincount(at, np.rint(cost * 65536) / 65536, len(place)).astype("<f4")
            for i, r in enumerate(rows):
                lo, hi = np.searchsorted(place, [i << 15, (i + 1) << 15])
                for k, v in (("slice", r["slice"]), ("part", r["part"]), ("docs", planes(np.diff(place[lo:hi] & 0x7FFF, prepend=0), 2)), ("costs", packed(total[lo:hi].tobytes())), ("told", planes(found[1, slice(*np.searchsorted(found[0], np.array([i, i + 1], np.uint64)))], 8) if beside else None)):
                    out[k].append(v)
        out = pa.table({k: pa.array(v, pa.int64() if k in ("slice", "part") else pa.binary()) for k, v in out.items()})
        return pa.concat_tables([out, told], promote_options="default").select(["docs", "costs", "told", *passed])

    def gather(rows: pa.Table) -> pa.Table:
        told = rows.filter(pc.is_valid(rows.column("facts")))
        facts, spelt, often = (unpacked(told.column(c)[0].as_py()) for c in ("facts", "spelt", "often"))
        facts, often = np.frombuffer(facts, np.int64).reshape(6, -1), np.frombuffer(often, np.int32).astype(np.int64)
        m = facts.shape[1]
        cost, own = np.zeros(m), often.copy()
        each = pa.array(spelt.split(b" ") if len(often) else [], pa.binary()).view(pa.string())
        key = np.repeat(np.arange(m, dtype=np.uint64), facts[5]) << np.uint64(48) | words.hash_strings(each) & np.uint64((1 << 48) - 1)
        order = np.argsort(key)
        key = key[order]
        for r in sorted(rows.filter(pc.is_null(rows.column("facts"))).select(["part", "docs", "costs", "told"]).to_pylist(), key=lambda r: r["part"]):
            cost[np.cumsum(unplaned(r["docs"], 2)).astype(np.int64)] += np.frombuffer(unpacked(r["costs"]), "<f4")
            if r["told"] is not None:
                np.subtract.at(own, order[np.searchsorted(key, unplaned(r["told"], 8))], 1)
        tail = pa.StructArray.from_arrays([each, pa.array(often), pa.array(own)], ["word", "k", "own"])
        tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(facts[5])), pa.int32()), tail)
        names = ["id", "training", "row", "n_tokens", "bytes", "known", "base", "cost", "tail"]
        ids = told.column("ids").combine_chunks().flatten()
        return pa.table([ids, facts[0] == 1, told.column("slice")[0].as_py() * SLICE_DOCS + np.arange(m), *facts[1:4], facts[4].view(float), cost, tail], names)

    through = F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part"))
    made = events.groupBy(through.alias("at")).applyInArrow(model, f"docs binary, costs binary, told binary, slice long, part long, facts binary, spelt binary, often binary, ids array<{kind}>")
    return made.groupBy("slice").applyInArrow(gather, f"id {kind}, training boolean, row long, n_tokens long, bytes long, known long, base double, cost double, tail array<struct<word: string, k: long, own: long>>")


def _spelt(outside: DataFrame, parts: int) -> DataFrame:
    """Adds cost, the bits of a word's spelling, to word and c. A training word is learnt from once, however often it occurs, as new words are."""

    def spell(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")
        c = rows.column("c").to_numpy()
        # Words that no training text has are predicted, not learnt.
        cost = word_costs(rows.column("word").combine_chunks(), np.ones(len(c), np.int64), c > 0)
        return pa.table({"word": rows.column("word"), "c": c, "cost": cost})

    hashed = outside.select("word", "c", F.xxhash64("word").alias("h"))
    return hashed.groupBy(F.pmod("h", F.lit(parts)).alias("at")).applyInArrow(spell, "word string, c long, cost double")


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, part_tokens: int = PART_TOKENS) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row. training: a boolean Column."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    rows = rows.withColumn("k1", F.xxhash64(F.lit(1), F.col("id").isNull(), "id", F.col("text").isNull(), "text", "training"))
    lexicon = stash(count_words(rows), "lexicon")
    total, distinct, tokens = lexicon.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = math.log10(total + distinct + 1)
    # The end token is always in the code; head bounds what is sent.
    top = lexicon.filter((F.col("c") > 1) & (F.col("word") != END)).orderBy(F.col("c").desc(), "word").limit(head - 1).select("word", "n", "c").toArrow().combine_chunks()
    ends = (lexicon.filter(F.col("word") == END).select("n", "c").first() or (0, 0))
    column = lambda c, x: np.append(top.column(c).to_numpy(), x)
    names, n, c = pa.array([*top.column("word").to_pylist(), END], pa.string()), column("n", ends[0]), column("c", ends[1])
    beyond = F.col("c") < 2
    if len(c) == head and head > 1:
        beyond = (F.col("c") < int(c[-2])) | ((F.col("c") == int(c[-2])) & (F.col("word") > names[-2].as_py()))
    elif head == 1:
        beyond = F.lit(True)
    outside = lexicon.filter((F.col("word") != END) & beyond)
    again, once, n_outside = outside.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)), F.count_if(F.col("c") == 1), F.count("*")).first()
    escaped = again + max(1, once)
    code = Code(names, np.maximum(c, 1), escaped)
    code.end = len(names) - 1
    parts = max(1, -(-tokens // part_tokens))
    # Into how many shares the tokens after a frequent word are dealt; words outside the code are not frequent.
    salts = np.append(np.maximum(1, -(-n * 4 // part_tokens)), 1)
    base, known = np.log10(np.append(c, 0) + 1.0) - floor, np.append(c > 0, False).astype(float)
    sent = spark.sparkContext.broadcast((code, salts, base, known, again > 0))
    # Words that occur again cost their share of the training tokens; the others are spelt, as words like all outside the code.
    own = F.when(F.col("c") > 1, math.log2(escaped) - F.log2("c")).otherwise(F.col("cost") - math.log2(max(1, once) / escaped))
    scored = stash(_spelt(outside, max(1, -(-n_outside // PART_WORDS))).withColumn("cost", own), "spelt")
    free(lexicon)
    with batches_of(spark, SLICE_BYTES):
        seen = stash(_model_costs(_events(rows, sent, parts), sent), "costs")
    tail = seen.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k", "t.own").join(scored, "word")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_t"), F.sum((F.log10(F.col("c") + 1.0) - floor) * F.col("k")).alias("base_t"), F.sum(F.col("cost") * F.col("own")).alias("cost_t"))
    both = seen.drop("tail").join(tail, "row", "left")
    add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    cost = add("cost", "cost_t")
    return both.select(
        F.col("id").alias(id_col), "training", "n_tokens", add("known", "known_t").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        add("base", "base_t").cast("double").alias("base_score"), (-cost * math.log10(2)).alias("score"), (cost / F.col("bytes")).alias("bits_per_byte"),
    )
