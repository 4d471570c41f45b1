"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text becomes `▁` (the dummy prefix, none for an empty text) and itself with each space as `▁`. Its characters are the first symbols. All adjacent pairs that
form a piece stand on an agenda, the best score first, of equal scores the leftmost; the best pair becomes one symbol, and its new neighbours go on the agenda;
entries whose symbols have changed since are passed over. A symbol that is no piece is spelt in byte pieces.

Chunks: texts are cut between a letter and what is none, between two digits, and before a `▁` (CUTS). Whether a place is cut depends on the two characters beside it
alone, so if no piece of the vocabulary holds a cut (this is proved before any text is read), no pair on the agenda ever crosses one: chunks are encoded alone,
and a chunk that a worker has met is not merged again. If a piece holds one, whole texts are chunks. Each chunk that is merged is also encoded and decoded by the
library, in the same Arrow batch, and so is one whole text of each slice; a difference is an error, never a wrong row.

The chunks that are new in a slice are merged together: an agenda of a block of chunks is a matrix, a row for each chunk with the rank of each adjacent pair, and
each step takes the best entry of every row. Long chunks have a heap each.

Vocabularies: BPE with byte fallback and the identity normalizer that keeps extra white space, without user-defined or unused pieces; others are refused with a ValueError.

Null and empty texts have the end id alone, and decode to an empty text; very long texts are whole; null ids stay null; repeated rows stay, with equal results;
ties of scores are decided from the left; columns of other names are ignored. An empty table gives an empty result. Ids outside the vocabulary are an error in
decoding, and a null list of ids is an empty one.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import worker_state

SPACE = "▁"
_LETTER = r"^\W\d_\xb2\xb3\xb9\xbc-\xbe▁"
#: Chunks of a text: letters, one digit, or other characters, each with the run of SPACE before it.
CUTS = rf"▁*[{_LETTER}]+|▁*\d|▁*(?:(?![{_LETTER}]|\d|▁)(?s:.))+|▁+"
#: Characters of chunks that a worker remembers; beyond it the memory starts afresh. It only saves time.
CACHE_CHARS = 8_000_000
#: Bytes of a slice of texts; characters of a block of chunks that are merged together, and of a chunk that isn't long.
SLICE_BYTES, BLOCK, LONG = 16 << 20, 1 << 16, 128
#: Chunks that are merged and checked at a time.
LEARNT = 1 << 14
_NONE, _CODES = np.int32(1 << 30), 21


class PieceModel:
    """A vocabulary: pieces, scores and kinds, and the library's processor for the check."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as layout

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = layout.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        kinds, rules = layout.ModelProto.SentencePiece, proto.normalizer_spec
        plain = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if (
            proto.trainer_spec.model_type != layout.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix
            or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or any(p.type not in plain for p in proto.pieces)
        ):
            raise ValueError("only BPE vocabularies with byte fallback and the identity normalizer are encoded here")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        # Agenda order: falling score. Equal scores share a rank, so that the leftmost pair comes first.
        scores = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.rank = {p.piece: scores[p.score] for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_ids = [i for i, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.special, self.surface = {*self.byte_of, *self.silent, self.unknown}, [x.replace(SPACE, " ") for x in self.pieces]
        self.end = self.library.eos_id()
        self._pairs()
        chunks = re.compile(CUTS)
        #: Whether no piece holds a cut.
        self.cuts = all(chunks.fullmatch(p) and len(chunks.findall(p)) == 1 for p in self.ids)
        self.chunks = chunks.findall if self.cuts else lambda text: [text]

    def symbols(self, text: str) -> list[str]:
        """The symbols that are left when no adjacent pair forms a piece."""
        rank, symbol, n = self.rank.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry is a pair's rank and its left place in one number; it stands as long as the pair there has that rank.
        agenda = [r * n + i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i = divmod(heapq.heappop(agenda), n)
            j = after[i]
            if not symbol[i] or j == n or rank(both := symbol[i] + symbol[j]) != r:
                continue
            symbol[i], symbol[j], after[i] = both, "", (k := after[j])
            if k < n:
                before[k] = i
                if (r := rank(both + symbol[k])) is not None:
                    heapq.heappush(agenda, r * n + i)
            if (h := before[i]) >= 0 and (r := rank(symbol[h] + both)) is not None:
                heapq.heappush(agenda, r * n + h)
        return [s for s in symbol if s]

    def _pairs(self) -> None:
        """All pairs of symbols that form a piece, as sorted numbers, with rank and piece of each. A symbol's code is its id, or that of a lone character."""
        n = len(self.pieces)
        code = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else -1)
        made = [(code(p[:k]), code(p[k:]), self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p))]
        left, right, rank, piece = np.array([x for x in made if x[0] >= 0 and x[1] >= 0], np.int64).reshape(-1, 4).T
        order = np.argsort(key := left << _CODES | right)
        self.keys, self.ranks, self.merged = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order], _NONE).astype(np.int32), np.append(piece[order], 0).astype(np.int32)
        self.codes = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.codes[ord(p)] = i

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs; rank _NONE for those that form none."""
        key = left.astype(np.int64) << _CODES | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]

    def encode_all(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks, as bytes: encode() for all of them at once."""
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            width = max(1, int(sizes[order[at]]))
            if width > LONG:
                out[order[at]] = np.array(self.encode(chunks[order[at]]), "<i4").tobytes()
                at += 1
                continue
            # Rows of up to a quarter more characters share a block.
            to = min(at + max(1, BLOCK // width), int(np.searchsorted(sizes[order], min(LONG, width + width // 4), side="right")))
            some = order[at:to]
            for i, ids in zip(some, self._encode_block([chunks[i] for i in some], sizes[some]), strict=True):
                out[i] = ids
            at = to
        return out

    def _encode_block(self, chunks: list[str], size: np.ndarray) -> list[bytes]:
        n, width = len(chunks), int(size.max())
        filled = np.arange(width) < size[:, None]
        symbol = np.full((n, width + 1), -1, np.int32)
        symbol[:, :width][filled] = self.codes[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        after = np.minimum(np.arange(1, width + 2, dtype=np.int32), size[:, None].astype(np.int32))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        rank, piece = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        if width > 1:
            pair = filled[:, 1:]
            rank[:, :-1][pair], piece[:, :-1][pair] = self._look_up(symbol[:, : width - 1][pair], symbol[:, 1:width][pair])
        row = np.arange(n)
        while len(row):
            i = rank[row].argmin(axis=1)  # of equal ranks the leftmost
            live = rank[row, i] < _NONE
            row, i = row[live], i[live]
            both, j = piece[row, i], after[row, i]
            k = after[row, j]
            symbol[row, i], symbol[row, j], rank[row, j], after[row, i] = both, -1, _NONE, k
            inner = k < size[row]
            before[row[inner], k[inner]] = i[inner]
            rank[row, i] = _NONE
            rank[row[inner], i[inner]], piece[row[inner], i[inner]] = self._look_up(both[inner], symbol[row[inner], k[inner]])
            h = before[row, i]
            inner = h >= 0
            rank[row[inner], h[inner]], piece[row[inner], h[inner]] = self._look_up(symbol[row[inner], h[inner]], both[inner])
        left = symbol >= 0
        flat, each = symbol[left], left.sum(axis=1)
        if (flat >= len(self.pieces)).any():
            spelt = [[int(x)] if x < len(self.pieces) else [self.byte_ids[b] for b in chr(x - len(self.pieces)).encode()] for x in flat]
            each = np.add.reduceat([len(x) for x in spelt], np.cumsum(each) - each)
            flat = np.array([i for x in spelt for i in x], np.int32)
        data, ends = flat.astype("<i4").tobytes(), (np.cumsum(each) * 4).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which spaces are SPACE already and the dummy prefix stands."""
        out = []
        for s in self.symbols(text):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8 (a byte that is none gives U+FFFD), SPACE as a space, without the dummy prefix."""
        if self.special.isdisjoint(ids):
            text = "".join([self.surface[i] for i in ids])
            return text[1:] if text.startswith(" ") else text
        out, held, first, dropped = [], bytearray(), True, False
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(held))
                held.clear()
            first = first and not dropped and not any(out)
            dropped = False
            if i in self.silent:
                continue
            if i == self.unknown:
                out.append(self.unknown_surface)
                continue
            piece = self.surface[i]
            if first and piece.startswith(" "):
                piece, dropped = piece[1:], True
            out.append(piece)
        out.append(_utf8(held))
        return "".join(out)


def _utf8(data: bytearray) -> str:
    """Well-formed characters, and U+FFFD for each byte that is in none."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for k in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + k].decode())
                    at += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def model(path: str) -> PieceModel:
    """The vocabulary of a file, once for each worker."""
    state = worker_state()
    if ("pieces", path) not in state:
        state["pieces", path] = PieceModel(path)
    return state["pieces", path]


class _Known(dict):
    """The ids of chunks, as bytes, and the chunks that decode to something else than themselves."""

    def __init__(self):
        self.chars, self.odd = 0, set()

    def clear(self) -> None:
        super().clear()
        self.chars, self.odd = 0, set()


def _learn(new: list[str], m: PieceModel, known: _Known) -> None:
    """Encodes chunks that are new to the worker, checks them against the library and remembers the ids of each."""
    # The library puts the dummy prefix before every text. A digit after it is cut off from any chunk; a whole text has the prefix itself.
    front, head = ("0", m.encode(SPACE) + m.encode("0")) if m.cuts else ("", [])
    for at in range(0, len(new), LEARNT):
        _learn_some(new[at : at + LEARNT], m, known, front, head)
    known.chars += sum(map(len, new))


def _learn_some(new: list[str], m: PieceModel, known: _Known, front: str, head: list[int]) -> None:
    given = [front + c[not m.cuts :] for c in new]
    theirs, ids = m.library.encode(given, num_threads=1), m.encode_all(new)
    before = np.array(head, "<i4").tobytes()
    own = np.frombuffer(b"".join([before + i for i in ids]), "<i4")
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + len(head)
    other = np.fromiter(itertools.chain.from_iterable(theirs), np.int32)
    if not np.array_equal(sizes, np.fromiter(map(len, theirs), np.int64, len(theirs))) or not np.array_equal(own, other):
        raise RuntimeError(f"the agenda and the library differ on one of {new!r:.2000}")
    for c, text, decoded, whole in zip(new, given, map(m.decode, theirs), m.library.decode(theirs), strict=True):
        if decoded != whole:
            raise RuntimeError(f"the decoder and the library differ on {c!r}: {decoded!r} and {whole!r}")
        if whole != text and whole != text.replace(SPACE, " "):
            known.odd.add(c)
    known.update(zip(new, ids, strict=True))


def _encode_slice(texts: pa.StringArray, m: PieceModel, known: _Known, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """The ids of all texts one after another, how many each has, and the places of texts that hold odd chunks."""
    n = len(texts)
    plain = np.zeros(n, bool)
    if m.cuts:
        # Where every space stands alone, the words between them begin chunks; other texts are cut one by one.
        runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))
        plain = ~pc.or_(runs, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    one_by_one = {i: m.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for i in np.flatnonzero(~plain) for t in [texts[i].as_py()]}
    lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    coded = lists.flatten().dictionary_encode()
    distinct = [SPACE + w for w in coded.dictionary.to_pylist()]
    cut = {w: m.chunks(w) for w in distinct if w not in known}
    _learn(list({c: None for chunks in (*cut.values(), *one_by_one.values()) for c in chunks if c not in known}), m, known)
    ids = [known.get(w) if w not in cut else b"".join([known[c] for c in cut[w]]) for w in distinct]
    ids += [b"".join([known[c] for c in chunks]) for chunks in one_by_one.values()]
    ids.append(last.tobytes())
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begins, pool = np.cumsum(lens) - lens, np.frombuffer(b"".join(ids), "<i4")
    # Entries of each text: its words, or its own, then the end.
    words_of = np.ones(n, np.int64)
    words_of[plain] = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(n), words_of + 1)
    use = np.full(len(owner), len(ids) - 1, np.int64)
    ends = np.cumsum(words_of + 1) - 1
    own = np.ones(len(owner), bool)
    own[ends] = False
    use[own & plain[owner]] = coded.indices.to_numpy()
    use[ends[~plain] - 1] = len(distinct) + np.arange(len(one_by_one))
    each = lens[use]
    upto = np.cumsum(each)
    stream = pool[np.repeat(begins[use] - (upto - each), each) + np.arange(int(upto[-1]))]
    odd = {i for i, chunks in one_by_one.items() if not known.odd.isdisjoint(chunks)}
    if known.odd:
        strange = np.array([not known.odd.isdisjoint(cut.get(w, [w])) for w in distinct] + [False] * (len(ids) - len(distinct)))
        odd |= set(owner[strange[use]].tolist())
    return stream, np.diff(np.concatenate([[0], upto[ends]])), odd


def encode_texts(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int, with the end id last if asked) and decoded (the text of these ids) of every row's whole text."""
    PieceModel(model_path)  # refuses a vocabulary before any task starts
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        known = worker_state().setdefault(("piece chunks", model_path), _Known())
        last = np.array([m.end] if end else [], "<i4")
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                if known.chars > CACHE_CHARS:
                    known.clear()
                texts = words.texts(part, "text")
                stream, sizes, odd = _encode_slice(texts, m, known, last)
                at = np.concatenate([[0], np.cumsum(sizes)])
                _check_whole(texts, stream, at, m, end)
                # A text whose chunks all decode to themselves does so too.
                decoded = pc.replace_substring(texts, SPACE, " ")
                if odd:
                    decoded = pa.array([m.decode(stream[at[i] : at[i + 1]].tolist()) if i in odd else t for i, t in enumerate(decoded.to_pylist())], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(stream))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded], ["id", "ids", "decoded"])

    return rows.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def _check_whole(texts: pa.StringArray, stream: np.ndarray, at: np.ndarray, m: PieceModel, end: bool) -> None:
    """The shortest text of the slice that isn't empty, as the library has it."""
    size = pc.binary_length(texts).to_numpy()
    if size.any():
        i = int(np.where(size > 0, size, np.iinfo(size.dtype).max).argmin())
        text = texts[i].as_py()
        if stream[at[i] : at[i + 1]].tolist() != m.library.encode(text) + [m.end] * end:
            raise RuntimeError(f"the agenda and the library differ on {text[:200]!r}")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text: what each row's list of ids stands for."""
    PieceModel(model_path)
    some = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array()).cast("array<int>").alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return some.mapInArrow(decode, f"id {some.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
