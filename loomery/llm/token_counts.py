"""Exact token counts with a whole-token shortcut.

A vocabulary string that the library encodes alone as one token counts 1 wherever it is a whole pre-token. That is proved
once, for every vocabulary string, before the corpus is read; only the other pre-tokens are merged by the library.

The shortcut needs a vocabulary file whose rules are RULES: there white space never joins two tokens (the pre-tokenizer drops it), so a text's count is the sum
over its white-space-separated chunks, and each distinct chunk of a slice is counted once. Any other vocabulary file (.json), and any .model file, is counted by its
library on whole texts.

Nulls and empty texts have no tokens; very long texts are whole; null ids stay null; repeated rows stay; any other columns are ignored, so names can't
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import worker_state

#: Chunks that a worker remembers; beyond it the memory starts afresh. It only saves time.
CACHE_WORDS = 300_000
SCHEMA = "n_bytes long, n_tokens long"

# Fixed values of the vocabulary file that the shortcut knows: its rules, and the ASCII case of its pattern.
RULES = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def load(path: str):
    """The tokenizer of a vocabulary file, once for each worker."""
    state = worker_state()
    if path not in state:
        # A task has one core; threads of the library's own would take others' and memory for each.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        state[path] = t
    return state[path]


def shortcut_holds(path: str) -> bool:
    """Whether a vocabulary file has the rules that the shortcut knows."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = ((t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    found = {
        "normalizer": [n["type"] for n in (t.get("normalizer") or {}).get("normalizers", [])],
        "pattern": (steps.get("pattern") or {}).get("Regex") if steps.get("behavior") == "Removed" else None,
        "suffix": t["model"].get("end_of_word_suffix"),
    }
    # Special strings are looked for in chunks that hold `<|` alone.
    return found == RULES and not t.get("post_processor") and all("<|" in x["content"] for x in t.get("added_tokens") or [])


def count_whole(texts: list[str], path: str) -> list[int]:
    """Tokens of whole texts, by the file's library."""
    if not path.endswith(".model"):
        return [len(e.ids) for e in load(path).encode_batch(texts, add_special_tokens=False)]
    state = worker_state()
    if path not in state:
        import sentencepiece

        state[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(x) for x in state[path].encode(texts, num_threads=1)]


def proven_tokens(path: str) -> frozenset[str]:
    """The strings of the vocabulary that, alone, encode as exactly one token and are one pre-token."""
    t = load(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    end = "</w>"
    names = [k[: -len(end)] for k in vocab if k.endswith(end) and k[: -len(end)].isascii()]
    names = [k for k in names if k and k == k.lower() and PRE_TOKENS.findall(k) == [k]]
    return frozenset(k for k, e in zip(names, t.encode_batch(names, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def _count_chunks(chunks: list[str], path: str, proven: frozenset[str]) -> list[int]:
    """Tokens of each chunk. Special strings and non-ASCII chunks go whole to the library, which knows their rules."""
    cache = worker_state().setdefault(("counts", path), {})
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out, rest, parts = [0] * len(chunks), [], []
    for i, w in enumerate(chunks):
        n = 1 if w in proven else cache.get(w)
        if n is not None:
            out[i] = n
        elif w.isascii() and "<|" not in w:
            n, more = 0, []
            for p in PRE_TOKENS.findall(w.lower()):
                if p in proven:
                    n += 1
                elif (k := cache.get(p)) is not None:
                    n += k
                else:
                    more.append(p)
            out[i] = n
            if more:
                rest.append(i)
                parts.append(more)
            else:
                cache[w] = n
        else:
            rest.append(i)
            parts.append([w])
    if rest:
        names = list(dict.fromkeys(p for more in parts for p in more))
        found = dict(zip(names, (len(e.ids) for e in load(path).encode_batch(names, add_special_tokens=False)), strict=True))
        cache.update(found)
        for i, more in zip(rest, parts, strict=True):
            out[i] += sum(found[p] for p in more)
            cache[chunks[i]] = out[i]
    return out


def with_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8) and n_tokens of every row's whole text."""
    holds, table = shortcut_holds(tokenizer_path), words.byte_table(lower=False)
    proven = docs.sparkSession.sparkContext.broadcast(proven_tokens(tokenizer_path) if holds else frozenset())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                text = words.texts(part, "text")
                if holds:
                    flat, per_doc = words.split(text, table)
                    coded = flat.dictionary_encode()
                    each = np.array(_count_chunks(coded.dictionary.to_pylist(), tokenizer_path, proven.value), np.int64)
                    total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])]) if len(flat) else np.zeros(1, np.int64)
                    ends = np.cumsum(per_doc)
                    n = total[ends] - total[ends - per_doc]
                else:
                    n = np.array(count_whole(text.to_pylist(), tokenizer_path), np.int64)
                size = pc.binary_length(text).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
