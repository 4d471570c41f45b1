"""URL rules by a bit-parallel wildcard automaton.

A rule is a glob over a canonical URL: `*` stands for any run of characters other than `/`, `**` for any run at all. All
rules are laid end to end in one bit vector of several 64-bit words. A character advances every rule at once: states move
by one bit where the character's mask allows it, states before a wildcard also stay, and empty wildcards are followed
at once (a rule never has two wildcards in a row). The same step runs over all URLs of a batch together, and ends once all states that live are closing `**`:
a long path costs no more than its rules look at.

Canonical URL: host (after the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased) followed by path (then up to
`?`, `#` or the end). A null URL, or one without `://`, has an empty host and path, so no host rule fits it.

The longest fitting rule decides (equally long: the earlier in the list); where none fits, the default verdict holds.
Extra columns of any name are ignored; repeated rows and null ids stay; very long URLs are matched whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Characters of URLs that one automaton run holds at a time; longer URLs are still read whole.
RUN_CHARS = 1 << 20


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains where the URL's path starts with path. name: host and path together."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class ShiftAnd:
    """All globs as one multiword automaton. match() tells for each text which globs fit it as a whole."""

    def __init__(self, globs: list[str]):
        starts, finals, items, at = [], [], [], 0
        for g in globs:
            tokens, i = [], 0
            while i < len(g):
                if g[i] == "*":
                    wide = g[i : i + 2] == "**"
                    i += 2 if wide else 1
                    if tokens and tokens[-1] in ("*", "**"):
                        tokens[-1] = "**" if wide or tokens[-1] == "**" else "*"
                    else:
                        tokens.append("**" if wide else "*")
                else:
                    tokens.append("=" + g[i])
                    i += 1
            starts.append(at)
            items.append((at, tokens))
            at += len(tokens) + 1  # one state before each token, and one after the last
            finals.append(at - 1)
        self.n_globs, self.n_words = len(globs), max(1, -(-at // 64))
        chars = sorted({t[1] for _, tokens in items for t in tokens if t[0] == "="} | {"/"})
        self.classes = {ord(c): k + 1 for k, c in enumerate(chars)}  # class 0: any other character
        self.move = np.zeros((len(chars) + 1, self.n_words), np.uint64)  # states that a character leads to
        self.stay = np.zeros((len(chars) + 1, self.n_words), np.uint64)  # wildcards that take the character
        slash, skips = self.classes[ord("/")], []
        for k in range(len(chars) + 1):
            to, loop = [], []
            for base, tokens in items:
                for j, t in enumerate(tokens):
                    if t[0] == "=" and k and self.classes[ord(t[1])] == k:
                        to.append(base + j + 1)
                    elif t == "**" or t == "*" and k != slash:
                        loop.append(base + j)
            self.move[k], self.stay[k] = self._pack(to), self._pack(loop)
        for base, tokens in items:
            skips += [base + j for j, t in enumerate(tokens) if t in ("*", "**")]
        self.skips = self._pack(skips)
        # States that no further character changes: a closing `**` and the end after it.
        self.closing = self._pack([b + len(t) - k for b, t in items if t and t[-1] == "**" for k in (0, 1)])
        self.start = self._closed(self._pack(starts)[None, :])[0]
        self.final_word = np.array([f // 64 for f in finals], np.int64)
        self.final_bit = np.array([f % 64 for f in finals], np.uint64)

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    @staticmethod
    def _shifted(d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, d: np.ndarray) -> np.ndarray:
        return d | self._shifted(d & self.skips)

    def match(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        out = np.zeros((len(texts), self.n_globs), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            # Texts of like length run together, so that the padded matrix stays small.
            width = max(1, len(texts[order[at]]))
            group = order[at : at + max(1, RUN_CHARS // width)]
            out[group] = self._run([texts[i] for i in group])
            at += len(group)
        return out

    def _run(self, texts: list[str]) -> np.ndarray:
        lens = np.array([len(t) for t in texts])  # falling
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.zeros(len(codes), np.uint16)
        for c, k in self.classes.items():
            kinds[codes == c] = k
        begins = np.cumsum(lens) - lens
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        for pos in range(int(lens[0]) if len(lens) else 0):
            n = int(np.searchsorted(-lens, -pos, side="left"))  # texts longer than pos
            k, d = kinds[begins[:n] + pos], state[:n]
            if not (d & ~self.closing).any():
                break
            state[:n] = self._closed((self._shifted(d) & self.move[k]) | (d & self.stay[k]))
        return (state[:, self.final_word] >> self.final_bit & np.uint64(1)).astype(bool)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[HostRule], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule and verdict of every row. The rule list is compiled once and sent with the task."""
    globs = [g for r in rules for g in r.globs()]
    owner = np.array([i for i, r in enumerate(rules) for _ in r.globs()], np.int64)
    automaton = ShiftAnd(globs)
    # The longest first; among equals the earlier. The last entry stands for no rule.
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    best = np.empty(len(rules), np.int64)
    best[rank] = np.arange(len(rules))
    names = np.array([rules[i].name for i in rank] + [None], object)
    verdicts = np.array([rules[i].verdict for i in rank] + [default], object)

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def verdict(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in urls:
            fits = automaton.match(s.tolist())
            place = np.where(fits, best[owner][None, :] if len(owner) else 0, len(rules)).min(axis=1, initial=len(rules))
            yield pd.DataFrame({"rule": names[place], "verdict": verdicts[place]})

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = own.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.withColumn("v", verdict(F.concat("host", "path")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "v.rule", "v.verdict")
