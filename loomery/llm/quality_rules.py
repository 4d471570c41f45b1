"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1) or bad (-1) or abstains (0) on a document. A latent two-class model holds, for each rule and class,
how often the rule votes each way where it votes (abstaining says nothing); expectation-maximisation estimates these rates (a rule's accuracies) and the share of
good documents from how votes agree over the whole corpus, without labels. The posterior probability of the good class
decides, in place of all rules having to pass.

EM needs only how many documents cast each combination of votes. Seven rules have at most 3^7 = 2187 combinations, at any corpus
size; those counts, and nothing else, reach the driver.

Null and empty texts have no words: every count is 0, and the length rule votes bad. Words are runs of characters other than space and 0x09-0x0D.
Very long texts are counted whole, in arrays of one row. Repeated rows and ties are judged alike; null ids stay null. Extra columns of any name
are ignored (only id and text are read); an empty table gives an empty result and a model without evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes value once and uses it in body any number of times, also within other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the array."""

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    return let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


STATS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def stats_of(text: Column) -> Column:
    """A struct of STATS of a text: words, their characters, symbols, capitals, lines and repeated lines (of lines with a word), words in repeated windows."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)

    def struct(w: Column, rows: Column) -> Column:
        n_lines = F.size(rows)
        values = (
            F.size(w), _without(text, _SPACES), F.length(text) - _without(text, _SYMBOLS), F.length(text) - _without(text, _UPPER),
            n_lines, n_lines - F.size(F.array_distinct(rows)), repeated_words(w),
        )
        return F.struct(*[v.cast("long").alias(name) for name, v in zip(STATS, values, strict=True)])

    return let(words_of(text), lambda w: let(lines, lambda rows: struct(w, rows)))


def within(stats: str, sql: str) -> Column:
    """An SQL expression over the names in STATS, in which the struct column stats is read once, so that nothing moves or copies its computation."""
    named = re.sub(r"\b(" + "|".join(STATS) + r")\b", r"s.\1", sql)
    return F.expr(f"get(transform(array({stats}), s -> {named}), 0)")


@dataclass(frozen=True)
class Rule:
    name: str
    good: str
    bad: str


#: Votes by SQL predicates over text_stats; a rule with neither predicate true abstains.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("symbols_by_word", "20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    Rule("symbols_by_character", "100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("capitals", "5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    Rule("repeated_lines", "n_lines > 1 and 10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    Rule("repeated_words", "5 * n_repeat_words <= n_words", "2 * n_repeat_words > n_words"),
)


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents. rates[rule][class][vote], class 0 bad and 1 good, vote 0 bad, 2 good; 1 (abstain) is 1 for either class."""

    prior: float
    rates: tuple[tuple[tuple[float, float, float], ...], ...]

    def accuracy(self, rule: int) -> tuple[float, float]:
        """Of the documents a rule votes on: the share of bad ones it votes bad, of good ones it votes good."""
        (b, _, bg), (gb, _, g) = self.rates[rule]
        return b / (b + bg), g / (g + gb)

    def weights(self) -> list[list[float]]:
        return [[math.log(good / bad) for bad, good in zip(*r, strict=True)] for r in self.rates]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(w[v + 1] for w, v in zip(self.weights(), votes, strict=True))


def fit_votes(counts: dict[tuple[int, ...], int], n_rules: int, rounds: int = 100) -> VoteModel:
    """EM over the counts of vote combinations. Starts from documents without a bad vote being mostly good."""
    total = sum(counts.values())
    if not total:
        return VoteModel(0.5, tuple(((0.5, 1.0, 0.5),) * 2 for _ in range(n_rules)))
    good = {v: 0.05 if -1 in v else 0.95 for v in counts}
    model = None
    for _ in range(rounds):
        n_good = sum(good[v] * n for v, n in counts.items())
        rates = []
        for j in range(n_rules):
            sums = [[1.0, 0.0, 1.0], [1.0, 0.0, 1.0]]  # one document of each vote more, so that no rate is 0
            for v, n in counts.items():
                if v[j]:
                    sums[1][v[j] + 1] += n * good[v]
                    sums[0][v[j] + 1] += n * (1 - good[v])
            rates.append(tuple((b / (b + g), 1.0, g / (b + g)) for b, _, g in sums))
        new = VoteModel((n_good + 1) / (total + 2), tuple(rates))
        good = {v: 1 / (1 + math.exp(-max(-700.0, min(700.0, new.log_odds(v))))) for v in counts}
        if model and abs(new.prior - model.prior) < 1e-9:
            return new
        model = new
    return model


def _voted(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), stats_of(F.col(text_col)).alias("stats"))
    vote = ", ".join(f"CAST(CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS TINYINT)" for r in rules)
    both = within("stats", f"named_struct('votes', array({vote}), 'stats', s)")
    return own.select("id", both.alias("b")).select("id", "b.stats.*", "b.votes")


def _fitted(votes: DataFrame, n_rules: int) -> VoteModel:
    return fit_votes({tuple(r.votes): r["count"] for r in votes.groupBy("votes").count().collect()}, n_rules)


def fit_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """The model of how the rules vote on all documents. Nothing is written."""
    return _fitted(_voted(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text", rules).select("votes"), len(rules))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """id, the statistics, votes (array in the order of rules), quality (posterior of good) and good (quality >= least)."""
    voted = stash(_voted(docs, id_col, text_col, rules), "votes")
    model = _fitted(voted, len(rules))
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, w in enumerate(model.weights()):
        odds = odds + F.get(F.array(*[F.lit(float(x)) for x in w]), F.get("votes", F.lit(j)) + 1)
    quality = 1 / (1 + F.exp(-odds))
    return voted.withColumn("quality", quality).withColumn("good", F.col("quality") >= least).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: VoteModel, text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows that a model finds good and that don't fail the rule of thumb. Nothing is written or shuffled; the texts are read once more."""
    terms = [f"CAST({math.log(model.prior / (1 - model.prior))!r} AS DOUBLE)"]
    terms += [f"CASE WHEN {r.bad} THEN CAST({bad!r} AS DOUBLE) WHEN {r.good} THEN CAST({good!r} AS DOUBLE) ELSE 0D END" for r, (bad, _, good) in zip(rules, model.weights(), strict=True)]
    good = within("stats", f"({' + '.join(terms)}) >= {math.log(least / (1 - least))!r}D AND NOT ({BASE_FAILED})")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), stats_of(docs[text_col]).alias("stats"))
    return own.filter(good).select("row.*")


#: The rule of thumb that holds beside the votes: too short, or mostly repeated word windows.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def base_failed() -> Column:
    return F.expr(BASE_FAILED)
