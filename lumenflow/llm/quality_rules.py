"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes bad, good or abstains. Documents are counted per pattern of votes (at most 3^rules
patterns). On these counts the share of good documents and each rule's accuracy are estimated, apart
for good documents (how often it wrongly says bad) and bad ones (how often it notices), because one
kind of junk trips one rule only. The posterior probability of good decides, instead of asking that
all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.store import saved

SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_chars", "n_lines")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains (SQL on the measures)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("density", "n_symbols > n_words", "4 * n_symbols <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
)


@dataclass(frozen=True)
class QualityConfig:
    """``rounds`` of expectation-maximisation; ``cut``: least posterior that is kept.

    ``false_alarm`` and ``notice`` (start, least, most) are a rule's chances of a bad vote on good and
    on bad documents; the bounds keep a rule from being read as its own opposite.
    """

    rules: tuple[Rule, ...] = RULES
    rounds: int = 20
    good_share: float = 0.8
    false_alarm: tuple[float, float, float] = (0.02, 0.001, 0.05)
    notice: tuple[float, float, float] = (0.3, 0.1, 0.9)
    cut: float = 0.5


def measured(docs: DataFrame, carry: bool = True) -> DataFrame:
    """doc_id, the measures of the whole text, and with ``carry`` the row itself as struct ``row``."""
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        "doc_id",
        *rows,
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_upper"),
        F.length(text).cast("long").alias("n_chars"),
    )
    kept = ["doc_id", *(["row"] if carry else []), "word_chars", "n_symbols", "n_upper", "n_chars"]
    w = F.col("w")
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
    )
    step = step.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(windows).alias("s"),
    )
    s = F.col("s")

    def equal(k: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))

    again = F.filter(s, lambda x, k: equal(k - 1, x) | equal(k + 1, x))
    step = step.withColumn("starts", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    step = step.withColumn("n_repeat_words", covered)
    return step.select("doc_id", *(["row"] if carry else []), *MEASURES)


def vote_code(rules: tuple[Rule, ...]) -> Column:
    """The votes as digits to base 3: 0 abstains, 1 bad, 2 good."""
    code = F.lit(0)
    for rule in rules:
        vote = F.when(F.expr(rule.bad), 1).when(F.expr(rule.good), 2).otherwise(0)
        code = code * 3 + vote
    return code.cast("int")


def digits(code: int, width: int) -> list[int]:
    return [code // 3 ** (width - 1 - k) % 3 for k in range(width)]


@dataclass(frozen=True)
class Fit:
    share: float
    false_alarm: tuple[float, ...]
    notice: tuple[float, ...]

    def posterior(self, votes: list[int]) -> float:
        """Probability of good, given votes that are independent within good and bad documents."""
        odds = math.log(self.share / (1 - self.share))
        for vote, a, b in zip(votes, self.false_alarm, self.notice, strict=True):
            if vote:
                odds += math.log(a / b) if vote == 1 else math.log((1 - a) / (1 - b))
        return 1 / (1 + math.exp(-odds))


def fit(counts: dict[int, int], config: QualityConfig) -> Fit:
    """Share of good documents and both accuracies of each rule from the counts per vote pattern."""
    width = len(config.rules)
    now = Fit(config.good_share, (config.false_alarm[0],) * width, (config.notice[0],) * width)
    total = sum(counts.values())

    def within(hits: float, all_: float, start: float, least: float, most: float) -> float:
        return min(max(hits / all_, least), most) if all_ else start

    for _ in range(config.rounds if total else 0):
        good = 0.0
        cast = [[0.0, 0.0] for _ in range(width)]  # weight of votes in good and in bad documents
        bad_votes = [[0.0, 0.0] for _ in range(width)]
        for code in sorted(counts):
            n, votes = counts[code], digits(code, width)
            p = now.posterior(votes)
            good += n * p
            for j, vote in enumerate(votes):
                for c, weight in enumerate((n * p, n * (1 - p))):
                    cast[j][c] += weight * (vote > 0)
                    bad_votes[j][c] += weight * (vote == 1)
        now = Fit(
            min(max(good / total, 0.05), 0.95),
            tuple(within(bad_votes[j][0], cast[j][0], *config.false_alarm) for j in range(width)),
            tuple(within(bad_votes[j][1], cast[j][1], *config.notice) for j in range(width)),
        )
    return now


def judge(docs: DataFrame, config: QualityConfig = QualityConfig(), carry: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, measures, base_failed, posterior, kept, and the row as struct ``row``.

    Null text has no words. Repeated rows are judged alike, each on its own; an empty table gives an
    empty one. The measured table is written once, since all votes must be counted before any verdict.
    """
    table = saved(measured(docs, carry).withColumn("code", vote_code(config.rules)))
    width = len(config.rules)
    counts = {r.code: r.n for r in table.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3^rules
    found = fit(counts, config)
    chances = F.expr("array({})".format(", ".join(f"{found.posterior(digits(c, width))!r}D" for c in range(3**width))))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = table.withColumn("base_failed", base)
    table = table.withColumn("posterior", F.element_at(chances, F.col("code") + 1))
    return table.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= config.cut))


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return judge(docs, config).filter("kept").select("row.*")
