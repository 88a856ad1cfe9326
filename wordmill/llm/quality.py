"""Quality by weak supervision: rules vote or abstain, expectation-maximisation
estimates how far each can be trusted, and a document is kept if its posterior
probability of good quality is high enough. Only DataFrame functions touch rows.

Words are maximal runs of other characters than space and U+0009-U+000D, code
points are counted, and the whole text is measured, however long. A null text has
no words. Documents with less than 10 words, or more than a fifth of whose words
lie in 5-word windows found twice or more, fail the base whatever the posterior.
Ties and repeated rows are scored row by row. An empty table gives no rows (the
estimates then are the priors). Extra columns pass through `keep` untouched.

The estimates come from one aggregation of all documents to the counts of vote
patterns, of which there are at most 3 to the number of rules. A rule that
abstains says nothing about a document, so rules that know some languages only
(function words) neither help nor hurt the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words that hold a symbol, or no letter: found at their starts only, so the scan stays linear in unbroken text.
ODD_WORD = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]|[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D]))"
#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an not have but they his which you were "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les et des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "de el los y del las por con para su al lo como más pero sus ha "
    "di che è per non sono della ma si nel anche alla una i "
    "o os um uma não mais foi dos da em no na "
    "het een van te dat niet zijn op aan voor met"
).split()
GOOD, BAD, ABSTAIN = 1, -1, 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text holds."""
    total = F.lit(0)
    for c in chars:
        n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        total = total + F.when(F.contains(text, F.lit(c)), n).otherwise(0)
    return total


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of `size` words that are found twice or more in the text.

    Windows are hashed; only where two hashes are equal are they sorted along
    with their positions, so that equal windows stand side by side."""

    def window_hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(size))))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def positions(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))

        return let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(positions(h), covered))

    return let(words, lambda w: F.when(F.size(w) < size, 0).otherwise(let(window_hashes(w), counted))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The base measures, and those that the rules need besides."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    found = let(
        words_of(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(list(dict.fromkeys(FUNCTION_WORDS))))).cast("long").alias("n_function_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return {"w": found, "l": by_line, "word_chars": (F.length(whole) - count_of(whole, BLANKS)).cast("long"), "n_symbols": count_of(whole, SYMBOLS).cast("long"), "n_odd_words": F.regexp_count(whole, F.lit(ODD_WORD)).cast("long")}


def measured(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs plus one struct column of measures."""
    steps = {f"{into}_{k}": c for k, c in measures(F.col(text)).items()}
    out, at = docs.withColumns(steps), F.col
    w, x = at(f"{into}_w"), at(f"{into}_l")
    named = {"n_words": w["n_words"], "word_chars": at(f"{into}_word_chars"), "n_symbols": at(f"{into}_n_symbols"), "n_dup_lines": x["dup"], "n_repeat_words": w["n_repeat_words"], "n_distinct": w["n_distinct"], "n_lines": x["n"], "n_odd_words": at(f"{into}_n_odd_words"), "n_function_words": w["n_function_words"]}
    return out.withColumn(into, F.struct(*[c.alias(k) for k, c in named.items()])).drop(*steps)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def rules(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Votes over the measures: GOOD, BAD or ABSTAIN."""
    n = c("n_words")
    return {
        "length": _vote(n >= 50, n < 10),
        "word_length": _vote(c("word_chars").between(F.lit(4) * n, F.lit(6) * n), ~c("word_chars").between(F.lit(3) * n, F.lit(7) * n)),
        "symbols": _vote(c("n_symbols") * 100 <= n, c("n_symbols") * 10 > n),
        "lines": _vote(c("n_dup_lines") * 20 <= c("n_lines"), c("n_dup_lines") * 10 > c("n_lines") * 4),
        "repeats": _vote(c("n_repeat_words") == 0, c("n_repeat_words") * 5 > n),
        "variety": _vote(c("n_distinct") * 2 > n, (n >= 20) & (c("n_distinct") * 4 < n)),
        "odd_words": _vote(c("n_odd_words") * 20 <= n, c("n_odd_words") * 5 > n),
        "function_words": _vote(c("n_function_words") * 20 >= n, F.lit(False)),
    }


START = {GOOD: 0.85, BAD: 0.75}  # chances, before any document, that a vote fits a good, and a bad document
WEIGHT = 10.0  # documents that those chances count for


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good documents and, for each rule, its accuracies: the
    chance that it votes GOOD on a good document and BAD on a bad one, where it
    votes at all. Starts from START, which also counts as WEIGHT documents a rule,
    so no chance is 0 or 1 and an empty input gives the start back."""
    n_rules = len(patterns[0][0]) if patterns else len(rules())
    share, table = 0.8, [(START[GOOD], START[BAD])] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [(votes, n, n * posterior(votes, share, table)) for votes, n in patterns]
        sure, new = sum(g for _, _, g in good), []
        for k in range(n_rules):
            fits = sum(g for v, _, g in good if v[k] == GOOD), sum(n - g for v, n, g in good if v[k] == BAD)
            cast = sum(g for v, _, g in good if v[k] != ABSTAIN), sum(n - g for v, n, g in good if v[k] != ABSTAIN)
            new.append(tuple((f + WEIGHT * START[x]) / (c + WEIGHT) for f, c, x in zip(fits, cast, (GOOD, BAD), strict=True)))
        moved = max(abs(a - b) for old, now in zip(table, new, strict=True) for a, b in zip(old, now, strict=True))
        share, table = (sure + 0.8 * WEIGHT) / (total + WEIGHT), new
        if moved < 1e-9:
            break
    return share, table


def gains(accuracies: tuple[float, float]) -> dict[int, float]:
    """What each vote of a rule adds to the logarithmic odds of good quality."""
    on_good, on_bad = accuracies
    return {GOOD: math.log(on_good) - math.log1p(-on_bad), BAD: math.log1p(-on_good) - math.log(on_bad), ABSTAIN: 0.0}


def posterior(votes: tuple[int, ...], share: float, table: list[tuple[float, float]]) -> float:
    odds = math.log(share) - math.log1p(-share) + sum(gains(x)[v] for v, x in zip(votes, table, strict=True))
    return 1 / (1 + math.exp(min(700, -odds)))


def judged(docs: DataFrame, into: str = "__quality", text: str = "text", threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all of them by default) plus one struct column: the
    measures, base_failed, quality (the posterior) and kept. The texts are
    measured once, and those columns written with the measures."""
    rows = Table(measured(docs, into, text).select(*(columns or docs.columns), into), "quality").df
    rule = rules(lambda k: F.col(f"{into}.{k}"))
    counted = rows.select(*[v.alias(k) for k, v in rule.items()]).groupBy(*rule).count().orderBy(*rule).collect()  # at most 3 ** len(rules) rows
    share, table = estimate([(tuple(r[:-1]), r[-1]) for r in counted])
    odds = F.lit(math.log(share) - math.log1p(-share))
    for v, seen in zip(rule.values(), table, strict=True):
        gain = gains(seen)
        odds = odds + F.when(v == GOOD, gain[GOOD]).when(v == BAD, gain[BAD]).otherwise(0.0)
    n = F.col(f"{into}.n_words")
    failed = (n < 10) | (F.col(f"{into}.n_repeat_words") * 100 > n * 20)
    posterior_ = 1 / (1 + F.exp(-odds))
    verdict = F.col(into).withField("base_failed", failed).withField("quality", posterior_).withField("kept", ~failed & (posterior_ >= threshold))
    return rows.withColumn(into, verdict)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: key, the base measures, base_failed, quality, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    out = judged(docs.select(key, F.col(text).alias("__text")), "__quality", "__text", threshold, [key])
    return out.select(key, *[f"__quality.{k}" for k in names])


def keep(docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns."""
    return judged(docs).where("__quality.kept").select(*docs.columns)
