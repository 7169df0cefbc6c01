"""Quality rules: a learned decision list over text statistics, in DataFrame operations only.

Sequential covering (after Cohen, "Fast effective rule induction", 1995): conjunctions of thresholds are grown on one part
of the labelled rows by information gain, pruned on the other, and the rows they cover are set aside. What is
learned becomes an ordered chain of Spark conditional expressions. Statistics of labelled rows are summed by Spark
for all thresholds at once; the driver sees one row of sums for each step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Thresholds tried for a statistic lie at these quantiles of the labelled rows that pass the base rule; the tails are finer.
QUANTILES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998)
#: Rules of a list, conditions of a rule, its least precision on the pruning part, the bad rows it must cover, and rules given up.
MAX_RULES, MAX_LITERALS, LEAST_PRECISION, LEAST_COVERED, MAX_REJECTED = 6, 3, 0.8, 5, 4
WINDOW = 8
SPACES = "\t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """Bind an expression once, so that a lambda does not evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str, by: str = "") -> Column:
    """Each of the characters replaced; a byte search for every one, which is far cheaper than translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(without(text, SPACES, " "), " "), "")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for every window of WINDOW words."""

    def body(w):
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    return F.when(F.size(words) >= WINDOW, _let(words, body)).otherwise(F.array().cast("array<bigint>"))


def _repeated(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice: sorted by hash, equal neighbours give the places to cover."""

    def marked(s):
        at = F.sequence(F.lit(0), F.size(s) - 1)
        near = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(at, lambda i: near(i, i - 1) | near(i, i + 1)), lambda i: F.get(s, i)["i"]))

    def covered(p):
        at = F.sequence(F.lit(0), F.size(p) - 1)
        return F.aggregate(at, F.lit(0).cast("bigint"), lambda n, i: n + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))))

    def body(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(_let(pairs, marked), covered)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(hashes, body)).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each text: the contract's columns, and those that only the rules use."""
    t = F.col("__t")
    rows = docs.select(*keep, text_of().alias("__t"))
    rows = rows.select(*keep, "__t", words_of(t).alias("__w"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES + " ")) != "").alias("__l"))
    # one pass leaves the characters that are counted, mostly few; counts are taken from them
    rows = rows.withColumns({"__h": _window_hashes(F.col("__w")), "__c": F.regexp_replace(t, r"[^#*$%&|<>0-9!?A-Z]+", "")})
    count = lambda chars: F.char_length(F.regexp_replace("__c", f"[^{chars}]+", ""))
    return rows.select(
        *keep,
        F.size("__w").cast("bigint").alias("n_words"),
        F.char_length(without(t, SPACES + " ")).cast("bigint").alias("word_chars"),
        count("#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("__h")).alias("n_repeat_words"),
        F.size("__l").cast("bigint").alias("n_lines"),
        count("0-9").cast("bigint").alias("n_digits"),
        count("!?").cast("bigint").alias("n_shouts"),
        count("A-Z").cast("bigint").alias("n_capitals"),
        F.size(F.array_distinct("__w")).cast("bigint").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios the rules may test. An empty text has 0 in all of them."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": over("word_chars", "n_words"),
        "symbols": over("n_symbols", "word_chars"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "digits": over("n_digits", "word_chars"),
        "shouts": over("n_shouts", "word_chars"),
        "capitals": over("n_capitals", "word_chars"),
        "distinct": over("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Literal:
    name: str
    above: bool
    cut: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] > self.cut if self.above else of[self.name] <= self.cut

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that any of them matches is dropped, others are kept."""

    rules: tuple[tuple[Literal, ...], ...]

    def keeps(self, of: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            holds = _both([x.column(of) for x in rule])
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self):
        return "\n".join(["drop if " + " and ".join(map(str, r)) for r in self.rules] + ["else keep"])


def _both(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """learn_from() the statistics of documents."""
    return learn_from(statistics(docs), labels)


def learn_from(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """Fit a list that drops what labels call quality 0.

    Labels with a null doc_id or quality are left out, and so are documents labelled both ways; repeated labels count
    once. Texts that the base rule drops teach nothing. A rule below LEAST_PRECISION on the pruning part is given up, and its first condition is
    not tried again. Without labels of both kinds, or without a good rule, the list keeps all.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id"))
    marks = marks.agg(F.min("quality").alias("bad"), F.max("quality").alias("most")).where("bad = most").select("__id", (F.col("bad") == 0).alias("bad"))
    # counts are joined, not texts, so what is shuffled is a few numbers a document
    known = stats.where(~base_failed()).withColumnRenamed("doc_id", "__id").join(marks, "__id")
    names = list(features())
    rows = known.select("bad", (F.pmod(F.xxhash64(F.lit("prune"), "__id"), F.lit(3)) == 0).alias("pruning"), *(c.alias(n) for n, c in features().items()))
    rows = materialize(rows, "quality-labelled")
    of = {n: F.col(n) for n in names}
    found = rows.agg(*(F.percentile_approx(n, list(QUANTILES), 10_000).alias(n) for n in names)).first()
    literals = [Literal(n, above, cut) for n in names for cut in sorted(set(found[n] or ())) for above in (True, False)]
    left = rows
    rules: list[tuple[Literal, ...]] = []
    rejected = 0

    def sums(part: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
        """(bad, good) rows of a part for which each test holds."""
        both = [F.count_if(t & kind) for t in tests for kind in (F.col("bad"), ~F.col("bad"))]
        row = part.agg(*(c.alias(f"c{i}") for i, c in enumerate(both))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(tests))]

    while literals and len(rules) < MAX_RULES and rejected <= MAX_REJECTED:
        grown: list[Literal] = []
        part = left.where("not pruning")
        while len(grown) < MAX_LITERALS:
            (p0, n0), *counts = sums(part, [F.lit(True), *(x.column(of) for x in literals)])
            if p0 < LEAST_COVERED or not n0:
                break
            before = math.log2(p0 / (p0 + n0))
            gains = [p * (math.log2(p / (p + n)) - before) if p >= LEAST_COVERED else 0.0 for p, n in counts]
            k = max(range(len(gains)), key=lambda i: (gains[i], -i))
            if gains[k] <= 1e-9:
                break
            grown.append(literals[k])
            part = part.where(literals[k].column(of))
        if not grown:
            break
        counts = sums(left.where("pruning"), [_both([x.column(of) for x in grown[: k + 1]]) for k in range(len(grown))])
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i))
        if (worth[k] + 1) / 2 < LEAST_PRECISION:
            rejected += 1
            literals = [x for x in literals if (x.name, x.above) != (grown[0].name, grown[0].above)]
            continue
        rules.append(tuple(grown[: k + 1]))
        left = left.where(~_both([x.column(of) for x in rules[-1]]))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, and kept.

    Null text has no words and fails the base rule, as does any text under 20 words. Texts are read whole, once, and never
    shuffled; repeated rows give repeated results; other columns are ignored.
    """
    stats = materialize(statistics(docs), "quality-statistics")
    verdict = learn_from(stats, labels).keeps(features())
    failed = base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(verdict).alias("kept")
    )
