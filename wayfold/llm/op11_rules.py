"""Quality rules: whole-text statistics and a learned decision list, with DataFrame functions alone.

Statistics are expressions over a text's words, lines and hashes of words; nothing is shuffled for them. Runs of eight
words are compared by 64-bit hashes inside one text (three pairwise folds of word hashes; two different runs of a text
of a million words meet with a chance below 10^-7).

The list is learned from labelled statistics by sequential covering. Every statistic has up to ``4 * CUTS`` thresholds, quantiles
of each class and the middles between them. A rule grows one comparison at a time, the one with the highest gain (Foil's) on the growing
half of the rows not yet covered, up to ``DEPTH`` comparisons; it is pruned to the prefix that is best on the other half
and kept if at least ``PRECISION`` of what it covers is bad, there and in all (Laplace's estimate). A round is one aggregation whose
partial sums combine map-side; the driver sees counts by statistic and threshold, a table of fixed size. The rules become
one ordered conditional expression. Both halves go by hashes of the statistics, so repeated rows stay together.

Cases: null and empty texts have statistics of zero and fail the base rule; repeated rows get the same verdict; labels
that are null count for nothing, an id with both labels as bad; without rows of both labels no rule is learned and the
base rule alone decides; an empty table gives no rows; columns of ``docs`` pass through, and the new struct takes a name they do
not use. A very long text is one row with arrays of its words' hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name

CUTS, DEPTH, RULES, PRECISION, LEAST = 24, 3, 12, 0.85, 3
#: Words of a repeated run; the base rule's bounds.
RUN, FEW_WORDS, REPEATED_PERCENT = 8, 20, 30
#: What rules may compare, over the columns of ``statistics``.
SHARES = {
    "n_words": "n_words", "mean_word": "word_chars / n_words", "symbols": "n_symbols / n_words", "shouts": "n_shouts / n_words", "capitals": "n_capitals / word_chars", "digits": "n_digits / word_chars",
    "lone_marks": "n_lone_marks / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words", "doubled": "n_doubled / n_words", "distinct": "n_distinct / n_words", "line_words": "n_words / n_lines",
}


def statistics(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with a struct of whole-text counts in column ``out`` (a name that ``rows`` does not use).

    Steps are projections of their own, as an array used twice in one expression would be built twice."""
    # the row travels as one struct, so names below cannot clash with its columns
    shifted = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(0)))
    paired = lambda c, k: F.zip_with(F.col(c), shifted(F.col(c), k), lambda x, y: F.xxhash64(x, y))
    a = rows.select(F.struct("*").alias("row"), F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    a = a.withColumn("w", F.array_remove(F.split(F.regexp_replace("t", "[\\x09-\\x0D]", " "), " "), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rest = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    size = F.length("t")
    a = a.select(
        "row", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), rest("[\\x20\\x09-\\x0D]+").alias("c"), (size - rest("[#*$%&|<>]+")).alias("s"), (size - rest("[!?]+")).alias("e"), (size - rest("[A-Z]+")).alias("u"), (size - rest("[0-9]+")).alias("d"),
        F.size(F.filter("w", lambda x: (F.length(x) == 1) & x.rlike("[^A-Za-z0-9\\x80-\\x{10FFFF}]"))).alias("m"), lines.alias("l"),
    )
    count = lambda c: c.cast("bigint")
    doubled = F.aggregate(F.zip_with("h", shifted(F.col("h"), 1), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    sums = {
        "n_words": F.size("h"), "word_chars": F.col("c"), "n_symbols": F.col("s"), "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_shouts": F.col("e"), "n_capitals": F.col("u"), "n_digits": F.col("d"),
        "n_lone_marks": F.col("m"), "n_doubled": doubled, "n_distinct": F.size(F.array_distinct("h")),
    }
    a = a.select("row", "h", F.struct(*[count(v).alias(k) for k, v in sums.items()]).alias("s"))
    a = a.withColumn("p", paired("h", 1))
    a = a.withColumn("p", paired("p", 2))
    a = a.withColumn("p", F.slice(paired("p", 4), 1, F.greatest(F.size("h") - (RUN - 1), F.lit(0))))
    # only texts with a run that comes again are sorted
    again = F.size(F.array_distinct("p")) < F.size("p")
    a = a.withColumn("z", F.when(again, F.sort_array(F.transform("p", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    both = F.zip_with("z", shifted(F.col("z"), 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    a = a.withColumn("z", F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))))
    steps = F.zip_with("z", shifted(F.col("z"), 1), lambda x, y: F.least(F.coalesce(y - x, F.lit(RUN)), F.lit(RUN)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0))
    return a.select("row.*", F.col("s").withField("n_repeat_words", count(covered)).alias(out))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < FEW_WORDS) | (100 * s["n_repeat_words"] > REPEATED_PERCENT * s["n_words"])


def shares(s: Column) -> list[Column]:
    """The compared numbers; a division by zero gives 0."""

    def number(rule: str) -> Column:
        top, _, below = rule.partition(" / ")
        return s[top].cast("double") if not below else F.when(s[below] > 0, s[top] / s[below]).otherwise(F.lit(0.0))

    return [number(r).alias(k) for k, r in SHARES.items()]


@dataclass(frozen=True)
class Test:
    """``share`` at most ``bound``, or above it."""

    share: str
    bound: float
    above: bool

    def holds(self, value: Column) -> Column:
        return value > self.bound if self.above else value <= self.bound


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions that reject, in order; what none covers is kept."""

    rules: tuple[tuple[Test, ...], ...] = ()

    def covers(self, rule: tuple[Test, ...], values: dict[str, Column]) -> Column:
        return reduce(lambda x, y: x & y, [t.holds(values[t.share]) for t in rule])

    def keeps(self, values: dict[str, Column]) -> Column:
        """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false … ELSE true."""
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(self.covers(rule, values), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self, values: dict[str, Column]) -> Column:
        """Number of the first rule that covers the row, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(self.covers(rule, values), F.lit(k)).otherwise(out)
        return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]] | None:
    """Quantiles of each class and the middles between neighbours; None where a class lacks."""
    marks = [k / CUTS for k in range(CUTS + 1)]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(k, marks, 2000).alias(k) for k in SHARES]).collect()
    if len(got) < 2:
        return None
    out = {}
    for k in SHARES:
        values = sorted({float(v) for r in got for v in r[k]})
        out[k] = sorted({*values[:-1], *((x + y) / 2 for x, y in zip(values, values[1:]))})
    return out


def _gain(p, n, p0, n0):
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(rows: DataFrame) -> DecisionList:
    """``rows``: a boolean ``bad`` and the columns of ``SHARES``. One aggregation for each comparison and one a rule."""
    values = {k: F.col(k) for k in SHARES}
    half = F.pmod(F.xxhash64(*SHARES), F.lit(2)) == 0
    rows = cut(rows.withColumn("growing", half))
    if (bounds := _thresholds(rows)) is None:
        return DecisionList()
    # a value's place among its thresholds: the number of those below it
    place = lambda k: F.size(F.filter(F.array(*[F.lit(b) for b in bounds[k]]), lambda b: F.col(k) > b)) if bounds[k] else F.lit(0)
    placed = cut(rows.select("bad", "growing", *SHARES, F.array(*[F.struct(F.lit(k).alias("k"), place(k).alias("b")) for k in SHARES]).alias("places")))
    found = DecisionList()

    def counts(at: DataFrame) -> dict[str, list[list[int]]]:
        out = {k: [[0, 0] for _ in range(len(bounds[k]) + 1)] for k in SHARES}
        for r in at.select("bad", F.explode("places").alias("x")).groupBy("x", "bad").count().collect():
            out[r["x"]["k"]][r["x"]["b"]][r["bad"]] += r["count"]
        return out

    while len(found.rules) < RULES:
        left, rule = placed.filter(found.keeps(values)), ()
        for _ in range(DEPTH):
            at = left.filter("growing")
            table = counts(at.filter(found.covers(rule, values)) if rule else at)
            n0, p0 = (sum(b[j] for b in table["n_words"]) for j in (0, 1))
            if not n0 or not p0:
                break
            tried = []
            for k in SHARES:
                n = p = 0
                for b, bound in enumerate(bounds[k]):
                    n, p = n + table[k][b][0], p + table[k][b][1]
                    tried += [(round(_gain(q, m, p0, n0), 9), Test(k, bound, above)) for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)) if q >= LEAST]
            most = max((g for g, _ in tried), default=0)
            if most <= 0:
                break
            first = next(t for g, t in tried if g == most)
            # of thresholds that part the rows alike, the middle one
            alike = [t for g, t in tried if g == most and (t.share, t.above) == (first.share, first.above)]
            rule += (alike[len(alike) // 2],)
        if not rule:
            break
        prefixes = [found.covers(rule[: k + 1], values) for k in range(len(rule))]
        sums = [F.count_if(c & (F.col("bad") == j) & (F.col("growing") == g)).alias(f"{k}_{int(j)}_{int(g)}") for k, c in enumerate(prefixes) for j in (False, True) for g in (False, True)]
        r = left.agg(*sums).first()
        laplace = lambda good, bad: (bad + 1) / (good + bad + 2)
        k = max(range(len(rule)), key=lambda k: (laplace(r[f"{k}_0_0"], r[f"{k}_1_0"]), -k))
        good, bad = (r[f"{k}_{j}_0"] + r[f"{k}_{j}_1"] for j in (0, 1))
        if laplace(good, bad) < PRECISION or r[f"{k}_1_0"] < PRECISION * (r[f"{k}_0_0"] + r[f"{k}_1_0"]):
            break
        found = DecisionList((*found.rules, rule[: k + 1]))
    return found


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, stats: str) -> DataFrame:
    """Rows of ``learn``: documents with a label that the base rule leaves undecided, bad where any label of theirs is 0."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 0).alias("bad"))
    return rows.select(F.col(id_col).alias("_at"), F.col(stats).alias("_s")).filter(~base_failed(F.col("_s"))).join(known, F.col("_at") == F.col("_id")).select("bad", *shares(F.col("_s")))


def verdict(s: Column, found: DecisionList) -> Column:
    return ~base_failed(s) & found.keeps(dict(zip(SHARES, shares(s))))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "rules") -> DataFrame:
    """All columns of ``docs`` and a struct of the statistics, ``base_failed``, ``kept`` and ``rule`` (the rule that fired)."""
    out = free_name(docs, out)
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(labels.filter("quality is not null").select(F.col("doc_id").alias("i")).distinct(), "i")
    found = learn(labelled(statistics(known.select("i", "t"), F.col("t"), "s").select("i", "s"), labels, "i", "s"))
    s = F.col(out)
    return statistics(docs, F.col(text_col), out).withColumn(out, s.withField("base_failed", base_failed(s)).withField("kept", verdict(s, found)).withField("rule", found.fired(dict(zip(SHARES, shares(s))))))


def op11_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics once, in a narrow table; the list is learned on its labelled rows and applied to all."""
    rows = cut(statistics(docs.select("doc_id", "text"), F.col("text"), "s").select("doc_id", "s"))
    found = learn(labelled(rows, labels, "doc_id", "s"))
    s = F.col("s")
    return rows.select("doc_id", *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(s).alias("base_failed"), verdict(s, found).alias("kept"))
