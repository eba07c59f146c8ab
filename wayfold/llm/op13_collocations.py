"""Phrase collocation mining: n-grams as rows, hash aggregation per language, exact scores, whole phrases before their parts.

Every occurrence of a run of 1 to ``max_n`` words inside a piece is a row; the grouped count combines on the map side, so
a phrase that fills a third of the corpus costs the reducer one row a task. Words and pairs are counted first, then each further length, so
that the shuffle of one goes before the next. Phrases below ``least`` cannot be part of a
candidate (a part is at least as frequent as the whole), so only frequent ones are written. Candidates then meet the
counts of their first and last parts by joins, which adaptive skew handling splits where one part is very common. Scores
are Decimals of 38 digits, exact up to counts of 10^16 and products of 10^38. A phrase whose one-word extension keeps
``share`` percent of its occurrences goes; longer extensions need no join of their own, as the run between is at least
as frequent. Ranks are taken within 64 hash classes a language first, so the last sort sees 64 * top rows a language.

Cases: null text counts as empty, null language as ``und`` (together with a language named so); repeated rows count as
often as they stand; ties are ordered by phrase, so ranks are unique; texts without words and empty tables give no rows;
further columns of ``docs`` are not read. A very long text is one row of words, dealt out by the explosion.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, release

#: Ends of pieces.
PIECES = "[.,;:!?\\x0A-\\x0D]"
CLASSES = 64


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, shortest: int, longest: int) -> DataFrame:
    """(lang, phrase, f) of all runs of ``shortest`` to ``longest`` words; where single words are among them, the empty phrase
    carries the language's number of words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # tabs part words as spaces do, and become such on the way; for ASCII the plain lower() says the same, far faster
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    pieces = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(F.replace(lowered, F.lit("\t"), F.lit(" ")), PIECES)).alias("piece"))
    words = pieces.select(F.concat("lang", F.lit("\n")).alias("lead"), F.array_remove(F.split("piece", " "), "").alias("g1")).filter(F.size("g1") > 0)
    names = [f"g{k + 1}" for k in range(longest)]
    moved = words.select("lead", F.size("g1").cast("bigint").alias("m"), "g1", *[F.slice("g1", k + 1, F.size("g1")).alias(names[k]) for k in range(1, longest)])
    total = F.array(F.struct(F.lit("").alias("g1"), *[F.lit(None).cast("string").alias(x) for x in names[1:]]))
    places = moved.select("lead", "m", F.explode(F.concat(F.arrays_zip(*names), total)).alias("g"))
    # one string as key, language first: words hold no line feed; runs past a piece's end are null
    begun = [F.concat("lead", "g.g1", *[x for n in names[1:k] for x in (F.lit(" "), F.col(f"g.{n}"))]) for k in range(shortest, longest + 1)]
    rows = places.select(F.when(F.col("g.g1") == "", F.col("m")).otherwise(1).alias("c"), (F.explode(F.array(*begun)) if len(begun) > 1 else begun[0]).alias("key"))
    counts = rows.filter("key is not null").groupBy("key").agg(F.sum("c").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    return counts.select(F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


def _run(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def cut_scores(frequent: DataFrame, candidates: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the cut with the lowest score, the earliest of equals."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _run(F.col("w"), F.lit(1), F.col("k")).alias("first"), _run(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(scale).cast("decimal(7,0)"), exact("l") * exact("r"))
    lowest = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy("lang", "phrase", "a").agg(F.min("x").alias("x"))
    return lowest.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def whole_phrases(candidates: DataFrame, share: int = 50) -> DataFrame:
    """Candidates that no one-word extension mostly replaces."""
    words = F.split("phrase", " ")
    inner = F.array(_run(words, F.lit(1), F.size(words) - 1), _run(words, F.lit(2), F.size(words) - 1))
    longer = candidates.filter(F.size(words) > 2).select("lang", F.explode(inner).alias("part"), "a").groupBy("lang", "part").agg(F.max("a").alias("most"))
    c, x = candidates.alias("c"), longer.alias("x")
    return c.join(x, (F.col("c.lang") == F.col("x.lang")) & (F.col("phrase") == F.col("part")) & (100 * F.col("most") >= share * F.col("a")), "left_anti")


def first_ranks(scored: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(CLASSES))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``max_n`` words: lang, rank, phrase, a, l, r, n, score."""
    frequent = None
    for shortest, longest in ((1, min(2, max_n)), *((k, k) for k in range(3, max_n + 1))):
        counts = phrase_counts(docs, text_col, lang_col, shortest, longest)
        part = cut(counts.filter((F.col("f") >= least) | (F.col("phrase") == "")))
        frequent = part if frequent is None else frequent.union(part)
        del counts
        release(docs.sparkSession)
    totals = frequent.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    candidates = frequent.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"))
    ranked = first_ranks(cut_scores(frequent, whole_phrases(candidates, share)), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(generate_series(1, len(w) - k + 1)) AS i, w FROM w, (VALUES (1), (2), (3)) x(k)),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k AS m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS phrase, a FROM c WHERE m = 3),
own AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 50 * c.a)),
cuts AS (SELECT own.*, unnest(generate_series(1, m - 1)) AS k FROM own),
s AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cuts.k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cuts.k + 1:m], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS b FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""
