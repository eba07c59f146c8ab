import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.oracle import compare
from wayfold.llm import op13_collocations as op


def brute(rows, max_n=3, least=10, share=50, top=2000):
    """Plain counting in Python integers."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in cands.items():
        if any(lg == lang and len(q) > len(p) and inside(p, q) and 100 * b >= share * a for (lg, q), b in cands.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    rank, rows = Counter(), []
    for lang, s, a, p, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return rows


def got(spark, rows, **how):
    docs = spark.createDataFrame([(t, lg, "c", 1) for t, lg in rows], "text string, lang string, piece string, f int")
    return sorted(map(tuple, op.collocations(docs, **how).collect()))


def corpus(seed, n=120, alphabet="a b c D é 😀 ß x1".split()):
    rng = random.Random(seed)
    gap = lambda: rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "])
    return [("".join(rng.choice(alphabet) + gap() for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", "a\nb", ""])) for _ in range(n)]


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed) + [(None, "en"), ("", None), (" \t\n", "en"), ("New York City " * 30, "en"), ("İstanbul ÀB Àb " * 15, "en"), ("w" * 5000 + " tail" * 40, "de")]
        assert got(spark, rows) == brute(rows)
        assert got(spark, rows * 2, least=4, top=7) == brute(rows * 2, least=4, top=7)
    rows = corpus(9, 60)
    assert got(spark, rows, max_n=5, least=3, share=70) == brute(rows, max_n=5, least=3, share=70)


def test_empty_and_one_hot_pair(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("", "en")]) == []
    rows = [("the cat " * 200, "en")] * 300 + corpus(4)
    assert got(spark, rows) == brute(rows)


def test_scores_are_exact_past_64_bits(spark):
    big = 3_000_000_019
    frequent = spark.createDataFrame([("en", "", 5 * big), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)], "lang string, phrase string, f bigint")
    r = op.cut_scores(frequent, frequent.filter("phrase = 'a b'").select("lang", "phrase", F.col("f").alias("a"))).first()
    assert r.score == 1000000 * (big - 7) ** 2 // (big * (big + 1)) and (r.l, r.r) == (big, big + 1)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = corpus(21, 200)
    spark.createDataFrame([(i, t, lg) for i, (t, lg) in enumerate(rows)], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, lambda s, d: op.op13_phrase_collocations(s.read.parquet(f"{d}/documents.parquet")), op.ORACLE, str(tmp_path)) == ""


def test_last_rank_sees_few_rows(spark):
    """Ranks are taken within classes first, so no window sorts a whole language."""
    scored = spark.createDataFrame([("en", f"p{i} q", i % 50, i % 7) for i in range(20000)], "lang string, phrase string, score bigint, a bigint")
    want = sorted(((r.score, r.a, r.phrase) for r in scored.collect()), key=lambda x: (-x[0], -x[1], x[2].encode()))[:100]
    out = sorted(op.first_ranks(scored, 100).collect(), key=lambda r: r.rank)
    assert [(r.score, r.a, r.phrase) for r in out] == want and [r.rank for r in out] == list(range(1, 101))
