import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.llm import op11_rules as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    return " ".join(" ".join(rng.choices(words, k=rng.randint(4, 9))).capitalize() + "." for _ in range(n))


def junk(rng, kind, n):
    words = ["".join(rng.choice("abcdefghil") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    some = rng.choices(words, k=n)
    return [" ".join(w + "%%%" for w in some), " | ".join(some), " ".join(w.upper() + "!!" for w in some), " ".join(" ".join([w] * 5) for w in some)][kind]


CASES = [
    None, "", "   \n\t ", "one", "a b c d e f g h a b c d e f g h", " ".join("abcdefgh" * 3), "x " * 40, "x y " * 500, "line\nline\nline \n\nline", "#*$%&|<> é😀 #",
    "\n".join(["the same line of eight words stands here"] * 4), "a\x0bb\x0cc\rd", "ünï cödé " * 9, "\x85 \xa0  ", "word " * 7 + "end", "q w e r t y u i o p " * 3 + "tail of other words",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(5)
    texts = CASES + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 2) + prose(rng, rng.randint(0, 4)) for _ in range(150)] + [prose(rng, 4000) + " " + prose(rng, 20) * 2]
    got = op.op11_quality_rules(frame(spark, texts), spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, texts[r.doc_id]
        assert r.kept is (not want[-1])  # nothing learned, so the base rule decides


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(5, 20)), 1) if rng.random() < 0.8 else (i, junk(rng, rng.randrange(4), rng.randint(30, 90)), 0) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id bigint, text string, `row` string, s int").cache()
    return rows, docs, spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id bigint, quality int")


def test_rules_hold_on_rows_without_a_label(spark, corpus):
    rows, docs, labels = corpus
    got = {r.doc_id: r for r in op.op11_quality_rules(docs, labels).collect()}
    unseen = [(got[i].kept, got[i].base_failed, q) for i, _, q in rows if i % 2 == 0]
    assert sum(k for k, f, q in unseen if q and not f) >= 0.99 * sum(1 for k, f, q in unseen if q and not f)
    assert sum(k for k, f, q in unseen if not q) <= 0.05 * sum(1 for k, f, q in unseen if not q)
    assert not any(k and f for k, f, _ in unseen)


def test_list_is_an_ordered_conditional_expression(spark, corpus):
    rows, docs, labels = corpus
    stats = op.statistics(docs.select("doc_id", "text"), F.col("text"), "s")
    found = op.learn(op.labelled(stats, labels, "doc_id", "s"))
    assert 1 <= len(found.rules) <= op.RULES and all(1 <= len(r) <= op.DEPTH for r in found.rules)
    values = dict(zip(op.SHARES, op.shares(F.col("s"))))
    text = str(found.keeps({k: F.col(k) for k in op.SHARES}))
    assert text.count("WHEN") == len(found.rules) and "ELSE true" in text
    for r in stats.select(found.keeps(values).alias("k"), found.fired(values).alias("f"), *op.shares(F.col("s"))).collect():
        first = next((n for n, rule in enumerate(found.rules, 1) if all((r[t.share] > t.bound) == t.above for t in rule)), None)
        assert r.f == first and r.k == (first is None)


def test_reruns_agree_and_order_does_not_matter(spark, corpus):
    _, docs, labels = corpus
    one = {r.doc_id: r.kept for r in op.op11_quality_rules(docs, labels).collect()}
    assert one == {r.doc_id: r.kept for r in op.op11_quality_rules(docs.repartition(7, F.rand(3)), labels.repartition(3)).collect()}


def test_odd_tables(spark, corpus):
    rows, docs, labels = corpus
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert op.op11_quality_rules(frame(spark, []), labels).count() == 0
    mixed = labels.unionByName(spark.createDataFrame([(None, 0), (1, None), (None, None), (10**9, 0)], labels.schema)).unionByName(labels)
    twice = docs.unionByName(docs)
    got = op.op11_quality_rules(twice.unionByName(spark.createDataFrame([(None, "word " * 30, None, 1)], docs.schema)), mixed).collect()
    assert len(got) == 2 * len(rows) + 1 and all(r.kept is not None for r in got)
    verdicts = {}
    for r in got:
        verdicts.setdefault(r.doc_id, set()).add(r.kept)
    assert all(len(v) == 1 for v in verdicts.values())
    judged = op.judge(docs.withColumn("rules", F.lit(1)), labels)
    assert judged.columns == [*docs.columns, "rules", "rules_"]
    r = judged.filter("not rules_.kept and not rules_.base_failed").first()
    assert r["rules_"].rule >= 1
    assert op.judge(docs, none).filter("rules.kept = rules.base_failed").count() == 0


def test_no_python_workers(spark, corpus):
    _, docs, labels = corpus
    plan = op.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
