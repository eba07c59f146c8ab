"""Source mixing: targets by the stated rule, taken words near them, reruns alike."""

from collections import Counter

from wayfold.llm import op6_mixture
from wayfold.llm.op6_mixture import op6_mix_sources


def targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_targets_and_taken_words(spark):
    names = ["a", "b", "c", None]
    rows = [(i, " ".join(["w"] * (1 + i % 7)), names[0 if i % 3 == 0 else i % 4]) for i in range(4000)] + [(4000, None, "a"), (4001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op6_mix_sources(df).collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(dict(sizes))
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 14
    assert sorted(map(tuple, out)) == sorted(map(tuple, op6_mix_sources(df.repartition(7)).collect()))


def test_empty_table(spark):
    assert op6_mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_names_that_clash(spark):
    rows = [(i, "word " * (i % 9), "abc"[i % 3], 1, 2, 3.0, "p") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix_key int, size int, _mix_ double, plan string")
    got = op6_mixture.mix_sources(df)
    assert got.columns == [*df.columns, "_mix__"] and got.count() == 60
    plain = {r.doc_id: r for r in op6_mixture.op6_mix_sources(df).collect()}
    assert all((r["_mix__"].size, r["_mix__"].taken) == (plain[r.doc_id].size, plain[r.doc_id].taken) for r in got.collect())


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, "same text here", "a")] * 40 + [(2, "w " * 300_000, "a"), (None, None, None)]
    got = op6_mixture.op6_mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 42 and len({r.taken for r in got if r.doc_id == 1}) == 1
    assert [r.size for r in got if r.doc_id == 2] == [300_000] and all(r.taken <= 2 * r.size for r in got)
