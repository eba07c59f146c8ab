import random

from wayfold.llm.op3_paragraphs import op3_repeated_paragraphs


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def sentence(rng, n=12):
    return words(rng, n).capitalize() + "."


def test_repeats_go_and_clean_texts_stay(spark):
    rng = random.Random(4)
    passage = " ".join(sentence(rng) for _ in range(6))
    near = passage.replace(passage.split()[40], "changed")
    long_line = " ".join(sentence(rng, 20) for _ in range(5))
    fresh = lambda: " ".join(sentence(rng) for _ in range(5))
    texts = [
        fresh() + "\n" + passage + "\n" + fresh(),  # 0 keeps
        fresh() + "\n" + passage + "\n" + fresh(),  # 1 a line again
        fresh() + " and then once more " + passage + " " + fresh(),  # 2 within a line; its first sentence is at 8 / 12 here
        fresh() + "\n" + near,  # 3 one word changed
        "Heading of five words here.\n" + fresh(), "Heading of five words here.\n" + fresh(),  # 4, 5 short repeats only
        long_line, long_line[: -len("x.")] + "zz.",  # 6, 7 near lines
        fresh(), None, "", "one", "x " * 3000,
    ]
    df = spark.createDataFrame([(i + 10, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, h string")
    got = {}
    for r in op3_repeated_paragraphs(df).collect():
        got.setdefault(r.doc_id - 10, []).append(r)
    assert {1, 2, 3, 7} <= set(got) <= {1, 2, 3, 7, 12}
    r = got[1][0]
    assert r.kept_doc_id == 10 and texts[1][r.start : r.end] == passage and r.n_words == len(passage.split())
    r = max(got[2], key=lambda r: r.n_words)
    assert texts[2][r.start : r.end] in passage and r.n_words >= 50
    assert op3_repeated_paragraphs(df.limit(0)).count() == 0


def test_copies_and_chance_meetings(spark):
    rng = random.Random(8)
    common = sentence(rng, 13)
    rows = [(i, common + " " + sentence(rng, 25)) for i in range(60)]  # one sentence in all, the lines unlike
    whole = "\n".join(sentence(rng, 15) for _ in range(4))
    rows += [(100 + i, whole) for i in range(40)] + [(None, whole), (100, whole)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = op3_repeated_paragraphs(df).collect()
    assert {r.doc_id for r in got} == set(range(101, 140)) and {r.kept_doc_id for r in got} == {100}


def test_families_of_near_copies_are_whole(spark):
    """Each paragraph an edit of an earlier one: members of a band are near each other, but not all near its leader."""
    rng = random.Random(15)
    rows = []
    for family in range(3):
        made = [words(rng, 100).split()]
        for _ in range(150):
            new = list(rng.choice(made))
            at = rng.randrange(99)
            new[at : at + 2] = words(rng, 2).split()
            made.append(new)
        rows += [(1000 * family + i, " ".join(w)) for i, w in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.kept_doc_id for r in op3_repeated_paragraphs(df).collect()}
    assert got == {i: root(i) for i in sets if root(i) != i}


def near_roots(texts):
    """Components of all pairs at a Jaccard similarity of 0.8 over 5-word shingles, and the pairs."""
    sets = [set(zip(*[t.lower().split()[k:] for k in range(5)])) for t in texts]
    root, pairs = list(range(len(sets))), []
    for b in range(len(sets)):
        for a in range(b):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs.append((a, b))
                if root[a] != root[b]:
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
    return root, pairs


def test_recall_of_links_against_brute_force(spark):
    """Edited copies of paragraphs of 8 to 60 words, at and around the threshold: 0.9 of all links and more are found."""
    from wayfold.llm.components import components
    from wayfold.llm.op3_paragraphs import near_pairs, paragraphs
    import numpy as np

    rng = random.Random(23)
    texts = []
    for n in [8, 9, 10, 11, 12, 13, 14, 20, 30, 60] * 12:
        w = words(rng, n).split()
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            kind = rng.randrange(3)
            if kind == 0:
                v = v[1:]
            elif kind == 1:
                v = v[:-1]
            else:
                v[rng.choice([0, 1, n - 2, n - 1])] = words(rng, 1)
            texts.append(" ".join(v))
    rng.shuffle(texts)
    _, pairs = near_roots(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    hashes = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        hashes.append(int(paragraphs(data, np.array([0, len(data)]), False)[4].view(np.int64)[0]))
    roots = {r.node: r.root for r in components(near_pairs(df)).collect()}
    of = [roots.get(h, h) for h in hashes]
    found = sum(of[a] == of[b] for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.95 * len(pairs)
    true, _ = near_roots(texts)
    assert all(true[a] == true[b] for a in range(len(texts)) for b in range(a) if of[a] == of[b])


def test_groups_beyond_a_block_lose_no_links(spark):
    """One group split over many blocks: chains of near copies that are not near the most frequent member."""
    from pyspark.sql import functions as F
    from wayfold.llm.components import components
    from wayfold.llm.near_sets import near_edges

    rng = random.Random(5)
    bodies = []
    for _ in range(12):
        chain = [words(rng, 40).split()]
        for _ in range(6):
            new = list(chain[-1])
            new[rng.randrange(40)] = words(rng, 1)
            chain.append(new)
        bodies += [" ".join(w) for w in chain]
    rng.shuffle(bodies)
    true, _ = near_roots(bodies)
    table = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(bodies)], "h bigint, body binary")
    members = table.select(F.lit(1).cast("bigint").alias("key"), "h", F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("own"))
    roots = {r.node: r.root for r in components(near_edges(lambda: members, lambda hits: table, chunk=7)).collect()}
    of = [roots.get(i, i) for i in range(len(bodies))]
    assert all((true[a] == true[b]) == (of[a] == of[b]) for a in range(len(bodies)) for b in range(a))


def test_lines_meet_sentences_but_not_their_own(spark):
    rng = random.Random(31)
    base = words(rng, 60).split()
    whole = " ".join(base)
    split = " ".join(base[:30]) + ". " + " ".join(base[30:])  # the same line but for a full stop: two sentences
    own = " ".join(base[::-1]) + ". Some few more words here."  # a long sentence in a line hardly longer
    df = spark.createDataFrame([(1, whole), (2, split), (3, own), (4, words(rng, 9000)), (5, words(rng, 12))], "doc_id bigint, text string")
    got = op3_repeated_paragraphs(df).collect()
    assert [(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id) for r in got] == [(2, 0, len(split), 60, 1)]


def test_hit_table_finds_all(spark):
    import numpy as np

    from wayfold.llm.near_sets import hit_table, wanted

    rng = np.random.default_rng(3)
    ids = np.append(rng.integers(-(1 << 62), 1 << 62, 3000), [0, -1, 1, (1 << 24) - 1, 1 << 24])
    hits = hit_table(spark.createDataFrame([(int(x),) for x in ids], "i bigint"))
    assert wanted(hits, ids).all() and wanted(hits, rng.integers(-(1 << 62), 1 << 62, 100_000)).mean() < 0.001


def shingle_set(text):
    w = text.split()
    return frozenset(zip(*[w[k:] for k in range(5)]))


def test_recall_by_number_of_shingles(spark):
    """Pairs at a similarity of 0.8 and more, whatever the number of shingles: all below 8, 0.95 from there on."""
    from wayfold.llm.op3_paragraphs import near_pairs

    rng = random.Random(23)
    rows, pairs = [], {}
    for n in range(4, 15):
        for _ in range(60):
            more = 1 if n < 8 else rng.choice([1, n // 4])
            w = words(rng, n + 4 + more).split()
            front = rng.randint(0, more)
            a, b = " ".join(w[front : front + n + 4]), " ".join(w)
            pairs.setdefault(n, []).append((len(rows), len(rows) + 1))
            rows += [a, b]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    met = near_pairs(df)
    found = met.count()
    assert found <= sum(map(len, pairs.values()))
    linked = linked_texts(spark, rows, met)
    for n, some in pairs.items():
        near = [p for p in some if len(shingle_set(rows[p[0]]) & shingle_set(rows[p[1]])) >= 0.8 * len(shingle_set(rows[p[0]]) | shingle_set(rows[p[1]]))]
        recall = sum(p in linked for p in near) / len(near)
        assert len(near) > 20 and recall >= (1 if n < 8 else 0.95), (n, recall)


def linked_texts(spark, rows, met):
    """Pairs of row numbers that an edge joins."""
    import numpy as np
    from wayfold.llm.op3_paragraphs import paragraphs

    known = {}
    for i, t in enumerate(rows):
        raw = t.encode()
        for h in paragraphs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), False)[4].view(np.int64).tolist():
            known.setdefault(h, []).append(i)
    return {tuple(sorted((x, y))) for r in met.collect() for x in known[r.a] for y in known[r.b]}


def test_repeated_shingles_meet(spark):
    from wayfold.llm.op3_paragraphs import near_pairs

    rng = random.Random(31)
    rows, want = [], []

    def pair(a, b):
        want.append((len(rows), len(rows) + 1))
        rows.extend([a, b])

    for _ in range(30):
        five = words(rng, 5)
        pair(" ".join([five] * 2), " ".join([five] * 3))
        five = words(rng, 5)
        pair(" ".join([five] * 4), " ".join([five] * 40))
        one = words(rng, 1)
        pair(" ".join([one] * 6), " ".join([one] * 9))
        three = words(rng, 3)
        pair(" ".join([three] * 3), " ".join([three] * 4))
        seven = words(rng, 7)  # seven shingles, and the same with an eighth at the end
        pair(" ".join([seven] * 3), words(rng, 1) + " " + " ".join([seven] * 2))
    for a, b in want:
        x, y = shingle_set(rows[a]), shingle_set(rows[b])
        assert len(x & y) >= 0.8 * len(x | y)
    assert set(want) <= linked_texts(spark, rows, near_pairs(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")))
    twice = spark.createDataFrame([(1, "alpha beta gamma delta omega " * 5), (2, "alpha beta gamma delta omega " * 7)], "doc_id bigint, text string")
    assert [r.doc_id for r in op3_repeated_paragraphs(twice).collect()] == [2]
