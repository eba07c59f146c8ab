from wayfold.llm.op2_decontaminate import leaks, op2_benchmark_leaks

ITEM = "If a train travels 120 km in 3 hours toward Boston, how many km does it cover before lunch at 60 km per hour on the first day"


def run(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in leaks(docs, bench, **more).collect()}


def test_finds_copies_and_new_values(spark):
    changed = ITEM.replace("120", "450").replace("3 hours", "5 hours").replace("Boston", "Denver").replace("60", "90")
    texts = ["so it goes. " + ITEM + ". and then some more", ITEM.upper(), changed, "nothing of the sort " * 9, None, "", "a b"]
    for bound in (10**6, 0):  # the index in memory, and the shuffled join beyond its bound
        got = run(spark, texts, [ITEM, "too short", ""], bound=bound)
        assert {0, 2} <= {d for d, i in got} <= {0, 1, 2} and {i for _, i in got} == {0}
        assert got[0, 0].n_changed == 0 and got[2, 0].n_changed > 0


def test_slots_must_be_consistent(spark):
    item = "take 5 apples and 7 pears then add 5 apples and 7 pears then count 5 apples and 7 pears once more"
    good = item.replace("5", "8").replace("7", "9")
    bad = "take 1 apples and 2 pears then add 3 apples and 4 pears then count 6 apples and 8 pears once more"
    assert {d for d, _ in run(spark, [good, bad], [item])} == {0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert op2_benchmark_leaks(docs, bench).count() == 0


def test_leaks_equal_a_plain_search(spark):
    """Every item against every text, windows compared one by one: numbers, units and names as typed slots, each value of
    the item with one value of the text."""
    import random
    import re

    from wayfold.llm import op2_decontaminate as op

    def tokens(text):
        out, low = [], text or ""
        for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f]|(?<=[0-9])[.,](?=[0-9]))+", low):
            w = m.group()
            before = low[: m.start()].rstrip(" ")
            number = re.fullmatch(r"[0-9.,]+", w) is not None
            unit = bool(out) and out[-1][0] == "NUM" and w.lower() in op.UNITS
            quiet = bool(out) and re.fullmatch(r"[A-Za-z0-9\x80-\U0010ffff,'\- ]?", before[-1:]) is not None and not before[-1:] == ""
            name = re.match(r"[A-Z][a-z]", w) is not None and quiet
            kind = "NUM" if number else "UNIT" if unit else "NAME" if name else w.lower()
            out.append((kind, w.lower()))
        return out

    def windows(text):
        t = tokens(text)
        return [(k, t[k : k + 5]) for k in range(len(t) - 4) if sum(x[0] not in ("NUM", "UNIT", "NAME") for x in t[k : k + 5]) >= 2]

    def slow(items, texts):
        got = {}
        for i, item in items:
            own = windows(item)
            for d, text in texts:
                hits = {}
                for p, w in own:
                    for q, v in windows(text):
                        if [x[0] for x in w] == [x[0] for x in v]:
                            hits.setdefault(q - p, []).append((w, v))
                found = set()
                for pairs in hits.values():
                    slots = {(x[1], y[1]) for w, v in pairs for x, y in zip(w, v) if x[0] in ("NUM", "UNIT", "NAME")}
                    if len(slots) == len({a for a, _ in slots}):
                        found |= {tuple(x[0] for x in w) for w, _ in pairs}
                total = len({tuple(x[0] for x in w) for _, w in own})
                if total and len(found) >= 0.8 * total:
                    got[d, i] = (total, len(found))
        return got

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    question = lambda a, b, who, unit: f"when {who} buys {a} {unit} of {words[1]} and gives {b} to {words[2]} how many {words[3]} does {who} keep at {words[4]} {words[5]}?"
    items = [(1, question(12, 7, "Tom", "kg")), (2, prose(25)), (3, question(3, 3, "Ann", "kg")), (4, "one two"), (5, None)]
    texts = [(10, prose(10) + ". " + question(9, 9, "Eve", "liters") + " " + prose(10)), (11, items[0][1]), (12, items[1][1]), (13, prose(60)), (14, items[1][1][: len(items[1][1]) // 2]), (15, question(5, 6, "Bob", "kg")), (16, None), (17, ""), (11, items[1][1]), (18, prose(5) + " " + items[1][1] + " " + prose(4000))]
    df = spark.createDataFrame(texts + [(None, items[0][1])], "doc_id bigint, text string")
    bench = spark.createDataFrame(items + [(None, items[1][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in op.op2_benchmark_leaks(df, bench).collect()}
    assert got == slow(items, texts) and {(10, 1), (11, 1), (12, 2), (11, 2), (18, 2)} <= set(got) and (15, 3) not in got
    small = {(r.doc_id, r.item_id) for r in op.leaks(df, bench, bound=0).collect()}
    assert small == set(got)  # the shuffled path
