import hashlib
import itertools
import re

import numpy as np

from wayfold.llm import op1_pii as op

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def slow_base(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and op.luhn(d.encode()):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (op.BASE.index(x[0]), x[1]))


def test_base_spans_equal_plain_patterns(spark):
    rng = np.random.default_rng(3)
    pieces = ["a@b.c", "x.y@", "@", "é", "1.2.3.4", "256.1.1.1", "10.20.30.40.50", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+", "0", "99", " ", " ", ".", "-", "(", "5105105105105100", "foo", "ü@x-y.z.", "+49 30 1234567", "\n", "a..b@c.d@e.f"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 14))) for _ in range(400)] + [None, "", "x" * 3000 + "@", "7" * 5000, "ab " * 9000 + "a@b.cd"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in op.op1_pii_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = slow_base(t)
        words = [f"{k}:{a}:{b}" for k, a, b in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(words).encode()).hexdigest(), (t, words, got[i].spans)
        assert set(words) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[0] == k for w in want) for k in op.BASE]
    assert op.op1_pii_spans(df.limit(0)).count() == 0


def test_viterbi_and_cuts_equal_all_paths():
    rng = np.random.default_rng(2)
    field = op.trained()
    emissions = field.emissions(op.shapes(*_words("call (017) 555-7713 now or 4111 1111 1111 1111")))
    for _ in range(20):
        e = rng.normal(0, 3, (5, len(op.LABELS)))
        best = max(itertools.product(range(len(op.LABELS)), repeat=5), key=lambda p: sum(field.moves[a, b] for a, b in zip((0, *p), (*p, 0))) + sum(e[i, k] for i, k in enumerate(p)))
        assert field.decode(e, np.array([0]), np.array([5])).tolist() == list(best)
    whole = field.decode(emissions, np.array([0]), np.array([len(emissions)]))
    assert not whole[field.surely_outside(emissions)].any()


def _words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = op.runs(~op.SPACE[data], np.array([0, len(data)]))
    return data, starts, ends


def test_field_learns_its_table_and_new_rows():
    right = total = 0
    for text, gold in op.labelled_table(200, seed=99):
        data, starts, ends = _words(text)
        got = op.trained().decode(op.trained().emissions(op.shapes(data, starts, ends)), np.array([0]), np.array([len(starts)]))
        right, total = right + int((got == gold).sum()), total + len(gold)
    assert right / total > 0.97


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to jo.99@mail7.example.com. or +1 (017) 555-7713 ok", 5), (2, "plain words only", 16), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in op.redact(df, length_col="n_chars").collect()}
    assert "[EMAIL]" in got[1].text and "[PHONE]" in got[1].text and "@" not in got[1].text and got[1].n_chars == len(got[1].text)
    assert got[2].text == "plain words only" and got[3].text is None
