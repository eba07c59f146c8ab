import hashlib
import random
import re

import numpy as np

from tests.oracle import compare
from wayfold.llm import op12_fill_middle as op

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n):
    rng = random.Random(seed)
    some = ["a", "word", "é", "😀😀", "<", "<P", "S>", "M", "\x85", "\xa0x", " ", "  ", "\n", "\t\r", "\x0b", ">"]
    return ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


ODD = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a <S> b", "<<P", "<P <S <M", "tail <", "é" * 70000, "a " * 40000, " " * 70001, "w" * 65535 + " b", "w" * 65536 + " b", "w" * 65536, " " * 65536 + "z"]


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(3, 400) + ODD * 3)] + [(None, "no id at all here"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame([(i, "x", t, 1) for i, t in rows], "doc_id bigint, fim string, text string, n int")
    out = op.fill_in_middle(docs, rate=90)
    assert out.columns == ["doc_id", "fim", "text", "n", "fim_"]
    back = out.select("doc_id", "text", "fim_.*", op.restored(out["fim_"]["output"], out["fim_"]["form"]).alias("back")).collect()
    assert len(back) == len(rows)
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, rate=90)
        assert r.back == (r.text or "")
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_checkpoints_find_every_cut():
    for text in [t for t in ODD if t] + texts(8, 30):
        data = np.frombuffer(text.encode(), np.uint8)
        units = UNIT.findall(text)
        for every, piece in ((1, 7), (3, 64), (512, 1 << 16)):
            marks = op.Checkpoints(data, every, piece)
            assert marks.n == len(units) and len(marks.units) == len(units) // every + 1
            for u in {0, 1, 2, 3, len(units) // 2, len(units) - 1, len(units)} & set(range(len(units) + 1)):
                head = "".join(units[:u])
                assert marks.locate(u) == (len(head.encode()), len(head))


def test_index_is_sparse():
    data = np.frombuffer(b"word " * 200_000, np.uint8)
    assert len(op.Checkpoints(data).units) == 200_001 // op.EVERY + 1


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = list(enumerate(texts(21, 200) + ODD))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, lambda s, d: op.op12_fill_in_middle(s.read.parquet(f"{d}/documents.parquet")), op.ORACLE, str(tmp_path)) == ""


def test_empty_table(spark):
    assert op.op12_fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
