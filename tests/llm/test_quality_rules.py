import duckdb
import pandas as pd
import pytest
from cellspark.llm import quality_rules as q

TEXTS = [None, "", "one two", "a b c d e f g h i j", "a b c d e a b c d e x y", "x\nx\n y \n\ny\r\n##|<", "w " * 300, "é # ü\x0b$ z\tq\n" * 3, "\xa0 nb sp " * 4, "a b c d e f " * 2 + "q r s t u v w x y z 1 2 3 4 5 6 7 8"]


def brute(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert q.measure_text(text) == brute(text)


def rows():
    good = " ".join(f"w{i}" for i in range(30))
    out = [(i, t, "mixed", 1) for i, t in enumerate(TEXTS)] + [(None, good, None, 0), (100, None, None, 0), (3, TEXTS[3], "mixed", 1)]
    out += [(200 + i, good if i == 0 else "bad", "farm", 1) for i in range(60)] + [(300 + i, good, "fine", 1) for i in range(40)]
    return out


def test_host_verdicts_and_sql(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, n_words long")
    got = sorted((tuple(r) for r in q.judge(df).collect()), key=str)
    documents = pd.DataFrame(rows(), columns=["doc_id", "text", "source", "n_words"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == sorted(con.sql(q.OP3_SQL).fetchall(), key=str)
    kept = {r[0]: r[7] for r in got}
    assert not kept[200] and kept[300] and not kept[201]


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
