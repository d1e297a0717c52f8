import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import staylight.llm.fim as fim
from staylight.llm.fim import MOST, Chunks, Fim, Lines, cut_places, fill_in_middle, restored
from staylight.llm.oracles import oracle_sql
from staylight.llm.queries import op12_fill_in_middle

MARKS = ("<P>", "<S>", "<M>")


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def test_query_equals_its_sql(spark, sample):
    folder, _ = sample
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op12_fill_in_middle']})").fetchall()
    assert sorted(map(tuple, op12_fill_in_middle(spark, folder).select(*names).collect())) == sorted(want)


def test_chunks_lead_to_the_same_lines_as_the_whole_text():
    rng, chunks = random.Random(2), Chunks(MARKS, limit=200_000)
    parts = ["a", "word ", "\n", "é", "中", "🙂", "\n\n", "<P", "<", ">", "<M>", "x" * 90, "The quick fox. "]
    passage = "".join(rng.choices(parts[:8], k=3000))
    for n in range(600):
        text = "".join(rng.choices(parts if n % 3 == 0 else parts[:10], k=rng.randint(0, 300)))
        text += passage * (n % 5 == 0)
        data, units = text.encode(), lines(text)
        found = Lines(data, chunks)
        assert found.count == len(units)
        assert found.marked == any(m in text for m in MARKS)
        at = rng.randint(0, len(units))
        assert data[: found.end_of(at)].decode() == "".join(units[:at])
        ends = cut_places(data)
        assert all(0 < b - a <= MOST for a, b in zip([0, *ends], ends)) and ends[-1:] == [len(data)][: len(data)]
    assert chunks.hits > 0 and chunks.held <= chunks.limit + MOST * 10


def test_equal_passages_share_chunks_and_colliding_keys_are_verified(monkeypatch):
    passage = " ".join(str(n * n) for n in range(5000))
    a, b = ("short " + passage).encode(), ("another beginning " + passage).encode()
    cut = lambda d: {d[x:y] for x, y in zip([0, *cut_places(d)], cut_places(d))}
    assert len(cut(a) & cut(b)) > len(cut(a)) - 4
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda content: 1)
    chunks = Chunks(MARKS)
    assert chunks.get(b"x\n").lines == (2,) and chunks.get(b"\n\n").lines == (1, 2) and chunks.get(b"x\n").lines == (2,)


def test_odd_texts_nulls_repeats_clashes_and_empty_table(make, odd_texts):
    texts = [*odd_texts, "one <P> two", "a\nb\nc", "no end\n", "<", "x<P\n>y\nS>"]
    docs = make([*enumerate(texts), (None, "lost\nid"), (3, "w\nx")]).selectExpr("*", "1 as n", "'x' as output", "2 as h1")
    for how in (Fim(), Fim(spm=100), Fim(spm=0), Fim(rate=0)):
        made = fill_in_middle(docs, how)
        rows = made.withColumn("back", restored(F.col("output"), F.col("form"), how)).collect()
        assert sorted(r["back"] for r in rows) == sorted([*(t or "" for t in texts), "lost\nid", "w\nx"])
        for r in rows:
            assert r["n"] == len(lines(r["back"]))
            plain = how.rate == 0 or not r["back"] or any(m in r["back"] for m in MARKS)
            assert (r["form"] == "plain") == plain == (r["prefix_chars"] is None)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_markers_that_run_into_each_other_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            Fim(*marks)
