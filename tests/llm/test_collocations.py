import random
import re
from collections import Counter

import duckdb
import pytest

from staylight.llm import collocations as C
from staylight.llm.collocations import Mining, mine_collocations
from staylight.llm.oracles import oracle_sql
from staylight.llm.queries import op11_collocations

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, how):
    """All phrases by their definition, from (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, how.longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= how.least}
    found = {}
    for (lang, p), a in candidates.items():
        if any(
            x == lang and len(q) > len(p) and 100 * b >= how.covered * a
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (x, q), b in candidates.items()
        ):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), a, l, r, n[lang], score))
    return sorted(
        (lang, rank, *row[3:]) for lang, rows in found.items() for rank, row in enumerate(sorted(rows)[: how.keep], 1)
    )


def got(docs, how):
    return sorted(map(tuple, mine_collocations(docs, how).select(*NAMES).collect()))


def test_query_equals_its_sql(spark, sample):
    folder, _ = sample
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(f"SELECT {', '.join(NAMES)} FROM ({oracle_sql()['op11_collocations']})").fetchall()
    assert sorted(map(tuple, op11_collocations(spark, folder).select(*NAMES).collect())) == sorted(want)


@pytest.mark.parametrize("keep", [3, 12, 1000])
def test_best_first_rounds_equal_all_phrases(spark, keep, monkeypatch):
    """With few kept, thresholds fall over several rounds; ties and contained phrases are many."""
    monkeypatch.setattr(C, "FIRST", 1)
    monkeypatch.setattr(C, "MORE", 2)
    rng = random.Random(keep)
    words = ["new", "york", "city", "the", "of", "a", "É", "中文", "x1", "Times"]
    rows = []
    for lang in ("en", None, "de"):
        for _ in range(60):
            text = " ".join(rng.choices(words, weights=[5, 5, 4, 9, 7, 6, 1, 1, 1, 2], k=rng.randint(0, 25)))
            text += rng.choice(["", ". New York City Times", "; in spite of that\tthe", "!\nof the of the of the"])
            rows.append((lang, text))
    how = Mining(least=4, keep=keep)
    docs = spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, f int").repartition(3)
    assert got(docs, how) == brute(rows, how)


def test_odd_texts_nulls_long_texts_repeats_and_empty_table(spark, odd_texts):
    rows = [("en", t) for t in odd_texts] * 3 + [(None, None), (None, "lost words " * 9), ("en", "a\x0bb\x1cc a\x0bb\x1cc " * 20)]
    docs = spark.createDataFrame([(lang, t, "x", 0) for lang, t in rows], "lang string, text string, phrase string, size int")
    how = Mining(least=2)
    assert got(docs, how) == brute(rows, how)
    assert got(docs.limit(0), how) == []
    assert got(docs.filter("text = 'word'"), how) == []


def test_counts_past_64_bits_are_exact(spark):
    big = 1 << 62
    counts = [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    table = spark.createDataFrame(counts, "lang string, size int, phrase string, f long")
    row = C.scored(table.filter("size = 2"), table).first()
    assert row["score"] == 2_000_000 * (big - 2) // (2 * big - 1)
