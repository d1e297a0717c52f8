import random

import pytest

from staylight.llm import decontaminate as dc
from staylight.llm.queries import op6_decontamination


def distance(item, text):
    """Least edits that turn ``item`` into a part of ``text``: the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(text, items, matching):
    """item -> distance of all items within their budget."""
    out = {}
    for number, raw in items:
        item = dc.plain(raw or "")
        if number is not None and 0 < len(item) < matching.least:
            if f" {item} " in f" {dc.plain(text or '')} ":
                out[number] = 0
        elif number is not None and item:
            d = distance(item, dc.plain(text or ""))
            if d <= len(item) // matching.budget:
                out[number] = d
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéo", k=rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, prose(14)) for i in range(8)] + [(90, "ab"), (93, "Zebra, crossing?"), (94, "!?"), (91, None), (None, prose(14)), (92, prose(3) * 3)]
    texts = [None, "", prose(80), "ab", "cab abc", "the zebra crossing", "zebra crossings", "A zebra\n-- crossing: ab"]
    for i, item in items[:8]:
        for edits in range(0, 7):
            chars = list(item.upper().replace(" ", ", ", 3) if i % 2 else item)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "q"]])
            texts.append(f"{prose(rng.randint(0, 12))}\n{''.join(chars)}. {prose(rng.randint(0, 12))}")
    return items, texts


def rows(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [16 << 20, 120])
def test_finds_just_what_is_within_the_budget(spark, make, planted, block):
    items, texts = planted
    matching = dc.Matching(budget=16, block_bytes=block)
    got = dc.contaminated(make(texts), rows(spark, items), matching).collect()
    want = {i: brute(t, items, matching) for i, t in enumerate(texts)}
    assert any(0 < d for w in want.values() for d in w.values()) and any(not w for w in want.values())
    assert {r["doc_id"]: set(r["item_ids"]) for r in got} == {i: set(w) for i, w in want.items()}
    for r in got:
        assert r["kept"] == (r["n_items"] == 0)
        assert dict(zip(r["item_ids"], r["distances"])) == want[r["doc_id"]]


def test_query_equals_brute_force(spark, sample):
    folder, docs = sample
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["item_ids"] for r in op6_decontamination(spark, folder).collect()}
    forms = [(i, dc.plain(t)) for i, t in items]
    for i, text in docs:
        whole = dc.plain(text or "")
        assert {n for n, f in forms if f in whole} <= set(got[i])
        # Whatever is reported is within the budget by the plain table.
        for n in got[i]:
            form = dict(forms)[n]
            assert distance(form, whole) <= len(form) // 32
    assert len(got) == len(docs)


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item, text = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (70, 90))
        assert dc.best_match(item, text) == distance(item, text)
    assert dc.best_match("abc", "") == 3


def test_pieces_cover_an_item():
    for n in range(1, 40):
        for k in range(0, min(5, n)):
            parts = dc.cut("x" * n, k)
            assert len(parts) == k + 1 and "".join(p for _, p in parts) == "x" * n and all(p for _, p in parts)


def test_filter_repeated_rows_clashes_and_empty_tables(spark, make, planted):
    items, _ = planted
    docs = make([(1, items[0][1]), (1, items[0][1]), (2, "clean"), (None, "clean")]).selectExpr("*", "1 as kept", "2 as item_id")
    clean = dc.clean_documents(docs, rows(spark, items))
    assert clean.columns == docs.columns and clean.count() == 2
    assert dc.clean_documents(docs, rows(spark, items).limit(0)).count() == 4
    assert dc.contaminated(docs.limit(0), rows(spark, items)).count() == 0
