import re
from collections import Counter

from staylight.llm.line_rules import LineRules, clean_lines
from staylight.llm.queries import op7_line_rules

SPACE = "\x20\x09-\x0d"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            covered |= set(range(i, i + 5))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def figures(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_query_equals_brute_force(spark, sample):
    folder, docs = sample
    got = {r["doc_id"]: r for r in op7_line_rules(spark, folder).collect()}
    assert len(got) == len(docs)
    assert {i: figures(r) for i, r in got.items()} == {i: brute(t) for i, t in docs}
    assert all(not r["kept"] for r in got.values() if r["base_failed"])


def test_odd_texts(make, odd_texts):
    again = "one two three four five six\n" * 4 + "one two three four five six seven"
    texts = [*odd_texts, again, "p q r s t u p q r s t v p q r s t"]
    got = {r["doc_id"]: figures(r) for r in clean_lines(make(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_lines_are_judged_one_by_one(make):
    good = "This is a plain sentence about the weather in the north today.\n"
    text = good * 3 + "Home | News | Sport | About.\nWe use cookies on this site.\nno end here\nA### b*** c$$$ d%%%.\nHEY!! HO!! GO!!"
    row = clean_lines(make([text, good + "no end\n" * 9])).orderBy("doc_id").collect()
    assert row[0]["clean_text"] == (good * 3).strip("\n") and row[0]["n_removed_lines"] == 5
    assert not row[1]["kept"]
    strict = clean_lines(make([text.replace(good, "", 2) + " words"]), LineRules(keep_share=0.99)).first()
    assert not strict["kept"]


def test_clashing_columns_nulls_and_empty_table(spark, make):
    docs = make([(None, "a. " * 20), (1, None)]).selectExpr("*", "1 as n_words", "2 as _windows", "3 as kept")
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in clean_lines(docs).collect()) == [("1", 0), ("None", 20)]
    assert clean_lines(docs.limit(0)).count() == 0
    plan = clean_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_query_equals_sql(spark, sample):
    from checks.compare import compare
    from staylight.llm.oracles import oracle_sql

    result = compare(spark, sample[0], op7_line_rules, oracle_sql()["op7_line_rules"])
    assert result.startswith("ok"), result
