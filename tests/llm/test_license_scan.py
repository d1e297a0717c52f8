import math
import re
from collections import Counter

import pytest

from staylight.llm.license_scan import MARKS, PHRASES, TEMPLATES, scan_licenses, template_matches, word_order
from staylight.llm.queries import op10_license_scan


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, templates=TEMPLATES, threshold=0.8):
    words = tokens(text)
    places = [
        (i, label)
        for label, phrase in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    best = {}
    for line in (text or "").split("\n"):
        have, held = set(tokens(line)), f" {' '.join(tokens(line))} "
        for label, template in templates:
            want, marks = set(tokens(template)), MARKS.get(label, ())
            if label == "mit":
                marks = ["mit license" if "mit" in want else "permission is hereby granted"]
            if want and all(f" {m} " in held for m in marks) and len(want & have) >= max(1, math.ceil(round(threshold * len(want), 9))):
                best[label] = max(best.get(label, 0), len(want & have) / len(want))
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | set(best))), max(best.values(), default=0.0),
    )


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_query_equals_brute_force(spark, sample):
    folder, docs = sample
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in op10_license_scan(spark, folder).collect()}
    assert got == {i: brute(t) for i, t in docs} and len(got) == len(docs)


def test_odd_texts(make, odd_texts):
    texts = [
        *odd_texts,
        "Use it UNDER the\nMIT-License; under the mit license, cc BY/nc",
        "K under the mİt license", "Licensed (under) Apache 2.0\nApache License, Version 2",
        "This work is licensed under a Creative Commons Attribution International License\n" * 3,
        "software copy of this any person obtaining charge granted hereby is permission to free",
        "cc by nc cc by nc", "apache license version",
    ]
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in scan_licenses(make(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_each_notice_has_its_own_label_alone(make):
    others = {
        "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Released under the BSD License.": "",
        "Dieser Text wird mit der Lizenz released under the License.": "",
        "This program is licensed under the GNU Lesser General Public License, version 3": "lgpl",
        "This work is licensed under the GNU General Public License, version 3, by the authors": "gpl-3",
        "This program is free software: GNU General Public License, version 2, under is the": "gpl-2",
    }
    texts = [t for _, t in TEMPLATES] + list(others)
    for wrapped in (False, True):
        got = {r["doc_id"]: r["labels"] for r in scan_licenses(make([f"One.\n{t}\nTwo." for t in texts]), wrapped=wrapped).collect()}
        want = [label for label, _ in TEMPLATES] + list(others.values())
        assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_join_is_exact_at_any_threshold(make, threshold):
    words = "a b c d e f g h".split()
    templates = [("x", "a b c d e"), ("y", "e f g h"), ("z", "h a")]
    texts = [" ".join(w for k, w in enumerate(words) if i >> k & 1) for i in range(256)]
    got = {(r["doc_id"], r["label"]) for r in template_matches(make(texts), templates, threshold).collect()}
    want = {
        (i, label) for i, t in enumerate(texts) for label, x in templates
        if len(set(t.split()) & set(x.split())) >= math.ceil(round(threshold * len(x.split()), 9))
    }
    assert got == want


def test_repeated_rows_nulls_clashes_and_empty_table(make):
    line = "Released under the MIT License."
    docs = make([(None, line), (7, line), (7, line), (7, "other"), (8, None)]).selectExpr("*", "'x' as labels", "1 as _words")
    rows = [(r["doc_id"], r["labels"]) for r in scan_licenses(docs).collect()]
    assert Counter(rows) == Counter([(None, "mit"), (7, "mit"), (7, "mit"), (7, ""), (8, "")])
    assert scan_licenses(docs.limit(0)).count() == 0
    assert word_order(docs, ["mit", "other", "zzz"]) == ["zzz", "other", "mit"]
    assert "Python" not in scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()


def test_query_equals_sql(spark, sample):
    from checks.compare import compare
    from staylight.llm.oracles import oracle_sql

    result = compare(spark, sample[0], op10_license_scan, oracle_sql()["op10_license_scan"])
    assert result.startswith("ok"), result


def test_query_finds_wrapped_notices(spark, make, tmp_path):
    import textwrap

    prose = "Some words stand before the notice and go on for a while.\n\n"
    texts = [prose + textwrap.fill(t, width) + "\n" + prose for width in (72, 40, 16) for _, t in TEMPLATES]
    make([*texts, prose * 3, "a\nb"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_license_scan(spark, str(tmp_path)).collect()}
    for i in range(len(texts)):
        label = TEMPLATES[i % len(TEMPLATES)][0]
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, texts[i]
    assert got[len(texts)]["labels"] == got[len(texts) + 1]["labels"] == ""
