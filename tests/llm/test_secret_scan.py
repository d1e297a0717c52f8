import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylight.llm import secret_scan as ss
from staylight.llm.queries import op2_secret_scan

KINDS = ("assign", "access", "hex")


def brute(text):
    """The known shapes read literally: every match, then those too short dropped."""
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


TRAPS = [
    "password = hunter2x", "PassWord:'abc12' then token=\"abcdef==\"", "secret:abc secret:abcdef", "api_key=apikey=abcdefgh",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 16, "é🙂token: " + "a1b2c3" * 8, "0" * 23 + " " + "f" * 24 + "G",
    "token=" + "deadbeef" * 5, "ſecret=abcdefgh", "toKen=abcdefgh", "passwordpassword=abcdefgh", None, "",
]


def test_query_equals_brute_force(spark, sample):
    folder, docs = sample
    got = {r["doc_id"]: r for r in op2_secret_scan(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        want = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [want.count(f"{k}:") for k in KINDS]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_known_shapes(make, odd_texts):
    texts = TRAPS + odd_texts
    rows = ss.scan_secrets(make(texts)).select("doc_id", ss.joined("base").alias("base"), ss.joined("spans").alias("all")).collect()
    assert {r["doc_id"]: r["base"] for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", list(ss.ALPHABETS))
def test_uniform_strings_rarely_fail_the_battery(name):
    rng, letters = random.Random(9), ss.ALPHABETS[name]
    ps = np.array([
        ss.p_values(ss._codes("".join(rng.choices(letters, k=64)), name), len(letters)) for _ in range(1500)
    ])
    assert ((ps < 0.01).mean(0) < 0.035).all() and ((ps < 0.5).mean(0) > 0.3).all()


def test_prose_and_patterns_fail_the_battery():
    prose = "thequickbrownfoxjumpsoverthelazydogandthenitrestsinthesun"
    noise = "".join(random.Random(2).choices(ss.ALPHABETS["base64"], k=60))
    p = {t: ss.battery_p(ss._codes(t, "base64"), 64) for t in ("abcd" * 16, prose, noise)}
    assert p["abcd" * 16] < 0.001 and p[prose] < 0.001 < p[noise]
    assert ss.unlike_prose(prose) < 10 and ss.unlike_prose(noise) > 30
    assert ss.unlike_prose("31415926535897932384626433") < 0


def test_discoveries_are_controlled(make):
    rng = random.Random(4)
    words = ["the", "north", "wind", "blows", "over", "hills", "and", "rivers"]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    key = lambda: "".join(rng.choices(ss.ALPHABETS["base64"][:62], k=40))
    secret = [f"{prose(60)} {key()} {prose(5)}" for _ in range(80)]
    slugs = [f"{prose(60)} {'-'.join(rng.choices(words, k=8))}/{'_'.join(rng.choices(words, k=3))} {prose(5)}" for _ in range(80)]
    got = {r["doc_id"]: len(r["spans"]) for r in ss.scan_secrets(make(secret + slugs)).collect()}
    assert sum(got[i] for i in range(80)) >= 72
    assert sum(got[i] for i in range(80, 160)) <= 8


@pytest.mark.parametrize("tables", [1, 5, 15])
def test_a_key_is_found_however_small_the_table_is(make, tables):
    rng = random.Random(tables)
    texts = [f"some words and then {''.join(rng.choices(ss.ALPHABETS['base64'][:62], k=40))} and more" for _ in range(tables)]
    rows = ss.scan_secrets(make(texts)).select("doc_id", ss.joined("spans").alias("spans")).collect()
    assert {r["doc_id"]: r["spans"] for r in rows} == {i: "random:20:60" for i in range(tables)}


def brute_added(texts, battery=ss.Battery()):
    """The added spans, read from the definition in plain Python: no bins, sorted p-values."""
    from math import erfc, sqrt

    tested, decoys = [], []
    for i, text in texts.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in brute(text).split(",") if s]
        inside = {k for a, b in base for k in range(a, b)}
        # Runs of free characters; a run never crosses a base span.
        marked = "".join("\n" if k in inside else c for k, c in enumerate(text or ""))
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", marked):
            token = m[0].rstrip("=")
            name = ss.infer(token)
            if name and not (token.isalpha() and (token.islower() or token.isupper() or token.istitle())):
                ok = ss.battery_p(ss._codes(token, name), len(ss.ALPHABETS[name])) >= battery.alpha
                tested.append((ss.unlike_prose(token), ok, i, m.start(), m.end()))
                decoy = ss._decoy(text, m.start(), m.end(), len(token))
                decoys += [ss.unlike_prose(decoy)] if decoy else []
    best = None
    for z in sorted({t[0] for t in tested}):
        p = max(0.5 * erfc(z / 10 / sqrt(2)), sum(d >= z for d in decoys) / max(1, len(decoys)))
        own = sum(ok for y, ok, *_ in tested if y >= z)
        if best is None and own and p * len(tested) <= battery.rate * own:
            best = z
    return {(i, a, b) for z, ok, i, a, b in tested if ok and best is not None and z >= best}


def test_added_spans_equal_brute_force(make):
    rng = random.Random(6)
    words = "the north wind blows over hills and rivers while people read Books or count 42 stars".split()
    key = lambda k: "".join(rng.choices(ss.ALPHABETS["base64"][:62], k=k))
    name = lambda: "".join(w.title() for w in rng.choices(words, k=6)) + str(rng.randint(1, 99))
    texts = {}
    for i in range(300):
        middle = name() if i % 3 else key(rng.randint(20, 60))
        if i % 30 == 0:
            middle = "AKIA" + "Q" * 16 + "_" + middle
        texts[i] = f"{' '.join(rng.choices(words, k=30))} {middle} {' '.join(rng.choices(words, k=4))}"
    rows = ss.scan_secrets(make(list(texts.items()))).select("doc_id", F.inline("spans")).filter("kind = 'random'").collect()
    got = {(r["doc_id"], r["start"], r["end"]) for r in rows}
    assert got == brute_added(texts)
    right = {i for i, _, _ in got if i % 3 == 0}
    assert len(right) >= 85 and len({i for i, _, _ in got}) - len(right) <= 0.1 * len(right)


def test_prose_adds_next_to_nothing(make):
    rng = random.Random(1)
    parts = "get set user account name list value by id all in order with date from the group of first last item".split()
    texts = []
    for _ in range(3000):
        first, *rest = rng.choices(parts, k=7)
        texts.append(f"a call of {first + ''.join(w.title() for w in rest)} or {'_'.join(rest)}/{'-'.join(rest)}{rng.randint(0, 9999)} here")
    assert sum(len(r["spans"]) > 0 for r in ss.scan_secrets(make(texts)).collect()) <= 3


def test_stretches_beside_known_shapes_and_mixed_alphabets():
    assert list(ss._free(0, 10, [(2, 4), (4, 6), (9, 12)])) == [(0, 2), (6, 9)]
    assert list(ss._free(3, 8, [(0, 5)])) == [(5, 8)] and list(ss._free(3, 8, [(0, 9)])) == []
    text = "path/" + "aB3" * 10 + "-x"
    assert list(ss._encoded(text, 0, len(text), 20)) == [(0, 35, "base64")]


def test_decoys_come_from_the_prose_around():
    assert ss._decoy("one two three XXXX", 14, 18, 8) == "twothree"
    assert ss._decoy("XXXX one two", 0, 4, 6) == "onetwo"
    assert ss._decoy("1 XXXX 2", 2, 6, 4) is None


def test_repeated_rows_nulls_clashes_and_empty_table(make):
    docs = make([(None, "password=abcdefgh"), (1, "password=abcdefgh"), (1, "password=abcdefgh")]).selectExpr("*", "1 as base", "2 as spans")
    assert [len(r["spans"]) for r in ss.scan_secrets(docs).collect()] == [1, 1, 1]
    assert ss.scan_secrets(docs.limit(0)).count() == 0
