import random

import numpy as np
import pytest

from staylight.llm import near_dup as nd
from staylight.llm.graph import components
from staylight.llm.oracles import oracle_sql
from staylight.llm.queries import op5_near_dup


def brute(texts, words, percent=80):
    sets = {i: set(nd.shingles(t or "", words).tolist()) for i, t in texts}
    ids, label = sorted(sets), {}
    for i in ids:
        label[i] = i
    changed = True
    near = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def results(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def test_query_equals_brute_force_and_sql(spark, sample):
    from checks.compare import compare

    folder, docs = sample
    assert results(op5_near_dup(spark, folder)) == brute(docs, 4)
    result = compare(spark, folder, op5_near_dup, oracle_sql()["op5_near_dup"])
    assert result.startswith("ok"), result


@pytest.fixture(scope="module")
def edited():
    """Copies, chains of edits that drift away from their start, and unrelated texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for length in (1, 3, 5, 8, 20, 60, 200):
        for _ in range(3):
            now = [word() for _ in range(length)]
            for _ in range(10):
                texts.append(" ".join(now))
                if rng.random() < 0.7:
                    for _ in range(max(1, length // 60)):
                        now[rng.randrange(length)] = word()
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("words", [1, 4, 5])
def test_components_equal_brute_force(make, edited, words):
    got = results(nd.near_duplicates(make(edited), nd.Hashing(words=words)))
    assert got == brute(list(enumerate(edited)), words)


def test_rounds_find_links_that_stars_miss(make, spark):
    # One bucket holds all of these: the smallest is far from the others, which are linked.
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:300])]
    for k in range(12):
        own = base[:]
        for _ in range(k % 4):
            own[rng.randrange(400)] = f"z{k}"
        texts.append(" ".join(own))
    docs = make(texts)
    nodes = spark.createDataFrame([(i, [1]) for i in range(len(texts))], "node long, buckets array<long>")
    got = {r["node"]: r["component"] for r in nd.links(docs, nodes, nd.Hashing()).collect()}
    want = {i: c for i, (_, c, _) in brute(list(enumerate(texts)), 5).items()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want
    assert len(set(want.values())) > 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefix_join_finds_every_link_around_the_limit(spark, seed):
    """Sets of all sizes, 0.6 to 0.95 alike, each a component of its own but for one large one."""
    rng = random.Random(seed)
    cores = [rng.sample(range(10**6), 60) for _ in range(3)]
    sets = []
    for i in range(150):
        core, size = rng.choice(cores), rng.randint(2, 60)
        own = set(core[:size])
        for x in rng.sample(sorted(own), k=rng.randint(0, max(1, size // 4))):
            own.discard(x)
            if rng.random() < 0.6:
                own.add(rng.choice([10**7 + i * 100 + x % 100, 10**8 + x % 5]))
        sets.append(sorted(own) or [1])
    nodes = spark.createDataFrame([(i, 0 if i < 20 else i) for i in range(150)], "node long, component long")
    frame = spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>")
    pairs = {(r["a"], r["b"]) for r in nd._prefix_pairs(nodes, frame, 80).collect()}
    alike = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
    linked = {(a, b) for a in range(150) for b in range(max(a + 1, 20), 150) if alike(a, b)}
    assert linked <= pairs and len(linked) > 20
    assert not any(b < 20 for _, b in pairs)


def test_sets_just_below_the_limit_make_no_pairs(spark):
    """A thousand sets that share six sevenths of their shingles, 0.75 alike: their rarest ones are their own."""
    sets = [(i, list(range(60)) + [1000 + 10 * i + k for k in range(10)]) for i in range(1000)]
    frame = spark.createDataFrame(sets, "node long, grams array<long>")
    nodes = frame.selectExpr("node", "node as component")
    assert nd._prefixes(nodes, frame, 80).filter("first").count() == 0
    assert nd._prefix_pairs(nodes, frame, 80).count() == 0


def test_rows_that_share_an_id_stand_for_themselves(make):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    docs = make([(1, words), (1, words), (3, words + " end"), (3, other), (2, words), (None, words), (None, other.replace("v", "u")), (4, None), (4, "")])
    kept = [tuple(r) for r in nd.representatives(docs).select("doc_id", "text").collect()]
    assert sorted(kept, key=repr) == sorted([(1, words), (3, other), (None, other.replace("v", "u")), (4, None), (4, "")], key=repr)


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    for size, common in ((5, 4), (50, 40), (2000, 1600)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[size - common :])
            agree.append((nd.signature(a, 112) == nd.signature(b, 112)).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.08
    one = nd.signature(np.array([7], np.uint64), 112)
    assert len(set(one.tolist())) == 1


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(100, 100)]
    loop = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame(path + star + loop + loop, "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(7)}}
    assert components(edges.limit(0)).count() == 0


def test_odd_texts_repeated_and_missing_ids_clashes_and_empty_table(make, odd_texts):
    rows = [*enumerate(odd_texts), (70, "some text of its own here"), (70, "some text of its own here"), (None, "word"), (80, "word")]
    docs = make(rows).selectExpr("*", "1 as node", "2 as component", "3 as buckets")
    got = nd.near_duplicates(docs, nd.Hashing(words=4)).collect()
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t in rows if i is not None], 4)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    kept = nd.representatives(docs, nd.Hashing(words=4))
    groups = {c for _, c, _ in brute([(i, t) for i, (_, t) in enumerate(rows)], 4).values()}
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_words_end_at_ascii_white_space_only():
    assert len(nd.shingles("A\x0bb\x1cc d E", 1)) == 3
    assert nd.shingles("A B", 4).tolist() == nd.shingles("a\tb", 4).tolist()
    assert nd.shingles("É b", 4).tolist() != nd.shingles("é b", 4).tolist()
