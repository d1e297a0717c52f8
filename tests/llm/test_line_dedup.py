import random
import re

import numpy as np
import pytest

from staylight.llm import line_dedup as ld
from staylight.llm.queries import op3_line_dedup

RUNS = ld.Runs(words=12)


def brute(texts, least, line=8):
    """From the words alone: every window of ``least`` words, and every shorter whole line, that stands earlier is cut.
    Returns the words left of each text and how many were cut."""
    windows, lines, out = set(), set(), {}
    for i, text in sorted(texts.items()):
        folded, gone, at = (text or "").casefold().split(), set(), 0
        for p in range(len(folded) - least + 1):
            window = tuple(folded[p : p + least])
            if window in windows:
                gone.update(range(p, p + least))
            windows.add(window)
        # A word or phrase over and over: the first window of it is the first occurrence, and stays.
        for a in sorted(k for k in gone if k - 1 not in gone):
            for d in range(1, min(least - 1, a) + 1):
                if folded[a - d : a - d + least] == folded[a : a + least]:
                    gone -= set(range(a, a - d + least))
                    break
        for one in (text or "").casefold().split("\n"):
            one = tuple(one.split())
            if line <= len(one) < least:
                if one in lines:
                    gone.update(range(at, at + len(one)))
                lines.add(one)
            at += len(one)
        out[i] = [w for k, w in enumerate((text or "").split()) if k not in gone], len(gone)
    return out


def left(frame):
    return {r["doc_id"]: ((r["text"] or "").split(), r["removed_words"]) for r in frame.collect()}


def results(frame):
    return {r["doc_id"]: (r["text"], r["removed_lines"], r["removed_words"]) for r in frame.collect()}


def test_query_equals_brute_force(spark, sample):
    folder, docs = sample
    found = op3_line_dedup(spark, folder)
    assert left(found) == brute(dict(docs), 20)
    texts = dict(docs)
    assert all(t == texts[i] for i, (t, _, words) in results(found).items() if not words)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 9))).capitalize() + rng.choice(". ! ?".split())
    prose = lambda k: " ".join(sentence() for _ in range(k))
    passages = [prose(8) for _ in range(5)]
    texts = []
    for i in range(40):
        head, tail = prose(4), prose(4)
        inside = passages[i % 5] if i % 2 else ""
        # In the middle of a line, so that its first and last sentence join on to others.
        texts.append(f"{head} {word()} {word()} {inside} {word()} {word()}\n{tail}")
    return texts, passages


def test_passages_go_where_they_come_again(make, planted):
    texts, passages = planted
    frame = ld.without_repeats(make(texts), RUNS)
    got = results(frame)
    assert left(frame) == brute(dict(enumerate(texts)), 12)
    for k, passage in enumerate(passages):
        holders = [i for i in range(40) if i % 2 and i % 5 == k]
        inner = " ".join(passage.split()[10:-10])
        assert inner in got[holders[0]][0]
        assert all(inner not in got[i][0] for i in holders[1:])
    for i in range(0, 40, 2):
        assert got[i] == (texts[i], 0, 0)


def test_repeats_within_a_text_and_short_ones(make):
    long = "This sentence has a good dozen words so that it stands by itself here."
    texts = {0: f"{long} Other words.\n{long} End.", 1: "Short one. Short two.\n" + "Short one. Short two.", 2: long.upper()}
    got = results(ld.without_repeats(make(list(texts.items())), RUNS))
    assert got[0][0].count("dozen") == 1 and got[0][1] == 1
    assert got[1] == (texts[1], 0, 0)
    assert got[2] == ("", 1, 14)


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(200):
        common = [f"w{rng.random()}." for _ in range(ld.GRAM + ld.WINDOW - 1)]
        prints = []
        for _ in range(2):
            text = [f"x{rng.random()}." for _ in range(rng.randint(0, 6))]
            lines = text + common + [f"y{rng.random()}." for _ in range(rng.randint(0, 6))]
            prints.append(set(ld.fingerprints(" ".join(lines), RUNS)[2].tolist()))
        # Texts as short as the window have one fingerprint, which need not be in the common part.
        if min(map(len, prints)) > 1:
            assert prints[0] & prints[1]


def test_lines_join_to_the_text(odd_texts):
    for text in [*odd_texts, "a.b!\n\n?c; d | e", "...", "no end"]:
        assert "".join(ld.lines_of(text or "")) == (text or "")


def test_odd_texts_repeated_and_missing_ids_clashes_and_empty_table(make, odd_texts):
    line = "One line with more than twelve words in it, counted by hand to be sure."
    rows = [*enumerate(odd_texts), (50, line), (51, line), (51, line), (None, line), (52, line), (53, "other. " + line)]
    docs = make(rows).selectExpr("*", "1 as place", "2 as _of", "3 as spans")
    got = ld.without_repeats(docs, RUNS).collect()
    assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[50] == [line] and by[51] == ["", ""] and by[None] == [""] and by[52] == [""] and by[53] == ["other."]
    assert by[0] == [None] and by[1] == [""]
    assert ld.without_repeats(docs.limit(0), RUNS).count() == 0


def test_every_repeated_window_goes_wherever_sentences_end(make):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    some = lambda k: [word() for _ in range(k)]
    # 60 words inside one sentence of each text, with no line edge in common; and 20 words, the least there is.
    passage, short = some(60), some(20)
    part = passage[7:45]
    texts = {
        0: some(9) + part + some(5), 1: some(5) + passage + some(8), 2: some(30) + passage + some(1) + short + some(4),
        3: short + some(3) + passage[:19] + some(2) + [x.upper() for x in passage[20:41]], 4: ["ho"] * 90, 5: some(2) + ["ho"] * 70,
    }
    texts = {i: " ".join(t) for i, t in texts.items()}
    # By the definition, from the words alone.
    seen, want = set(), {}
    for i, text in texts.items():
        words = text.lower().split()
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        want[i] = [w for k, w in enumerate(text.split()) if k not in gone]
    want[4] = ["ho"] * 20
    got = results(ld.without_repeats(make(list(texts.items()))))
    assert {i: t.split() for i, (t, _, _) in got.items()} == want
    assert [len(want[i]) for i in range(6)] == [52, 35, 55, 24, 20, 2]
    assert got[2][2] == 60 and got[3][2] == 41 and got[5][2] == 70


def test_whole_lines_go_where_they_come_again(make):
    line, other = "nine plain words stand on this one short line", "a second line that has nine words in it"
    texts = {i: f"w{i} x{i} y{i}\n{line}\nz{i}" for i in range(30)}
    texts |= {40: f"{line}\n" * 4 + other, 41: f"{other}\n{line.upper()} and more", 42: "only six words in this line\n" * 2}
    frame = ld.without_repeats(make(list(texts.items())))
    got = results(frame)
    assert got[0] == (texts[0], 0, 0) and all(got[i][0].split() == [f"w{i}", f"x{i}", f"y{i}", f"z{i}"] for i in range(1, 30))
    assert got[40] == ("\n" + other, 4, 36) and got[42] == (texts[42], 0, 0)
    assert got[41][0].strip() == f"{line.upper()} and more"


def test_every_row_is_a_text_of_its_own(make):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    same, clean = text(), text()
    docs = make([(1, same), (2, same), (2, same), (None, same), (3, same), (3, clean), (3, clean), (None, None), (-4, text())])
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in ld.without_repeats(docs).collect())
    assert [t for _, t in got].count(same) == 1 and (1, same) in got
    assert [t for _, t in got].count(clean) == 1 and (3, clean) in got
    assert len(got) == 9
    only = make([(None, same), (None, same)])
    assert sorted(r["text"] for r in ld.without_repeats(only).collect()) == ["", same]


def mixed_texts(rng, n):
    """Texts with words of all lengths, among them clashes of case and size, and every kind of blank."""
    blanks = [" "] * 9 + ["\n", "\t", " \n ", "\u3000", "\xa0", "\x85", "\x1c", "\u2003", "\u2028", "\r\n"]
    odd = ["Ho", "ho.", "ß", "SS", "K", "k", "\u212a", "x;", "...", "中文字", "🙂|", "\u200b", "\xc2"]
    odd += ["â", "â\0", "\0", "é" * 400]
    some = lambda: "".join(rng.choices("abAéÉ.!中", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 30, 64, 65])))
    out = []
    for _ in range(n):
        vocabulary = [rng.choice(odd) if rng.random() < 0.3 else some() for _ in range(rng.choice([1, 3, 40]))]
        text = "".join(rng.choice(vocabulary) + rng.choice(blanks) for _ in range(rng.choice([0, 1, 5, 60, 150])))
        out.append(rng.choice([text, text.rstrip(), rng.choice(blanks) + text, None]))
    return out


def test_words_are_hashed_without_a_call_for_each(monkeypatch, odd_texts):
    calls, real = [], ld.xxhash.xxh64_intdigest
    monkeypatch.setattr(ld.xxhash, "xxh64_intdigest", lambda x: calls.append(x) or real(x))
    texts = ["Some plain words, and longer-than-eight-bytes ones.\n" * 200, "É à la carte\xa0! " * 50, "x" * 500, "ho " * 9]
    words = ld._Words(texts)
    assert len(calls) <= 1 and words.counts.tolist() == [len(t.split()) for t in texts]
    texts = [*mixed_texts(random.Random(4), 300), *odd_texts]
    words = ld._Words(texts)
    folded = [w for t in texts for w in (t or "").casefold().split()]
    assert words.counts.tolist() == [len((t or "").split()) for t in texts]
    lines = [len(line.split()) for t in texts for line in (t or "").split("\n")]
    assert [n for n in words.lines.tolist() if n] == [n for n in lines if n]
    hashes = words.stretch(np.arange(len(folded)), 1).tolist()
    assert len(set(zip(hashes, folded))) == len(set(hashes)) == len(set(folded))


def test_the_first_pass_sends_pieces_only(make, planted):
    docs = make(planted[0])
    pieces = ld._prints(docs, RUNS, ["piece"])
    assert pieces.columns == ["piece"]
    assert sorted(pieces.collect()) == sorted(ld._prints(docs, RUNS).select("piece").collect())


def test_texts_are_cut_side_by_side_as_one_by_one():
    rng = random.Random(9)
    for _ in range(60):
        texts, spans = mixed_texts(rng, 5), []
        for text in texts:
            n = len((text or "").split())
            runs = [(i, min(n, i + 12 + rng.choice([0, 0, 30]))) for i in rng.choices(range(max(1, n - 11)), k=3) if n >= 12]
            spans.append([*runs, *[(i, i + 8) for i in rng.choices(range(max(1, n - 7)), k=2) if n >= 8]][: rng.randint(0, 5)])
        coded = [t if t is None else t.encode() for t in texts]
        flat = lambda some: np.array([s for one in some for s in one], np.int32).reshape(-1, 2)
        got = [*zip(*ld.cut_runs(coded, np.array([len(s) for s in spans]), flat(spans), 12))]
        for text, one, (left_, lines, words) in zip(coded, spans, got):
            alone = ld.cut_runs([text], np.array([len(one)]), flat([one]), 12)
            assert (left_, lines, words) == tuple(x[0] for x in alone)
            if not one:
                assert (left_, lines, words) == (text, 0, 0)
                continue
            # Each word keeps the blanks before it, the last one those behind it too.
            units = ld.lines_of(text.decode())
            gone = {k for a, b in one if b - a < 12 for k in range(a, b)}
            covered = {k for a, b in one if b - a >= 12 for k in range(a, b)}
            folded = [u.casefold().strip() for u in units]
            for a in sorted(k for k in covered if k - 1 not in covered):
                for d in range(1, min(11, a) + 1):
                    if folded[a - d : a - d + 12] == folded[a : a + 12]:
                        covered -= set(range(a, a + 12 - d))
                        break
            gone |= covered
            assert left_.decode() == "".join(u for k, u in enumerate(units) if k not in gone) and words == len(gone)
            runs = "".join(u if k in gone else "\r\0" for k, u in enumerate(units)).split("\r\0") if gone else []
            logical = r"[^.!?;|\n]*[.!?;|\n]+|[^.!?;|\n]+"
            assert lines == sum(len(re.findall(logical, run.strip())) for run in runs if run.strip())
