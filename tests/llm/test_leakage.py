from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from conftest import rows_of

from cohortspark.llm import leakage
from cohortspark.llm.leakage import ItemIndex, alike, leaks, longest_stretch
from cohortspark.llm.words import word_batch, words

VOCABULARY = [a + b for a in ("tal", "mor", "ven", "kis", "dor", "pel", "ran", "sut") for b in ("en", "ika", "os", "ume", "alt", "ir", "eck", "ofu")]


def item(rng, n=30):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_words():
    assert words("A <b>Thi</b>rd&nbsp;*CAFÉ*, twenty‑one\n> li­ne</p><p>x_y") == ["a", "third", "cafe", "twenty", "one", "line", "x", "y"]
    assert words("") == []


def test_word_batches_are_the_words():
    texts = ["A <b>Thi</b>rd&nbsp;*CAFÉ*, twenty‑one\n> li­ne</p><p>x_y", "", None, "Straße ΣΑΣ — «Ünïcode» 3.5 ½", "plain words, only", "<p>&lt;b&gt; x</p>", "   ", "ﬁn 日本語 e\u0301"] * 3
    for given in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.string()).slice(1)):
        found = word_batch(given)
        assert [[found.vocabulary[c] for c in found.codes[a:b]] for a, b in zip(found.starts, found.starts[1:])] == [words(t) if t else [] for t in texts]
    assert len(word_batch(pa.array([], pa.string())).codes) == 0 and found.of().tolist() == [i for i, t in enumerate(texts) for _ in (words(t) if t else [])]


def test_alike():
    assert alike("later", "ltaer") and alike("the", "thee") and alike("word", "wrd") and alike("word", "ward")
    assert not alike("a", "an") and not alike("nine", "ten") and not alike("later", "rater s")


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(4)
    texts = [item(rng) for _ in range(60)]
    index = ItemIndex(enumerate(texts))
    mean, df = sum(map(len, texts)) / 60, {w: sum(w in t for t in texts) for t in texts for w in t}
    bm25 = lambda w, t: np.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    every = [{w: bm25(w, t) for w in set(t)} for t in texts]
    least = [leakage._least(e, {w: t.count(w) for w in t}, 15) for e, t in zip(every, texts)]
    for e, t, x in zip(every, texts, least):
        assert all(sum(e[w] for w in set(rng.sample(t, 15))) >= x for _ in range(20))
    for _ in range(200):
        query = {w for w in item(rng, rng.randint(1, 40)) if w in index.place}
        score = [sum(e.get(w, 0) for w in query) / x for e, x in zip(every, least)]
        at = np.array(sorted(index.place[w] for w in query), np.int64)
        twice = index.above(np.tile(at, 2), np.repeat([0, 2], len(at)), 3)
        expected = [k for k in range(60) if score[k] >= leakage.ENOUGH]
        assert [x.tolist() for x in twice] == [[0] * len(expected) + [2] * len(expected), expected * 2]


def test_stretch_against_brute_force():
    rng = random.Random(6)

    def brute(text, it, gap):
        best = {}
        for j, w in enumerate(text):
            for i, v in enumerate(it):
                if w == v:
                    best[i, j] = 1 + max((n for (a, b), n in best.items() if 0 < i - a <= gap + 1 and 0 < j - b <= gap + 1), default=0)
        return max(best.values(), default=0)

    for _ in range(200):
        it, text = [rng.choice("abcdef") for _ in range(8)], [rng.choice("abcdef") for _ in range(14)]
        assert longest_stretch(text, it, lambda w: [w], 2) == brute(text, it, 2)


def test_leaks():
    rng = random.Random(7)
    items = [item(rng) for _ in range(40)]
    index = ItemIndex(enumerate(items))
    filler = lambda n: [f"filler{rng.randint(0, 99)}" for _ in range(n)]
    held = lambda *texts: {i for _, i, *_ in leaks(word_batch(pa.array(texts, pa.string())), index)}
    it = items[3]
    assert held(" ".join(filler(200) + it + filler(90))) == {3}
    assert held(" ".join(filler(50) + it[:18] + filler(5))) == {3}
    assert held(" ".join(filler(50) + it[:11] + filler(5))) == set()
    assert held(" ".join(it[:9] + filler(12) + it[9:18] + filler(12) + it[18:26])) == set()  # not in one stretch
    assert held(" ".join(it[20:] + it[10:20] + it[:10])) == set()  # another order
    changed = [w if n % 6 else "changed" for n, w in enumerate(it)]
    assert held(" ".join(changed)) == {3}
    added = [x for n, w in enumerate(it) for x in ([w, "added"] if n % 7 == 0 else [w])]
    assert held("<p>" + "</b> <b>".join(added).upper() + "</p>") == {3}
    assert held(" ".join(w[:2] + w[3:2:-1] + w[4:] if n % 3 == 0 and len(w) > 4 else w for n, w in enumerate(it))) == {3}
    assert held(" ".join(filler(40000) + it)) == {3}
    assert held(None, "", "x") == held() == set()
    assert list(leaks(word_batch(pa.array(["x"])), ItemIndex([]))) == []


def test_found_pairs_in_shards(spark):
    rng = random.Random(9)
    items = [(i, " ".join(item(rng))) for i in range(30)]
    docs = [(i, items[i][1]) for i in range(30)] + [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([*items, (7, "other"), (None, "x"), (99, None), (98, "")], "item_id bigint, text string")
    want = sorted([(i, i) for i in range(30)] + [(102, 0), (102, 0)], key=str)
    expected = [w for w in want if w != (7, 7) or min(items[7][1], "other") == items[7][1]]
    for shard in (1000, 7):
        assert rows_of(leakage.leaked_items(d, e, shard=shard).select("doc_id", "item_id")) == expected
    assert leakage.leaked_items(d.limit(0), e.limit(0)).count() == 0


def test_scores_do_not_depend_on_shards(spark):
    rng = random.Random(10)
    e = spark.createDataFrame([(i, " ".join(item(rng, rng.randint(5, 40)))) for i in range(40)], "item_id bigint, text string")
    whole = next(leakage.indexes(e))
    scores = lambda index: {(index.ids[i], w): round(x, 12) for w, k in index.place.items() for b in range(index.first_block[k], index.first_block[k + 1]) for i, x in zip(index.item[index.block_start[b] : index.block_start[b + 1]], index.weight[index.block_start[b] : index.block_start[b + 1]])}
    parts = [scores(p) for p in leakage.indexes(e, 9)]
    assert len(parts) > 3 and {k: v for p in parts for k, v in p.items()} == scores(whole)


def test_no_half_is_missed():
    rng = random.Random(11)
    weights = [1 / (k + 1) for k in range(len(VOCABULARY))]
    items = [rng.choices(VOCABULARY, weights, k=30) for _ in range(300)]
    index, found, count = ItemIndex(enumerate(items)), 0, lambda t, w: sum(w in x for x in t)
    for i, t in enumerate(items):
        common = max(range(0, 15), key=lambda a: sum(count(items, w) for w in t[a : a + 15]))  # the half of the commonest words
        text = " ".join([*(f"filler{rng.randint(0, 99)}" for _ in range(60)), *t[common : common + 15], *(f"filler{rng.randint(0, 99)}" for _ in range(60))])
        found += i in {k for _, k, *_ in leaks(word_batch(pa.array([text])), index)}
    assert found == len(items)
