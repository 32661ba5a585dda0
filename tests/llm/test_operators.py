"""Each operator against a plain reading of its contract, on documents full of edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfold.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, quality_classifier, quality_rules, rangecoder, simhash, substring_dedup, token_output

from .conftest import lowered, prose, words


def same(got, want, tolerance=1e-9):
    """Equal multisets of rows, doubles to a tolerance."""
    key = lambda r: tuple((v is not None, v if not isinstance(v, float) else round(v, 6)) for v in r)
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(y, float) and x == pytest.approx(y, rel=tolerance)), (a, b)


def oracle(docs, sql):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con = duckdb.connect()
    con.register("documents", table)
    return con.execute(sql).df()


def against_sql(got, docs, sql):
    want = oracle(docs, sql)
    none = lambda v: None if v is None or v is pd.NA or v != v else v
    same([[r[c] for c in want.columns] for r in got.collect()], [[none(v.item() if hasattr(v, "item") else v) for v in r] for r in want.itertuples(index=False)])


# 1 SimHash


def fingerprint(text):
    w = lowered(text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows):
    prints = [fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]


def test_simhash(docs, rows):
    same(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect(), linked(rows))


def test_simhash_keeps_one(docs, rows):
    want = {c for _, _, c in linked(rows)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_keep_one_takes_near_copies_of_five_word_shingles(spark):
    """Components at Jaccard 0.8 by comparing all pairs, with pairs far beyond op1's three bits and a bucket of many rounds."""
    rnd = np.random.default_rng(8)
    word = lambda: f"w{rnd.integers(0, 5000)}"
    texts = []
    for g in range(25):
        base = [word() for _ in range(150)]
        for k in range(40 if g == 0 else 5):
            t = list(base)
            for at in rnd.choice(150, rnd.integers(0, 6) if k else 0, replace=False):
                t[at] = word()
            texts.append(" ".join(t))
    passage = [word() for _ in range(120)]
    texts += [" ".join(passage + [word() for _ in range(50)]) for _ in range(30)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    far = 0
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 3
            up[max(find(i), find(j))] = min(find(i), find(j))
    assert far > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted({find(i) for i in range(len(texts))})


def test_far_copies_of_one_text_do_not_meet_in_all_pairs(spark, monkeypatch):
    """Many copies of a text, each with its own changes, meet in few candidates, and no link is lost."""
    from inkfold.llm import jaccard

    rnd = np.random.default_rng(9)
    word = lambda: f"w{rnd.integers(0, 50_000)}"
    base, texts = [word() for _ in range(200)], []
    for k in range(600):
        t = list(base)
        for at in rnd.choice(200, rnd.integers(4, 13), replace=False):
            t[at] = word()
        if k % 6 == 5:  # a near copy of the one before
            t = texts[-1].split()
            t[rnd.integers(0, 200)] = word()
        texts.append(" ".join(t))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if alike(i, j):
            up[max(find(i), find(j))] = min(find(i), find(j))
    met, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, found: met.append(pairs.count()) or verified(pairs, found))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted({find(i) for i in range(len(texts))}) and 300 < len(kept) < 510
    assert sum(met) < 45 * len(texts)


def test_close_finds_every_link_of_a_bucket():
    """Sets of many sizes about a base, against all pairs; whatever the base, and with what is joined already."""
    from inkfold.llm import jaccard

    rnd = np.random.default_rng(10)
    for case in range(60):
        core = rnd.choice(1 << 20, rnd.integers(3, 90), replace=False)
        spread = rnd.integers(1, 40)
        sets = []
        for _ in range(rnd.integers(2, 60)):
            source = sets[rnd.integers(0, len(sets))] if sets and rnd.random() < 0.3 else core
            keep = rnd.random(len(source)) > rnd.random() * spread / 100
            sets.append(np.unique(np.r_[source[keep], rnd.choice(1 << (20 if case % 2 else 7), rnd.integers(0, spread))]).astype(np.uint64))
        sets = [s for s in {s.tobytes(): s for s in sets}.values() if len(s)]
        base = [np.zeros(0, np.uint64), np.unique(core).astype(np.uint64), sets[0]][case % 3]
        root = np.arange(len(sets))
        if case % 4 == 0:
            root[: len(root) // 2] = 0
        up = root.tolist()

        def find(x, up):
            while up[x] != x:
                x = up[x]
            return x

        want = list(up)
        for i, j in combinations(range(len(sets)), 2):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                x, y = find(i, want), find(j, want)
                want[max(x, y)] = min(x, y)
        a, b = jaccard._close(root, np.array([len(s) for s in sets]), [np.setxor1d(s, base) for s in sets])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9
            x, y = find(i, up), find(j, up)
            up[max(x, y)] = min(x, y)
        assert [find(i, up) for i in range(len(sets))] == [find(i, want) for i in range(len(sets))]


def test_simhash_search_finds_every_link(spark):
    """Chains and balls of fingerprints: the search gives the components of all links, whatever the plan."""
    rnd = np.random.default_rng(3)
    centers = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(rnd.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in centers.tolist():
        for _ in range(30):
            x = c
            for b in rnd.choice(64, rnd.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, i, i) for i, p in enumerate(signed)], "fp long, first long, keeper long")
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.fp: r.component_id for r in simhash.classes(nodes).collect()} == {p: find(i) for i, p in enumerate(signed)}


def test_simhash_hot_buckets(spark, monkeypatch):
    """Components do not change when every bucket is dealt anew, and when every bucket is large."""
    rnd = np.random.default_rng(4)
    prints = {int(c) ^ sum(1 << int(b) for b in rnd.choice(64, k, replace=False)) for c in rnd.integers(0, 1 << 62, 12) for k in (0, 1, 1, 2, 3, 4, 6) for _ in range(6)}
    prints |= {x & 0xFFFFFFFFFFFF | 5 << 48 for x in prints}
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i, i) for i, x in enumerate(sorted(prints))], "fp long, first long, keeper long")
    want = sorted(map(tuple, simhash.classes(nodes).select("fp", "component_id").collect()))
    monkeypatch.setattr(simhash, "HOT_BUCKET", 3)
    assert sorted(map(tuple, simhash.classes(nodes).select("fp", "component_id").collect())) == want
    every = np.array(sorted(prints), np.uint64).view(np.int64)
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    found = simhash._forest(simhash._links(np.array([0]), np.ones(len(every), bool), every, 3))
    least = {x: i for i, x in enumerate(every.tolist())}
    group = {x: x for x in least} | dict(zip(*found, strict=True))
    ids = {}
    for x in least:
        ids[group[x]] = min(ids.get(group[x], 1 << 60), least[x])
    assert sorted((x, ids[group[x]]) for x in least) == want


def test_simhash_plan_spends_the_whole_budget():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500)
    for n in (10, 10_000, 100_000_000):
        parts = simhash.plan(n, together)
        assert sum(t + 1 for _, t in parts) == simhash.MAX_BITS + 1


# 2 token ids


def test_words_in_pieces_have_the_tokenizers_ids(monkeypatch):
    """Words of all printable ASCII, of letters beyond it, added tokens and contractions: the whole tokenizer's ids, and few words go through it."""
    import public_tokenizers

    rnd = np.random.default_rng(12)
    path = public_tokenizers.path("word_bpe_49k.json")
    ascii_ = [chr(c) for c in range(33, 127)]
    words = ["".join(rnd.choice(ascii_, rnd.integers(1, 14))) for _ in range(4_000)] + ["".join(rnd.choice(list("abETzQ0,.-'"), rnd.integers(1, 20))) for _ in range(4_000)]
    words += ["don't", "<|endoftext|>", "a<|startoftext|>b", "Été,", "İx", "\x00a\x1fb\x7f", "e\u0301", "ﬁ", "x" * 3_000, *ascii_]
    tokens, whole = token_output.WordTokens(path), token_output.WordTokens(path, by_word=False)
    asked, encode = [], tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    texts = [w.encode() for w in words]
    for a, b in zip(tokens(texts, 2), whole(texts, 2), strict=True):
        assert a.tolist() == b.tolist()
    assert 0 < len(asked) < 0.5 * len(set(words))


def test_token_output_is_in_order(docs, spark):
    starts = [r.start for r in token_output.token_output(docs.unionAll(docs).repartition(7)).collect()]
    assert starts == sorted(starts) and len(starts) == 2 * docs.count()


def test_token_output(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for r in order:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(token_output.token_output(docs).collect(), want)


def test_word_tokens_equal_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [x.encode() for x in ["It's  a\tTEST, isn't it?", "", "naïve été   x y", "<|endoftext|> a<|endoftext|>b", "12,345.67 !!! ÄÖ ﬁ", "a\x1cb 　 c"]]
    for a, b in zip(token_output.WordTokens(path)(texts, 2), token_output.WordTokens(path, by_word=False)(texts, 2), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("n", [0, 1, 2, 300, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 2, 300, 131072])
def test_range_coder_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n)
    ids[: n // 3] = ids[:7].repeat(n)[: n // 3] if n else ids[:0]
    frame = rangecoder.encode_frame([5, None], np.array([n, 0]), ids)
    doc_ids, lengths, out = rangecoder.decode_frame(frame)
    assert doc_ids == [5, None] and lengths.tolist() == [n, 0] and np.array_equal(out, ids)
    for cut in (frame[:20], frame[:-1], frame + b"\0"):
        with pytest.raises(rangecoder.FrameError):
            rangecoder.decode_frame(cut)


def test_range_coder_finds_every_changed_byte():
    ids = np.random.default_rng(1).integers(0, 50_000, 150)
    frame = rangecoder.encode_frame([7, None, -3], np.array([100, 0, 50]), ids)
    for at in range(len(frame)):
        for flip in (1, 0x80):
            bad = bytearray(frame)
            bad[at] ^= flip
            with pytest.raises(rangecoder.FrameError):
                rangecoder.decode_frame(bytes(bad))


def test_range_coder_refuses_large_ids():
    with pytest.raises(rangecoder.FrameError):
        rangecoder.encode_frame([1], np.array([1]), np.array([rangecoder.MAX_ID + 1]))


# 3 licenses


def test_license_scan_base(docs, rows):
    def one(r):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r[1]))
        hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return r[0], len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = license_scan.license_scan(docs)
    same(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), [one(r) for r in rows])
    assert got.filter("score < 0 or score > 1 or (n_base > 0 and score < 1)").count() == 0


def test_license_join_is_exact(spark):
    """Every block and template over the threshold, and no other, by comparing all of them."""
    found = license_scan.templates()
    texts = ["Released under the MIT license", "this is licensed, under\nCC BY-NC 4.0 now", "licensed under the apache license", "nothing here", "the license", "Licensed under the GNU Lesser General Public License version 3", "License: mit, released under the", ""]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        lines = [x.split() for x in license_scan.cleaned(texts[r.doc_id].encode()).split(b"\n")]
        want = set()
        for at in range(len(lines)):
            for n in (1, 2):
                if at + n <= len(lines):
                    held = {w for x in lines[at : at + n] for w in x}
                    want |= {(k, at, n) for k, (_, t) in enumerate(found) if len(t & held) >= math.ceil(license_scan.THRESHOLD * len(t))}
        assert {(b.template, b.first_line, b.lines) for b in r.blocks} == want
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)] == ["mit", "cc-by-nc", "apache", "", "", "gpl,lgpl", "mit", ""]


def test_license_scan_finds_wrapped_notices_and_bodies(spark):
    fill = "some other words stand here and go on for long\n" * 30
    mit = license_scan.BODIES["mit"][0]
    texts = [
        (fill + "Licensed under the\n\nMozilla Public\n# License, version 2.0\n" + fill, "mpl"),
        ("\n".join("This work is licensed under CC BY-SA 4.0".split()), "cc-by-sa"),
        (fill + mit + "\n" + fill, "mit"),
        (fill + "\n\n".join(mit.split()) + "\n" + fill, "mit"),
        *[(fill + body + "\n" + fill, label) for label in ("isc", "bsd", "apache", "unlicense") for body in license_scan.BODIES[label]],
        (fill + "licensed\n" + fill + "under\n" + fill + "mozilla\n" + fill + "public license version 2 0", ""),
    ]
    rows = license_scan.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {i: x for i, (_, x) in enumerate(texts)}


# 4 LM


def lm(rows):
    """A literal automaton: a dictionary of states with their arcs, walked one token at a time along failure arcs."""
    tokens = [[*lowered(r[1]).encode().split(), b"\n"] for r in rows]
    out = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows]
    train = [[b"\n", *t] for t, o in zip(tokens, out, strict=True) if not o]
    c = Counter(w for t in train for w in t[1:])
    n, v = sum(c.values()), len(c)
    grams = [c, Counter(x for t in train for x in zip(t, t[1:], strict=False)), Counter(x for t in train for x in zip(t, t[1:], t[2:], strict=False))]
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    states = {(): (None, {})}
    states |= {(w,): (math.log10(100 / (k + 100)), {}) for w, k in c.items()}
    states |= {x: (math.log10(20 / (k + 20)), {}) for x, k in grams[1].items()}
    for (u, w), k in grams[1].items():
        states[u,][1][w] = math.log10((k + 100 * p1(w)) / (c[u] + 100))
    for (t, u, w), k in grams[2].items():
        states[t, u][1][w] = math.log10((k + 20 * 10 ** states[u,][1][w]) / (grams[1][t, u] + 20))
    for r, t, o in zip(rows, tokens, out, strict=True):
        score, state, said = 0.0, (b"\n",) if c else (), (b"\n",)
        for w in t:
            while state and w not in states[state][1]:
                score, state = score + states[state][0], state[1:]
            score += states[state][1][w] if state else math.log10(p1(w))
            said = (*said, w)[-2:]
            state = next(x for x in (said, said[1:], ()) if x in states)
        yield r[0], o, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score


def test_lm_counts_have_64_bits():
    big = np.array([0, 1, 255, 256, 1 << 31, (1 << 32) + 7, (1 << 62) + 5], np.uint64)
    assert lm_score.from_planes(lm_score.planes(big), len(big)).tolist() == big.tolist()
    assert len(lm_score.planes(big[:3])) == 4


def test_lm_states_of_each_order(spark):
    """Texts that lead to states of two words, to one after an unseen pair, and to the root, each followed by seen and unseen words."""
    ids = [i for i in range(1, 200) if not lm_score.held_out(i)][:12]
    texts = [(i, ["a b c", "a b d", "b c a", "c a b a"][k % 4]) for k, i in enumerate(ids)]
    probes = ["a b", "x a b", "a b b", "c b", "b", "d c b"]  # what leads to (a b), to (b) after an unseen pair
    following = ["a", "b", "c", "d", "new"]
    hold = [i for i in range(1, 1000) if lm_score.held_out(i)]
    asked = [p + " " + f for p in probes for f in following]
    every = [*texts, *zip(hold, [*probes, *asked], strict=False)]
    got = {r.doc_id: r.score for r in lm_score.lm_score(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    want = {r[0]: r[6] for r in lm(every)}
    assert got == pytest.approx(want, abs=1e-9)


def test_lm_score(docs, rows):
    same(lm_score.lm_score(docs).collect(), list(lm(rows)), 1e-6)


def test_lm_score_learns_pairs_of_seldom_words(spark):
    """A held-out text with word pairs seen twice in training scores above one with the same words in another order."""
    ids = range(1, 100)
    out = [i for i in ids if lm_score.held_out(i)][:2]
    train = [i for i in ids if not lm_score.held_out(i)][:20]
    seen = "alpha beta gamma delta"
    texts = [(i, seen if k < 2 else f"filler{k} text{k}") for k, i in enumerate(train)] + [(out[0], seen), (out[1], "gamma alpha delta beta")]
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    a, b = got[out[0]], got[out[1]]
    assert a.base_score == pytest.approx(b.base_score) and a.score > b.score + 0.05


# 5 classifier


def test_quality_classifier_held_out(spark):
    import random

    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        toxic, junk = rnd.random() < 0.15, rnd.random() < 0.2
        text = prose(rnd, rnd.randint(60, 120))
        if toxic:
            text += " " + " ".join("vile" + rnd.choice("abcdefgh") for _ in range(4))
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", f"s{i % 5}"))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    truth = {i: (("vile" in t.lower()), t.isupper() or "!!" in t) for i, t, *_ in docs}
    d = spark.createDataFrame([*docs, (5000, None, None, None)], "doc_id long, text string, lang string, source string")
    got = quality_classifier.quality_classifier(d, spark.createDataFrame([*labels, (99999, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 901
    held = [r for r in got if r.doc_id % 3 == 0]
    assert sum(r.is_toxic != truth[r.doc_id][0] for r in held if r.doc_id in truth) <= 3
    assert sum(r.kept != (not truth[r.doc_id][0] and not truth[r.doc_id][1]) for r in held if r.doc_id in truth) <= 6


def test_quality_classifier_by_brute_force(spark):
    """Weights by dense steps, sums of weights, shrunk site rates and posterior, all computed anew in plain Python."""
    import random

    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(160):
        bad = rnd.random() < 0.4
        docs.append((i, " ".join(rnd.choices(["ill", "poor", "x"] if bad else ["fine", "well", "x"], k=rnd.randint(3, 9))), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None])))
        if i % 4:
            labels.append((i, int(not bad) if i % 9 else None, int(bad and rnd.random() < 0.5)))
    labels += [labels[5], (7777, 1, 1), (None, 0, 1)]
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    text, site = {d[0]: d[1].encode() for d in docs}, {d[0]: (d[3], d[2]) for d in docs}
    used = [x for x in labels if x[0] in text]
    held = Counter(f for x in used for f in quality_classifier.features(text[x[0]]))
    names = sorted(f for f, k in held.items() if k >= quality_classifier.MIN_HELD)
    for k, target in enumerate(quality_classifier.TARGETS):
        known = [x for x in used if x[1 + k] is not None]
        x = np.array([[f in quality_classifier.features(text[d[0]]) for f in names] for d in known], float)
        y = np.array([d[1 + k] for d in known], float)
        base = math.log(y.mean() / (1 - y.mean()))
        w, b, seen = np.zeros(len(names)), base, np.full(len(names), 1e-8)
        for _ in range(quality_classifier.STEPS):
            g = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
            seen += (x.T @ g) ** 2
            step = quality_classifier.RATE / np.sqrt(seen)
            w = w - step * (x.T @ g)
            w = np.sign(w) * np.maximum(abs(w) - step * quality_classifier.PENALTY, 0)
            b -= 2 * quality_classifier.RATE * g.sum()

        def rates(key):
            n, p = Counter(), Counter()
            for d in known:
                n[key(d[0])] += 1
                p[key(d[0])] += d[1 + k]
            return n, p

        def strength(n, p):
            r = [p[s] / n[s] for s in n]
            m, v = sum(p.values()) / sum(n.values()), np.var(r)
            return m, (min(max(m * (1 - m) / v - 1, quality_classifier.PRIOR_MIN), quality_classifier.PRIOR_MAX) if v > 0 else quality_classifier.PRIOR_MAX)

        hn, hp = rates(lambda d: site[d][0])
        pn, pp = rates(lambda d: site[d])
        (top, hk), (_, pk) = strength(hn, hp), strength(pn, pp)
        for d, t in text.items():
            evidence = b - base + sum(w[i] for i, f in enumerate(names) if f in quality_classifier.features(t))
            host = (hp[site[d][0]] + top * hk) / (hn[site[d][0]] + hk)
            prior = (pp[site[d]] + host * pk) / (pn[site[d]] + pk)
            want = 1 / (1 + math.exp(-(evidence + math.log(prior / (1 - prior)))))
            r = got[d]
            assert (r[f"evidence_{target}"], r[f"prior_{target}"], r[f"p_{target}"]) == pytest.approx((evidence, prior, want), abs=1e-6), (d, target)


def test_quality_classifier_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    every = quality_classifier._sampled(docs, labels)
    assert len(every) == 30  # labels of documents that are not there use up nothing
    monkeypatch.setattr(quality_classifier, "MAX_FIT", 10)
    assert quality_classifier._sampled(docs, labels) == every[:10]
    monkeypatch.setattr(quality_classifier, "MAX_FIT_BYTES", sum(len(t) for t, _ in every[:4]))
    assert quality_classifier._sampled(docs, labels) == every[:4]
    monkeypatch.setattr(quality_classifier, "MAX_FIT_BYTES", 1)
    assert quality_classifier._sampled(docs, labels) == []


def test_components_of_odd_edges(spark):
    from inkfold.llm.components import components

    edges = [(1, 2), (2, 1), (2, 2), (3, None), (None, 4), (5, 2), (9, 8), (9, 8), *[(k, k + 1) for k in range(100, 180)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 5: 1, 9: 8, **{k: 100 for k in range(101, 181)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_classifier_without_labels(docs, rows, spark):
    got = quality_classifier.quality_classifier(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)


# 6 decontamination


def distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_leaks_by_brute_force(spark):
    import random

    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.randint(3, 25), 400)) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(60):
        text = prose(rnd, rnd.randint(0, 60), 400).split()
        if i % 2:
            part = (items[i % 12][1]).split()
            for _ in range(rnd.randint(0, max(1, len(part) // 4))):
                k = rnd.randrange(len(part))
                part[k : k + 1] = rnd.choice([[], ["odd"], [part[k], "odd"]])
                part = part or ["odd"]
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() for w in part]
        docs.append((i, " ".join(text)))
    docs.append((100, None))
    want = set()
    for d, t in docs:
        w = decontaminate.split_words((t or "").encode())
        for i, x in items:
            m = decontaminate.split_words((x or "").encode())
            if len(m) >= decontaminate.MIN_ITEM_WORDS and (k := distance(m, w)) <= len(m) * decontaminate.EDIT_PERCENT // 100:
                want.add((d, i, k))
            elif m and len(m) < decontaminate.MIN_ITEM_WORDS and m == w:
                want.add((d, i, 0))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want
    for r in got:
        w = decontaminate.split_words(dict(docs)[r.doc_id].encode())[r.first_word : r.last_word + 1]
        m = decontaminate.split_words(dict(items)[r.item_id].encode())
        assert distance(m, w) <= r.distance and distance(w, m) <= r.distance + abs(len(w) - len(m))
    assert {r.doc_id for r in decontaminate.keep_clean(d, b).collect()} == {x for x, _ in docs} - {x for x, _, _ in want}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.keep_clean(d, b.limit(0)).count() == len(docs)


def test_leaks_of_short_items_and_unspaced_scripts(spark):
    zh = "机器学习模型在大规模语料上训练并评估"
    docs = [(1, "Paris!"), (2, "I went to Paris"), (3, f"前言{zh}后记"), (4, f"前言{zh[:8]}猫{zh[9:]}后记"), (5, "今天天气很好我们去公园散步吧朋友们"), (6, None)]
    items = spark.createDataFrame([(1, "paris"), (2, zh), (3, "")], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(1, 1, 0), (3, 2, 0), (4, 2, 1)}


def test_leaks_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item {i} has words of its own number{i}") for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so item {i} has words of its own number{i} here") for i in range(10)], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == want and decontaminate.keep_clean(docs, items).count() == 0


# 7 substrings


def repeats(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d, t] = (d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return [out[r[0], r[1]] for r in rows]


def test_substring_dedup(docs, rows):
    same(substring_dedup.substring_dedup(docs).collect(), repeats(rows))


def test_substring_counts_have_64_bits():
    """A k-mer found 2^30 times or more keeps its count; sums over blocks do too."""
    count = np.array([1, 2, 1 << 30, (1 << 30) + 1, 1 << 32, 1 << 40], np.uint64)
    told = substring_dedup.packed_edges(count, np.ones(6, bool), np.zeros(6, bool))
    assert (told >> np.uint64(2)).tolist() == count.tolist() and ((told & np.uint64(3)) == 2).all()
    e = np.array([5, 5, 9], np.uint64)
    big = np.full(3, 0xFFFFFFFF, np.uint32)
    assert substring_dedup._merged(e, big, big, big)[1].tolist() == [2 * 0xFFFFFFFF, 0xFFFFFFFF]


def test_substring_dedup_on_tangles(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.choices("abcdefgh", k=rnd.randint(5, 120)) for _ in range(25)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            a = rnd.randrange(len(b))
            w += b[a : a + rnd.randint(1, 80)]
            w += rnd.choice([[], ["x"] * rnd.randint(1, 60), ["x", "y", "z"] * rnd.randint(1, 30), rnd.choices("abcdefgh", k=3)])
        rows.append((i * 7 % 150, " ".join(w)))
    same(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), repeats(rows))


# 8, 9, 10: native, against their SQL


def test_mixing(docs):
    against_sql(mixing.mix(docs), docs, mixing.ORACLE)


def test_mixing_takes_near_target(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    for t in {r.target for r in got}:
        mine = [r for r in got if r.target == t]
        assert abs(sum(r.taken for r in mine) - t) <= max(r["size"] for r in mine)
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)


def test_mixing_ranks_few_rows_of_any_source(spark):
    """A source capped at three times its size, and one with most documents: the range that is ranked row by row stays small."""
    rows = [(i, "a b c d", "big") for i in range(20_000)] + [(100_000 + i, "x", "capped") for i in range(3_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d)
    capped = got.filter("doc_id >= 100000").collect()
    assert all(r.taken == 3 and r.target == 9000.0 for r in capped)
    sized = got.selectExpr("doc_id", "size", "source_size", "doc_id < 100000 as big").withColumn("n_docs", F.when(F.col("big"), 20_000).otherwise(3_000))
    u = (F.col("doc_id") % 3_000 + 0.5) / 3_000
    for part in (1e-9, 0.3, 1 - 1e-9):
        filed = mixing.filed(sized.withColumn("_u", u), F.lit(part))
        assert filed.groupBy("big", "_bucket").count().agg(F.max("count")).first()[0] <= 2 * mixing.TILT * mixing.BUCKET_ROWS


def test_mixing_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 1000, 5), ("b", 10, 5), ("c", 100, 5), (None, 7, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left, open_, target = 1117.0, {"a": 1, "b": 2, "c": 3, None: 1}, {}
    cap = {"a": 3000, "b": 30, "c": 300, None: 21}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(cap[s])
            left -= cap[s]
            del open_[s]
    assert got == pytest.approx(target)


def test_quality_rules(docs):
    against_sql(quality_rules.quality_rules(docs), docs, quality_rules.ORACLE)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.quality_rules(docs).filter("kept").count()


def test_line_dedup(docs):
    d = docs.dropDuplicates(["doc_id"])
    against_sql(line_dedup.line_dedup(d), d, line_dedup.ORACLE)


def test_line_dedup_shifts(spark):
    block = [f"line {i} of the passage" for i in range(40)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["something else", *block])), (3, "own\ntext\nhere"), (4, None)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0 and got[4].n_lines == 0 and got[4].kept_md5 is None
    assert got[2].n_removed >= 34


def test_line_dedup_leaves_no_single_lines(spark):
    """An exact copy of a text of several lines goes whole, and a shared passage but for the chunks that other text shares."""
    rnd = np.random.default_rng(12)
    text = lambda n: [f"line {rnd.integers(0, 10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        own = text(int(rnd.integers(2, 60)))
        rows += [(2 * i, "\n".join(own)), (2 * i + 1, "\n".join(own))]
        want[2 * i + 1] = len(own)
    passage = text(50)
    rows += [(1000 + i, "\n".join([*text(7), *passage, *text(7)])) for i in range(20)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want and all(got[2 * i] == 0 for i in range(60))
    assert all(38 <= got[1000 + i] <= 50 for i in range(1, 20)) and got[1000] == 0


def test_repeated_rows_are_one_document(docs, rows, spark):
    twice = docs.unionAll(docs)
    a, b = line_dedup.line_dedup(docs), line_dedup.line_dedup(twice)
    assert sorted(map(tuple, a.unionAll(a).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


# empty tables


def test_empty_tables(empty, spark):
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for got in (
        simhash.near_duplicates(empty), simhash.keep_one(empty), token_output.token_output(empty), license_scan.license_scan(empty), lm_score.lm_score(empty),
        quality_classifier.quality_classifier(empty, labels), decontaminate.leaks(empty, items), decontaminate.keep_clean(empty, items), substring_dedup.substring_dedup(empty),
        mixing.mix(empty), mixing.take_mix(empty), quality_rules.quality_rules(empty), quality_rules.keep_good(empty), line_dedup.line_dedup(empty),
    ):
        assert got.count() == 0


def test_salted_join_equals_broadcast(docs, monkeypatch):
    from inkfold.llm import common

    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    rules = sorted(map(tuple, quality_rules.quality_rules(docs).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want
    assert sorted(map(tuple, quality_rules.quality_rules(docs).collect()), key=str) == rules
    assert F is not None
