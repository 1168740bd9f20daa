import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import collocations, contamination, lexical
from pagewright.llm import words as words_of

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return re.findall(words_of.WORD, lower(text))


def sentences(rng, n, letters="abc", marks=" .,-"):
    return "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) + rng.choice(marks) for _ in range(n))


def test_words_in_blocks(monkeypatch):
    text = "Ab c'd é9 İx" + "\x00\x7f" + "日本 ﬁ_x" * 40 + "Z" * 50
    whole = terms(text)
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(words_of, "BLOCK", size)
        assert [w.decode() for part in words_of.word_blocks(text) for w in part] == whole
    assert list(words_of.word_blocks(None)) == [] == list(words_of.word_blocks(""))


# Decontamination


def hits(text, items, window):
    """By brute force: hit places, and the ids of the items whose windows occur."""
    doc, hit, names = terms(text), set(), set()
    for item, body in items:
        w = terms(body)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for i in range(len(doc) - k + 1):
                if doc[i : i + k] == w[s : s + k]:
                    hit |= set(range(i, i + k))
                    names |= {str(item)} if item is not None else set()
    return len(doc), hit, sorted(names)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_is_as_brute_force(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 4, 10])
    items = [(i, sentences(rng, rng.choice([0, 1, 2, 3, 6, 30]), "ab")) for i in range(rng.choice([1, 5, 20]))]
    sequences = {}
    for i, body in items:
        if terms(body):
            sequences.setdefault(tuple(terms(body)), []).append(str(i))
    if not sequences:
        return
    automaton = contamination.Automaton(sequences, window)
    assert len(automaton.step) <= 2 * sum(map(len, sequences)) + 1
    for _ in range(30):
        text = sentences(rng, rng.randint(0, 60), "abz")
        reader, doc = contamination.Reader(automaton), [w.encode() for w in terms(text)]
        at = 0
        while at < len(doc):
            step = rng.randint(1, 9)
            reader.read(doc[at : at + step])
            at += step
        spans, names = reader.found()
        n, hit, expected = hits(text, items, window)
        assert reader.n == n and sorted(names) == expected
        assert {p for s, e in spans for p in range(s, e)} == hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("most,piece", [(250_000, 4096), (40, 3)])
def test_scan_over_shards(spark, most, piece):
    rng = random.Random(4)
    items = [(1, "One two, three FOUR."), (1, "x y"), (2, "one TWO three four"), (None, "nobody knows"), (3, None), (4, "...")]
    items += [(10 + i, sentences(rng, 30, "ab")) for i in range(6)]
    docs = [(1, "zero one two three four five x z"), (2, None), (3, ""), (None, "well nobody knows x y"), (1, "zero one two three four five x z")]
    docs += [(20 + i, sentences(rng, 20) + items[6 + i % 6][1][3:50] + sentences(rng, 9)) for i in range(20)]
    frame = spark.createDataFrame(docs, DOC).withColumn("N_WORDS", F.lit("clash"))
    made = contamination.scan(frame, spark.createDataFrame(items, ITEM), 4, most=most, piece=piece)
    rows = [(r.doc_id, r.text, r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in made.collect()]
    expected = []
    for i, text in docs:
        n, hit, names = hits(text, items, 4)
        expected.append((i, text, n, contamination.joined([(p, p + 1) for p in hit]), names))
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_scan_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert contamination.scan(docs.limit(0), items).count() == 0
    assert contamination.scan(docs, items.limit(0)).select("n_words", F.size("spans")).collect() == [(2, 0)]


def test_decontaminated(spark):
    item = "the quick brown fox jumps over it"
    docs = [(1, "Well: 'The quick, brown fox' é " + "so it goes on and on " * 3), (2, "the quick brown fox jumps"), (3, None), (4, "clean — text"), (5, "")]
    made = contamination.decontaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item)], ITEM), 4, 4, 0.5)
    assert {r.doc_id: r.text for r in made.collect()} == {1: "Well: '' é " + "so it goes on and on " * 3, 3: None, 4: "clean — text", 5: ""}
    longer = contamination.decontaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item)], ITEM), 4, 5, 1.0)
    assert {r.doc_id: r.text for r in longer.collect()}[1] == docs[0][1] and {r.doc_id: r.text for r in longer.collect()}[2] == ""


# Ranked search


def ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, body in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            scores.append((-sum(weight(t) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(body)) if c[t]), i is None, i))
        best = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_docs,most,sample", [(4096, 200_000, 16), (3, 200_000, 2), (7, 4, 1)])
def test_search_is_as_brute_force(spark, block_docs, most, sample):
    rng = random.Random(block_docs)
    docs = [(i, sentences(rng, rng.choice([0, 1, 5, 40]), "abcd")) for i in range(90)]
    docs += [(200 + i, "aa bb aa cc") for i in range(30)] + [(7, "aa bb"), (7, "aa bb"), (None, "aa bb"), (300, None), (301, "É é")]
    items = [(1, "aa BB"), (2, None), (3, ""), (1, "cc dd é"), (4, "unheard"), (5, "aa"), (5, "aa"), (None, "bb cc")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, DOC).withColumn("score", F.lit("clash")).repartition(3)
    index = lexical.build(frame, block_docs=block_docs, sample=sample)
    made = lexical.search(index, spark.createDataFrame(items, ITEM), 5, most=most)
    assert sorted(map(tuple, made.collect()), key=repr) == ranking(docs, items, 5)


def test_search_bounds_hold():
    """Byte levels bound the part of a score that they stand for, and fit a byte."""
    for tf in (1, 2, 17, 10**6):
        for m in (50, 51, 100, 5000, 10**9):
            part = lexical.factor(tf, m)
            level = -(-part // lexical.STEP)
            assert 0 <= level <= 255 and (level - 1) * lexical.STEP < part <= level * lexical.STEP


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert lexical.search(lexical.build(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0


# Collocations


def brute_counts(docs):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            total[lang or "und"] += len(w)
            for n in range(1, 6):
                counts.update((lang or "und", " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    return counts, total


def brute_collocations(docs, least, most):
    counts, total = brute_counts(docs)
    rows = {}
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if a < least or len(w) < 2:
            continue
        cuts = [(counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((1000 * a * total[lang] // (l * r), k) for k, (l, r) in enumerate(cuts))
        rows[lang, phrase] = (a, *cuts[k], total[lang], score)
    inside = lambda p, q: f" {p} " in f" {q} " and p != q
    kept = {(g, p): v for (g, p), v in rows.items() if not any(g == h and inside(p, q) and u[0] >= v[0] for (h, q), u in rows.items())}
    out = []
    for lang in {g for g, _ in kept}:
        mine = sorted(((p, v) for (g, p), v in kept.items() if g == lang), key=lambda x: (-x[1][4], -x[1][0], x[0].encode()))
        out += [(lang, i, p, *v) for i, (p, v) in enumerate(mine[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("step,cells", [(1 << 20, 16), (40, 16), (200, 12)])
def test_collocations_are_as_brute_force(spark, step, cells):
    rng = random.Random(step)
    docs = [(rng.choice(["en", "de", None, "und"]), sentences(rng, rng.choice([0, 3, 200]), "ab", " \t.,\x0b-é")) for _ in range(40)]
    docs += [("en", None), ("fr", ""), (None, "x" * 99), ("en", "New York City. " * 12), ("en", "new york city"), ("de", "a.b.c.d" * 30)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(3)
    made = collocations.collocations(frame, least=5, most=30, shape=collocations.Shape(1 << cells, 1 << 12), step=step)
    assert sorted(map(tuple, made.collect())) == brute_collocations(docs, 5, 30)


def test_phrase_counts_lose_nothing_when_the_sketch_is_full(spark):
    rng = random.Random(8)
    docs = [("en", sentences(rng, 300, "abc")) for _ in range(6)]
    made = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(spark.createDataFrame(docs, "lang string, text string"), 3, shape=collocations.Shape(16, 16)).where("phrase is not null").collect()}
    assert made == {k: v for k, v in brute_counts(docs)[0].items() if v >= 3}


def test_scores_beyond_64_bits(spark):
    rows = [("en", None, 0, 10**13), ("en", "a", 1, 10**12), ("en", "b", 1, 3 * 10**12), ("en", "a b", 2, 9 * 10**11)]
    made = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).first()
    assert (made.l, made.r, made.score) == (10**12, 3 * 10**12, 1000 * 9 * 10**11 * 10**13 // (3 * 10**24))


def test_slices_of_sketches():
    import numpy as np

    for cell, count in (([0], [1]), ([5, 6, 300, 1000, 4095], [1, 255, 3, 9, 700]), ([4094], [2])):
        at, n = collocations.unpacked(*collocations.packed(np.array(cell), np.array(count)))
        assert at.tolist() == cell and n.tolist() == [min(c, 255) for c in count]


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_blocks_overlap():
    text = "a b c. d e\tf,g h i j k l m" * 5
    whole = next(collocations.blocks(text, 1 << 20))[0]
    for size in (1, 3, 10, 50):
        parts = list(collocations.blocks(text, size))
        assert [t for tokens, n in parts for t in tokens[:n]] == whole
        at = 0
        for tokens, n in parts:
            assert tokens == whole[at : at + len(tokens)] and (len(tokens) - n == 4 or at + len(tokens) == len(whole))
            at += n


def test_steps_of_null_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([None, "a b"])], names=["lang", "text"])
    made = list(collocations.steps(iter([batch]), 100))
    assert [(lang, room.tolist()) for lang, _, room, _, _ in made] == [("de", [2, 1, 0])]


def test_sketches_grow_with_the_corpus():
    sizes = [collocations.shape_for(b).cells for b in (0, 10**6, 10**8, 10**9, 10**14)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 26 and sizes[-1] == 1 << 29
    assert all(8 <= b / collocations.shape_for(b).cells <= 16 for b in (2 * 10**9, 5 * 10**9))
