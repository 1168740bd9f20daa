import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import bpe, mixing, neardup, quality, repeats, secrets, tokencount, toxicity
from pagewright.llm.components import components
from pagewright.llm.shared import fresh_path, held_out

VOCABULARY = pytest.importorskip("public_tokenizers")
RANKS = VOCABULARY.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=VOCABULARY.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_is_as_tiktoken(tiktoken_encoding):
    codec = bpe.Codec(bpe.read_ranks(RANKS), VOCABULARY.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab the éñ  \n你12!\x1c\x85\xa0²ª×'sre<|endoftext|>ɐ") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["ab" * 5000, "", "<|endoftext|>", "don't", "x" * 63, "\n" * 100]
    assert codec.encode_all(texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert all(codec.decode(codec.encode(t)) == t.encode() for t in texts)


def test_bpe_scalar_and_arrays_agree():
    ranks = bpe.read_ranks(RANKS)
    pairs, longest, rng = bpe.pair_table(ranks), max(map(len, ranks)), random.Random(2)
    pieces = [bytes(rng.choice(b"thent ing") for _ in range(rng.randint(2, 60))) for _ in range(500)]
    pieces = [p for p in pieces if p not in ranks]
    assert bpe.encode_pieces(pieces, ranks, pairs) == [bpe.encode_piece(p, ranks, longest) for p in pieces]


def test_bpe_on_frames(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, None), (3, ""), (1, "hello there")], DOC).withColumn("IDS", F.lit("clash"))
    made = bpe.decode(bpe.encode(docs, RANKS, VOCABULARY.PATTERN), RANKS).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.ids), bytes(r.decoded)) for r in made] == [(1, 2, b"hello there"), (1, 2, b"hello there"), (2, 0, b""), (3, 0, b"")]
    assert bpe.encode(docs.limit(0), RANKS, VOCABULARY.PATTERN).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_token_counts(spark, block):
    given = [(1, "a b c"), (2, None), (3, ""), (4, "d " * 50), (5, "e")]
    docs = spark.createDataFrame(given, DOC).coalesce(2)
    manifest = tokencount.write_flat(docs, bpe.encoder(spark, RANKS, VOCABULARY.PATTERN), 50256, fresh_path(spark, "flat"))
    counted = tokencount.token_counts(manifest.select("file", "bytes").distinct(), 50256, block=block)
    codec = bpe.Codec(bpe.read_ranks(RANKS), VOCABULARY.PATTERN)
    made = {r.doc_id: r.n_tokens for r in manifest.join(counted, ["file", "ordinal"]).collect()}
    assert made == {i: len(codec.encode(t)) for i, t in given}
    assert counted.where("not closed").count() == 0


def test_token_counts_of_odd_rows(spark):
    encode, flat = bpe.encoder(spark, RANKS, VOCABULARY.PATTERN), lambda: fresh_path(spark, "flat")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "w " * 30000)], DOC).withColumn("FILE", F.lit("clash"))
    manifest = tokencount.write_flat(docs, encode, 50256, flat())
    made = manifest.join(tokencount.token_counts(manifest.select("file", "bytes").distinct(), 50256), ["file", "ordinal"]).collect()
    codec = bpe.Codec(bpe.read_ranks(RANKS), VOCABULARY.PATTERN)
    long = len(codec.encode("w " * 30000))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in made) == [(0, 0), (0, 1), (1, 2), (1, 2), (2, long)]
    none = tokencount.write_flat(docs.limit(0), encode, 50256, flat())
    assert none.count() == 0 and tokencount.token_counts(none.select("file", "bytes").distinct(), 50256).count() == 0
    with pytest.raises(ValueError, match="does not fit in 2 bytes"):
        tokencount.flat_ids([[1, 65536]], 9, 2)
    with pytest.raises(ValueError, match="the separator 9 is a token"):
        tokencount.flat_ids([[], [1, 9]], 9, 2)
    assert tokencount.flat_ids([[5], [], [6, 7]], 9, 2).tolist() == [5, 9, 9, 6, 7, 9]


def test_token_counts_of_an_open_file(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(np.array([5, 9, 9, 7, 8], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    files = tokencount.flat_files(spark, f"{tmp_path}/*.bin")
    made = tokencount.token_counts(files, 9, block=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens, r.closed) for r in made] == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


def removed(docs):
    """By brute force: the bytes that each document keeps."""
    seen, kept = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        cover = [False] * len(raw)
        for p in range(len(raw) - repeats.WIDTH + 1):
            if (w := raw[p : p + repeats.WIDTH]) in seen:
                cover[p : p + repeats.WIDTH] = [True] * repeats.WIDTH
            seen.add(w)
        kept[i] = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
    return kept


@pytest.mark.parametrize(("crowd", "shown"), [(500, 8), (1, 8), (500, 2)])
def test_repeats(spark, monkeypatch, crowd, shown):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SHOWN", shown)
    rng = random.Random(3)
    passage, text = words(rng, 40), words(rng, 300)
    docs = [(i, words(rng, 30) + passage[rng.randint(0, 30) :] + words(rng, 20)) for i in range(12)]
    docs += [(20 + i, text) for i in range(5)] + [(30, text[50:400] + "é" + text[300:]), (31, "ab" * 300), (32, None), (33, ""), (34, "x" * 100), (35, "y" * 99), (36, "For " * 200)]
    made = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(docs, DOC).repartition(3)).collect()}
    assert {i: bytes(r.kept) for i, r in made.items()} == removed(docs)
    assert all(sum(s.end - s.start for s in r.spans) + len(r.kept) == len((dict(docs)[i] or "").encode()) for i, r in made.items())


def test_a_line_that_all_documents_share(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 5)
    rng = random.Random(21)
    line = words(rng, 45)
    docs = [(i, f"{words(rng, rng.randint(0, 40))} {line} {words(rng, rng.randint(0, 40))}") for i in range(60)]
    made = repeats.without_repeats(spark.createDataFrame(docs, DOC).repartition(4).withColumn("RAW", F.lit("clash"))).collect()
    assert {r.doc_id: bytes(r.kept) for r in made} == removed(docs)


def test_crowds_without_an_equal_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 1)
    rng = random.Random(23)
    lines = [words(rng, 40)[:70] for _ in range(20)]  # each shorter than a window
    docs = [(i, f"{words(rng, 40)} {lines[i % 20]} {words(rng, 40)}") for i in range(60)]
    made = repeats.without_repeats(spark.createDataFrame(docs, DOC).repartition(4)).collect()
    assert {r.doc_id: bytes(r.kept) for r in made} == removed(docs) == {i: x.encode() for i, x in docs}


def test_windows_by_both_suffix_arrays():
    rng = random.Random(22)
    data = np.frombuffer(b"".join(words(rng, 40).encode()[:200] * 3 for _ in range(6)), np.uint8)
    at, n, cut, gram = repeats.phrases(data, np.array([len(data)]), repeats._letters())
    _, group = np.unique(gram, return_inverse=True)
    order = np.argsort(group, kind="stable")
    entries = [data[at[i] : at[i] + n[i] + repeats.WIDTH - 1].tobytes() for i in order]
    entry, place = repeats.later_windows(entries, cut[order], group[order])
    seen, expected = set(), set()
    for i, x in enumerate(entries):
        for p in range(len(x) - repeats.WIDTH + 1):
            w = x[p : p + repeats.WIDTH]
            expected |= {(i, p)} if w in seen else set()
            seen.add(w)
    assert set(zip(entry.tolist(), place.tolist(), strict=True)) == expected and expected


def test_repeats_in_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 1500)
    rng = random.Random(4)
    long = words(rng, 900)
    docs = [(1, long), (2, long[700:2600]), (3, long[1400:1650])]
    assert {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(spark.createDataFrame(docs, DOC)).collect()} == removed(docs)


def test_repeated_rows_are_one_place(spark):
    rng = random.Random(5)
    text = words(rng, 60)
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2**63 - 1, words(rng, 40))], DOC).withColumn("Z", F.lit(1))
    made = repeats.without_repeats(rows).collect()
    assert sorted((r.doc_id is None, bytes(r.kept) == text.encode()) for r in made if r.doc_id != 2**63 - 1) == [(False, True), (False, True), (True, False)]
    assert [len(r.spans) for r in made if r.doc_id == 2**63 - 1] == [0]
    assert repeats.without_repeats(rows.limit(0)).count() == 0


def linked(docs, k, per):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= per * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("leaf", "group"), [(256, 1024), (4, 1024), (4, 8)])
def test_near_duplicates(spark, monkeypatch, leaf, group):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    rng = random.Random(6)
    docs, base = [], [words(rng, rng.randint(30, 80)).split() for _ in range(4)]
    for i in range(90):
        w = list(rng.choice(base)) if i % 3 else words(rng, 40).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(100))
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, " \t"), (102, "one two"), (103, "One TWO"), (104, "é É"), (105, "é é")]
    made = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, DOC).repartition(3), words=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in made.items()} == linked(docs, 4, 80)
    assert all(r.kept == (r.component_id == i) for i, r in made.items())


def test_near_duplicates_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (None, "x")], DOC).withColumn("SET_HASH", F.lit(b"clash"))
    made = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(rows).collect()))
    assert made == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert neardup.near_duplicates(rows.limit(0)).count() == 0


def test_near_duplicates_without_ids_and_very_long(spark):
    rng = random.Random(23)
    long = words(rng, 60_000)
    texts = [long, long + " end", words(rng, 30), "other " + long[: len(long) // 2]]
    rows = spark.createDataFrame([(None, t) for t in texts] + [(3, texts[2]), (3, long + " more")], DOC)
    made = neardup.near_duplicates(rows.withColumn("at", F.monotonically_increasing_id()), also=("at",)).orderBy("at").collect()
    keys = [r.group_key for r in made]
    assert keys[0] == keys[1] == keys[5] and keys[2] == keys[4] and len(set(keys)) == 3
    assert [r.component_id for r in made] == [3, 3, 3, None, 3, 3]


def test_near_duplicates_with_unlucky_sketches(spark):
    base = " ".join(f"w3731x{i}" for i in range(8))  # 8 of 10 words shared; sketches agree in 82 of 128 places
    rows = spark.createDataFrame([(1, f"{base} p3731"), (2, f"{base} q3731")], DOC)
    assert [r.component_id for r in neardup.near_duplicates(rows, words=1).collect()] == [1, 1]


def test_hubs_lose_no_pair_that_leaves_pass():
    n, share = neardup.COORDINATES, 0.8
    least = int(n * share - neardup.SLACK * (n * share * (1 - share)) ** 0.5)
    leaves, outside = -int(-n * neardup.NEAR // 1), -int(-n * neardup.AROUND // 1) - 1
    assert n - (leaves - outside) < least


@pytest.mark.parametrize("held", [1_000_000, 1])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr("pagewright.llm.components.HELD", held)
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (101, 100), (50, 50)]
    random.Random(1).shuffle(links)
    made = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert made == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}




def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), words(rng, rng.randint(1, 60))) for i in range(600)]
    rows += [(1000, "empty", None), (1001, "empty", ""), (1002, "b", "w " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made = mixing.mix(docs).collect()
    assert len(made) == len(rows)
    by = {}
    for r in made:
        assert r.size == len((dict((i, t) for i, _, t in rows)[r.doc_id] or "").split()) and 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(sum(r.size for r in made))
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(60, 0.01 * x[0].target) or x[0].source == "b"
        assert x[0].target <= 3 * x[0].source_size + 1e-9
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))
    copies = mixing.repeated(docs, mixing.allot(docs))
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in made)
    assert mixing.mix(docs.limit(0)).count() == 0


def naive_mix(rows, most=3.0):
    """(size, taken) of rows (doc_id, source, text) of one source that is its own target."""
    total = sum(size for size, _ in rows)
    classes = sorted({size.bit_length() - 1 for size, _ in rows})
    words_of = {k: sum(size for size, _ in rows if size.bit_length() - 1 == k) for k in classes}
    for i, first in enumerate(classes):
        level = (total - most * sum(words_of[k] for k in classes[:i])) / sum(words_of[k] / (4 + k) for k in classes[i:])
        if level / (4 + first) < most:
            break
    expected = [min(most, level / (4 + size.bit_length() - 1)) for size, _ in rows]
    wanted = total - sum(int(e) * size for e, (size, _) in zip(expected, rows, strict=True))
    p = [e - int(e) for e in expected]
    order = sorted((i for i in range(len(rows)) if p[i] > 0), key=lambda i: (rows[i][1] / (1 - rows[i][1]) / (p[i] / (1 - p[i])), rows[i][1], i))
    before, drawn = 0, set()
    for i in order:
        if before + rows[i][0] / 2 < wanted:
            drawn.add(i)
        before += rows[i][0]
    gap = wanted - sum(rows[i][0] for i in drawn)
    rest = [(abs(gap + rows[i][0] if i in drawn else gap - rows[i][0]), rows[i][1], i) for i in order]
    if rest and min(rest)[0] < abs(gap):
        drawn ^= {min(rest)[2]}
    return sorted((size, (int(e) + (i in drawn)) * size) for i, (e, (size, _)) in enumerate(zip(expected, rows, strict=True)))


def test_mixing_by_brute_force_with_unequal_odds(spark):
    rng = random.Random(17)
    rows = [(i, "a", words(rng, rng.choice([3, 10, 40, 160, 600]))) for i in range(200)] + [(7, "a", words(rng, 50))] * 30 + [(None, "a", words(rng, 25)) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    drawn = lambda i, t: (int(hashlib.md5(f"{'' if i is None else i}:mix:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    made = sorted((r.size, r.taken) for r in mixing.mix(docs).collect())
    assert made == naive_mix([(len(t.split()), drawn(i, t)) for i, _, t in rows])
    odds = mixing.allot(docs).select("size", "certain").distinct().collect()
    assert len({r.certain for r in odds}) > 1  # small documents are taken more often


@pytest.mark.parametrize("piece", [4096, 7])
def test_mixing_of_repeated_rows_and_null_ids(spark, monkeypatch, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)
    rng = random.Random(18)
    rows = [(None, s, words(rng, 50)) for s in "abc" for _ in range(200)]  # ids are all null
    rows += [(5, s, words(random.Random(s), 50)) for s in "abc" for _ in range(100)]  # a third of rows alike
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("SIZE", F.lit("clash"))
    made = mixing.mix(docs).collect()
    assert len(made) == len(rows)
    for s in "abc":
        mine = [r for r in made if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25 and all(r.taken <= 3 * r.size for r in mine)
    copies = mixing.repeated(docs, mixing.allot(docs))
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in made)


def test_targets_of_many_sources(spark):
    rng = random.Random(19)
    sizes = [(f"s{i:03}", rng.choice([1, 5, 50, 1000])) for i in range(150)] + [(None, 70)]
    made = {r.source: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, words long").repartition(7), (5.0, 2.0, 1.0), 1.0, 3.0).collect()}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate([*sorted(s for s, _ in sizes if s), None])}
    target, free = {}, dict(sizes)
    while True:  # pour by weight into what has room
        level = (sum(n for _, n in sizes) - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s, n in free.items() if 3 * n <= weight[s] * level]
        target |= {s: 3.0 * free.pop(s) for s in full}
        if not full:
            break
    target |= {s: weight[s] * level for s in free}
    assert {s: r.target for s, r in made.items()} == pytest.approx(target)


def spans(spark, *texts):
    """Of each text, the places of its spans by kind."""
    rows = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("hex", F.lit("clash"))
    found = secrets.scan(rows).orderBy("doc_id").collect()
    return [{k: [(x.start, x.end) for x in row[k]] for k in ("assign", "access", "hex", "linked")} for row in found]


def test_base_secrets(spark):
    key, digest = "AKIA" + "A1" * 8, "0f" * 16
    text = f'é PassWord = "hunter22!" token:short api_key: x={digest} {key}z AKIASHORT'
    made, none, empty, short = spans(spark, text, None, "", 'token=secret = "abcdefgh12"')
    assert [text[a:b] for a, b in made["assign"]] == ['PassWord = "hunter22', f"api_key: x={digest}"]
    assert [text[a:b] for a, b in made["access"]] == [key]
    assert [text[a:b] for a, b in made["hex"]] == [digest]
    assert none == {"assign": [], "access": [], "hex": [], "linked": []} == empty
    assert short["assign"] == []  # a value that is too short still uses its text


def test_weak_parts_need_each_other(spark):
    weak, host = "aB3" * 9, "https://vault.example.com:8200"
    texts = [
        f"value {weak} and nothing else", f"see {host} only", f"at {host} use {weak} now", f"at {host} " + "x " * 300 + weak,
        f"user = bob password = hunter2222 {host}", "account=https://vault.example.com password = hunter2222",
    ]
    made = [[text[a:b] for a, b in found["linked"]] for text, found in zip(texts, spans(spark, *texts), strict=True)]
    assert made == [[], [], [host, weak], [], ["user = bob", host], ["https://vault.example.com"]]


@pytest.mark.parametrize("width", [64, 2])
def test_passes_over_arrays_by_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(secrets, "WIDTH", width)
    rng = random.Random(20)
    values = [[rng.randrange(1000) for _ in range(n)] for n in (0, 1, 2, 5, 63, 64, 65, 200)]
    rows = spark.createDataFrame([(v,) for v in values], "v array<int>")
    made = rows.select(secrets.running(F.col("v"), lambda a, b: a + b).alias("s"), secrets.running(F.col("v"), F.greatest).alias("m"), "v").collect()
    for r in made:
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.m == [max(r.v[: i + 1]) for i in range(len(r.v))]
    parts = "array<struct<start:int,kind:int,end:int,whole:string>>"
    spans = lambda k: [(a, k, a + rng.randint(1, 40), "w") for a in sorted(rng.randrange(9000) for _ in range(rng.choice([0, 1, 30, 90])))]
    cases = [(spans(5), spans(6)) for _ in range(12)]
    made = spark.createDataFrame(cases, f"x {parts}, y {parts}").select("x", "y", secrets.near(F.col("x"), F.col("y")).alias("near"), secrets.apart(F.col("x"), F.col("y")).alias("apart")).collect()
    for r in made:
        assert sorted(r.near) == sorted(x for x in r.x if any(y.start <= x.end + secrets.SCOPE and y.end >= x.start - secrets.SCOPE for y in r.y))
        assert sorted(r.apart) == sorted(x for x in r.x if not any(y.start < x.end and y.end > x.start for y in r.y))


def test_very_long_texts_take_linear_time(spark):
    import time

    line = "see https://host-{}.example.com/a and user = name{} or aB3" + "xY9" * 8 + "\n"
    text = "".join(line.format(i, i) for i in range(200_000))  # 20 MB and 600,000 parts
    rows = spark.createDataFrame([(1, text), (2, text[:2_000_000])], DOC)
    rows.write.parquet(path := fresh_path(spark, "long"))
    rows, took = spark.read.parquet(path), {}
    for i, parts in ((2, 60_000), (1, 600_000)):
        at = time.time()
        assert secrets.scan(rows.where(F.col("doc_id") == i)).select(F.size("linked")).first()[0] >= parts
        took[i] = time.time() - at
    assert took[1] < 20 * max(took[2], 1)
    assert "aB3xY9" not in secrets.redact(rows.where("doc_id = 2")).select("text").first()[0]


def test_redact(spark):
    text = 'x token = "' + "0f" * 20 + '" y'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "clean")], DOC)
    assert [r.text for r in secrets.redact(rows).orderBy("doc_id").collect()] == ['x [REDACTED]" y', None, "clean"]
    assert secrets.redact(rows.limit(0)).columns == rows.columns
    clash = rows.withColumns({"hex": F.lit(5), "spans": F.lit("s"), "row": F.lit("r")})
    assert [tuple(r)[2:] for r in secrets.redact(clash).collect()] == [(5, "s", "r")] * 3
    two = spark.createDataFrame([(1, "a AKIA" + "B" * 12 + ' é token: "AKIA' + "C" * 16 + '" z')], DOC)
    assert secrets.redact(two).first().text == 'a [REDACTED] é [REDACTED]" z'


def test_toxicity_finds_the_sentence():
    rng = random.Random(8)
    bags, labels, texts = [], [], []
    for i in range(400):
        sentences = [words(rng, 8) for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["grobian", "schurke"])
        texts.append(". ".join(sentences))
        labels.append(int(i % 4 == 0))
        bags.append(toxicity.sentence_words(texts[-1]))
    model = toxicity.fit_bags(bags, labels)
    assert {"grobian", "schurke"} <= set(model.weights)
    hits = [toxicity.score_text(t, model) for t in texts]
    assert sum((p >= 0.7) == bool(y) for (p, _), y in zip(hits, labels, strict=True)) >= 396
    toxic = next(i for i, y in enumerate(labels) if y)
    (start, end, _), *_ = hits[toxic][1]
    assert "grobian" in texts[toxic][start:end] or "schurke" in texts[toxic][start:end]
    for odd in (None, "", "...", "\n"):
        assert toxicity.score_text(odd, model)[0] == pytest.approx(model.leak)


def test_toxicity_scores_by_brute_force(spark):
    rng = random.Random(24)
    model = toxicity.ToxicModel({"grobian": 5.0, "^grob": 2.5, "^schu": 4.0, "bad": 3.0}, -6.0, 0.02)

    def naive(text):
        clean = 1 - model.leak
        for sentence in "".join("\n" if c in ".!?" else c for c in text or "").split("\n"):
            seen = {"".join(c for c in w if c.isalnum()) for w in sentence.lower().split()} - {""}
            z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(f"^{w[:n]}", 0) for n in (4, 5, 6) if len(w) >= n) for w in seen)
            if seen:
                clean *= 1 - 1 / (1 + np.exp(-z))
        return 1 - clean

    texts = [". ".join(" ".join(rng.choice(["grobian", "Schurke", "bad", "Bad", "fine", "grob", "day"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None, "", "?!", "bad " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], DOC).withColumn("SCORE", F.lit("clash"))
    made = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert [made[i].score for i in range(len(texts))] == pytest.approx([naive(t) for t in texts])
    assert made[0].score == made[len(texts)].score and "SCORE" not in rows.columns[:2]


def test_quality_scores_by_brute_force(spark):
    rng = random.Random(25)
    sample = [words(rng, 30) + rng.choice([".", " | x", "!!"]) for _ in range(40)]
    model = quality.fit_texts(sample, [rng.randint(0, 1) for _ in sample], 8)

    def naive(text):
        counts = [0.0] * quality.BUCKETS
        import re

        for term in re.findall(r"\w+|[^\w\s]+", text or ""):
            counts[zlib.crc32(term.encode()) % quality.BUCKETS] += 1
        if not any(counts):
            return model.prior
        w = text.split()
        counts[zlib.crc32(b"<again>") % quality.BUCKETS] += sum(w[i] == w[i - 1] for i in range(1, len(w)))
        x = np.array(counts) ** 0.5 * model.weight
        x = x @ model.axes
        cosine = [float(x @ v / np.sqrt(x @ x) / np.sqrt(v @ v)) for v in model.vectors.astype(float)]
        near = sorted(zip(cosine, model.labels.tolist(), strict=True), reverse=True)[:7]
        return sum(max(c, 0) * y for c, y in near) / sum(max(c, 0) for c, _ in near)

    texts = [words(rng, rng.randint(1, 60)) + rng.choice(["", " | x", " a a a a"]) for _ in range(30)] + [None, "", " \n", "w " * 20000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], DOC).withColumn("Score", F.lit("clash"))
    made = {r.doc_id: r.score for r in quality.score(rows, model).select("doc_id", "score").collect()}
    assert [made[i] for i in range(len(texts))] == pytest.approx([naive(t) for t in texts], abs=1e-4)
    assert made[0] == made[len(texts)]


def test_samples_are_bounded_by_document(spark):
    from pagewright.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(2, "text 2")] * 50, DOC)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows, sizes = labelled_sample(docs, labels, "quality", 100, 1000)
    kept = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(rows) == sorted((f"text {i}", i % 2) for i in kept) and sum(sizes.values()) == len(kept)


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where("score between 0 and 1").count() == 3
    assert quality.score(docs, quality.fit(docs, labels)).where("score between 0 and 1").count() == 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_quality_votes_by_likeness():
    rng = random.Random(9)
    good = [words(rng, 50) + "." for _ in range(150)]
    bad = [words(rng, 30).upper().replace(" ", "!! ") for _ in range(80)] + [" ".join([words(rng, 1)] * 40) for _ in range(70)]
    model = quality.fit_texts(good[:100] + bad[:50] + bad[80:130], [1] * 100 + [0] * 100)
    buckets = quality._Buckets()
    score = lambda texts: quality.vote(model.project(np.array([quality.profile(t, buckets) for t in texts])), model)
    assert (score(good[100:]) >= 0.5).mean() > 0.95 and (score(bad[50:80] + bad[130:]) < 0.5).mean() > 0.95
    assert quality.profile("", buckets) is None and quality.profile(None, buckets) is None


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_digests(spark):
    rows = spark.createDataFrame([([5, 17],), ([],)], "ids array<int>")
    assert [r[0] for r in rows.select(bpe.ids_digest(F.col("ids"))).collect()] == [hashlib.sha256(x).hexdigest() for x in (b"5 17", b"")]


def test_runs_keep_every_chunk():
    """A run that spans several batches, of several chunks, comes whole."""
    import pyarrow as pa

    from pagewright.llm.shared import runs

    keys = [1, 1, 2, 2, 2, 2, 2, 3, 5, 5]
    for cuts in ([10], [1, 9], [3, 2, 1, 1, 3], [1] * 10):
        at, batches = 0, []
        for n in cuts:
            batches += [pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array([bytes([i]) for i in range(at, at + n)], pa.binary())], names=["k", "v"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["k", "v"])]
            at += n
        made = [(t.column(0).to_pylist(), t.column(1).to_pylist()) for t in runs(iter(batches), "k")]
        assert [k for ks, _ in made for k in ks] == keys and [v for _, vs in made for v in vs] == [bytes([i]) for i in range(10)]
        assert all(a[0][-1] != b[0][0] for a, b in zip(made, made[1:], strict=False))  # no key is in two
        if len(cuts) > 3:
            assert [ks for ks, _ in made if 2 in ks] == [[2] * 5] or cuts[0] == 3


@pytest.mark.parametrize("most", [60, 400])
def test_neardup_in_parts_by_shingles(spark, monkeypatch, most):
    """Groups with more shingles than a part holds are cut and lose no link."""
    from functools import partial

    rng = random.Random(most)
    bases = [words(rng, 40).split() for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, DOC)
    whole = sorted(map(tuple, neardup.near_duplicates(docs, 2, 80).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(neardup, "_confirmed", partial(neardup._confirmed, most=most))
    assert sorted(map(tuple, neardup.near_duplicates(docs, 2, 80).select("doc_id", "component_id").collect())) == whole
    assert 4 <= len({c for _, c in whole}) < 60


def test_marks_let_few_others_through(spark):
    from pagewright.llm.shared import marked

    ids = spark.range(0, 40_000, 8)
    rows = spark.range(40_000)
    made = marked(rows, "id", ids).where("may")
    assert made.join(ids, "id").count() == ids.count() and made.count() < ids.count() + 40_000 // 12
    assert marked(rows, "id", ids, most=1).where("may").join(ids, "id").count() == ids.count()
    assert marked(rows, "id", ids.limit(0)).where("may").count() == 0


def test_quality_ties_are_shared():
    """Sample texts that are equal share the last places' votes, in whatever order they come."""
    rng = random.Random(3)
    sample = [words(rng, 12)] * 10 + [words(rng, 12) for _ in range(20)]
    labels = [i % 2 for i in range(30)]
    seen = set()
    for _ in range(5):
        pairs = list(zip(sample, labels, strict=True))
        rng.shuffle(pairs)
        model = quality.fit_texts([t for t, _ in pairs], [y for _, y in pairs], 8)
        profiles = np.array([quality.profile(sample[0], quality._Buckets())])
        seen.add(round(float(quality.vote(model.project(profiles), model)[0]), 6))
    assert seen == {0.5}


def test_quality_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b c")], DOC), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert [r.score for r in quality.score(docs, quality.fit(docs.limit(0), labels)).collect()] == [0.5]


def test_neardup_recall_over_several_levels(spark, monkeypatch):
    """Pairs at and around the threshold, with leaves so small that four levels and their hubs are crossed: found over true."""
    monkeypatch.setattr(neardup, "LEAF", 6)
    rng = random.Random(17)
    common = [words(rng, 1) for _ in range(400)]
    rows = []
    for i in range(250):
        base = [rng.choice(common) for _ in range(60)]
        other = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 3, 4, 4])):
            other[at] = words(rng, 1)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, t in rows for w in [t.split()]}
    true = {(2 * i, 2 * i + 1) for i in range(250) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    made = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC), 2, 80).collect()}
    found = {(a, b) for a, b in true if made[a] == made[b]}
    print(f"recall: {len(found)} of {len(true)} pairs")
    assert len(true) > 100 and len(found) == len(true)
    assert all(made[2 * i + 1] == 2 * i + 1 for i in range(250) if (2 * i, 2 * i + 1) not in true)
