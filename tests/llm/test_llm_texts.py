import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import abuse, leaks, near_duplicates, pieces, tokens
from vecloom.llm.shingles import shingle_sets, word_hashes

WORDS = re.compile("[a-z0-9]+")


def texts(spark, rows):
    return spark.createDataFrame(rows, "kind string, key bigint, text string").withColumns({"class": F.lit(1), "rep": F.lit("x"), "size": F.lit(0), "a": F.lit(0), "bucket": F.lit(1)})


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def variants(rnd, base, count):
    out = []
    for _ in range(count):
        words = base.split()
        for _ in range(rnd.randrange(0, 14)):
            i = rnd.randrange(len(words))
            words[i : i + rnd.randrange(2)] = [f"e{rnd.randrange(999)}"] * rnd.randrange(2)
        out.append(" ".join(words))
    return out


def triples(text):
    w = WORDS.findall((text or "").lower())
    return set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 30 else set()


def brute_pairs(rows, least=0.7):
    sets = [(k, i, triples(t)) for k, i, t in rows if k is not None and i is not None]
    out = set()
    for n, (k, i, s) in enumerate(sets):
        for k2, j, u in sets[:n]:
            if k == k2 and i != j and s and u and len(s & u) >= least * len(s | u):
                out.add((k, min(i, j), max(i, j)))
    return out


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    rows, key = [], 0
    for _ in range(groups):
        base = sentence(rnd, rnd.randrange(35, 160))
        for t in [base, *variants(rnd, base, 4)]:
            key += 1
            rows.append((rnd.choice(["document", "document", "chunk"]), key, t))
    rows += [("document", 1000 + i, sentence(rnd, 50)) for i in range(40)]
    rows += [("document", 2000, rows[0][2].upper() + "!"), ("document", 2001, rows[0][2]), rows[0], rows[1]]
    rows += [("document", 2002, None), ("document", 2003, ""), (None, 5, rows[0][2]), ("document", None, rows[0][2]), ("document", 2004, "a b c"), ("document", 2005, "a b c"), ("document", 3000, sentence(rnd, 30_000))]
    return rows


@pytest.mark.parametrize("hot", [near_duplicates.HOT_BUCKET, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    if hot == 1:  # all sampled, so every shared bucket goes the way of large ones
        monkeypatch.setattr(near_duplicates, "_SAMPLED", 1)
    monkeypatch.setattr(near_duplicates.near_duplicates, "__defaults__", (0.7, 3, 30, hot, 4 if hot == 1 else near_duplicates.BLOCK, near_duplicates.FILTER_BITS))
    rows = corpus(1, groups=24)
    got = {tuple(r) for r in near_duplicates.duplicate_pairs(texts(spark, rows).repartition(5)).collect()}
    expected = brute_pairs(rows)
    assert len(expected) > 50 and got == expected


def test_groups_and_links(spark):
    rows = corpus(2, groups=6)
    pairs = brute_pairs(rows)
    links = {}
    for k, a, b in pairs:
        for x, y in ((a, b), (b, a)):
            links.setdefault((k, x), set()).add(y)
    parent = {n: n for n in links}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for k, a, b in pairs:
        x, y = sorted((find((k, a)), find((k, b))))
        parent[y] = x
    got = {(r.kind, r.key): (r["group"], r.links) for r in near_duplicates.duplicate_groups(texts(spark, rows)).collect()}
    assert got == {n: (find(n)[1], len(s)) for n, s in links.items()}


def test_many_copies_are_expanded_in_parts(spark):
    rnd = random.Random(3)
    base = sentence(rnd, 60)
    near = base.rsplit(" ", 3)[0] + " x y z"
    rows = [("document", i, base) for i in range(50)] + [("document", 100 + i, near) for i in range(3)]
    members = near_duplicates.near_duplicates(texts(spark, rows))[0]
    assert sorted({(r["class"], r["size"]) for r in members.collect()}, key=lambda x: x[1])[-1][1] == 50
    assert {tuple(r) for r in near_duplicates.duplicate_pairs(texts(spark, rows)).collect()} == brute_pairs(rows)


def test_no_near_duplicates_in_an_empty_table(spark):
    empty = texts(spark, []).limit(0)
    assert near_duplicates.duplicate_pairs(empty).count() == 0 and near_duplicates.duplicate_groups(empty).count() == 0


def test_covering_masks_meet_within_their_radius():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 32, size=(1, near_duplicates.PARTS * 7), dtype=np.uint32)
        b = a.copy()
        b[0, rng.choice(a.shape[1], 3 * near_duplicates.PARTS - 1, replace=False)] ^= 1
        salt = np.zeros(1, np.uint64)
        assert (near_duplicates.table_keys(a, salt) == near_duplicates.table_keys(b, salt)).any()


def test_words_and_shingles():
    samples = ["Ab-cd  12x\nÉa K", "", None, "x\0y", "z" * 500, "ß9 İstanbul"]
    hashes, bounds = word_hashes(samples)
    names = {}
    for text, a, b in zip(samples, bounds[:-1], bounds[1:], strict=True):
        words = WORDS.findall((text or "").replace("\0", " ").lower())
        assert b - a == len(words)
        for w, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    long = " ".join(map(str, range(40)))
    assert shingle_sets([long, "a b", None])[1:] == [None, None] and len(shingle_sets([long])[0]) == 38


@pytest.mark.parametrize("unit, limit, overlap", [("characters", 80, 10), ("characters", 80, 0), ("words", 12, 3), ("characters", 2, 1)])
def test_pieces_cover_the_text(spark, unit, limit, overlap):
    rnd = random.Random(5)
    marks = [" ", " ", " ", ". ", ", ", "\n", "\n\n", "\r\n", "\u00a0", "  ", "\n\\section{A} ", "。"]
    whole = ["".join(rnd.choice(["word", "é", "x" * 30, "\U0001f600"]) + rnd.choice(marks) for _ in range(n)) for n in (3, 40, 200)]
    whole += ["x" * 500, " " * 300, "", None, "a" * limit]
    rows = [("d", i, t) for i, t in enumerate(whole)] + [("d", None, whole[2])]
    size = lambda t: len(t.split()) if unit == "words" else len(t)
    got = {}
    for r in pieces.split_oversized(texts(spark, rows).select("kind", "key", "text"), unit, limit, overlap).collect():
        got.setdefault(r.key, []).append(r)
    assert {k for k in got if k is not None} == {i for i, t in enumerate(whole) if t and size(t) > limit}
    for key, parts in got.items():
        if key is None:
            continue
        parts.sort(key=lambda r: r.chunk_id)
        text = whole[key]
        assert [r.chunk_id for r in parts] == list(range(len(parts))) and len(parts) > 1
        ends = [r.own_start for r in parts[1:]] + [len(text)]
        assert parts[0].own_start == parts[0].start == 0
        for r, end in zip(parts, ends, strict=True):
            assert r.text == text[r.start : end] and size(r.text) <= limit and size(text[r.start : r.own_start]) == (0 if r.chunk_id == 0 else min(overlap, size(text[: r.own_start])))


def test_cuts_prefer_strong_boundaries():
    text = "a " * 20 + "b. " + "c " * 20 + "\n\n" + "d " * 22
    assert text[pieces.cut_place(text, 0, len(text)) :].startswith("d ")
    with pytest.raises(ValueError):
        pieces.split_oversized(None, "words", 5, 5)


def test_token_ids_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rnd = random.Random(6)
    alphabet = ["a", "the ", "  ", "\n", "don't", "12", "é", "日本", "\U0001f600", "!!", "<|endoftext|>", "\t", "\u00a0", "\x1c", "x" * 40, " \n ", "'s", "'re"]
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400))) for _ in range(60)] + ["a" * 3000, " " * 500, "ab" * 700, "\n\n\n", None, ""]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    expected = {i: reference.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(samples)}
    df = spark.createDataFrame(list(enumerate(samples)), "doc_id bigint, text string").withColumns({"ids": F.lit(1), "row": F.lit(2), "piece": F.lit(3)})
    for limit in (tokens.LONG_TEXT, 64):
        assert {r.doc_id: r.ids for r in tokens.token_ids(df.repartition(3), long_text=limit).collect()} == expected
    encoder = tokens.Encoder(*tokens.public_vocabulary())
    for limit in (1, 7, 50):
        for i, t in enumerate(samples[:20]):
            assert encoder.encode_tree(t, limit, window=1).tolist() == expected[i]
    assert tokens.token_ids(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab " * 50), (1, "ab " * 50), (None, "cd " * 50)], "doc_id bigint, text string")
    assert sorted(len(r.ids) for r in tokens.token_ids(twice, long_text=40).collect()) == sorted(len(encoder.encode(t)) for t in ("ab " * 50, "ab " * 50, "cd " * 50))


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(7)
    items = [(i, " ".join(f"t{rnd.randrange(60)}" for _ in range(rnd.choice([8, 13, 40])))) for i in range(12)]
    items += [(99, items[5][1] + " shared"), (100, None), (101, "")]
    docs = []
    for d in range(80):
        item = rnd.choice([t for _, t in items if t]).split()
        a = rnd.randrange(len(item))
        passage = item[a : a + rnd.randrange(5, 30)]
        text = " ".join(f"\\emph{{{w.upper()}}}~\n% " if rnd.random() < 0.3 else w + rnd.choice(["", ",", "."]) for w in passage)
        docs.append((d, sentence(rnd, 10) + " " + text + " " + sentence(rnd, 10)))
    docs += [(500, None), (501, ""), (None, items[2][1]), (502, "t1 " * 20_000)]

    def grams(text, n=13):
        w = WORDS.findall(re.sub(r"\\[a-zA-Z]+", " ", text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    expected = {(d, i) for d, t in docs if d is not None for i, u in items if grams(t) & grams(u)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    tests = spark.createDataFrame(items + items[:2], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    for chars in (leaks.ITEM_CHARS, 300):
        got = leaks.leaks(df.repartition(3), tests, 13, item_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and all(r.longest >= 13 and 0 < r.coverage <= 1 for r in got)
    assert leaks.leaks(df.limit(0), tests).count() == leaks.leaks(df, tests.limit(0)).count() == 0


def test_tiles_find_moved_passages():
    left, right = np.array([7, 8, 9, 1, 2, 3, 4, 0, 5, 6], np.uint64), np.array([1, 2, 3, 4, 5, 6, 7, 8, 9], np.uint64)
    assert sorted(leaks.tiles(left, right, 2)) == [(0, 6, 3), (3, 0, 4), (8, 4, 2)]
    assert leaks.tiles(left, right, 5) == [] and leaks.tiles(right[:0], right, 2) == []
    repeated = np.array([1, 1, 1, 1, 1], np.uint64)
    assert sum(n for *_, n in leaks.tiles(repeated, repeated, 2)) == 5


def test_disguised_spellings():
    for text in ("id1ot", "I D I O T", "idiiiiot", "id\u200biot", "id\\-iot", "\\textbf{idiot}", "ＩＤＩＯＴ", "i.d.i.o.t"):
        assert b"idiot" in abuse.canonical(f"what an {text} he is"), text
    assert b"2018a" in abuse.canonical("\\cite{surname2018a}") and abuse.canonical("") == b" "


def test_classifier_on_held_out_passages(spark):
    rnd = random.Random(8)
    bad = ["what a {} you are", "this {} of an editor should be fired", "shut up you {}", "only a {} would write this"]
    insults = ["idiot", "moron", "pathetic loser", "stupid clown", "worthless fool"]

    def document(kind):
        """Sentences, of which one is abusive, or now and then quotes an insult."""
        lines = [f"the {rnd.choice(['model', 'proof', 'sample', 'cohort'])} {rnd.choice(['shows', 'has', 'lacks'])} {sentence(rnd, 6)}." for _ in range(12)]
        if kind:
            lines.insert(rnd.randrange(12), rnd.choice(bad).format(rnd.choice(insults)) + "!")
        elif rnd.random() < 0.3:
            lines.insert(3, "the word idiot was annotated as an insult in the corpus.")
        return " ".join(lines)

    truth = {i: i % 12 == 0 for i in range(1500)}
    rows = [(i, f"s{i % 3}" if i % 7 else None, document(k)) for i, k in truth.items()] + [(5000, "s", None), (5001, "s", ""), (5002, "s", " ".join(document(False) for _ in range(300))), (5003, "s", " ".join(document(i == 150) for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("score", F.lit("x"))
    marks = [(i, int(truth[i]) if rnd.random() > 0.03 else 1 - int(truth[i])) for i in range(900)] + [(0, None), (None, 1), (9999, 1)]
    model = abuse.train(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    scores = abuse.abuse_scores(docs.repartition(3), model)
    flagged = {r.doc_id for r in scores.where("score > 0").collect()}
    held = {i for i in truth if i >= 900}
    hit = len(flagged & {i for i in held if truth[i]})
    assert hit >= 0.9 * sum(truth[i] for i in held) and hit >= 0.9 * len(flagged & held) and flagged & {5000, 5001, 5002, 5003} == {5003}
    by = {r.source: r for r in abuse.rates(scores).collect()}
    assert sum(r.documents for r in by.values()) == len(rows) and abs(by["s0"].rate - by["s0"].cases / by["s0"].documents) < 1e-12
    assert abuse.abuse_scores(docs.limit(0), model).count() == 0


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(i, "s", "plain words about a method " * 10) for i in range(60)] + [(99, "s", "plain words. you are a stupid idiot, shut up!")], "doc_id bigint, source string, text string")
    model = abuse.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    best = abuse.abuse_scores(docs, model).orderBy(F.desc("score")).first()
    assert best.doc_id == 99


def test_class_numbers_that_clash_are_told_apart(spark):
    rnd = random.Random(4)
    rows = [("document", i, sentence(rnd, 40)) for i in range(40)]
    rows += [("document", 100 + i, rows[i % 3][2]) for i in range(9)] + [("chunk", i, rows[i][2]) for i in range(3)]
    df = spark.createDataFrame(rows, "kind string, key bigint, text string")
    pairs = [sorted(map(tuple, near_duplicates.duplicate_pairs(df, class_bits=bits).collect())) for bits in (64, 4)]
    groups = [sorted(map(tuple, near_duplicates.duplicate_groups(df, class_bits=bits).collect())) for bits in (64, 4)]
    assert pairs[0] == pairs[1] and groups[0] == groups[1] and len(pairs[0]) == 3 * 6


def test_very_many_copies_are_split(spark, monkeypatch):
    from vecloom.operators import skew

    monkeypatch.setattr(near_duplicates, "NARROW", 20)
    monkeypatch.setattr(skew.split_join, "__defaults__", (20, "inner", None))
    rnd = random.Random(14)
    text = sentence(rnd, 40)
    rows = [("document", i, text) for i in range(120)] + [("document", 500, text + " and one more"), ("document", 501, sentence(rnd, 40))]
    got = near_duplicates.duplicate_groups(spark.createDataFrame(rows, "kind string, key bigint, text string")).collect()
    assert {(r.key, r.group, r.links) for r in got} == {(i, 0, 120) for i in (*range(120), 500)}


def test_unsplit_text_is_encoded_about_once():
    rnd = random.Random(3)
    encoder = tokens.Encoder(*tokens.public_vocabulary())
    for text in ("".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 200_000, "".join(rnd.choice("0123456789") for _ in range(200_000)), " " * 50_000 + "x"):
        encoder.encoded = 0
        got = encoder.encode_tree(text, 16_384)
        assert (got == encoder.encode(text)).all() and encoder.encoded < 0.2 * len(text)


def test_repetitive_texts_are_tiled_in_time():
    import time

    began = time.perf_counter()
    word = np.full(20_000, 7, np.uint64)
    assert leaks.tiles(word, word[:1_000], 13) == [(0, 0, 1_000)]
    cycle = np.tile(np.arange(37, dtype=np.uint64), 540)
    assert leaks.tiles(cycle, cycle[5:900], 5)[0][2] == 895
    assert time.perf_counter() - began < 2


def test_leaks_of_many_items_are_joined(spark):
    rnd = random.Random(9)
    items = [(i, sentence(rnd, 30)) for i in range(20)]
    docs = [(d, " ".join([sentence(rnd, 20), *items[d % 20][1].split()[5 : 5 + d % 26], sentence(rnd, 20)])) for d in range(60)] + [(900, items[3][1] * 3), (900, items[3][1] * 3)]
    df, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for length, least in ((13, 0.0), (5, 0.5)):
        one, two = (sorted(map(tuple, leaks.leaks(df, tests, length, least, item_chars=n).collect())) for n in (leaks.ITEM_CHARS, 10))
        assert one == two and one


def test_a_model_is_stored(spark, tmp_path):
    model = abuse.Model(np.arange(abuse.BUCKETS, dtype=np.float32), 1.5)
    abuse.save_model(spark, model, str(tmp_path / "model"))
    again = abuse.load_model(spark, str(tmp_path / "model"))
    assert (again.weights == model.weights).all() and again.threshold == 1.5
