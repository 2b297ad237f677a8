import random

import numpy as np

from helixlake.llm import decontaminate as D

VOCAB = [f"{a}{b}{c}" for a in ("th", "re", "lo", "en", "st") for b in ("a", "o", "ing", "er") for c in ("n", "ly", "s", "tion", "ment", "d")]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i, op = rng.randrange(len(words)), rng.random()
        if op < 0.34:
            words[i] = rng.choice(VOCAB)
        elif op < 0.67 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, rng.choice(VOCAB))
    return words


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    text = " ".join(VOCAB * 3) + " " + "x" * 500 + " end"
    whole = D.text_words(text)
    monkeypatch.setattr(D, "PIECE_BYTES", 64)
    assert (D.text_words(text) == whole).all() and len(whole) == 3 * len(VOCAB) + 2


def test_words_and_edit_distance():
    same = D.text_words("Hello, wORLD! éa 7")
    assert (same == D.text_words("HELLO world\n\néa...7")).all() and len(same) == 4
    assert len(D.text_words(None)) == len(D.text_words("... ")) == 0
    rng = random.Random(5)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(1, 6)), rng.choices("abcd", k=rng.randint(0, 9))
        row = [[0] * (len(b) + 1)] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                row[i][j] = min(row[i - 1][j] + 1, row[i][j - 1] + 1, row[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        x, y = np.array([ord(c) for c in a], np.uint64), np.array([ord(c) for c in b], np.uint64)
        assert D.best_edits(x, y) == min(row[-1])


def test_recall_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(8, 60)))) for i in range(30)]
    docs = []
    for i in range(240):
        words = items[i % 30][1].split()
        body = edited(rng, words, int(rng.choice((0, 0.1, 0.2, 0.3)) * len(words)))
        docs.append((i, " ".join([*rng.choices(VOCAB, k=40), *body, *rng.choices(VOCAB, k=40)])))
    got = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, t in docs:
        for i, s in items:
            item = D.text_words(s)
            e = D.best_edits(item, D.text_words(t))
            if e <= D.allowed_edits(len(item)):
                want[k, i] = e
    assert got.items() <= want.items()
    assert len(got) >= 0.97 * len(want) > 100


def test_awkward_rows(spark, monkeypatch):
    item = " ".join(VOCAB[:20])
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "too short"), (9, "in a row"), (6, " ".join(VOCAB[30:90] * 40))], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.upper(), 0), (2, None, 0), (3, "", 0), (4, "zzz " * 60_000 + item.replace(" ", ", "), 0), (4, item, 0), (None, item, 0), (7, "clean words only", 0), (10, "clean, in (a) ROW then", 0), (11, "in a clean row", 0), (8, " ".join(VOCAB[30:90] * 40), 0)], "doc_id long, text string, edits int")
    monkeypatch.setattr(D, "ITEMS_PER_BLOCK", 2)
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(k, i) for k in (1, 4, 4, None) for i in (1, 2, None)] + [(8, 6), (10, 9)], key=str)
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {2, 3, 7, 11}
    assert D.drop_contaminated(docs, bench).columns == docs.columns
    assert D.contaminated(docs.limit(0), bench).count() == 0 == D.contaminated(docs, bench.limit(0)).count()


def test_recall_by_length_and_kind_of_edit():
    rng = random.Random(21)
    foreign = [f"zz{i}" for i in range(5000)]
    items = [rng.choices(VOCAB, k=n) for n in (5, 9, 15, 59, 150, 400, 1000) for _ in range(3)]
    held = D.make_items([" ".join(w) for w in items])
    for around in (foreign, VOCAB):
        for kind in ("delete", "insert", "replace", "mixed"):
            for i, words in enumerate(items):
                d, body = D.allowed_edits(len(words)), list(words)
                spots = sorted(rng.sample(range(len(words)), d), reverse=True)
                for at in spots:
                    how = rng.choice(("delete", "insert", "replace")) if kind == "mixed" else kind
                    body[at : at + (how != "insert")] = [] if how == "delete" else [rng.choice(around)]
                lead = rng.choices(around, k=30)
                data = " ".join([*lead, *body, *rng.choices(around, k=30)]).encode()
                found = {item: (edits, at) for item, edits, at in D.match_texts(held, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]}
                assert i in found and found[i][0] <= d and abs(found[i][1] - len(lead)) <= 2 * d + 1, (kind, len(words))


def test_scripts_without_spaces_and_text_ids(spark):
    item = "我们在学校里学习数学和语文" * 2
    thai = "ภาษาไทยไม่มีช่องว่างระหว่างคำ"
    bench = spark.createDataFrame([("mmlu-7", item), ("mmlu-8", "the “quick” brown fox — it jumps over"), ("th-1", thai)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "前言。" + item[:9] + "改" + item[10:] + "，后记"), (2, 'so the "quick" brown fox, it jumps over all'), (3, "ก" + thai + "ข"), (4, "我在家")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs, bench).collect()) == [(1, "mmlu-7", 1), (2, "mmlu-8", 0), (3, "th-1", 0)]
    assert len(D.text_words("日本 a。b", True)) == 4 and len(D.text_words("日本 a。b")) == 2
