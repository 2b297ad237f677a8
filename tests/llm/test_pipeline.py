import random
import re

import pytest

import corpus_pipeline
from helixlake.llm import decontaminate, simhash

from .test_line_dedup import brute as brute_lines


def five_words(text):
    """The set of a text's runs of five words; fewer words are one run."""
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    vocab = {"en": ["the", "and", "ing", "ther", "shall", "would"], "de": ["der", "und", "schein", "ung", "nicht", "ver"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        line = lambda: " ".join(rng.choices(vocab[lang], k=12)) + f" {i}x{rng.random():.6f}"
        rows.append([i, "\n".join(line() for _ in range(6)), lang, f"s{i % 4}"])
    item = " ".join(rng.choices(vocab["en"], k=4)) + " quite unlike anything else that these documents ever say at length"
    rows[5][1] += "\nthis is a line that repeats in documents"
    rows[6][1] += "\nThis is a line that repeats in documents "
    rows[7][1] += "\nthis is a line that repeats in documents"
    rows[9][1] += " " + item
    rows.append([60, rows[10][1].upper() + "  ", "en", "s1"])
    rows += [[61, None, "en", "s1"], [62, "12 34", "en", None], [63, "", None, "s2"]]
    for k, changed in enumerate(((30,), (30, 59), (30, 58, 59))):  # Jaccard 0.84, 0.81 and 0.78 of 56 shingles
        words = rng.choices(vocab["en"], k=60)
        rows += [[64 + 2 * k, " ".join(words), "en", "s1"], [65 + 2 * k, " ".join(f"{w}s" if i in changed else w for i, w in enumerate(words)), "en", "s2"]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(map(tuple, docs.collect()))
        out = stage(spark, docs, folder).cache()
        after = {r.doc_id: r for r in out.collect()}
        if name == "language ID":
            assert set(after) == {r[0] for r in before if any(c.isalpha() for c in r[1] or "")}
        elif name == "line dedup":
            want = {w[0]: w for w in brute_lines([(r[0], r[1]) for r in before])}
            assert {k: len((r.text or "").split("\n")) for k, r in after.items()} == {k: w[1] - w[2] if w[1] > w[2] else 1 for k, w in want.items()}
            assert sum(w[2] for w in want.values()) >= 2 and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "SimHash near-dedup":
            sets = {r[0]: five_words(r[1]) for r in before}
            like = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0 for a in sets for b in sets if a < b}
            root = {k: k for k in sets}
            for (a, b), j in sorted(like.items()):
                if j >= 0.8:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {k: new if r == old else r for k, r in root.items()}
            assert set(after) == set(root.values()) and 60 not in after
            assert [0.8 <= like[a, a + 1] < 0.85 for a in (64, 66, 68)] == [True, True, False] and like[68, 69] > 0.75
            assert {64, 66, 68, 69} <= set(after) and not {65, 67} & set(after)
        elif name == "benchmark decontamination":
            assert set(after) == {r[0] for r in before} - {9}
        else:
            assert set(after) == {r[0] for r in before} and len({r.mix_position for r in after.values()}) == len(before)
        if name != "mixing sources":
            assert out.columns == names
        docs = out
        seen.append(len(after))
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == seen[-1]
    assert decontaminate.SIMILARITY == 0.8 and simhash.LEAF > 1
