"""Language id, quality rules, license scans, quality model: small cases against brute force."""

import math
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jsonlake.llm import langid, lattice, license_scan, piece_codec, quality_model, quality_rules
from jsonlake.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no public tokenizer files here")
DOCS = "doc_id long, text string, lang string, source string, text_ string, host string"


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.read_vocabulary(PIECES)


def paths(text, pieces):
    """All segmentations, character by character where nothing matches."""
    if not text:
        return [[]]
    out = []
    for n in range(1, min(len(text), 16) + 1):
        if text[:n] in pieces or n == 1:
            out += [[text[:n], *rest] for rest in paths(text[n:], pieces)]
    return out


def test_edges_find_every_piece(vocabulary):
    pieces, _, plain, _ = vocabulary
    table = lattice.PieceTable(pieces, plain)
    known = {p for i, p in enumerate(pieces) if plain[i]}
    words = ["▁hello", "▁naïve", "▁日本語", "zzz\nq", "▁▁▁x"]
    for where, codes in lattice.by_length(words):
        got = {(int(where[r]), s, e, pieces[i]) for s, e, rows, ids in table.edges(codes) for r, i in zip(rows, ids, strict=True)}
        want = {(int(w), s, e, words[w][s:e]) for w in where for s in range(len(words[w])) for e in range(s + 1, len(words[w]) + 1) if words[w][s:e] in known}
        assert got == want


def test_forward_sums_all_segmentations(vocabulary):
    pieces, _, plain, _ = vocabulary
    table = lattice.PieceTable(pieces, plain)
    known = {p: i for i, p in enumerate(pieces) if plain[i]}
    rng = np.random.default_rng(1)
    probs = rng.random((len(pieces) + 1, 2)) * 1e-2
    model = langid.LangModel(["x", "y"], table, probs)
    for word in ("▁the", "▁über", "▁☃a"):
        want = sum(np.prod([probs[known.get(p, len(pieces))] for p in path], axis=0) for path in paths(word, known))
        assert np.allclose(model.word_scores([word])[0], np.log(want))
        assert np.allclose(langid.long_forward(table, word, probs, len(pieces)), np.log(want))
    # Long words: all segmentations, in numbers of any size.
    from fractions import Fraction

    exact = [[Fraction(float(v)) for v in row] for row in probs]
    long = "▁" + "überthe☃" * 12
    for k in range(2):
        sums = [Fraction(1)] + [Fraction(0)] * len(long)
        for end in range(1, len(long) + 1):
            for start in range(max(0, end - table.longest), end):
                i = known.get(long[start:end], len(pieces) if start == end - 1 else None)
                sums[end] += sums[start] * exact[i][k] if i is not None else 0
        want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
        assert math.isclose(model.word_scores(["▁a", long])[1][k], want, rel_tol=1e-9)


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"palabra{rng.integers(5000)}casa".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(300)), "es", None, None, None) for i in range(300)]
    rows += [(1000 + i, "quux zyzzy wuvvle " * 5, "xx", None, None, None) for i in range(6)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, DOCS), PIECES).collect()}
    assert all(out[1000 + i] == "xx" for i in range(6)) and all(out[i] == "es" for i in range(300))


def test_language_id(spark):
    rows = []
    words = {"aa": "alpha beta gamma delta".split(), "bb": "uno dos tres cuatro".split()}
    rng = np.random.default_rng(0)
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(words[lang], 12)), lang, None, "x", "h"))
    rows += [(200, None, "aa", None, "x", "h"), (201, "", "bb", None, None, None), (202, "12 34 !?", None, None, None, None), (203, "alpha " * 20000, None, "s", None, None), (None, "beta " * 5, None, None, None, None), (203, "alpha", None, "s", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.identify(df, PIECES).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id != 203}
    assert all(by[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(120))
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (200, 201, 202))
    assert by[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id == 203} == {"aa"}
    assert {r.lang_pred for r in langid.identify(df.limit(0), PIECES).collect()} == set()
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled, PIECES).collect()} == {"und"}


def brute_base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {i + k for i in range(len(words) - 2) for k in range(3) if tri[tuple(words[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a b c a b c", "a b c d a b c", "x\nx\n x\nx", "é ü z #$   a\x1cb", "a " * 500, "一 二 三 一 二 三\n"])
def test_base_counts(text):
    assert quality_rules.base_counts(text) == brute_base(text)


def brute_rules(rows):
    """(n_words, lost_words, base_failed, kept) by row of (doc_id, text, host)."""
    ws = " \t\n\x0b\x0c\r"
    count = lambda x: len([w for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w])
    key = lambda x: x.strip(ws).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t, h in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders.setdefault((h, key(x)), set()).add(i)
    over = {k: min(v) for k, v in holders.items() if k[1] and len(v) > (2 if count(k[1]) >= 10 else 10)}
    out = []
    for i, t, h in rows:
        n, repeat = count(t), brute_base(t)[4]
        lost = sum(count(x) for x in (t or "").split("\n") if i is not None and over.get((h, key(x)), i) != i)
        failed = n < 50 or 100 * repeat > 50 * n
        out.append((n, lost, failed, not failed and lost < 0.7 * n))
    return out


def test_line_frequency(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    boiler, menu = " ".join(f"b{j}" for j in range(150)), "home about contact"
    rows = [(k, f"{body(k)}\n  {boiler.upper() if k % 2 else boiler} \n{menu}", "s") for k in range(30)]
    rows += [(100 + k, f"{body(100 + k)}\n{boiler}\n{menu}", "t") for k in range(2)]  # two documents of a host: under the limit
    rows += [(110 + k, f"{body(110 + k)}\n{menu}\n{menu}", None) for k in range(11)]
    rows += [(200, None, None), (201, "", "s"), (202, body(202), None), (None, f"{body(0)}\n{boiler}", "s"), (None, body(1), "s"), (None, body(1), "s")]
    rows += [(3, rows[3][1], "s"), (3, body(3) + "\n" + menu, "s"), (4, boiler, "u")]  # repeated rows and ids
    got = quality_rules.assess(spark.createDataFrame([(i, t, None, h, None, None) for i, t, h in rows], DOCS)).collect()
    flat = lambda x: sorted(x, key=lambda r: tuple((v is not None, v) for v in r))
    assert flat((r.doc_id, r.n_words, r.lost_words, r.base_failed, r.kept) for r in got) == flat((rows[k][0], *w) for k, w in enumerate(brute_rules(rows)))
    by = {r.doc_id: r for r in got}
    assert by[0].kept and by[0].lost_words == 0  # the first holder keeps its lines
    assert all(not by[k].kept and by[k].lost_words == 153 for k in range(5, 30)) and by[100].kept and by[101].kept
    assert quality_rules.assess(spark.createDataFrame([], DOCS)).count() == 0


def test_a_repeated_row_is_no_further_holder_of_a_line(spark):
    line = " ".join(f"b{j}" for j in range(60))
    rows = [(k, line, None, "s", None, None) for k in range(2)]
    rows += [rows[0]] * 3
    got = quality_rules.assess(spark.createDataFrame(rows, DOCS)).collect()  # two documents: not over the limit
    assert len(got) == 5 and all(r.lost_words == 0 and r.kept and r.n_words == 60 for r in got)
    short = spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(30)), None, "s", None, None)] * 2, DOCS)
    assert [(r.n_words, r.base_failed) for r in quality_rules.assess(short).collect()] == [(30, True)] * 2


def brute_license(text):
    words = license_scan.template_words(text or "")
    places = [(i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({lab for _, lab in places}))


def test_license_scan(spark):
    apache = license_scan.TEMPLATES[1][1]
    mit = license_scan.TEMPLATES[4][1]
    texts = [None, "", "no words here", "ALL rights-reserved. all  rights reserved", "cc by cc by general public license", "x " * 30 + apache, apache.replace("obtain a copy", "get one single copy") + " tail " * 40, "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "of the in the under the terms of the " * 10, "y " * 5000 + mit + " z" * 5000, "Licensed under CC BY-NC 4.0.", "épublic general public licenseé", "ALL RIGHTS RESERVED Kelvin All Rights Reserved", "all rights", "reserved all rights reserved"]
    df = spark.createDataFrame([(i, t, None, None, "t", None) for i, t in enumerate([*texts, texts[3]])], DOCS).withColumn("doc_id", F.when(F.col("doc_id") == len(texts), 3).otherwise(F.col("doc_id")))
    out = license_scan.scan(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in out}
    assert labels[5] == labels[6] == labels[7] == "apache-2.0" and labels[8] == labels[10] == "mit" and labels[9] == "" and "cc-by-nc" in labels[11]
    spans = {r.doc_id: r.spans for r in out}
    assert min(s.start for s in spans[5]) == 30 and min(s.start for s in spans[10]) == 5000
    assert license_scan.scan(df.limit(0)).count() == 0


def test_statistics_of_edge_texts():
    for t in (None, "", " ", "\n\n", "x" * 100_000, "é", "\x00"):
        s = quality_model.statistics(t)
        assert len(s) == len(quality_model.STATS) and all(math.isfinite(v) for v in s)


def test_rules_as_columns_and_learning(spark):
    rng = np.random.default_rng(3)
    good = lambda k: " ".join(f"word{rng.integers(400)}" for _ in range(80))
    bad = [lambda: " ".join(f"W{rng.integers(400)}!!" for _ in range(80)), lambda: "same line again\n" * 40]
    rows = [(k, good(k) if k % 3 else bad[k % 2](), None, None, None, None) for k in range(300)] + [(900, None, None, None, None, None), (901, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train_held_out(docs, labels)
    out = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    held = [k for k in range(300) if __import__("zlib").crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(out[k] >= 0.7) == (k % 3 != 0) for k in held]) >= 0.97
    # The Spark expression and the Python ensemble agree.
    for k in (0, 1, 2, 3):
        assert math.isclose(out[k], model.predict(np.array([quality_model.statistics(rows[k][1])]))[0], rel_tol=1e-9)
    kept = quality_model.keep(docs, model, 0.7)
    assert kept.columns == docs.columns and 150 < kept.count() <= 210
    empty = quality_model.train(docs, labels.limit(0))
    assert quality_model.score(docs, empty).first().score == 0.5
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_n_best_against_all_segmentations(vocabulary):
    pieces, scores, plain, _ = vocabulary
    known = {p: i for i, p in enumerate(pieces) if plain[i]}
    codec = piece_codec.Codec(PIECES)
    for text in ("the cat", "hello\nworld", "a☃b", "ab  cd", "über", " x", "x ", "a\n b", "\n\n"):
        form = "▁" + text.replace(" ", "▁")
        every = sorted((sum(scores[known[p]] if p in known else codec.unknown for p in path) for path in paths(form, known)), reverse=True)
        (best, found), = codec.encode([text], 5)
        assert np.allclose(best, every[:5]) and codec.decode(found[0]) == text
        # Each of the N is another segmentation, has the score it is said to have and decodes to the text.
        assert len({p.tobytes() for p in found}) == len(found) == len(best) and all(codec.decode(p) == text for p in found)
        score_of = lambda p: sum(scores[i] for i in p.tolist() if plain[i])
        if all(c in known for c in form):
            assert np.allclose([score_of(p) for p in found], best)
        direct = lattice.n_best(form, known, scores, codec.unknown, 5, 16)
        assert np.allclose([s for s, _ in direct], every[:5])
        assert all("".join(form[a:b] for a, b, _ in path) == form for _, path in direct)


def test_codec_over_documents(spark):
    texts = [None, "", "plain text", "tab\tand\x00nul", "é" * 2000, "word " * 20000, "no_space" * 300, "emoji 😀 end", "  lead\n\n trail  ", "plain text"]
    df = spark.createDataFrame([(i, t, None, None, "kept", None) for i, t in enumerate(texts)], DOCS)
    out = piece_codec.encode(df, PIECES, n=3, with_segmentations=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].n_pieces is None and rows[1].n_pieces == 0 and rows[1].round_trip and rows[1].n_found == 1
    assert all(rows[i].round_trip for i in range(1, len(texts))) and rows[2].ids_sha256 == rows[9].ids_sha256
    assert all(len(rows[i].piece_ids) == rows[i].n_pieces for i in range(1, len(texts))) and rows[2].text_ == "kept"
    for i in range(1, len(texts)):
        r = rows[i]
        assert r.segmentations[0] == r.piece_ids and len(r.segmentations) == r.n_found == len(r.nbest_sha256)
        assert len({tuple(x) for x in r.segmentations}) == r.n_found
    assert rows[0].segmentations is None and rows[0].piece_ids is None and rows[2].n_found == 3
    named = piece_codec.encode(df.withColumn("n_pieces", F.lit("x")), PIECES)
    assert dict(named.dtypes)["n_pieces"] == "bigint" and named.columns.count("n_pieces") == 1
    back = {r.doc_id: r.back for r in piece_codec.decode(out, PIECES, to="back").collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert piece_codec.encode(df.limit(0), PIECES).count() == 0


def test_results_do_not_depend_on_the_cache(monkeypatch):
    texts = [f"some words {k} and more of them {k * 7}" for k in range(50)]
    plainly = lambda got: (got[0], [p.tolist() for p in got[1]])
    want = [plainly(x) for x in piece_codec.Codec(PIECES).encode(texts, 3)]
    monkeypatch.setattr(piece_codec, "CACHE_CHUNKS", 4)
    small = piece_codec.Codec(PIECES)
    assert [plainly(x) for t in texts for x in small.encode([t], 3)] == want


def test_the_cache_holds_each_chunk_once():
    """A second string for each chunk was the largest part of an encoder."""
    codec = piece_codec.Codec(PIECES)
    list(codec.encode([f"word{k} and\nword{k}  after two spaces, \0 too" for k in range(200)], 3))
    assert len(codec.names) == len(codec.cache) > 200
    assert all(a is b for a, b in zip(codec.names, codec.cache, strict=True))


def test_an_encoder_gives_back_what_it_frees():
    """Workers are used again, so freed memory that stays in their pools counts against the executor later on."""
    script = f"""
import re
from jsonlake.llm import piece_codec
from jsonlake.llm.common import give_back
def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
codec = piece_codec.Codec({PIECES!r})
give_back()
before = held()
freed = [b"%0600d" % k for k in range(200_000)]
last = freed[-1]
del freed
list(codec.encode(["some words"]))
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(got.stdout) < 40  # of 130 MB
