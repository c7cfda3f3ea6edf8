"""Line dedup, MinHash, embeddings, WARC, mixing: small cases against brute force."""

import base64
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jsonlake.llm import components, line_dedup, minhash, mixing, pivot_index, warc
from jsonlake.llm.common import work_dir

DOCS = "doc_id long, text string, lang string, h1 long, top string"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    parents = [(k, k - 1) for k in range(1, 40)] + [(50 + k, 50) for k in range(1, 9)]
    folder = work_dir(spark, "t")
    forest = components.roots_of(spark.createDataFrame(parents, "node long, parent long"), folder)
    assert {r.node: r.comp for r in forest.collect()} == roots({x for e in parents for x in e}, parents)
    more = [(39, 57), (70, 71)]
    merged = components.merge_components(forest, spark.createDataFrame(more, "a long, b long"), folder + "/m")
    assert {r.node: r.comp for r in merged.collect()} == roots({x for e in parents + more for x in e}, parents + more)


def brute_lines(rows, min_chars=20, min_docs=3):
    ws = " \t\n\x0b\x0c\r"
    low = lambda s: s.strip(ws).translate({c: c + 32 for c in range(65, 91)})
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs.setdefault(low(x), set()).add(i)
    gone = {k: max(v) for k, v in docs.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {i: [x for x in (t or "").split("\n") if gone.get(low(x), i) == i] for i, t in rows}


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    shared, other = "A shared line of twenty characters", "éééééééééééééééééééé"
    rows = [(1, f"{shared}\nown one"), (2, f"\t{shared.lower()}  \nshort\n{other}"), (3, f"{shared}\n{shared}\nshort\n{other}"), (4, f"short\n{other}\n"), (5, None), (6, ""), (7, "x" * 100_000), (8, "short"), (9, "twice in one document only\n" * 3), (10, f"\x1c{shared}"), (11, "trailing\n\n")]
    df = spark.createDataFrame([(i, t, "l", 7, "t") for i, t in rows], DOCS)
    out = line_dedup.drop_lines(df, batches=batches)
    got = {r.doc_id: r for r in out.collect()}
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].text == "\n".join(want[i]) and got[i]["__n_lines"] == len((t or "").split("\n")) and got[i]["__n_dropped"] == len((t or "").split("\n")) - len(want[i]), i
    assert got[1].h1 == 7 and got[1].top == "t"
    assert line_dedup.drop_lines(df.limit(0)).count() == 0
    again = line_dedup.drop_lines(df.unionByName(df.where("doc_id = 1")), batches=batches)  # a repeated row counts once
    assert {r.doc_id: r.text for r in again.collect()} == {i: "\n".join(x) for i, x in want.items()}


@pytest.mark.parametrize("batches", [1, 3])
def test_a_repeated_row_is_no_further_holder_of_a_line(spark, batches):
    line = "a line that two documents hold"
    rows = [(5, f"{line}\nfive"), (5, f"{line}\nfive"), (3, f"{line}\nthree")]
    out = line_dedup.drop_lines(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), batches=batches)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(rows)


def test_index_levels(spark):
    df = spark.createDataFrame([(i, f"line number {i % 7:030d}\nline {i} is in one document only", None, None, None) for i in range(70)], DOCS)
    lines = line_dedup.keyed_lines(df, 20, 5).cache()
    index = line_dedup.build_index(lines, work_dir(spark, "idx"), 5, fanout=2)
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five batches at fanout 2
    runs = [{(r.h1, r.h2) for r in spark.table(t).collect()} for t in index.runs()]
    assert sum(map(len, runs)) == len(set.union(*runs)) == 77  # the anti-join: no hash in two runs
    assert {r.n: r["count"] for r in index.counts().groupBy("n").count().collect()} == {10: 7, 1: 70}
    index.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_the_anti_join_decides_the_result(spark, monkeypatch):
    """With what it lets through taken for new, a line has entries of their own counts and stays."""
    line = "a line that three documents hold"
    rows = [(i, line, None, None, None) for i in range(1, 13)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.text for r in line_dedup.drop_lines(docs, batches=12).collect()) == [""] * 11 + [line]
    whole = line_dedup.LineIndex.add
    monkeypatch.setattr(line_dedup.LineIndex, "add", lambda self, batch: self._place(self._write(batch), 0))
    assert sorted(r.text for r in line_dedup.drop_lines(docs, batches=12).collect()) != [""] * 11 + [line]
    monkeypatch.setattr(line_dedup.LineIndex, "add", whole)


def test_by_default_runs_are_compacted_over_two_levels(spark, monkeypatch):
    """Also where the input is small: two batches would never fill a level."""
    rows = [(i, f"line number {i % 30:030d}\nline {i // 2:030d} of two\nline {i} is in one document only") for i in range(100)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    seen, close = [], line_dedup.LineIndex.close
    monkeypatch.setattr(line_dedup.LineIndex, "close", lambda self: (seen.append([len(x) for x in self.levels]), close(self)))
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert got == {i: "\n".join(x) for i, x in brute_lines(rows).items()}
    assert seen == [[0, 0, 1]]


@pytest.mark.parametrize("batches", [3, 7])
def test_several_runs_and_increments_are_summed_whole(spark, batches):
    """Without a broadcast: unions of columnar scans broke the sums of increments and the join with them."""
    df = spark.createDataFrame([(i, f"line number {i % 7:030d}\nline {i} is in one document only", None, None, None) for i in range(70)], DOCS)
    lines = line_dedup.keyed_lines(df, 20, batches).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = line_dedup.build_index(lines, work_dir(spark, "idx"), batches)
        assert {r.n: r["count"] for r in index.counts().groupBy("n").count().collect()} == {10: 7, 1: 70}
        for name in [*index.runs(), *index.more]:
            assert spark.table(name).count() == spark.table(name).select("h1", "h2").distinct().count()
            assert len(spark.table(name).inputFiles()) <= index.buckets  # one file a bucket, also of what was compacted
        index.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_follow_the_size_of_the_input(spark, monkeypatch):
    for size, want in [(0, 16), (10 << 30, 16), (30 << 30, 30), (30 << 40, 64), (1 << 62, 16)]:
        monkeypatch.setattr(line_dedup, "input_bytes", lambda docs, size=size: size)
        assert line_dedup.batches_for(spark.range(1), 1 << 30) == want


def test_runs_are_joined_and_compacted_without_a_shuffle(spark):
    index = line_dedup.LineIndex(spark, work_dir(spark, "idx"), fanout=9, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(2):
            index.add(spark.range(50).selectExpr("id h1", f"id + {k} h2", "1L n", "id top"))
        a, b = index.runs()
        joined = spark.table(a).join(spark.table(b).select("h1", "h2"), ["h1", "h2"], "left_anti")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.close()


def brute_sets(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def corpus():
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(5000)}"
    rows, i = [], 0
    for _ in range(12):  # groups of near copies, some chained through the middle only
        base = [word() for _ in range(120)]
        for k in range(int(rng.integers(2, 25))):
            t = list(base)
            for _ in range(int(rng.integers(0, 6))):
                t[int(rng.integers(120))] = word()
            if k % 5 == 4:
                base = t
            rows.append((i, " ".join(t)))
            i += 1
    for t in (None, "", "  \n", "one two", "ONE two", "one two three", "a b c d e", "A b c d e", "é b c d e", "É b c d e"):
        rows.append((i, t))
        i += 1
    rows += [(i + k, " ".join(word() for _ in range(60))) for k in range(30)]
    return rows + [(i + 40, "long " * 30_000), (i + 41, "LONG " * 30_000)]


@pytest.mark.parametrize("block", [1024, 5])
def test_minhash_against_all_pairs(spark, block):
    rows = corpus()
    sets = {i: brute_sets(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows) and len(links) > 200
    for i, _ in rows:
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_null_and_repeated_ids_through_the_pipeline_stages(spark):
    rows = [(None, "a null id", None, 1, None), (None, "a null id", None, 2, None), (4, "one two three four five six", None, 3, None), (4, "one two three four five six", None, 3, None), (6, "one two three four five six", None, 4, None), (7, "another text", None, 5, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.h1 for r in kept.collect()) == [1, 2, 3, 5]
    plan = spark.createDataFrame([(None, 1), (None, 1), (4, 2), (6, 0), (7, 1)], "doc_id long, copies int")
    assert sorted(r.h1 for r in mixing.resample(docs, plan).collect()) == [1, 2, 3, 3, 3, 3, 5]
    assert sorted(r.h1 for r in mixing.resample(docs, plan.where("doc_id > 4")).collect()) == [5]


def test_minhash_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    lone = minhash.near_duplicates(spark.createDataFrame([(None, "a b", None, None, None), (3, None, None, None, None), (4, "a b", None, None, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in lone) == [(0, 0, True), (3, 3, True), (4, 4, True)]


def test_no_pair_of_small_sets_is_lost(spark):
    """Pairs of 4 to 16 shingles at the threshold: min-max bands alone lose some of them."""
    rows = []
    for k in range(3000):
        n = 4 + k % 13
        words = [f"{k}w{j}" for j in range(n + 4)]
        cut = words[1:] if n == 4 else words[: -(n // 7) or None]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(cut))]
    sets = {i: brute_sets(t) for i, t in rows}
    want = {2 * k for k in range(3000) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 75 * len(sets[2 * k] | sets[2 * k + 1])}
    got = {r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).where("NOT kept").collect()}
    assert got == want and len(want) > 2000


def test_shared_counts_in_slices():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.shared_counts(sets, width=16)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


VECS = "vec_id long, embedding array<float>, label int, sig string"


def vectors(n=400, d=32, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 1:
            v = np.array(rows[-1][1]) + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.06, 0.12])
        else:
            v = rng.normal(size=d)
        rows.append((i, [float(np.float32(x)) for x in v], rows[-1][2] if i % 4 == 1 else int(rng.integers(3)), "s"))
    rows += [(n, rows[0][1], rows[0][2], "s"), (n + 1, rows[0][1], rows[0][2], "s"), (n + 2, None, 1, None), (n + 3, [0.0] * d, 1, None), (n + 4, [float("nan")] * d, 1, None), (n + 5, rows[0][1], None, None), (n + 6, [], 1, None), (n + 7, [None] * d, 1, None), (n + 8, rows[0][1][:5], rows[0][2], None)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_against_all_pairs(spark, block):
    rows = vectors()
    fit = [(i, np.array(e, dtype=np.float64), lab) for i, e, lab, _ in rows if e and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(fit, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    got = {r.vec_id: r for r in pivot_index.near_duplicates(spark.createDataFrame(rows, VECS), block=block).collect()}
    assert len(got) == len(rows)
    degree = {i: 0 for i, *_ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(got[i].n_links for i in degree)
    assert all(got[i].n_links <= degree[i] for i in degree)
    assert found == sum(degree.values()) > 100  # recall 1
    want = roots(degree, links)
    if found:
        assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in degree)
    assert pivot_index.near_duplicates(spark.createDataFrame([], VECS)).count() == 0


def test_embedding_recall_on_ten_thousand_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(7000, 48))
    near = base[:3000] + rng.normal(size=(3000, 48)) * rng.choice([0.1, 0.2, 0.3, 0.36], (3000, 1))
    x = np.concatenate([base, near])
    label = np.concatenate([np.arange(7000) % 3, np.arange(3000) % 3])
    df = spark.createDataFrame([(i, v.tolist(), int(k), None) for i, (v, k) in enumerate(zip(x, label, strict=True))], VECS.replace("float", "double"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(df).collect()}
    found, want = sum(got.values()), int(link.sum())
    assert want > 3000 and found <= want and found >= 0.99 * want, found / want


def test_shared_pivots_are_counted_before_vectors_are_compared():
    sigs = [[1, 2, 3], [2, 3, 4], [3, 5, 6], [1, 3, 9]]
    counts, before = pivot_index.shared_pivots(sigs, 3)
    assert counts[0, 1] == 2 and counts[0, 2] == 1 and counts[0, 3] == 2 and before[0, 1] and not before[0, 2] and not before[1, 2]
    x = np.ones((4, 2))
    links, root = pivot_index.block_links(x, np.ones(4, dtype=np.int64), sigs, np.full(4, 2), 3, 0.93, 1)
    assert links.tolist() == [1, 2, 3, 2] and root.tolist() == [0, 0, 0, 0]  # pairs (0,1) and (0,3) belong to the lists of 2 and 1
    only, _ = pivot_index.block_links(x, np.ones(4, dtype=np.int64), sigs, np.full(4, 2), 3, 0.93, 2)
    assert only.tolist() == [0, 0, 0, 0]
    assert pivot_index.pivot_count(10**9, 64, 32, 32, 64 << 20) > pivot_index.pivot_count(10**8, 64, 32, 32, 64 << 20) > 4096


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    body = ["<p>one</p>", "<p>two</p>", None, "", "é☃" * 50, "x" * 300_000, "<p>one</p>"]
    rows = [(k, f"http://h/{k}\r\n?q" if k % 3 else None, body[k % len(body)], "d") for k in range(60)] + [(7, "http://again", body[0], "d"), (None, "http://null", "n", "d")]
    df = spark.createDataFrame(rows, PAGES)
    folder = work_dir(spark, "warc-test")
    files = warc.write_archives(df, folder, shard_bytes=200_000, roll_bytes=3_000)
    assert files.count() > 5 and files.agg(F.sum("n_records")).first()[0] == 61
    got = warc.read_archives(spark, folder).collect()
    payload = lambda h: (h or "").encode()
    first = {}
    for k, _, h, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(payload(h), k)
    assert len(got) == 61
    texts = {k: payload(h) for k, _, h, _ in rows[:60]}
    for r in got:
        if r.key == 7:
            continue
        p = texts[r.key]
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        if first[p] == r.key:
            assert r.record_type == "response" and bytes(r.payload) == p and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == first[p] and r.payload is None
        assert r.url == (None if r.key % 3 == 0 else f"http://h/{r.key}%0D%0A?q")
    # Both rows of the repeated key hold the text of key 0.
    seven = [r for r in got if r.key == 7]
    assert [r.record_type for r in seven] == ["revisit", "revisit"] and {r.refers_to for r in seven} == {0}
    again = work_dir(spark, "warc-test")
    warc.write_archives(df.repartition(7), again, shard_bytes=200_000, roll_bytes=3_000)
    read = lambda f: {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{f}/data/*.warc.gz").collect()}
    assert read(folder) == read(again)  # the same bytes however Spark deals the rows
    none = work_dir(spark, "warc-test")
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_shard_limits_are_even(spark):
    skewed = [(k, 100) for k in range(1000)] + [(10**12 + k, 100) for k in range(1000)]
    limits = warc.shard_limits(spark.createDataFrame(skewed, "key long, bytes long"), 10_000, buckets=16)
    sizes = np.diff([0, *np.searchsorted([k for k, _ in skewed], limits), len(skewed)]) * 100
    assert len(limits) >= 9 and sizes.max() <= 30_000


def test_shard_limits_take_as_many_jobs_for_more_rows(spark):
    def jobs(n):
        tracker = spark.sparkContext.statusTracker()
        group = f"limits{n}"
        sizes = spark.range(n).selectExpr("id key", f"{100_000_000 // n}L bytes")
        spark.sparkContext.setJobGroup(group, group)
        found = warc.shard_limits(sizes, 100_000, buckets=16)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group)), len(found)

    few, many = jobs(20_000), jobs(200_000)
    assert few[1] > 500 and many[1] > 500 and many[0] <= few[0] + 2
    edges = spark.createDataFrame([(-(1 << 63), 500), ((1 << 63) - 1, 500), (0, 500), (1, 500), (2, 500)], "key long, bytes long")
    limits = warc.shard_limits(edges, 500, buckets=4)
    assert np.searchsorted(limits, [-(1 << 63), 0, 1, 2, (1 << 63) - 1], side="right").tolist() == [0, 1, 2, 3, 4]


def test_pieces_are_counted_in_many_parts(spark):
    """The texts are small, so Spark would make one part of them, but their pieces are not: a task held 411 MB of them."""
    docs = spark.createDataFrame([(i, f"some words {i} of text {i % 7}", None, None, None) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(400)], "doc_id long, domain string")
    spark.sparkContext.setJobGroup("pieces", "pieces")
    try:
        mixing.train(docs, labels, ["clean", "toxic"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("pieces") for s in status.getJobInfo(j).stageIds]
    assert mixing.PARTS in [s.numTasks for s in stages if s]


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(9)
    own = {"clean": [f"c{k}" for k in range(40)], "toxic": [f"t{k}" for k in range(40)], "low": [f"l{k}" for k in range(40)]}
    rows, labels = [], []
    for i in range(600):
        d = ["clean", "clean", "clean", "toxic", "low"][i % 5]
        rows.append((i, " ".join(rng.choice(own[d], int(rng.integers(5, 60)))), None, None, None))
        if i % 3 == 0:
            labels.append((i, d))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "word " * 50_000, None, None, None), (None, "c1 c2", None, None, None), (1, rows[1][1], None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (5, None), (None, "clean")], "doc_id long, domain string")
    targets = {"clean": 0.5, "toxic": 0.3, "low": 0.2}
    plan = mixing.mix(docs.where("doc_id < 900"), lab, targets)
    out = plan.toPandas()
    assert (out.rate >= 0).all() and len(out) == 601
    total = out.tokens.sum()
    for d, share in targets.items():
        assert abs((out.rate * out.tokens * out[f"p_{d}"]).sum() / total - share) < 0.01
    assert abs((out.copies * out.tokens).sum() / total - 1) < 0.1  # rounding keeps the expectation
    assert out.misfit.nunique() == 1 and out.misfit[0] < 0.01
    all_rows = mixing.mix(docs, lab, targets, anchor="clean", max_rate=1.0).toPandas()
    assert len(all_rows) == len(rows) and all_rows.rate.between(0, 1).all()
    same = mixing.resample(docs, plan)
    assert same.columns == docs.columns and same.count() == int(out.drop_duplicates("doc_id").set_index("doc_id").copies.reindex([r[0] for r in rows if r[0] is not None and r[0] < 900]).sum())
    assert mixing.mix(docs, lab.limit(0), targets).count() == len(rows)
    assert mixing.mix(docs.limit(0), lab, targets).count() == 0


@pytest.mark.parametrize("few", [15, 60])
def test_few_labels_of_each_language_are_learned(spark, few):
    """Production defaults; a language has ``few`` labelled toxic documents, whose words share a root or are fixed."""
    rng = np.random.default_rng(3)
    rows, labels, tongue = [], [], {}
    for lang, roots_ in {"xa": ["achlich", "keitach"], "xb": ["boco"], "xc": ["idiot", "scum"]}.items():
        ends = [lang[1] + "".join(rng.choice(list("mnrst"), 4)) for _ in range(400)]
        for i in range(few * 20):
            toxic = i % 10 == 0
            words = list(rng.choice(ends, int(rng.integers(30, 90))))
            if toxic:
                words[:6] = [str(rng.choice(roots_)) + ("" if lang == "xc" else str(rng.choice(ends))) for _ in range(6)]
            k = len(rows)
            rows.append((k, " ".join(words), None, None, None))
            tongue[k] = (lang, toxic)
            if i % 20 < 10:
                labels.append((k, "toxic" if toxic else "clean"))
    plan = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.98, "toxic": 0.02}, anchor="clean", max_rate=1.0)
    got = {r.doc_id: r.p_toxic for r in plan.collect()}
    held_out = set(tongue) - {k for k, _ in labels}
    for lang in ("xa", "xb", "xc"):
        assert np.mean([got[k] > 0.5 for k in held_out if tongue[k] == (lang, True)]) >= 0.9, lang
        assert np.mean([got[k] < 0.5 for k in held_out if tongue[k] == (lang, False)]) >= 0.99, lang


def bounded_least_squares(p, tokens, target, most, steps=20_000):
    """Accelerated projected gradient in numpy, with restarts."""
    top = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    r = np.ones(len(p))
    y, pace, last = r.copy(), 1.0, math.inf
    for _ in range(steps):
        new = np.clip(y - p @ (p.T @ (y * tokens) - target) / top, 0, most)
        now = ((p.T @ (new * tokens) - target) ** 2).sum()
        if now > last:
            y, pace, last = r.copy(), 1.0, math.inf
            continue
        quick = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        y, r, pace, last = new + (pace - 1) / quick * (new - r), new, quick, now
    return p.T @ (r * tokens)


@pytest.mark.parametrize(("weights", "anchor", "most"), [([0.6, 0.3, 0.1], None, 8.0), ([0.97, 0.02, 0.01], 0, 1.0), ([0.01, 0.01, 0.98], None, 1.5), ([1.0, 0.0, 0.0], None, 2.0)])
def test_projected_gradient_against_least_squares(spark, weights, anchor, most):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(10, 90, 200).astype(float)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    got = mixing.solve(table, weights, None, anchor, most, work_dir(spark, "t"))
    rows = got.table.collect()
    r = np.array([x.rate for x in rows])
    assert (r >= 0).all() and (r <= most).all()
    own = np.array([[x.p0, x.p1, x.p2] for x in rows])
    assert np.allclose(((r * [x.tokens for x in rows])[:, None] * own).sum(axis=0), got.reached)
    target = np.array(got.target)
    least = np.linalg.norm(bounded_least_squares(p, tokens, target, most) - target)
    assert np.linalg.norm(np.array(got.reached) - target) <= 1.01 * least + mixing.CLOSE * target.sum()
    assert math.isclose(got.misfit * target.sum(), np.linalg.norm(np.array(got.reached) - target), abs_tol=1e-6)


def test_many_domains(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.2] * 20, 100)
    table = spark.createDataFrame([(50, *map(float, x)) for x in p], "tokens long, " + ", ".join(f"p{k} double" for k in range(20)))
    got = mixing.solve(table, [1.0] * 20, None, None, 8.0, work_dir(spark, "t"))
    assert got.misfit <= 1e-3


def test_rows_keep_their_own_posterior(spark):
    texts = [("c1 c2 c3", "clean"), ("t1 t2 t3", "toxic")]
    rows = [(i, " ".join([texts[i % 2][0]] * 9) + f" w{i}", None, None, None) for i in range(80)]
    labels = [(i, texts[i % 2][1]) for i in range(80)]
    more = [(None, texts[0][0], None, None, None), (None, texts[1][0], None, None, None), (5, texts[0][0], None, None, None), (5, texts[1][0], None, None, None), (5, texts[1][0], None, None, None)]
    plan = mixing.mix(spark.createDataFrame(rows + more, DOCS), spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.5, "toxic": 0.5})
    out = plan.collect()
    assert len(out) == len(rows) + len(more)
    null = sorted(r.p_toxic for r in out if r.doc_id is None)
    assert null[0] < 0.5 < null[1]
    five = sorted(r.p_toxic for r in out if r.doc_id == 5)
    assert len(five) == 4 and five[0] < 0.5 < five[1] and five[1] == five[2] or five[2] == five[3]
