"""The pipeline: deterministic stages against brute force, the whole run for what must hold."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
from jsonlake.llm import line_dedup
from jsonlake.llm.queries import table

SF = "/root/testdata/sf0.001"


def kept_lines(texts: dict) -> dict:
    """Lines of 20 or more code points that three documents hold stay in the largest id only."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in texts.items()}


def shingles(text: str) -> set:
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def group_heads(texts: dict) -> set:
    sets = {d: shingles(t) for d, t in texts.items()}
    head = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((head[a], head[b]))
                head = {d: x if h == y else h for d, h in head.items()}
    return {d for d in sets if head[d] == d}


def test_line_and_copy_stages_agree_with_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.where("text IS NOT NULL").collect()}
    out = corpus_pipeline.lines(spark, docs, SF)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    want = kept_lines(texts)
    assert {d: rows[d].text for d in texts} == want and len(rows) == docs.count()
    assert all(rows[d].n_chars == len(t) for d, t in want.items() if t != texts[d])
    out = corpus_pipeline.near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} & set(texts) == group_heads(texts)


def test_the_line_stage_compacts_runs_over_two_levels(spark, monkeypatch):
    """Two batches, as below 1 TB before, are one anti-join and no compaction."""
    seen, close = [], line_dedup.LineIndex.close
    monkeypatch.setattr(line_dedup.LineIndex, "close", lambda self: (seen.append([len(x) for x in self.levels]), close(self)))
    docs = table(spark, SF, "documents").where("text IS NOT NULL")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got == kept_lines({r.doc_id: r.text for r in docs.collect()})
    assert seen == [[0, 0, 1]]


def test_the_whole_run_keeps_whole_distinct_documents(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing to target weights", "sentencepiece encoding"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = [r.doc_id for r in rows]
    assert 0 < len(ids) < len(texts) and len(set(ids)) == len(ids) and set(ids) <= set(texts)
    # Only whole lines go, in place.
    for r in rows:
        rest = iter(texts[r.doc_id].split("\n"))
        assert not r.text or all(any(x == y for y in rest) for x in r.text.split("\n"))
