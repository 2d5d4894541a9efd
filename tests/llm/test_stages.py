"""Every stage of the pipeline against a brute-force version of its decisions, on whole small tables; the searches that SQL can't express against exact ones."""

import re

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from foliograph.llm import ann, bpe, langid, licenses, pii
from foliograph.llm.graph import saved

SF = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return WORD.findall(low(text))


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the result of each stage, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found = saved(stage(spark, docs, SF))
        out.append((docs, docs.collect(), found.collect()))
        docs = found
    return out


def test_language_stage(spark, stages):
    docs, before, after = stages[0]
    judged = {r["doc_id"]: r for r in langid.identify(spark, docs, langid.train(docs)).collect()}
    assert {r["doc_id"] for r in after} == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= 0.35}
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items() and len(after) > 0.9 * len(before)


def test_dedup_stage(stages):
    """Components of all pairs, compared exactly."""
    _, before, after = stages[1]
    low = [r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in before]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                root = [root[b] if r == root[a] else r for r in root]
    groups = {}
    for r, row in zip(root, before, strict=True):
        groups.setdefault(r, []).append(row["doc_id"])
    assert len(groups) < len(before) and {r["doc_id"] for r in after} == {min(ids) for ids in groups.values()}


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = {}
    for r in before:
        spots = [m.span() for m in WORD.finditer(low(r["text"]))]
        w, hit, cut = plain_words(r["text"]), np.zeros(len(spots), bool), np.zeros(len(r["text"]), bool)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = True
                    cut[spots[i][0] : spots[i + n - 1][1]] = True
        if not len(hit) or hit.mean() <= 0.5:
            want[r["doc_id"]] = re.sub("\0+", " ", "".join("\0" if c else x for c, x in zip(cut, r["text"], strict=True)))
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert any(want[r["doc_id"]] != r["text"] for r in before if r["doc_id"] in want)


def test_pii_stage(spark, stages):
    docs, before, after = stages[3]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(spark, docs, pii.train(docs)).collect()}
    got = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        text = r["text"]
        found = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s))
        merged = []
        for a, b, kind in found:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -b)
            else:
                merged.append([a, -b, kind])
        for a, b, kind in reversed(merged):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        assert got[r["doc_id"]] == text
    assert len(after) == len(before) and any(spans.values())


def test_token_stage(stages):
    _, before, after = stages[4]
    own = bpe.encoder(bpe.public_tokenizers.path(bpe.VOCABULARY))
    assert isinstance(own, tiktoken.Encoding)
    want = {r["doc_id"]: np.asarray(own.encode_ordinary(r["text"] or ""), "<u4").tobytes() for r in before}
    assert {r["doc_id"]: bytes(r["ids"]) for r in after} == want


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"], r["ids_sha256"]) for r in got.collect()} == {(r["doc_id"], r["ids_sha256"]) for r in stages[-1][2]}


def test_license_labels(spark):
    """Labels of a whole table: phrases looked up word by word, and tags by a pattern over each line."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    extra = ["SPDX-License-Identifier: MIT OR GPL-2.0+", "see: SPDX License Identifier: (Apache-2.0)", "licensed under the MIT", "all rights reserved, no tag", "spdx-license-identifier MIT"]
    phrases = {p: {label} for p, label in licenses.BASE.items()}
    for p, (label, _) in licenses.NOTICES.items():
        phrases.setdefault(p, set()).add(label)
    for text in [*(r["text"] for r in docs), *extra]:
        w = plain_words(text)
        line = f" {' '.join(w)} "
        want = {label for p, labels in phrases.items() if f" {p} " in line for label in labels}
        for m in re.finditer(r"(?i)spdx[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier:[ \t]*([^\r\n]*)", text):
            value = licenses.evaluate(m[1])
            want |= value[0] if value else set()
        assert licenses.scan_text(text.encode())[5] == ",".join(sorted(want))


def test_recall(spark):
    """Against the exact search of the whole table, with its scores."""
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = {(q, v): s for q, _, v, s in con.sql(ann.EXACT_SQL).fetchall()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.op3_ann(spark, "/root/testdata/sf0.01").collect()}
    both = got.keys() & want.keys()
    assert len(got) == len(want) and len(both) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in both)


def test_graph_search():
    """The walk against the distances of all centroids, for ratios that take few, some and nearly all lists; each query alone finds what it finds among others."""
    rng = np.random.default_rng(3)
    c = rng.normal(size=(700, 24))
    q = np.concatenate([rng.normal(size=(60, 24)), c[:3]])
    index = ann.Index(c, ann.neighbour_graph(c), 1.0, 1.0, 23)
    assert index.graph.shape[1] <= 2 + 2 * ann.DEGREE
    d = np.sqrt(ann.squares(q[:60], c))
    for ratio, least in ((1.0, 1), (1.05, 5), (1.3, 1), (3.0, 1), (1.0, 40)):
        r, j, far = ann.graph_search(index, q[:60], ratio, least)
        assert len(set(zip(r.tolist(), j.tolist()))) == len(r) and np.allclose(far, d[r, j])
        want = {(a, b) for a in range(60) for b in range(700) if d[a, b] <= ratio * d[a].min() or b in np.argsort(d[a])[:least]}
        assert len(want & set(zip(r.tolist(), j.tolist()))) >= 0.95 * len(want)
        assert (np.bincount(r, minlength=60) >= least).all()
        for a in (0, 31):
            one = ann.graph_search(index, q[a : a + 1], ratio, least)
            assert one[1].tolist() == j[r == a].tolist()
    # a query on a centroid has that list alone, whatever the ratio
    r, j, far = ann.graph_search(index, q[60:], 1.5, 1)
    assert (far[np.r_[0, np.flatnonzero(np.diff(r)) + 1]] < 1e-6).all()
    r, j, far = ann.graph_search(index, q[:0], 1.5, 1)
    assert len(r) == len(j) == len(far) == 0
    one = ann.Index(c[:1], ann.neighbour_graph(c[:1]), 1.0, 1.0, 23)
    assert [x.tolist() for x in ann.graph_search(one, q[:2], 1.5, 3)[:2]] == [[0, 1], [0, 0]]
