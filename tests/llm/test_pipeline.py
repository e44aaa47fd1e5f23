"""The pipeline's stages against plain versions, each on its own input; registered queries against SQL and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import bpe, omh, quality
from chronoweave.llm import queries as Q

from ..oracle import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    words = "the tree runs over hill and river while clouds move slowly past old stone walls near quiet fields".split()
    line = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(300)) for _ in range(n)) + "."
    shared = [line(20) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [line(24) for _ in range(4)]
        if i % 6 == 0:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(100 + i, "BUY!! NOW!! " * 40, "en", "s0") for i in range(30)]
    # one word of the second line differs, so no run of 50 words is repeated
    rows += [(200 + i, re.sub(r"(\n(?:\S+ ){10})\S+", r"\1edited", rows[i][1], count=1), "en", "s1") for i in range(1, 6)]
    rows += [(300, rows[7][1], "en", None), (301, None, None, None), (302, "", "en", "s2"), (None, line(30), "en", "s2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 100)) for i in [*range(60), *range(100, 130)]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    kept.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        kept.append(docs)
    return at, [[r.asDict() for r in d.collect()] for d in kept], kept


def test_columns(run):
    _, _, frames = run
    for df in frames[:-1]:
        assert df.columns == frames[0].columns


def test_quality_stage(spark, run):
    at, (docs, good, *_), frames = run
    model = quality.train(frames[0], spark.read.parquet(f"{at}/labels.parquet"))
    want = [r for r in docs if model.score(np.stack([quality.features(r["text"])]))[0] >= 0.7]
    assert sorted(map(repr, good)) == sorted(map(repr, want))
    assert {r["doc_id"] for r in good} >= set(range(60)) and not {r["doc_id"] for r in good} & set(range(100, 130))


def test_line_stage(run):
    _, (_, good, lined, *_), _ = run
    order = sorted(good, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    first, want = {}, []
    for r in order:
        rows = (r["text"] or "").split("\n")
        for a in range(len(rows)):
            for z in range(a + 1, len(rows) + 1):
                first.setdefault(tuple(rows[a:z]), (r["doc_id"], a))
    for r in order:
        rows, gone = (r["text"] or "").split("\n"), set()
        for a in range(len(rows)):
            for z in range(a + 1, len(rows) + 1):
                if sum(len(x.split()) for x in rows[a:z]) >= 50 and first[tuple(rows[a:z])] != (r["doc_id"], a):
                    gone |= set(range(a, z))
        text = "\n".join(x for k, x in enumerate(rows) if k not in gone) if gone else r["text"]
        if not gone or text.strip():
            want.append((r["doc_id"], text))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in lined)
    assert len(lined) < len(good)


def test_near_copy_stage(run):
    _, (_, _, lined, one, *_), _ = run
    kept = []
    for r in sorted((r for r in lined if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        s = omh.shingles((r["text"] or "").split())
        if not len(s) or not any(len(o) and omh.similarity(s, o) for _, o in kept):
            kept.append((r["doc_id"], s))
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == [i for i, _ in kept]
    assert sum(r["doc_id"] is None for r in one) == sum(r["doc_id"] is None for r in lined)
    assert not {r["doc_id"] for r in one} & {201, 202, 203, 204, 205}


def test_mixing_stage(run):
    _, (_, _, _, one, mixed, _), _ = run
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = {(r["doc_id"], r["source"]): r["text"] for r in one}
    taken = {}
    for r in mixed:
        whole = texts[r["doc_id"], r["source"]]
        assert r["text"] == whole or r["text"] in whole
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + size(r["text"])
    assert all(n <= 2 * size(texts[k]) for k, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size(t) for t in texts.values())) <= 16 * 4


def test_bpe_stage_and_run(spark, run):
    at, (*_, mixed, ids), _ = run
    path, pattern = bpe.public_rank_file()
    enc = bpe.codec(bpe.load_ranks(path), pattern)
    want = sorted(repr((r["doc_id"], enc.encode_ordinary(r["text"] or ""))) for r in mixed)
    assert sorted(repr((r["doc_id"], list(r["ids"]))) for r in ids) == want
    again = corpus_pipeline.run(spark, str(at)).select("doc_id", "ids_sha256").collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(repr((r["doc_id"], r["ids_sha256"])) for r in ids)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not differences(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def test_op3_equals_tiktoken(spark):
    path, pattern = bpe.public_rank_file()
    enc = bpe.codec(bpe.load_ranks(path), pattern)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op3_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op5_finds_nine_tenths_of_the_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in Q.op5_neighbours(spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        share.append(len(found[ids[k]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(share) >= 0.9


def test_empty_documents(spark, run, tmp_path):
    at, _, frames = run
    frames[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op2_token_rollup", "op3_bpe", "op6_pii", "op9_quality"):
        assert Q.queries()[name](spark, str(tmp_path)).count() == 0
    assert frames[0].where(F.col("doc_id").isNull()).count() == 1
