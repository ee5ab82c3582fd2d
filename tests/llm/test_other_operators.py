"""Embeddings, archives, the registered SQL and the pipeline."""

import glob
import os
import random
import shutil
import zlib

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import near_dup, queries, secrets, vectors, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_against_sql(spark, name):
    problems, _ = compare(spark, SF, queries.PLANS[name], queries.CHECKS[name])
    assert not problems


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    rows = [c + rng.normal(size=32) * s for c in centres for s in (0.02, 0.1, 0.2, 0.3, 0.4) for _ in range(12)]
    rows += [rows[0]] * 5 + [rows[3] * 7.5]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None] + [0.0] * 30, [float("inf")] + [0.0] * 31, [1.0, 2.0]]
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)] + [(1000 + i, v, 2) for i, v in enumerate(odd)] + [(0, [float(x) for x in rows[0]], 3), (None, [1.0] * 32, 4)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, list int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame, block=64).collect()}
    u = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert len(got) == len(rows) + len(odd)
    assert sum(got[i]["n_links"] for i in range(len(rows))) >= 0.99 * (near.sum() - len(rows))
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(len(rows)))
    for i in range(len(rows)):
        assert near[i][got[i]["component_id"]] or got[i]["component_id"] < i or got[i]["kept"]
    assert all((got[1000 + i]["n_links"], got[1000 + i]["kept"]) == (0, True) for i in range(len(odd)))
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    assert vectors.near_vectors(frame.filter("vec_id = 1000")).count() == 1


def test_low_rank_vectors_lose_no_link(spark):
    """Vectors near a subspace crowd the borders of the lists; every link is found, over many blocks and copies."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(900, 3)) @ rng.normal(size=(3, 32)) + 0.05 * rng.normal(size=(900, 32))
    rows[800:] = rows[:100]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame.repartition(4), block=64).collect()}
    single = rows.astype(np.float32).astype(np.float64)
    u = single / np.linalg.norm(single, axis=1, keepdims=True)
    cosines = u @ u.T
    assert np.abs(cosines - 0.9).min() > 1e-12
    assert [got[i]["n_links"] for i in range(900)] == ((cosines >= 0.9).sum(1) - 1).tolist()


def test_decoded_lists_bound_the_cosines():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)) + 2 * rng.normal(size=(6, 24))[np.arange(600) % 6]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = vectors.Quantiser(x, lists=6, subspaces=5, codes=16)
    own = q.distances(x).argmin(1)
    codes, miss = q.encode(x, own)
    for k in range(6):
        there = own == k
        rough = x.astype(np.float32) @ q.decoded(k, codes[there]).astype(np.float32).T
        assert (x @ x[there].T <= rough + miss[there] + vectors.rounding(24)).all()
        assert np.allclose(np.linalg.norm(x[there] - q.decoded(k, codes[there]), axis=1), miss[there])


def pages_of(spark, n=40):
    body = lambda i: None if i == 3 else "" if i == 4 else "same" if i % 10 == 5 else f"<p>{i}</p>" * (i + 1) * 50
    return spark.createDataFrame([(i, f"http://h/{i} é\r\nX: y", body(i), "z") for i in range(n)], "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark, tmp_path):
    pages = pages_of(spark)
    folder = str(tmp_path / "a")
    manifest = warc.write_archives(pages.coalesce(1), file_bytes=4000, folder=folder)
    records, gaps = warc.read_archives(manifest, range_bytes=700)
    got = {int(r["record_id"]): r for r in records.collect()}
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert set(got) == set(want) and gaps.count() == 0 and manifest.count() > 1
    for i, payload in want.items():
        owner = max(j for j, p in want.items() if p == payload)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if owner == i else ("revisit", str(owner)))
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == warc.sha1_base32(payload)
        assert owner != i or bytes(got[i]["payload"]) == payload
    assert warc.list_archives(spark, folder).count() == manifest.count()
    alone = warc.read_archives(warc.write_archives(pages, min_revisit=10))[0].filter("record_type = 'revisit'").count()
    assert alone == 0  # the equal payloads are shorter
    records, gaps = warc.read_archives(warc.write_archives(pages.limit(0)))
    assert records.count() == gaps.count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(spark, tmp_path, compress):
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(256) for _ in range(300)) + b"\nWARC/1.0\r\n" for _ in range(30)]
    parts = [warc.record(str(i), "http://h/", p, None, compress) for i, p in enumerate(payloads)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    data = bytearray(b"".join(parts))
    data[at[4] + 200] ^= 255  # inside a member or payload
    data[at[9] : at[9] + 3] = b"???"  # a lost magic or version line
    cut_short = bytes(data[: at[-1] - 40]) if compress else bytes(data)
    path = str(tmp_path / ("x.warc.gz" if compress else "x.warc"))
    with open(path, "wb") as f:
        f.write(cut_short)
    manifest = spark.createDataFrame([(path, len(cut_short))], "path string, bytes long")
    for step in (150, 1 << 20):
        records, gaps = warc.read_archives(manifest, range_bytes=step)
        got = {int(r["record_id"]): bytes(r["payload"]) for r in records.collect()}
        lost = {4, 9, 29} if compress else {4, 9}
        assert got == {i: p for i, p in enumerate(payloads) if i not in lost}
        spans = sorted((r["offset"], r["end"]) for r in gaps.collect())
        assert spans == [(at[i], min(at[i + 1], len(cut_short))) for i in sorted(lost)]
        assert all(r["reason"] for r in gaps.collect())


def read_bytes(spark, path, data, step=1 << 20):
    path.write_bytes(data)
    records, gaps = warc.read_archives(spark.createDataFrame([(str(path), len(data))], "path string, bytes long"), range_bytes=step)
    return sorted(int(r["record_id"]) for r in records.collect()), sorted((r["offset"], r["end"]) for r in gaps.collect())


def test_salvage_whatever_stands_before_a_record(spark, tmp_path):
    plain, packed = ([warc.record(str(i), "http://h/", f"payload {i} ".encode() * 30, None, c) for i in range(6)] for c in (False, True))
    short = plain[2][:-200]
    for k, noise in enumerate((b"", bytes(50), b"noise")):
        data = b"".join([*plain[:2], short, noise, *plain[3:]])
        start = len(plain[0] + plain[1])
        assert read_bytes(spark, tmp_path / f"{k}.warc", data) == ([0, 1, 3, 4, 5], [(start, start + len(short + noise))])
    for parts, name in ((packed, "a.warc"), (plain, "b.warc.gz"), (plain, "c")):
        data = b"???" + b"".join(parts)[3:]
        for step in (300, 1 << 20):
            assert read_bytes(spark, tmp_path / name, data, step) == ([1, 2, 3, 4, 5], [(0, len(parts[0]))])
    bad = plain[3].replace(b"payload 3", b"payload X", 1)
    member = lambda raw: (lambda z: z.compress(raw) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    data = packed[0] + member(plain[1] + plain[2]) + member(bad + plain[4]) + packed[5]
    at = [len(packed[0] + member(plain[1] + plain[2])), len(data) - len(packed[5])]
    assert read_bytes(spark, tmp_path / "d.warc.gz", data, 300) == ([0, 1, 2, 4, 5], [tuple(at)])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with odd rows added to documents."""
    folder = tmp_path_factory.mktemp("tables")
    for path in glob.glob(f"{SF}/*.parquet"):
        if "documents" not in path:
            os.symlink(path, folder / os.path.basename(path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "again and again", None, None, 1), (90003, "again and again", None, None, 1), (None, "no id", "en", "s", 2)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(folder / "documents.parquet"))
    yield str(folder)
    shutil.rmtree(folder)


def test_pipeline_stages(spark, tables):
    from test_text_operators import classes, shingles

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.cut(stage(spark, before, tables))
        if k < 4:
            assert after.columns == columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        source = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "quality_classifier":
            assert all(i in ids for i, q in quality.items() if q == 1) and sum(i in ids for i, q in quality.items() if q == 0) <= 2
        elif name == "near_duplicates":
            roots = classes({i: shingles(t, 5) for i, t in source.items() if i is not None}, 80)
            assert sorted(i for i in ids if i is not None) == sorted(set(roots.values())) and ids.count(None) == 1
        elif name == "secret_scans":
            assert sorted(map(str, ids)) == sorted(map(str, source))
            assert secrets.find_secrets(after).filter(F.size("matches") > 0).count() == 0
        elif name == "mixing":
            assert set(ids) <= set(source) and len(ids) == len(set(ids)) > len(source) // 2
        else:
            assert set(ids) == set(source)
        before = after
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_pipeline_keeps_the_judged_row_of_a_repeated_id(spark):
    copied, long = (" ".join(f"{word}{k}" for k in range(n)) for word, n in (("copied", 30), ("only", 60)))
    texts = [None, "", copied, long, None, copied]
    rows = [(1, copied, "first")] + [(i, t, str(k)) for i, order in ((2, texts), (3, [*texts[::-1], "x " + long])) for k, t in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    left = corpus_pipeline.near_dup_stage(spark, docs.filter("doc_id < 3"), "").unionByName(near_dup.standing(docs.filter("doc_id = 3")))
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in left.collect()) == [(1, copied, "first"), (2, long, "3"), (3, "x " + long, "6")]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
