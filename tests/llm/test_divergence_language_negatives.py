"""Source divergence, language identification and hard negatives against plain computations, and their defined cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import divergence, hard_negatives, language_id, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, total long, place int, key int, df int, counts int"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 1, 1, 1, 1, 1, 1) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


# ---- pointer sort ----


def test_runs_are_sorted_and_stable():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(300)]
    words = [vocabulary[int(rng.paretovariate(0.6)) % 300] for _ in range(100_000)]
    text = " ".join(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    start, length, doc = divergence.word_pointers(raw, np.array([0, len(raw)]))
    order, begins = divergence.sorted_runs(np.concatenate([raw, np.zeros(16, np.uint8)]), start, length)
    got = [words[i] for i in order]
    assert got == sorted(words, key=lambda w: w.encode())
    ends = np.append(begins[1:], len(order))
    assert [got[b] for b in begins] == sorted(set(words), key=lambda w: w.encode())
    assert all((np.diff(order[a:b]) > 0).all() for a, b in zip(begins, ends, strict=True))


def test_shard_rows_of_a_sliced_buffer():
    texts = pa.array(["skipped words", "One two ONE", "", "two;three", "twelve"]).slice(1)
    got = [r for b in divergence.shard_rows(texts, ["a", "a", "a", "b"], ["s", "s", "t", ""]) for r in b.to_pylist()]
    assert {(r["lang"], r["term"]): (r["df"], {c["source"]: c["n"] for c in r["counts"]}) for r in got} == {
        ("a", "one"): (1, {"s": 2}),
        ("a", "two"): (2, {"s": 1, "t": 1}),
        ("a", "three"): (1, {"t": 1}),
        ("b", "twelve"): (1, {"": 1}),
    }


# ---- divergence ----


def plain_audit(rows, min_docs, top):
    docs = [(terms_of(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = collections.Counter(w for d in own for w in set(d[0]))
        kept = sorted((w for w, n in df.items() if n >= min_docs), key=lambda w: w.encode())
        count = collections.defaultdict(collections.Counter)
        for words, _, source in own:
            count[source].update(w for w in words if w in set(kept))
        everywhere = sum(count.values(), collections.Counter())

        def p(c):
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}

        sources, q = {d[2] for d in own}, p(everywhere)
        for s in sources:
            mine = p(count[s])
            pair = [(o, sum(abs(mine[w] - x) for w, x in p(count[o]).items())) for o in sources if o != s]
            term = [(w, mine[w] - q[w]) for w in kept if count[s][w] and mine[w] > q[w]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def rows_of_words(n=120):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "Ünter", "élan", "delta", "epsilonepsilonepsilon", "zz", "ZZ", "İstanbul"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(12))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "a"), ("", "xx", "s"), ("only here", "xx", "t"), ("12 34", "yy", None), ("alpha " * 3000, "en", "a")] + rows[:5]


@pytest.mark.parametrize("shard_bytes,block", [(1, 1), (300, 3), (1 << 25, 256)])
def test_audit_against_plain_code(spark, monkeypatch, shard_bytes, block):
    if block == 3:
        monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)  # several blocks of sources
    rows = rows_of_words()
    got = divergence.audit(frame(spark, rows).repartition(3), min_docs=10, top=2, block_terms=block, shard_bytes=shard_bytes)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 10, 2)
    assert got.schema["value"].dataType.simpleString() == "bigint" and got.schema["rank"].dataType.simpleString() == "int"


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0
    got = divergence.audit(frame(spark, [("a", "b", "c"), ("d", "b", "e")])).collect()
    assert sorted(tuple(r) for r in got) == [("b", "c", "pair", "e", 0, 1), ("b", "e", "pair", "c", 0, 1)]


def test_probability_of_large_counts(spark):
    n, total, terms = 9_000_000_000_000, 70_000_000_000_000, 1_000_000
    got = spark.range(1).select(divergence.probability(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


# ---- languages ----


def plain_margin(text, model):
    words, sums, n = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()], 0.0, 0
    for w in words:
        padded = f" {w} "
        for order in language_id.ORDERS:
            for i in range(len(padded) - order + 1):
                gram = padded[i : i + order]
                if gram.strip():
                    sums = sums + model.weights[plain_bucket(gram)].astype(float)
                    n += 1
    return sums / max(n, 1) + model.bias


def plain_bucket(gram):
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return h >> (32 - language_id.BITS)


def test_margins_against_plain_code(monkeypatch):
    rng = np.random.default_rng(0)
    model = language_id.Identifier(["a", "b", "c"], language_id.codewords(3), rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32), rng.normal(size=3), np.ones(3) / 3)
    texts = ["a", "Déjà vu, ça va?", "x" * 50, "12 a4b ..", "日本語 テスト", "İi ß", "one two three " * 40, "", "...", "z"]
    for piece in (1 << 17, 64, 5):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = language_id.margins(texts, model.weights, model.bias)
        assert np.allclose(got, [plain_margin(t, model) for t in texts], atol=1e-4)
        bucket, share = language_id.buckets(texts[1])
        assert np.allclose(share @ model.weights[bucket] + model.bias, got[1], atol=1e-4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 12, 40])
def test_codewords_correct_errors(n):
    code = language_id.codewords(n)
    gaps = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert len(code) == n and (not gaps or min(gaps) >= max(1, code.shape[1] // 4))
    assert all(0 < (column > 0).sum() < n or n == 1 for column in code.T)
    # with a third of the least distance in wrong bits, decoding still finds the word
    if n >= 4:
        model = language_id.Identifier([str(i) for i in range(n)], code, None, None, np.full(code.shape[1], 1 / code.shape[1]))
        wrong = (min(gaps) - 1) // 2
        values = code * 2.0
        values[:, :wrong] *= -1
        assert model.decode(values, 0.0)[0].tolist() == list(range(n))


def test_decoding_weighs_bits_and_flags_ties():
    model = language_id.Identifier(["a", "b", "c"], language_id.codewords(3), None, None, np.array([0.6, 0.2, 0.2]))
    values = np.array([[3.0, -1.0, -1.0], [0.0, 0.0, 0.0]])
    losses = model.losses(values)
    plain = [[sum(t * np.log1p(np.exp(-m * v)) for t, m, v in zip(model.trust, word, row, strict=True)) for word in model.code] for row in values]
    assert np.allclose(losses, plain)
    best, score, unsure = model.decode(values, 0.05)
    assert best[1] == 0 and unsure.tolist()[1] and abs(score[1] - 1 / 3) < 1e-9


def test_language_cases(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "tion", "er"], "de": ["der", "ung", "sch", "ä"], "": ["xo", "qua", "zi"]}
    rows = [("".join(rng.choices(syllables[k], k=3)) + " " + " ".join("".join(rng.choices(syllables[k], k=2)) for _ in range(20)), k, "s") for k in syllables for _ in range(60)]
    model = language_id.learn(frame(spark, [*rows, ("the thing", None, "s"), (None, "de", "s"), ("123", "fr", "s")]))
    assert model.languages == ["", "de", "en"]
    again = language_id.learn(frame(spark, rows[::-1]).repartition(5))
    assert np.allclose(again.weights, model.weights, atol=1e-3)
    odd = [(None, "en", "s"), ("", "en", "s"), ("12 ...", "de", "s"), ("the erring tion thetion", None, None), ("der undung schä " * 20_000, "x", "s"), ("the erring tion thetion", None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, odd), model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and got[0]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = language_id.learn(frame(spark, rows[:60]))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(frame(spark, rows), one).collect()} == {("en", 1.0)}
    nothing = language_id.learn(frame(spark, rows).limit(0))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, rows), nothing).collect()} == {"und"}
    assert language_id.identify(frame(spark, rows).limit(0), model).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.PLANS["op12_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.98 * got.count()


# ---- hard negatives ----


def test_scores_are_exact():
    rng = np.random.default_rng(2)
    for dim, top in ((1, 3), (64, 300), (64, 1 << 24), (700, 1 << 20), (1000, 2)):
        a, b = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (11, dim))
        b[0] = a[0] if len(a[0]) == dim else b[0]
        b[1] = -a[0]
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert hard_negatives.scores(a, b).tolist() == want
    assert hard_negatives.scores(np.zeros((2, 3), np.int64), np.zeros((1, 3), np.int64)).tolist() == [[0], [0]]


def plain_mine(rows, anchor, positives=5, negatives=5):
    known = {}
    for i, label, vector in rows:
        if None in (i, label, vector) or not vector or not all(x is not None and np.isfinite(x) for x in vector):
            continue
        c = [int(np.floor(256.0 * x)) for x in vector]
        if sum(x * x for x in c) < hard_negatives.LONGEST:
            packed = np.array(c, np.int32).tobytes()
            known[i] = min(known.get(i, (label, packed, c)), (label, packed, c))
    out = []
    for a, (label, _, v) in known.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, (own, _, w) in known.items() if i != a and len(w) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:negatives]
            out += [(a, p, k + 1, n, -minus, -s) for k, (s, n, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("row_block,anchor_block", [(16, 3), (8192, 1024)])
def test_mining_against_plain_code(spark, row_block, anchor_block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(150)]
    rows += [(150 + i, i % 4, rows[10][2]) for i in range(30)]  # equal vectors
    rows += [(10, 0, rows[10][2]), (10, 0, rows[11][2]), (None, 1, [1.0] * 8), (500, None, [1.0] * 8), (510, 1, None), (520, 1, []), (530, 1, [1.0, None] + [0.0] * 6)]
    rows += [(540, 1, [float("nan")] * 8), (550, 1, [float("-inf")] * 8), (560, 1, [1e300] * 8), (570, 2, [0.0] * 8), (580, 2, [1.0, 1.0]), (590, 3, [1.0, 1.0]), (600, 2, [2.0, 2.0]), (-10, 1, rows[1][2])]
    data = [(i, label, v, 1, 1, 1.0, "x") for i, label, v in rows]
    table = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>, id int, score int, v double, anchor_id string")
    got = hard_negatives.mine(table.repartition(4), F.col("id") % 10 == 0, row_block=row_block, anchor_block=anchor_block)
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(table.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(table, F.col("id") == 7777).count() == 0


def test_long_vectors_are_mined_exactly(spark):
    """Scores up to 64 bits; longer ones are none, without taking their rows out."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-5, 200_000, 6) * 10.0 ** rng.integers(-1, 2, 6)]) for i in range(60)]
    rows += [(60 + i, i % 2, [float(10**k), 0.0, 0.0, -1.0, float(-(10**k)), 3.5]) for i, k in enumerate((6, 9, 12, 15, 20, 200))]
    rows += [(70 + i, i % 2, [0.0, 1.5, 0.0, 2.0, 0.0, float(i)]) for i in range(10)] + [(80 + i, i % 2, []) for i in range(8)]
    whole = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows}
    want = []
    for a in range(0, 90, 10):
        if a in whole:
            found = [(-sum(x * y for x, y in zip(whole[a][1], w, strict=True)), i, label) for i, (label, w) in whole.items() if i != a and len(w) == len(whole[a][1])]
            found = sorted(x for x in found if -(1 << 63) <= -x[0] < 1 << 63)
            for s, p, _ in [x for x in found if x[2] == whole[a][0]][:5]:
                window = [x for x in found if x[2] != whole[a][0] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                want += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(window)]
    assert max(abs(r[4]) for r in want) > 1 << 57 and any(r[0] >= 80 for r in want)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(table.repartition(3), F.col("id") % 10 == 0, row_block=20, anchor_block=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_all_blocks_meet_in_whatever_tasks_they_are(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = hard_negatives.mine(table, F.col("id") % 10 == 0, row_block=20, anchor_block=3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == plain_mine(rows, lambda i: i % 10 == 0)
