import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from origintrace.llm import language_model, mixing, packing, quality_crf, sampling, simhash, token_shards, toxicity
from origintrace.llm.columns import fresh
from origintrace.llm.components import components
from origintrace.llm.tokens import default_tokenizer, encoder

TOKENIZER = default_tokenizer()


def plain_ids(texts, end):
    lists = encoder(TOKENIZER).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*x.ids, end], dtype="<u4") for x in lists]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


# --- tokens, shards and index ---------------------------------------------------------------------
def test_encoder_equals_the_library(odd_rows, documents):
    texts = [r[1] for r in odd_rows] + [r.text for r in documents.collect()]
    got = encoder(TOKENIZER).encode_many(texts)
    for t, ids, want in zip(texts, got, plain_ids(texts, 0)):
        assert np.array_equal(np.frombuffer(ids, dtype="<u2"), want[:-1]), t


def test_encoder_with_another_tokenizer_file(odd_rows):
    import public_tokenizers

    assert encoder(TOKENIZER).wordwise
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), [r[1] for r in odd_rows]
    other = encoder(path)
    assert not other.wordwise
    for t, ids in zip(texts, other.encode_many(texts)):
        want = other.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=other.dtype).tolist() == want


def test_perfect_hash_is_perfect():
    for n in (1, 2, 5, 1000, 4096):
        keys = [f"k{i}" for i in range(n)]
        _, slot, _ = token_shards.build_perfect_hash(keys)
        assert sorted(slot) == list(range(n))
        part = token_shards.IndexPart(token_shards.build_part(keys, np.arange(n), np.arange(n) + 1, np.ones(n)))
        found = part.find(keys)
        assert found["shard"].tolist() == list(range(n)) and (found["copies"] == 1).all()
    assert (part.find([f"other{i}" for i in range(1000)])["copies"] > 0).sum() <= 1


def test_shards_round_trip(spark, odd, odd_rows, documents):
    for df in (odd, documents):
        written = token_shards.write(df, TOKENIZER)
        rows = token_shards.read(df, written).collect()
        assert len(rows) == df.count() == written.documents
        want = Counter()
        order = sorted((r for r in df.select("doc_id", "text").collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        for r, ids in zip(order, plain_ids([r.text for r in order], 2)):
            want[(r.doc_id, len(ids), crc(ids))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [r.doc_id for r in order]
        assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    assert token_shards.read(spark.createDataFrame([(10**12,)], "doc_id long"), written).collect() == []


def test_shards_of_an_empty_table(none):
    assert token_shards.read(none, token_shards.write(none, TOKENIZER)).collect() == []


# --- packing -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack(packing.pieces_of(df, TOKENIZER)).collect()
    texts = df.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(texts, plain_ids([r.text for r in texts], 1)):
        for k, i in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, i, len(ids[i : i + 4096]), crc(ids[i : i + 4096]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) <= 4096
    room, place, sizes = [], np.empty(len(rows), dtype=int), np.array([r.length for r in rows])
    packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), place, room, 4096)
    assert len(by_sequence) <= len(room) + 1


def test_packing_in_several_blocks(documents, monkeypatch):
    """With small blocks, what they leave badly filled is packed once more, so few sequences are lost to the cutting."""
    monkeypatch.setattr(packing, "BLOCK", 40)
    pieces = packing.pieces_of(documents, TOKENIZER)
    rows = packing.pack(pieces).collect()
    assert Counter((r.doc_id, r.piece) for r in rows) == Counter((r.doc_id, r.piece) for r in pieces.collect())
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096
    sizes = np.array([r.length for r in rows])
    room, place = [], np.empty(len(rows), dtype=int)
    packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), place, room, 4096)
    assert len(filled) <= 1.05 * len(room) + 1


def test_packing_an_empty_table(none):
    assert packing.pack(packing.pieces_of(none, TOKENIZER)).collect() == []


def test_children_are_packings():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 4096, 400)
    first, second = packing.evolve(sizes, [], 4096, (1,))[:2]
    child = packing.cross(sizes, first, second, 4096, rng)
    assert child.min() >= 0 and np.bincount(child, sizes).max() <= 4096


# --- near duplicates --------------------------------------------------------------------------------------
def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_simhash_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = simhash.near_duplicates(df).withColumn("hex", simhash.hex_digits("fp")).collect()
    assert len(rows) == df.count()
    want = Counter((r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in df.collect())
    assert Counter((r.id, r.hex) for r in rows) == want
    codes = sorted({r.fp for r in rows})
    label = {c: c for c in codes}
    for _ in codes:
        new = {a: min(label[b] for b in codes if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3) for a in codes}
        if new == label:
            break
        label = new
    least = {}
    for r in rows:
        if r.id is not None:
            least[label[r.fp]] = min(r.id, least.get(label[r.fp], r.id))
    assert all(r.component_id == least.get(label[r.fp]) for r in rows)


def test_keep_one_leaves_one_of_each_component(odd, documents):
    for df in (odd, documents):
        found = simhash.near_duplicates(df).select("component_id", "kept_fp").distinct().count()
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == found
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(30)]))
    search, member = simhash.GrayIndex(codes).within(codes, 3)
    want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes) <= 3)
    assert sorted(zip(search.tolist(), member.tolist())) == sorted(map(tuple, want.tolist()))


def test_a_key_is_cut_into_cells_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 20)
    codes = spark.range(300).select(F.col("id").alias("fp"))
    found = {r.node: r.root for r in components(simhash.near_edges(codes, 1, 3)).collect()}
    assert set(found) == set(range(1, 300)) and set(found.values()) == {0}


def test_simhash_of_an_empty_table(none):
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


# --- mixing ---------------------------------------------------------------------------------------------------
def test_mixing_keeps_to_its_budgets(documents):
    target = mixing.Target(repeats=2.0)
    rows = mixing.mix(documents, target).withColumn("tokens", mixing.token_count("text")).collect()
    size, copies = Counter(), Counter(r.doc_id for r in rows)
    cost = {r.doc_id: (r.source, max(1, len((r.text or "").encode().split()))) for r in documents.collect()}
    for source, n in cost.values():
        size[source] += n
    total = sum(size.values())
    a = 1 - np.log(2) / np.log(max(size.values()) / min(size.values()))
    lift = {s: (n / total) ** (a - 1) for s, n in size.items()}
    given = Counter()
    for r in rows:
        given[r.source] += cost[r.doc_id][1]
    for s in size:
        budget = size[s] * lift[s] / min(lift.values())
        longest = max(n for source, n in cost.values() if source == s)
        assert budget - longest - 1 <= given[s] <= budget + 1
    assert set(copies) == set(cost) and max(copies.values()) <= 2
    assert sorted(r.mix_epoch for r in rows if r.doc_id == rows[0].doc_id) == list(range(copies[rows[0].doc_id]))


def test_mixing_meets_an_entropy_and_runs_no_python(documents):
    costs = documents.groupBy(mixing.source_key("source").alias("key")).agg(F.sum(mixing.token_count("text")).alias("tokens"))
    share = np.array([r.tokens for r in costs.collect()], dtype=float)
    share /= share.sum()
    aim = (np.log(len(share)) - (share * np.log(share)).sum()) / 2
    a = mixing.exponent(costs, mixing.Target(entropy=aim))
    q = share**a / (share**a).sum()
    assert -(q * np.log(q)).sum() == pytest.approx(aim, abs=1e-6)
    plan = mixing.mix(documents, mixing.Target(entropy=aim))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixing_odd_documents(odd, none):
    rows = mixing.mix(odd, mixing.Target(repeats=3.0), epoch="pass").collect()
    assert {r["a b"] for r in rows} == {r["a b"] for r in odd.collect()}
    assert mixing.mix(none, mixing.Target(repeats=2.0), epoch="pass").collect() == []
    assert fresh(odd, "fp") == "fp_"


# --- classifiers ------------------------------------------------------------------------------------------------
def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_documents(spark, documents):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_crf.fit(big, labels)
    rows = big.join(labels, "doc_id").select("doc_id", "quality", model.score("text").alias("s")).collect()
    test = [r for r in rows if held_out(r.doc_id)]
    assert np.mean([(r.s >= quality_crf.THRESHOLD) == (r.quality == 1) for r in test]) > 0.95


def test_a_sample_of_very_many_labels_is_not_empty(spark):
    many = spark.range(2_200_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("toxic"))
    assert 1 <= sampling.labelled_sample(many, many, "toxic", 1, 1).count() <= 20


def test_marginals_equal_enumeration():
    from itertools import product

    features = [quality_crf.line_features("a b\nC!! D!!\nx | y")[0], quality_crf.line_features("one")[0]]
    chains = quality_crf.Chains(features)
    rng = np.random.default_rng(4)
    scores, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    good, _, log_z = chains.marginals(scores, trans)
    weight = {y: np.exp(sum(s for s, v in zip(scores, y) if v) + trans[y[0], y[1]] + trans[y[1], y[2]]) for y in product((0, 1), repeat=3)}
    total = sum(weight.values())
    assert log_z[0] == pytest.approx(np.log(total))
    for t in range(3):
        assert good[t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)
    assert good[3] == pytest.approx(1 / (1 + np.exp(-scores[3])))


def test_toxicity_on_held_out_documents(spark):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(big, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = big.join(labels, "doc_id").select("doc_id", "toxic", model.severity("text").alias("s")).collect()
    test = [r for r in rows if held_out(r.doc_id)]
    found = [r.s >= toxicity.THRESHOLD for r in test]
    assert sum(f and r.toxic == 0 for f, r in zip(found, test)) <= 2
    assert np.mean([f for f, r in zip(found, test) if r.toxic == 1]) > 0.85


@pytest.mark.parametrize("which", ["labels", "no_labels"])
def test_classifiers_on_odd_documents(request, odd, none, which):
    labels = request.getfixturevalue(which)
    for table in (odd, none):
        quality, severity = quality_crf.fit(table, labels), toxicity.fit(table, labels)
        rows = table.select(quality.score("text").alias("q"), severity.severity("text").alias("t")).collect()
        assert len(rows) == table.count()
        assert all(0 <= r.q <= 1 and 0 <= r.t <= toxicity.GRADES for r in rows)


# --- language model ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_language_model(request, which):
    df = request.getfixturevalue(which)
    rows = language_model.score_corpus(df).collect()
    texts = df.select("doc_id", "text").collect()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in texts if not out(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
    want = sorted((str(r.doc_id), out(r.doc_id), len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(base(r.text), 6)) for r in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)
    if which == "documents":
        test = [r for r in rows if r.held_out]
        assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_language_model_is_a_distribution():
    words = [f"w{i}".encode() for i in range(3000)]
    counts = np.arange(3000, 0, -1)
    tokens, kinds = np.zeros(language_model.TAIL), np.zeros(language_model.TAIL)
    for w, n in zip(words, counts):
        tokens[language_model.tail_class(w)] += n
        kinds[language_model.tail_class(w)] += 1
    weights = language_model.Vocabulary(words, counts, int(counts.sum()), 3000, tokens, kinds).first_weights()
    trainer = language_model.Trainer(weights)
    rng = np.random.default_rng(0)
    trainer.update(language_model.Batch([rng.integers(0, language_model.SYMBOLS, 500).astype(np.uint16)]))
    every = [np.array([7, 3, s], dtype=np.uint16) for s in range(language_model.SYMBOLS)]
    b = language_model.Batch(every)
    assert np.exp(b.log_probabilities(trainer.w)[2::3]).sum() == pytest.approx(1, abs=1e-4)
