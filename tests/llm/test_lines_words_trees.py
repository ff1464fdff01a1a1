import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from origintrace.llm import line_dedup, merkle, queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- line dedup ----------------------------------------------------------------------------------------
def place(i):
    """Null ids come after all others."""
    return (i is None, i or 0)


def plain_lines(rows, least=10):
    """(id, kept text, lines, dropped) of every row, by the definition."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == place(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINED = [
    (5, "Shared line one\nown line of five\n\nshort\nSHARED LINE ONE"), (3, " shared line one\t\nshort\nown line of three"),
    (9, "shared line one"), (9, "shared line one"), (9, "only nine has it\nonly nine has it"), (None, "own line of five\nof no id at all"),
    (None, "of no id at all"), (7, None), (8, ""), (10, "\n\n"), (11, "ÄÖÜ ähnlich ja"), (12, "äÖÜ ähnlich ja\n ÄÖÜ ähnlich ja "),
    (13, "日本語日本語日本語日\nx"), (14, "日本語日本語日本語日"), (15, "日本語日本語日本語"), (16, "日本語日本語日本語"), (17, "\xa0shared line one"),
    (18, "\n".join(f"line number {i}" for i in range(5000))), (2, "line number 4999\r\nline number 0"),
]


@pytest.mark.parametrize("which", ["lined", "odd", "documents", "hot"])
def test_lines_equal_brute_force(spark, request, which, monkeypatch):
    if which == "lined":
        df = spark.createDataFrame([(*r, "x", 1) for r in LINED], "doc_id long, text string, KEY string, n_lines int")
    elif which == "hot":  # one line in every document, and one document in a third of all rows
        monkeypatch.setattr(line_dedup, "HEAVY", 8)
        rows = [(i % 300 if i % 3 else 7, f"the line that all have\nsome other line {i % 40}\nline {i} alone") for i in range(900)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns[: len(df.columns)] == df.columns and len(got.columns) == len(df.columns) + 2
    names = got.columns[-2:]
    want = plain_lines([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert Counter(map(tuple, got.select("doc_id", "text", *names).collect())) == Counter(want)


def test_waves_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 1 << 12)
    lines = documents.agg(F.sum(F.size(F.split("text", "\n")))).first()[0]
    assert line_dedup.plan(lines)[1] > 1
    got = line_dedup.drop_repeated_lines(documents).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines([tuple(r) for r in documents.select("doc_id", "text").collect()]))


def test_no_lines(none):
    assert line_dedup.drop_repeated_lines(none).collect() == []


def test_filters_forget_nothing():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    parts = [line_dedup.BloomPair(1 << 16) for _ in range(3)]
    parts[0].add(hashes[:2000]), parts[1].add(hashes[1000:3000]), parts[2].add(np.r_[hashes[3000:], hashes[3000:3100]])
    pieces = sorted(p for part in parts for p in part.segments())
    merged = line_dedup.BloomPair(1 << 16)
    merged.twice = np.concatenate([np.frombuffer(t, dtype=np.uint8) for _, t in line_dedup.merge_segments(iter(pieces))])
    assert merged.seen_twice(hashes[1000:2000]).all() and merged.seen_twice(hashes[3000:3100]).all()
    once = np.r_[hashes[:1000], hashes[2000:3000], hashes[3100:]]
    assert merged.seen_twice(once).mean() < 0.1


@pytest.mark.parametrize("lines", [0, 1, 10**6, 10**8, 10**10])
def test_filters_are_bounded(lines):
    bits, waves = line_dedup.plan(lines)
    assert bits <= line_dedup.FILTER_BITS and bits * waves >= lines * line_dedup.LEAST


# --- spelling variants -----------------------------------------------------------------------------------
def plain_counts(rows, noise=97, shortest=5, least=3):
    totals = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            totals[word] += 1
    return {w: n for w, n in totals.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_runs():
    assert spelling.runs("AbÄä×x 12aĀb don't") == [x.encode("latin-1") for x in ("abÄä×x", "a", "b", "don", "t")]
    assert spelling.runs(None) == [] == spelling.runs("12 一")


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("counted", [300_000, 5])
def test_counts_equal_brute_force(request, which, counted, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", counted)
    df = request.getfixturevalue(which)
    want = plain_counts([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert {(r.word, r.n) for r in spelling.word_counts(df, noise=97).collect()} == set(want.items())


@pytest.mark.parametrize("cell", [8192, 60])
def test_variants_equal_brute_force(spark, documents, cell, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", cell)
    counts = plain_counts([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = queries.queries()["op12_spelling"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == plain_variants(counts)


def test_variants_of_hard_words(spark, monkeypatch):
    """Anagrams, ties, chains, words of repeated letters, long words around the shared class, and cells over their size."""
    monkeypatch.setattr(spelling, "CELL", 20)
    rng = np.random.default_rng(2)
    words = {"".join(rng.permutation(list("abcdefg"))) for _ in range(300)} | {"a" * n for n in range(5, 60)} | {"ab" * 150, "ab" * 149 + "a"}
    words |= {"b" * 300 + "c", "b" * 300, "b" * 299 + "d" + "b", "ä" * 6, "ä" * 5 + "a", "Ä" + "ä" * 5}
    long = "".join(rng.choice(list("abcdef"), 45))
    words |= {long[:n] for n in range(36, 46)} | {long[:n] + "z" for n in range(36, 45)}
    counts = {w: int(rng.choice([3, 3, 6, 12, 24, 48])) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(df).collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == plain_variants(counts)


@pytest.mark.parametrize("leaf", [64, 3])
def test_search_in_a_cell(leaf, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "COMPARED", 500)
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("aeinrstäö"), rng.integers(5, 8))) for _ in range(1500)})
    counts = {w: int(rng.integers(3, 30)) for w in words}
    coded, n = [w.encode("latin-1") for w in words], np.array([counts[w] for w in words])
    met, best = Counter(), {}
    for word, near, best_n, other in spelling.near_in_cell(coded, n, coded, n):
        word = word.decode("latin-1")
        met[word] += near
        best[word] = min(best.get(word, (0, "")), (-best_n, other.decode("latin-1")))
    for word in words:
        near = [x for x in words if one_edit(word, x)]
        assert met[word] == len(near)
        assert not near or best[word] == min((-counts[x], x) for x in near)


def test_long_chains(spark):
    chain = [("abcde" + "x" * n, 3 << n) for n in range(20)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_no_words(none):
    assert spelling.variants(spelling.word_counts(none)).collect() == []


def test_upper_trees_lose_no_near_word():
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("aeinrst"), rng.integers(5, 9))).encode() for _ in range(3000)})
    trees = spelling.UpperTrees(words[::3], dict(Counter(len(w) for w in words)))
    spelled = {c: [w for w in words if len(w) == c] for c in range(5, 9)}
    homes = {c: trees.home(spelling.letter_counts(ws), c) for c, ws in spelled.items()}
    for c, ws in spelled.items():
        for d, reach in ((0, (1, 1)), (1, (0, 1))):
            if c - d not in spelled:
                continue
            cells = defaultdict(set)
            for cell, rows in trees.reached(spelling.letter_counts(ws), c - d, *reach):
                for i in rows:
                    cells[i].add(cell)
            for i in range(0, len(ws), 37):
                assert all(home in cells[i] for x, home in zip(spelled[c - d], homes[c - d]) if one_edit(ws[i].decode(), x.decode()))


# --- Merkle manifest -------------------------------------------------------------------------------------
def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, witness of every leaf) by levels."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(level):
                proofs[i].append(level[p ^ 1])
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p >> 1 for p in at]
    return level[0], proofs


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof digest, folded root, verified) by the definition; rows (id, source, lang, n_chars, text)."""
    def leaf(*values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for r in rows:
        i, source, lang, n, text = r
        tampered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[lang].append((i is not None, i or 0, leaf(*r), i, tampered))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in order])
    return Counter(
        (i, mine, trees[g][0], root, h(*proof, *top), not tampered)
        for g, top in zip(order, tops) for (_, _, mine, i, tampered), proof in zip(groups[g], trees[g][1])
    )


@pytest.mark.parametrize("height", [12, 3, 1])
@pytest.mark.parametrize("which", ["odd", "documents"])
def test_manifest_equals_brute_force(spark, request, which, height, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    df = request.getfixturevalue(which)
    if which == "odd":
        df = df.withColumn("n_chars", F.when(F.col("doc_id") > 3, F.length("text").cast("long"))).drop("a b", "FP")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_merkle"](spark, str(tmp_path)).collect()
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == plain_manifest(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_manifest_with_many_groups(spark, tmp_path):
    rows = [(i, None, f"g{i % 37:02d}" if i % 5 else None, i, "x") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_merkle"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == plain_manifest(rows)


def test_manifest_of_nothing(none, tmp_path, spark):
    none.drop("a b", "FP").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()["op13_merkle"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("leaves", [1, 2, 3, 7, 8, 9, 64, 100])
def test_witnesses_prove_their_leaf_only(leaves):
    digests = [sha256(str(i).encode()).digest() for i in range(leaves)]
    tree = merkle.Witnesses()
    for d in digests:
        tree.append(d)
    root = tree.close()
    assert root.hex() == plain_tree([d.hex() for d in digests])[0]
    for i, d in enumerate(digests):
        assert merkle.fold(d, bytes(tree.of[i]), (i, leaves)) == root
        assert leaves == 1 or merkle.fold(digests[i - 1], bytes(tree.of[i]), (i, leaves)) != root
