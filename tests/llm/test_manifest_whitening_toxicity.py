"""Whitening, the Merkle manifest and toxicity scores against plain Python, odd rows included."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import toxicity, whitening
from ragspark.llm.eigen import leading_pairs, leading_values, sturm_counts, tridiagonal
from ragspark.llm.merkle import Appender, fold, joined_digest, merkle_manifest, proof_digest
from ragspark.llm.toxicity import Index, chosen_terms, grams, score_toxicity, words_of
from ragspark.llm.whitening import whiten

RANDOM = np.random.default_rng(0)
TURN, _ = np.linalg.qr(RANDOM.normal(size=(40, 40)))


def samples(rows, width):
    x = RANDOM.normal(size=(rows, width))
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / rows


@pytest.mark.parametrize("matrix", [
    samples(200, 40), samples(10, 40),  # full and low rank
    np.eye(20), np.zeros((3, 3)), np.array([[4.0]]), np.array([[1.0, 1.0], [1.0, 1.0]]), np.ones((30, 30)),
    np.diag(np.r_[np.ones(20) * 3, np.ones(20) * 2]), TURN @ np.diag(np.r_[np.ones(20) * 3, np.ones(12) * 2, np.zeros(8)]) @ TURN.T,
    np.kron(np.eye(8), np.array([[2.0, 1.0], [1.0, 2.0]])), np.full((30, 30), 1e12) + np.diag(np.arange(30.0)),
    np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),  # pairs of nearly equal values
])
def test_leading_pairs_equal_a_dense_solver(matrix):
    values, vectors = leading_pairs(matrix, 32)
    want = np.linalg.eigvalsh(matrix)[::-1][:32]
    size = max(float(np.abs(want).max()), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() <= 1e-12


def test_tridiagonal_form_and_sturm_counts():
    d, e, _ = tridiagonal(samples(100, 12))
    full = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    values = np.linalg.eigvalsh(full)
    at = np.linspace(-1, 4, 50)
    assert sturm_counts(d, e, at).tolist() == [int((values < x).sum()) for x in at]
    assert np.allclose(leading_values(d, e, 5), values[::-1][:5])


def brute_whitening(vectors, components):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return ((n * x - total) ** 2).sum(axis=1), centred @ basis / np.sqrt(values), values / np.trace(covariance)


def test_whitening_equals_brute_force(spark):
    data = RANDOM.normal(size=(300, 12)) * np.arange(1, 13) + RANDOM.normal(size=(300, 1))
    rows = [(i, [float(c) for c in v], 5, "x") for i, v in enumerate(data.astype(np.float32))]
    odd = [(1000, None, 1, ""), (1001, [1.0] * 11 + [None], 1, ""), (1002, [float("nan")] * 12, 1, ""), (1003, [float("inf")] * 12, 1, ""), (1004, [], 1, "")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int, component string").repartition(5)
    got = whiten(frame, 8).toPandas()
    deviation, white, explained = brute_whitening([v for _, v, *_ in rows], 8)
    assert len(got) == 300 * 8 and set(got["n"]) == {300} and set(got["component"]) == set(range(1, 9))
    assert got["identity_error"].nunique() == 1 and 0 < got["identity_error"][0] < 1e-9
    one = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert one.loc[range(300)].tolist() == deviation.tolist()
    for k in range(8):
        mine = got[got["component"] == k + 1].set_index("vec_id")["whitened"].loc[range(300)].to_numpy()
        sign = np.sign(mine @ white[:, k])
        assert np.abs(sign * mine - white[:, k]).max() < 1e-8
        assert got[got["component"] == k + 1]["explained"].to_numpy() == pytest.approx(explained[k], rel=1e-9)


def test_whitening_of_few_equal_repeated_and_unequally_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PART_CELLS", 1)  # each length a part of its own
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (5, [7.0]), (6, [2.0, 2.0, 2.0]), (7, [2.0, 2.0, 2.0])]
    got = whiten(spark.createDataFrame(rows, schema)).toPandas()
    two = got[got["n"] == 3]
    assert sorted(two["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1]
    first = two[two["component"] == 1]
    assert (first["whitened"] ** 2).sum() == pytest.approx(3) and first["explained"].to_numpy() == pytest.approx(1.0)
    assert two[two["component"] == 2]["whitened"].isna().all()  # no variance there
    alone = got[got["vec_id"].isin([5, 6, 7])]
    assert len(alone) == 1 + 3 * 2 and alone["whitened"].isna().all() and alone["explained"].isna().all() and (alone["deviation"] == 0).all()
    huge = whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], schema)).toPandas()
    assert huge["deviation"].isna().all() and np.isfinite(huge[huge["component"] == 1]["whitened"]).all()
    assert whiten(spark.createDataFrame([], schema)).count() == 0


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, at long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5])


def plain_tree(leaves):
    """Root, and for each leaf the (position, siblings) of every level."""
    paths, level = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(level) > 1:
        higher = []
        for at in range(0, len(level), 3):
            run = level[at:at + 3]
            for k, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append((k, [h for j, (h, _) in enumerate(run) if j != k]))
            higher.append((digest(h for h, _ in run), [i for _, below in run for i in below]))
        level = higher
    return level[0][0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = plain_tree([leaf(r) for r in groups[s]])
    root, paths = plain_tree([trees[s][0] for s in names])
    out = []
    for s, beyond in zip(names, paths, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            changed = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf((*r[:4], changed))
            for k, siblings in path + beyond:
                folded = digest(siblings[:k] + [folded] + siblings[k:])
            out.append((r[0], leaf(r), trees[s][0], root, digest(h for _, hs in path + beyond for h in hs), folded, folded == root))
    return sorted(out, key=repr)


def manifest(frame, levels):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle_manifest(frame, COLUMNS, "source", "doc_id", [F.col(c) for c in COLUMNS[:-1]] + [text], levels=levels)
    return sorted([(r["doc_id"], *(r[c].hex() for c in ("leaf", "subroot", "root", "proof", "folded")), r["verified"]) for r in out.collect()], key=repr)


def leaves_of(seed, n):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "é", "", None]), rnd.choice(["en", None]), rnd.choice([3, None]),
             rnd.choice([None, "", "one\ntwo", "\n", "line", "日本\n" * 50])) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "a", "en", 1, "x\ny"), (None, None, None, None, None)]


@pytest.mark.parametrize(("n", "levels"), [(1, 2), (9, 1), (100, 1), (100, 2), (100, 7)])
def test_manifest_equals_plain_trees(spark, n, levels):
    rows = leaves_of(n, n) if n > 3 else [(5, "s", None, None, "t")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], MANIFEST).repartition(3)
    assert manifest(frame, levels) == brute_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert manifest(spark.createDataFrame([], MANIFEST), 2) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_streamed_appends_give_the_witnesses_of_the_whole_tree(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    tree = Appender()
    for h in leaves:
        tree.append(h)
    root = tree.close()
    want, paths = plain_tree([h.hex() for h in leaves])
    assert root.hex() == want
    for h, witness, path in zip(leaves, tree.witnesses, paths, strict=True):
        assert fold(h, bytes(witness)) == root
        assert proof_digest(bytes(witness)) == joined_digest([bytes.fromhex(s) for _, hs in path for s in hs])
        assert n == 1 or fold(b"\0" * 32, bytes(witness)) != root


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def spoken(seed=3, n=600):
    """Invented prose; toxic texts hold one of three words, or several forms of a stem."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(common, k=rnd.randint(3, 80)) + [word() for _ in range(10)]
        toxic = i % 5 == 0
        if toxic and i % 2:
            words[1:1] = [rnd.choice(["Scoundrel", "VILLAIN", "knave!"]) for _ in range(2)]
        elif toxic:
            words[2:2] = ["zwurg" + word() for _ in range(4)]
        docs.append((i, " ".join(words), 1, "s"))
        labels.append((i, int(toxic), 9.0))
    return docs, labels


TEXTS, LABELS = "doc_id long, text string, label int, score string", "doc_id long, toxic int, score double"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spoken()
    extra = [(None, "knave villain", 1, ""), (2000, "", 1, ""), (2001, None, 1, ""), (2002, "12 34", 1, ""), (0, docs[0][1], 1, ""), (2003, "word " * 30_000, 1, "")]
    d = spark.createDataFrame(docs + extra, TEXTS).repartition(4)
    learnt = [x for x in labels if x[0] % 4] + [(None, 1, 0.0), (2, None, 0.0), (99_999, 1, 0.0)]
    return docs, labels, score_toxicity(d, spark.createDataFrame(learnt, LABELS)).collect()


def test_toxicity_of_held_out_texts(scored):
    docs, labels, rows = scored
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + 6 and set(found) == {i for i, *_ in docs} | {None, 2000, 2001, 2002, 2003}
    held = [(found[i]["predicted"], toxic) for i, toxic, _ in labels if i % 4 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and sum(a for a, b in held if b) >= 0.9 * sum(b for _, b in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert found[None]["predicted"] == 1 and {found[i]["predicted"] for i in (2000, 2001, 2002, 2003)} == {0}
    assert found[2000]["evidence"] == [] == found[2002]["evidence"] and found[2001]["score"] == found[2000]["score"]


def test_no_text_is_evidence_for_itself(scored):
    _, labels, rows = scored
    truth = {i: toxic for i, toxic, _ in labels}
    for r in rows:
        ids = [e["doc_id"] for e in r["evidence"]]
        assert r["doc_id"] not in ids and all(e["label"] == truth[e["doc_id"]] and e["doc_id"] % 4 for e in r["evidence"])
        assert [(-e["cosine"], e["doc_id"]) for e in r["evidence"]] == sorted((-e["cosine"], e["doc_id"]) for e in r["evidence"])


def test_labels_of_a_text_do_not_reach_its_score(spark):
    docs, labels = spoken(5, 200)
    d = spark.createDataFrame(docs, TEXTS)
    base = {r["doc_id"]: r["score"] for r in score_toxicity(d, spark.createDataFrame([x for x in labels if x[0] % 4], LABELS)).collect()}
    more = [x for x in labels if x[0] % 4] + [(8, 1, 0.0)]
    changed = score_toxicity(d.withColumn("score", F.lit("other")).where("doc_id <> 8"), spark.createDataFrame(more, LABELS)).collect()
    assert {r["doc_id"]: r["score"] for r in changed} == pytest.approx({i: s for i, s in base.items() if i != 8}, abs=0.02)


def test_block_max_search_equals_all_cosines():
    rnd = random.Random(7)
    terms = 30
    idf = np.array([1 + rnd.random() for _ in range(terms)])
    row = lambda i: (i, rnd.randint(0, 1), sorted(rnd.sample(range(terms), rnd.choice([0, 1, 1, 2, 5]))), None, rnd.randint(0, 50))
    examples = [(i, y, t, [rnd.randint(1, 3) for _ in t], w) for i, y, t, _, w in map(row, rnd.sample(range(10_000), 900))]
    index = Index(idf, examples, k=7)
    dense = np.zeros((900, terms + 1))
    for n, (_, _, t, times, w) in enumerate(examples):
        at, weights = index.unit(t, times, w)
        dense[n, at] = weights
    for i, _, t, _, w in map(row, [e[0] for e in examples[:60]] + list(range(20_000, 20_060))):
        times = [rnd.randint(1, 3) for _ in t]
        at, weights = index.unit(t, times, w)
        query = np.zeros(terms + 1)
        query[at] = weights
        cosines = np.round(dense @ query, 9)
        want = sorted((-c, e[0]) for c, e in zip(cosines.tolist(), examples, strict=True) if c > 0 and e[0] != i)[:7]
        got, near = index.nearest(i, t, times, w)
        assert index.ids[got].tolist() == [e for _, e in want] and near.tolist() == pytest.approx([-c for c, _ in want], abs=2e-9)
    assert index.visited < 0.8 * index.blocks * 120


def test_terms_cover_toxic_texts_and_leave_common_ones():
    assert grams("zwurgle") == ["zwu", "zwur", "zwurg", "zwurgl", "zwurgle", "zwurgle$"] and grams("ab") == ["ab$"] and len(grams("x" * 99)) == 6
    assert words_of("Don't STOP_it 5x") == ["don", "t", "stop", "it", "x"] and words_of(None) == []
    held = [[0, 2], [0], [0], [1], [1], [1], [2], [2]]
    assert chosen_terms(held, np.array([0.0, 0.0, 9.0]), 5) == [0, 1]


def test_toxicity_without_labels_of_both_kinds(spark):
    docs, labels = spoken(6, 30)
    d = spark.createDataFrame(docs, TEXTS)
    for kept, score in (([], 0.0), ([x for x in labels if not x[1]], 0.0), ([x for x in labels if x[1]], 1.0)):
        rows = score_toxicity(d, spark.createDataFrame(kept, LABELS)).collect()
        assert len(rows) == 30 and all(abs(r["score"] - score) < 1e-9 for r in rows)
    assert score_toxicity(d.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_bounded_examples_are_chosen_by_hash(spark):
    docs, labels = spoken(8, 300)
    rows = score_toxicity(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(labels, LABELS), examples=100, k=300, shown=300).collect()
    assert max(len(r["evidence"]) for r in rows) <= 100
    assert toxicity.EXAMPLES == 16_384
