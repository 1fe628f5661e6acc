"""Merkle manifest, embedding near-duplicates and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkit.llm import embed_dedup, merkle
from driftkit.llm.embed_dedup import Codes, near_vectors, tile_links
from driftkit.llm.merkle import merkle_manifest
from driftkit.llm.spelling import cheapest_disjoint, near_words, spelling_variants


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and, per leaf, the steps to it: (side, sibling) or None for a lone node."""
    steps, spot, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(spot):
            other = at ^ 1
            steps[k].append(None if other >= len(level) else ("L" if other < at else "R", level[other]))
            spot[k] = at // 2
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], steps


def brute_manifest(rows):
    def leaf(r, more=0):
        n = r.n_chars if r.n_chars is None else r.n_chars + more
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    subs = {}
    for g, part in groups.items():
        part.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        subs[g] = tree([leaf(r) for r in part])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = tree([subs[g][0] for g in order])
    for g, high in zip(order, tops):
        for r, low in zip(groups[g], subs[g][1]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, int(hit))
            for step in low + high:
                node = sha(node) if step is None else sha(step[1], node) if step[0] == "L" else sha(node, step[1])
            yield r.doc_id, leaf(r), subs[g][0], root, sha(*(s[1] for s in low + high if s)), node, node == root


def manifest(docs):
    return merkle_manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).drop("path")


@pytest.mark.parametrize("height, broadcast", [(10, 16 << 20), (2, 0)])
def test_manifest(spark, odd_docs, no_docs, monkeypatch, height, broadcast):
    """Several passes, several rounds, with and without broadcasts."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 10_000 if broadcast else 0)
    more = spark.range(75).selectExpr("id * 3 AS doc_id", "concat('t', id) AS text", "CASE WHEN id < 70 THEN 'fr' WHEN id < 73 THEN 'é' ELSE 'x' END AS lang", "'s' AS source", "IF(id % 5 = 0, NULL, id) AS n_chars")
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more), odd_docs, odd_docs.limit(1)):
        rows = docs.collect()
        got = sorted(map(tuple, manifest(docs).collect()), key=str)
        assert got == sorted(brute_manifest(rows), key=str)
        assert len(rows) < 20 or {r[-1] for r in got} == {True, False}
    assert manifest(no_docs).count() == 0


def test_manifest_proofs_need_no_other_row(odd_docs):
    """The path alone takes a leaf to the root."""
    for r in merkle_manifest(odd_docs).collect():
        node = r.leaf
        for i in range(0, len(r.path), merkle.STEP):
            side, sibling = r.path[i], bytes(r.path[i + 1:i + merkle.STEP]).hex()
            node = sha(node) if side == merkle.ALONE else sha(sibling, node) if side == merkle.LEFT else sha(node, sibling)
        assert node == r.root == r.folded_root and r.verified


def brute_near(rows, threshold):
    vecs = [None if r.embedding is None or not len(r.embedding) or any(x is None or not np.isfinite(x) for x in r.embedding) or not any(r.embedding) else np.array(r.embedding, float) for r in rows]
    near = [[j for j, w in enumerate(vecs) if i != j and v is not None and w is not None and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold] for i, v in enumerate(vecs)]
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j].vec_id for j in seen if rows[j].vec_id is not None]
        label = min(ids, default=None)
        yield r.vec_id, len(near[i]), label, r.vec_id == label


@pytest.fixture(scope="module")
def near_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):  # clusters of every tightness, around the threshold too
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * spread).tolist() for spread in np.linspace(0.02, 0.5, 25)]
    chain = [[np.cos(0.3 * i), np.sin(0.3 * i), 0, 0, 0, 0, 0, 0] for i in range(9)]  # each links with the next only
    rows += [[float(x) for x in v] for v in chain]
    rows = [(i, v, 1) for i, v in enumerate(rows)]
    rows += [(900, rows[3][1], 0), (901, [5.0 * x for x in rows[3][1]], 0), (902, [1e300 * x for x in rows[3][1]], 0), (2, rows[3][1], 0), rows[3], (None, rows[3][1], 0)]
    rows += [(910, None, 0), (911, [], 0), (912, [0.0] * 8, 0), (913, [float("nan")] * 8, 0), (914, [1.0, None] + [0.0] * 6, 0), (915, [1.0, 2.0], 0), (916, [1.0, 2.0001], 0), (None, None, None), (None, [0.0, 9.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block, tile", [(8192, 1024), (256, 7)])
def test_near_vectors(near_rows, monkeypatch, block, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = near_rows.collect()
    huge = [r for r in rows if r.vec_id != 902]  # the brute force would overflow
    want = sorted(brute_near(huge, 0.95), key=str)
    assert sorted((tuple(r) for r in near_vectors(near_rows.where("vec_id IS NULL OR vec_id <> 902"), block_rows=block).collect()), key=str) == want
    got = {r.vec_id: r for r in near_vectors(near_rows).collect()}
    assert got[902].component_id == got[3].component_id and got[902].n_links == got[901].n_links
    assert near_vectors(near_rows.limit(0)).count() == 0


def test_near_vectors_over_many_slots(spark, monkeypatch):
    """Every pair of slots meets, single floats, no vector twice."""
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 1)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 5))
    vecs = np.repeat(base, 6, axis=0) + rng.normal(size=(900, 5)) * 0.15
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(df, threshold=0.97).collect())) == sorted(brute_near(df.collect(), 0.97))


def test_error_bounds_decide_nothing_wrong():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(300, 40))
    v = u[rng.permutation(300)] + rng.normal(size=(300, 40)) * rng.uniform(0.05, 0.6, 300)[:, None]
    exact = (u @ v.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    for t in (0.5, 0.9, float(np.sort(exact.ravel())[-40])):
        a, b = tile_links(Codes(u), slice(0, 300), Codes(v), slice(0, 300), t)
        sure = np.abs(exact - t) > 1e-12
        got = np.zeros_like(sure)
        got[a, b] = True
        assert (got == (exact >= t))[sure].all()


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, length=6, least=5, slip=199):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= length and n >= least}


def brute_variants(words):
    form = {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None


def test_spelling(spark, odd_docs, no_docs):
    rng = np.random.default_rng(9)
    base = ["banana", "Überfluß", "aaaaaaaa", "strasse", "ab" * 5, "réveillé", "zzyzxq"]
    text, n = [], [500, 700, 300, 650, 400, 260, 125]
    for w, m in zip(base, n):
        text += [w] * m
        for _ in range(12):
            i, how, c = int(rng.integers(len(w) + 1)), int(rng.integers(3)), chr(97 + int(rng.integers(26)))
            v = w[:i] + c + w[i + (how > 0):] if how < 2 else w[:i] + w[i + 1:]
            text += [v] * int(rng.integers(4, 60))
    rows = [(i, " ".join(text[i::40]), 1) for i in range(40)] + [(None, " ".join(["BANANA", "bananä"] * 30), 2), (3, "banana-banana Ünited×÷ Ābcdefg " * 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for part in (docs, docs.unionByName(docs.limit(5)), odd_docs):
        words = brute_words(part.collect())
        got = sorted(map(tuple, spelling_variants(part).collect()), key=str)
        assert got == sorted(brute_variants(words), key=str)
    slipping = sorted(map(tuple, spelling_variants(docs, slip=3).collect()), key=str)
    assert slipping == sorted(brute_variants(brute_words(docs.collect(), slip=3)), key=str)
    assert spelling_variants(no_docs).count() == 0


def test_roots_go_to_the_end_of_long_chains(spark):
    """Counts of 1, 5, 25, ... along a chain of words, each one edit from the next."""
    words = [("abcdefgh"[:i] + "z" * (8 - i)) for i in range(7)]
    text = " ".join(" ".join([w] * 5 ** (i + 1)) for i, w in enumerate(words[:6]))
    got = {r.word: r for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), slip=None).collect()}
    assert {r.root for r in got.values()} == {words[5]} and got[words[0]].form == words[1]


def test_every_edit_of_a_word_is_found(spark):
    """All words one edit apart from words of few different bigrams, at every place."""
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abc"), 6 + int(rng.integers(3)))) for _ in range(400)}
    got = {(r.word, r.other) for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and edits(a, b)}


def test_cheapest_disjoint():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(200):
        at = sorted(rng.choice(12, int(rng.integers(3, 8)), replace=False).tolist())
        cost = rng.integers(1, 50, len(at)).tolist()
        i, j = cheapest_disjoint(at, cost)
        assert at[j] - at[i] >= 2
        assert cost[i] + cost[j] == min(cost[a] + cost[b] for a, b in combinations(range(len(at)), 2) if at[b] - at[a] >= 2)
