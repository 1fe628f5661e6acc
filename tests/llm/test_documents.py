"""Text operators against brute force on small tables with every odd case."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from driftkit.llm.components import connected_components
from driftkit.llm.mixing import block_quotas, mix_sources, mixed_documents, source_targets
from driftkit.llm.packing import CAPACITY, best_fit, configuration_program, knapsack, pack_documents, plan
from driftkit.llm.queries import MIXING_SQL, vocabulary
from driftkit.llm.sharding import interleaved_shards
from driftkit.llm.simhash import fingerprint_links, near_duplicates, without_near_duplicates
from driftkit.llm.substring import deduplicated, without_repeats
from driftkit.llm.wordpiece import Automaton, token_counts, vocabulary_pieces


def raw(text):
    return (text or "").encode().split()


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def test_shards(odd_docs, no_docs):
    got = interleaved_shards(odd_docs, 4).collect()
    texts = sorted(zlib.crc32((r.text or "").encode()) for r in odd_docs.collect())
    assert sorted(r.text_crc32 for r in got) == texts and {r.law for r in got} == {"rows"}
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert sorted(map(str, got)) == sorted(map(str, interleaved_shards(odd_docs, 4).collect()))
    assert interleaved_shards(no_docs).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 10) END AS source")
    for r in interleaved_shards(docs, 8).groupBy("source", "shard").count().groupBy("source").agg({"count": "max", "*": "count"}).collect():
        total = docs.where(docs.source == r.source).count()
        assert r["max(count)"] <= -(-total // 8) + 1


def test_mix(odd_docs, no_docs, spark):
    got = mix_sources(odd_docs).collect()
    assert sorted(r.size for r in got) == sorted(len(raw(r.text)) for r in odd_docs.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in got) and mix_sources(no_docs).count() == 0
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 37 as int)) AS text", "concat('s', id % 5) AS source")
    again = [sorted(map(tuple, mix_sources(docs).collect())) for _ in range(2)]
    assert again[0] == again[1]
    rows = mix_sources(docs).collect()
    by = {s: [r for r in rows if r.source == s] for s in {r.source for r in rows}}
    assert [round(by[f"s{i}"][0].target / by["s0"][0].target) for i in range(5)] == [1, 2, 3, 1, 2]
    for part in by.values():
        assert sum(r.taken for r in part) == pytest.approx(part[0].target, rel=0.01)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(raw(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_mix_caps_and_reshares(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 5, "b"), (3, "c " * 985, "c")], "doc_id long, text string, source string")
    got = {r.source: r for r in mix_sources(docs).collect()}
    assert (got["a"].target, got["b"].target, got["c"].target) == (30.0, 15.0, pytest.approx(955.0))
    assert got["a"].taken == 30 and got["b"].taken == 15 and got["c"].taken == pytest.approx(955, abs=1)


def test_mix_takes_its_own_span_for_each_row(spark):
    """NULL and repeated ids: the words written are the words taken, and one row at most is cut."""
    rows = [(None, "a b c d e", "s")] * 30 + [(7, f"x{i} y z", "t") for i in range(40)] + [(i, "p q " * 8, "u") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mix_sources(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for part in (docs, docs.repartition(5)):
        out = mixed_documents(part).collect()
        for source, text in (("s", "a b c d e"), ("t", None), ("u", None)):
            mine = [r for r in out if r.source == source]
            assert sum(len(r.text.split()) for r in mine) == taken[source]
            size = {"s": 5, "t": 3, "u": 16}[source]
            assert sum(len(r.text.split()) != size for r in mine) <= 1
    assert len({r.text for r in mixed_documents(docs).where("source = 't'").collect()}) > 20


def test_mix_reaches_small_sources(spark):
    """Sources of 1e-6 of all words, of one or two blocks, and so many small ones that a large one wins their seats."""
    docs = spark.range(2_000_000 // 500).selectExpr("id AS doc_id", "repeat('w ', 500) AS text", "'big' AS source")
    small = spark.createDataFrame([(10_001, "a b", "tiny"), (10_002, "a " * 10, "half"), (10_003, "a " * 16, "one"), (10_004, "a " * 23, "two")], "doc_id long, text string, source string")
    got = mix_sources(docs.union(small)).collect()
    for source in {r.source for r in got}:
        part = [r for r in got if r.source == source]
        assert sum(r.taken for r in part) == pytest.approx(part[0].target, rel=0.01, abs=1), source
    kept = {r.source for r in mixed_documents(docs.union(small)).select("source").distinct().collect()}
    assert kept == {"big", "tiny", "half", "one", "two"}
    many = docs.limit(20).union(spark.range(200).selectExpr("id + 20000", "'a b c'", "concat('s', id)"))
    got = mix_sources(many, blocks=64).collect()
    by = {r.source: (r.target, sum(x.taken for x in got if x.source == r.source)) for r in got}
    assert len(by) == 201 and all(taken == pytest.approx(target, rel=0.01, abs=1) for target, taken in by.values())


def awards(targets, houses):
    """Seats after so many awards, one award after the other."""
    got, out, done = {k: 0 for k in targets}, [], 0
    for house in houses:
        for _ in range(house - done):
            best = min(targets, key=lambda k: (-targets[k][0] / (2 * got[k] + 1), targets[k][1]))
            got[best] += 1
        done = house
        out.append(dict(got))
    return out


@pytest.mark.parametrize("sizes,blocks", [([900, 5, 40, 7], 64), ([1] * 30 + [5000], 32), ([3], 4), ([100_000, 90_000, 40_000], 256), ([20_000] + [700] * 90, 16)])
def test_block_quotas_are_the_highest_quotients(spark, sizes, blocks):
    table = spark.createDataFrame([(False, f"s{i:03}", n) for i, n in enumerate(sizes)], "no_source boolean, source string, source_size long")
    targets = source_targets(table)
    known = {r.source: (r.target, r.place) for r in targets.collect() if r.target > 0}
    got = {r.source: r for r in block_quotas(targets, blocks=blocks, shards=5).collect()}
    block = {r.block for r in got.values()}
    assert len(block) == 1 and set(got) == set(known)
    total, block = sum(sizes), block.pop()
    assert block == 1 or (block <= total / blocks and block * 128 <= min(t for t, _ in known.values()))
    want = awards(known, [total // block * k // 5 for k in range(1, 6)])
    assert all(list(got[s].seats) == [w[s] for w in want] for s in got)


def test_every_shard_holds_its_quota(spark):
    """Words taken per (shard, source) are that quota's blocks, and a document's shards are its taken words."""
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 41 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 7 THEN NULL ELSE concat('s', id % 4) END AS source")
    rows = mix_sources(docs, shards=6).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = r.source_size
        assert sum(r.shard_words) == r.taken and len(r.shard_words) == 6 and min(r.shard_words) >= 0
    table = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long")
    for q in block_quotas(source_targets(table), shards=6).collect():
        source = None if q.no_source else q.source
        ends = [min(n * q.block, 3 * sizes[source]) for n in q.seats]
        got = [sum(r.shard_words[k] for r in rows if r.source == source) for k in range(6)]
        assert got == [e - b for e, b in zip(ends, [0, *ends])]
    shards = [sum(r.shard_words[k] for r in rows) for k in range(6)]
    assert max(shards) - min(shards) <= 2 + 0.02 * sum(shards) / 6


def test_mixing_sql_holds_for_small_sources(spark, odd_docs):
    """The whole rule restated in SQL, on sources far smaller than a block and on the odd cases."""
    big = spark.range(3000).selectExpr("id + 100 AS doc_id", "repeat('w ', 100) AS text", "'big' AS source")
    small = spark.createDataFrame([(1, "a b", "tiny"), (2, "a " * 23, "two"), (3, "", "empty"), (4, None, None)], "doc_id long, text string, source string")
    for documents in (big.union(small), small.where("doc_id = 1"), odd_docs.select("doc_id", "text", "source").dropDuplicates(["doc_id"])):
        con = duckdb.connect()
        con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
        want = con.execute(MIXING_SQL).fetchall()
        got = [(r.doc_id, r.size, r.source_size, r.target, r.taken, ",".join(map(str, r.shard_words))) for r in mix_sources(documents).collect()]
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=lambda r: str(r[0])), sorted(want, key=lambda r: str(r[0]))):
            assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4:] == w[4:]


def greedy(pieces, word):
    longest, n, i = max(map(len, pieces)), 0, 0
    while i < len(word):
        size = next((k for k in range(longest, 0, -1) if word[i:i + k] in pieces), 0)
        if not size:
            return 1
        n, i = n + 1, i + size
    return n


def test_token_counts(odd_docs, no_docs):
    small = [b"a", b"ab", b"abcd", b"bc", b"d", b"cde", b" a"]
    words = [b"abcde", b"abc", b" abcd", b"abce", b"x", b"abcdabcd", b"bcd"]
    assert Automaton(small).count(words).tolist() == [greedy(set(small), w) for w in words]
    path = vocabulary("byte_bpe_50k.json")
    pieces = set(vocabulary_pieces(path))
    memo = {}
    want = sorted((len(raw(r.text)), sum(memo.setdefault(w, None) or memo.update({w: greedy(pieces, b" " + w)}) or memo[w] for w in raw(r.text))) for r in odd_docs.collect())
    assert sorted((r.n_words, r.n_tokens) for r in token_counts(odd_docs, path).collect()) == want
    assert token_counts(no_docs, path).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    ids = {}
    for r, c in zip(rows, label):
        if r.doc_id is not None:
            ids[c] = min(ids.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", ids.get(c)) for r, f, c in zip(rows, fps, label)), key=str)
    assert sorted(map(tuple, near_duplicates(odd_docs).collect()), key=str) == want
    assert near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark, odd_docs):
    """Copies go under whatever id; one id with two texts keeps each text's own group."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, "x"), (5, b, "y"), (5, a, "z"), (5, b, "y"), (None, b, "n"), (None, "c c c", "n"), (None, "c c c", "m"), (9, "d", "q"), (9, "e", "q"), (9, "e", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, without_near_duplicates(docs).collect()), key=str)
    assert [r[:2] for r in got if r[0] in (3, 5)] == [(3, a), (5, b)]
    assert sorted(r[1] for r in got if r[0] == 9) == ["d", "e"] and [r[1] for r in got if r[0] is None] == ["c c c"]
    assert got == sorted(map(tuple, without_near_duplicates(docs.repartition(3)).collect()), key=str)
    groups = near_duplicates(odd_docs).select("component_id", "fingerprint").collect()
    kept = without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r.component_id for r in groups} >= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("rows", [1, 1_000_000])
def test_links_give_all_components(spark, rows):
    """``rows`` drives the number of tasks: one, or so many that every hot segment is cut."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:12]:  # dense groups and chains, all within one hot segment value
        x = int(b)
        for _ in range(25):
            x ^= 1 << int(rng.integers(0, 40)) ^ 1 << int(rng.integers(0, 40))
            fps.add(x)
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = components(len(fps), pairs)
    links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, rows=rows).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert components(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 170)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100 and got[200] == got[170] == 150


def brute_cut(rows, window):
    first = {}
    for r in rows:
        words = raw(r.text)
        for i in range(len(words) - window + 1):
            if r.doc_id is not None:
                k = tuple(words[i:i + window])
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
    for r in rows:
        words = raw(r.text)
        gone = set()
        for i in range(len(words) - window + 1):
            if r.doc_id is not None and first[tuple(words[i:i + window])] < r.doc_id:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield r.doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 500])
def test_substring(odd_docs, no_docs, chunk_bytes):
    want = sorted(brute_cut(odd_docs.collect(), 13), key=str)
    assert sorted(map(tuple, deduplicated(odd_docs, 13, with_text=False, chunk_bytes=chunk_bytes).collect()), key=str) == want
    assert deduplicated(no_docs, 13).count() == 0


def test_substring_with_a_full_sketch(odd_docs):
    """A sketch that estimates everything as repeated changes nothing."""
    want = sorted(brute_cut(odd_docs.collect(), 3), key=str)
    assert sorted(map(tuple, deduplicated(odd_docs, 3, with_text=False, spare=0, chunk_bytes=2000).collect()), key=str) == want


def test_without_repeats_keeps_columns(odd_docs):
    out = without_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[7].text == "tail" and kept[7].n_chars == 4 and kept[8].text == "head" and 6 not in kept
    assert kept[0].text is None and kept[2].text == "   \n" and kept[12].text == "A\tB\x0bC D"


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    want = []
    for r in odd_docs.collect():
        ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, p, a, len(ids[a:a + CAPACITY]), zlib.crc32(np.array(ids[a:a + CAPACITY], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), CAPACITY))]
    got = pack_documents(odd_docs, path).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert pack_documents(no_docs, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(np.minimum(rng.lognormal(6, 1.2, 300).astype(int) + 1, CAPACITY))
    counts = rng.integers(1, 60, len(lengths))
    made, used = plan(lengths, counts), {}
    for config, many in made:
        assert sum(k * n for k, n in config.items()) <= CAPACITY and many > 0
        for k, n in config.items():
            used[k] = used.get(k, 0) + n * many
    assert used == dict(zip(lengths.tolist(), counts.tolist()))
    best = sum(many for _, many in best_fit(lengths, counts, CAPACITY))
    assert sum(many for _, many in made) <= best * 1.01 + 1


def test_remainder_fills_planned_sequences():
    """Room left in sequences that are begun is used before new ones are opened."""
    lengths, counts = np.array([10, 30, 60]), np.array([7, 0, 1])
    made = best_fit(lengths, counts, 100, [({1: 3}, 2), ({2: 1}, 1)])
    assert sum(many for _, many in made) == 4
    used = {}
    for config, many in made:
        assert sum(int(lengths[i]) * n for i, n in config.items()) <= 100
        for i, n in config.items():
            used[i] = used.get(i, 0) + n * many
    assert used == {0: 7, 1: 6, 2: 2}


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_plan_is_near_a_known_optimum(parts):
    """Pieces cut from full sequences: the optimum is their number."""
    rng, pieces = np.random.default_rng(parts), []
    for _ in range(5000):
        cuts = np.sort(rng.choice(np.arange(1, CAPACITY), parts - 1, replace=False))
        pieces += np.diff([0, *cuts, CAPACITY]).tolist()
    lengths, counts = np.unique(pieces, return_counts=True)
    made = sum(many for _, many in plan(lengths, counts))
    assert 5000 <= made <= 5050
    bound = configuration_program(lengths, counts, CAPACITY)[1]
    assert 4990 <= bound <= 5000 + 1e-6


def test_plan_beats_best_fit_where_it_can():
    """Lengths that best fit pairs badly; the dual bound holds for both."""
    lengths, counts = np.unique(np.random.default_rng(0).integers(700, 2101, 20_000), return_counts=True)
    made, plain = (sum(many for _, many in x) for x in (plan(lengths, counts), best_fit(lengths, counts, CAPACITY)))
    assert configuration_program(lengths, counts, CAPACITY)[1] <= made < plain


def test_knapsack_against_brute_force():
    from itertools import product

    lengths, price = np.array([2, 3, 7]), np.array([1.0, 1.7, 4.5])
    best, choice = knapsack(lengths, price, 20)
    for c in range(21):
        assert best[c] == pytest.approx(max(np.dot(k, price) for k in product(range(11), range(7), range(3)) if np.dot(k, lengths) <= c))
