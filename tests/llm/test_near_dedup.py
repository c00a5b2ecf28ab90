import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rectio.llm import embeddings, simhash
from rectio.llm.common import connected_components


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)) for _ in range(12)]
    texts = []
    for k in range(60):
        words = base[k % 12].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        texts.append((k, " ".join(words)))
    return texts


def test_fingerprints_and_components_match_brute_force(spark, documents):
    texts = near_texts()
    prints = {k: brute_fingerprint(t) for k, t in texts}
    want = brute_components(sorted(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    for hot_half in (2000, 1):
        got = simhash.simhash_components(documents(texts), hot_half=hot_half).collect()
        assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
        assert {r.doc_id: r.component_id for r in got} == want


def test_one_wildcard_variants_find_every_pair_within_three_bits(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {center}
    for _ in range(120):
        x = center
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(sorted(prints))]
    ordered = sorted(prints)
    want = {(i, j) for i in range(len(ordered)) for j in range(i + 1, len(ordered)) if (ordered[i] ^ ordered[j]).bit_count() <= 3}
    df = spark.createDataFrame(signed, "fp long, rep long")
    for hot_half in (2000, 2):
        got = {tuple(sorted(r)) for r in simhash.near_pairs(df, hot_half=hot_half).collect()}
        assert got == want


def test_simhash_edge_rows(spark, edge):
    got = simhash.simhash_components(edge)
    rows = got.collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[7].fp == 0 and by[7].component_id == 1
    assert by[3].component_id == by[8].component_id == 3
    kept = simhash.keep_one_each(edge, got)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4]
    assert simhash.simhash_components(edge.limit(0)).count() == 0


def test_components_of_chain_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2), (None, 4)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 130)}


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((20, 16))
    rows = [(k, (centers[k % 20] + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, rows[5][1], 0) for k in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 0), (2004, [1.0, 2.0], 0), (2005, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(k, np.array(v, dtype=float)) for k, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: v / np.linalg.norm(v) for k, v in good}
    link = {(i, j): bool(unit[i] @ unit[j] >= 0.95) for i in unit for j in unit if i < j}
    want = brute_components(sorted(unit), lambda i, j: link[i, j])
    degree = {i: sum(v for p, v in link.items() if i in p) for i in unit}
    for tile in (4096, 50):
        got = {r.vec_id: r for r in embeddings.embedding_links(df, tile=tile).collect()}
        assert len(got) == len(rows)
        for i in unit:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i)
        for i in range(2000, 2006):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.embedding_links(df.limit(0)).count() == 0


def test_embeddings_of_any_magnitude(spark):
    base = [3.0, 4.0, 0.5]
    rows = [(k, [x * scale for x in base], "x") for k, scale in enumerate((1.0, 1e-30, 1e20, 1e-200, 1e200, -1.0))] + [(9, [1e-300, 0.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(df).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5), 9: (0, 9)}
    single = spark.createDataFrame([(1, [1e-30, 1e-30]), (2, [1e-20, 1e-20]), (3, [1e-45, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(single).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_dense_blocks_decide_as_others_do():
    rng = np.random.default_rng(2)
    center = rng.standard_normal(32)
    vectors = center + 0.28 * rng.standard_normal((900, 32))
    axes = embeddings.principal_axes(vectors)
    unit = embeddings.units(vectors)
    x = np.einsum("id,jd->ij", unit, unit)
    want = {(i, j) for i, j in zip(*np.nonzero(x >= 0.95)) if i < j}
    got = {(int(i), int(j)) for a, b in embeddings.compare(vectors, None, axes, 0.95) for i, j in zip(a, b)}
    assert got == want and 1000 < len(want) < 900 * 899 / 2


def test_one_id_with_texts_of_two_components(spark, documents):
    texts = near_texts()
    twice = [(1, texts[0][1]), (1, texts[1][1]), (1, texts[1][1]), (2, texts[0][1]), (3, texts[1][1]), (4, texts[2][1])]
    got = simhash.simhash_components(documents(twice))
    assert {r.component_id for r in got.collect()} == {1, 4}
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one_each(documents(twice), got).collect())
    assert kept == sorted([(1, texts[0][1]), (1, texts[1][1]), (4, texts[2][1])])


def test_hot_classes_meet_in_a_broadcast(spark, monkeypatch):
    from rectio.llm import common

    rows = spark.createDataFrame([(k % 7 if k % 3 else 99,) for k in range(300)], "key long")
    classes = rows.groupBy("key").count().withColumnRenamed("count", "n")
    for share in (1000, 5, 1):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.join_classes(rows, classes, "key")
        assert got.count() == 300 and got.where("key = 99 AND n = 100").count() == 100


def test_hex(spark):
    assert spark.range(1).select(simhash.to_hex(F.lit(-1)).alias("h")).first().h == "f" * 16
