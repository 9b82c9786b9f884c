import itertools
import random

import numpy as np
import xxhash

from seqframe.llm import simhash
from seqframe.llm.components import components
from seqframe.llm.queries import simhash_digests


def test_golay_decoder_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    index = simhash.decode(words)
    book = {}
    for w, i in zip(words.tolist(), index.tolist(), strict=True):
        code = w ^ int(simhash._ERRORS[simhash._LOW[w & 0xFFF] ^ simhash._HIGH[w >> 12]])
        assert (w ^ code).bit_count() <= 3 and code >> 11 == i
        assert book.setdefault(i, code) == code


def test_keys_meet_within_three_bits():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << i
        keys, owner = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    for where in itertools.combinations((0, 20, 21, 41, 42, 63), 3):
        pair = np.array([0, sum(1 << i for i in where)], np.uint64)
        keys, owner = simhash.keys_of(pair)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def slow_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = {}
    for key, fp in rows:
        prints.setdefault(fp, []).append(key)
    names = {fp: min(keys) for fp, keys in prints.items()}
    while True:
        changed = False
        for a, b in itertools.combinations(names, 2):
            if (a ^ b).bit_count() <= 3 and names[a] != names[b]:
                names[a] = names[b] = min(names[a], names[b])
                changed = True
        if not changed:
            return {key: names[fp] for key, fp in rows}


def test_rows(spark):
    rng = random.Random(3)
    vocabulary = ["the", "Of", "ünd", "a1", "x\x1cy", "İ", "zz z"]
    texts = [None, "", " \n\t", "one", "One two", "one  two", "ONE TWO three"]
    for _ in range(12):
        base = [rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 400))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 3))
            texts.append(rng.choice([" ", "\n", " \t "]).join(copy))
    rows = list(enumerate(texts, -2))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(5)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_digests(simhash.near_duplicates(docs)).collect()}
    names = brute([(k, slow_print(t)) for k, t in rows])
    assert found == {k: (f"{slow_print(t):016x}", names[k]) for k, t in rows}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_keys_are_dealt_out_whole(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for i in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << i
    signed = {fp: fp - (1 << 64) if fp >> 63 else fp for fp in prints}
    distinct = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    want = brute([(signed[fp], fp) for fp in prints])
    for block in (2, 8192):
        found = {r.node: r.component for r in components(simhash.links(distinct, block)).collect()}
        assert {x: found.get(x, x) for x in signed.values()} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 90)] + [(5, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300)]
    rng = random.Random(5)
    rng.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {**{i: 10 for i in range(11, 91)}, **{i: 5 for i in range(200, 260)}, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
