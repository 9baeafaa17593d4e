"""Exact dedup, SimHash near-dedup, substring dedup and components against brute force, and their defined results."""

import hashlib
import random

import pytest
import xxhash

from floodlens.llm import exact_dedup, paragraph_dedup, simhash
from floodlens.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(edges, nodes):
    """Smallest member of the component of each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(70)]
    edges += [(None, 3), (7, 7)]
    have = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert have == groups(real, {n for e in real for n in e})


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


EDGE_ROWS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "A b"), (5, "a b "), (None, "only"), (6, "x " * 50_000), (7, "x " * 50_000)]


def test_exact_dedup_decisions(spark):
    have = sorted(map(repr, exact_dedup.exact_dedup(table(spark, EDGE_ROWS)).collect()))
    by = {}
    for i, t in EDGE_ROWS:
        by.setdefault(t or "", []).append(i)
    want = []
    for i, t in EDGE_ROWS:
        own = by[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    names = "doc_id={!r}, keep_id={!r}, group_size={!r}, kept={!r}, text_sha256={!r}"
    assert have == sorted("Row(" + names.format(*w) + ")" for w in want)


def test_exact_dedup_keeps_one_row_and_all_columns(spark):
    docs = table(spark, EDGE_ROWS).selectExpr("*", "1 as id", "2 as digest", "'r' as row", "3 as keep_id", "4 as n")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in EDGE_ROWS})
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_index_takes_batches(spark):
    index = exact_dedup.DigestIndex.fresh(spark, buckets=3)
    index.append(table(spark, [(1, "a"), (2, "b"), (9, "a")]))
    index.append(table(spark, [(10, "a"), (11, "c"), (12, None)]))
    index.append(table(spark, []))
    rows = {r.text_sha256: (r.keep_id, r.group_size) for r in index.decide(table(spark, [(10, "a"), (11, "c"), (12, "")])).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {sha("a"): (10, 3), sha("c"): (11, 1), sha(""): (12, 1)}  # counts and ids of the later batch too
    again = exact_dedup.DigestIndex(spark, index.path, index.name, buckets=3)
    for _ in range(2):  # the same batch twice, as after a failure, counts once
        again.append(table(spark, [(13, "d"), (14, "b"), (1, "a")]), batch="third")
    entries = {r.keep_id: r.group_size for r in again.entries().collect()}
    assert entries == {10: 4, 11: 1, 12: 1, 13: 1, 14: 2}
    # The anti-join left out what the index knew: one row per digest.
    assert spark.table(index.name).count() == spark.table(index.name).select("digest").distinct().count() == 5


def test_batches_decide_like_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["x", "y", "", None, *(f"t{i}" for i in range(30))])) for _ in range(150)]
    one, many = (sorted(map(repr, exact_dedup.exact_dedup(table(spark, rows), batches=n).collect())) for n in (1, 4))
    assert one == many
    kept = [sorted(((r.doc_id, r.text or "") for r in exact_dedup.drop_exact_copies(table(spark, rows), batches=n).collect()), key=repr) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == len({t or "" for _, t in rows})


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two Words", "É É é", "a b c", "a b c d e f g a b c", "x\x0by\x0cz\x85w\xa0v " * 9, "to be " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_links_join_all_near_fingerprints(spark, crowd):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for _ in range(30)}
        chain = base
        for _ in range(6):
            chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(chain)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd=crowd)
    have = {r.node: r.component for r in connected_components(links).collect()}
    keys = sorted(signed)
    want = groups([(a, b) for i, a in enumerate(keys) for b in keys[:i] if (signed[a] ^ signed[b]).bit_count() <= 2], keys)
    assert {k: have.get(k, k) for k in keys} == want


def test_near_dedup_defined_results(spark):
    rows = [(1, None), (2, " "), (3, "a b c d"), (3, "a b c d"), (9, "A b c D"), (None, "a b c d"), (4, "quite another text here"), (None, "lonely one")]
    have = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(table(spark, rows)).collect()}
    want = {1: 1, 2: 1, 3: 3, 9: 3, 4: 4}
    assert have == {(i, f"{slow_fingerprint(t):016x}", want.get(i, 3 if t == "a b c d" else None)) for i, t in rows}
    assert simhash.near_dedup(table(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Decided by row: rows are told apart by id and text, also where an id repeats or lacks."""
    rng = random.Random(9)
    base = words(rng, 400)
    copies = [" ".join([*base[:k], "other", *base[k + 1:]]) for k in (0, 150, 399)]
    clean = [" ".join(words(rng, 60)) for _ in range(3)]
    rows = [(7, " ".join(base)), (7, clean[0]), (8, copies[0]), (8, clean[1]), (None, copies[1]), (9, copies[2]), (None, clean[2]), (None, clean[2]),
            (3, None), (4, " "), (4, " "), (5, "A b"), (5, "A b"), (6, "a B")]
    docs = table(spark, rows).selectExpr("*", "1 as fp", "2 as class", "3 as text_key", "4 as none", "'r' as row", "5 as first")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    prints = {r: slow_fingerprint(r[1]) for r in set(rows)}
    own = sorted(prints, key=lambda r: (r[0] is None, r[0] or 0))
    near = groups([(a, b) for a in range(len(own)) for b in range(a) if (prints[own[a]] ^ prints[own[b]]).bit_count() <= 2], range(len(own)))
    want = [own[k] for k in near if near[k] == k]
    assert len(want) < len(own) - 2
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.keep_one_of_each(table(spark, [])).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def repeats(spark):
    rng = random.Random(2)
    passage = " ".join(words(rng, 60))
    near = words(rng, 80)
    docs = {i: " ".join(words(rng, 40)) + "\n" + " ".join(words(rng, 90)) for i in range(40)}
    docs[5] += " " + passage + " " + " ".join(words(rng, 30))
    docs[17] = " ".join(words(rng, 25)) + " " + passage.upper() + " " + docs[17]
    docs[23] = docs[23] + "\n" + passage
    docs[8] += "\n" + " ".join(near)
    docs[30] += "\n" + " ".join([*near[:40], "changed", *near[41:]])
    docs[31] = "short line here\n" + docs[31]
    docs[32] = "short line here\n" + docs[32]
    return docs, passage, near


def test_substring_dedup_finds_planted_repeats_only(spark):
    docs, passage, near = repeats(spark)
    spans = paragraph_dedup.repeated_spans(table(spark, [*docs.items(), (None, passage), (50, None), (51, ""), (5, docs[5])])).collect()
    by = {}
    for s in spans:
        by.setdefault(s.doc_id, []).append(docs.get(s.doc_id, passage)[s.start:s.start + s.length])
    assert set(by) == {17, 23, 30, None}
    lone = paragraph_dedup.repeated_spans(table(spark, [(None, " ".join([*near[:9], "other", *near[10:]])), (8, " ".join(near))])).collect()
    assert [(s.doc_id, s.keep_id, s.n_words) for s in lone] == [(None, 8, 80)]
    for i in (17, 23, None):
        assert all(text.lower() in passage for text in by[i]) and max(len(t.split()) for t in by[i]) >= 35
    assert by[30] == [docs[30].split("\n")[-1]]
    assert {s.keep_id for s in spans} == {5, 8}
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.remove_repeats(table(spark, docs.items())).collect()}
    assert all(cleaned[i] == docs[i] for i in docs if i not in (17, 23, 30))
    assert cleaned[30] == docs[30][:-len(docs[30].split("\n")[-1])]


def test_substring_dedup_ties_a_crowd(spark):
    """Near copies of one line, more than the centres of a band, end in one class."""
    rng = random.Random(4)
    base = words(rng, 120)
    docs = []
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(120), 1):
            own[at] = words(rng, 1)[0]
        docs.append((i, " ".join(own)))
    spans = paragraph_dedup.repeated_spans(table(spark, docs)).collect()
    whole = {s.doc_id for s in spans if s.n_words == 120 and s.keep_id == 0}
    assert len(whole) >= 57


def test_substring_dedup_of_nothing(spark):
    assert paragraph_dedup.repeated_spans(table(spark, [])).count() == 0


def test_substring_dedup_finds_every_near_pair_of_lines_with_boilerplate(spark):
    """Hundreds of different lines crowd in the bands of their common wording; the near pairs among them are found."""
    rng = random.Random(11)
    common, docs, pairs = words(rng, 100), {}, 0
    for i in range(300):
        own = common + words(rng, 20)
        docs[2 * i] = " ".join(own)
        if i % 2:
            pairs += 1
            docs[2 * i + 1] = " ".join(own[:-11] + words(rng, 11))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = {i: c for i, c in groups(links, ids).items() if c != i}
    assert pairs <= len(want) < 200
    whole = {s.doc_id: s.keep_id for s in paragraph_dedup.repeated_spans(table(spark, docs.items())).collect() if s.n_words == 120}
    assert sum(whole.get(i) is not None for i in want) >= 0.97 * len(want)
