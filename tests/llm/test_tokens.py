"""Encoding, token store, packing and edit-aware counts against the tokenizer library."""

import random
import zlib

import numpy as np
import pytest

from floodlens.llm import edit_counts, encoding, packing, perfect_hash, token_store

DOCS = "doc_id long, text string"
TEXTS = [
    "", " ", "it's I'LL A'S 'Re''s !'s", "a  b\t\tc \n\n x\n", "x ²3½ á Élan ß Œuvre", "<|endoftext|> a <|startoftext|>", "日本語 text", "é combining",
    "\x1c control \xa0 nbsp \x85", "İstanbul ı", "«quoted» “text” – dash… €5", "tail   ", "\n\n\n", "word " * 3000, "𝔘nicode", "ǅ ǆ Ⅷ ⅷ",
]


@pytest.mark.parametrize("name", sorted(encoding.PIECES))
def test_encoder_equals_the_library(name):
    encoder = encoding.PieceEncoder(name, remembered=50)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab 'sSrEéÉ1²\n\t.,!<|") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for at in range(0, len(texts), 7):
        ids, counts = encoder.encode(texts[at:at + 7])
        ends = np.cumsum(counts)
        for text, end, n in zip(texts[at:at + 7], ends, counts):
            assert ids[end - n:end].tolist() == encoder.whole(text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**15, n, replace=False) - 5 * 10**14
    moves = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(keys, moves, n).tolist()) == list(range(n))


def stored(docs):
    encoder, at, out = encoding.PieceEncoder(token_store.TOKENIZER), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or "")):
        ids = np.array([*encoder.whole(text or ""), 0], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_store_round_trip(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(TEXTS)) for i in rng.sample(range(-500, 500), 120)] + [(7000, None), (7001, "twice"), (7001, "once"), (None, "no key"), (None, None)]
    manifest = token_store.write(spark.createDataFrame(docs, DOCS))
    have = [tuple(r) for r in token_store.read_back(manifest).orderBy("start").collect()]
    assert have == stored(docs)
    keys = [docs[0][0], docs[5][0], 7001, 10**9, -10**9, 501]
    found = token_store.look_up(manifest, spark.createDataFrame([(k,) for k in [*keys, None]], "doc_id long")).collect()
    encoder = encoding.PieceEncoder(token_store.TOKENIZER)
    want = sorted((i, [*encoder.whole(t or ""), 0]) for i, t in docs if i in keys)
    assert sorted((r.key, r.ids) for r in found) == want


def test_rows_without_key_and_of_one_key_fill_many_shards(spark):
    docs = [(None, f"{i % 97} text {i}") for i in range(400)] + [(7, f"{i % 89} other {i}") for i in range(400)] + [(i, "single") for i in range(20, 60)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be one shard
    try:
        manifest = token_store.write(spark.createDataFrame(docs, DOCS))
        assert manifest.agg({"rows": "max"}).first()[0] < 0.4 * len(docs)
        assert [tuple(r) for r in token_store.read_back(manifest).orderBy("start").collect()] == stored(docs)
        found = token_store.look_up(manifest, spark.createDataFrame([(7,), (25,), (8,)], "doc_id long")).collect()
        assert sorted(r.key for r in found) == [7] * 400 + [25]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_token_store_of_nothing(spark):
    manifest = token_store.write(spark.createDataFrame([], DOCS))
    assert manifest.count() == 0 and token_store.read_back(manifest).count() == 0


def sequences(counts, size):
    plan = packing.plan_slots(counts, size)
    held = {}
    for length in counts:
        own = plan[plan["length"] == length]
        for i, slot in enumerate(own):
            last = own["first"][i + 1] if i + 1 < len(own) else counts[length]
            for rank in range(int(slot["first"]), int(last)):
                k = rank - int(slot["first"])
                held.setdefault(int(slot["sequence"] + k // slot["each"]), []).append((int(slot["offset"] + k % slot["each"] * length), length))
    return held


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 2048])
    counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
    held = sequences(counts, size)
    assert sorted(held) == list(range(len(held)))
    assert sum(map(len, held.values())) == sum(counts.values())
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        room = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
        if room is None:
            bins.append(size)
            room = len(bins) - 1
        bins[room] -= length
    assert len(held) == len(bins)


def test_packing(spark):
    docs = [(1, None), (2, ""), (2, ""), (3, "word " * 5000), (None, "no id"), *((i, "some words here " * (i % 40)) for i in range(10, 200))]
    rows = packing.pack(spark.createDataFrame(docs, DOCS)).collect()
    encoder, want = encoding.PieceEncoder(packing.TOKENIZER), []
    for i, text in docs:
        ids = np.array([*encoder.whole(text or ""), 0], dtype="<u4")
        want += [(i, k, at, len(part := ids[at:at + 2048]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


FRAGMENTS = ["'", " ", "  ", "\n", "\n\n", "re", "s", "'re", " x", "\t\n ", "123", "!!", "é", "foo bar", "<|", "日", "a b c " * 200, "", "\n \n x", "it's"]


def test_edits_leave_exact_counts():
    encoder, rng = encoding.PieceEncoder(edit_counts.TOKENIZER), random.Random(9)
    for text in [*TEXTS, *("".join(rng.choice(FRAGMENTS) for _ in range(300)) for _ in range(30))]:
        tree = edit_counts.CountTree.of_text(text, encoder)
        for _ in range(8):
            start, length = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40])
            new = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 3)))
            place = min(start, len(text))
            want = text[:place] + new + text[place + length:]
            text, tree, _ = edit_counts.edit(text, tree, start, length, new, encoder)
            assert text == want and tree.n_tokens == len(encoder.whole(text)) and tree.chars[1] == len(text)


def test_a_small_edit_encodes_little():
    encoder = encoding.PieceEncoder(edit_counts.TOKENIZER)
    text = "some ordinary words in a row. " * 2000
    tree = edit_counts.CountTree.of_text(text, encoder)
    _, tree, encoded = edit_counts.edit(text, tree, 30_000, 4, "new", encoder)
    assert encoded <= 3 * edit_counts.LEAF


def test_edit_tables(spark):
    schema = "doc_id long, text string, tree string, n_tokens long, changes array<struct<start:int,length:int,text:string>>"
    rows = [(1, "hello there world", "x", 1, [(5, 6, None), (0, 0, "Oh, ")]), (2, None, None, None, [(3, 4, "new text")]), (3, "kept as is", None, 2, None),
            (3, "kept as is", None, 2, []), (4, "", None, 0, [None, (-5, -5, "a")]), (5, "long text " * 20_000, None, 0, [(100_000, 10, "")])]
    docs = edit_counts.with_trees(spark.createDataFrame(rows, schema))
    once = edit_counts.apply_edits(docs, "changes")
    have = {(r.doc_id, r.text): (r.n_tokens_before, r.n_tokens) for r in once.collect()}
    encoder = encoding.PieceEncoder(edit_counts.TOKENIZER)
    n = lambda t: len(encoder.whole(t)) if t else 0
    texts = {1: "Oh, hello world", 2: "new text", 3: "kept as is", 4: "a", 5: "long text " * 19_999}
    assert have == {(i, t): (n(dict((r[0], r[1]) for r in rows)[i]), n(t)) for i, t in texts.items()}
    twice = edit_counts.apply_edits(once.drop("n_encoded"), "changes").where("doc_id = 2").first()
    assert twice.text == "new" + "new text" + "t" and twice.n_tokens == n(twice.text)
    assert edit_counts.apply_edits(docs.limit(0), "changes").count() == 0
    clashing = edit_counts.apply_edits(docs.selectExpr("*", "1 as _edits", "2 as EDITS", "3 as edits_"), "changes")
    assert clashing.count() == docs.count() and {"_edits", "EDITS", "edits_"} <= set(clashing.columns)


def test_whole_encodings_count_their_ids():
    from floodlens.llm.encoding import PieceEncoder

    encoder = PieceEncoder(edit_counts.TOKENIZER)
    text = "some words \x01 and more of them " * 40
    assert not encoder.plain(text)
    after, tree, encoded = edit_counts.edit(text, edit_counts.CountTree.of_text(text, encoder), 5, 2, "other", encoder)
    assert encoded == tree.n_tokens == len(encoder.whole(after)) > 40
