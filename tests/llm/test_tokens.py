import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import edit_counts, packing, token_store
from linkloom.llm.common import scratch_path
from linkloom.llm.encoding import Counter, Encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
CACHED = {p: Encoder(p) for p in (BYTE, WORD)}
TEXTS = AWKWARD + [(100 + i, prose(40 * i, i)) for i in range(12)]


def plain(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '\n\t .1Aé́Σs\x1c\x85 ​<|>") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_cached_encoding_is_the_librarys(path, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in CACHED[path].ids(texts)] == [plain(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_of_prose(path):
    texts = [t for _, t in TEXTS]
    assert [np.frombuffer(b, "<u4").tolist() for b in CACHED[path].ids(texts)] == [plain(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_of_every_latin_character(path):
    texts = [f"{before}{chr(c)}{after}" for c in range(0x300) for before in ("", " ", "a", "x\n") for after in ("", "b", "!", "'s", "...")]
    for codec in (Encoder(path), Encoder(path, 40)):
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in codec.ids(texts)] == [plain(path, t) for t in texts]
            assert len(codec.known) <= max(1, codec.known.half) and len(codec.known.older) <= max(1, codec.known.half)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_of_white_space(path):
    texts = ["".join(t) for n in range(8) for t in itertools.product("a \n", repeat=n)]
    texts += ["".join(t) for n in range(6) for t in itertools.product("a. \n\t", repeat=n)]
    assert [np.frombuffer(b, "<u4").tolist() for b in CACHED[path].ids(texts)] == [plain(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_full_cache_makes_no_text_dearer(path):
    """What earlier texts have filled takes up new words, and a word is not encoded again for each mark beside it."""
    told = []

    class Told:
        def __init__(self, own):
            self.own = own

        def encode(self, text, **options):
            told.append(len(text))
            return self.own.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            told.extend(map(len, texts))
            return self.own.encode_batch_fast(texts, **options)

        def tokenize(self, text):
            told.append(len(text))
            return self.own.tokenize(text)

    def words(first, n):
        return ["".join(chr(97 + int(d)) for d in str(k)) for k in range(first, first + n)]

    def cost(text):
        told.clear()
        assert [np.frombuffer(b, "<u4").tolist() for b in codec.ids([text])] == [plain(path, text)]
        return sum(told)

    codec = Encoder(path, 4000)
    codec.model, codec.tokenizer = Told(codec.tokenizer.model), Told(codec.tokenizer)
    cost(" ".join(words(100_000, 5000)))
    own = words(200_000, 500)
    assert cost(" ".join(own)) >= 3000
    assert [cost(mark.join(own)) < 100 for mark in (" ", ", ", "; ", " ")] == [True] * 4


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '\n\t .1Aé́Σs\x1c\x85 ​<|>") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_counts_are_the_librarys(path, texts):
    assert Counter(path, pieces=3)(texts) == [len(plain(path, t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" 's,._`~é×÷ªºǄ") | st.characters(max_codepoint=0x2FF), max_size=12), max_size=4))
def test_counts_of_words_by_the_model_alone(texts):
    assert Counter(BYTE)(texts) == [len(plain(BYTE, t)) for t in texts]


def test_counts_of_every_latin_character():
    texts = [f"{before}{chr(c)}{after}" for c in range(0x300) for before in ("", " ", "a") for after in ("", "b", "!", "'s")]
    assert Counter(BYTE)(texts) == [len(plain(BYTE, t)) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts_of_prose(path, monkeypatch):
    monkeypatch.setattr("linkloom.llm.encoding.COUNTED_PIECE_CHARS", 1000)
    texts = [t or "" for _, t in TEXTS]
    for count in (Counter(path), Counter(path, pieces=40), Counter(path, chars=60)):
        for _ in range(2):
            assert count(texts) == [len(plain(path, t)) for t in texts]
            assert len(count.newer) < count.pieces and count.held < count.chars


def test_token_store_round_trip(spark):
    out = scratch_path(spark, "test-store")
    token_store.write(documents(spark, TEXTS, extra=True), out, WORD, shard_bytes=2000)
    rows = token_store.read(spark, out).collect()
    rows.sort(key=lambda r: r.start)
    want, start = [], 0
    for d, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*plain(WORD, t), 2]
        want.append((d, start, len(ids), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == want
    store = token_store.TokenStore(spark, out)
    assert len(store.shards) > 3
    for d in {d for d, _ in TEXTS if d is not None}:
        assert sorted(store.get(d)) == sorted(ids for k, _, _, ids in want if k == d)
    assert store.get(-5) == store.get(50) == store.get(10**15) == []


def test_a_wrong_index_is_not_read_past(spark):
    """Rows come through the index: a slot that is not its key's ends the read."""
    from linkloom.scratch import qualified

    out = qualified(spark, scratch_path(spark, "test-broken"))
    token_store.write(documents(spark, [(k, f"text {k}") for k in range(50)]), out, WORD)
    files, root = token_store._filesystem(out)
    shard = token_store.manifest(spark, out).first()
    path = f"{root}/shards/{shard.file}.mph"
    with files.open_input_file(path) as f:
        data = f.read()
    head = token_store.HEADER.unpack_from(data)
    at = token_store.HEADER.size + 8 * head[6]  # the first fingerprint
    with files.open_output_stream(path) as f:
        f.write(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
    with pytest.raises(Exception, match="does not lead to 1 of its keys"):
        token_store.read(spark, out).collect()


def test_many_rows_of_one_key(spark):
    docs = [(7, f"row {k % 40}") for k in range(300)] + [(8, "other")]
    out = scratch_path(spark, "test-hot")
    token_store.write(documents(spark, docs).repartition(6), out, WORD, shard_bytes=200)
    rows = token_store.read(spark, out).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((d, len(plain(WORD, t)) + 1) for d, t in docs)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    store = token_store.TokenStore(spark, out)
    assert sorted(store.get(7)) == sorted([*plain(WORD, t), 2] for d, t in docs if d == 7) and len(store.get(8)) == 1


LONG = " ".join(f"{w} line{k}" for k in range(30) for w in prose(5000, 70).split()) + "\n" + "z" * 300_000


def test_very_long_text(spark):
    """More than two MB in one document, in every operator of this file."""
    assert len(LONG) > 2_000_000
    docs = documents(spark, [(1, "short"), (2, LONG)])
    ids = plain(WORD, LONG)
    out = scratch_path(spark, "test-long")
    token_store.write(docs, out, WORD)
    row = token_store.read(spark, out).where("doc_id = 2").first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*ids, 2]
    ids = [*plain(BYTE, LONG), 0]
    rows = packing.pack(docs, BYTE).where("doc_id = 2").orderBy("start").collect()
    assert [y for r in rows for y in np.frombuffer(r.ids, "<u4").tolist()] == ids
    edits = "from_json('[{\"pos\": 5, \"del\": 3, \"ins\": \"new\"}, {\"pos\": 1500000, \"del\": 20, \"ins\": \" words\"}]', 'array<struct<pos:bigint,del:bigint,ins:string>>')"
    found = edit_counts.edited_counts(docs.selectExpr("*", f"{edits} AS edits"), BYTE).where("doc_id = 2").first()
    text = LONG[:5] + "new" + LONG[8:]
    text = text[:1_500_000] + " words" + text[1_500_020:]
    assert found.tokens_before == len(ids) - 1 and found.tokens_after == len(plain(BYTE, text)) and found.text_crc32 == zlib.crc32(text.encode())


def test_shards_end_after_so_many_documents(spark):
    """Documents of one id each fill shards by their number; every key is found in its own."""
    docs = [(k, None) for k in range(1000)] + [(None, "")] * 5
    out = scratch_path(spark, "test-short")
    token_store.write(documents(spark, docs).coalesce(1), out, WORD, shard_docs=90)
    shards = token_store.manifest(spark, out).collect()
    assert max(s.n_docs for s in shards) == 90 and sum(s.n_docs for s in shards) == 1005
    rows = token_store.read(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 5 + list(range(1000)) and {r.n_tokens for r in rows} == {1}
    store = token_store.TokenStore(spark, out)
    assert all(store.get(k) == [[2]] for k in (0, 89, 90, 500, 999)) and store.get(1000) == []


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    seed, shift, slots, marks = token_store.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_empty_tables(spark):
    empty = documents(spark, [])
    out = scratch_path(spark, "test-empty")
    token_store.write(empty, out, WORD)
    assert token_store.read(spark, out).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert edit_counts.edited_counts(empty.selectExpr("*", "null AS edits"), BYTE).count() == 0


def test_packing(spark):
    rows = packing.pack(documents(spark, TEXTS, extra=True), BYTE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == 1 << r.bucket <= 1024 and len(r.ids) == 4 * r.length for r in rows)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for d, t in TEXTS:
        ids = [*plain(BYTE, t), 0]
        own = sorted(got[d], key=lambda r: r.start)
        times = sum(x == d for x, _ in TEXTS)
        assert all(r.doc_tokens == len(ids) for r in own)
        pieces = own[::times]
        assert [y for r in pieces for y in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert sum(r.length for r in own) == times * len(ids)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert all(len({r.length for r in own}) == 1 and min(r.sequence_id for r in own) == k for k, own in batches.items())
    assert all(len(own) * own[0].length <= packing.BATCH_TOKENS for own in batches.values())
    digest = packing.digests(packing.pack(documents(spark, TEXTS), BYTE)).where("doc_id = 9").orderBy("start").collect()
    ids = [*plain(BYTE, "word " * 3000), 0]
    assert [r.ids_crc32 for r in digest] == [crc(ids[r.start : r.start + r.length]) for r in digest]


def test_buckets_are_batches_of_equal_shape(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", 64)
    docs = [(k, prose(3 + k, k)) for k in range(40)]
    pieces = packing.pack(documents(spark, docs).coalesce(1), BYTE)
    path = scratch_path(spark, "test-buckets")
    packing.write_buckets(pieces, path)
    total = 0
    for k in range(11):
        found = packing.batches(spark, path, 1 << k).collect()
        assert all(len(b.ids) == 4 * b.n << k for b in found)
        full = [b for b in found if b.n == max(1, 64 >> k)]
        assert len(found) - len(full) <= 1  # only the last batch of a length is not full
        total += sum(len(b.ids) // 4 for b in found)
    assert total == sum(len(plain(BYTE, t)) + 1 for _, t in docs)


@settings(max_examples=150, deadline=None)
@given(
    st.text(st.sampled_from("ab c\n.'1é "), max_size=400),
    st.lists(st.tuples(st.integers(-2, 450), st.integers(-1, 90), st.text(st.sampled_from("xy \n1'"), max_size=30)), max_size=8),
)
def test_edited_counts_equal_full_counts(text, edits):
    count = lambda spans: [len(plain(BYTE, s)) for s in spans]
    tree = edit_counts.TokenTree(text, count, least=16)
    assert tree.tokens[1] == len(plain(BYTE, text))
    for pos, cut, ins in edits:
        p = min(max(pos, 0), len(text))
        text = text[:p] + ins + text[p + max(cut, 0) :]
        tree.edit(pos, cut, ins)
        assert tree.text() == text and tree.chars[1] == len(text)
        assert tree.tokens[1] == len(plain(BYTE, text))


def test_insertions_at_one_place_stay_cheap():
    count = lambda spans: [len(s.split()) for s in spans]
    tree = edit_counts.TokenTree(prose(2000, 1), count, least=64)
    cost = []
    for k in range(600):
        before = tree.reencoded
        tree.edit(5000, 0, f" inserted words number {k}")
        cost.append(tree.reencoded - before)
    assert max(cost[300:]) <= 1.2 * max(cost[:300]) and max(cost) < 4000
    assert tree.tokens[1] == len(tree.text().split())


def test_edits_encode_no_word_of_their_text_again():
    """A cache that earlier texts have filled makes neither a text nor its edits dearer."""

    class Told:
        def __init__(self, own):
            self.own, self.pieces = own, 0

        def encode_batch_fast(self, pieces, **options):
            self.pieces += len(pieces)
            return self.own.encode_batch_fast(pieces, **options)

    def rows(k):
        """Twenty documents of a thousand words that no other document has."""
        texts = [" ".join(f"w{d}x{i}" for i in range(1000)) for d in range(20 * k, 20 * k + 20)]
        edits = [(100, 0, " and more words,\nthen"), (3000, 40, ""), (5500, 7, "edited")]
        return [(None, t, edits, None) for t in texts]

    count = Counter(BYTE, pieces=30_000)
    count.codec = Encoder(BYTE)
    told = count.codec.tokenizer = Told(count.codec.tokenizer)
    cost = []
    for k in range(4):
        before = told.pieces
        for (_, text, edits, _), (tree, tokens) in zip(rows(k), edit_counts._edited(rows(k), count, 512)):
            assert tokens == len(plain(BYTE, text))
            for pos, cut, ins in edits:
                text = text[:pos] + ins + text[pos + cut :]
            assert tree.text() == text and tree.tokens[1] == len(plain(BYTE, text))
        cost.append(told.pieces - before)
    assert all(20_000 <= c <= 20_000 + 20 * 3 * 8 for c in cost)


def test_edit_query_reencodes_little(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, TEXTS, extra=True)
    kept = edit_counts.trees(docs, BYTE)
    scripted = docs.select("doc_id", "text", edit_counts.scripted_edits(F.col("doc_id"), F.col("text")).alias("edits"))
    rows = edit_counts.edited_counts(scripted, BYTE).collect()
    own = scripted.where("doc_id > 100").join(kept, "doc_id")
    again = edit_counts.edited_counts(own.withColumn("tree", F.struct("leaf_tokens", "signature")), BYTE, kept="tree").collect()
    assert sorted(r for r in rows if (r.doc_id or 0) > 100) == sorted(again)
    # what was kept for another text, or for other leaves, is not used; a column of that name alone means nothing
    for stale in ("struct(array(7L, 9L) AS leaf_tokens, signature)", "struct(leaf_tokens, 5L AS signature)", "null"):
        table = own.withColumn("tree", F.expr(stale).cast("struct<leaf_tokens:array<long>,signature:long>"))
        assert sorted(edit_counts.edited_counts(table, BYTE, kept="tree").collect()) == sorted(again)
    assert sorted(edit_counts.edited_counts(own.withColumn("leaf_tokens", F.lit("x")), BYTE).collect()) == sorted(again)
    edits = {(r.doc_id, r.text): r.edits for r in scripted.collect()}
    want = []
    for (d, t), es in edits.items():
        text = t or ""
        before = len(plain(BYTE, text))
        for e in es:
            text = text[: e["pos"]] + e["ins"] + text[e["pos"] + e["del"] :]
        want.append((d, before, len(plain(BYTE, text)), len(text), zlib.crc32(text.encode())))
    assert {(r.doc_id, r.tokens_before, r.tokens_after, r.chars_after, r.text_crc32) for r in rows} == set(want)
    assert any(r.doc_id == 9 and r.reencoded_chars < 0.5 * r.chars_after for r in rows)
