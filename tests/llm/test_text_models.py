"""Edit-aware counts and n-best segmentation against plain recomputation."""

import heapq
import itertools
import random

import public_tokenizers as public
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm.piece_nbest import SPACE, lattice
from millrace.llm.queries import op3_edit_token_counts, op7_piece_nbest
from millrace.llm.token_trees import TokenTree, apply_edits, count_trees, sample_edits, splitter

RANKS, MODEL = public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()


def test_edits_equal_recounting(texts):
    own, rng = splitter(RANKS, public.PATTERN), random.Random(3)
    parts = ["", " ", "  ", "\n", "'", "'re", "s", "x", "12", " word", "é", "!?", "日本", "'v", "e", "   y"]
    for text in ["", "a", " ", "don't  stop\n\n now   ", *texts[:40]]:
        tree = TokenTree(own, text)
        for _ in range(25):
            at, delete, insert = rng.randint(0, len(text)), rng.choice([0, 0, 1, 2, 5, 300]), "".join(rng.choices(parts, k=rng.randint(0, 4)))
            text = text[:at] + insert + text[at + delete :]
            tree.edit(at, delete, insert)
            assert tree.text == text
            lengths, counts = own.split(text)
            assert tree.pieces() == (lengths, counts)
            assert tree.tokens == len(own.encoding.encode_ordinary(text))


def test_edits_touch_little(texts):
    text = max(texts, key=len)
    tree = TokenTree(splitter(RANKS, public.PATTERN), text)
    tree.edit(len(text) // 2, 3, "new words")
    assert tree.encoded < 200 < len(text)


def test_op3(spark, sf_dir, texts):
    own = splitter(RANKS, public.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edits = {r.doc_id: r.e for r in docs.select("doc_id", sample_edits().alias("e")).collect()}
    plain = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = op3_edit_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(plain)
    for r in rows:
        text = plain[r.doc_id]
        assert r.n_tokens == len(own.encoding.encode_ordinary(text))
        for e in edits[r.doc_id]:
            at = min(e.at, len(text))
            text = text[:at] + e.insert + text[at + e.delete :]
        assert (r.n_chars, r.n_tokens_edited) == (len(text), len(own.encoding.encode_ordinary(text)))


def test_stored_trees_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "x")], "doc_id long, text string")
    trees = count_trees(docs, RANKS, public.PATTERN)
    edits = "case doc_id when 3 then array(named_struct('at', 99L, 'delete', 5L, 'insert', ' more'), null) when 1 then array(named_struct('at', -4L, 'delete', 2L, 'insert', string(null))) end as edits"
    rows = {(r.doc_id, r.text): r for r in apply_edits(trees.selectExpr("*", edits), RANKS, public.PATTERN).collect()}
    assert rows[3, "some words here more"].n_tokens == 4 and rows[1, ""].n_tokens == 0 and rows[None, "x"].n_tokens == 1
    assert count_trees(docs.limit(0), RANKS, public.PATTERN).count() == 0


def _all_ways(own, text):
    if not text:
        return [(0.0, ())]
    out = []
    for e in range(1, len(text) + 1):
        found = own.prefixes.get(text[:e])
        if found:
            out += [(found[1] + s, (found[0], *i)) for s, i in _all_ways(own, text[e:])]
    if not own.prefixes.get(text[0]):
        out += [(own.unknown + s, (*[own.byte_ids[b] for b in text[0].encode()], *i)) for s, i in _all_ways(own, text[1:])]
    return out


@pytest.mark.parametrize("text", ["the cat", "a  b c", "l'été", "日x ☃", "aaaaaa", "in the", "\U0001f600ab"])
def test_n_best_equals_brute_force(text):
    own = lattice(MODEL)
    whole = SPACE + text.replace(" ", SPACE)
    ways = sorted((s for s, _ in _all_ways(own, whole)), reverse=True)
    ids, scores, changed = own.encode(text, 6)
    assert scores == pytest.approx(ways[:6], abs=1e-9)
    assert own.decode(ids) == text
    assert len({tuple(sorted(c.items())) for c in changed}) == len(scores)
    found = own.n_best(whole, 6)
    assert [s for s, _ in found] == pytest.approx(ways[:6], abs=1e-9) and len({i for _, i in found}) == len(found)
    (many, total, loss), long = next(own.best_of_many([whole])), own._best_and_loss(whole)
    second = ways[0] - ways[1] if len(ways) > 1 else float("inf")
    assert total == pytest.approx(ways[0]) == long[1] and loss == pytest.approx(second, abs=1e-9) == long[2] and many == long[0]


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(data):
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag, size = number(), number()
        yield tag, data[at : at + size]
        at += size


def _as_unigram(own):
    """The library's unigram model of the same pieces and scores: later fields of a message override earlier ones."""
    import struct

    out, i = bytearray(), 0
    for tag, body in _fields(open(MODEL, "rb").read()):
        if tag == 10:  # a piece
            if own.usual_score(i) is not None:
                body += b"\x15" + struct.pack("<f", own.usual_score(i))
            i += 1
        out += _varint(tag) + _varint(len(body)) + body
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out + b"\x12\x02\x18\x01"))


def _four_best(own, text):
    """The four best sums over the whole lattice: four for each prefix, without chunks."""
    best = [[0.0], *[[] for _ in text]]
    for e in range(1, len(text) + 1):
        ways = []
        for s in range(max(0, e - own.longest), e):
            found = own.prefixes.get(text[s:e])
            if found or e - s == 1:
                ways += [x + (found[1] if found else own.unknown) for x in best[s]]
        best[e] = heapq.nlargest(4, ways)
    return best[-1]


def test_op7(spark, sf_dir):
    """Every row of the query against the library's unigram model of the same scores."""
    import hashlib

    own = lattice(MODEL)
    library = _as_unigram(own)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def score(ids):
        total = 0.0
        for i in (i for i in ids if i > 2):  # the library may add control pieces
            if own.bytes[i] < 0:
                total += own.usual_score(i)
            elif own.bytes[i] < 128 or own.bytes[i] >= 192:  # the first byte of a character
                total += own.unknown
        return total

    rows = op7_piece_nbest(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    checked = 0
    for r in rows:
        text = docs[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert all(a >= b for a, b in itertools.pairwise(r.scores)) and r.n_found == len(r.scores)
        theirs = library.encode(text)
        assert r.scores[0] == pytest.approx(score(theirs), abs=1e-3 + 1e-6 * len(text))
        mine, scores, _ = own.encode(text, 4)
        assert scores == list(r.scores) and score(mine) == pytest.approx(r.scores[0]) and r.n_pieces == len(mine)
        short = text[:60]  # the library's search gives up on long texts
        theirs = sorted({tuple(x) for x in library.nbest_encode(short, nbest_size=4)}, key=score, reverse=True)
        assert own.encode(short, 4)[1] == pytest.approx([score(x) for x in theirs], abs=1e-3)
        if len(text) < 1500:
            assert scores == pytest.approx(_four_best(own, SPACE + text.replace(" ", SPACE)), abs=1e-6)
            checked += 1
    assert checked > 300


def test_op7_odd_texts(spark):
    from millrace.llm.piece_nbest import encode_n_best

    texts = [None, "", " ", "▁", "a▁b ▁", "x" * 100_000, "no space " * 20_000, "\n\t\x00é", "same words", "same words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = {r.doc_id: r for r in encode_n_best(df, MODEL).collect()}
    assert [rows[k].decoded for k in range(len(texts))] == [t or "" for t in texts]
    assert list(rows[0].ids) == list(rows[1].ids) == [] and list(rows[0].scores) == [0.0]
    assert rows[8].ids == rows[9].ids and rows[8].scores == rows[9].scores
    assert encode_n_best(df.limit(0), MODEL).count() == 0
