"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat, warc
from millrace.llm.cover_tree import cover_paths, dual_traversal, near_vectors
from millrace.llm.fm_index import FmIndex
from millrace.llm.jaccard import jaccard_classes, keep_one_of_each
from millrace.llm.line_dedup import drop_shared_lines, line_digests
from millrace.llm.packing import cutting_patterns, packed_documents
from millrace.llm.piece_nbest import n_best_digests
from millrace.llm.quality import cascade, keep_good, quality_verdicts
from millrace.llm.shared import new_path
from millrace.llm.substring_dedup import drop_repeated_passages, passage_digests

WORDS = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    passage = " ".join(f"word{rng.randint(0, 999)}" for _ in range(60))
    line = "A line that is long enough to count as shared, ÄÖÜ."
    rows = [(1, None), (2, ""), (3, "   \t "), (4, passage), (4, passage), (5, passage + " and more"), (6, None), (None, passage), (None, None), (7, "one two"), (8, "one two"), (9, "x" * 200_000), (10, "aaa " * 30_000)]
    rows += [(20 + k, f"{line}\nown text of number {k}\n{line.upper() if k % 2 else line} ") for k in range(7)]
    names = ["id", "tag", "row", "n_words", "n_lines", "kept", "token", "component_id", "sequence_id", "packed"]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])


OPERATORS = {
    "line_digests": line_digests,
    "drop_shared_lines": drop_shared_lines,
    "jaccard_classes": jaccard_classes,
    "quality_verdicts": quality_verdicts,
    "cascade": cascade,
    "drop_repeated_passages": drop_repeated_passages,
    "passage_digests": passage_digests,
    "n_best": lambda d: n_best_digests(d, public.path("piece_bpe_32k.model")),
    "keep_good": keep_good,
    "keep_one": keep_one_of_each,
    "packed": lambda d: packed_documents(d, WORDS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(name, odd):
    got, n = OPERATORS[name](odd).count(), odd.count()
    assert got <= n if name.startswith("keep") else got >= n if name == "packed" else got == n
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_lines_of_odd_rows(odd):
    rows = {r.doc_id: r for r in line_digests(odd).where("doc_id is not null").collect()}
    assert (rows[1].n_lines, rows[1].n_dropped) == (1, 0)
    assert [rows[20 + k].n_dropped for k in range(7)] == [2] * 6 + [0]
    assert rows[20].kept_sha256 == hashlib.sha256(b"own text of number 0").hexdigest()


def test_passages_of_odd_rows(odd):
    rows = drop_repeated_passages(odd).collect()
    lost = collections.defaultdict(list)
    for r in rows:
        lost[r.doc_id].append(r.n_removed)
    assert lost[4] == [60, 60] and lost[5] == [60] and sorted(lost[None]) == [0, 0]
    assert [r.text for r in rows if r.doc_id == 5] == ["and more"] and lost[10] == [0] and lost[7] == lost[8] == [0]


def test_classes_of_odd_rows(odd):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(odd).collect()}
    assert rows[1] == (0, 1) and rows[7] == (1, 7) and rows[8] == (1, 7) and rows[4] == (58, 4) and rows[5] == (60, 4) and rows[10] == (1, 10)


@pytest.mark.parametrize("segment_bytes", [300, 5000])
def test_warc_round_trip(spark, segment_bytes):
    rng = random.Random(1)
    long = "".join(rng.choices("abé\r\n0 ", k=30_000))
    rows = [(1, "u", None), (2, "u\r\nX: y", ""), (3, None, long), (5, "u", long), (4, "u", "WARC/1.1\r\n\r\n\r\n"), (6, "u", long + "x"), (6, "u", long + "x"), (None, "u", "only"), (7, "u", "0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path, segment_bytes=segment_bytes, chunk_bytes=100)
    read = warc.read_archives(spark, path)
    back = read.collect()
    assert all(r.fault is None for r in back) and len(back) == len(rows)
    payloads = collections.Counter(bytes(r.payload) for r in back if r.record_type == "response")
    assert payloads == collections.Counter(x.encode() for x in ("", long, "WARC/1.1\r\n\r\n\r\n", long + "x", long + "x", "only", "0\r\n\r\n"))
    facts = collections.Counter((r.payload_bytes, r.payload_digest) for r in warc.with_payload_facts(read).collect())
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert facts == collections.Counter((len(x), digest(x)) for x in ((r[2] or "").encode() for r in rows))
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_faults():
    whole = warc._HTTP + warc.chunked(b"some payload", 4)
    parts = [{"segment": 1, "total": None, "block": whole[:50]}, {"segment": 2, "total": len(whole), "block": whole[50:]}]
    assert warc._whole(parts[::-1]) == (b"some payload", None)
    assert warc._whole(parts[1:]) == (None, "segment missing")
    assert warc._whole([parts[0], parts[1] | {"total": 7}]) == (None, "total length")
    assert warc._payload(whole[:-9])[1] == "framing"


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a ### User: </turn>\\\\"},{"content":"##","role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}',
        '{"prompt":"p","completion":"c"}',
        '{"output":"o","instruction":"i"}',
        '{"instruction":"i","input":"n","output":"o"}',
        '{"other":1}',
        "no json",
        None,
        '{"prompt":null,"completion":"c"}',
    ]
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(records)], "conv_id long, record string, layout string")
    got = chat.format_turns(chat.canonical_turns(df)).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).orderBy("conv_id").collect()
    assert [r.layout for r in got] == ["messages", "conversations", "prompt", "instruction", "instruction_input", None, None, None, "prompt"]
    for r in got:
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns or []]
    assert [r.loss for r in got] == ["##", "r", "c", "o", "o", "", "", "", "c"]


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (1, 1, None, "a"), (None, 0, "assistant", "x"), (2, None, "a: b", ": "), (3, 0, "x:", "### "), (3, 1, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\n\na\n\na\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"a: b\n: \n").hexdigest() and got[None].loss_chars == 1
    assert got[3].turns_sha256 == hashlib.sha256(b"x:\n### \nassistant\n\\\n").hexdigest() and got[3].loss_sha256 == hashlib.sha256(b"\\").hexdigest()
    assert chat.chat_digests(df.limit(0)).count() == 1


def test_packing_against_tokenizer(spark, sf_dir):
    own = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids, at = own.encode(texts[doc], add_special_tokens=False).ids + [2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and pieces[0].padded_length == (at if at & (at - 1) == 0 else 4096)
    assert sum(r.length for r in rows) / (4096 * len(by_sequence)) > 0.95


def test_patterns_place_everything():
    rng = random.Random(2)
    for _ in range(20):
        demand = {s: rng.choice([1, 3, 50, 4000]) for s in rng.sample(range(1, 65), rng.randint(1, 40))}
        found, placed = cutting_patterns(demand, 64), collections.Counter()
        for pattern, times in found:
            assert sum(s * n for s, n in pattern.items()) <= 64
            for s, n in pattern.items():
                placed[s] += n * times
        assert placed == demand
        least = max(sum(s * n for s, n in demand.items()) / 64, sum(n for s, n in demand.items() if s > 32))
        assert sum(t for _, t in found) <= 1.5 * least + 41


def _brute(x, ok, ids, cosine):
    n, parent = [0] * len(x), list(range(len(x)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(x)):
        for j in range(i):
            if ok[i] and ok[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)), key=lambda k: ids[k])
                parent[b] = a
    return [(ids[k], n[k], ids[root(k)]) for k in range(len(x))]


def test_near_vectors_against_brute_force(spark, monkeypatch):
    from millrace.llm import cover_tree

    monkeypatch.setattr(cover_tree, "CELL_ROWS", 60)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(size=(50, 8)) * s for c, s in zip(centres, (0.02, 0.2, 0.4, 0.6, 1.0, 2.0), strict=True)])
    x = np.concatenate([x, x[:20], x[:20] * 3])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 8, 0), (1003, [1.0, None] + [0.0] * 6, 0), (1004, [float("nan")] * 8, 0), (1005, [float("inf")] * 8, 0), (1006, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n_links int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    for k, n, c in _brute(x, [True] * len(x), list(range(len(x))), 0.9):
        assert got[k] == (n, c, k == c)
    assert all(got[k] == (0, k, True) for k in range(1000, 1007)) and got[None][0] == 0
    assert near_vectors(df.limit(0)).count() == 0


def test_dual_traversal_alone():
    rng = np.random.default_rng(8)
    for spread in (0.01, 0.3, 3):
        a, b = (rng.normal(size=(n, 5)) * spread + 1 for n in (40, 70))
        a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (a, b))
        wa, wb = rng.integers(1, 4, 40).astype(float), rng.integers(1, 4, 70).astype(float)
        na, nb, i, j = dual_traversal(a, wa, cover_paths(a).astype(np.int64), b, wb, cover_paths(b).astype(np.int64), 0.9)
        hit = a @ b.T >= 0.9
        assert (na == hit @ wb).all() and (nb == hit.T @ wa).all() and hit[i, j].all()
        assert {*i} == {*np.flatnonzero(hit.any(1))} and {*j} == {*np.flatnonzero(hit.any(0))}


def test_fm_index_against_scanning():
    rng = np.random.default_rng(0)
    for symbols, n in ((2, 60), (5, 300), (200, 500)):
        text = rng.integers(1, symbols + 1, n)
        labels = rng.integers(0, 1000, n)
        index = FmIndex(text, labels, symbols + 1)
        ends = np.arange(4, n)
        length, low, high = index.matching_statistics(text, ends, 5)
        assert (length == 5).all()
        least = index.least_label(low, high)
        for e, lo, hi, m in zip(ends, low, high, least, strict=True):
            at = [k for k in range(n - 4) if (text[k : k + 5] == text[e - 4 : e + 1]).all()]
            assert hi - lo == len(at) and m == min(labels[at])
