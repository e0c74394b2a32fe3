"""Spans that polynomial hashes modulo 2 ** 64 can't tell apart."""

import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from millrace.llm.jaccard import jaccard_classes
from millrace.llm.line_dedup import line_digests
from millrace.llm.packing import packed_documents
from millrace.llm.quality import quality_verdicts
from millrace.llm.substring_dedup import drop_repeated_passages
from millrace.llm.textblocks import span_hashes


def two_words(n):
    """A Thue-Morse word over a and b, and its complement."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 32, 64, 65, 1024, 2048, 4096])
def test_spans_differ(n):
    data = np.frombuffer("".join(two_words(n)).encode(), np.uint8)
    one, two = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two


def test_spans_depend_on_their_bytes_only():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 16, 40, 64, 65, 300):
        span = rng.integers(0, 256, n, dtype=np.uint8)
        found = set()
        for before in (0, 1, 5, 8):
            data = np.concatenate([rng.integers(0, 256, before, dtype=np.uint8), span, rng.integers(0, 256, 3, dtype=np.uint8)])
            found.add(int(span_hashes(data, np.array([before]), np.array([before + n]))[0]))
        assert len(found) == 1


def test_operators_tell_them_apart(spark):
    a, b = two_words(2048)
    filler = " ".join(f"w{k}" for k in range(60))
    texts = [(1, f"{a} {b}"), (2, b), (3, f"{filler} {a}"), (4, f"{filler}\n{a}\n{b}\n{a}"), (5, f"{a} x y {b} x y"), *[(10 + k, a) for k in range(3)], *[(20 + k, b) for k in range(3)]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    own = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for r in packed_documents(docs, public.path("word_bpe_49k.json")).collect():
        ids = own.encode(dict(texts)[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    classes = {r.doc_id: r.component_id for r in jaccard_classes(docs).collect()}
    assert classes[2] == 2 and classes[12] == 10 and classes[20] == 2 and classes[1] == 1
    verdicts = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert verdicts[4].n_dup_lines == 1 and verdicts[5].n_repeat_words == 0
    # four documents hold a line of a, five one of b
    assert {r.doc_id: r.n_dropped for r in line_digests(docs).collect() if r.n_dropped} == {2: 1, 4: 1, 20: 1, 21: 1}
    removed = {r.doc_id: r.n_removed for r in drop_repeated_passages(docs).collect()}
    assert removed[4] == 61 and removed[3] == 0  # the filler and the word after it: document 3 holds both
