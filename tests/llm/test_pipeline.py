"""Each stage of the pipeline against SQL or plain Python on the rows that it gets."""

import itertools
import re
from collections import defaultdict

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.oracles import LINES, PASSAGES, QUALITY
from millrace.llm.shared import stash


def _sql(docs, query):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    return con.execute(query).fetchdf()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = out = stash(stage(spark, docs, sf_dir), "test-stage")
        if name != "packing":
            assert out.schema.names == docs.schema.names
        before, docs = docs, out
        texts = {r.doc_id: r.text for r in before.collect()}
        now = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name == "quality_rules":
            verdicts = _sql(before, QUALITY)
            assert now.keys() == set(verdicts[verdicts.kept].doc_id)
        elif name == "line_dedup":
            assert {k: r.n_chars for k, r in now.items()} == {k: len(r.text) for k, r in now.items()}
            assert {r.doc_id: r.kept_sha256 for r in _sql(before, LINES).itertuples()} == {k: _sha(r.text) for k, r in now.items()}
        elif name == "near_duplicates":
            assert now.keys() == _first_of_groups(texts)
        elif name == "substring_dedup":
            kept = {k: _sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for k, r in now.items()}
            assert {r.doc_id: r.kept_sha256 for r in _sql(before, PASSAGES).itertuples()} == kept
        else:
            own, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(int)
            for r in out.collect():
                tokens[r.doc_id] += r.length
            assert tokens == {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    assert 0 < after["near_duplicates"].count() < after["line_dedup"].count()


def _sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def _first_of_groups(texts):
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    pairs = {p for ks in holders.values() for p in itertools.combinations(sorted(ks), 2)}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {root(k) for k in texts}
