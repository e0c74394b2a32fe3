"""Exact Jaccard join on word shingles with token-combination prefixes.

Two sets of sizes a and b with Jaccard similarity of at least t share at least t * max(a, b)
shingles, so a set misses at most e = floor((1 - t) * size) of its shingles in any partner.
All shingles get one order; the first e + 1 of a set (its prefix) then hold a shingle
that is also in the partner's prefix. The order puts a pseudo-random share of all
shingles first and, within that, the shingles of few sets. Shingles of few sets (rare)
are indexed singly. Where a prefix runs into frequent shingles, it is extended by q + 1 of
them: these fall into q classes by hash, and two of one class must be shared, so pairs
of one class are indexed instead of single frequent shingles.

Work, in this order:

1. Shingles of the leading share are counted over all sets. A set whose prefix holds
   unique shingles only has no partner and is done.
2. Equal sets become one. The other texts are read again and their prefixes are indexed.
3. Buckets of at most ``SMALL`` sets give all their pairs; buckets of equal members give them once.
4. A larger bucket, split by size of sets, is written as differences from one of its sets, the pivot: buckets
   with one pivot become one family. As |A ^ B| = |D(A) ^ D(B)| for the differences D from
   any pivot, similarity asks for a known overlap of the differences, of which the shingles that many sets share are no
   longer part. Sets with too many differences that only sets of one component have are done. The
   others' differences get prefixes of their own, rarest first, and thus buckets; of these, buckets of at most ``NEAR`` sets give
   pairs of sets not yet known to be linked, and larger ones become families again, each with a pivot of its own. Only
   where levels don't make the buckets smaller (differences from a few values that many sets share) do large buckets give pairs,
   those of different components and within the bounds.
5. Candidate pairs are verified by their whole sets. No pair that could join two components goes unchecked.

Defined results: sets of null, empty or wordless texts are empty and linked with nothing;
texts with fewer words than a shingle form one shingle of all words; rows with equal sets
are one class; rows that share an id share its component, whatever their texts, and each keeps the size
of its own set; a row with a null id keeps its size, is linked with nothing and has a null component; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.links import connected_components
from millrace.llm.shared import discard, frugal, small_or_shuffled, stash
from millrace.llm.textblocks import TextBlock, blocks, mix, windows

#: Shingles of at most so many sets are rare.
RARE = 8
#: Buckets of at most so many sets give all pairs.
SMALL = 8
#: Buckets of differences of at most so many sets give pairs, those within the bounds.
NEAR = 256
#: Prefixes of at most so many differences are carried along, so that a pair comes from one bucket only.
LISTED = 64
#: Differences of the least overlap that are looked for among the first ones of a set.
FIRST = 16
#: Times the rows of a level that the next may have; beyond, its buckets give the pairs within the bounds at once.
GROWTH = 2
_SIGN = np.uint64(1 << 63)


def _shingles(block: TextBlock, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits) of each row, sorted within the row, and the rows' offsets."""
    hashes = block.word_hashes(lower=True)
    found, first = windows(hashes, block.word_row, words)
    rows = block.word_row[first]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = block.n_words[short] > k
            at = np.minimum(block.word_offsets[:-1][short] + k, len(hashes) - 1)
            whole = np.where(has, whole * np.uint64(0xD6E8FEB86659FD93) + hashes[at], whole)
        found = np.concatenate([found, mix(whole ^ block.n_words[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
    found = found >> np.uint64(1)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return found[new], np.searchsorted(rows[new], np.arange(block.rows + 1))


def _misses(n, percent: int):
    """Shingles of a set of n that a partner can lack."""
    return n * (100 - percent) // 100


def _lead(percent: int) -> np.uint64:
    """Shingles below this hash are the leading share: half as many again as a set may miss."""
    return np.uint64(min((1 << 63) - 1, int((1 << 63) * min(1.0, 1.5 * (100 - percent) / 100))))


def _classes(n, percent: int):
    """Classes of frequent shingles for a set of n: a power of two that never falls as n grows."""
    return np.int64(1) << np.log2(np.maximum(_misses(np.asarray(n, np.int64), percent) // 6, 1)).astype(np.int64)


def _reach(n, percent: int):
    """Shingles that a prefix may need: misses, and one more than the classes of the largest partner."""
    return _misses(n, percent) + _classes(np.asarray(n) * 100 // percent + 1, percent) + 1


def _leading(found: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's sorted shingles: which are taken (the leading share; all, if these are too few), which lead, and how many lead."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    leads = found < _lead(percent)
    lead_n = np.bincount(row[leads], minlength=len(n))
    return leads | (lead_n < _reach(n, percent))[row], leads, lead_n


def _unpack(column: pa.Array) -> pa.Array:
    undo = zstandard.ZstdDecompressor()
    return pa.array([undo.decompress(z) if z is not None else None for z in column.to_pylist()], pa.binary())


def _pack(texts: DataFrame) -> DataFrame:
    """(id, packed): texts compressed before they are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([do.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["id", "packed"])

    return texts.mapInArrow(frugal(pack), "id long, packed binary")


def _facts(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` without text, with n, h1 and h2: size and 128-bit hash of each row's shingle set."""
    carried = [f for f in texts.schema.fields if f.name != "text"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found, offsets = _shingles(block, words)
                hashes = []
                for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
                    sums = np.zeros(len(found) + 1, np.uint64)
                    np.cumsum(mix(found ^ np.uint64(salt)), out=sums[1:])
                    hashes.append(pa.array(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)))
                own = [batch.column(f.name).slice(block.first, block.rows) for f in carried]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets), pa.int64()), *hashes], [*[f.name for f in carried], "n", "h1", "h2"])

    more = [T.StructField(c, T.LongType()) for c in ("n", "h1", "h2")]
    return texts.mapInArrow(frugal(sizes), T.StructType([*carried, *more]))


def _leading_rows(texts: DataFrame, words: int, percent: int, column: str) -> DataFrame:
    """(token, id, facts) of the shingles that a prefix can hold; ``column`` has the text or the packed text."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text") if column == "text" else _unpack(batch.column(column))):
                found, offsets = _shingles(block, words)
                n = np.diff(offsets)
                taken, leads, lead_n = _leading(found, offsets, percent)
                ids = batch.column("id").slice(block.first, block.rows).to_numpy()
                # one column holds the size, how many lead and whether this one does
                facts = (np.repeat(n, n) << 32) | (np.repeat(lead_n, n) << 1) | leads
                yield pa.RecordBatch.from_arrays([pa.array(found[taken].astype(np.int64)), pa.array(np.repeat(ids, n)[taken]), pa.array(facts[taken].astype(np.int64))], ["token", "id", "facts"])

    return texts.select("id", column).mapInArrow(frugal(leading), "token long, id long, facts long")


def _isolated(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ids of sets that no other set can be similar to: their whole prefix is unique."""
    rows = _leading_rows(texts, words, percent, "text")
    unique = rows.groupBy("token").agg(F.count("*").alias("c"), F.first("id").alias("id"), F.first("facts").alias("facts")).where("c = 1")
    lead = F.col("facts").bitwiseAND(1)
    per = unique.groupBy("id").agg(F.sum(lead).alias("u_lead"), F.count("*").alias("u_all"), F.max("facts").alias("facts"))
    n = F.shiftrightunsigned("facts", 32)
    lead_n = F.shiftrightunsigned(F.col("facts").bitwiseAND(0xFFFFFFFF), 1)
    need = F.floor(n * (100 - percent) / 100) + 1
    return per.where((F.col("u_lead") >= need) | ((F.col("u_lead") == lead_n) & (F.col("u_all") >= need))).select("id")


def _index(packed: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, id, n, u): the buckets of every set; u: how many of its leading shingles no other set has."""
    rows = _leading_rows(packed, words, percent, "packed")
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # a set without shared shingles in reach has no partner
    listed = rows.join(counts, "token").groupBy("id").agg(F.max("facts").alias("facts"), F.collect_list(F.struct(F.col("facts").bitwiseAND(1).alias("l"), "df", "token")).alias("shared"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids, ns, us = [], [], [], []
            for id_, facts, shared in zip(*[batch.column(c) for c in ("id", "facts", "shared")], strict=True):
                facts = facts.as_py()
                n, lead_n = facts >> 32, (facts & 0xFFFFFFFF) >> 1
                taken = lead_n if lead_n >= _reach(n, percent) else n
                parts = shared.values.flatten()
                late, df, token = parts[0].to_numpy() == 0, parts[1].to_numpy(), parts[2].to_numpy().astype(np.uint64)
                u_lead = lead_n - int(np.count_nonzero(~late))
                u_late = (taken - lead_n) - int(np.count_nonzero(late))
                order = np.lexsort((token, df, late))
                late, df, token = late[order], df[order], token[order]
                # a shingle's place in the order: unique ones of its part stand before it
                place = np.arange(len(token)) + u_lead + np.where(late, u_late, 0)
                base = place < _misses(n, percent) + 1
                if not base.any():
                    continue
                if (df[base] <= RARE).all():
                    out = token[base]
                else:
                    reach = place < _reach(n, percent)
                    often = token[reach & (df > RARE)]
                    cls = often & np.uint64(int(_classes(n, percent)) - 1)
                    out = [token[reach & (df <= RARE)]]
                    for c in np.unique(cls):
                        own = np.sort(often[cls == c])
                        i, j = np.triu_indices(len(own), 1)
                        out.append(mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j]) | _SIGN)
                    out = np.concatenate(out)
                sigs.append(out.view(np.int64))
                ids.append(np.full(len(out), id_.as_py()))
                ns.append(np.full(len(out), n))
                us.append(np.full(len(out), u_lead))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (sigs, ids, ns, us)], ["sig", "id", "n", "u"])

    return listed.mapInArrow(frugal(signatures), "sig long, id long, n long, u long")


def _bands(percent: int):
    """Of a size, two bands: sizes that can be similar have one in common."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(100 * edges[-1] // percent + 1)
    edges = np.array(edges)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(edges, batch.column("n").to_numpy(), "right")
            take = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            band = np.stack([own - 1, own], 1).ravel()
            sig = mix(batch.column("sig").to_numpy().view(np.uint64).repeat(2) ^ mix(band.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), *[batch.column(c).take(take) for c in ("id", "n", "u")]], ["sig", "id", "n", "u"])

    return of


def _with_sizes(index: DataFrame, name: str) -> DataFrame:
    """The rows of buckets of several sets, with their number ``m``."""
    return stash(index.join(index.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "sig"), name)


def _all_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of buckets of at most ``SMALL`` sets, where sizes and unique shingles allow the overlap that the threshold asks for. Buckets of equal members are one."""
    members = index.where(F.col("m") <= SMALL).groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("id", "n", "u"))).alias("of")).select("of").distinct()
    pairs = members.select("of", F.explode("of").alias("x")).select("x", F.explode("of").alias("y")).where("x.id < y.id")
    least = F.least(F.col("x.n") - F.col("x.u"), F.col("y.n") - F.col("y.u"))
    return pairs.where(least * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _families(rows: DataFrame, rank, name: str) -> DataFrame:
    """``rows`` with the pivot of their bucket, its set of least ``rank``, and without the pivot's own row."""
    pivots = stash(rows.groupBy("sig").agg(F.min(rank).getField("id").alias("pivot")), "pivots")
    rows = stash(rows.join(pivots, "sig").where("id <> pivot"), name)
    discard(pivots)
    return rows


def _differences(families: DataFrame, packed: DataFrame, words: int, percent: int) -> DataFrame:
    """``families`` (family, pivot, id, c) with n, d, diff and linked, written: each set's difference from its pivot; a shingle that only the pivot has is inverted.

    ``c`` is an id that the set is known to be linked with, or its own. A null family is a pair to be compared, without ``diff``.
    """

    def sets(texts: list[bytes]) -> dict[bytes, np.ndarray]:
        distinct = list(dict.fromkeys(texts))
        out = {}
        for block in blocks(_unpack(pa.array(distinct, pa.binary()))):
            found, offsets = _shingles(block, words)
            for k in range(block.rows):
                out[distinct[block.first + k]] = found[offsets[k] : offsets[k + 1]]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                mine, theirs = part.column("packed").to_pylist(), part.column("held").to_pylist()
                known = sets(mine + theirs)
                n, d, diffs, linked = [], [], [], []
                for family, x, y in zip(part.column("family").to_pylist(), mine, theirs, strict=True):
                    x, y = known[x], known[y]
                    more, less = np.setdiff1d(x, y, True).astype(np.int64), ~np.setdiff1d(y, x, True).astype(np.int64)
                    n.append(len(x))
                    d.append(len(more) + len(less))
                    linked.append((100 + percent) * d[-1] <= (100 - percent) * (len(x) + len(y)))
                    diffs.append(np.concatenate([more, less]) if family is not None else ())
                c = [p if one else own for p, own, one in zip(part.column("pivot").to_pylist(), part.column("c").to_pylist(), linked, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in ("family", "pivot", "id")], pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(diffs, pa.list_(pa.int64())), pa.array(linked, pa.bool_())], ["family", "pivot", "id", "c", "n", "d", "diff", "linked"])

    ids = stash(families.select("id").union(families.select("pivot")).distinct(), "needed-ids")
    packed = stash(packed.join(small_or_shuffled(ids), "id", "left_semi"), "needed")
    named = families.join(packed, "id").join(packed.toDF("pivot", "held"), "pivot").select("family", "pivot", "id", "c", "packed", "held")
    differences = stash(named.mapInArrow(frugal(compare), "family long, pivot long, id long, c long, n long, d long, diff array<long>, linked boolean"), "differences")
    discard(ids, packed)
    return differences


def _pairs_to_compare(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().select(F.lit(None).cast("long").alias("family"), F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("b").alias("c"))


def _compared(pairs: DataFrame, packed: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar."""
    pairs = stash(_pairs_to_compare(pairs), "to-compare")
    differences = _differences(pairs, packed, words, percent)
    discard(pairs)
    return _linked(differences)


def _linked(differences: DataFrame) -> DataFrame:
    return differences.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b"))


_FAMILY = ["family", "pivot"]


def _unique(tokens: DataFrame) -> DataFrame:
    """(family, pivot, id, u): how many of a set's differences no other set of the family has."""
    once = tokens.groupBy(*_FAMILY, "token").agg(F.count("*").alias("k"), F.first("id").alias("id")).where("k = 1")
    return once.groupBy(*_FAMILY, "id").agg(F.count("*").alias("u"))


def _with_shared(rows: DataFrame, part, need) -> DataFrame:
    """``rows`` of at least ``need`` differences in ``part`` that other sets of the family have in theirs, with the number of these, ``met``."""
    u = _unique(rows.select(*_FAMILY, "id", F.explode(part).alias("token")))
    met = F.size(part) - F.coalesce("u", F.lit(0))
    return rows.join(u, [*_FAMILY, "id"], "left").withColumn("met", met).drop("u").where(F.col("met") >= need)


def _near(found: DataFrame, percent: int) -> DataFrame:
    """(sig, id, c, x, d, met, out, room, prefix, m): the buckets of the differences' prefixes, which stand in their order; a long one is null.

    With a = 100 + percent and b = 100 - percent, sets i and j are similar if 2 * a * overlap of differences >= x(i) + x(j), x = a * d - b * n.
    A partner's overlap is at most its own d and its size at most 100 * n / percent, so the overlap is at least ``least``.
    For sets with x(i) + x(j) <= 0, which need no overlap, x(i) + x(pivot) <= 0 holds too: both are linked with the pivot.
    A set that is linked with the pivot has the pivot as its ``c``, so its partners are not linked with it, and x(j) > b * n(pivot).

    In the order of ``diff``, one for all, the first ``k`` differences of the overlap stand among the first d - least + k of either set, its ``part``;
    of two different ``k`` the greater does. Only parts become rows, until few sets are left: ``out`` differences stand behind the part, others of the
    family have ``met`` of all, and ``room`` are left of the part from the bucket's own on: no earlier one is shared by a pair whose first common bucket this is.
    """
    a, b = 100 + percent, 100 - percent
    x = a * F.col("d") - b * F.col("n")
    pivot_n = F.col("n") - F.col("d") + 2 * F.size(F.filter("diff", lambda token: token < 0))
    beside = F.when(F.col("linked"), F.ceil((x + b * pivot_n + 1) / (2 * a))).otherwise(1)
    least = F.greatest(F.lit(1), F.ceil((x - b * F.floor(100 * F.col("n") / percent)) / a), beside).cast("long")
    rows = found.select(*_FAMILY, "id", "c", "d", "diff", x.alias("x"), least.alias("least")).where("d >= least")
    rows = rows.withColumn("k", F.least(F.lit(FIRST), "least"))
    rows = rows.withColumn("part", F.slice("diff", F.lit(1), (F.col("d") - F.col("least") + F.col("k")).cast("int")))
    # by their parts the many sets go that share a bucket with the pivot and little else
    rows = parts = stash(_with_shared(rows, F.col("part"), F.col("k")).drop("met"), "near-parts")
    # nor can what only sets of one component have be shared for a pair that says something new
    each = rows.select(*_FAMILY, "id", "c", F.explode("part").alias("token"))
    counts = stash(each.groupBy(*_FAMILY, "token").agg(F.count("*").alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").drop("c0", "c1"), "near-counts")
    ranked = each.join(counts, [*_FAMILY, "token"]).groupBy(*_FAMILY, "id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    rows = stash(rows.drop("part").join(ranked, [*_FAMILY, "id"]).where("size(shared) >= k").withColumn("shared", F.col("shared.token")), "near-shared")
    discard(parts, counts)
    shared, rows = rows, stash(_with_shared(rows, F.col("diff"), F.col("least")).drop("diff"), "near-rows")
    discard(shared)
    # the differences that are left out come first
    prefixed = rows.withColumn("room", F.size("shared").cast("long"))
    prefix = F.slice("shared", F.lit(1), (F.col("room") - F.col("k") + 1).cast("int"))
    kept = ["id", "c", "x", "d", "met", (F.col("least") - F.col("k")).alias("out")]
    sigs = prefixed.select(*_FAMILY, *kept, "room", F.when(F.size(prefix) <= LISTED, prefix).alias("prefix"), F.posexplode(prefix).alias("at", "token"))
    sigs = stash(sigs.select(F.struct(*_FAMILY, "token").alias("sig"), "id", "c", "x", "d", "met", "out", (F.col("room") - F.col("at")).alias("room"), "prefix"), "near-prefixes")
    discard(rows)
    index = _mixed(sigs, "near-index")
    discard(sigs)
    return index


def _mixed(sigs: DataFrame, name: str) -> DataFrame:
    """The rows of buckets of several ``c``, with the number ``m`` of their sets."""
    sizes = sigs.groupBy("sig").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").drop("c0", "c1")
    return stash(sigs.join(sizes, "sig"), name)


def _near_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one bucket, of different ``c`` and within the bounds; only in the bucket of the first shingle of both prefixes."""
    one = index.select("sig", "id", "c", "x", "met", "out", "room", "prefix")
    two = one.toDF("sig", "id2", "c2", "x2", "met2", "out2", "room2", "prefix2")
    # what is not in both parts stands behind the one that ends first
    overlap = F.least("met", "met2", F.least("room", "room2") + F.greatest("out", "out2"))
    bound = 2 * (100 + percent) * overlap >= F.col("x") + F.col("x2")
    first = F.coalesce(F.element_at(F.array_intersect("prefix", "prefix2"), 1) == F.col("sig.token"), F.lit(True))
    return one.join(two, "sig").where((F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2")) & bound & first).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def _links(packed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that connect the sets as all links would."""
    signatures = stash(_index(packed, words, percent), "signatures")
    index = _with_sizes(signatures, "index")
    discard(signatures)
    bands = index.where(F.col("m") > SMALL).select("sig", "id", "n", "u").mapInArrow(frugal(_bands(percent)), "sig long, id long, n long, u long")
    banded = _with_sizes(bands, "bands")
    pairs = _pairs_to_compare(_all_pairs(index, percent).union(_all_pairs(banded, percent)))
    large = _families(banded.where(F.col("m") > SMALL), F.struct("u", "id"), "large")
    families = large.select(F.lit(0).cast("long").alias("family"), "pivot", "id", F.col("id").alias("c")).distinct()
    compare = stash(pairs.union(families), "to-compare")
    discard(index, banded, large)
    compared = _differences(compare, packed, words, percent)
    discard(compare)
    found = _linked(compared)
    differences = compared.where("family is not null")
    while True:
        held = differences.count()
        if not held:
            return found
        near = _near(differences, percent)
        more = _compared(_near_pairs(near.where(F.col("m") <= NEAR), percent), packed, words, percent)
        before, found = found, stash(found.union(more), "similar")
        discard(before, more)  # ``differences`` are among them
        crowded = near.where(F.col("m") > NEAR).drop("m")
        if crowded.isEmpty():
            discard(near)
            return found
        component = connected_components(found)
        crowded = _mixed(crowded.drop("c").join(component, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "crowded")
        discard(near, component)
        if crowded.count() > GROWTH * held:  # differences that many sets share, again and again: no level would make them few
            more = _compared(_near_pairs(crowded, percent), packed, words, percent)
            discard(crowded)
            return found.union(more)
        # each bucket is a family of its own here, whose sets agree in one more shingle than those of its parent
        families = _families(crowded, F.struct("d", "id"), "families")
        discard(crowded)
        differences = _differences(families.select(F.xxhash64("sig").alias("family"), "pivot", "id", "c"), packed, words, percent)
        discard(families)
        found = found.union(_linked(differences))


def _text_keys(texts: DataFrame) -> DataFrame | None:
    """(id, h, key) of the ids that stand at different texts: a key for each text, which is no id; null if there are none."""
    hashed = texts.where("id is not null").select("id", _text_hash().alias("h"))
    many = stash(hashed.groupBy("id").agg(F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("id"), "many-texts")
    if many.isEmpty():
        return None
    each = stash(hashed.join(many, "id", "left_semi").distinct(), "texts-of-ids")
    salt = 0
    while True:
        keys = stash(each.withColumn("key", F.xxhash64("id", "h", F.lit(salt))), "text-keys")
        taken = keys.select("key").union(texts.where("id is not null").select("id").distinct())
        if taken.groupBy("key").count().where("count > 1").isEmpty():
            return keys
        salt += 1


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(texts: DataFrame, keys: DataFrame | None) -> DataFrame:
    """``texts`` with a key in place of each id, as ``id``; the id itself, as ``_own``."""
    named = texts.withColumn("_own", F.col("id"))
    if keys is None:
        return named
    named = named.withColumn("_h", _text_hash()).join(keys.toDF("_own", "_h", "_key"), ["_own", "_h"], "left")
    return named.withColumn("id", F.coalesce("_key", "id")).drop("_h", "_key")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: the size of its set and the smallest id that links lead to.

    Texts link when the Jaccard similarity of their sets of distinct ``words``-word shingles (A-Z lower-cased) is at least ``percent`` / 100.
    Only components are found: pairs within one need not be compared, so neither the pairs nor their number are known.
    """
    texts = docs.select(F.col(id_col).alias("_given"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = _text_keys(texts)
    texts = _keyed(texts, keys)
    facts = stash(_facts(texts.select("_given", "_own", "id", "text"), words), "set-facts")
    texts = texts.where("id is not null").select("id", "text")
    alone = stash(_isolated(texts, words, percent), "isolated")
    some = facts.where("id is not null and n > 0").join(alone, "id", "left_anti").select("id", "n", "h1", "h2")
    classes = stash(some.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    members = some.join(classes, ["n", "h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    packed = _pack(texts).join(small_or_shuffled(classes.select(F.col("rep").alias("id"))), "id", "left_semi")
    if not some.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        packed = packed.dropDuplicates(["id"])  # rows of one id have one text here: any of them will do
    packed = stash(packed, "firsts")
    found = _links(packed, words, percent)
    links = found.union(members)
    if keys is not None:
        for side in ("a", "b"):
            links = links.join(keys.select(F.col("key").alias(side), F.col("id").alias("own")), side, "left").withColumn(side, F.coalesce("own", side)).drop("own")
        links = links.where("a <> b")
    linked = connected_components(links)
    discard(found, packed, classes, alone)
    out = facts.select("_given", F.col("_own").alias("id"), F.col("n").alias("n_shingles")).join(linked, "id", "left")
    return out.select(F.col("_given").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link, directly or not, to one of a smaller id; all columns unchanged. Rows with a null id stay."""
    classes = similarity_classes(docs, id_col, text_col, words, percent)
    gone = classes.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, for 3-word shingles and a similarity of 0.9."""
    return similarity_classes(docs, words=3, percent=90)
