"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text gets a leading space; spaces become U+2581. The lattice's edges are the model's pieces with their scores; a
character that no piece covers is spelled in byte pieces, at ``UNKNOWN`` below the least score. Forward
Viterbi scores of all prefixes are exact heuristics for an A-star search from the end of the text, so the n-th pop of a whole path is the n-th best.
No piece holds a space behind another character, so no edge crosses the places before words: the lattice falls
into chunks, and the best combinations of chunks' segmentations are those of the whole. Only the n - 1 chunks with the least
loss from best to second best can differ from their best. A search leaves out what costs more than the n - 1 cheapest edges
that turn off the best path, each of which is a segmentation of its own.

Scores are log-probabilities. A model of the BPE kind, as ``piece_bpe_32k.model`` is, holds ranks of merges in their place,
whose sums mean nothing: a piece of rank r then has the probability of Zipf's law, in proportion to 1 / (r + ``ZIPF_SHIFT``).
The best segmentation is the most probable one; a BPE encoder applies merges in their order and can differ from it.

Defined results: a null or empty text has no pieces and one segmentation of score 0; U+2581 in a text is spelled in byte pieces, so that it is
not read back as a space; fewer segmentations than n give a shorter list; ties
go to the segmentation found first, which is the same in every run; repeated rows are encoded each by itself; an empty table gives
an empty result. A chunk without spaces takes about 9 bytes of memory for a character, and its search what is nearly as good as the n-th best.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import frugal
from millrace.llm.textblocks import mix

SPACE = "\u2581"
UNKNOWN = 10.0
#: Added to the rank of a BPE piece in Zipf's law.
ZIPF_SHIFT = 2.7
#: Scores are multiples of 1 / GRID.
GRID = 1 << 20
#: Chunks that a worker keeps in each of two generations, and results of searches.
CACHED, SEARCHED = 100_000, 20_000
#: Longer chunks are neither kept nor computed many at a time.
SHORT = 64
#: Characters of chunks computed at a time.
SLAB = 40_000
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MISSING = object()
_NONE = -2


def _log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """The scores themselves, unless they are ranks: whole numbers of 0 or less. All are multiples of 1 / ``GRID``, so that sums are exact and ties are ties."""
    if scores and all(s <= 0 and float(s).is_integer() for s in scores.values()):
        norm = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(scores))))
        scores = {p: -math.log(r + ZIPF_SHIFT) - norm for r, p in enumerate(sorted(scores, key=lambda p: -scores[p]))}
    return {p: round(s * GRID) / GRID for p, s in scores.items()}


class PieceLattice:
    """Pieces and scores of a model file; made once for each worker process."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.bytes = np.full(len(pieces), -1, np.int64)
        for b, i in self.byte_ids.items():
            self.bytes[i] = b
        self.plain = [p.replace(SPACE, " ") for p in pieces]
        usual = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.names, self.usual = pieces, set(usual.values())
        self.scores = _log_probabilities({p: model.get_score(i) for p, i in usual.items()})
        self.unknown = min(self.scores.values()) - UNKNOWN
        split_words = not any(SPACE in p.lstrip(SPACE) for p in usual)
        self.chunks_of = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if split_words else "(?s).+")
        # every prefix of a piece, so that a scan stops as soon as no piece can follow
        self.prefixes: dict[str, tuple[int, float] | None] = {p[:k]: None for p in usual for k in range(1, len(p))}
        self.prefixes.update({p: (i, self.scores[p]) for p, i in usual.items()})
        self.longest = max(map(len, usual))
        self._tabulate()
        self.young: dict[str | None, tuple] = {}
        self.old: dict[str | None, tuple] = {}
        self.searched: dict[tuple[str, int], list] = {}
        #: U+2581 itself, in byte pieces: a chunk by the name None
        self.space = (np.array([self.byte_ids[b] for b in SPACE.encode()], "<u4").tobytes() if self.byte_ids else b"", self.unknown, math.inf)

    def usual_score(self, piece_id: int) -> float | None:
        """The log-probability of a piece; None for byte and control pieces."""
        return self.scores.get(self.names[piece_id]) if piece_id in self.usual else None

    def _tabulate(self) -> None:
        """A hash table of all prefixes, with id and score where the prefix is a piece: a key stands in the first free slot from its lowest bits on."""
        names = list(self.prefixes)
        hashes, state = np.zeros(len(names), np.uint64), np.full(len(names), _SEED)
        codes = np.zeros((len(names), self.longest), np.uint64)
        length = np.array([len(p) for p in names])
        for k, p in enumerate(names):
            codes[k, : len(p)] = [ord(c) for c in p]
        for k in range(self.longest):
            state = mix((state ^ codes[:, k]) * _SEED)
            hashes[length == k + 1] = state[length == k + 1]
        # one slot more for each step that a key is moved by, and a last one that is free
        bits = max(4, len(names) - 1).bit_length() + 3
        self.slots = np.uint64((1 << bits) - 1)
        self.keys = np.zeros((1 << bits) + len(names) + 1, np.uint64)
        self.key_ids, self.key_scores = np.full(len(self.keys), _NONE, np.int32), np.full(len(self.keys), -np.inf)
        for h, name in zip(hashes.tolist(), names, strict=True):
            place, found = h & int(self.slots), self.prefixes[name]
            while self.keys[place]:
                place += 1
            self.keys[place] = h
            if found:
                self.key_ids[place], self.key_scores[place] = found

    def _slots(self, state: np.ndarray) -> np.ndarray:
        """Where each hash stands, or a slot of another key or of none."""
        place = (state & self.slots).astype(np.int64)
        key = self.keys[place]
        on = np.flatnonzero((key != state) & (key != 0))
        while len(on):
            place[on] += 1
            key = self.keys[place[on]]
            on = on[(key != state[on]) & (key != 0)]
        return place

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the pieces of 1, 2, ... characters that begin at each place."""
        ids = np.full((self.longest + 1, len(codes)), _NONE, np.int32)
        gains = np.full((self.longest + 1, len(codes)), -np.inf)
        at, state = np.arange(len(codes)), np.full(len(codes), _SEED)
        for k in range(1, self.longest + 1):
            inside = at + k <= len(codes)
            at = at[inside]
            state = mix((state[inside] ^ codes[at + k - 1]) * _SEED)
            place = self._slots(state)
            known = self.keys[place] == state
            at, state, place = at[known], state[known], place[known]
            ids[k, at], gains[k, at] = self.key_ids[place], self.key_scores[place]
            if not len(at):
                break
        bare = ids[1] == _NONE
        ids[1, bare], gains[1, bare] = -1, self.unknown
        return ids, gains

    def best_of_many(self, chunks: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """For each chunk the ids of its best segmentation, its score and the loss to the second best."""
        n = np.array([len(c) for c in chunks])
        # each chunk stands in n + 1 places; the last is a character that no piece has
        codes = np.frombuffer("".join(c + "\U0010ffff" for c in chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        begin = np.cumsum(n + 1) - (n + 1)
        codes[begin + n] = np.uint64(1 << 32)
        ids, gains = self._edges(codes)
        best, back = np.full(len(codes), -np.inf), np.zeros(len(codes), np.int64)
        best[begin] = 0
        order = np.argsort(-n, kind="stable")
        shorter = np.searchsorted(-n[order], -np.arange(int(n.max()) + 1), "right")
        for e in range(1, int(n.max()) + 1):
            at = begin[order[: shorter[e]]] + e
            for k in range(min(self.longest, e), 0, -1):
                way = best[at - k] + gains[k, at - k]
                better = way > best[at]
                best[at[better]], back[at[better]] = way[better], k
        total = best[begin + n]
        loss, cur, alive = np.full(len(chunks), np.inf), begin + n, np.arange(len(chunks))
        owners, starts = [], []
        while len(alive):
            at, k = cur[alive], back[cur[alive]]
            for j in range(1, self.longest + 1):
                open_ = (j != k) & (at - j >= begin[alive])
                off, own = at[open_], alive[open_]
                loss[own] = np.minimum(loss[own], best[off] - best[off - j] - gains[j, off - j])
            owners.append(alive)
            starts.append(at - k)
            cur[alive] = at - k
            alive = alive[at - k > begin[alive]]
        owner, start = np.concatenate(owners[::-1]), np.concatenate(starts[::-1])
        place = np.lexsort((start, owner))
        owner, start = owner[place], start[place]
        lengths = np.zeros(len(codes), np.int64)
        for at, k in zip(starts, _lengths(starts, begin + n, owners), strict=True):
            lengths[at] = k
        found = ids[lengths[start], start]
        edges = np.searchsorted(owner, np.arange(len(chunks) + 1))
        unknown = np.zeros(len(chunks), bool)
        unknown[owner[found < 0]] = True
        flat, cuts = found.astype("<u4").tobytes(), (4 * edges).tolist()
        out = [flat[p:q] for p, q in zip(cuts, cuts[1:], strict=False)]
        for k in np.flatnonzero(unknown):
            part, spelled = slice(edges[k], edges[k + 1]), []
            for i, s in zip(found[part].tolist(), (start[part] - begin[k]).tolist(), strict=True):
                spelled += [i] if i >= 0 else [self.byte_ids[b] for b in chunks[k][s].encode()]
            out[k] = np.array(spelled, "<u4").tobytes()
        return zip(out, total.tolist(), np.maximum(0.0, loss).tolist(), strict=True)

    def forward(self, text: str) -> tuple[array, bytearray]:
        """Viterbi scores of all prefixes, and the length of the best last piece of each."""
        n, get = len(text), self.prefixes.get
        best, back = array("d", [-math.inf]) * (n + 1), bytearray(n + 1)
        best[0] = 0.0
        for s in range(n):
            single, here = False, best[s]
            for e in range(s + 1, n + 1):
                found = get(text[s:e], _MISSING)
                if found is _MISSING:
                    break
                if found is not None:
                    single = single or e == s + 1
                    if here + found[1] > best[e]:
                        best[e], back[e] = here + found[1], e - s
            if not single and here + self.unknown > best[s + 1]:
                best[s + 1], back[s + 1] = here + self.unknown, 1
        return best, back

    def _ending(self, text: str, e: int) -> Iterator[tuple[int, int, float]]:
        """The edges (begin, id, score) that end at a place."""
        for s in range(max(0, e - self.longest), e):
            found = self.prefixes.get(text[s:e])
            if found is not None:
                yield s, *found
            elif s == e - 1:
                yield s, -1, self.unknown

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the ``n`` best segmentations of a text without a leading space added."""
        best, back = self.forward(text)
        # the edges that turn off the best path, the cheapest n - 1 of them, bound the loss of the n-th best
        turns, e = [], len(text)
        while e:
            turns += [best[e] - best[s] - gain for s, _, gain in self._ending(text, e) if e - s != back[e]]
            e -= back[e]
            if len(turns) > 64 * n:
                turns = heapq.nsmallest(n - 1, turns)
        turns = heapq.nsmallest(n - 1, turns)
        most = turns[-1] if len(turns) == n - 1 and turns else math.inf if n > 1 else 0.0
        # among equal totals the path that is nearest to its end goes first: ties would else be followed all at once
        heap, serial, out = [(0.0, len(text), 0, 0.0, None)], 1, []
        while heap and len(out) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if not at:
                out.append((score, self._ids(text, path)))
                continue
            for begin, piece, gain in self._ending(text, at):
                loss = best[-1] - (best[begin] + gain + score)
                if loss <= most:
                    heapq.heappush(heap, (loss, begin, serial, gain + score, (begin, at, piece, path)))
                    serial += 1
        return out

    def _ids(self, text: str, path) -> tuple[int, ...]:
        ids = []
        while path is not None:
            begin, end, piece, path = path
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in text[begin:end].encode()]
        return tuple(ids)

    def _best_and_loss(self, text: str) -> tuple[bytes, float, float]:
        """As ``best_of_many``, for one long chunk."""
        best, back = self.forward(text)
        loss, e, ids = math.inf, len(text), array("I")
        while e:
            for s, piece, gain in self._ending(text, e):
                if e - s != back[e]:
                    loss = min(loss, best[e] - best[s] - gain)
                elif piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(text[s:e].encode()))
            e -= back[e]
        return np.array(ids[::-1], "<u4").tobytes(), best[-1], max(0.0, loss)

    def chunks(self, text: str) -> list[str | None]:
        """The text's chunks; None stands for a U+2581 of the text."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(SPACE) if text else ()):
            if k:
                out.append(None)
            out += self.chunks_of.findall((SPACE if not k else "") + part.replace(" ", SPACE))
        return out

    def known(self, chunks: Iterable[str | None]) -> dict[str | None, tuple[bytes, float, float]]:
        """Ids, score and loss to the second best of distinct chunks, from the cache or computed many at a time."""
        chunks = list(chunks)
        found: dict[str | None, tuple] = dict(zip(chunks, map(self.young.get, chunks), strict=True))
        slab, size = [], 0

        def compute():
            for c, f in zip(slab, self.best_of_many(slab) if slab else (), strict=True):
                found[c] = self.young[c] = f

        for c in [c for c, f in found.items() if f is None]:
            f = self.space if c is None else self.old.get(c)
            if f is not None:
                found[c] = f
                if c is not None:
                    self.young[c] = f
            elif len(c) > SHORT:
                found[c] = self._best_and_loss(c)
            else:
                slab.append(c)
                size += len(c) + 1
                if size >= SLAB:
                    compute()
                    slab, size = [], 0
        compute()
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return found

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self.searched.get((chunk, n))
        if found is None:
            found = self.n_best(chunk, n)
            if len(chunk) <= SHORT:
                if len(self.searched) >= SEARCHED:
                    self.searched.clear()
                self.searched[chunk, n] = found
        return found

    def segmentations(self, chunks: list[str | None], known: dict, n: int) -> tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]]]:
        """The best ids, the ``n`` best scores and, for each of these, the chunks that differ from the best (by number)."""
        own_ids, own_scores, losses = zip(*map(known.__getitem__, chunks), strict=True) if chunks else ((), (), ())
        total = math.fsum(own_scores)
        ids = np.frombuffer(b"".join(own_ids), "<u4")
        ways: list[tuple[float, dict]] = [(0.0, {})]
        for k in _least(losses, n - 1):
            options = self.search(chunks[k], n)
            ways = heapq.nsmallest(n, ((loss + options[0][0] - s, {**changed, k: i} if j else changed) for loss, changed in ways for j, (s, i) in enumerate(options)), key=lambda w: w[0])
        return ids, [total - loss for loss, _ in ways], [changed for _, changed in ways]

    def encode(self, text: str, n: int = 1) -> tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]]]:
        chunks = self.chunks(text)
        return self.segmentations(chunks, self.known(dict.fromkeys(chunks)), n)

    def decode(self, ids: np.ndarray) -> str:
        value = self.bytes[ids] if len(ids) else np.zeros(0, np.int64)
        spelled = value >= 0
        if not spelled.any():
            return "".join(map(self.plain.__getitem__, ids.tolist())).removeprefix(" ")
        edges = [0, *(np.flatnonzero(spelled[1:] != spelled[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            out.append(value[a:b].astype(np.uint8).tobytes().decode(errors="replace") if spelled[a] else "".join(map(self.plain.__getitem__, ids[a:b].tolist())))
        return "".join(out).removeprefix(" ")


def _least(losses: tuple[float, ...], n: int) -> list[int]:
    """The places of the ``n`` least finite losses in order, the first of equal ones."""
    loss = np.array(losses)
    if n < len(loss):
        most = np.partition(loss, n - 1)[n - 1] if n else -np.inf
        under = np.flatnonzero(loss < most)
        at = np.sort(np.concatenate([under, np.flatnonzero(loss == most)[: n - len(under)]]))
    else:
        at = np.arange(len(loss))
    return at[loss[at] < np.inf].tolist()


def _lengths(starts: list[np.ndarray], ends: np.ndarray, owners: list[np.ndarray]) -> Iterator[np.ndarray]:
    """How long the piece at each of ``starts`` is: paths are walked from their ends."""
    at = ends.copy()
    for start, own in zip(starts, owners, strict=True):
        yield at[own] - start
        at[own] = start


_lattices: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    if path not in _lattices:
        _lattices[path] = PieceLattice(path)
    return _lattices[path]


def encode_n_best(docs: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, scores, alternatives, decoded): the best ids, the ``n`` best scores, for each of these the changed chunks (number and ids), and the text decoded from the best ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            for part in _parts(batch):
                split = [own.chunks(text or "") for text in part.column("text").to_pylist()]
                known = own.known(dict.fromkeys(chain.from_iterable(split)))
                out = []
                for chunks in split:
                    ids, scores, changed = own.segmentations(chunks, known, n)
                    out.append((ids.astype(np.int32), scores, [[{"chunk": k, "ids": list(v)} for k, v in sorted(c.items())] for c in changed], own.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(_KINDS)]], ["id", "ids", "scores", "alternatives", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, ids array<int>, scores array<double>, alternatives array<array<struct<chunk: int, ids: array<int>>>>, decoded string")
    return out.withColumnRenamed("id", id_col)


def _parts(batch: pa.RecordBatch, rows: int = 500, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``limit`` bytes of text."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right"))
        end = min(max(at + 1, end), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


_KINDS = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))), pa.string()]


def n_best_digests(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """Per document: doc_id, n_pieces, the ``n`` best scores, a checksum of the most probable ids and the digest of the text decoded from them."""
    out = encode_n_best(docs.select("doc_id", "text"), model, n)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "scores", F.xxhash64("ids").alias("ids_hash"), F.size("scores").cast("long").alias("n_found"), F.sha2("decoded", 256).alias("decoded_sha256"))


