"""Token ids of blocks of texts by a word-level BPE tokenizer file, each distinct piece of text encoded once.

The tokenizer drops white space, lower-cases and splits texts into runs of letters, single
digits and runs of other characters, so the ids of a text are those of such pieces in
order. Pieces of ASCII and Latin-1 letters are found by byte classes; a word that holds any other
character (or an apostrophe, which starts a contraction) is encoded whole by the full tokenizer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.textblocks import TextBlock, blocks, span_hashes

#: Pieces that a worker keeps in each of two generations of its cache, of at most so many bytes each: about 20 MB.
CACHED, CACHED_BYTES = 60_000, 48
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _HARD


class PieceEncoder:
    """``encode_block`` gives the ids of the texts of a block; made once for each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        plain = json.loads(self.full.to_str())
        plain["normalizer"] = None  # what it does to these pieces is done before
        plain["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain["added_tokens"] = []
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pieces(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = block.data
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        second = data[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        kind[1:][(data[1:] == ord("|")) & (data[:-1] == ord("<"))] = _HARD  # may begin a special token
        lowered = data.copy()
        lowered[(data >= 65) & (data <= 90)] += 32
        lowered[lead[(second >= 0x80) & (second <= 0x9E)] + 1] += 32
        hard = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == _HARD, out=hard[1:])
        whole = hard[block.ends] > hard[block.starts]
        fill = np.zeros(len(data) + 1, np.int8)
        fill[block.starts[whole]] += 1
        fill[block.ends[whole]] -= 1
        inside = np.cumsum(fill[:-1]).astype(bool)
        kind[inside] = _HARD
        lowered[inside] = data[inside]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[block.starts] = True  # two texts may meet without white space
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        some = kind[starts] != _SPACE if len(starts) else np.zeros(0, bool)
        return starts[some], ends[some], kind[starts[some]], lowered

    def _known(self, piece: bytes) -> bytes | None:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self.young[piece] = found
        return found

    def encode_block(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        starts, ends, kind, lowered = self._pieces(block)
        _, at, of = np.unique(span_hashes(lowered, starts, ends), return_index=True, return_inverse=True)
        whole = lowered.tobytes()
        pieces = [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        found = [self._known(p) for p in pieces]
        for encoder, missing in (
            (self.plain, [k for k, x in enumerate(found) if x is None and kind[at[k]] != _HARD]),
            (self.full, [k for k, x in enumerate(found) if x is None and kind[at[k]] == _HARD]),
        ):
            texts = [pieces[k].decode() for k in missing]
            for k, e in zip(missing, encoder.encode_batch_fast(texts, add_special_tokens=False) if texts else (), strict=True):
                found[k] = np.array(e.ids, "<u4").tobytes()
                if len(pieces[k]) <= CACHED_BYTES:
                    self.young[pieces[k]] = found[k]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        flat = np.frombuffer(b"".join(found), "<u4")
        n = np.array([len(x) // 4 for x in found], np.int64)
        begin = np.cumsum(n) - n
        many = n[of]
        total = int(many.sum())
        place = np.cumsum(many) - many
        ids = flat[np.repeat(begin[of] - place, many) + np.arange(total)]
        sums = np.append(place, total)
        return ids, sums[np.searchsorted(starts, block.offsets)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def text_ids(column: pa.Array, path: str, block_bytes: int = 500_000) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text of a string column; null counts as empty."""
    own = encoder(path)
    for block in blocks(column, block_bytes):
        ids, offsets = own.encode_block(block)
        for row in range(block.rows):
            yield block.first + row, ids[offsets[row] : offsets[row + 1]]
