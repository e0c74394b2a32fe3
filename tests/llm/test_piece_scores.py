"""What the n-best segmentations are best by, with a model of merges."""

import math

import public_tokenizers as public
import sentencepiece

from millrace.llm.piece_nbest import SPACE, PieceLattice

MODEL = public.path("piece_bpe_32k.model")


def test_ranks_become_probabilities():
    own, model = PieceLattice(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert abs(math.fsum(map(math.exp, own.scores.values())) - 1) < 1e-5
    assert own.scores[SPACE + "the"] > own.scores[SPACE + "them"] > own.unknown
    for word in "international beautiful segmentation understanding documentation responsibilities".split():
        (score, ids), = own.n_best(SPACE + word, 1)
        assert score >= sum(own.usual_score(i) for i in model.encode(word)) - 1e-9
        assert len(ids) <= len(model.encode(word))
