"""Unigram scores of an existing tokenizer's vocabulary, as natural logarithms by piece (UTF-8 bytes)."""

from __future__ import annotations

import math


def default_path() -> str:
    """The public subword vocabulary of this machine; any sentencepiece model file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> dict[bytes, float]:
    """Pieces and log probabilities. The space mark is one space byte; every single byte is a piece.

    A unigram model's scores are used as they are. Where scores only give the order of merges (every
    score a whole number), piece of rank r weighs 1 / (r + 10), which is Zipf's law. Single bytes that
    are no piece of their own share the weight of the last rank. Scores are normalised to sum to one.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    scores = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        scores.setdefault(sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i))
    if all(x == int(x) for x in scores.values()):
        order = sorted(scores, key=lambda p: (-scores[p], p))
        scores = {p: -math.log(r + 10) for r, p in enumerate(order)}
    least = min(scores.values(), default=0.0)
    for b in range(256):
        scores.setdefault(bytes([b]), least - math.log(256))
    total = math.log(math.fsum(math.exp(x) for x in scores.values()))
    return {p: x - total for p, x in scores.items()}
