"""Piece vocabularies of SentencePiece models, and the words into which their texts fall apart.

In these models a space becomes the marker U+2581 and one marker is put before the text. As no piece goes on with a
marker after another character, segmentations of the words "markers, then other characters" don't influence each other.
"""

from __future__ import annotations

import re

MARK = "▁"
#: A word of a text that has a space in front: its spaces, then its other characters. Spaces at the end are a word too.
WORD = re.compile(r" +[^ ]*")


class Vocabulary:
    """Ids and scores of the pieces that can stand in a segmentation, and the ids of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: list[int] = [0] * 256
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece], self.id[piece] = sp.get_score(i), i
        if bad := [p for p in self.score if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces go on with a marker after another character: {bad[:3]}")
        if sp.encode(" x") and not sp.encode("x", out_type=str)[0].startswith(MARK):
            raise ValueError("the model puts no marker before a text")


def words_of(text: str) -> list[str]:
    """The words of a text, each with its spaces, the one that's put before the text included."""
    return WORD.findall(" " + text) if text else []
