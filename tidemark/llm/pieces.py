"""The piece model: pieces, scores, and the cut of a text into parts that no piece crosses."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from tidemark.llm.base import TOKENIZERS

MARK = "▁"  # stands for a space
MODEL = "piece_bpe_32k.model"


class Pieces:
    """Pieces of a model file by text, with ids and scores; bytes stand for characters without a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = lib = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.texts: list[str] = []
        for i in range(lib.get_piece_size()):
            p = lib.id_to_piece(i)
            self.texts.append(p)
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[p] = i
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space after another character; texts cannot be cut at spaces")

    @staticmethod
    def surface(text: str) -> str:
        """What the library segments: one space in front of a text that is not empty, spaces as marks."""
        return (MARK + text).replace(" ", MARK) if text else ""

    _parts = re.compile(f"{MARK}+[^{MARK}]*")

    @classmethod
    def parts(cls, text: str) -> list[str]:
        """The surface cut before each run of marks: no piece crosses such a cut."""
        return cls._parts.findall(cls.surface(text))


@lru_cache(maxsize=4)
def load(name: str = MODEL, folder: str | None = TOKENIZERS) -> Pieces:
    """The model file of that name, loaded once per Python process."""
    if folder is None:
        import public_tokenizers

        return Pieces(public_tokenizers.path(name))
    return Pieces(os.path.join(folder, name))
