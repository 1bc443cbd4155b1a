"""Token ids by a public tokenizer, with a bounded memo of text units."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: The id that ends a document.
END_ID = 1
#: Words after single spaces or line ends are encoded apart: no token of the byte-level BPE reaches
#: from a word to the next, as its pattern starts a token at the white space.
#: White space beyond those four characters, and special tokens: such texts are encoded whole.
_ODD_ASCII = ("<|", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: What a text that is words and single spaces or line ends does not hold.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary's file on this machine; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(text): its ids, as the tokenizer gives them, as little-endian unsigned 32-bit bytes.

    Units met before come from a memo of two generations, each of `most` units at most. New ones are
    encoded together and told apart by the white space that each starts with, and no other token does.
    """

    def __init__(self, name: str = TOKENIZER, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        spaces = self.tokenizer.encode_batch([" ", "\n", "\t", "\r"], add_special_tokens=False)
        marks = tuple(self.tokenizer.id_to_token(e.ids[0]) for e in spaces)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(marks)]] = True
        self.plain = self._rank_encoder(path) or self._whole
        self.known: dict[str, bytes] = {}  # by word after a space, or after a line end that is part of the key
        self.old: dict[str, bytes] = {}

    def _rank_encoder(self, path: str):
        """The same vocabulary as ranks, where its file lies beside: the same ids in a third of the time."""
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            order = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        one = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})
        return lambda text: one.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _join(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        new = []
        for w in set(words):
            if w not in known:
                if (ids := self.old.get(w)) is not None:
                    known[w] = ids
                else:
                    new.append(w)
        if new:
            ids = self.plain("".join([w if w[0] == "\n" else f" {w}" for w in new]))
            at = np.flatnonzero(self.starts[ids]) * 4
            if len(at) != len(new):
                raise ValueError("units and their first tokens differ")
            raw, at = ids.tobytes(), at.tolist()
            known.update(zip(new, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))
        joined = b"".join([known[w] for w in words])
        if len(known) > self.most:
            self.old, self.known = known, {}
        return joined

    def encode(self, text: str) -> bytes:
        if any(x in text for x in _ODD_ASCII) or not text.isascii() and _ODD.search(text):
            return self._whole(text).tobytes()
        if any(x in text for x in _RUNS) or text[:1] in ("", " ", "\n") or text[-1] in " \n":
            return self.plain(text).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.plain(first).tobytes() + self._join(rest)


@lru_cache(2)
def encoder(name: str = TOKENIZER) -> Encoder:
    """One for each worker."""
    return Encoder(name)
