"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Byte-level BPE works on pre-tokens, so each distinct pre-token is encoded once per worker
and its ids are kept, as little-endian unsigned 32-bit integers.  Texts made of Latin
letters and common punctuation are cut by an equal regular expression over fixed
character classes; any other text, and any text holding an added token's string, goes
through the library whole.  Words of letters are merged by ``tiktoken`` over the same
file's vocabulary, if its ids follow its merges, and everything else by the library.  All
ways give the library's ids; the tests hold them against it.
"""

from __future__ import annotations

import array
import json
import re
import sys
import unicodedata

from pyspark import cloudpickle

# These functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"

#: Pre-tokens a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 300_000

_LAST = 0x250  # below: Latin letters, whose classes are the same in all Unicode versions
_DASHES = "‐-‧"  # dashes, quotes, bullets, ellipsis: neither letters, numbers nor spaces


def tokenizer_path(name: str) -> str:
    """A file's own path, or the place of a public tokenizer by its name."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[str, str, str]:
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for code in range(_LAST):
        kind = unicodedata.category(chr(code))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(code)))
    return "".join(kinds["L"]), "".join(kinds["N"]), "\t-\r \x85\xa0"


class Known(dict):
    """Ids of pre-tokens, encoded when first met."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encoder.word(word)
        return ids


class Encoder:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and (spec.get("model") or {}).get("type") == "BPE"
        )
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        letter, number, space = _classes()
        # Fixed value: the byte-level pre-token pattern, over the classes above.
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+"
            f"| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        ).findall
        odd = [f"[^\x00-{chr(_LAST - 1)}{_DASHES}]", *map(re.escape, added)]
        self.odd = re.compile("|".join(odd)).search
        self.letters = re.compile(f" ?[{letter}]+").fullmatch
        self.merger = self._merger(spec["model"]) if self.by_words else None
        self.known = Known(self)

    @staticmethod
    def _merger(model: dict):
        """A faster encoder of single words, where ids follow the order of the merges."""
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get("".join(p), -1) for p in pairs]
        if ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in model["vocab"].items()
            if all(c in byte_of for c in token)
        }
        ranks = {token: i for token, i in ranks.items() if len(token) == 1 or i <= ids[-1]}
        return tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if self.merger and self.letters(word):
            return array.array("I", self.merger(word)).tobytes()
        return self._whole([word])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [
            np.asarray(e.ids, dtype="<u4").tobytes()
            for e in self.library.encode_batch(texts, add_special_tokens=False)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self._whole(texts)
        plain = [not self.odd(t) for t in texts]
        words = [self.cut(t) if p else () for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        others = [i for i, p in enumerate(plain) if not p]
        if others:
            for i, ids in zip(others, self._whole([texts[i] for i in others]), strict=True):
                out[i] = ids
        return out


def blocks_of(texts: list[str], chars: int = 2_000_000):
    """Slices of a list holding about ``chars`` characters each, at least one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
