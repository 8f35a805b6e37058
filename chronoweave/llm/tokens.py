"""Token ids of public tokenizers, encoded piece by piece with a cache.

A text is cut at the literals of the tokenizer's added tokens, which have ids of their own, and then
where the tokenizer's own first step always cuts, so encoding the cuts one by one gives the ids of
the whole text, and frequent cuts are encoded once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse
from struct import pack

import numpy as np

from .common import worker_cache

# White space as the tokenizers' patterns know it.
_SPACE = "\t-\r \x85\xa0  -     　"
# Letters before a plain mark end a piece in both patterns, so the word is known without its mark.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = "[.,!?;:|$%&*#]"
# A byte-level pattern keeps one blank with the word behind it and never joins words.
BYTE_CUTS = re.compile(rf" ?[{_LETTERS}]+(?={_MARKS})| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LED = re.compile(rf" [^{_SPACE}]")
# A pattern that drops white space never joins what white space parts.
WORD_CUTS = re.compile(rf"[{_LETTERS}]+(?={_MARKS})|[^\t-\r ]+")
# Where no mark may compose with a letter, small and capital ASCII letters encode alike.
_COMPOSING = re.compile("[̀-ͯ]")

# Cuts in each of two generations of the cache; bounds a worker's memory, not the results.
CACHE_CUTS = 400_000
# Characters of the texts whose new cuts are learnt in one call, and cuts with a leading blank that
# are encoded as one text; both bound memory, not the results.
GROUP_CHARS, JOINED_CUTS = 1 << 20, 256


class Encoder:
    """``small``: the tokenizer lower-cases, so ASCII capitals may be lowered before the lookup.

    ``added``: literals of added tokens get their ids, as in the tokenizers library by default;
    otherwise they are text like any other.
    """

    def __init__(self, path: str, cuts: re.Pattern, small: bool = False, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts, self.small, self.cache, self.older = cuts, small, {}, {}
        # bytes of each id, where every character of a token stands for one byte of the text
        self.widths = None
        if cuts is BYTE_CUTS:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
            self.widths[list(vocab.values())] = [len(t) for t in vocab]
        self.literals, self.ids = None, {}
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens.values()):
            raise ValueError(f"{path}: added tokens that aren't plain literals")
        if tokens:
            self.ids = {t.content: np.array([i], dtype="<u4") for i, t in tokens.items()}
            self.literals = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``encode`` of each text; new cuts of many texts are learnt together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.literals is None or not any(map(self.literals.search, texts)):
            yield from self._plain(texts)
            return
        parts = [self.literals.split(t) for t in texts]  # every second one is a literal
        plain = self._plain([p for x in parts for p in x[::2]])
        for x in parts:
            yield np.concatenate([self.ids[p] if i % 2 else next(plain) for i, p in enumerate(x)])

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts without added tokens."""
        if self.small:
            texts = [t if _COMPOSING.search(t) else t.encode().lower().decode() for t in texts]
        cuts = [self.cuts.findall(t) for t in texts]
        if next(filterfalse(self.cache.__contains__, chain.from_iterable(cuts)), None) is not None:
            self._learn(list(chain.from_iterable(cuts)))
        # the cache as it is now knows all of these, whatever is learnt before they are taken
        known = self.cache.__getitem__
        return (np.frombuffer(b"".join(map(known, c)), dtype="<u4") for c in cuts)

    def _learn(self, cuts: list[str]) -> None:
        """Make all of ``cuts`` known to the cache."""
        new = list(dict.fromkeys(filterfalse(self.cache.__contains__, cuts)))
        if len(self.cache) + len(new) > CACHE_CUTS:
            self.cache, self.older = {}, self.cache
            new = list(dict.fromkeys(cuts))
        cache, older = self.cache, self.older
        if older:
            cache.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in cache]
        if self.widths is not None:
            # one blank before something else always begins a piece, so such cuts stay apart in one text
            led = list(filter(_LED.match, new))
            for at in range(0, len(led), JOINED_CUTS):
                self._learn_joined(led[at : at + JOINED_CUTS])
            new = [c for c in new if c not in cache]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            cache[c] = _ids(e.ids)

    def _learn_joined(self, cuts: list[str]) -> None:
        """Encode cuts as one text and part its ids by the bytes they stand for."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(cuts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = self.widths[ids].cumsum()
        wanted = np.cumsum([len(c.encode()) for c in cuts])
        at = np.searchsorted(ends, wanted)
        if at[-1] != len(ids) - 1 or (ends[at] != wanted).any():
            return  # not parted at the cuts: they are encoded one by one
        line, at = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        self.cache.update((c, line[a:b]) for c, a, b in zip(cuts, at[:-1], at[1:], strict=True))


def _ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file; ``kind`` is ``byte`` or ``word``."""
    encoders = worker_cache(f"tokens {path} {kind}")
    if not encoders:
        encoders["encoder"] = Encoder(path, *{"byte": (BYTE_CUTS, False), "word": (WORD_CUTS, True)}[kind], added=True)
    return encoders["encoder"]
