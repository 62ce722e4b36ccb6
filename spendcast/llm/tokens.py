"""Token ids of whole texts with a public tokenizer, one small cache per Python worker.

Both kinds of tokenizer treat the stretches between white space each by itself, so a text's ids are those of its
stretches in a row; so do letters and the marks after them. A stretch seen before is looked up; only new ones go through the merges, which cost a
microsecond per byte. For the word-level tokenizer the stretches of many texts are found in their bytes at once, and
only different ones become Python objects.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import kept, map_columns

# Stretches kept per worker; beyond that the cache starts anew.
CACHED = 1_200_000
# Characters split at a time.
AT_ONCE = 1_000_000

# Letters up to a mark or white space with the one space before them, other stretches without white space, or white
# space as the byte-level pattern divides it. Tokens never reach from letters into ASCII marks.
STRETCH = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![\w\u0080-\U0010ffff])"
BYTE_LEVEL = re.compile(rf" ?{STRETCH}| ?\S+|\s+(?!\S)|\s+")
# At the word level: white space, ASCII letters, ASCII marks (0, 1 and 2), and all other bytes.
KIND = np.full(256, 3, np.uint8)
KIND[[c for c in range(128) if not (chr(c).isalnum() or c == ord("_"))]] = 2
KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
KIND[list(b" \t\n\x0b\x0c\r")] = 0
# Python counts these as white space, the tokenizers don't: such texts are encoded in one go, and so are those that
# spell one of the tokenizer's added tokens, which the library finds before anything else.
ODD = "[\x1c-\x1f]"


class Places(dict):
    """Numbers stretches as they come and remembers the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = place = len(self)
        self.new.append(stretch)
        return place


def word_stretches(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different stretches of texts, which of them stand in a row, and how many each text has.

    A stretch is what stands between white space, but letters up to an ASCII mark are one of their own. The tokenizer
    takes capitals for small letters; those of texts in ASCII alone are made small here, so that fewer are different.
    """
    raw = [(t.lower() if t.isascii() else t).encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)  # white space around every text
    kind = KIND[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != 0) & (kind[:-1] == 0)
    first = np.flatnonzero(begins)
    others = np.flatnonzero(kind != 1)
    ends = others[np.searchsorted(others, first)]  # of the letters that a stretch begins with
    begins[ends[(ends > first) & (kind[ends] == 2)]] = True
    held = kind != 0
    starts = np.flatnonzero(begins)
    cuts = np.append(np.cumsum(held)[starts] - 1, np.count_nonzero(held)).astype(np.int32)
    flat = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[held])])
    found = flat.dictionary_encode()
    until = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.diff(until, prepend=0)


class Encoder:
    """``ids`` of texts with the tokenizer file at ``path``, followed by ``end_id``."""

    def __init__(self, path: str, end_id: int):
        # a task has one core; the library's own threads take more time than they save
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD, *added]), re.IGNORECASE)
        # a text without any of these characters is not odd, which is found out faster; letters would come in two cases
        self.signs = {*map(chr, range(0x1C, 0x20)), *(t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values())}
        self.plain_signs = not any(c.lower() != c.upper() for c in self.signs)
        self.byte_level = self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def is_odd(self, text: str) -> bool:
        return (not self.plain_signs or any(c in text for c in self.signs)) and self.odd.search(text) is not None

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the texts' stretches in a row, and how many each text has."""
        odd = [i for i, t in enumerate(texts) if self.is_odd(t)]
        if self.byte_level:
            parts = [BYTE_LEVEL.findall(t) for t in texts]
            for i in odd:
                parts[i] = [texts[i]]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            return np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum())), sizes
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        different, row, sizes = word_stretches(plain)
        at = np.fromiter(map(self.places.__getitem__, different), np.int64, len(different))[row]
        whole = [self.places[texts[i]] for i in odd]
        at = np.insert(at, (np.cumsum(sizes) - sizes)[odd], whole) if odd else at
        sizes[odd] = 1
        return at, sizes

    def encoded(self, stretches: list[str]) -> list[list[int]]:
        """The ids of each. At the word level, small ASCII letters alone are one word as they are: they go to the model."""
        small = [not self.byte_level and s.isascii() and s.isalpha() and s.islower() for s in stretches]
        others = self.tokenizer.encode_batch_fast([s for s, alone in zip(stretches, small, strict=True) if not alone], add_special_tokens=False)
        rest = iter(others)
        return [[t.id for t in self.model.tokenize(s)] if alone else next(rest).ids for s, alone in zip(stretches, small, strict=True)]

    def learn(self) -> None:
        new, self.places.new = self.places.new, []
        found = self.encoded(new)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > CACHED:
            self.clear()
        at, sizes = self.placed(texts)
        if self.places.new:
            self.learn()
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + lengths, lengths)
        ids = self.ids[where]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        end = np.array([self.end_id], np.uint32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        waiting, size = [], 0
        for text in texts:
            waiting.append(text or "")
            size += len(waiting[-1])
            if size >= AT_ONCE:
                yield from self.encode(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self.encode(waiting)


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's own encoder; Spark keeps Python workers, so the cache serves later tasks as well, until it is idle."""
    return kept((path, end_id), lambda: Encoder(path, end_id))


def token_ids(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """``key`` and ``ids``, little-endian unsigned 32-bit (16-bit where the vocabulary fits), with ``end_id`` at the end.

    A NULL text is an empty one. The width is in ``width``.
    """

    def encode(texts: list[str | None]) -> tuple:
        own = encoder(tokenizer, end_id)
        width = 2 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids = [x.astype(f"<u{width}").tobytes() for x in own.encode_all(texts)]
        return None, [ids, np.full(len(ids), width, np.int32)]

    return map_columns(docs, [key], [F.col(f"`{text}`").cast("string")], encode, "ids binary, width int")
