"""Token ids of whole texts with a public tokenizer file, as raw little-endian unsigned 32-bit ids.

The tokenizers library encodes a text one pre-token at a time, so a text may be cut wherever a pre-token
surely ends. That holds before a space or line feed that is followed by a character that is not white space, and
between a word of letters and ASCII punctuation (no apostrophe) up to the next space, for byte-level vocabularies and for those with word ends.
A batch of texts is cut and its segments are numbered by Arrow; each distinct segment is encoded once
and remembered; numpy then lays the ids of all segments end to end. The memory holds two
generations of at most `KEEP` segments each, so it is bounded whatever the corpus."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 200_000
#: Characters that are cut and encoded together, or one longer text.
BATCH = 2_000_000
_CUT = re.compile(r"(?=[ \n]\S)")
#: A space or line feed before white space or the end, the mark used below, or the letter whose lower case is two: such texts are cut by `_CUT`.
_ODD = r"[ \n]([\s\p{Z}\x{85}\x{1c}-\x{1f}]|$)|\x01|\x{130}"
#: Punctuation that ends a word of letters and does not belong to it.
_TAIL = r"(\p{L})([!-&(-/:-@\[-`{-~]+)( |$)"


def spelled(part: str) -> str:
    """The text that a segment stands for: `\\1` marks one to be taken as it is, a line feed begins its own, others have lost a space."""
    return part if part[0] == "\n" else part[1:] if part[0] == "\1" else " " + part


class IdEncoder:
    """Encodes texts to bytes of ids; special tokens written in a text count as ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        one, other = self._each([" word", "\nWORD"])
        self.folds = one == other

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters, each after `before`: encoded in one text and told apart by pre-token."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            e = self.tokenizer.encode(before + before.join(some), add_special_tokens=False)
            ids, word = np.array(e.ids, "<u4"), np.array(e.word_ids)
            ends = np.r_[np.flatnonzero(word[1:] != word[:-1]) + 1, len(ids)]
            if len(ends) % len(some):  # another view of what letters are
                out += self._each([before + x for x in some])
                continue
            raw, start = ids.tobytes(), 0
            for end in (4 * ends[len(ends) // len(some) - 1 :: len(ends) // len(some)]).tolist():
                out.append(raw[start:end])
                start = end
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        words, lines, missing = [], [], []
        for x in [x for x, ids in zip(parts, found) if ids is None]:
            if x in old:
                young[x] = old[x]
            else:
                (words if x.isalpha() else lines if x[0] == "\n" and x[1:].isalpha() else missing).append(x)
        young.update(zip(words, self._words(words, " ")))
        young.update(zip(lines, self._words([x[1:] for x in lines], "\n")))
        young.update(zip(missing, self._each([spelled(x) for x in missing])))
        out = [young[x] if ids is None else ids for x, ids in zip(parts, found)]
        for x in missing:
            if len(x) > 64:  # not worth keeping
                del young[x]
        return out

    def _batch(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            cut = pa.array([["\1" + p for p in _CUT.split(t) if p] if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
            texts = pc.if_else(odd, "", texts)
        else:
            cut = None
        # Lower-casing vocabularies that drop white space give a word the same ids in any case and on any line.
        texts = pc.utf8_lower(pc.replace_substring(texts, "\n", " ")) if self.folds else pc.replace_substring(texts, "\n", " \n")
        marked = pc.utf8_replace_slice(pc.replace_substring_regex(texts, _TAIL, "\\1 \1\\2\\3"), 0, 0, "\1")
        lists = pc.split_pattern(marked, " ")
        if cut is not None:
            lists = pc.if_else(odd, cut, lists)
        coded = lists.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, index = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        first, each = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.r_[0, np.cumsum(each)]
        raw = memoryview(ids[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])].tobytes())
        at = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        bounds = (4 * ends[at]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield bytes(raw[a:b])

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
            yield from self._batch(texts.slice(at, upto - at))
            at = upto


@lru_cache(maxsize=4)
def encoder(path: str) -> IdEncoder:
    """One encoder per Python worker and file."""
    return IdEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
