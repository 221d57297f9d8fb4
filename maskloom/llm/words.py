"""Normal words of texts: lower case, letters and digits of any script, everything else a gap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class _Gaps(dict):
    """For str.translate: characters that are not letters or digits become spaces; learnt as they come."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = code if c.isalnum() else 32
        return out


_GAPS = _Gaps({i: i if chr(i).isalnum() else 32 for i in range(256)})


def normal(text: str | None) -> str:
    """The normal words of a text with single spaces between."""
    return " ".join((text or "").lower().translate(_GAPS).split())


def hashed_words(texts: pa.Array, part: int = 1_000_000):
    """For each text in turn the 64-bit hashes of its normal words."""
    for lo in range(0, len(texts), 1000):
        yield from _hashed(texts.slice(lo, 1000).to_pylist(), part)


def _hashed(texts: list, part: int):
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= part):
            size += len(texts[upto] or "")
            upto += 1
        lists = pc.split_pattern(pa.array([normal(t) for t in texts[at:upto]], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = known[coded.indices.to_numpy()] if len(known) else known
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        start = 0
        for t, end in zip(lists, ends.tolist()):
            own = hashes[start:end]
            yield own if end - start > 1 or t[0].as_py() else own[:0]
            start = end
        at = upto
