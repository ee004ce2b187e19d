"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from linkloom.llm.common import AT_END

SHINGLE = 5
#: Words whose hashes a task keeps at most.
CACHE_WORDS = 150_000


class _Hashes(dict):
    """Hashes of words; one that is not there yet is computed and kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_cache = _Hashes()
AT_END.append(_cache.clear)


def mixed(x):
    """A 64-bit finalizer over an array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x):
    """The distinct values of an array, sorted: by a sort and a mask, several times quicker here than by a hash table."""
    import numpy as np

    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def text_bytes(text) -> bytes:
    """UTF-8 of an Arrow string; null is empty."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def shingle_set(text: bytes, size: int = SHINGLE):
    """Distinct shingles of a whole UTF-8 text; one of all words where it has fewer than ``size``, none where it has no words.

    Words are runs of bytes other than the six that ``bytes.split`` cuts at.
    """
    import numpy as np

    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    ids = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    k = min(size, len(ids))
    out = ids[: len(ids) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j]
    return distinct(mixed(out + np.uint64(k)))


def set_key(shingles) -> int:
    """A signed 64-bit name of a set, the same for equal sets."""
    import numpy as np

    total = np.asarray([mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)
    return int(mixed(total).view(np.int64)[0])
