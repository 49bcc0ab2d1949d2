"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remove_repeats(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[hashlib.blake2b(r[i : i + length], digest_size=16).digest()] += 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hashlib.blake2b(r[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def starts_elsewhere(texts: list[str | None], length: int) -> list[bool]:
    """Whether a string of `length` bytes of the text also starts at another place, copies of a text taken as one."""
    seen: dict[bytes, int] = defaultdict(int)
    for r in {(t or "").encode() for t in texts}:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    raw = [(t or "").encode() for t in texts]
    return [any(seen[r[i : i + length]] > 1 for i in range(len(r) - length + 1)) for r in raw]


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def components(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(id, set size, smallest id of the class) by row; brute force over the pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    pairs = {(a, b) for held in where.values() for n, a in enumerate(held) for b in held[n + 1 :]}
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def benchmark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts: list[str | None], items: list[tuple[int | str, str | None]], window: int = 10) -> list[tuple[int, int, int, str]]:
    windows = defaultdict(set)
    for name, text in items:
        words = benchmark_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            windows[tuple(words[i : i + size])].add(str(name))
    sizes = sorted({len(w) for w in windows})
    out = []
    for text in texts:
        words = benchmark_words(text)
        hit, found = [False] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    found |= names
                    hit[i : i + size] = [True] * size
        out.append((len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
