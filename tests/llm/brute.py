"""The contracts spelled out in plain Python, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str) -> tuple[dict[str, int], str]:
    kinds = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    spans = []
    for order, (kind, (pattern, good)) in enumerate(kinds.items()):
        spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if good(m)]
    counts = {k: sum(s[2] == k for s in spans) for k in kinds}
    return counts, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text: str) -> tuple[dict[str, int], str]:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = []
    for order, (kind, (pattern, good)) in enumerate(kinds.items()):
        spans += [(order, m.start(), kind, m.end()) for m in re.finditer(pattern, text) if good(m)]
    counts = {k: sum(s[2] == k for s in spans) for k in kinds}
    return counts, ",".join(f"{k}:{a}:{b}" for _, a, k, b in sorted(spans))


def components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found: dict[int, int] = {}
    for node in sorted(nodes):
        todo = [node]
        while todo:
            at = todo.pop()
            if at not in found:
                found[at] = node
                todo += near[at]
    return found


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def top_k(rows: list[tuple[int, list[float]]], every: int, k: int) -> set[tuple[int, int, int, int]]:
    whole = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows]
    out = set()
    for i, v in whole:
        if i % every == 0:
            best = sorted((-int(v @ w), j) for j, w in whole if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out
