"""Plain-Python results of the text operators, straight from their rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str, size: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def near(rows: dict[int, str]) -> dict[int, tuple]:
    sets = {i: shingle_set(t) for i, t in rows.items()}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    links = set()
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                links.add((i, j))
    part = components(rows, links)
    return {i: (len(sets[i]), part[i], part[i] == i) for i in rows}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text: str) -> tuple:
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "ip":
            return all(int(p) <= 255 for p in m[0].split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and _luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m)] for k, p in patterns.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k in patterns for a, b in found[k])
    return (*[len(found[k]) for k in patterns], sha(joined), joined)


def secret(text: str) -> tuple:
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    n = [len(found)]
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        own = [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
        n.append(len(own))
        found += own
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return (*n, sha(joined), joined)


def quality(text: str) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def licence(text: str) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for p, label in phrases.items() for k in [p.split()] for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def exact(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    norm = {i: re.sub(f"[{SPACE}]", "", t or "") for i, t in rows}
    size = {i: len(t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, _ in rows:
        groups[norm[i]].append(i)
    out = {}
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-size[i], i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, sha(text))
    return out
