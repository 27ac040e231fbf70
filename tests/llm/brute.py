"""Plain Python versions of the operators, for small inputs."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def secrets(text: str) -> list[tuple[int, int, int, str]]:
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    return ([(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
            + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def hull(value: str, window: int, bits: float) -> tuple[int, int] | None:
    """Start and end of all windows of high entropy."""
    on = []
    for i in range(len(value) - window + 1):
        n = Counter(value[i: i + window])
        if -sum(c / window * math.log2(c / window) for c in n.values()) >= bits:
            on.append(i)
    return (on[0], on[-1] + window) if on else None


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str) -> list[tuple[int, int, int, str]]:
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def quality(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fingerprint(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(values: list[int], radius: int) -> list[int]:
    """Index of the first member of each value's component."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def overlaps(text: str, item: str) -> bool:
    """Whether some window of 13 words (of an item's all words, if fewer) agrees but for 2 (one in five)."""
    w, b = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
    size, allowed = (13, 2) if len(b) >= 13 else (len(b), min(2, len(b) // 5))
    return bool(b) and any(sum(x != y for x, y in zip(w[i: i + size], b[j: j + size])) <= allowed for i in range(len(w) - size + 1) for j in range(len(b) - size + 1))
