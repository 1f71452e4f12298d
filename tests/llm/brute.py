"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near_duplicates(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id); doc_ids are distinct."""
    sets = {}
    for i, t in rows:
        w = SPACE.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def license_base(t: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    hits = {k: [i for i in range(len(w)) if w[i : i + len(p)] == p] for k, p in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"]))}
    every = [i for v in hits.values() for i in v]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in hits.items() if v))


def secret_base(t: str | None) -> tuple:
    t = t or ""
    rules = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24))
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, flags, ok) in enumerate(rules) for m in re.finditer(p, t, flags) if ok(m))
    text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest(), text


def quality_base(t: str | None) -> tuple:
    t = t or ""
    w = SPACE.findall(t)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def ids_of(tokenizer, texts: list[str | None], end: int) -> list[np.ndarray]:
    return [np.array([*e.ids, end], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def judge(url: str | None, rules) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"
