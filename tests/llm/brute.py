"""Plain Python versions of what the operators return, for small tables."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, size: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_duplicates(docs: list[tuple[int, str | None]], size: int = 2) -> dict[int, tuple[int, int, bool]]:
    sets = {i: shingle_set(t, size) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def personal_row(text: str | None) -> tuple:
    spans = personal(text)
    return (*(sum(k == kind for k, _, _ in spans) for kind in FORMS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


def quality_row(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def quality_kept(rows: list[dict], rules: dict[str, list[float]], risk: float, confidence: float, gain: float) -> dict[int, bool]:
    """doc_id -> kept, of rows with doc_id, stratum, base_failed, ratios (by rule), good (None without a label) and holdout."""
    labelled = [r for r in rows if r["good"] is not None and not r["base_failed"]]
    sizes: dict[str, int] = {}
    for r in labelled:
        if r["good"] and r["holdout"]:
            sizes[r["stratum"]] = sizes.get(r["stratum"], 0) + 1
    needed = lambda m: math.log(confidence / m) / math.log(1 - risk)
    order = sorted((s for s in sizes if sizes[s] >= needed(1)), key=lambda s: (-sizes[s], s))
    alone: list[str] = []
    for n in range(1, len(order) + 1):
        rest = sum(sizes.values()) - sum(sizes[s] for s in order[:n])
        if sizes[order[n - 1]] >= needed(n + (rest > 0)) and (not rest or rest >= needed(n + 1)):
            alone = order[:n]
    pooled = sum(sizes.values()) > sum(sizes[s] for s in alone)
    tests = len(alone) + (pooled or not alone)
    cuts: dict[str | None, dict[str, float]] = {}
    for group in [*alone, None]:
        mine = [r for r in labelled if (r["stratum"] if r["stratum"] in alone else None) == group]
        fit, held = [r for r in mine if not r["holdout"]], [r for r in mine if r["holdout"] and r["good"]]
        good, bad = [r for r in fit if r["good"]], [r for r in fit if not r["good"]]
        candidates = []
        for which, (name, steps) in enumerate(rules.items()):
            for step, c in enumerate(steps):
                lost, caught = sum(r["ratios"][name] > c for r in good), sum(r["ratios"][name] > c for r in bad)
                if caught > gain * (lost + 1) / (len(good) + 1) * len(bad):
                    candidates.append((lost / max(len(good), 1), step, which, name, c))
        chosen: dict[str, float] = {}
        for _, _, _, name, c in sorted(candidates):
            trial = chosen | {name: min(c, chosen.get(name, c))}
            k, n = sum(any(r["ratios"][x] > y for x, y in trial.items()) for r in held), len(held)
            tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k <= n * risk else 1.0
            if not n or tail > confidence / tests:
                break
            chosen = trial
        cuts[group] = chosen
    of = lambda r: cuts[r["stratum"] if r["stratum"] in alone else None]
    return {r["doc_id"]: not r["base_failed"] and not any(r["ratios"][x] > y for x, y in of(r).items()) for r in rows}


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_row(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def chat_row(turns: list[tuple[str, str]]) -> tuple:
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)


def media_row(text: str | None) -> tuple:
    raw = (text or "").encode()
    payload = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def article_text(page: str | None) -> str:
    """The text of a page whose article element holds nothing but its main text."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not m:
        return ""
    blocks = re.split(r"</?(?:p|h1|h2|br|li|ul|div)\b[^>]*>", m[1])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def packed(rows, ids: dict[int, np.ndarray], width: int = 1024) -> tuple[int, int]:
    """Checks pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); tokens and sequences."""
    rows = sorted(rows)
    at: dict[int, int] = {}
    for i, start, length, crc, n, _, _ in rows:
        assert start == at.get(i, 0) and n == len(ids[i]) and length > 0
        assert zlib.crc32(ids[i][start : start + length].astype("<u4").tobytes()) == crc
        at[i] = start + length
    assert at == {i: len(x) for i, x in ids.items()}
    ends: dict[int, int] = {}
    for _, _, length, _, _, sequence, offset in sorted(rows, key=lambda r: (r[5], r[6])):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert all(e <= width for e in ends.values())
    return sum(at.values()), len(ends)


def infilled(doc_id: int | None, text: str | None) -> tuple:
    """n, form, prefix_chars, middle_chars and the hashes of the output and the text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", len(prefix), len(middle), sha(output), sha(text)


def targets(docs: list[tuple]) -> dict[str | None, tuple[int, float]]:
    """Source -> its words and its target, of rows (id, text, source): weights 1, 2, 3 repeating, at most three times the words."""
    words: dict[str | None, int] = {}
    for _, text, source in docs:
        words[source] = words.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None] * (None in words)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    share = {s: sum(words.values()) * weight[s] / sum(weight.values()) for s in order}
    full: set[str | None] = set()
    while over := [s for s in order if share[s] > 3 * words[s] + 1e-9]:
        full |= set(over)
        excess = sum(share[s] - 3 * words[s] for s in over)
        open_ = sum(weight[s] for s in order if s not in full)
        for s in order:
            share[s] = 3.0 * words[s] if s in over else share[s] + (excess * weight[s] / open_ if s not in full else 0)
    return {s: (words[s], share[s]) for s in order}


def multiplier(sizes: list[int], target: float, scale: float) -> float:
    """By halving: where the tilted rates, at most 3, take so many words."""
    low, high = -1e5, 1e5
    for _ in range(200):
        middle = (low + high) / 2
        taken = sum(n * math.exp(min(middle * n / scale, math.log(3))) for n in sizes)
        low, high = (middle, high) if taken < target else (low, middle)
    return low


def runs(s: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    """All periods tried from the smallest: stretches that agree with themselves moved by the period."""
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(shortest, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((i, n, p) for (i, n), p in out.items())


def tailed(doc_id: int | None, words: list) -> list:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def numpy_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """``runs`` for longer texts: the stretches of each period by numpy."""
    number: dict[str, int] = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(s) // 2 + 1):
        same = np.concatenate([[0], (s[p:] == s[:-p]).astype(np.int8), [0]])
        steps = np.diff(same)
        for i, j in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
            if j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
    return sorted((i, n, p) for (i, n), p in out.items())


def run_row(doc_id: int | None, text: str | None) -> tuple:
    words = tailed(doc_id, WORD.findall(text or ""))
    found = numpy_runs(words)
    kept = [True] * len(words)
    for start, length, period in found:
        kept[start + period : start + length] = [False] * (length - period)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return len(found), *first, sha(lines), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k))
