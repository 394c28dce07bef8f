"""Plain counterparts of the operators, and small awkward tables."""

import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, width=4):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def shingles(text, width=5):
    """Set of word shingles; a shorter text is one."""
    w = WORD.findall(lower(text))
    return {" ".join(w[i:i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def dedup_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    split = [(d, (t or "").split("\n")) for d, t in rows]
    docs, keeper = {}, {}
    for i, (d, ls) in enumerate(split):
        for k in {key(x) for x in ls}:
            docs.setdefault(k, set()).add(i)
            if d is not None:
                keeper[k] = max(d, keeper.get(k, d))
    out = []
    for d, ls in split:
        gone = [len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and keeper.get(key(x)) != d for x in ls]
        out.append((d, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)))
    return out


def contaminated(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = BENCH_WORD.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i:i + k]))):
                    found |= own
                    hit |= set(range(i, i + k))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    repeat = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


def crc(key):
    return zlib.crc32(str(key).encode())
