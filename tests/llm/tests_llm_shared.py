"""Brute-force versions that several tests use."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers
import xxhash

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_rules(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def brute_fingerprint(text, width=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_shingles(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def check_pieces(rows, pieces, capacity=1024):
    """Each id in exactly one piece, sequences gapless and within the capacity; returns the padding."""
    tok = tokenizers.Tokenizer.from_file(PATH)
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in rows]
    want, got = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for d, x in ids:
        want[d, len(x)].append(x)
    assert set(want) == set(got)
    for key, texts in want.items():
        have = sorted(got[key])
        if len(texts) == 1:
            at = 0
            for start, length, crc in have:
                assert start == at and crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(texts[0])
        else:
            assert sum(n for _, n, _ in have) == sum(map(len, texts))
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    total = [sum(n for _, n in s) for s in used.values()]
    return sum(capacity - n for n in total if n & (n - 1)) / (capacity * len(total)), len(total)
