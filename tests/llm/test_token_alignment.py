import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import sentencepiece
import tokenizers
from tests_llm_shared import PATH

from meshwork.llm import token_alignment
from meshwork.llm.tokens import byte_alphabet

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(of(i))))
        at += len(of(i))
    return out


def brute(rows):
    """Intervals of plain tokenizers, every overlap by comparison."""
    left = tokenizers.Tokenizer.from_file(PATH)
    left.encode_special_tokens = True
    right, alphabet = sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_alphabet()
    out, corpus = [], Counter()
    for doc, text, _ in rows:
        a_of = lambda i: bytes(alphabet[c] for c in left.id_to_token(i))

        def b_of(i):
            p = right.id_to_piece(i)
            return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

        want = (" " + (text or "")).encode()
        a, b = spans(left.encode(" " + text, add_special_tokens=False).ids, a_of) if text else [], spans(right.encode(text), b_of) if text else []
        if not text or b"".join(a_of(i) for i, _, _ in a) != want or b"".join(b_of(i) for i, _, _ in b) != want:
            a, b = [], []
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links, first = [], Counter(), 0
        for e in ends:
            in_a, in_b = ([x for x in side if first <= x[1] and x[2] <= e] for side in (a, b))
            groups.append(",".join(str(x[0]) for x in in_a) + "|" + ",".join(str(x[0]) for x in in_b))
            links.update((x[0], y[0]) for x in in_a for y in in_b if x[1] < y[2] and y[1] < x[2])
            first = e
        corpus += links
        out.append((doc, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, y), n in corpus.items():
        top[y] = max(top[y], n)
    return sorted(
        (
            (d, n_a, n_b, len(g), sum(links.values()), sum(n for p, n in links.items() if corpus[p] == top[p[1]]), sum(n * corpus[p] for p, n in links.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, n_a, n_b, g, links in out
        ),
        key=str,
    )


def small(sample, odd):
    return [r for r in sample[:40] if len(r[1] or "") < 4000] + [r for r in odd if len(r[1] or "") < 4000] + [
        (800, "a▁b", "a"), (801, "<s> <unk> </s> <0x41> <|endoftext|>", "a"), (802, " two  spaces \n\n\t", "a"), (803, "\U0001f600 日本語 ́e\x00z", "a"), (804, " ", "a"),
    ]


def test_alignment_against_brute_force(frame, sample, odd):
    rows = small(sample, odd)
    assert sorted(map(tuple, token_alignment.align(frame(rows), PATH, PIECES).collect()), key=str) == brute(rows)


def test_small_chunks_and_slices(frame, sample, odd, monkeypatch):
    """Chunks and slices of a few documents give the same; ``_aligned`` is pickled with the values it sees."""
    rows = small(sample, odd)

    def aligned(a, b):
        inner = token_alignment._aligned.__wrapped__(a, b)

        def run(batches):
            token_alignment.SLICE, token_alignment.ENTRIES = 3000, 500
            yield from inner(batches)

        return run

    aligned.__wrapped__ = token_alignment._aligned
    monkeypatch.setattr(aligned, "__wrapped__", token_alignment._aligned)
    monkeypatch.setattr(token_alignment, "_aligned", aligned)
    got = token_alignment.align(frame(rows), PATH, PIECES)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_links_are_those_of_a_range_join(sample):
    texts = [t for _, t, _ in sample[:30] if t]
    left, right = token_alignment.ByteLevel(PATH), token_alignment.Pieces(PIECES)
    import numpy as np

    con = duckdb.connect()
    con.register("a", token_alignment._intervals(left.encode(texts), np.array([len(x) for x in left.bytes])))
    con.register("b", token_alignment._intervals(right.encode(texts), np.array([len(x) for x in right.bytes])))
    con.execute(token_alignment.LINKS)
    got = con.execute(token_alignment.PAIRS, {"n_b": 32000}).fetchall()
    want = con.execute("SELECT a.doc, a.id::BIGINT * 32000 + b.id AS key, count(*) FROM a JOIN b ON a.s < b.e AND b.s < a.e GROUP BY 1, 2 ORDER BY 1, 2").fetchall()
    assert got == want


def test_long_texts_nulls_and_empty_tables(frame):
    rows = [(1, " " * 300_000, "a"), (2, "word " * 40_000, "a"), (None, None, "a"), (None, "", "a"), (4, "x" * 20_000, "a"), (4, "x" * 20_000, "a")]
    got = sorted(token_alignment.align(frame(rows), PATH, PIECES).collect(), key=str)
    assert len(got) == 6 and sum(r.n_a > 0 for r in got) == 4
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got)
    assert all(r.groups_sha256 == "" and r.count_sum == 0 for r in got if not r.n_a)
    assert token_alignment.align(frame([]), PATH, PIECES).count() == 0
    assert token_alignment.align(frame([(1, None, "a")]), PATH, PIECES).first().n_a == 0
