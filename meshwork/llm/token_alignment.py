"""Alignment of two tokenizers' tokens over the same bytes.

Each Arrow partition is aligned by DuckDB: the tokens of a slice of documents are two tables of byte intervals, one after the other, so
that document borders are token borders of both. An ASOF join finds the B token in which an A token starts, a range join those
B tokens that start inside an A token: together these are all overlaps. Where both start is a group's border; a window
sum over the borders numbers the groups of A tokens, and another ASOF join gives B tokens the group they lie in.

Id pairs are counted within a document, then within a *chunk* of documents of bounded size, and the partial counts of the chunks are
merged by Spark. The merged counts go back to the chunks that hold the pair, and each chunk meets its
documents again: what moves is a chunk's different pairs, not its links. Only the highest count of each B id is broadcast, a row for each entry
of the vocabulary at most.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.tokens import PATTERN, as_ranks, byte_alphabet
from meshwork.session import materialize, table

#: Bytes of text that DuckDB aligns at a time, and entries (document, pair) of a chunk; one longer document makes a slice or chunk of its own.
SLICE = 1 << 19
ENTRIES = 1 << 20
ALIGNED = "chunk long, whole boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, counts binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

LINKS = """
CREATE OR REPLACE TEMP TABLE a_of AS SELECT *, (sum(border::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING))::INT AS g
    FROM (SELECT a.doc, a.s, a.e, a.id, b.id AS b_id, a.s = b.s AS border FROM a ASOF JOIN b ON a.s >= b.s);
CREATE OR REPLACE TEMP TABLE borders AS SELECT s, g FROM a_of WHERE border;
CREATE OR REPLACE TEMP TABLE b_of AS SELECT b.doc, b.s, b.id, b.s = o.s AS border, o.g FROM b ASOF JOIN borders o ON b.s >= o.s;
CREATE OR REPLACE TEMP TABLE b_inside AS SELECT s, id, g FROM b_of WHERE NOT border;
"""
PAIRS = """
SELECT doc, key, count(*) AS n FROM (
    SELECT doc, id::BIGINT * $n_b + b_id AS key FROM a_of
    UNION ALL SELECT a.doc, a.id::BIGINT * $n_b + b.id FROM (SELECT * FROM a_of WHERE g IN (SELECT g FROM b_inside)) a JOIN b_inside b ON b.s > a.s AND b.s < a.e)
GROUP BY doc, key ORDER BY doc, key
"""
#: Groups of the tokens of each side in their order.
NUMBERS = ("SELECT g FROM a_of ORDER BY s", "SELECT g FROM b_of ORDER BY s")


class ByteLevel:
    """Ids of a byte-level ``tokenizers`` file for a space and the text as it is, strings of special tokens included, and the bytes of each id."""

    def __init__(self, path: str):
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        alphabet = byte_alphabet()
        vocabulary = model["model"]["vocab"] | {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.fast = None
        if ranks := as_ranks(model):  # then the same merges run in the faster library
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(" " + t) for t in texts]

    def one(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
            except ValueError:  # a run of about a million spaces is beyond the stack of its splitter
                pass
        if self.slow is None:
            import tokenizers

            self.slow = tokenizers.Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Ids of a ``sentencepiece`` model, which puts a space before the text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("i", x), np.int32) if x else np.empty(0, np.int32) for x in self.model.encode(texts, num_threads=1)]


class Bytes:
    """The bytes of a vocabulary, one entry after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, joined."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.all[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def _intervals(ids: list[np.ndarray], size: np.ndarray) -> pa.Table:
    """(doc, id, s, e): the tokens of all documents, one after the other over their bytes."""
    flat = np.concatenate(ids)
    end = np.cumsum(size[flat])
    small = np.int32 if end[-1] < 2**31 else np.int64
    return pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids]), "id": flat.astype(np.int32), "s": (end - size[flat]).astype(small), "e": end.astype(small)})


def _group_texts(a: list[np.ndarray], b: list[np.ndarray], g_a: np.ndarray, g_b: np.ndarray, signed: Bytes) -> list[bytes]:
    """Each document's groups as text: a token's place is its own number plus the tokens of the other side in groups before (of B: up to) its own.

    ``signed`` has the ids after ``;``, then after ``|``, then after a comma.
    """
    n_a, n_b, groups, ids = len(g_a), len(g_b), int(g_a[-1]) + 1, len(signed.size) // 3
    before_b, upto_a = np.searchsorted(g_b, np.arange(groups)), np.searchsorted(g_a, np.arange(groups), "right")
    place = np.concatenate([np.arange(n_a) + before_b[g_a], np.arange(n_b) + upto_a[g_b]])
    kind = np.concatenate([np.where(np.diff(g_a, prepend=-1) > 0, 0, 2), np.where(np.diff(g_b, prepend=-1) > 0, 1, 2)])
    word = np.empty(n_a + n_b, np.int64)
    word[place] = kind * ids + np.concatenate([*a, *b])
    joined = signed.of(word)
    tokens = np.cumsum([0] + [len(x) + len(y) for x, y in zip(a, b)])
    cuts = np.concatenate([[0], np.cumsum(signed.size[word])])[tokens].tolist()
    return [joined[x + 1 : y] for x, y in zip(cuts, cuts[1:])]


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        left, right = ByteLevel(a_path), Pieces(b_path)
        bytes_a, bytes_b = Bytes(left.bytes), Bytes(right.bytes)
        signed = Bytes([f"{sign}{i}".encode() for sign in ";|," for i in range(max(len(left.bytes), len(right.bytes)))])
        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        chunk, held, entries = TaskContext.get().partitionId() << 32, [], 0

        def rows(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in SCHEMA}, schema=SCHEMA)

        def pair_row() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            none = dict.fromkeys(FIGURES, [None])
            return rows(none | {"chunk": [chunk], "whole": [True], "keys": [keys.tobytes()], "counts": [counts.tobytes()]})

        for ids, texts in _slices(batches):
            a, b = left.encode(texts), right.encode(texts)
            for i, t in enumerate(texts):
                raw = b" " + t.encode()
                if not t or bytes_a.of(a[i]) != raw or bytes_b.of(b[i]) != raw:
                    a[i] = b[i] = np.empty(0, np.int32)
            n, zero = len(texts), [0] * len(texts)
            out = {"doc_id": ids, "n_a": [len(x) for x in a], "n_b": [len(x) for x in b], "n_groups": zero.copy(), "n_links": zero.copy(), "groups_sha256": [""] * n, "keys": [b""] * n, "counts": [b""] * n}
            if any(map(len, a)):
                con.register("a", _intervals(a, bytes_a.size))
                con.register("b", _intervals(b, bytes_b.size))
                con.execute(LINKS)
                g_a, g_b = (con.execute(q).fetchnumpy()["g"] - 1 for q in NUMBERS)
                for i, groups in enumerate(_group_texts(a, b, np.asarray(g_a), np.asarray(g_b), signed)):
                    if groups:
                        out["groups_sha256"][i] = hashlib.sha256(groups).hexdigest()
                        out["n_groups"][i] = groups.count(b"|")
                pairs = con.execute(PAIRS, {"n_b": len(right.bytes)}).fetchnumpy()
                doc, keys, counts = (np.asarray(pairs[c]).astype(np.int64) for c in ("doc", "key", "n"))
                cuts = np.searchsorted(doc, np.arange(n + 1))
                for i in range(n):
                    part = slice(cuts[i], cuts[i + 1])
                    out["keys"][i], out["counts"][i], out["n_links"][i] = keys[part].tobytes(), counts[part].tobytes(), int(counts[part].sum())
                held.append((keys, counts))
                entries += len(keys)
            yield rows(out | {"chunk": [chunk] * n, "whole": [False] * n})
            if entries >= ENTRIES:
                yield pair_row()
                chunk, held, entries = chunk + 1, [], 0
        if held:
            yield pair_row()
        con.close()

    return run


SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in ALIGNED.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most SLICE bytes, or of one longer text."""
    for b in batches:
        size = pc.binary_length(b.column(1)).to_numpy()
        first, held = 0, 0
        for i in range(b.num_rows + 1):
            if i == b.num_rows or (held and held + size[i] > SLICE):
                if i > first:
                    part = b.slice(first, i - first)
                    yield part.column(0).to_pylist(), part.column(1).to_pylist()
                first, held = i, 0
            if i < b.num_rows:
                held += int(size[i])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            keys, counts = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b.column(0)[i].as_py())), pa.array(keys), pa.array(counts)], ["chunk", "key", "n"])


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a chunk with the corpus-wide counts of their pairs."""
    key = pairs["key"].to_numpy()
    by = np.argsort(key)
    key, total, best = key[by], pairs["total"].to_numpy()[by], pairs["best"].to_numpy().astype(np.int64)[by]
    keys = [np.frombuffer(k, np.int64) for k in docs["keys"].to_pylist()]
    size = np.array([len(k) for k in keys], np.int64)
    at = np.searchsorted(key, np.concatenate([*keys, np.empty(0, np.int64)]))
    n = np.frombuffer(b"".join(docs["counts"].to_pylist()), np.int64)
    ends = np.cumsum(size)
    sums = []
    for value in (best[at] * n, total[at] * n):
        run = np.concatenate([[0], np.cumsum(value)])
        sums.append(pa.array(run[ends] - run[ends - size]))
    out = {c: docs[c] for c in FIGURES} | {"n_best": sums[0], "count_sum": sums[1]}
    return pa.table({c.split()[0]: out[c.split()[0]] for c in RESULT.split(", ")})


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the counts of its tokens, groups and links, and of its links over the whole corpus.

    ``a_path`` is a byte-level ``tokenizers`` file, ``b_path`` a ``sentencepiece`` model; every machine has both. Texts that are null or
    empty, or that the tokens' bytes don't give back, have no tokens: zeros and an empty digest. Repeated rows count as often as they
    occur; of B ids whose highest count several A ids share, all these links are best. An empty table gives an empty result. A very long text
    is a slice of its own: a task then needs memory in proportion to that text. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    aligned = materialize(rows.mapInArrow(_aligned(a_path, b_path), ALIGNED))
    pairs = aligned.where("whole").select("chunk", "keys", "counts").mapInArrow(_pair_rows, "chunk long, key long, n long")
    n_b = len(Pieces(b_path).bytes)
    merged = materialize(pairs.groupBy("key").agg(F.sum("n").alias("total")))
    b_id = F.pmod("key", F.lit(n_b))
    highest = merged.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))
    counted = merged.join(F.broadcast(highest), b_id == F.col("b_id")).select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = pairs.join(counted, "key").select("chunk", "key", "total", "best")
    own = aligned.where("not whole").select("chunk", *FIGURES, "keys", "counts")
    return own.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed, RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
