"""Byte-level BPE ids of a ``tokenizers`` file."""

from __future__ import annotations

import json

import numpy as np

#: The split of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def as_ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the ids are in the order of the merges, so that an id is a rank."""
    alphabet, special = byte_alphabet(), {t["content"] for t in model["added_tokens"]}
    pre, bpe = model["pre_tokenizer"] or {}, model["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["normalizer"] or bpe.get("ignore_merges"):
        return None
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    order = [bpe["vocab"][m] for m in merges]
    if order != sorted(order) or len(bpe["vocab"]) - len(special & set(bpe["vocab"])) != len(merges) + 256:
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in bpe["vocab"].items() if t not in special}


class Encoder:
    """``encode`` gives the ids that the file's tokenizer gives without adding special tokens.

    Where the file's ids are its merge ranks, the same merges run in the faster of the two libraries,
    after they have agreed on a sample. The strings of special tokens are matched in a text.
    """

    SAMPLE = "A few words,\n\n  don't l'été  größer 12345 %%% <|endoftext|> \tend. "

    def __init__(self, path: str):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if ranks := as_ranks(model):
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in model["added_tokens"]})
            if fast.encode(self.SAMPLE, allowed_special="all") == self.slow.encode(self.SAMPLE, add_special_tokens=False).ids:
                self.fast = fast

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of about a million spaces is beyond the stack of its splitter
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
