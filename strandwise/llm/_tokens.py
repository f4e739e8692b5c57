"""Ids of a byte-level BPE vocabulary given as a tokenizers JSON file."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed value: how byte-level BPE vocabularies write the bytes that are not printable.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


#: Characters of a text that are turned into ids at a time, about.
LONG = 1 << 18
_CUT = re.compile("(?<=[a-z])(?= [a-z])")


def _byte_of_char() -> dict[str, int]:
    table = {chr(b): b for b in _PRINTABLE}
    others = (b for b in range(256) if b not in set(_PRINTABLE))
    return table | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """``ids(text)`` gives the ids that the tokenizers library gives with add_special_tokens=False.

    Vocabularies whose merges stand in id order are run by tiktoken, which applies the same merges
    and the same split pattern several times faster; any other file, and any text that tiktoken
    refuses, goes to the tokenizers library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        self.path = path
        self._slow = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.fast = self._tiktoken(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])

    @classmethod
    def _tiktoken(cls, spec: dict):  # noqa: ANN206
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = all(not t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or model.get("dropout") or not plain:
            return None
        byte = _byte_of_char()
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        ids = [vocab.get(t, -1) for t in merged]
        if ids != sorted(ids) or len(vocab) != 256 + len(merged):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("vocabulary", pat_str=cls.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _exact(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= LONG or self.fast is None or any(" " in s for s in self.special):
            return self._ids(text)
        return np.concatenate([self._ids(part) for part in self._parts(text)])

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Parts of a long text, cut between a letter and a space before a letter: the split pattern cuts there in any case."""
        begin = 0
        while begin < len(text):
            found = _CUT.search(text, begin + LONG)
            end = found.start() if found else len(text)
            yield text[begin:end]
            begin = end

    def _ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self._exact(text)
        try:
            allowed = "all" if any(s in text for s in self.special) else set()
            return self.fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except BaseException as error:  # its regex engine panics on some very long runs
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return self._exact(text)


_loaded: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


def pieces(ids: np.ndarray, end_id: int, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces, its end id included; only the first may be shorter than the capacity when there are several."""
    ids = np.append(ids, np.uint32(end_id))
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    begin, end = 0, first
    while begin < len(ids):
        yield begin, ids[begin:end]
        begin, end = end, end + capacity


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
