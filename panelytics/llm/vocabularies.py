"""Ids of whole texts by public tokenizers, a piece between blanks at a time."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import regex

#: Files of the tokenizers; any other path can be given.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Distinct pieces of text whose ids a task keeps anew before those not met since the last time go.
MOST_KEPT = 150_000


class Kept(dict):
    """What was met lately: once MOST_KEPT are new, what was met neither since then nor in the round before goes."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.before.get(key)
        if found is not None:
            self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > MOST_KEPT:
            self.before = dict(self)
            self.clear()

    def forget(self) -> None:
        self.before = {}
        self.clear()


class ChunkTokenizer:
    """A tokenizer that drops white space, so that the ids of a text are those of its pieces between blanks.

    The tokenizer in turn cuts a piece into words, numbers and signs by a pattern of its file, and the ids of each are
    its own. Ids of pieces and of their parts are kept in two rounds of MOST_KEPT. Results don't depend on it.
    """

    _loaded: dict[str, ChunkTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each
        self._tokenizer = Tokenizer.from_file(path)
        self._kept = Kept()
        self._parts = Kept()
        with open(path, encoding="utf-8") as file:
            first = json.load(file)["pre_tokenizer"]["pretokenizers"][0]
        if (first["type"], first["behavior"], first["invert"]) != ("Split", "Removed", True):
            raise ValueError(f"{path} doesn't cut texts by a pattern of parts that it keeps")
        self._tokenize = self._tokenizer.model.tokenize
        self._names: dict[str, str] = {}
        self._named = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._find = regex.compile(first["pattern"]["Regex"]).findall

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """The one of this Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        """Drop the kept ids: a worker goes on with other tasks."""
        self._kept.forget()
        self._parts.forget()

    def _parts_of(self, chunk: str) -> list[str] | None:
        """The parts of a piece; None where lower case or composition could depend on neighbours."""
        low = chunk.lower()
        if not chunk.isascii() and (
            len(low) != len(chunk) or "Σ" in chunk or not unicodedata.is_normalized("NFC", chunk)
        ):
            return None
        if low.isalpha():  # letters to Python are letters to the pattern; most pieces are a word, or one and a sign
            return [low]
        if low[-1:] in ",.;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return None if "<|" in chunk else self._find(low)

    def _encode(self, chunk: str) -> bytes:
        """Ids of a text without blanks."""
        own = self._parts_of(chunk)
        if own is None:
            return array("I", self._tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        parts, names, out = self._parts, self._names, []
        for part in own:
            ids = parts.get(part) or parts[part]
            if ids is None:
                # signs in print are their own bytes' names; others are named by the byte-level step, one by one
                plain = part if part.isascii() and part.isprintable() else "".join([names.get(c) or self._name(c) for c in part])
                ids = parts[part] = array("I", [t.id for t in self._tokenize(plain)]).tobytes()
            if len(own) == 1:
                return ids
            out.append(ids)
        return b"".join(out)

    def _name(self, sign: str) -> str:
        name = self._names[sign] = self._named(sign)[0][0]
        return name

    def ids(self, text: str) -> np.ndarray:
        """The ids of the whole text, without special tokens around it."""
        chunks = text.replace("\n", " ").split(" ")
        kept = self._kept
        kept.turn()
        self._parts.turn()
        found = list(map(kept.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    ids = kept[chunk]
                    if ids is None:
                        ids = kept[chunk] = self._encode(chunk)
                    found[i] = ids
        return np.frombuffer(b"".join(found), np.uint32)
