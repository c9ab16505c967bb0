"""Public tokenizer vocabularies applied word by word, with a bounded memo of encoded words.

A byte-level vocabulary never merges across the boundary before a space that is
followed by a non-space, so a text's ids are the ids of such chunks in a row. Most
chunks repeat, so each worker encodes a chunk once and keeps its ids as packed
unsigned 32-bit little-endian bytes; a text's ids are then one ``bytes.join``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Words that a worker remembers.
MEMO_WORDS = 1 << 19

_ODD_SPACE = re.compile(r" (?:\s|$)")
_BOUNDARY = re.compile(r" (?=\S)")
_LOADED: dict[tuple[str, str], object] = {}


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Words and their packed ids. When it is full it stops growing; it starts anew if a batch finds under half of its words."""

    def missing(self, words: set) -> list:
        new = [w for w in words if w not in self]
        if len(self) >= MEMO_WORDS and 2 * len(new) > len(words):
            self.clear()
            new = list(words)
        return new

    def room(self) -> bool:
        return len(self) < MEMO_WORDS


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelVocabulary:
    """Ids of a ``tokenizers`` file, equal to its ``encode(text, add_special_tokens=False)``.

    Chunks are encoded from the file's own vocabulary by a faster encoder where the
    merges are numbered in order (tested for equal ids); other files, and chunks with a
    special token in them, go through ``tokenizers`` itself.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_chunk = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec.get("post_processor")
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added)
        )
        self.special = [t["content"] for t in added]
        self.fast = self._fast(spec["model"]) if self.by_chunk else None
        self.memo = Memo()

    @staticmethod
    def _fast(model: dict):
        import public_tokenizers
        import tiktoken

        vocab = model["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", [])]
        if model.get("type", "BPE") != "BPE" or made != sorted(made) or model.get("dropout") or model.get("ignore_merges"):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}
        single = max(ranks[bytes([b])] for b in range(256))
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i > single}
        if not made or single > min(made):
            return None
        known = set(made)
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in known}
        return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        fast = self.fast
        out = [array("I", fast(t)).tobytes() for t in texts]
        for special in self.special:
            for k, text in enumerate(texts):
                if special in text:
                    out[k] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as unsigned 32-bit little-endian."""
        if not self.by_chunk:
            return self._encode(texts)
        split = []
        for text in texts:
            parts = _BOUNDARY.split(text) if _ODD_SPACE.search(text) else text.split(" ")
            split.append((parts[0], parts[1:]))
        wanted: set[str] = set()
        for _, rest in split:
            wanted.update(rest)
        memo = self.memo  # of what follows a space
        new = memo.missing(wanted)
        found = dict(zip(new, self._encode([" " + w for w in new])))
        if memo.room():
            memo.update(found)
            found = {}
        firsts = self._encode([first for first, _ in split])
        if not found:
            return [b"".join([first, *[memo[w] for w in rest]]) for first, (_, rest) in zip(firsts, split)]
        return [b"".join([first, *[found[w] if (ids := memo.get(w)) is None else ids for w in rest]]) for first, (_, rest) in zip(firsts, split)]


class PieceVocabulary:
    """Ids of single words under a ``sentencepiece`` file with byte fallback."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.memo = Memo()

    def packed(self, word_lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of UTF-8 words, every word encoded on its own."""
        wanted: set[bytes] = set()
        for words in word_lists:
            wanted.update(words)
        memo = self.memo
        new = memo.missing(wanted)
        found = {w: array("I", ids).tobytes() for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1))} if new else {}
        if memo.room():
            memo.update(found)
            found = {}
        if not found:
            return [b"".join([memo[w] for w in words]) for words in word_lists]
        return [b"".join([found[w] if (ids := memo.get(w)) is None else ids for w in words]) for words in word_lists]


def load(kind: type, file: str):
    """One vocabulary a worker process and file."""
    key = (kind.__name__, file)
    if key not in _LOADED:
        _LOADED[key] = kind(file)
    return _LOADED[key]
