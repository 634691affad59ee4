"""Texts as codes of distinct pre-tokens, so that a tokenizer sees each distinct pre-token of a slice once.

A text is cut only where the tokenizer itself never joins two characters, so the ids (or counts) of the
pieces, one after the other, are those of the whole text:

* ``byte``: byte-level BPE whose pre-tokens never hold a visible character followed by white space. Cuts stand
  before a blank or line feed that follows a visible character.
* ``word``: BPE with word ends that drops white space. Cuts stand at runs of white space.
* ``piece``: sentencepiece BPE in which no piece holds a blank after another character and none holds a line
  feed. Cuts stand before line feeds and before blanks that don't follow a blank.

Texts in which a cut can't be told from one character alone (blanks in a row) take the same cuts by a
regular expression.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat

SEP = "\x1f"
#: sentencepiece writes blanks as this character, so one in a text is a blank to it.
BLANK = "\u2581"
#: White space by any reading, before a blank or line feed.
_DOUBLE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{180e}\x{200b}\p{Z}][ \n]"
_BYTE_CUT = re.compile(r"(?<=[^\s\u180e\u200b])(?=[ \n])")
_PIECE = re.compile(r" +[^ \n]*|\n[^ \n]*")


def _by_cut(text: str) -> list[str]:
    return _BYTE_CUT.split(text)


def split(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each pre-token, offsets of the texts in the codes, distinct pre-tokens)."""
    texts = flat(texts)
    if kind == "word":
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        for x in "\n\t\r":
            lower = pc.replace_substring(lower, x, " ")
        parts = flat(pc.split_pattern(lower, " "))
    else:
        if kind == "piece":
            texts = pc.replace_substring(texts, BLANK, " ")
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise("", texts, " "))
            odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SEP))
        else:
            odd = pc.or_(pc.match_substring_regex(texts, _DOUBLE), pc.match_substring(texts, SEP))
        fast = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", SEP + " "), "\n", SEP + "\n")
        parts = flat(pc.split_pattern(fast, SEP))
        if pc.any(odd).as_py():
            cut: Callable[[str], list[str]] = _PIECE.findall if kind == "piece" else _by_cut
            rows, slow = parts.to_pylist(), texts.to_pylist()
            parts = pa.array([cut(t) if o else r for r, t, o in zip(rows, slow, odd.to_pylist(), strict=True)], pa.list_(pa.string()))
    values = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return values.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], values.dictionary.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


class Cache:
    """Values of pre-tokens, made once each; two generations of ``limit`` at most, so memory stays bounded and what recurs stays.

    A Python worker serves stage after stage: the caches of another ``owner`` are emptied when one is used, so they don't add up.
    """

    _in_use: list["Cache"] = []

    def __init__(self, make: Callable[[list[str]], list], limit: int = 400_000, owner: object = None):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}
        self.owner = self if owner is None else owner

    def _alone(self) -> None:
        held = Cache._in_use
        if held and held[0].owner is not self.owner:
            for cache in held:
                cache.young, cache.old = {}, {}
            held.clear()
        if not any(cache is self for cache in held):
            held.append(self)

    def get(self, words: list[str]) -> list:
        """Values of distinct ``words``."""
        self._alone()
        young, old = self.young, self.old
        out = list(map(young.get, words))
        if missing := [i for i, v in enumerate(out) if v is None]:
            for i in missing:
                if (v := old.get(words[i])) is not None:
                    young[words[i]] = out[i] = v
            missing = [i for i in missing if out[i] is None]
            for a in range(0, len(missing), 20_000):
                part = [words[i] for i in missing[a : a + 20_000]]
                made = self.make(part)
                young.update(zip(part, made, strict=True))
                for i, v in zip(missing[a : a + 20_000], made, strict=True):
                    out[i] = v
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


_END = ".,;:!?"
#: The end of the Latin letters (without letters that normal forms or lower case take apart, but one).
_LATIN_END = "\u0250"
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level BPE names a byte by the character of its number if that can be seen, the others by 256 and on.
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _shown)}


_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file; kept in the Python worker from task to task."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.kind, model = kind, own.model

        def whole(words: list[str]) -> list[bytes]:
            """Ids of each word: a run of Latin letters (after a blank, for ``byte``) is one pre-token of either tokenizer, and neither
            changes it but for the case and the names of bytes, so the library's model takes it at once; the library does all
            steps for other words."""
            out: list[bytes] = [b""] * len(words)
            rest = []
            for i, w in enumerate(words):
                letters = w[1:] if kind == "byte" and w[:1] == " " else w
                if letters.isalpha() and (letters.isascii() or max(letters) < _LATIN_END and "\u0130" not in letters):
                    plain = w.lower() if kind == "word" else w
                    out[i] = array("I", [t.id for t in model.tokenize(plain.encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
                else:
                    rest.append(i)
            for i, e in zip(rest, own.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
            return out

        stems = Cache(whole, owner=self)

        def encode(words: list[str]) -> list[bytes]:
            # both tokenizers cut between a letter and these marks, so a word is encoded once, whatever mark follows it
            cut = [w.rstrip(_END) for w in words]
            cut = [c if c[-1:].isalpha() else w for c, w in zip(cut, words, strict=True)]
            ends = [w[len(c) :] for c, w in zip(cut, words, strict=True)]
            parts = list(dict.fromkeys([*cut, *ends]))
            known = dict(zip(parts, stems.get(parts), strict=True))
            return [known[c] + known[e] for c, e in zip(cut, ends, strict=True)]

        self.cache = Cache(encode, 200_000, owner=self)

    @classmethod
    def of(cls, path: str, kind: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path, kind)
        return _encoders[path]

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, list[str]], np.ndarray]:
        """All ids with ``end`` after each text; their number for each text; the split; ids in each pre-token."""
        codes, offsets, words = split(texts, self.kind)
        coded = self.cache.get(words)
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        pool = np.frombuffer(b"".join(coded), "<u4")
        first = np.cumsum(length) - length
        per = length[codes]
        sums = np.concatenate([[0], np.cumsum(per)])
        n = sums[offsets[1:]] - sums[offsets[:-1]] + 1
        out = np.empty(int(n.sum()), "<u4")
        ends = np.cumsum(n) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = pool[ragged(first[codes], per)]
        out[ends] = end
        return out, n, (codes, offsets, words), per
