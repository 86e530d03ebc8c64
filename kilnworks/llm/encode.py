"""Token ids of whole texts, through the tokenizers library, inside Python workers.

Texts repeat their words, so a worker encodes each distinct word once and joins the remembered ids.
Texts are cut only where the tokenizer's own pre-tokenizer cuts too, so the ids are those of the
whole text; a text or piece that may break this rule is encoded as it is.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one worker remembers; then the older half is forgotten.
REMEMBERED = 250_000
ID = np.dtype("<u4")
_MARKS = frozenset(".,;:!?")
#: A comma or full stop behind something other than a letter or digit may share a word with it.
_RUN = r"[^\pL\pN][.,]"
#: White space that meets other white space or an end of the text, or is neither space nor line end.
_ODD = (r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _texts(words: pa.Array) -> list[str]:
    """Python strings of an array; one long string is made and cut, which is faster than one by one."""
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\x01")[0].as_py().split("\x01")
    return joined if len(joined) == len(words) else words.to_pylist()


class Encoder:
    """``drops_space``: the tokenizer lower-cases, drops white space and marks the ends of words."""

    def __init__(self, path: str, drops_space: bool, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.drops_space, self.remembered = drops_space, remembered
        self.letters = _byte_letters()
        self.seen: dict[str, bytes] = {}
        self.line_end = b"" if drops_space else self._whole("\n").tobytes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=ID)

    def _word(self, text: str) -> bytes:
        """One piece; a word of Latin letters is one word of the pre-tokenizer and goes to the model itself."""
        stem = text.removeprefix(" ")
        if not _LATIN.fullmatch(stem):
            return self._whole(text).tobytes()
        if self.drops_space:
            text = text.lower()
        spelled = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _piece(self, key: str) -> bytes:
        if self.drops_space:
            lead, text = b"", key
        elif key[:1] == "\n":
            lead, text = self.line_end, key[1:]
        elif key[:1] == "\x00":
            lead, text = b"", key[1:]
        else:
            lead, text = b"", f" {key}"
        if text[-1:] in _MARKS and _LATIN.fullmatch(text[:-1].removeprefix(" ")):
            return lead + self._word(text[:-1]) + self._word(text[-1])
        return lead + self._word(text) if text else lead

    def _pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys."""
        got = list(map(self.seen.get, keys))
        if len(self.seen) > self.remembered:
            self.seen = dict(list(self.seen.items())[self.remembered // 2:])
        for k, ids in enumerate(got):
            if ids is None:
                got[k] = self.seen[keys[k]] = self._piece(keys[k])
        return got

    def _keys(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of texts that may be cut at their spaces and line ends."""
        apart = [(", ", " , "), (". ", " . "), (".\n", " . ")] if self.drops_space else [(", ", " \0, "), (". ", " \0. "), (".\n", " \0.\n")]
        cut = texts
        for mark, instead in apart:
            cut = pc.replace_substring(cut, mark, instead)
        cut = pc.if_else(pc.match_substring_regex(texts, _RUN), texts, cut)
        # a key follows a space, unless a line end or \0 opens it
        cut = pc.replace_substring(cut, "\n", " " if self.drops_space else " \n")
        return pc.split_pattern(cut if self.drops_space else pc.binary_join_element_wise("\0", cut, ""), " ")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's ids end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.zeros(len(texts), dtype=bool) if self.drops_space else pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = self._keys(pc.if_else(pa.array(odd), "", texts))
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        pieces = self._pieces(_texts(coded.dictionary))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        known = np.frombuffer(b"".join(pieces), dtype=ID)
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = known[np.repeat(starts[index] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = upto[bounds[1:]]
        if odd.any():
            parts, begins = [], np.concatenate([[0], ends[:-1]])
            for k in range(len(texts)):
                parts.append(self._whole(texts[k].as_py()) if odd[k] else ids[begins[k]:ends[k]])
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        return self.batch(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, drops_space, remembered)
