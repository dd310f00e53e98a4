"""Token ids of whole texts, by way of the distinct words of a batch.

Texts are cut in front of white space, where no token can reach across, and
each distinct piece goes through the tokenizer once; a text's ids are its
pieces' ids, joined. Texts whose white space is not single blanks or line
breaks between words are encoded whole.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers up to twice as many pieces: those met since it last had so
#: many, and the ones before them. It bounds memory only; ids don't depend on it.
#: Where case and blanks count, as many pieces cover fewer words: twice as many are kept.
REMEMBERED = 300_000

#: Characters of text that are cut up at a time; a longer text is a batch of its own.
BATCH = 2_000_000

#: New pieces that go through a tokenizer at a time; what it gives takes far more memory than ids.
LEARNT = 10_000

_CUT = "\x00"
_LATIN_END = "ɐ"  # below it, every letter is one code point that stays as it is

_coders: dict[tuple[str, bool], Coder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte → the letter that byte-level vocabularies write for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Coder:
    """A vocabulary file; `folds_space`: its tokenizer lower-cases and drops white space."""

    def __init__(self, name: str, folds_space: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer(self.tokenizer.model)  # the same merges, for words already cut
        self.folds_space = folds_space
        self.known: dict[str, bytes | None] = {"": b""}
        self.older: dict[str, bytes | None] = {}
        self.begins: np.ndarray | None = None  # which ids stand for a blank and what follows it
        if not folds_space:
            names = self.tokenizer.get_vocab(with_added_tokens=False)
            self.begins = np.zeros(max(names.values()) + 1, bool)
            self.begins[[i for name, i in names.items() if name[0] == _LETTERS[32]]] = True
        self.fixed = {m: self.whole(m) for m in (",", ".", "\n")}

    def whole(self, text: str) -> bytes:
        """Ids of a text that the tokenizer sees in one piece."""
        return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _is_word(self, body: str) -> bool:
        return body.isalpha() and max(body) < _LATIN_END and body.lower().isalpha()

    def _spelled(self, piece: str) -> str:
        if self.folds_space:
            piece = piece.lower()
        if piece.isascii():
            return piece.replace(" ", _LETTERS[32])
        return piece.encode().decode("latin-1").translate(_LETTERS)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that aren't remembered; None for those that can't be encoded alone."""
        known, older, fixed, folds = self.known, self.older, self.fixed, self.folds_space
        words: list[str] = []
        rest: list[str] = []
        joined: list[tuple[str, str, bytes, bytes]] = []
        wanted: set[str] = set()

        for piece in pieces:
            if piece in wanted:  # as the stem of another piece
                continue
            body = piece if folds or piece[0] not in " \n" else piece[1:]
            before = after = b""
            stem = piece
            plain = body.isalpha()
            if not plain:
                if body.split() != [body]:
                    known[piece] = None
                    continue
                if body[-1] in ",." and self._is_word(body[-2:-1]):
                    stem, body, after = stem[:-1], body[:-1], fixed[body[-1]]
                    plain = body.isalpha()
            if stem[0] == "\n" and self._is_word(body[0]):
                stem, before = stem[1:], fixed["\n"]
            if stem is not piece:
                joined.append((piece, stem, before, after))
                if stem in known or stem in wanted:
                    continue
                ids = older.get(stem, older)
                if ids is not older:
                    known[stem] = ids
                    continue
            wanted.add(stem)
            if plain and (body.isascii() or self._is_word(body)):
                words.append(stem)
            else:
                rest.append(stem)
        for at in range(0, len(words), LEARNT):
            known.update(self._of_words(words[at : at + LEARNT]))
        for at in range(0, len(rest), LEARNT):
            some = rest[at : at + LEARNT]
            made = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update(zip(some, [id_bytes(e.ids) for e in made]))
        for piece, stem, before, after in joined:
            known[piece] = before + known[stem] + after

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each of letters behind a blank or none.

        Many words behind blanks go as one text, where the vocabulary's blank says
        at which tokens they begin.
        """
        out: dict[str, bytes] = {}
        if self.begins is not None:
            behind = [w for w in words if w[0] == " "]
            words = [w for w in words if w[0] != " "]
            groups = [behind[at : at + 500] for at in range(0, len(behind), 500)]
            made = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, made):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(self.begins[ids])
                if len(at) != len(group) or at[0]:
                    words += group
                    continue
                data, at = ids.tobytes(), (at * 4).tolist()
                out.update(zip(group, [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]))
        made = self.bare.encode_batch_fast([self._spelled(w) for w in words], add_special_tokens=False)
        out.update(zip(words, [id_bytes(e.ids) for e in made]))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string array; null counts as empty."""
        return list(self.each(texts))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of one text after the other, `BATCH` characters of text encoded at a time."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + BATCH, side="right")))
            yield from self._encode(texts.slice(at, upto - at))
            at = upto

    def rest(self) -> None:
        """Forget the older pieces; called at the end of a task."""
        self.older = {}

    def _encode(self, texts: pa.Array) -> list[bytes]:
        texts = pa.concat_arrays([texts])  # own buffers, without an offset
        if self.folds_space:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            whole = np.zeros(len(texts), bool)
        else:
            whole = pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
            marked = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n")
            cut = pc.split_pattern(marked, _CUT)
        places = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.known) > (REMEMBERED if self.folds_space else 2 * REMEMBERED):
            self.older, self.known = self.known, {"": b""}
        known, missing = self.known, object()
        ids = [known.get(p, missing) for p in names]
        new = [p for p, i in zip(names, ids) if i is missing]
        if new:
            if self.older:
                met = [(p, self.older[p]) for p in new if p in self.older]
                known.update(met)
                new = [p for p in new if p not in known] if met else new
            self._learn(new)
            ids = [known[p] if i is missing else i for p, i in zip(names, ids)]
        index = coded.indices
        if None in ids:
            odd = np.fromiter((i is None for i in ids), bool, len(ids))
            hits = np.flatnonzero(odd[index.to_numpy()])
            whole = whole.copy()
            whole[np.searchsorted(places, hits, side="right") - 1] = True
            ids = [i or b"" for i in ids]
        spread = pa.array(ids, pa.large_binary()).take(index)
        starts = np.frombuffer(spread.buffers()[1], np.int64)[places] if len(spread) else places
        data = memoryview(spread.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


def coder(name: str, folds_space: bool) -> Coder:
    """The worker's coder for a vocabulary file; it lives as long as the worker."""
    key = (name, folds_space)
    if key not in _coders:
        _coders[key] = Coder(name, folds_space)
    return _coders[key]


def forget() -> None:
    """Drop the coders that an operator before left in this worker; called by those that need the memory."""
    _coders.clear()
