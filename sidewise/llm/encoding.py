"""Public tokenizers that encode each distinct word of a slice of texts once.

A library call for each word costs far more than the merges inside it, and most words recur.
Texts are cut where the tokenizer cuts them in any case, each distinct piece is encoded once by
the library, and all texts are put together from those by number. Nothing is kept from one slice
to the next. Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .hashing import chunks

#: Letters that are one code point in normal form C and have one lower-case code point.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: One line for each piece: the letters and the marks after them, or nothing.
_SIMPLE = re.compile(rf"^([{_LETTERS}]+)([.,!?;:]*)$|^.*$", re.MULTILINE)
#: A single space or newline between characters that no library counts as white space.
_CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")
_SPACE = re.compile(r"\s|\A\Z")
#: Bytes of memory that a memo takes, and those of an entry.
MEMO_BYTES = 48 << 20
ENTRY_BYTES = 250
#: Bytes of text that are encoded together.
SLICE_BYTES = 12 << 20


def _visible_bytes() -> dict[int, str]:
    """Byte-level vocabularies show each byte as a printable character: Latin-1's printable
    ones as they are, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(shown))
    return out


_SHOWN = _visible_bytes()
_TO_SHOWN = {i: _SHOWN[i] for i in range(256)}


class Memo(dict):
    """What pieces become, in two generations of about ``most`` bytes together; pieces in use
    move to the younger one."""

    def __init__(self, most: int) -> None:
        self.limit, self.old = max(1, most // (2 * ENTRY_BYTES)), {}

    def values_of(self, pieces: list[str], learn: Callable[[list[str]], list]) -> list:
        """The values of distinct pieces; those not known yet are learned together."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        missing = [x for x in pieces if x not in self]
        if self.old:
            known = [x for x in missing if x in self.old]
            self.update(zip(known, map(self.old.__getitem__, known), strict=True))
            missing = [x for x in missing if x not in self]
        self.update(zip(missing, learn(missing), strict=True))
        return list(map(self.__getitem__, pieces))

    def forget(self) -> None:
        self.old = {}
        self.clear()


def _uncached_model(path: str) -> BPE:
    """A tokenizer's merge model without the library's own cache, since a word comes once."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["merges"]]
    more = {k: told[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if told.get(k)}
    return BPE(told["vocab"], merges, cache_capacity=0, **more)


class SliceEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    ``spaces`` says what the tokenizer does with a single space: "lead" (the space starts
    the next piece) or "drop" (white space only separates)."""

    def __init__(self, name: str, spaces: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = _uncached_model(public_tokenizers.path(name))
        self.lower = spaces == "drop"
        self.lead = spaces == "lead"
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {"": b""}
        self.newline = self._by_library(["\n"])[0]

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        ids = self.id_bytes
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []
        return [b"".join([ids[i] for i in x.ids]) for x in found]

    def _marks(self, marks: str) -> bytes:
        """Ids of a run of marks; short runs are few and stay known."""
        got = self.marks.get(marks)
        if got is None:
            ids = self.id_bytes
            got = b"".join([ids[t.id] for t in self.model.tokenize(marks)])
            if len(marks) <= 3:
                self.marks[marks] = got
        return got

    def _learn(self, pieces: list[str], space: str = "") -> list[bytes | None]:
        """Ids of pieces, after ``space``; None for a piece that white space may join to its
        neighbours. Letters and the marks after them are pre-tokens, which go to the library's
        merge model; other pieces go to the whole library."""
        ids, tokenize, first, out, other = self.id_bytes, self.model.tokenize, _SHOWN[32] if space else "", [], []
        for word, marks in _SIMPLE.findall("\n".join(pieces)) if pieces else ():
            if not word:
                other.append(len(out))
                out.append(None)
                continue
            if self.lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_TO_SHOWN)
            found = tokenize(first + word)
            got = ids[found[0].id] if len(found) == 1 else b"".join([ids[t.id] for t in found])
            out.append(got + self._marks(marks) if marks else got)
        if self.lead:
            other = [k for k in other if pieces[k] and pieces[k].strip() == pieces[k]]
        for k, got in zip(other, self._by_library([space + pieces[k] for k in other]), strict=True):
            out[k] = got
        return out

    def _uneven(self, texts: list[str]) -> list[bytes]:
        """Texts with white space other than single spaces and newlines: cut where one stands
        alone, all else by the library."""
        cut = []
        for text in texts:
            first, *rest = _CUT.split(text)
            cut.append([("", first), *zip(rest[::2], rest[1::2], strict=True)])
        found: dict[tuple[bool, str], bytes] = {}
        for led in (False, True):
            own = dict.fromkeys(p for pieces in cut for sep, p in pieces if (sep == " ") == led)
            bare = [p for p in own if not _SPACE.search(p)]
            odd = [p for p in own if _SPACE.search(p)]
            found |= {(led, p): x for p, x in zip(bare, self._learn(bare, " " * led), strict=True)}
            found |= {(led, p): x for p, x in zip(odd, self._by_library([" " * led + p for p in odd]), strict=True)}
        return [b"".join([(self.newline if sep == "\n" else b"") + found[sep == " ", p] for sep, p in pieces]) for pieces in cut]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts without special tokens, one after another, and where each text's
        begin and the last ends. Null: none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        parted = pc.replace_substring(texts, "\n", " \n " if self.lead else " ")
        lists = pc.split_pattern(parted, " ")
        words = lists.flatten().dictionary_encode()
        code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        first = lists.offsets.to_numpy()
        first = first - first[0]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if self.lead:
            # Pieces at the start of a text or line have no space before them.
            newline = names.index("\n") if "\n" in names else -1
            plain = np.concatenate([[False], code[:-1] == newline])
            plain[first[:-1]] = True
            plain &= code != newline
            some, at = np.unique(code[plain], return_inverse=True)
            code = code.copy()
            code[plain] = len(names) + at
            if newline >= 0:
                names[newline] = ""
            values = self._learn(names, " ")
            if newline >= 0:
                values[newline] = self.newline
            values += self._learn([names[k] for k in some])
        else:
            values = self._learn(names)
        del names, words
        bad = np.flatnonzero([x is None for x in values])
        if len(bad):
            values = [b"" if x is None else x for x in values]
        size = np.array(list(map(len, values)), np.int32) // 4
        flat, begin = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[code]
        end = np.cumsum(n)
        # 32 bits are enough for the places of a slice, unless a single text is enormous.
        kind = np.int32 if not len(end) or end[-1] < 1 << 31 else np.int64
        at = np.repeat((begin[code] - end + n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        out = flat[at]
        offsets = np.concatenate([[0], end])[first]
        if len(bad):
            uneven = np.add.reduceat(np.isin(code, bad), first[:-1]) > 0 if len(texts) else np.zeros(0, bool)
            parts = [out[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            odd = np.flatnonzero(uneven & ~empty)
            for k, ids in zip(odd, self._uneven(texts.take(pa.array(odd)).to_pylist()), strict=True):
                parts[k] = np.frombuffer(ids, "<u4")
            out = np.concatenate(parts) if parts else out
            offsets = np.cumsum([0, *map(len, parts)])
        return out, offsets

    def encode(self, text: str | None) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or a single longer one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from chunks(np.concatenate([[0], np.cumsum(sizes + 16)]), most)


_encoders: dict[tuple[str, str], SliceEncoder] = {}


def encoder(name: str, spaces: str) -> SliceEncoder:
    """One tokenizer for each worker process."""
    if (name, spaces) not in _encoders:
        _encoders[name, spaces] = SliceEncoder(name, spaces)
    return _encoders[name, spaces]


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text's."""
    n = len(offsets) - 1
    out, at = np.full(len(flat) + n, end_id, "<u4"), offsets + np.arange(n + 1)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    out[own] = flat
    return out, at
