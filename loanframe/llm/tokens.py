"""Whole-text tokenisation inside Arrow batches.

A tokenizer's pre-tokenizer never joins characters across an ASCII white
space that follows a non-space character, so a text may be cut there and the
cut units encoded one by one.  Units repeat (words do), so each slice of a
batch is dictionary-encoded in Arrow, plain words are parted from their closing
marks, and only parts that this worker has not met yet reach the tokenizers
library.  The ids equal those of one call on the text.

What a worker remembers are two Arrow arrays (parts and their ids) of at most
``MEMO_BYTES`` bytes together; beyond that it keeps the parts it has met again.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loanframe.llm.common import release, worker_cache

MEMO_BYTES = 24 << 20
SLICE_BYTES = 8 << 20  # texts that are encoded at a time

# Characters that some engines call white space and others do not, and the
# cut mark itself: a text that holds one is encoded by a single call.
_ODD = "[\\x00\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_TAIL = "[.,;:!?)#$%&*]*"  # marks that form one pre-token after a letter
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-{}]+"


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _packed(lists: list[list[int]]) -> pa.Array:
    """Little-endian 32-bit ids of each list, as a binary array."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype("<i8") * 4
    data = np.array(list(chain.from_iterable(lists)), "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


class UnitEncoder:
    """Encodes string arrays with one tokenizer file.

    ``spaces`` says whether a unit keeps the white space before it (byte-level
    vocabularies) or white space is dropped (lower-cased word vocabularies).
    ``special_as_text`` says whether the strings of special tokens are ordinary
    text, or get their ids as the library's default has it.
    """

    def __init__(self, path: str, spaces: bool, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        # A text that holds a special token is encoded by a single call.
        special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.whole = "|".join([_ODD, *map(re.escape, special)])
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model, self.spaces = self.tok.model, spaces
        self.bytes = _byte_chars()
        word = " ?" + _LATIN.format("\u024f") if spaces else _LATIN.format("\u012f")
        self.plain = f"^{word}$"
        self.unit = f"^(?P<lead>{'\n?' if spaces else ''})(?P<body>{word})(?P<tail>{_TAIL})$"
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.again = np.zeros(0, bool)  # of the known ones, those that were met again

    def _word(self, word: str) -> list[int]:
        """Ids of a plain word, which is one pre-token."""
        if not self.spaces:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(self.bytes.__getitem__, word.encode()))
        elif word[0] == " ":
            word = self.bytes[32] + word[1:]
        return [x.id for x in self.model.tokenize(word)]

    def _made(self, parts: pa.Array) -> pa.Array:
        """Ids of parts that are not known."""
        plain = pc.match_substring_regex(parts, self.plain).to_numpy(zero_copy_only=False)
        listed, places = parts.to_pylist(), np.flatnonzero(~plain).tolist()
        others = self.tok.encode_batch_fast([listed[i] for i in places], add_special_tokens=False) if places else []
        odd = {i: e.ids for i, e in zip(places, others)}
        return _packed([odd[i] if i in odd else self._word(w) for i, w in enumerate(listed)])

    def _ids(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts."""
        at = pc.index_in(parts, self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        self.again[place[~new]] = True
        place[new] = len(self.known) + np.arange(new.sum())
        fresh = parts.filter(pa.array(new))
        known, ids = pa.concat_arrays([self.known, fresh]), pa.concat_arrays([self.known_ids, self._made(fresh)])
        out, again = ids.take(pa.array(place)), np.concatenate([self.again, np.zeros(len(fresh), bool)])
        if known.nbytes + ids.nbytes > MEMO_BYTES:
            known, ids = (x.filter(pa.array(again)) for x in (known, ids))
            again = np.zeros(len(known), bool)
            if known.nbytes + ids.nbytes > MEMO_BYTES // 2:
                known, ids, again = known[:0], ids[:0], again[:0]
        self.known, self.known_ids, self.again = known, ids, again
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        if not self.spaces:
            texts = pc.replace_substring_regex(texts, "[ \\t\\n\\r\\f]+", " ")
            return pc.split_pattern(texts, " ")
        if pc.any(pc.match_substring_regex(texts, "\\s\\s|\\s$")).as_py():
            texts = pc.replace_substring_regex(texts, "([^ \\t\\n\\r\\f])([ \\t\\n\\r\\f])", "\\1\x00\\2")
        else:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        return pc.split_pattern(texts, "\x00")

    def _unit_ids(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units: of a plain word and the marks around it, or of the unit as it stands."""
        found = pc.extract_regex(units, self.unit)
        body = pc.coalesce(pc.struct_field(found, "body"), units)
        lead, tail = (pc.fill_null(pc.struct_field(found, name), "") for name in ("lead", "tail"))
        coded = pa.concat_arrays([lead, body, tail]).dictionary_encode()
        ids, n = self._ids(coded.dictionary), len(units)
        parts = [ids.take(coded.indices.slice(i * n, n)) for i in range(3)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]. Null: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.whole)
        units = self._cut(pc.if_else(whole, "", texts))
        coded = units.flatten().dictionary_encode()
        # Taking each unit's ids from the dictionary lays the ids of all texts end to end.
        taken = self._unit_ids(coded.dictionary).take(coded.indices)
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, "<i8", len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, "<u4", int(ends[-1] - ends[0]) // 4, int(ends[0])) if data else np.empty(0, "<u4")
        ends = (ends - ends[0]) // 4
        cuts = units.offsets.to_numpy()
        offsets = ends[cuts - cuts[0]]
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        return (ids, offsets) if not len(rows) else self._mend(texts, rows, ids, offsets)

    def slices(self, texts: pa.Array, most: int = SLICE_BYTES):
        """(first row, ids, offsets) of consecutive runs of texts of about ``most`` bytes each."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield at, *self.encode(texts.slice(at, end - at))
            at = end
        release()

    def _mend(self, texts, rows, ids, offsets):
        """Puts the texts that one call has to encode back in their places."""
        done = self.tok.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)
        put, each = dict(zip(rows.tolist(), done)), []
        for i in range(len(offsets) - 1):
            each.append(np.array(put[i].ids, "<u4") if i in put else ids[offsets[i]:offsets[i + 1]])
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def close_documents(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids with the end id after each, and their new offsets."""
    n = np.diff(offsets)
    out = np.full(len(ids) + len(n), end, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, offsets + np.arange(len(offsets))


def binary_slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The little-endian bytes of ``data`` (unsigned 32-bit) between consecutive cuts, as one binary array."""
    offsets = pa.py_buffer(((cuts - cuts[0]) * 4).astype("<i8"))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                 [None, offsets, pa.py_buffer(data[cuts[0]:cuts[-1]].tobytes())]).cast(pa.binary())


def encoder(path: str, spaces: bool, special_as_text: bool = True) -> UnitEncoder:
    """The worker's encoder of a file, kept over tasks."""
    return worker_cache(("encoder", path, spaces, special_as_text), lambda: UnitEncoder(path, spaces, special_as_text))
