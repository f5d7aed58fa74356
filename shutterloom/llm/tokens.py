"""Token ids of texts by the `tokenizers` library, with the ids of recurring segments kept.

A byte-level tokenizer splits text into runs of letters, digits or other signs before its merges,
and where such a split is certain from the neighbouring bytes alone a text can be cut: the ids of the
segments, one after another, are the ids of the text. Segments recur, so Arrow makes a dictionary of a few
megabytes of them at once, a worker keeps the ids of those it has met, up to a bound, and only the
new ones are encoded.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker keeps. Beyond them those that never recurred go, or all.
KEEP = 500_000
#: Bytes of the texts that are cut at once, about; a longer text is cut by itself.
AT_ONCE = 8 << 20
#: Bytes of a string of new segments that is encoded at once.
JOINED = 1 << 16

#: Classes of bytes. OTHER is what a byte alone doesn't tell: no cut hangs on it.
OTHER, LETTER, DIGIT, SIGN, SPACE, BLANK, QUOTE = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for c in map(chr, range(33, 127)):
        table[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SIGN
    table[[*b"\t\n\v\f\r"]] = BLANK
    table[ord(" ")] = SPACE
    return table


def _certain() -> np.ndarray:
    """For the classes of two neighbours, whether a text can always be cut between them.

    Whitespace ends any run, and letters, digits and signs end one another's; an apostrophe may begin a short
    form with the letters after it, and a space belongs to the run after it.
    """
    ok = np.zeros((7, 7), bool)
    for a in (LETTER, DIGIT, SIGN, QUOTE, OTHER):
        ok[a, [SPACE, BLANK]] = True
    ok[LETTER, [DIGIT, SIGN, QUOTE]] = ok[DIGIT, [LETTER, SIGN, QUOTE]] = ok[SIGN, [LETTER, DIGIT]] = True
    return ok.ravel()


_CLASS, _CERTAIN = _classes(), _certain()
#: First bytes of two-byte characters that are letters all, but for two of 0xC3.
_LETTERS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])
#: The last byte but one of every whitespace character beyond ASCII is one of these.
_WIDE_SPACE = np.isin(np.arange(256), [0x80, 0x81, 0x9A, 0xC2])


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text; the letters of Latin and Cyrillic beyond ASCII are letters too."""
    kind = _CLASS[data]
    lead = np.flatnonzero(_LETTERS[data[:-1]])
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7) | (data[lead] != 0xC3)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cuttable(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text but the last, whether the text can be cut behind it."""
    if len(data) < 2:
        return np.zeros(0, bool)
    kind = byte_classes(data)
    ok = _CERTAIN[kind[:-1] * np.uint8(7) + kind[1:]]
    # After bytes that may end a whitespace character, or control characters, nothing is certain.
    odd = np.flatnonzero(ok & (kind[:-1] == OTHER))
    ok[odd[(data[odd] < 0x80) | _WIDE_SPACE[data[odd - 1]] | (odd == 0)]] = False
    # A single line end or tab between other characters stands by itself.
    blank = np.flatnonzero(kind[1:-1] == BLANK) + 1
    firm = (kind != OTHER) & (kind != SPACE) & (kind != BLANK)
    ok[blank[firm[blank - 1] & firm[blank + 1]]] = True
    return ok


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data])


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large binary array without nulls."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


class SegmentTokenizer:
    """ids(texts) for a byte-level tokenizer file without normaliser, whose ids fit 16 bits."""

    def __init__(self, path: str, keep: int = KEEP, at_once: int = AT_ONCE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.whole.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids over 16 bits")
        #: Bytes of each token: in a byte-level vocabulary a character stands for a byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, n in vocabulary.items():
            self.width[n] = len(token)
        self.keep, self.at_once = keep, at_once
        self._forget()

    def _forget(self) -> None:
        self.segments = self.encoded = pa.array([], pa.large_binary())
        self.recurred = np.empty(0, bool)

    def ids(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as a binary array of little-endian 16-bit numbers; none for null."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets, data = _parts(texts)
        out, start = [], 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + self.at_once, side="right")) - 1)
            out.append(self._ids(offsets[start : stop + 1] - offsets[start], data[offsets[start] : offsets[stop]]))
            start = stop
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _ids(self, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
        """The same for texts that lie one after another in `data`."""
        ends = np.zeros(len(data) + 1, bool)
        ends[1:-1] = cuttable(data)
        ends[offsets] = True
        edges = np.flatnonzero(ends)
        segments = _binary(edges, pa.py_buffer(data)).dictionary_encode()
        made = self._look_up(segments.dictionary).take(segments.indices)
        at, ids = _parts(made)
        return _binary(at[np.searchsorted(edges, offsets)] - at[0], pa.py_buffer(ids[at[0] : at[-1]]))

    def _look_up(self, segments: pa.Array) -> pa.Array:
        """The ids of distinct segments, which are kept."""
        at = pc.index_in(segments, value_set=self.segments)
        new = segments.filter(at.is_null())
        known = np.asarray(at.drop_null())
        self.recurred[known] = True
        place = np.array(at.fill_null(-1))
        place[place < 0] = np.arange(len(self.segments), len(self.segments) + len(new))
        self.segments = pa.concat_arrays([self.segments, new])
        self.encoded = pa.concat_arrays([self.encoded, self._encode(new)])
        self.recurred = np.concatenate([self.recurred, np.zeros(len(new), bool)])
        found = self.encoded.take(pa.array(place))
        if len(self.segments) > self.keep:
            stay = pa.array(self.recurred)
            self.segments, self.encoded = self.segments.filter(stay), self.encoded.filter(stay)
            self.recurred = np.zeros(len(self.segments), bool)
            if len(self.segments) > self.keep // 2:
                self._forget()
        return found

    def _encode(self, segments: pa.Array) -> pa.Array:
        """Segments are encoded in long strings, with a line end before each that begins without a space.

        Both stand alone there, so each segment keeps its ids, which are cut where its bytes end. Segments at whose
        edges there may be more whitespace are encoded by themselves.
        """
        offsets, data = _parts(segments)
        size = np.diff(offsets)
        many = np.flatnonzero(size > 0)
        firm = np.isin(_CLASS, [LETTER, DIGIT, SIGN, QUOTE])
        first, last = data[offsets[many]], data[offsets[many + 1] - 1]
        spaced = (first == ord(" ")) & (size[many] > 1)
        joins = firm[last] & firm[np.where(spaced, data[np.minimum(offsets[many] + 1, len(data) - 1)], first)]
        out: list[bytes] = [b""] * len(segments)
        texts = segments.cast(pa.large_string()).to_pylist()
        alone = many[~joins].tolist()
        for n, got in zip(alone, self.whole.encode_batch_fast([texts[n] for n in alone], add_special_tokens=False), strict=True):
            out[n] = np.array(got.ids, "<u2").tobytes()
        rows, spaced = many[joins], spaced[joins]
        group = np.cumsum(size[rows] + 1) // JOINED
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)] if len(rows) else []
        groups = [(rows[a:b], spaced[a:b]) for a, b in zip(starts, starts[1:])]
        joined = ["".join(texts[n] if s else "\n" + texts[n] for n, s in zip(r.tolist(), p.tolist(), strict=True)) for r, p in groups]
        for (r, p), got in zip(groups, self.whole.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u2")
            ends = np.cumsum(self.width[ids])
            # The line end is one token, which is left out.
            stop = np.searchsorted(ends, np.cumsum(size[r] + ~p)) + 1
            start = np.concatenate([[0], stop[:-1]]) + ~p
            piece = ids.tobytes()
            for n, a, b in zip(r.tolist(), (2 * start).tolist(), (2 * stop).tolist(), strict=True):
                out[n] = piece[a:b]
        return pa.array(out, pa.large_binary())


@functools.cache
def tokenizer(path: str) -> SegmentTokenizer:
    """One for each Python worker, kept from task to task."""
    return SegmentTokenizer(path)
