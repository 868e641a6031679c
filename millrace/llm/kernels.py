"""Vectorised text kernels on the buffers of Arrow string arrays.

Texts are never turned into Python words: a kernel sees the concatenated UTF-8 bytes (or code
points) of a slice of documents, finds boundaries with array operations and hashes spans by their
blocks of 8 bytes. Nulls count as empty texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of 0 to 8 bytes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end] of each span; equal spans have equal hashes.

    A span is read in blocks of 8 bytes. Each block is mixed with its place, which no polynomial of
    the bytes does, so spans of a regular form do not collide; spans of up to 8 bytes of one length
    never do. Another salt gives hashes that are independent of these.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    n = ends - starts
    seed = np.uint64((salt * int(_GOLDEN)) % (1 << 64))
    out = mix64((blocks[starts] & _FIRST_BYTES[np.minimum(n, 8)]) ^ seed)
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) >> 3  # blocks after the first
        place = ranges(np.ones(len(long), np.int64), more)
        at = np.repeat(starts[long], more) + 8 * place
        rest = blocks[at] & _FIRST_BYTES[np.minimum(np.repeat(ends[long], more) - at, 8)]
        rest = mix64(rest ^ mix64(place.astype(np.uint64) * _GOLDEN + seed))
        out[long] += np.add.reduceat(rest, np.cumsum(more) - more)
    return mix64(out + n.astype(np.uint64) * _GOLDEN)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null rows get no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes outside 0x20 and 0x09-0x0D; rows bound runs."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    here = np.zeros(len(data) + 1, bool)
    here[:-1] = word
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashed_words(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end row, the word hashes, and each word's row within the slice."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, most):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if lower:
            part = _LOWER[part]
        starts, ends, row = word_spans(part, at)
        yield a, b, span_hashes(part, starts, ends), row


_STEP = np.uint64(0xD6E8FEB86659FD93)


def chain(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """An order-sensitive hash of aligned hash arrays."""
    out = np.full(len(parts[0]), (salt * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
    for p in parts:
        out = (out ^ (out >> np.uint64(29))) * _STEP + p
    return mix64(out)


def shingles(words: np.ndarray, row: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of `size` words; a row with fewer words (but one) gives one window of all."""
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    n = max(0, len(words) - size + 1)
    inside = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    hashes = chain([words[k : k + n] for k in range(size)], size)[inside] if n else np.zeros(0, np.uint64)
    at = row[:n][inside]
    first = np.concatenate([[0], np.cumsum(count)])
    extra = [(np.array([], np.int64), np.array([], np.uint64))]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            extra.append((short, chain([words[first[short] + j] for j in range(k)], k)))
    short, more = np.concatenate([x for x, _ in extra]), np.concatenate([x for _, x in extra])
    if len(short):
        at, hashes = np.concatenate([at, short]), np.concatenate([hashes, more])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    return hashes, at


def by_row(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The order by row, then by hash."""
    if rows > 1 << 16:
        return np.lexsort((hashes, row))
    order = np.argsort(hashes)
    return order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # a radix sort


def distinct_in_rows(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted within it, and offsets by row."""
    order = by_row(hashes, row, rows)
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


# ---- splitting as byte-level BPE tokenizers do -------------------------------------------------

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


_classes: dict[str, np.ndarray] = {}


def char_classes(pieces_of=None) -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), white space (White_Space), other.

    Two libraries know different editions of Unicode. Where they disagree, pieces_of (a tokenizer's
    own pre_tokenize_str) decides.
    """
    key = "asked" if pieces_of else "plain"
    if key not in _classes:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1)]).astype(np.uint32)
        every = codes.tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[codes[m.start() : m.end()]] = kind
        if pieces_of:
            first = {"L": LETTER, "N": NUMBER}
            other = np.fromiter((first.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
            for code in codes[(other != table[codes]) & (table[codes] != BLANK)].tolist():
                c = chr(code)
                table[code] = LETTER if len(pieces_of(f"a{c}")) == 1 else NUMBER if len(pieces_of(f"1{c}")) == 1 else OTHER
        _classes[key] = table
    return _classes[key]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, their offsets by row, and the byte at which each starts (and the end)."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.searchsorted(lead, offsets), lead


def bpe_pieces(cp: np.ndarray, offsets: np.ndarray, specials: list[np.ndarray], classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that are encoded on their own, and the special token (-1: none) of each.

    A piece is a contraction suffix, or a run of letters, of numbers or of other characters with one
    blank before it, or white space but for the last character before other text.
    """
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = (char_classes() if classes is None else classes)[cp]
    seg = np.zeros(n + 1, bool)
    seg[offsets] = True
    special_at: dict[int, tuple[int, int]] = {}
    taken = -1
    found = []
    for k, s in enumerate(specials):
        if len(s) > n:
            continue
        at = np.flatnonzero(cp[: n - len(s) + 1] == s[0])
        for j in range(1, len(s)):
            if not len(at):
                break
            at = at[cp[at + j] == s[j]]
        if len(at):
            found += [(int(a), -len(s), k) for a in at if not seg[a + 1 : a + len(s)].any()]
    for a, neg, k in sorted(found):
        if a >= taken:
            taken = a - neg
            special_at[a] = (taken, k)
            seg[a] = seg[taken] = True
    blank = kind == BLANK
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~seg[1:n])  # the last white space before other text
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    start |= seg
    quote = np.flatnonzero(cp == 39)
    quote = quote[start[quote]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~seg[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        long = quote[quote + 2 < n]
        long = long[~seg[long + 2]]
        a, b = cp[long + 1], cp[long + 2]
        long = long[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        start[short + 1] = False
        start[short + 2] = True
        start[long + 1] = start[long + 2] = False
        start[long + 3] = True
    for a, (b, _) in special_at.items():
        start[a + 1 : b] = False
    start[n] = False
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    special = np.full(len(starts), -1, np.int64)
    if special_at:
        where = np.searchsorted(starts, list(special_at))
        special[where] = [k for _, k in special_at.values()]
    return starts, ends, special


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... (length of them) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)
