"""Whole-text tokenizing by tables of distinct chunks.

Neither vocabulary has a token that crosses its chunk borders, so a block of
texts is cut into chunks, each distinct chunk is encoded once, and the ids are
joined back by the chunks' positions. The results equal those of the libraries.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np

from kvtrail.llm.text import code_points, csr_take, span_names

#: Distinct chunks remembered from earlier blocks of a task; a full table starts anew.
MEMO_CHUNKS = 400_000
_LETTER, _NUMBER, _SPACE, _END = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            s, e = m.span()
            low = [x if x < 0xD800 else x + 0x800 for x in (s, e - 1)]
            out[low[0] : low[1] + 1] = kind
    return out


class _ChunkTable:
    """Ids of distinct chunks by the chunks' hashes; each chunk is encoded once while the table holds it.

    A chunk is named by two independent hashes: rows are found by the first, and the
    second has to agree. Chunks that share only the first are never mixed up: the
    table then starts anew with other hashes (`salt`).
    """

    def __init__(self, encode) -> None:
        self.encode = encode
        self.salt = 0
        self.clear()

    def clear(self) -> None:
        self.keys = self.checks = np.empty(0, np.uint64)
        self.starts = self.lengths = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def rows(self, keys: np.ndarray, checks: np.ndarray, chunk_at) -> np.ndarray | None:
        """The row of each of the sorted keys; chunk_at(k) is the text of the k-th. None if a check fails."""
        if len(self.keys) > MEMO_CHUNKS:
            self.clear()
        known, agree = self._known(keys, checks)
        if not agree:
            return None
        if len(new := np.flatnonzero(~known)):
            ids, starts, lengths = self.encode([chunk_at(k) for k in new.tolist()])
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys = both[order]
            self.checks = np.concatenate([self.checks, checks[new]])[order]
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])[order]
            self.lengths = np.concatenate([self.lengths, lengths])[order]
            self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.keys, keys)

    def _known(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, bool]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), True
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, bool((self.checks[at] == checks)[known].all())


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all lists, and each list's start and length."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), np.cumsum(lengths) - lengths, lengths


def _join_back(text: str, points, starts, ends, order, bounds, table: _ChunkTable):
    """Ids of all texts in order, and the bounds of each text's ids; order: where each chunk lies."""
    rows = None
    narrow = points.astype(np.uint16) if len(points) and points.max() < 1 << 16 else points
    while rows is None:
        names, check = span_names(narrow, starts, ends, salt=table.salt)
        keys, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        at, to = starts[first], ends[first]
        if (check == check[first][inverse]).all():
            rows = table.rows(keys, check[first], lambda k, at=at, to=to: text[at[k] : to[k]])
        if rows is None:
            table.clear()
            table.salt += 1
    ids, n = csr_take(table.ids, table.starts, table.lengths, rows[inverse])
    upto = np.concatenate([[0], np.cumsum(n)])
    return ids, upto[np.searchsorted(order, bounds)]


class ByteBpe:
    """The byte-level BPE of 50,257 ids, as the tokenizers library encodes without special tokens."""

    MARK, MARK_ID = "<|endoftext|>", 50256

    def __init__(self, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {i: b for b, i in ranks.items()}
        self.feed = ranks[b"\n"]
        self.core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = _ChunkTable(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks without white space at the end are encoded in one call, with a line feed (one id) after each."""
        blank = np.fromiter((c[-1].isspace() for c in chunks), bool, len(chunks))
        plain, rest = np.flatnonzero(~blank), np.flatnonzero(blank)
        starts, lengths = np.zeros((2, len(chunks)), np.int64)
        ids, starts[rest], lengths[rest] = _flat([self.core.encode_ordinary(chunks[k]) for k in rest.tolist()])
        if len(plain):
            joined = "\n".join([chunks[k] for k in plain.tolist()]) + "\n"
            more = np.frombuffer(self.core._core_bpe.encode_to_tiktoken_buffer(joined, set()), np.uint32)
            stop = np.flatnonzero(more == self.feed)
            starts[plain] = len(ids) + np.concatenate([[0], stop[:-1] + 1])
            lengths[plain] = np.diff(stop, prepend=-1) - 1
            ids = np.concatenate([ids, more])
        return ids, starts, lengths

    def _chunks(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _classes()[points]
        kind[bounds[1:] - 1] = _END
        cut = np.ones(len(points), bool)
        cut[1:] = kind[1:] != kind[:-1]
        edges = np.flatnonzero(cut)
        space = kind[edges] == _SPACE
        begin, end = edges[:-1][space[:-1]], edges[1:][space[:-1]]
        begin, end = begin[kind[end] != _END], end[kind[end] != _END]
        cut[end - 1] = True  # the last white space before a chunk stands alone ...
        cut[end[points[end - 1] == 0x20]] = False  # ... or, as a blank, opens that chunk
        tick = np.flatnonzero((points == 39) & (kind == 0))
        if len(tick):
            before = np.where(tick > 0, kind[tick - 1], _END)
            blank = (tick > 0) & (points[tick - 1] == 0x20) & (before == _SPACE)
            tick = tick[(before != 0) & ~blank & (kind[tick + 1] == _LETTER)]
            one, two = points[tick + 1], points[np.minimum(tick + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(tick), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for hit, width in ((short, 2), (long, 3)):
                cut[tick[hit] + 1] = False
                cut[tick[hit] + width] = True
        edges = np.flatnonzero(cut)
        keep = kind[edges] != _END
        ends = np.concatenate([edges[1:], [len(points)]])
        return edges[keep], ends[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts end to end, and bounds of each text's ids."""
        if any(self.MARK in t for t in texts):
            return self._with_marks(texts)
        if not texts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        points, bounds = code_points(texts)
        starts, ends = self._chunks(points, bounds)
        return _join_back("\0".join(texts) + "\0", points, starts, ends, starts, bounds, self.table)

    def _with_marks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [t.split(self.MARK) for t in texts]
        ids, bounds = self.encode([p for x in parts for p in x])
        out, k, sizes = [], 0, [0]
        for x in parts:
            for j in range(len(x)):
                if j:
                    out.append(np.array([self.MARK_ID], np.uint32))
                out.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
            sizes.append(int(bounds[k] - bounds[k - len(x)]) + len(x) - 1)
        return np.concatenate(out), np.cumsum(sizes)


class PieceBpe:
    """The SentencePiece model of 32,000 pieces; no piece holds a white-space marker after another character."""

    MARKER = 0x2581

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        marker = chr(self.MARKER)
        if any(marker in self.model.id_to_piece(i).lstrip(marker) for i in range(self.model.vocab_size())):
            raise ValueError("pieces of this model cross white-space markers")
        self.lone = self.model.piece_to_id(marker)
        self.table = _ChunkTable(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.model.encode(chunks, num_threads=1)
        return _flat([x if c else [self.lone] for c, x in zip(chunks, found, strict=True)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts end to end, without an end id, and bounds of each text's ids."""
        if not texts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        points, bounds = code_points(texts)
        mark = (points == 0x20) | (points == self.MARKER)
        cut = mark.copy()
        cut[1:] &= ~mark[:-1]
        first = np.zeros(len(points), bool)
        first[bounds[:-1]] = True
        last = bounds[1:] - 1
        first[last] = False
        cut |= first
        cut[last] = True
        edges = np.flatnonzero(cut)
        ends = np.concatenate([edges[1:], [len(points)]])
        is_end = np.zeros(len(points), bool)
        is_end[last] = True
        keep = ~is_end[edges]
        starts, ends = edges[keep], ends[keep]
        # the encoder puts one marker before what it is given, so that of a later chunk goes
        return _join_back("\0".join(texts) + "\0", points, starts + ~first[starts], ends, starts, bounds, self.table)


@lru_cache(maxsize=1)
def byte_bpe() -> ByteBpe:
    return ByteBpe()


@lru_cache(maxsize=1)
def piece_bpe() -> PieceBpe:
    return PieceBpe()
