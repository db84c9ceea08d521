"""SentencePiece encoding and decoding: Viterbi over a trie of distinct marked words."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import words as W

MARK = "▁"
CACHE_BYTES = 32 << 20
"""Memory for the pieces of words that a task remembers between slices; when it is full, a task begins anew."""
LONG = 1024
"""Characters from which on a word is encoded by itself with a sliding tail, and not remembered."""
_SETTLE = 4096
"""Characters of a long word after which the pieces that all open paths share are settled."""
_UNKNOWN = -20.0
_TRIE = 1 << 20
"""Bytes of words that are encoded side by side; more go in turns, so that memory does not follow the length of a text."""
_LEAD = np.repeat(np.array([0, 1, 2, 3], np.int8), [192, 32, 16, 16])
"""How many bytes of a character follow its first one."""


class Pieces:
    """A vocabulary read from a model file: piece strings with log probabilities, and byte pieces.

    A unigram model's scores are log probabilities. A merge-ranked (BPE) model has ranks instead; its pieces get Zipf
    probabilities by rank, ``-ln(rank + 2)``. The path of most probability wins; of equal ones, the one whose last
    piece is longest, and so on backwards.
    """

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        unigram = model.trainer_spec.model_type == 1
        self.prefix = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model whose normaliser changes texts can't give them back")
        self.text = [p.piece for p in model.pieces]
        self.score: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.bytes: dict[int, int] = {}
        self.value: dict[int, int] = {}
        self.unknown, rank = 0, 0
        for n, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = n
                self.value[n] = int(p.piece[1:-1], 16)
            elif p.type == 2:
                self.unknown = n
            elif p.type == 1:
                self.score[p.piece] = (p.score if unigram else -math.log(rank + 2), (n,))
                rank += 1
        self.trie: dict = {}
        for piece, found in self.score.items():
            node = self.trie
            for n, char in enumerate(piece):
                entry = node.setdefault(char, [{}, None])
                node = entry[0]
            entry[1] = found
        inner = [p for p in self.score if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"a piece runs over two words: {inner[0]!r}")
        self._by_byte()

    def _by_byte(self) -> None:
        """The vocabulary's trie over UTF-8 bytes as arrays, a mark as the byte 32: its edges (256 * node + byte) in order
        with the node below each, and for each node whether it has any, the piece that ends there (or -1) and its score."""
        node, edges = {b"": 0}, []
        ends = {piece.replace(MARK, " ").encode(): found for piece, found in self.score.items() if " " not in piece}
        for raw in ends:
            for n in range(1, len(raw) + 1):
                if raw[:n] not in node:
                    node[raw[:n]] = len(node)
                    edges.append((256 * node[raw[: n - 1]] + raw[n - 1], node[raw[:n]]))
        edges.sort()
        self.edge, self.below = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.full(1, -1), np.zeros(1, np.int64))
        self.inner, self.ends, self.gain = np.zeros(len(node), bool), np.full(len(node), -1, np.int32), np.zeros(len(node))
        self.inner[self.edge[self.edge >= 0] >> 8] = True
        for raw, (score, (n,)) in ends.items():
            self.ends[node[raw]], self.gain[node[raw]] = n, score
        self.spelled = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)

    def words(self, text: str) -> list[str]:
        """Marked words: each run of spaces goes with what follows it; their concatenation is the marked text."""
        if not text:
            return []
        marked = text.replace(MARK, " ").replace(" ", MARK)  # a mark inside a text counts as a space, as in the library
        if self.prefix:
            marked = MARK + marked
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)

    def _step(self, char: str, open_: list, end: int) -> tuple[list, tuple]:
        """One character on: the nodes open after it, and the (start, pieces) of the best last piece that ends with it."""
        top, how, on = -math.inf, None, []
        for node, score, start in open_:
            below = node.get(char)
            if below:
                if below[0]:
                    on.append((below[0], score, start))
                if below[1] and score + below[1][0] > top:
                    top, how = score + below[1][0], (start, below[1][1])
        if char not in self.score:
            spelled = tuple(self.bytes.get(b, self.unknown) for b in char.encode()) if self.bytes else (self.unknown,)
            score = open_[-1][1] + _UNKNOWN * len(spelled)
            if score > top:
                top, how = score, (end, spelled)
        on.append((self.trie, top, end + 1))
        return on, how

    def encode_words(self, words: list[str]) -> dict[str, Sequence[int]]:
        """Piece numbers of distinct words; those of ``LONG`` characters or more go by themselves, so that a text without
        spaces does not keep its positions."""
        out: dict[str, Sequence[int]] = {}
        some = [w for w in dict.fromkeys(words) if len(w) < LONG]
        raw = [w.replace(MARK, " ").encode() for w in some]
        ids, edge = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        flat, at = ids.tolist(), edge.tolist()
        for n, word in enumerate(some):
            out[word] = tuple(flat[at[n] : at[n + 1]])
        for word in words:
            if len(word) >= LONG:
                out[word] = self.encode_long(word)
        return out

    def encode_bytes(self, buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words and where each word's begin, as ``edge`` tells for their bytes (UTF-8, marks as spaces).

        At most ``_TRIE`` bytes of words, or one word, are encoded at once.
        """
        done = [self._encode(buf[edge[a] : edge[b]], edge[a : b + 1] - edge[a]) for a, b in W.row_ranges(edge, _TRIE)]
        size = np.concatenate([np.zeros(1, np.int64), *[n for _, n in done]])
        return np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in done]]), np.cumsum(size)

    def _encode(self, buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words and their count in each.

        The words' own trie is walked one byte deeper for all its nodes at a time; words with the same first 16 bytes share
        their nodes, and with them the forward scores. With each node stand the states open there, the earliest start first:
        node of the vocabulary's trie, score at the start, node of the start. Every node at the end of a character keeps the
        best last piece and the node before it, by which the pieces are read back from the words' ends.
        """
        start, size = edge[:-1], np.diff(edge)
        total = len(buf) + 1
        score, count, depth = np.zeros(total), np.zeros(total, np.int32), np.zeros(total, np.int32)
        back, last = np.zeros(total, np.int32), np.full(total, -1, np.int32)
        ahead = np.concatenate((buf, np.zeros(16, np.uint8)))
        head = np.zeros((len(size), 16), np.uint8)
        for n in range(16):
            head[:, n] = np.where(size > n, ahead[start + n], 0)
        head = head.view(">u8").astype(np.uint64)
        order = np.lexsort((head[:, 1], head[:, 0]))
        order = order[size[order] > 0]
        leaf = np.zeros(len(size), np.int32)
        here = np.zeros(len(order), np.int64)  # each word's node, counted from the level's first one
        first, open_ = np.zeros(1, np.int64), np.ones(1, np.int64)
        node, base, since = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int32)
        rest, char, offset, nodes, level = np.zeros(1, np.int8), np.zeros(1, np.int32), 0, 1, 0
        while len(order):
            byte = buf[start[order] + level]
            new = np.ones(len(order), bool)
            new[1:] = (here[1:] != here[:-1]) | (byte[1:] != byte[:-1])
            parent, byte = here[new], byte[new]
            here, level = np.cumsum(new) - 1, level + 1
            own = np.arange(nodes, nodes + len(parent), dtype=np.int32)
            begins = rest[parent] == 0
            char = np.where(begins, parent + offset, char[parent]).astype(np.int32)
            rest = np.where(begins, _LEAD[byte], rest[parent] - 1).astype(np.int8)
            whole = rest == 0
            # the parent's open states, one byte on
            many = open_[parent]
            state, of = _ranges(first[parent], many), np.repeat(np.arange(len(parent)), many)
            wanted = (node[state] << 8) | byte[of]
            at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
            met = np.flatnonzero(self.edge[at] == wanted)
            node, of, state = self.below[at[met]], of[met], state[met]
            base, since = base[state], since[state]
            # the best last piece: of equal ones the first, which is the longest
            top, how, piece, single = np.full(len(parent), -np.inf), char.copy(), np.full(len(parent), -1, np.int32), np.zeros(len(parent), bool)
            full = np.flatnonzero(self.ends[node] >= 0)
            if len(full):
                to, reached = of[full], base[full] + self.gain[node[full]]
                group = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                top[to[group]] = np.maximum.reduceat(reached, group)
                best = np.flatnonzero(reached == top[to])
                best = best[np.concatenate(([True], to[best][1:] != to[best][:-1]))]
                how[to[best]], piece[to[best]] = since[full[best]], self.ends[node[full[best]]]
                single[to[since[full] == char[to]]] = True
            # a character that is no piece may be spelled
            alone = np.flatnonzero(whole & ~single)
            made = np.ones(len(parent), np.int32)
            if len(alone):
                bytes_ = self._spelled(level - depth[char[alone]], byte[alone])
                spelled = score[char[alone]] + _UNKNOWN * bytes_
                better = spelled > top[alone]
                alone = alone[better]
                top[alone], how[alone], piece[alone], made[alone] = spelled[better], char[alone], -1, bytes_[better]
            score[own], back[own], last[own], depth[own] = top, how, piece, level
            count[own] = count[how] + made
            # what is open now: the states that can go on, and one from here where a character ends
            on = np.flatnonzero(self.inner[node])
            upto = np.concatenate(([0], np.cumsum(whole)))
            kept = np.bincount(of[on], minlength=len(parent))
            open_ = kept + whole
            first = np.cumsum(open_) - open_
            fill, fresh = np.arange(len(on)) + upto[of[on]], (first + kept)[whole]
            states = [np.zeros(len(on) + len(fresh), t) for t in (np.int64, np.float64, np.int32)]
            for x, old, now in zip(states, (node, base, since), (0, top[whole], own[whole]), strict=True):
                x[fill], x[fresh] = old[on], now
            node, base, since = states
            offset, nodes = nodes, nodes + len(parent)
            going = size[order] > level
            leaf[order[~going]] = own[here[~going]]
            order, here = order[going], here[going]
        return self._read_back(buf, start, leaf, back, last, count, depth)

    def _spelled(self, width: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """How many pieces spell characters of ``width`` bytes that end with ``byte``."""
        return np.where(byte == 32, len(MARK.encode()), width).astype(np.int32) if self.bytes else np.ones(len(width), np.int32)

    def _read_back(self, buf, start, leaf, back, last, count, depth) -> tuple[np.ndarray, np.ndarray]:
        size = count[leaf].astype(np.int64)
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        word = np.flatnonzero(leaf)
        node = leaf[word]
        while len(word):
            before, piece = back[node], last[node]
            to = at[word] + count[before]
            out[to] = piece
            own = np.flatnonzero(piece < 0)
            if len(own):
                spells, char = (count[node] - count[before])[own], (start[word] + depth[before])[own]
                for n in range(int(spells.max())):
                    more = spells > n
                    byte = buf[char[more] if n == 0 else np.minimum(char[more] + n, len(buf) - 1)]
                    byte = np.where(buf[char[more]] == 32, MARK.encode()[min(n, 2)], byte)
                    out[to[own[more]] + n] = self.spelled[byte] if self.bytes else self.unknown
            word, node = word[before > 0], before[before > 0]
        return out, size

    def encode_long(self, word: str) -> array:
        """Piece numbers of one word of any length, the same as by ``encode_words``.

        Only the last position's open nodes are kept. Every ``_SETTLE`` characters the paths back from all positions at
        which a piece may still begin are followed to where they meet; what lies before that can't change any more, is
        written out and forgotten.
        """
        out, open_, back, base = array("i"), [(self.trie, 0.0, 0)], [(-1, ())], 0

        def settle(upto: int) -> None:
            nonlocal base
            ids, at = [], upto
            while at > base:
                at, own = back[at - base]
                ids.append(own)
            out.extend(n for own in reversed(ids) for n in own)
            del back[: upto - base]
            base = upto

        for end, char in enumerate(word):
            open_, how = self._step(char, open_, end)
            back.append(how)
            if end % _SETTLE == _SETTLE - 1:
                starts = {start for _, _, start in open_}
                while len(starts) > 1:
                    far = max(starts)
                    starts.remove(far)
                    starts.add(back[far - base][0])
                settle(starts.pop())
        settle(len(word))
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes in one array, marks as spaces, and where each piece begins."""
        raw = [bytes([self.value[n]]) if n in self.value else p.replace(MARK, " ").encode() for n, p in enumerate(self.text)]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(bytes([self.value[n]]) if n in self.value else self.text[n].encode() for n in ids)
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of each range, one range after the other."""
    before = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
    return np.repeat(start - before, size) + np.arange(size.sum())


def _by_row(buf: np.ndarray, offsets: np.ndarray, change: Callable[[bytes], bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = [change(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def _is_utf8(buf: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether each row is, not only all together."""
    try:
        buf.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return not (buf[offsets[:-1][offsets[:-1] < len(buf)]] & 0xC0 == 0x80).any()


class Encoder:
    """Encodes slices of texts; remembers the pieces of words in at most about ``CACHE_BYTES``."""

    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self._forget()

    def _forget(self) -> None:
        """``known`` has the remembered words' hashes in order, ``place`` their numbers; ``raw`` and ``ids`` hold the words'
        bytes and pieces one after the other, each word's from its ``edge`` on."""
        self.known, self.place, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.raw, self.raw_edge = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _remember(self, key: np.ndarray, raw: np.ndarray, raw_edge: np.ndarray, ids: np.ndarray, edge: np.ndarray) -> None:
        self.place = np.concatenate((self.place, len(self.edge) - 1 + np.arange(len(key))))
        self.known = np.concatenate((self.known, key))
        order = np.argsort(self.known, kind="stable")
        self.known, self.place = self.known[order], self.place[order]
        self.raw, self.raw_edge = np.concatenate((self.raw, raw)), np.concatenate((self.raw_edge, self.raw_edge[-1] + raw_edge[1:]))
        self.ids, self.edge = np.concatenate((self.ids, ids)), np.concatenate((self.edge, self.edge[-1] + edge[1:]))
        parts = (self.known, self.place, self.raw, self.raw_edge, self.ids, self.edge)
        self.held = 3 * sum(x.nbytes for x in parts)  # while words are added, the old, the new and the sorted stand side by side

    def _recall(self, key: np.ndarray, raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The number of each remembered word, or -1; words are compared byte by byte."""
        if not len(self.known):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        found, size = self.place[at], np.diff(edge)
        met = np.flatnonzero((self.known[at] == key) & (np.diff(self.raw_edge)[found] == size))
        alike = raw[_ranges(edge[met], size[met])] == self.raw[_ranges(self.raw_edge[found[met]], size[met])]
        met = met[np.diff(np.concatenate(([0], np.cumsum(alike)))[np.concatenate(([0], np.cumsum(size[met])))]) == size[met]]
        out = np.full(len(key), -1)
        out[met] = found[met]
        return out

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all rows, and where each row's begin.

        A word is a run of spaces with what follows it; the first of a row also takes the mark of the row's beginning.
        Words are told apart by hash inside the slice, so each distinct one is looked up once.
        """
        if MARK.encode() in buf.tobytes():  # a mark in a text counts as a space, as in the library
            buf, offsets = _by_row(buf, offsets, lambda row: row.replace(MARK.encode(), b" "))
        if not _is_utf8(buf, offsets):
            buf, offsets = _by_row(buf, offsets, lambda row: row.decode("utf-8", "replace").encode())
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = buf == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        first = np.unique(offsets[:-1][offsets[:-1] < n])
        head = np.zeros(n, bool)
        head[first] = True
        start = np.flatnonzero(begin | head)
        end = np.append(start[1:], n)
        key = W.mix(W.span_hashes(W._prefix(W._BYTE[buf], 0), start, end, 0) + (end - start).astype(np.uint64) + head[start] * np.uint64(1 << 40))
        key, one, which = np.unique(key, return_index=True, return_inverse=True)
        # the distinct words' bytes, with a space for the mark of a row's beginning
        lead = (head[start[one]] & self.pieces.prefix).astype(np.int64)
        size = end[one] - start[one]
        edge = np.concatenate(([0], np.cumsum(size + lead)))
        raw = np.full(edge[-1], 32, np.uint8)
        raw[_ranges(edge[:-1] + lead, size)] = buf[_ranges(start[one], size)]
        if self.held > CACHE_BYTES:
            self._forget()
        seen = self._recall(key, raw, edge)
        size = np.diff(edge)
        long, fresh = np.flatnonzero(size >= LONG), np.flatnonzero((size < LONG) & (seen < 0))
        own, own_edge = raw[_ranges(edge[fresh], size[fresh])], np.concatenate(([0], np.cumsum(size[fresh])))
        made, made_edge = self.pieces.encode_bytes(own, own_edge)
        whole = [self.pieces.encode_long(raw[a:b].tobytes().decode().replace(" ", MARK)) for a, b in zip(edge[long].tolist(), edge[long + 1].tolist())]
        # each distinct word's pieces: remembered, encoded now, or long
        flat = np.concatenate([self.ids, made, *[np.frombuffer(x, np.int32) for x in whole]])
        told = np.concatenate([np.diff(self.edge), np.diff(made_edge), np.array([len(x) for x in whole], np.int64)])
        number = seen.copy()
        number[fresh], number[long] = len(self.edge) - 1 + np.arange(len(fresh)), len(told) - len(long) + np.arange(len(long))
        at, size = (np.cumsum(told) - told)[number], told[number]
        out = flat[_ranges(at[which], size[which])]
        upto = np.concatenate(([0], np.cumsum(size[which])))
        if len(fresh):
            self._remember(key[fresh], own, own_edge, made, made_edge)
        return out, upto[np.searchsorted(start, offsets)]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.pieces, (self.bytes, self.at) = pieces, pieces.tables()

    def slice(self, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
        """The text of each row of piece numbers."""
        size = self.at[ids + 1] - self.at[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        raw = self.bytes[_ranges(self.at[ids], size)]
        start, end = upto[edge[:-1]], upto[edge[1:]]
        if self.pieces.prefix:
            full = start < end
            lead = np.zeros(len(start), bool)
            lead[full] = raw[start[full]] == 32
            keep = np.ones(len(raw), bool)
            keep[start[lead]] = False
            raw = raw[keep]
            sizes = end - start - lead
        else:
            sizes = end - start
        off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        made = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes()))
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            made = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], pa.large_string())
        return made.cast(pa.string())


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` plus ``ids``, the piece numbers of each whole text, and ``decoded``, the text they give back, if named.

    Null and empty texts have no ids and decode to ''. A text with the mark U+2581 in it decodes with a space there (the
    marked form can't tell them apart); every other text comes back exactly. The distinct words of a slice are encoded
    once; columns of ``docs`` pass through (those of the added names are replaced). ``model_file`` is a path that every
    executor can open. One pass, no shuffle.

    Models whose normaliser changes texts (a table of replacements, or repeated spaces removed, as most published unigram
    models have) and pieces that run over two words are refused: decoding could not give such texts back.
    """
    added = [ids, *([decoded] if decoded else [])]
    docs = docs.drop(*added)
    names = docs.columns
    ddl = f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file)
        decoder = Decoder(encoder.pieces)
        for batch in batches:
            for a, b, buf, off in W.text_slices(batch.column(text)):
                flat, edge = encoder.slice(buf, off)
                columns = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat))]
                if decoded:
                    columns.append(decoder.slice(flat, edge))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], *columns], names=[*names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields]))


def decode_pieces(docs: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` plus the texts of their piece numbers; null ids decode to '', a null number counts as unknown."""
    docs = docs.drop(decoded)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Pieces(model_file))
        for batch in batches:
            rows = [np.array([decoder.pieces.unknown if n is None else n for n in x or ()], np.int64) for x in batch.column(ids).to_pylist()]
            edge = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            out = decoder.slice(np.concatenate([*rows, np.zeros(0, np.int64)]), edge)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], out], names=[*names, decoded])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{decoded}` string").fields]))
