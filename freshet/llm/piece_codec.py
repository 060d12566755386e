"""SentencePiece encoding and decoding by a batched Viterbi pass.

The model at hand merges pieces in the order of their scores, so the wanted path is not the one with the largest sum of scores
but the one whose neighbours would stay apart under those merges. That is still a Viterbi recursion: each prefix of
a string has one such path, and it ends in the longest piece that may follow the path of the shorter prefix. Strings of equal
length advance together, one character a step; substring hashes probe the sorted piece keys, a vectorised check tells which pieces
may follow, and the maxima over piece lengths store the backpointers. A string of more than ``EXACT`` characters has few beside it: it takes
the same steps alone, its probes vectorised over its positions and the checks of pairs of pieces remembered.

Words are first cut wherever two neighbouring characters stand together in no piece, since no merge crosses such a place: text
without spaces becomes short strings, and a character without a piece stands alone and becomes its bytes. Pieces of spaces only are
the model's last merges and all tie, so a run of lone spaces ends as ``Tables.runs`` says.

The tables are made once, on the driver, and sent with the tasks (some 5 MB). A task holds a slice of 1 MB of texts and the words it remembers.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table
from .texts import lean

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Distinct words that a task remembers, and their characters together; beyond either it starts anew.
REMEMBERED, REMEMBERED_CHARS = 100_000, 2_000_000
#: Strings up to so many characters form batches of one length; cells (strings times characters) of a batch; positions probed at once; pairs remembered.
EXACT, CELLS, PROBED, PAIRS = 32, 1 << 18, 1 << 15, 200_000
#: Bits of the index into the sorted keys.
INDEX_BITS = 18
_B, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_U = np.uint64


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _B + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def merge(text: str, score: dict[str, float], stop: int = 1) -> list[str]:
    """Pieces left when the best-scored neighbours, leftmost first, have been joined; ends at ``stop`` pieces."""
    parts, n = [*text], len(text)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(-s, i, 1, 1) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap and left > stop:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if len(parts[i]) != a or j >= n or len(parts[j]) != b:
            continue
        parts[i], parts[j], left = parts[i] + parts[j], "", left - 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (s := score.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (-s, x, len(parts[x]), len(parts[y])))
    return [p for p in parts if p]


@dataclass(frozen=True)
class Tables:
    """What coding needs of a model, as arrays; ``piece`` numbers the pieces that merging can reach."""

    ids: np.ndarray  # of each piece
    length: np.ndarray
    keys: np.ndarray  # hashes of the pieces
    rank: np.ndarray  # place in the order of merging, -1 for single characters
    left: np.ndarray  # the two pieces that its last merge joins
    right: np.ndarray
    end_keys: np.ndarray  # sorted mixed hashes of every ending of a piece
    end_piece: np.ndarray  # the piece that the ending is, or -1
    index: np.ndarray  # first key of each range of end_keys
    chars: np.ndarray  # sorted codes of characters with a piece, and the pieces
    char_piece: np.ndarray
    pairs: np.ndarray  # sorted codes of characters that stand together in some piece
    byte_ids: np.ndarray
    runs: tuple[tuple[int, ...], ...]  # ids of a run of k lone spaces; longer ones start with the last entry's head
    space: int  # the piece of one space
    text: np.ndarray  # bytes of all ids end to end, and their cuts
    cut: np.ndarray


def _mixed(keys: np.ndarray) -> np.ndarray:
    return keys * _U(_MIX)


@functools.cache
def tables(path: str) -> Tables:
    """The tables of the model file ``path``, of which only the list of pieces is read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    name = [model.id_to_piece(i) for i in range(n)]
    texts = [b"" if model.is_control(i) else bytes([int(name[i][3:5], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else name[i].replace(SPACE, " ").encode() for i in range(n)]
    byte_id = {int(name[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {name[i]: model.get_score(i) for i in normal}
    ids = {name[i]: i for i in normal}
    if any("\n" in p or SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in score):
        raise ValueError("a piece crosses the end of a word or line")
    spaces = {p for p in score if len(p) > 1 and not p.strip(SPACE)}
    if spaces and max(score[p] for p in spaces) >= min((s for p, s in score.items() if len(p) > 1 and p not in spaces), default=0.0):
        raise ValueError("runs of spaces are not the last merges")
    most = max(map(len, spaces), default=1)
    runs = [tuple(ids[p] for p in merge(SPACE * k, score)) for k in range(3 * most + 1)]
    if any(runs[k] != runs[most] + runs[k - most] for k in range(most, 3 * most + 1)):
        raise ValueError("runs of spaces have no period")
    made = [p for p in score if len(p) == 1 or (p not in spaces and merge(p, score) == [p])]  # reachable pieces
    index = {p: k for k, p in enumerate(made)}
    order = {p: k for k, p in enumerate(sorted((p for p in made if len(p) > 1), key=lambda p: -score[p]))}
    halves = [merge(p, score, stop=2) if len(p) > 1 else (p, p) for p in made]
    ends = {p[-k:]: -1 for p in made for k in range(1, len(p))} | index  # a string is looked at from the right as long as it ends some piece
    end_keys = _mixed(np.array([_hash(e) for e in ends], _U))
    at = np.argsort(end_keys)
    end_keys = end_keys[at]
    if (end_keys[1:] == end_keys[:-1]).any():
        raise ValueError("two endings share a hash")
    chars = sorted((ord(p), k) for p, k in index.items() if len(p) == 1)
    pairs = sorted({ord(a) << 21 | ord(b) for p in made for a, b in zip(p, p[1:], strict=False)})
    array = lambda x, t=np.int32: np.array(x, t)
    return Tables(
        array([ids[p] for p in made]), array([len(p) for p in made]), np.array([_hash(p) for p in made], _U), array([order.get(p, -1) for p in made]), array([index[a] for a, _ in halves]), array([index[b] for _, b in halves]),
        np.append(end_keys, _U(0xFFFFFFFFFFFFFFFF)), array([*np.array(list(ends.values()))[at], -1]), array(np.searchsorted(end_keys >> _U(64 - INDEX_BITS), np.arange(1 << INDEX_BITS).astype(_U))),
        array([c for c, _ in chars], np.int64), array([k for _, k in chars]), array(pairs, np.int64), array([byte_id[b] for b in range(256)]), tuple(runs[: most + 1]), index[SPACE],
        np.frombuffer(b"".join(texts), np.uint8), array(np.concatenate([[0], np.cumsum([len(t) for t in texts])])),
    )


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Numbered(dict):
    """Words in order of their first lookup; ``new`` holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Codec:
    """Encodes and decodes with ``tables``, remembering the words of a task."""

    def __init__(self, made: Tables):
        self.t = made
        self.longest = int(made.length.max())
        self.power = np.array([pow(_B, k, 1 << 64) for k in range(2 * self.longest + 2)], _U)
        self.sizes, self.pairs = made.length.tolist(), {}
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self._clear()

    def _clear(self) -> None:
        self.table, self.held, self.used = _Numbered(), 0, 0
        self.flat, self.cut = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted keys, or -1."""
        keys = _mixed(keys)
        at = self.t.index[(keys >> _U(64 - INDEX_BITS)).astype(np.int64)]
        found = self.t.end_keys[at]
        low = np.flatnonzero(found < keys)
        while len(low):
            at[low] += 1
            found[low] = now = self.t.end_keys[at[low]]
            low = low[now < keys[low]]
        return np.where(found == keys, at, -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each hash among the pieces, or -1."""
        return self.t.end_piece[self.probe(keys)]  # the last entry is -1

    def may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pieces x and y stay apart: undo their merges, latest first, and see if the inner neighbours would have been joined earlier."""
        t = self.t
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        bound, strict = np.full(len(x), 1 << 30, np.int32), np.ones(len(x), bool)
        while len(live):
            both = self.find(t.keys[x] * self.power[t.length[y]] + t.keys[y])
            r = np.where(both >= 0, t.rank[both], (1 << 30) + 1)
            bad = (r < bound) | (~strict & (r == bound))
            ok[live[bad]] = False
            rx, ry = t.rank[x], t.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_x = rx > ry
            bound, strict = np.where(undo_x, rx, ry), undo_x
            x, y = np.where(undo_x, t.right[x], x), np.where(undo_x, y, t.left[y])
        return ok

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of each row of character codes, padded in front with -1."""
        w, n = codes.shape
        prefix = np.zeros((w, n + 1), _U)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _U(_B) + codes[:, i] + _U(1)
        last = np.zeros((w, n + 1), np.int32)
        for i in range(1, n + 1):
            best, live, found = np.zeros(w, np.int8), np.arange(w), []
            for k in range(1, min(i, self.longest) + 1):
                at = self.probe(prefix[live, i] - prefix[live, i - k] * self.power[k])
                live, at = live[at >= 0], at[at >= 0]
                if not len(live):
                    break
                piece = self.t.end_piece[at]
                found.append((k, live[piece >= 0], piece[piece >= 0]))
            for k, rows, piece in reversed(found):  # only one piece can end a path, so rows that have theirs are done
                open_ = best[rows] == 0
                rows, piece = rows[open_], piece[open_]
                if i > k and len(rows):
                    ok = self.may_follow(last[rows, i - k], piece)
                    rows, piece = rows[ok], piece[ok]
                best[rows] = k
                last[rows, i] = piece
        out, at = [], np.full(w, n)
        while (at > 0).any():
            piece = last[np.arange(w), at]
            out.append(np.where(at > 0, piece, -1))
            at = np.where(at > 0, at - self.t.length[piece], 0)
        return np.stack(out[::-1], axis=1)

    def viterbi_long(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of one string of character codes."""
        n, last, done = len(codes), [0] * (len(codes) + 1), 0
        for s in range(0, n, PROBED):
            lo = max(0, s - self.longest + 1)
            window = codes[lo : s + PROBED].astype(_U) + _U(1)
            h, ends, sizes, pieces = np.zeros(len(window) + 1, _U), [], [], []
            for k in range(1, min(self.longest, len(window)) + 1):
                h = h[:-1] * _U(_B) + window[k - 1 :]
                piece = self.find(h)
                hit = np.flatnonzero((piece >= 0) & (np.arange(len(h)) + lo + k > s))
                ends.append(hit + lo + k)
                sizes.append(np.full(len(hit), k))
                pieces.append(piece[hit])
            end, size, piece = map(np.concatenate, (ends, sizes, pieces))
            order = np.argsort(end * 64 - size)  # longest first
            for e, k, p in zip(end[order].tolist(), size[order].tolist(), piece[order].tolist(), strict=True):
                if e > done and (e == k or self._follows(last[e - k], p)):
                    last[e], done = p, e
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return np.array(out[::-1], np.int32)

    def _follows(self, x: int, y: int) -> bool:
        if (known := self.pairs.get((x, y))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[x, y] = bool(self.may_follow(np.array([x]), np.array([y]))[0])
        return known

    def _paths(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the strings end to end, their number a string); the piece -1 stands for a character without one."""
        count = np.ones(len(start), np.int64)
        single = np.flatnonzero(size == 1)
        c = codes[start[single]]
        at = np.minimum(np.searchsorted(self.t.chars, c), len(self.t.chars) - 1)
        done = [(single, np.where(self.t.chars[at] == c, self.t.char_piece[at], -1))]
        for n in np.unique(size[(size > 1) & (size <= EXACT)]).tolist():
            same = np.flatnonzero(size == n)
            for s in range(0, len(same), CELLS // n):
                rows = same[s : s + CELLS // n]
                path = self.viterbi(codes[start[rows, None] + np.arange(n)].astype(_U))
                count[rows] = (path >= 0).sum(axis=1)
                done.append((rows, path[path >= 0]))
        for row in np.flatnonzero(size > EXACT).tolist():
            piece = self.viterbi_long(codes[start[row] : start[row] + size[row]])
            count[row] = len(piece)
            done.append((np.array([row]), piece))
        first = np.cumsum(count) - count
        flat = np.zeros(count.sum(), np.int32)
        for rows, piece in done:
            flat[_spread(first[rows], count[rows])] = piece
        return flat, count

    def _learn(self) -> None:
        """Encodes the words not seen so far and appends their ids in order."""
        words, self.table.new = self.table.new, []
        if not words:
            return
        t = self.t
        raw = "".join(words).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        cut = ~_member(t.pairs, np.append(0, codes[:-1] << 21 | codes[1:]))
        cut[begin] = True
        start = np.flatnonzero(cut)
        piece, many = self._paths(codes, start, np.diff(np.append(start, len(codes))))
        owner = np.repeat(np.searchsorted(begin, start, "right") - 1, many)
        code = codes[np.repeat(start, many)]  # of the characters without a piece
        # bytes of characters without a piece
        lost = piece < 0
        odd = code[lost]
        as_bytes = np.where((odd >= 0xD800) & (odd < 0xE000), ord("?"), odd)
        wide = np.ones(len(piece), np.int64)
        wide[lost] = 1 + (as_bytes > 0x7F) + (as_bytes > 0x7FF) + (as_bytes > 0xFFFF)
        # runs of lone spaces
        lone = piece == t.space
        same = np.append(False, lone[1:] & lone[:-1] & (owner[1:] == owner[:-1]))
        if same.any():
            head = np.flatnonzero(lone & ~same)
            length = np.bincount(np.cumsum(lone & ~same)[lone] - 1)
            long_ = length > 1
            spelt = [self._run(int(k)) for k in length[long_]]
            wide[same] = 0
            wide[head[long_]] = [len(r) for r in spelt]
        ids = np.zeros(wide.sum(), np.int32)
        first = np.cumsum(wide) - wide
        plain = ~lost & (wide == 1)
        ids[first[plain]] = t.ids[piece[plain]]
        ids[_spread(first[lost], wide[lost])] = t.byte_ids[np.frombuffer(as_bytes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        if same.any():
            for at, r in zip(first[head[long_]].tolist(), spelt, strict=True):
                ids[at : at + len(r)] = r
        total = np.bincount(owner, wide, minlength=len(words)).astype(np.int64)
        self._append(ids, total, len(words))
        self.held += len(codes)

    def _run(self, k: int) -> tuple[int, ...]:
        most = len(self.t.runs) - 1
        return self.t.runs[most] * (k // most) + self.t.runs[k % most]

    def _append(self, ids: np.ndarray, sizes: np.ndarray, many: int) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        known = len(self.table) - many
        if known + many + 1 > len(self.cut):
            self.cut = np.concatenate([self.cut, np.zeros(max(len(self.cut), many), np.int64)])
        self.cut[known + 1 : known + many + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, the n + 1 boundaries)."""
        if len(self.table) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self._clear()
        parts = []
        for text in texts:
            words = self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []
            parts.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self._learn()
        at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = self.cut[at + 1] - self.cut[at]
        ids = self.flat[_spread(self.cut[at], size)]
        bounds = np.cumsum([0, *map(len, parts)])
        return ids, np.append(0, np.cumsum(size))[bounds]

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """The texts of ``ids``, cut at ``cut``: byte pieces join to characters, the space put before the first word goes."""
        size = np.diff(self.t.cut)[ids]
        raw = self.t.text[_spread(self.t.cut[ids], size)].tobytes()
        at = np.append(0, np.cumsum(size))[cut].tolist()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def codec(path: str) -> Codec:
    return Codec(tables(path))


def _slices(texts: pa.Array, rows: int = 1000, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of bounded rows and characters; a longer text is a slice of its own."""
    start, held, part = 0, 0, []
    for t in texts:
        s = t.as_py()
        if part and (len(part) >= rows or held + len(s or "") > most):
            yield start, part
            start, held, part = start + len(part), 0, []
        part.append(s)
        held += len(s or "")
    if part:
        yield start, part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row; null and empty texts have no ids."""
    return _coded(docs, path, id_col, text_col, check=False)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` for every row; null ids give an empty text."""
    made = tables(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(made)
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                rows = [np.asarray(x.as_py() or [], np.int64) for x in part.column(1)]
                texts = c.decode(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return coded.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {coded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``n_ids``, the decoded text's CRC-32 and whether it equals the text (a U+2581 in it reads back as a space).

    Null texts count as empty. Repeated rows are coded each; other columns are ignored.
    """
    return _coded(docs, path, id_col, text_col, check=True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, check: bool) -> DataFrame:
    made = tables(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(made)
        for b in batches:
            for start, texts in _slices(b.column(1)):
                ids, cut = c.encode(texts)
                arrays = [b.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))]
                names = [id_col, "ids"]
                if check:
                    back = c.decode(ids, cut)
                    arrays += [pa.array(np.diff(cut), pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([t == (s or "").replace(SPACE, " ") for t, s in zip(back, texts, strict=True)])]
                    names += ["n_ids", "decoded_crc32", "same"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>" + ", n_ids long, decoded_crc32 long, same boolean" * check
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
