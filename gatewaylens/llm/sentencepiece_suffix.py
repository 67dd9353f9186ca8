"""SentencePiece encoding and decoding by suffix-array matching.

For each batch the distinct chunks of text (a run of blanks with the word after it) are put into one text and its
suffixes are sorted. A binary search finds, for every piece of the vocabulary at once, the range of suffixes
that begin with it: all its occurrences. These are edges from position to position; sorted by where they end,
they are relaxed from left to right.

What relaxing means follows from the model. In a BPE model the encoding of a chunk up to a position ends in
exactly one piece: the one whose edge starts where the encoding up to there ends in a piece that it may follow.
Two pieces may follow each other if no merge across their boundary comes before those that build the pieces. So
an edge relaxes its end if its piece may follow, and the result is that of the merges, piece for piece.
Characters without a piece are spelled in byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gatewaylens.llm.common import fresh_name, memory_returned, slices

BLANK = "\u2581"  # fixed value: stands for a blank
SLICE = 1 << 20
SYMBOLS_AT_ONCE = 200_000  # of distinct chunks that are indexed together; the vocabulary is searched once for them
KNOWN_BYTES = 24 << 20  # of chunks in each of the two generations that a worker remembers; any number gives the same ids
ENTRY_BYTES = 200  # that a remembered chunk takes beside its characters and ids
KNOWN_PAIRS = 1 << 19
NEVER = np.iinfo(np.int64).max


@dataclass
class Pieces:
    """The vocabulary: texts by id, ranks of merges (lower merges first), and the bytes."""

    texts: list[str]
    ids: np.ndarray  # ids of the pieces that stand for text, in order of the text: their searches go through the suffixes from front to back
    rank: np.ndarray  # by id; NEVER for what no merge makes
    byte_ids: np.ndarray
    unknown: int
    add_blank: bool
    pair_key: np.ndarray = field(default=None)  # sorted left * V + right, for pieces whose sum is a piece
    pair_id: np.ndarray = field(default=None)
    edges: list = field(default=None)  # by id: how the first and the last symbol grow while merges build the piece
    matrix: np.ndarray = field(default=None)  # code points of the pieces in `ids`, zeros behind
    young: dict = field(default_factory=dict)  # chunk -> ids as bytes of int32
    old: dict = field(default_factory=dict)
    young_bytes: int = 0

    def forget(self) -> None:
        """Gives the memory back: a worker process goes on with other tasks."""
        self.young, self.old, self.young_bytes = {}, {}, 0


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    """The vocabulary of a BPE model file with byte pieces and no normalisation but the marking of blanks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    count = reader.get_piece_size()
    texts = [reader.id_to_piece(i) for i in range(count)]
    plain = np.array([not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) or reader.is_unused(i))
                      for i in range(count)])
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError(f"{path}: not a BPE model that keeps texts as they are")
    if any(BLANK in t.lstrip(BLANK) for t, p in zip(texts, plain) if p):
        raise ValueError(f"{path}: a piece holds a blank after a letter, so chunks are not independent")
    byte_ids = np.full(256, -1)
    for i in range(count):
        if reader.is_byte(i):
            byte_ids[int(texts[i][1:-1], 16)] = i
    scores = np.array([reader.get_score(i) for i in range(count)])
    ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
    ids = np.array(sorted(np.flatnonzero(plain).tolist(), key=texts.__getitem__), np.int64)
    pieces = Pieces(texts, ids, np.where(plain, ranks, NEVER), byte_ids, reader.unk_id(), spec.add_dummy_prefix)
    _build_pairs(pieces)
    return pieces


def _build_pairs(pieces: Pieces) -> None:
    """Every split of a piece into two pieces, and for each piece how merges build it, found by running them."""
    number = {pieces.texts[i]: int(i) for i in pieces.ids}
    size = len(pieces.texts)
    pieces.matrix = np.zeros((len(pieces.ids), max(map(len, number), default=1)), np.int64)
    for row, i in enumerate(pieces.ids):
        pieces.matrix[row, :len(pieces.texts[i])] = [ord(ch) for ch in pieces.texts[i]]
    keys, made = [], []
    for text, i in number.items():
        for at in range(1, len(text)):
            left, right = number.get(text[:at]), number.get(text[at:])
            if left is not None and right is not None:
                keys.append(left * size + right)
                made.append(i)
    order = np.argsort(np.array(keys, np.int64))
    pieces.pair_key, pieces.pair_id = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
    # The first and last symbol while merges build a piece, with the rank at which each grows: its two edges.
    pair = dict(zip(keys, made))
    rank = pieces.rank.tolist()
    first: list = [()] * size
    last: list = [()] * size
    for text, i in number.items():
        symbols = [number.get(ch, -1) for ch in text]
        head, tail = [symbols[0]], [symbols[-1]]
        when_head, when_tail = [], []
        clock = -1
        while len(symbols) > 1:
            options = [(rank[p], at, p) for at in range(len(symbols) - 1)
                       if (p := pair.get(symbols[at] * size + symbols[at + 1])) is not None]
            if not options:
                break
            step, at, p = min(options)
            clock = max(clock, step)
            symbols[at:at + 2] = [p]
            if at == 0:
                head.append(p)
                when_head.append(clock)
            if at == len(symbols) - 1:
                tail.append(p)
                when_tail.append(clock)
        whole = len(symbols) == 1
        first[i] = (head, when_head) if whole else None
        last[i] = (tail, when_tail) if whole else None
    pieces.edges = [first, last]


class _Follows:
    """Whether one piece may follow another, remembered for all pairs that came up."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.new = pieces, {}
        self.codes, self.answers = np.empty(0, np.int64), np.empty(0, bool)
        self.pair = dict(zip(pieces.pair_key.tolist(), pieces.pair_id.tolist()))
        self.rank = pieces.rank.tolist()

    def ask(self, left: int, right: int) -> bool:
        """Replays the merges next to the boundary: is any pair across it merged before its sides are done?"""
        tail, head = self.pieces.edges[1][left], self.pieces.edges[0][right]
        if tail is None or head is None:
            return False
        if tail == () or head == ():
            return True  # byte pieces take part in no merge
        size, (symbols, when), (others, times) = len(self.pieces.texts), tail, head
        i = j = 0
        while True:
            across = self.pair.get(symbols[i] * size + others[j])
            step_left = when[i] if i < len(when) else NEVER
            step_right = times[j] if j < len(times) else NEVER
            if across is not None:
                step = self.rank[across]
                # Of equal ranks the leftmost pair goes first: the left side's own merge, then the one across.
                if step < step_left and step <= step_right:
                    return False
            if step_left == step_right == NEVER:
                return True
            if step_left <= step_right:
                i += 1
            else:
                j += 1

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left * len(self.pieces.texts) + right
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        missing = np.flatnonzero(self.codes[at] != codes) if len(self.codes) else np.arange(len(codes))
        answers = self.answers[at] if len(self.codes) else np.empty(len(codes), bool)
        if len(missing):
            unique, where = np.unique(codes[missing], return_inverse=True)
            size, new, found = len(self.pieces.texts), self.new, np.empty(len(unique), bool)
            for n, code in enumerate(unique.tolist()):
                answer = new.get(code)
                if answer is None:
                    answer = new[code] = self.ask(*divmod(code, size))
                found[n] = answer
            answers[missing] = found[where]
        return answers

    def settle(self) -> None:
        """Moves new answers into the sorted table; a table that has grown too large starts afresh."""
        if not self.new:
            return
        if len(self.codes) > KNOWN_PAIRS:
            self.codes, self.answers = self.codes[:0], self.answers[:0]
        codes = np.concatenate([self.codes, np.fromiter(self.new.keys(), np.int64, len(self.new))])
        answers = np.concatenate([self.answers, np.fromiter(self.new.values(), bool, len(self.new))])
        order = np.argsort(codes, kind="stable")
        self.codes, self.answers = codes[order], answers[order]
        self.new.clear()


@lru_cache(maxsize=4)
def _follows(path: str) -> _Follows:
    return _Follows(load_pieces(path))


def suffix_ranges(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of `codes` sorted as far as words reach, and for each word (a row, zeros behind) its range of suffixes."""
    depth, size = wanted.shape[1], len(codes)
    bits = max(1, int(codes.max(initial=1)).bit_length())
    per_key = 63 // bits
    padded = np.concatenate([codes, np.zeros(depth + per_key, np.int64)])
    lengths = (wanted > 0).sum(axis=1)

    def key_of(part: int) -> np.ndarray:
        key = np.zeros(size, np.int64)
        for at in range(part, min(part + per_key, depth)):
            key = (key << bits) | padded[at:at + size]
        return key

    keys = [key_of(part) for part in range(0, depth, per_key)]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    low = np.zeros(len(wanted), np.int64)
    high = np.full(len(wanted), size)
    for number, key in enumerate(keys):
        part, key = number * per_key, key[order]
        least, most = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for at in range(part, min(part + per_key, depth)):
            least = (least << bits) | wanted[:, at]
            most = (most << bits) | np.where(at < lengths, wanted[:, at], (1 << bits) - 1)
        if part == 0:
            low, high = np.searchsorted(key, least, "left"), np.searchsorted(key, most, "right")
            continue
        open_ = np.flatnonzero((lengths > part) & (low < high))
        low[open_], high[open_] = _bisect(key, low[open_], high[open_], least[open_], most[open_])
    return order, low, high


def _bisect(key, low, high, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Binary searches inside many ranges of a key at once."""
    ends = []
    for value, right in ((least, False), (most, True)):
        a, b = low.copy(), high.copy()
        while (a < b).any():
            middle = (a + b) >> 1
            at = key[np.minimum(middle, len(key) - 1)]
            up = (at <= value if right else at < value) & (a < b)
            a, b = np.where(up, middle + 1, a), np.where(up | (a >= b), b, middle)
        ends.append(a)
    return ends[0], ends[1]


def encode_chunks(chunks: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in a row, and how many each has. No chunk is empty."""
    pieces, follows = load_pieces(path), _follows(path)
    sizes = np.array([len(c) for c in chunks], np.int64)
    begins = np.cumsum(sizes) - sizes + np.arange(len(chunks))
    text = "\0".join(c.replace("\0", "\ufffe") for c in chunks)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(points).astype(np.int64)
    codes = np.searchsorted(alphabet, points) + 1
    symbol = np.minimum(np.searchsorted(alphabet, pieces.matrix), len(alphabet) - 1)
    spelt = (pieces.matrix == 0) | (alphabet[symbol] == pieces.matrix)
    present = np.flatnonzero(spelt.all(axis=1))
    wanted = np.where(pieces.matrix[present] == 0, 0, symbol[present] + 1)
    ids, lengths = pieces.ids[present], (wanted > 0).sum(axis=1)
    order, low, high = suffix_ranges(codes, wanted)
    counts = np.maximum(high - low, 0)
    # Edges: every occurrence of every piece.
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    start = order[at]
    piece = np.repeat(ids.astype(np.int64), counts)
    span = np.repeat(lengths, counts)
    # Characters without an edge of one symbol are an edge made of bytes.
    single = np.zeros(len(points), bool)
    single[start[span == 1]] = True
    owner = np.repeat(np.arange(len(chunks)), sizes + 1)[: len(points)]
    real = np.ones(len(points), bool)
    real[begins[1:] - 1] = False
    bare = np.flatnonzero(~single & real)
    start, piece, span = np.concatenate([start, bare]), np.concatenate([piece, np.full(len(bare), -1)]), np.concatenate([span, np.ones(len(bare), np.int64)])
    # In order of the place in the chunk where they end; the longer edge is tried first.
    end = start + span
    place = end - begins[owner[start]]
    sort = np.argsort(place * 64 - span, kind="stable")
    start, piece, span, end, place = start[sort], piece[sort], span[sort], end[sort], place[sort]
    last = np.full(len(points) + 1, -2, np.int64)  # piece in which the encoding up to here ends
    back = np.zeros(len(points) + 1, np.int64)
    fresh = np.zeros(len(points) + 1, bool)
    fresh[begins] = True
    cuts = np.flatnonzero(np.diff(place)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(place)]):
        if a == b:
            continue
        s, p, e, w = start[a:b], piece[a:b], end[a:b], span[a:b]
        for length in np.unique(w)[::-1]:
            pick = w == length
            s1, p1, e1 = s[pick], p[pick], e[pick]
            todo = last[e1] == -2
            s1, p1, e1 = s1[todo], p1[todo], e1[todo]
            before = last[s1]
            free = fresh[s1] | (before == -1) | (p1 == -1)
            ask = np.flatnonzero(~free & (before >= 0))
            good = free & (fresh[s1] | (before != -2))
            if len(ask):
                good[ask] = follows.many(before[ask], p1[ask])
            last[e1[good]], back[e1[good]] = p1[good], s1[good]
    follows.settle()
    # Walk back from all chunk ends at once.
    here, number = begins + sizes, np.arange(len(chunks))
    found_chunk, found_at, found_piece = [], [], []
    while len(here):
        found_chunk.append(number)
        found_at.append(back[here])
        found_piece.append(last[here])
        here = back[here]
        more = here > begins[number]
        here, number = here[more], number[more]
    chunk, at, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_chunk, found_at, found_piece))
    sort = np.argsort(at, kind="stable")
    chunk, at, piece = chunk[sort], at[sort], piece[sort]
    spelled = np.flatnonzero(piece == -1)
    if not len(spelled):
        return piece, np.bincount(chunk, minlength=len(chunks))
    width = np.ones(len(piece), np.int64)
    # The bytes of all spelled characters, by their code points; U+FFFE stood in for NUL above.
    point = points[at[spelled]].astype(np.int64)
    for n in np.flatnonzero(point == 0xFFFE):
        place = spelled[n]
        point[n] = ord(chunks[chunk[place]][at[place] - begins[chunk[place]]])
    spelled_ids, sizes = _byte_pieces(point, pieces)
    width[spelled] = sizes
    out = np.repeat(piece, width)
    out[np.repeat(piece == -1, width)] = spelled_ids
    return out, np.bincount(np.repeat(chunk, width), minlength=len(chunks))


def _byte_pieces(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the UTF-8 bytes of the code points in a row, and how many each has."""
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[sizes]
    row = np.repeat(np.arange(len(points)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    part = points[row] >> (6 * (sizes[row] - 1 - place))
    found = pieces.byte_ids[np.where(place == 0, lead[row] | part, 0x80 | (part & 0x3F))]
    return np.where(found < 0, pieces.unknown, found), sizes


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the ids of the whole text in `ids`, as the model's own merges give them.

    A null text has null ids, an empty text none. All other columns pass through, or those named in `keep`; one that is
    called as `ids` is replaced.
    `path` is a model file on the driver, sent to every executor.
    """
    kept = [f for f in docs.schema.fields if f.name != ids and (keep is None or f.name in keep)]
    read, file = fresh_name("text"), _shipped(docs, path)
    schema = StructType([*kept, StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = SparkFiles.get(file)
        try:
            for batch in batches:
                for part in slices(batch, read, SLICE):
                    values, offsets = encode_texts(part.column(read).to_pylist(), local)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                    made = pc.if_else(pc.is_null(part.column(read)), pa.scalar(None, made.type), made)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(f.name) for f in kept), made], names=[*(f.name for f in kept), ids])
        finally:
            load_pieces(local).forget()  # which pieces may follow which is kept: it is small, and most of it comes up in every partition

    return docs.select(F.col(text).alias(read), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(memory_returned(run), schema)


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each text's ids begin and end. Distinct chunks are encoded once."""
    pieces = load_pieces(path)
    cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall  # before every run of blanks
    front = BLANK if pieces.add_blank else ""
    lists = [cut(front + t.replace(" ", BLANK)) if t else [] for t in texts]
    memory = _remembered(pieces, set().union(*lists), path)
    joined = [b"".join(map(memory.__getitem__, one)) for one in lists]
    ends = np.cumsum([0, *(len(j) // 4 for j in joined)])
    return np.frombuffer(b"".join(joined), np.int32), ends.astype(np.int32)


def _remembered(pieces: Pieces, chunks: set[str], path: str) -> dict[str, bytes]:
    """The worker's memory with all of these chunks; what was not used for long is forgotten."""
    if pieces.young_bytes > KNOWN_BYTES:
        pieces.old, pieces.young, pieces.young_bytes = pieces.young, {}, 0
    young, old, new = pieces.young, pieces.old, []
    for chunk in chunks - young.keys():
        ids = old.get(chunk)
        if ids is None:
            new.append(chunk)
        else:
            young[chunk] = ids
            pieces.young_bytes += 4 * len(chunk) + len(ids) + ENTRY_BYTES
    new.sort(key=len)  # chunks of like length are relaxed in step
    symbols = np.cumsum([len(c) for c in new]) // SYMBOLS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(symbols)) + 1).tolist(), len(new)] if new else []
    for start, stop in zip(cuts, cuts[1:]):
        values, sizes = encode_chunks(new[start:stop], path)
        raw, ends = values.astype(np.int32).tobytes(), np.cumsum(sizes) * 4
        young.update(zip(new[start:stop], map(raw.__getitem__, map(slice, (ends - sizes * 4).tolist(), ends.tolist()))))
        pieces.young_bytes += len(raw)
    pieces.young_bytes += 4 * sum(map(len, new)) + ENTRY_BYTES * len(new)
    return young


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the text that `ids` stand for; null ids give null, no ids an empty text.

    Bytes that are no UTF-8 become the replacement character; ids outside the vocabulary raise an error.
    """
    kept = [f for f in docs.schema.fields if f.name != text and (keep is None or f.name in keep)]
    read, file = fresh_name("ids"), _shipped(docs, path)
    schema = StructType([*kept, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(SparkFiles.get(file))
        raw = _raw_pieces(pieces)
        both = _doubled(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = decode_lists(part.column(read), raw, both, pieces.add_blank)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), made], names=[*(f.name for f in kept), text])

    return docs.select(F.col(ids).alias(read), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(memory_returned(run), schema)


def _raw_pieces(pieces: Pieces) -> list[bytes]:
    raw = [b""] * len(pieces.texts)
    for i in pieces.ids:
        raw[i] = pieces.texts[i].replace(BLANK, " ").encode()
    for byte, i in enumerate(pieces.byte_ids):
        if i >= 0:
            raw[i] = bytes([byte])
    raw[pieces.unknown] = " \u2047 ".encode()  # fixed value
    return raw


def decode_ids(ids: list[int], raw: list[bytes], add_blank: bool) -> str:
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if add_blank and text.startswith(" ") else text


def _doubled(raw: list[bytes]) -> pa.Array:
    """The pieces, and behind them the pieces without the blank that they begin with."""
    return pa.array([*raw, *(r.removeprefix(b" ") for r in raw)], pa.binary())


def decode_lists(ids: pa.ListArray, raw: list[bytes], both: pa.Array, add_blank: bool) -> pa.Array:
    """The text of every list: its pieces' bytes joined, without the blank that encoding puts in front."""
    known = np.array(ids.flatten(), np.int64)
    if len(known) and not 0 <= known.min() <= known.max() < len(raw):
        raise IndexError("an id outside the vocabulary")
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
    begins = ends[:-1][np.diff(ends) > 0]
    if add_blank:
        if any(not raw[i] for i in known[begins].tolist()):  # a list that begins with a piece without text
            return pa.array([None if x is None else decode_ids(x, raw, True) for x in ids.to_pylist()], pa.string())
        known[begins] += len(raw)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both.take(pa.array(known))), b"")
    try:
        made = joined.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        made = pa.array([data.decode("utf-8", "replace") for data in joined.to_pylist()], pa.string())
    return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.string()), made)


def _shipped(docs: DataFrame, path: str) -> str:
    """The model file's name on the executors; the file is sent with the job."""
    context = docs.sparkSession.sparkContext
    context.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]
