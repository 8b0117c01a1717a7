"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Pieces (the tokenizer's pre-tokens) are counted over all documents.  The most
frequent ones are compiled, with their ids as outputs, into a minimal acyclic
automaton that shares prefixes and suffixes; a transition carries a number, the
numbers along a piece add up to its index, and the index gives its ids.  The
automaton is one array file that Spark ships to every executor, where all
workers map it into memory.  Pieces that it does not hold are merged exactly,
by rank.  Which pieces the lexicon holds changes speed only, never an id.

A task holds one Arrow batch, the mapped lexicon, and a memo of at most
``MEMO`` pieces that is emptied when full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

# The pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point Python and the tokenizers library classify characters alike (tested);
#: texts with any other character are cut by the tokenizers library itself.
SAFE_BELOW = "ɐ"
LEXICON_SIZE = 1 << 18
MEMO = 1 << 18
_MEMO_BYTES = 4096
_ROWS = 2048  # documents that are counted at once


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        letter = byte_letters()
        of = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in of.items() if t not in self.special}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(of[a], of[b]): (rank, of[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = [of[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        in_order = all(made == 256 + rank for rank, made in self.merges.values()) and sorted(self.single) == list(range(256))
        self._piece = self._fast() if in_order else self.merged

    def _fast(self):
        """Where ids follow the ranks, tiktoken merges by the same ranks."""
        import tiktoken

        special = set(self.special.values())
        ranks = {t: i for i, t in self.tokens.items() if i not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def piece(self, piece: bytes) -> list[int]:
        return self._piece(piece)

    def merged(self, piece: bytes) -> list[int]:
        """Exact merges in order of rank, leftmost first, in n log n."""
        ids: list[int | None] = [self.single[b] for b in piece]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (m := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1], ids[a], ids[b]))
        return [x for x in ids if x is not None]


# ------------------------------------------------------------------ lexicon


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of ``words`` as one array file (int32).

    Layout: header (6 sizes), states' first transitions, states' finality,
    transition keys ``state * 256 + byte`` (ascending), targets, numbers, then
    the offsets and ids of the outputs by index.
    """
    ordered = sorted(w for w in words if w)
    # Incremental construction over sorted words: a state is frozen, and merged with an equal one, once
    # no further word can pass through it.
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # [final, [(byte, target)]] of the states along the last word

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    last = b""
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        for _ in word[shared:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = freeze(path[0])
    n = len(frozen)
    below = [0] * n  # accepted words from a state on; targets are frozen before their sources
    keys, targets, numbers = [], [], []
    for s, (final, out) in enumerate(frozen):
        count = int(final)
        for byte, target in out:
            keys.append(s * 256 + byte)
            targets.append(target)
            numbers.append(count)
            count += below[target]
        below[s] = count
    outputs = [words[w] for w in ordered]
    offsets = np.cumsum([0, *map(len, outputs)])
    flat = [i for ids in outputs for i in ids]
    header = [root, n, len(keys), len(outputs), len(flat), 0]
    arrays = [header, [int(f) for f, _ in frozen], keys, targets, numbers, offsets, flat]
    return b"".join(np.asarray(a, dtype="<i4").tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon over an int32 array, usually a memory map."""

    def __init__(self, array: np.ndarray) -> None:
        root, n, m, outputs, flat, _ = (int(x) for x in array[:6])
        at = 6
        parts = []
        for size in (n, m, m, m, outputs + 1, flat):
            parts.append(array[at : at + size])
            at += size
        self.root, (self.final, self.keys, self.targets, self.numbers, self.offsets, self.ids) = root, parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype="<i4", mode="r"))

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The index of each piece, or -1; all pieces advance byte by byte together."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        found = np.full(len(pieces), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        alive = np.nonzero(lengths > 0)[0]
        state = np.full(len(alive), self.root, dtype=np.int64)
        number = np.zeros(len(alive), dtype=np.int64)
        depth = 0
        while len(alive):
            key = state * 256 + data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[at] == key
            alive, at = alive[goes], at[goes]
            state, number = self.targets[at].astype(np.int64), number[goes] + self.numbers[at]
            depth += 1
            ended = lengths[alive] == depth
            accepted = ended & (self.final[state] > 0)
            found[alive[accepted]] = number[accepted]
            alive, state, number = alive[~ended], state[~ended], number[~ended]
        return found

    def output(self, index: int) -> np.ndarray:
        return self.ids[self.offsets[index] : self.offsets[index + 1]]


# ----------------------------------------------------------------- encoding


def _ranges(wanted) -> str:
    """The characters below ``SAFE_BELOW`` that ``wanted`` holds for, as the inside of a character class."""
    out, start = [], None
    for c in range(ord(SAFE_BELOW) + 1):
        inside = c < ord(SAFE_BELOW) and wanted(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + "-" + re.escape(chr(c - 1)))
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def _pattern():
    """``PATTERN`` with its classes spelled out for the characters below ``SAFE_BELOW``: the plain engine is the faster one."""
    letters, numbers = (_ranges(lambda ch, k=k: unicodedata.category(ch)[0] == k) for k in "LN")
    blank = "\\t-\\r \\x85\\xa0"
    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letters}{numbers}]")
    for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", blank)):
        spelled = spelled.replace(name, f"[{chars}]")
    return re.compile(spelled.replace(r"\S", f"[^{blank}]"))


@lru_cache(maxsize=1)
def _library_cut():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pieces_of(text: str) -> list[str]:
    if text.isascii() or max(text) < SAFE_BELOW:
        return _pattern().findall(text)
    return [text[a:b] for _, (a, b) in _library_cut().pre_tokenize_str(text)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        size = max(vocabulary.tokens, default=-1) + 1
        self.tokens = [vocabulary.tokens.get(i, b"") for i in range(size)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encode new pieces: by the lexicon, else by merging.  Long ones are not kept in the memo."""
        new = list(pieces)
        raw = [p.encode() for p in new]
        at = self.lexicon.find(raw) if self.lexicon else np.full(len(new), -1)
        passing = {}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        for piece, data, index in zip(new, raw, at.tolist(), strict=True):
            ids = self.lexicon.output(index) if index >= 0 else self.vocabulary.piece(data)
            packed = np.asarray(ids, dtype="<u4").tobytes()
            if len(data) <= _MEMO_BYTES and len(self.memo) < MEMO:
                self.memo[piece] = packed
            else:
                passing[piece] = packed
        return passing

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.split and any(s in text for s in self.vocabulary.special):
                pieces: list[str] = []
                for i, part in enumerate(self.split(text)):
                    pieces += [part] if i % 2 else pieces_of(part)
                cut.append(pieces)
            else:
                cut.append(pieces_of(text))
        seen: set[str] = set()
        seen.update(*cut)
        special = {s: np.asarray([i], dtype="<u4").tobytes() for s, i in self.vocabulary.special.items()}
        memo = self.memo
        missing = {p for p in seen if p not in memo} - special.keys()
        if len(memo) + len(missing) > MEMO:  # it will be emptied: nothing of it may be relied on
            missing = seen - special.keys()
        passing = self._learn(missing)
        if passing or any(s in seen for s in special):
            of = passing | special
            return [b"".join([of[p] if p in of else memo[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def frequent_pieces(docs: DataFrame, text: str = "text", size: int = LEXICON_SIZE) -> DataFrame:
    """``(piece, n)``: the pieces that make up at least one in ``size`` of all counted ones (so at most ``size``).

    A piece that occurs once in a few thousand documents is not counted there:
    it cannot matter to which pieces are frequent, and the lexicon never
    changes ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(pieces_of(t or ""))
            often = [(p, n) for p, n in counts.items() if n > 1 and len(p) <= 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["piece", "n"]
            )

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "piece string, n long")
    counted = written(counted.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counted.where(F.col("n") * size >= F.lit(total))


def _ship(spark: SparkSession, data: bytes) -> str:
    """Ship the compiled lexicon to every executor; returns the name to look it up by."""
    name = f"tidemark-lexicon-{uuid.uuid4().hex}.bin"  # Spark refuses one name for two paths
    folder = tempfile.mkdtemp(prefix="tidemark-lexicon-")
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: all columns but the text stay, and there come
    ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (binary, little-endian
    unsigned 32-bit integers) and ``decoded``.

    Null texts are empty and have no ids.  Special tokens written in a text are
    encoded as such, like the library does.  Clashing names of further columns
    are replaced by the results; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        data = f.read()
    vocabulary = Vocabulary(data)
    words = [r["piece"] for r in frequent_pieces(docs, text).collect()]
    lexicon = _ship(spark, compile_lexicon({w.encode(): vocabulary.piece(w.encode()) for w in words}))
    shared = spark.sparkContext.broadcast(data)  # the vocabulary file, a few MB whatever the corpus
    results = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        results |= {"ids": "binary", "decoded": "string"}
    taken = {r.lower() for r in results}
    keep = [c for c in docs.columns if c != text and c.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), Lexicon.mapped(SparkFiles.get(lexicon)))
        for batch in batches:
            n, ids_sha, out_sha, every, decoded = [], [], [], [], []
            for group in _groups([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                for ids in encoder.encode_batch(group):
                    out = encoder.decode(ids)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    out_sha.append(hashlib.sha256(out.encode()).hexdigest())
                    if with_ids:
                        every.append(ids)
                        decoded.append(out)
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            if with_ids:
                made += [pa.array(every, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *made], names=[*keep, *results])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.schema
    for name, kind in results.items():
        schema = schema.add(name, kind)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
