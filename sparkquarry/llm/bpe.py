"""BPE encoding by a segment tree over adjacent pair ranks, many words side by side, and decoding.

Each word's adjacent pairs are the leaves of a tree of minima, a leaf holding (rank, position).  The root yields the
leftmost pair of the lowest rank; merging it changes three leaves, whose paths to the root are computed anew, in
logarithmic time; a word is done when its root holds no pair.  Words of similar length are stacked and step together in
numpy, so a step costs a few array operations for all of them.  Words of over LONG bytes are taken one by one, by the
same tree in plain Python, since array operations pay only for many words.

Splitting texts into words follows the tokenizer file's byte-level pattern; strings of its special tokens in a text
become their ids.  Defined results: a null or empty text has no ids and decodes to an empty text; texts of any length
are taken whole; rows are rows: repeated ones and those that share a doc_id or have none are encoded each; an empty table
gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bounded, columns_of
from .pieces import PieceTable

_NONE = np.int64(1) << 62
#: Cells of a stack of words; bytes of a word from which it is taken by itself.
_STACK, LONG = 1 << 19, 4096


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 as itself, the rest from 256."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._hash(keys, np.arange(len(keys)), made)
        self._merges = keys, made
        self.pattern = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.alphabet = alphabet
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = PieceTable()
        # what decoding and digests look up by id
        self.spelled = pa.array(self.token_bytes, pa.binary())
        self.decimals = pa.array([str(i).encode() for i in range(size)], pa.binary())

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table from pair to rank and product."""
        bits = 19
        self.mask = (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, -1, np.int64)
        self.slot_made = np.zeros(1 << bits, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.slot_key[at[first]] < 0]
            put = todo[first]
            self.slot_key[at[first]], self.slot_rank[at[first]], self.slot_made[at[first]] = keys[put], ranks[put], made[put]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys * np.int64(0x9E3779B97F4A7)) >> 20) ^ (keys >> 7)) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pairs, and whether each pair is in the table."""
        keys = left << 20 | right
        at = self._slot(keys)
        found = self.slot_key[at]
        odd = np.flatnonzero((found != keys) & (found >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            found[odd] = self.slot_key[at[odd]]
            odd = odd[(found[odd] != keys[odd]) & (found[odd] >= 0)]
        return at, found == keys

    def _stack(self, words: list[bytes], bits: int) -> list[bytes]:
        """The ids of words of at most 2**bits bytes, as 32-bit integers."""
        n, width = len(words), 1 << bits
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width][np.arange(width) < lengths[:, None]] = self.of_byte[raw]
        place = np.arange(width)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            slots, known = self.pairs(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel())
            known &= (place[1:] < lengths[:, None]).ravel()
            tree[:, width : 2 * width - 1] = np.where(known, self.slot_rank[slots] << bits | np.tile(place[:-1], n), _NONE).reshape(n, width - 1)
            for level in range(bits - 1, -1, -1):
                a = 1 << level
                tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        alive = np.arange(width) < lengths[:, None]
        row = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.zeros(0, np.int64)
        flat, side, back, front, tops, live = ids.ravel(), width + 1, before.ravel(), after.ravel(), tree.ravel(), alive.ravel()
        while len(row):
            at = tops[row * (2 * width) + 1] & (width - 1)
            base = row * side
            gone = front[base + at]
            slots, _ = self.pairs(flat[base + at], flat[base + gone])
            made = self.slot_made[slots]
            flat[base + at] = made
            following = front[base + gone]
            front[base + at] = following
            back[base + np.minimum(following, width)] = at
            live[row * width + gone] = False
            # the merged token with the one after it, then the one before it with the merged token
            slots, known = self.pairs(made, flat[base + np.minimum(following, width)])
            known &= following < lengths[row]
            here = np.where(known, self.slot_rank[slots] << bits | at, _NONE)
            prior = back[base + at]
            some = prior >= 0
            prior = np.where(some, prior, at)
            slots, known = self.pairs(flat[base + prior], made)
            prior_key = np.where(some, np.where(known, self.slot_rank[slots] << bits | prior, _NONE), here)
            top = row * (2 * width)
            tops[top + width + gone] = _NONE
            tops[top + width + at] = here
            tops[top + width + prior] = prior_key
            node = np.concatenate([width + at, width + gone, width + prior])
            top3 = np.concatenate([top, top, top])
            for _ in range(bits):
                node >>= 1
                child = top3 + 2 * node
                tops[top3 + node] = np.minimum(tops[child], tops[child + 1])
            row = row[tops[top + 1] < _NONE]
        kept = ids[:, :width][alive].astype("<i4").tobytes()
        ends = (4 * np.cumsum(alive.sum(1))).tolist()
        return [kept[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    @cached_property
    def _ranked(self) -> dict[int, tuple[int, int]]:
        """Rank and product by pair."""
        keys, made = self._merges
        return {k: (r, m) for r, (k, m) in enumerate(zip(keys.tolist(), made.tolist(), strict=True))}

    def _alone(self, word: bytes) -> bytes:
        """The ids of one long word: the same tree, a path stopping where a minimum stays as it was."""
        n, ranked, none = len(word), self._ranked, 1 << 62
        width = 1 << (n - 1).bit_length()
        ids, after, before = array("i", self.of_byte[np.frombuffer(word, np.uint8)].tolist()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        start = np.full(2 * width, none, np.int64)
        slots, known = self.pairs(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        start[width : width + n - 1] = np.where(known, self.slot_rank[slots] << 32 | np.arange(n - 1), none)
        size = width
        while size > 1:
            start[size // 2 : size] = np.minimum(start[size : 2 * size : 2], start[size + 1 : 2 * size : 2])
            size //= 2
        tree = array("q", start.tobytes())

        def put(place: int, left: int, right: int) -> None:
            hit = ranked.get(left << 20 | right) if right >= 0 else None
            node, low = width + place, hit[0] << 32 | place if hit else none
            while node and tree[node] != low:
                tree[node] = low
                low = min(low, tree[node ^ 1])
                node >>= 1

        while (top := tree[1]) < none:
            at = top & 0xFFFFFFFF
            gone = after[at]
            made = ids[at] = ranked[ids[at] << 20 | ids[gone]][1]
            following, prior = after[gone], before[at]
            after[at], ids[gone] = following, -1
            if following < n:
                before[following] = at
            put(gone, 0, -1)
            put(at, made, ids[following] if following < n else -1)
            if prior >= 0:
                put(prior, ids[prior], made)
        kept = np.array(ids, "<i4")
        return kept[kept >= 0].tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, words being what the pattern splits off, as 32-bit integers."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._alone(words[i])
        bits = np.where(sizes > LONG, -1, np.ceil(np.log2(np.maximum(sizes, 1)))).astype(int)
        for b in np.unique(bits[bits >= 0]):
            those = np.flatnonzero(bits == b)
            step = max(1, _STACK >> b)
            for k in range(0, len(those), step):
                part = those[k : k + step]
                for i, ids in zip(part, self._stack([words[i] for i in part], int(b)), strict=True):
                    out[i] = ids
        return out

    def split_piece(self, piece: str) -> list[bytes]:
        """A piece's words, as bytes. Beyond Latin letters the library's own splitter decides what a letter is."""
        if piece.isascii() or max(piece) < "ɐ":
            return [w.encode() for w in self.pattern.findall(piece)]
        return [bytes(self.alphabet[c] for c in w) for w, _ in self.library.pre_tokenize_str(piece)]

    def _encode_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece, as 32-bit integers."""
        split = [self.split_piece(p) for p in pieces]
        ids = iter(self.encode_words([w for ws in split for w in ws]))
        for words in split:
            yield b"".join([next(ids) for _ in words])

    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids, as 32-bit integers."""
        parts, many = [], []
        for text in texts:
            cut = self.split.split(text or "") if self.split and any(s in (text or "") for s in self.special) else [text or ""]
            parts.extend(cut[::2])
            many.append(cut[1::2])
        values = self.words.texts(parts, self._encode_pieces)
        for specials in many:
            got = [next(values)]
            for s in specials:
                got += [np.array([self.special[s]], "<i4").tobytes(), next(values)]
            yield b"".join(got) if specials else got[0]

    def lists(self, texts: Iterable[str | None]) -> pa.ListArray:
        """The ids of each text as a list array."""
        got = list(self.encoded(texts))
        ends = np.cumsum([0, *map(len, got)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))

    @staticmethod
    def _joined(ids: pa.ListArray, table: pa.Array, by: bytes) -> pa.Array:
        """For each list what the table has at its ids, joined."""
        flat = ids.flatten()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(flat)), pa.scalar(by, pa.binary()))

    def listed(self, ids: pa.ListArray) -> list[bytes]:
        """Each list as decimals with commas."""
        return self._joined(ids, self.decimals, b",").to_pylist()

    def decoded(self, ids: pa.ListArray) -> list[str]:
        """The texts that lists of ids stand for; a null list stands for an empty one."""
        return [raw.decode("utf-8", "replace") for raw in self._joined(ids, self.spelled, b"").to_pylist()]


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One codec for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's text."""
    path = path or default_path()

    def run(batches):
        codec = loaded(path)
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), codec.lists(b.column("text").to_pylist())], ["doc_id", "ids"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); null ids give an empty text."""
    path = path or default_path()

    def run(batches):
        codec = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codec.decoded(b.column("ids")), pa.string())], ["doc_id", "text"])

    return columns_of(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimals with commas) and of the text that is decoded from these ids."""
    path = path or default_path()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        codec = loaded(path)
        for b in bounded(batches):
            ids = codec.lists(b.column("text").to_pylist())
            digest = [pa.array([sha(x) for x in codec.listed(ids)], pa.string()), pa.array([sha(x.encode()) for x in codec.decoded(ids)], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), *digest], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
