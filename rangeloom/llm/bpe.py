"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols of a word that never stand side by side inside any vocabulary token cannot end up in one
token, so every merge sequence leaves a cut between them. Words are split at these certain cuts, each fragment is
merged on its own, and the results are concatenated: the ids equal those of merging the whole word. Words are
remembered in a bounded table, since texts repeat them.

Defined results: a null or empty text gives no ids and decodes to the empty string. Texts of any length are encoded
whole; a long word takes a heap, so its cost grows as n log n. Rows are independent: ties, repeated rows and further
columns make no difference, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of these characters only are normalised here; in all others the library's own normaliser and splitter run.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įĲ-ſ‘’“”–—…]*")
#: The split pattern of the vocabulary file (fixed value; checked when the file is loaded).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words kept before the table is emptied, and the longest word kept.
KEPT, KEPT_LENGTH = 600_000, 64


def plain_splitter() -> re.Pattern[str]:
    """SPLIT for plain texts: the same alternatives over the plain characters, the commonest first."""
    plain = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
    kinds = {kind: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind) for kind in "LN"}
    return re.compile(rf"[{kinds['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """A vocabulary file with word-end suffixes, its certain cuts, and tables of what has been encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": SPLIT} or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a vocabulary of the supported kind")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.within = [self.vocab[c] for c in self.symbols]
        self.last = [self.vocab[c + self.end] for c in self.symbols]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inside = self._pairs_inside_tokens()
        self.words = plain_splitter()
        self.known: dict[str, bytes] = {}

    def _pairs_inside_tokens(self) -> set[int]:
        """Every pair of neighbouring symbols of any token; the suffix belongs to a token's last symbol."""
        found: set[int] = set()
        for token in self.vocab:
            if token not in self.special:
                ends = token.endswith(self.end) and len(token) > len(self.end)
                parts = [self.vocab[c] for c in (token[: -len(self.end)] if ends else token)]
                if ends:
                    parts[-1] = self.last[self.byte_of[token[-len(self.end) - 1]]]
                found.update(a << 20 | b for a, b in zip(parts, parts[1:]))
        return found

    def fragments(self, symbols: list[int]) -> list[list[int]]:
        """The fragments between certain cuts."""
        inside = self.inside
        cuts = [k for k, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if a << 20 | b not in inside]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])] if cuts else [symbols]

    def merge(self, left: list[int]) -> list[int]:
        """Merge a fragment: always the best-ranked pair, the leftmost among equals."""
        if len(left) > 40:
            return self._merge_long(left)
        rank_of, none = self.rank.get, len(self.merged)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(left, left[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            left[k : k + 2] = [self.merged[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of(left[k] << 20 | left[k + 1], none)
            if k:
                ranks[k - 1] = rank_of(left[k - 1] << 20 | left[k], none)
        return left

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links between neighbours."""
        n, rank_of = len(parts), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := rank_of(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (found := rank_of(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (found, x, parts[x], parts[y]))
        return [p for p, keep in zip(parts, alive) if keep]

    def word(self, word: str) -> bytes:
        """A word's ids (little-endian unsigned 32-bit)."""
        raw = word.encode()
        symbols = list(map(self.within.__getitem__, raw))
        symbols[-1] = self.last[raw[-1]]
        ids = array("I")
        for fragment in self.fragments(symbols):
            ids.extend(self.merge(fragment))
        return ids.tobytes()

    def split(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        if PLAIN.fullmatch(text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        shown = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in shown]

    def _look_up(self, words: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    word = words[k]
                    found = known.get(word)
                    if found is None:
                        found = self.word(word)
                        if len(word) <= KEPT_LENGTH:
                            if len(known) >= KEPT:
                                known.clear()
                            known[word] = found
                    out[k] = found
        return out

    def encode(self, text: str | None) -> bytes:
        """A text's ids (little-endian unsigned 32-bit); special tokens in it become their ids."""
        if not text:
            return b""
        if self.special_at is None or "<|" not in text:
            return b"".join(self._look_up(self.split(text)))
        ids = []
        for piece in self.special_at.split(text):
            if piece in self.special:
                ids.append(array("I", [self.special[piece]]).tobytes())
            elif piece:
                ids += self._look_up(self.split(piece))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """As the library decodes without a decoder: the tokens joined by spaces."""
        return " ".join(map(self.text_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str | None = None) -> ForcedBoundaryBPE:
    """The vocabulary at a path of the worker's machine; the installed word vocabulary by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str | None = None, text: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, with ``text``, decoded (the text decoded from those ids) of each document."""
    schema = "doc_id long, ids array<int>" + (", decoded string" if text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            encoded = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ids = pa.array([memoryview(e).cast("I").tolist() for e in encoded], pa.list_(pa.int32()))
            columns = [batch.column(0), ids, *([pa.array([bpe.decode(e) for e in encoded], pa.string())] if text else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them; only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
