"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token holds a segment tree whose leaf ``i`` is the merge rank of the pair that starts at symbol ``i``. The
root is the leftmost pair of lowest rank; a merge changes three leaves and their paths, so a pre-token of n bytes takes
O(n log n). Short pre-tokens of a batch run through one set of trees held in arrays; long ones through a tree of lists.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import slices, uncollected
from gridloom.staging import staged

#: Fixed value: how byte-level vocabularies cut text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int64).max
WIDEST_BATCH = 128
BATCH_WORDS = 3_000
CACHE_ENTRIES = 500_000


def vocabulary_path(name_or_path: str) -> str:
    """A path as given, or the place of an installed public vocabulary of that file name."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def printable_bytes() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class SegmentTreeBpe:
    """Byte-level BPE of a tokenizers JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        shown = printable_bytes()
        back = {c: b for b, c in shown.items()}
        self.base = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.by_pair = {int(p): r for r, p in reversed(list(enumerate(pairs)))}
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bytes_of = [b""] * self.size
        for token, i in chain(vocab.items(), self.special.items()):
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Starts the cache of pre-tokens anew. Its values are tuples of numbers, which the garbage collector passes over."""
        self.words: dict[str, tuple[int, ...]] = {s: (i,) for s, i in self.special.items()}

    def known(self, pre_tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The cache with the ids of all these; new ones share one batch of trees."""
        new = list(set(pre_tokens).difference(self.words))
        self.words.update(zip(new, map(tuple, self.encode_words([w.encode() for w in new]))))
        return self.words

    def encode_spaced(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks that each start with their only space and end in no white space: a pre-token with a space starts each."""
        if len(self.words) > CACHE_ENTRIES:
            self.forget()
        text = "".join(chunks)
        if any(s in text for s in self.special):
            return list(map(tuple, self.encode_chunks(chunks)))
        pre_tokens = self.pre_token.findall(text)
        words, out = self.known(pre_tokens), []
        for w in pre_tokens:
            if w[0] == " ":
                out.append(words[w])
            else:
                out[-1] += words[w]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each text; all pre-tokens of the call share one batch of trees."""
        if len(self.words) > CACHE_ENTRIES:
            self.forget()
        plans, cut = [], self.pre_token.findall
        for text in chunks:
            if self.cut and self.cut.search(text):
                plan, at = [], 0
                for m in self.cut.finditer(text):
                    plan += [*cut(text[at : m.start()]), m.group()]
                    at = m.end()
                plans.append(plan + cut(text[at:]))
            else:
                plans.append(cut(text))
        words = self.known(chain.from_iterable(plans))
        return [list(chain.from_iterable(map(words.__getitem__, p))) for p in plans]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = [int(self.base[w[0]])]
            elif len(w) > WIDEST_BATCH:
                out[i] = self.encode_long(w)
            elif w:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, those in by_width.items():
            for at in range(0, len(those), BATCH_WORDS):
                part = those[at : at + BATCH_WORDS]
                for i, ids in zip(part, self._encode_batch([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NONE where no merge is listed or an id is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def _encode_batch(self, words: list[bytes], width: int) -> list[list[int]]:
        n, place = len(words), np.arange(width)
        size = np.array([len(w) for w in words])[:, None]
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no symbol"
        ids[:, :width] = np.where(place < size, self.base[raw], -1)
        after = np.where(place < size - 1, place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        first = self._rank(ids[:, : width - 1], ids[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(first == NONE, NONE, first * width + place[:-1])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] != NONE)
        while row.size:
            rank, p = np.divmod(tree[row, 1], width)
            q = after[row, p]
            r, left = after[row, q], before[row, p]
            new = self.merged[rank]
            ids[row, p], ids[row, q], after[row, p] = new, -1, r
            linked = r < width
            before[row[linked], r[linked]] = p[linked]
            right_rank = self._rank(new, ids[row, r])
            left_rank = self._rank(np.where(left >= 0, ids[row, left], -1), new)
            tree[row, width + q] = NONE
            tree[row, width + p] = np.where(right_rank == NONE, NONE, right_rank * width + p)
            has = left >= 0
            tree[row[has], width + left[has]] = np.where(left_rank == NONE, NONE, left_rank * width + left)[has]
            for rows, leaf in ((row, q), (row, p), (row[has], left[has])):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            row = row[tree[row, 1] != NONE]
        kept = ids[:, :width] >= 0
        flat, ends = ids[:, :width][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> list[int]:
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, size, rank_of, merged = len(ids), self.size, self.by_pair, self.merged
        width = 1 << (n - 1).bit_length()
        after, before, none = [*range(1, n), -1], [*range(-1, n - 1)], (len(merged) + 1) * width

        def leaf(i: int) -> int:
            j = after[i]
            rank = rank_of.get(ids[i] * size + ids[j]) if j >= 0 else None
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] != none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            ids[p], ids[q], after[p] = int(merged[rank]), -1, after[q]
            if after[q] >= 0:
                before[after[q]] = p
            put(q, none)
            put(p, leaf(p))
            if before[p] >= 0:
                put(before[p], leaf(before[p]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class ChunkedEncoder:
    """Encodes whole texts from cached chunks.

    A chunk is a space and what follows it up to the next one. No pre-token of a byte-level vocabulary crosses its
    edge unless white space stands before the space; texts with such a place are encoded whole. Each chunk is kept as
    the digits of its ids and the bytes that they decode to, so a text is put together from whole chunks.
    """

    def __init__(self, model):
        self.model, self.spaced, self.older, self.opening = model, {}, {}, {}
        self.digits = list(map(str, range(model.size)))  # chunks that come up again move from the older cache to the newer one

    def entry(self, ids: Iterable[int]) -> tuple[str, bytes]:
        return ",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.model.bytes_of.__getitem__, ids))

    def parts(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """The entries of each text's chunks."""
        if len(self.spaced) + len(self.opening) > CACHE_ENTRIES // 2:
            self.spaced, self.older, self.opening = {}, self.spaced, {}
        cut = [t.split(" ") for t in texts]
        spaced = set(chain.from_iterable([islice(c, 1, None) for c in cut])).difference(self.spaced)
        again = spaced.intersection(self.older)
        self.spaced.update(zip(again, map(self.older.pop, again)))
        for cache, lead, encode, missing in (
            (self.spaced, " ", self.model.encode_spaced, spaced.difference(again)),
            (self.opening, "", self.model.encode_chunks, {c[0] for c in cut}.difference(self.opening)),
        ):
            odd = [w for w in missing if (not w and lead) or w[-1:].isspace()]
            cache.update(dict.fromkeys(odd))
            plain = list(missing.difference(odd))
            cache.update(zip(plain, map(self.entry, encode([lead + w for w in plain]))))
        out = [[self.opening[c[0]], *map(self.spaced.__getitem__, islice(c, 1, None))] for c in cut]
        whole = [i for i, p in enumerate(out) if None in p]
        for i, ids in zip(whole, self.model.encode_chunks([texts[i] for i in whole]) if whole else ()):
            out[i] = [self.entry(ids)]
        return out

    def whole(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """The digits of each text's ids, joined by commas, and the bytes that the ids decode to."""
        for parts in self.parts(texts):
            digits, raw = zip(*parts)
            yield ",".join(filter(None, digits)), b"".join(raw)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, digits.split(","))) if digits else [] for digits, _ in self.whole(texts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkedEncoder:
    """One encoder for each Python worker."""
    return ChunkedEncoder(SegmentTreeBpe(vocabulary_path(path)))


@lru_cache(maxsize=4)
def rank_encoding(path: str):
    """The same vocabulary for the tiktoken library, for callers that need ids alone and many of them."""
    import tiktoken

    model = SegmentTreeBpe(vocabulary_path(path))
    if (np.diff(model.merged) <= 0).any():
        raise ValueError(f"{path}: the ids of merges have to follow their order")
    special = set(model.special.values())
    return tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks={b: i for i, b in enumerate(model.bytes_of) if i not in special}, special_tokens=model.special)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    A null or empty text has no tokens and the hashes of the empty string; very long texts are encoded whole; repeated
    rows stay repeated; an empty table gives no rows; other columns are not read, so their names can't clash. Special
    strings of the vocabulary inside texts become their ids, and decoding keeps them.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for part in uncollected(slices(batches, "_text")):
            n, listed, decoded, ids = [], [], [], []
            for digits, raw in enc.whole([t or "" for t in part.column("_text").to_pylist()]):
                n.append(digits.count(",") + 1 if digits else 0)
                listed.append(sha(digits.encode()))
                decoded.append(sha(raw.decode("utf-8", "replace").encode()))
                if with_ids:
                    ids.append(list(map(int, digits.split(","))) if digits else [])
            columns, names = [part.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return staged(docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema), "encoded")


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of arrays of ids, whatever their length; a null or empty array decodes to the empty text, repeated rows stay repeated,
    other columns are not read, and an empty table gives no rows."""
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
