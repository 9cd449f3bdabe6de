"""BPE encoding and decoding by a prefix-sharing trie.

In byte pair encoding the last token of a text's encoding, with the encoding of what precedes it, is the whole encoding; and the
last token of a prefix is the one token that ends there and that may follow the last token before it. So the distinct words of a
batch are put into a trie, which is walked depth first: each node gets the last token of its prefix from the nodes
above it, once for all words that share the prefix. Texts are then put together from their words' ids in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Words a worker remembers at most.
CACHE_WORDS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest counts on from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Byte-level BPE without word-end marks, from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged[left, right] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank + 1
        self.longest = max(map(len, self.ids))
        n = max([*self.ids.values(), *self.special.values()]) + 1
        token_bytes = [b""] * n
        for t, i in self.ids.items():
            token_bytes[i] = t
        for t, i in self.special.items():
            token_bytes[i] = t.encode()
        self.token_sizes = np.array([len(t) for t in token_bytes])
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_sizes)])
        self.token_data = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.pairs: dict[int, bool] = {}
        self.known = C.IdCache(CACHE_WORDS)
        self.slow = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]" + b"".join(b"|" + re.escape(s.encode()) for s in self.special))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    # ---- words -----------------------------------------------------------------------------------

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b right after token a stays as it is when their bytes are encoded together.

        No merge across the border may come before the merges that build a and b: merges are undone from the latest on, and at
        each step the two tokens at the border must not merge earlier than the token that was undone last.
        """
        known = self.pairs.get(a << 32 | b)
        if known is not None:
            return known
        left, right, limit, ok = a, b, 1 << 60, True
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and self.rank[whole] < limit:
                ok = False
                break
            rl, rr = self.rank.get(left, 0), self.rank.get(right, 0)
            if not rl and not rr:
                break
            if rl > rr:  # left was built later
                limit, left = rl, self.parts[left][1]
            else:  # an equal merge further left comes first, so one across the border still may
                limit, right = rr + 1, self.parts[right][0]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def encode_words(self, distinct: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of words, each as if it stood alone."""
        out, ids, longest, may = {}, self.ids, self.longest, self.may_follow
        last: list[int] = []  # the last token of each prefix of the path from the root
        sizes: list[int] = []
        before = b""
        for word in sorted(distinct):  # the order of a depth-first walk through the trie
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], sizes[shared:]
            for end in range(shared + 1, len(word) + 1):
                for n in range(min(end, longest), 0, -1):
                    token = ids.get(word[end - n : end])
                    if token is not None and (n == end or may(last[end - n - 1], token)):
                        last.append(token)
                        sizes.append(n)
                        break
                else:
                    raise AssertionError("a prefix has no last token")
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end - 1])
                end -= sizes[end - 1]
            out[word] = tokens[::-1]
            before = word
        return out

    def _chunk_ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks (an optional space and what is up to the next white space, or white space)."""
        split = []
        for c in chunks:
            if c.isascii() and (c[1:] if c[:1] == b" " else c).isalpha():
                split.append([c])
            else:
                split.append([bytes(_ALPHABET[x] for x in p) for p, _ in self.splitter.pre_tokenize_str(c.decode())])
        encoded = self.encode_words(list({w for ws in split for w in ws}))
        return [encoded[ws[0]] if len(ws) == 1 else [i for w in ws for i in encoded[w]] for ws in split]

    # ---- texts -----------------------------------------------------------------------------------

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of chunks in the concatenated texts, as the byte-level pattern parts words at ASCII white space."""
        white = C.SPACE[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        new = new[:-1]
        last = np.zeros(len(data), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        prev_white = np.zeros(len(data), bool)
        prev_white[1:] = white[:-1]
        prev_white[new] = False
        next_solid = np.zeros(len(data), bool)
        next_solid[:-1] = ~white[1:]
        next_solid[last] = False
        start = new | (white & ~prev_white) | (white & next_solid)  # a run of white space, and its last before a word
        prev_other = np.zeros(len(data), bool)
        prev_other[1:] = white[:-1] & (data[:-1] != 32)
        start |= ~white & prev_other & ~new  # a word joins only a space
        return np.flatnonzero(start), white

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their n+1 offsets."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        starts, _ = self._chunks(data, offsets)
        raw = data.tobytes()
        odd = np.unique(np.searchsorted(offsets, [m.start() for m in self.slow.finditer(raw)], "right") - 1)
        special: dict[int, int] = {}
        if len(odd):
            of = np.searchsorted(offsets, starts, "right") - 1
            more = [starts[~np.isin(of, odd)]]
            for d in odd:
                at, text = int(offsets[d]), raw[offsets[d] : offsets[d + 1]].decode()
                found = []
                for part in self.cut.split(text) if self.cut else [text]:
                    if part in self.special:
                        special[at] = self.special[part]
                        found.append(at)
                        at += len(part.encode())
                    elif part:
                        for token, _ in self.splitter.pre_tokenize_str(part):
                            found.append(at)
                            at += len(token)
                more.append(np.array(found, np.int64))
            starts = np.sort(np.concatenate(more))
        chunks, chunk_at, name = C.distinct_segments(data, np.append(starts, len(data)))
        flat_chunks = chunks.tobytes()
        encode = lambda places: self._chunk_ids([flat_chunks[a:z] for a, z in zip(chunk_at[places].tolist(), chunk_at[places + 1].tolist(), strict=True)])
        begins, sizes = self.known.find(chunks, chunk_at, encode)
        n, flat_at = sizes[name], begins[name]
        if special:
            marks = np.searchsorted(starts, list(special))
            n[marks] = 1
        at = np.concatenate([[0], np.cumsum(n)])
        flat = self.known.flat[C.gather_at(flat_at, n)]
        if special:
            flat[at[marks]] = list(special.values())
        return flat, at[np.searchsorted(starts, offsets)]

    def decode_ids(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts that the ids stand for, special tokens included; bytes that are no UTF-8 are replaced."""
        sizes = self.token_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.token_data[np.repeat(self.token_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        at = ends[offsets]
        return [out[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]


_ALPHABET = byte_alphabet()


@lru_cache(maxsize=4)
def load(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text; null text is empty. `vocabulary` is a path on every executor."""
    return _run(docs, vocabulary, lambda bpe, ids, at: [pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["ids"], "ids binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and then decoded from the ids.

    Null text is empty (no ids); special tokens spelt out in a text are those tokens; repeated rows each give a row.
    """

    def digest(bpe, ids, at):
        hashes = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return [pa.array(np.diff(at), pa.int64()), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode_ids(ids, at)], pa.string())]

    return _run(docs, vocabulary, digest, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, vocabulary: str, make, names: list[str], schema: str) -> DataFrame:
    C.configure(docs.sparkSession)

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            data, offsets = C.text_bytes(b.column(1))
            for i, j in C.pieces(offsets, 1 << 20):
                o = offsets[i : j + 1]
                ids, at = bpe.encode_bytes(data[o[0] : o[-1]], o - o[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *make(bpe, ids, at)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of what encode() returns."""
    C.configure(encoded.sparkSession)

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() for x in bpe.decode_ids(np.concatenate(ids) if ids else np.zeros(0, np.uint32), at)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
