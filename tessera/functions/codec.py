"""Tile records and the conditional Huffman codec.

Wire formats are little-endian. Tile: x, y, w, h as uint16, r, g, b and the ROI flag as uint8. Payload: "ASCE", a flag byte (0 raw, 1 Huffman), body.
Huffman body: number of bytes, tree (bits, leaves, packed length; preorder bits with 1 for a leaf; leaf bytes), number of data bits, data, first bit highest.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# fixed by the format
MAGIC = b"ASCE"
HEADER = len(MAGIC) + 1
RECORD = np.dtype([("x", "<u2"), ("y", "<u2"), ("w", "<u2"), ("h", "<u2"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("roi", "u1")])


class CodecError(ValueError):
    """Bytes that don't follow the format, or values that it can't hold."""


def serialize_tiles(geometry: np.ndarray, colour: np.ndarray, is_roi: np.ndarray) -> bytes:
    """n x (x, y, w, h), n x (r, g, b) and n flags as records; colours are rounded half to even."""
    if len(geometry) and (geometry.max() > 0xFFFF or geometry.min() < 0):
        raise CodecError("a tile's coordinates exceed 65535")
    out = np.zeros(len(geometry), RECORD)
    for i, name in enumerate("xywh"):
        out[name] = geometry[:, i]
    rounded = np.clip(np.rint(np.asarray(colour, np.float64)), 0, 255)
    for i, name in enumerate("rgb"):
        out[name] = rounded[:, i]
    out["roi"] = is_roi
    return out.tobytes()


def deserialize_tiles(data: bytes) -> np.ndarray:
    if len(data) % RECORD.itemsize:
        raise CodecError("tile data are not a whole number of records")
    return np.frombuffer(data, RECORD)


def code_lengths(counts: dict[int, int]) -> tuple[list, dict[int, str]]:
    """An optimal prefix tree as nested pairs, and each symbol's code; one symbol alone fills both leaves."""
    if not counts:
        raise CodecError("nothing to build a tree from")
    if len(counts) == 1:
        (s,) = counts
        return (s, s), {s: "0"}
    heap = [(n, i, s) for i, (s, n) in enumerate(counts.items())]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
        serial += 1
    tree, codes, stack = heap[0][2], {}, [(heap[0][2], "")]
    while stack:
        node, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[1], code + "1"), (node[0], code + "0")]
        else:
            codes[node] = code
    return tree, codes


def _preorder(tree) -> tuple[list[int], bytes]:
    bits, leaves, stack = [], bytearray(), [tree]
    while stack:
        node = stack.pop()
        bits.append(0 if isinstance(node, tuple) else 1)
        if isinstance(node, tuple):
            stack += [node[1], node[0]]
        else:
            leaves.append(node)
    return bits, bytes(leaves)


def huffman_encode(data: bytes) -> bytes:
    """The Huffman body of data; empty data are four zero bytes."""
    if not data:
        return struct.pack("<I", 0)
    raw = np.frombuffer(data, np.uint8)
    values, first, n = np.unique(raw, return_index=True, return_counts=True)
    order = np.argsort(first)
    tree, codes = code_lengths(dict(zip(values[order].tolist(), n[order].tolist(), strict=True)))
    shape, leaves = _preorder(tree)
    lengths = np.zeros(256, np.int64)
    table = np.zeros((256, max(map(len, codes.values()))), np.uint8)
    for s, code in codes.items():
        lengths[s] = len(code)
        table[s, : len(code)] = np.frombuffer(code.encode(), np.uint8) - 48
    size = lengths[raw]
    at = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    bits = table[np.repeat(raw, size), within]
    packed = np.packbits(np.array(shape, np.uint8)).tobytes()
    return struct.pack("<IIII", len(data), len(shape), len(leaves), len(packed)) + packed + leaves + struct.pack("<I", len(bits)) + np.packbits(bits).tobytes()


def huffman_decode(body: bytes) -> bytes:
    try:
        (size,) = struct.unpack_from("<I", body)
        if size == 0:
            return b""
        n_shape, n_leaves, n_packed = struct.unpack_from("<III", body, 4)
        at = 16
        shape = np.unpackbits(np.frombuffer(body, np.uint8, n_packed, at), count=n_shape).tolist()
        leaves = iter(body[at + n_packed : at + n_packed + n_leaves])
        at += n_packed + n_leaves
        (n_bits,) = struct.unpack_from("<I", body, at)
        bits = np.unpackbits(np.frombuffer(body, np.uint8, -1, at + 4), count=n_bits).tolist()
        left, right, symbol = [], [], []
        pending: list[tuple[int, int]] = []
        for leaf in shape:
            i = len(symbol)
            left.append(-1)
            right.append(-1)
            symbol.append(next(leaves) if leaf else -1)
            if pending:
                parent, side = pending.pop()
                (left if side == 0 else right)[parent] = i
            if not leaf:
                pending += [(i, 1), (i, 0)]
        out, node = bytearray(), 0
        for bit in bits:
            node = right[node] if bit else left[node]
            if symbol[node] >= 0:
                out.append(symbol[node])
                node = 0
    except (struct.error, ValueError, IndexError, StopIteration) as e:
        raise CodecError(f"malformed Huffman body: {e}") from e
    if len(out) != size:
        raise CodecError("decoded length differs from the header")
    return bytes(out)


def encode_payload(records: bytes, raw_bytes: int, target_cr: float | None) -> tuple[bytes, dict]:
    """The payload of tile records and how it came to be: raw where they meet the target or Huffman doesn't shorten them."""
    structural = raw_bytes / max(len(records), 1)
    body, used, reason = records, False, "target met without entropy coding"
    if target_cr is None or structural < target_cr:
        packed = huffman_encode(records)
        used = len(packed) < len(records)
        body, reason = (packed, "entropy coding shortened the records") if used else (records, "entropy coding did not shorten the records")
    payload = MAGIC + bytes((used,)) + body
    return payload, {"huffman_used": used, "structural_cr": structural, "final_cr": raw_bytes / max(len(payload), 1), "reason": reason}


def decode_payload(payload: bytes) -> np.ndarray:
    """The tile records of a payload."""
    if payload[: len(MAGIC)] != MAGIC or len(payload) < HEADER:
        raise CodecError("no payload header")
    if payload[len(MAGIC)] not in (0, 1):
        raise CodecError(f"unknown payload flag {payload[len(MAGIC)]}")
    return deserialize_tiles(huffman_decode(payload[HEADER:]) if payload[len(MAGIC)] else payload[HEADER:])
