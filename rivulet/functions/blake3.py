"""BLAKE3 of a byte string, by its published specification: chunks of 1,024 bytes, hashed block by block, under a binary tree."""

from __future__ import annotations

from struct import pack, unpack

#: The initial state, the order of a round's words in the next one, the flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, ROUNDS, MASK = 1024, 64, 7, 0xFFFFFFFF
#: The state's words that a round mixes, columns first and diagonals then.
QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def compress(chain: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> tuple[int, ...]:
    """The next eight chaining words."""
    words = unpack("<16I", block.ljust(BLOCK, b"\0"))
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, size, flags]
    for _ in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(QUARTERS):
            for word, first, second in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> first | x << (32 - first)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> second | x << (32 - second)) & MASK
        words = tuple(words[i] for i in ORDER)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def node(data: bytes, first: int, flags: int) -> tuple[int, ...]:
    """Chaining words of the subtree over data, whose first chunk has the number `first`."""
    if len(data) <= CHUNK:
        chain, blocks = IV, [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)] or [b""]
        for k, block in enumerate(blocks):
            own = (CHUNK_START if k == 0 else 0) | (CHUNK_END | flags if k == len(blocks) - 1 else 0)
            chain = compress(chain, block, first, len(block), own)
        return chain
    left = CHUNK << ((len(data) - 1) // CHUNK).bit_length() - 1  # the most whole chunks that are a power of two and leave some
    pair = node(data[:left], first, 0) + node(data[left:], first + left // CHUNK, 0)
    return compress(IV, pack("<16I", *pair), 0, BLOCK, PARENT | flags)


def blake3(data: bytes) -> bytes:
    """32 bytes."""
    return pack("<8I", *node(data, 0, ROOT))
