"""CRC-32 as an expression of DuckDB, which has no function for it."""

from __future__ import annotations


def _table() -> list[int]:
    """The reflected table of the polynomial 0xEDB88320."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a non-empty text expression."""
    table = f"[{', '.join(map(str, _table()))}]::UINTEGER[]"
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::UINTEGER)"
    step = f"lambda a, y: xor(a >> 8, ({table})[(xor(a, y) & 255)::INT + 1])"
    return f"xor(list_reduce({codes}, {step}, 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT"
