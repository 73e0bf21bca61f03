"""CRC-32 as a DuckDB expression, for the SQL twins."""

# The standard reflected polynomial, a fixed value; the 256-entry table follows from it.
POLYNOMIAL = 0xEDB88320

TABLE_SQL = f"""
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}) ELSE c // 2 END, i)) AS t"""


def crc32_sql(text: str, table: str = "t") -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``table`` is a column holding ``TABLE_SQL``'s list."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"xor(list_reduce(range(octet_length(encode({text}))::BIGINT), lambda c, k: xor(c // 256, {table}[(xor(c, {byte}) % 256 + 1)::INT]), 4294967295::BIGINT), 4294967295)"
