"""SQL that several operators' DuckDB statements share."""

from __future__ import annotations

#: The table of the usual CRC-32, made from its polynomial: one row with 256 values.
CRC_TABLE = """WITH RECURSIVE crc_step(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_step WHERE k < 8),
crc(l) AS MATERIALIZED (SELECT list(c ORDER BY b) FROM crc_step WHERE k = 8)"""


def crc32(octets: str) -> str:
    """The unsigned CRC-32 of ``octets``, a list of BIGINT; the table ``crc`` must be in the FROM clause."""
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda h, o: xor(h // 256, l[xor(h % 256, o) + 1])), 4294967295)"
