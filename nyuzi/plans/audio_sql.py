"""SQL that reads WAV and FLAC headers, for checking the audio queries."""

from __future__ import annotations

from nyuzi.functions.wav import OPEN_SIZES


def _number(h: str, at: str, size: int) -> str:
    """A little-endian number of ``size`` bytes from hexadecimal digits."""
    return "TRY_CAST('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + " AS BIGINT)"


def headers(table: str, blob: str, carry: str) -> str:
    """The head of a statement that defines ``wavs``: ``carry``, ``is_wav, ok, rate, frames, n16`` (samples at 16 kHz) and ``error`` of each row."""
    text = "translate(regexp_replace(TRY(decode(b)), '\\s', '', 'g'), '-_', '+/')"
    bare = f"rtrim(CASE WHEN starts_with({text}, 'data:') THEN split_part({text}, ',', 2) ELSE {text} END, '=')"
    return f"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS k, {blob} AS b, {carry} FROM {table}),
t AS (SELECT *, CASE WHEN b IS NULL OR octet_length(b) = 0 OR substr(hex(b), 1, 8) IN ('52494646', '52494658', '52463634', '664C6143', '4F676753') THEN NULL ELSE {bare} END AS s FROM p),
r AS (SELECT * EXCLUDE (s), hex(coalesce(TRY(from_base64(rpad(left(s, len(s) - (len(s) % 4 = 1)::INT), ((len(s) - (len(s) % 4 = 1)::INT + 3) // 4 * 4)::INT, '='))), b)) AS h FROM t),
w AS (
  SELECT k, h, len(h) // 2 AS n, 12::BIGINT AS pos, NULL::BIGINT AS rate, NULL::BIGINT AS width, NULL::BIGINT AS frames,
    NOT (len(h) >= 24 AND substr(h, 1, 8) IN ('52494646', '52463634') AND substr(h, 17, 8) = '57415645') AS over FROM r WHERE h IS NOT NULL
  UNION ALL
  SELECT k, h, n, pos + 8 + size + size % 2, CASE WHEN id = '666D7420' THEN {_number('h', 'pos + 12', 4)} ELSE rate END,
    CASE WHEN id = '666D7420' THEN bits * channels // 8 ELSE width END,
    CASE WHEN id = '64617461' AND width IS NOT NULL THEN least(CASE WHEN size IN {OPEN_SIZES} THEN n - pos - 8 ELSE size END, n - pos - 8) // width END,
    id = '64617461' OR (id = '666D7420' AND NOT (size >= 16 AND pos + 24 <= n AND channels > 0 AND (kind = 1 AND bits IN (8, 16, 24, 32) OR kind = 3 AND bits IN (32, 64))))
  FROM (SELECT *, CASE WHEN tag = 65534 AND size >= 26 AND pos + 34 <= n THEN {_number('h', 'pos + 32', 2)} ELSE tag END AS kind FROM (
    SELECT *, substr(h, 2 * pos + 1, 8) AS id, {_number('h', 'pos + 4', 4)} AS size, CASE WHEN pos + 24 <= n THEN {_number('h', 'pos + 8', 2)} END AS tag,
      CASE WHEN pos + 24 <= n THEN {_number('h', 'pos + 10', 2)} END AS channels, CASE WHEN pos + 24 <= n THEN {_number('h', 'pos + 22', 2)} END AS bits
    FROM w WHERE NOT over AND pos + 8 <= n))),
f AS (SELECT k, rate, frames FROM w WHERE over AND frames IS NOT NULL),
g AS (SELECT r.*, f.rate AS r0, f.frames AS f0, substr(h, 1, 8) = '664C6143' AND len(h) >= 52 AS is_flac FROM r LEFT JOIN f USING (k)),
wavs AS (SELECT * EXCLUDE (k, b, h, r0, f0, is_flac), f0 IS NOT NULL AS is_wav, f0 IS NOT NULL OR coalesce(is_flac, false) AS ok,
  CASE WHEN f0 IS NOT NULL THEN r0 WHEN is_flac THEN ('0x' || substr(h, 37, 5))::BIGINT END AS rate,
  CASE WHEN f0 IS NOT NULL THEN f0 WHEN is_flac THEN ('0x' || substr(h, 44, 9))::BIGINT END AS frames,
  CASE WHEN f0 = 0 OR r0 = 16000 THEN f0 ELSE round_even(f0 * 16000 / r0, 0)::BIGINT END AS n16,
  CASE WHEN f0 IS NOT NULL OR is_flac THEN NULL WHEN b IS NULL OR octet_length(b) = 0 THEN 'empty' ELSE 'unreadable' END AS error FROM g)
"""
