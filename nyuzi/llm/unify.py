"""Text that looks the same brought to one form: DuckDB inside the Arrow partitions of the scan.

``nfc_normalize``, ``translate``, regular expressions and a table of forms in one embedded SQL statement map compatibility forms (full-width and
half-width, mathematical, ligatures, enclosed and squared, presentation forms: all that Unicode decomposes but for ``KEPT_KINDS``, ``KEPT_SIGNS`` and
``KEPT_RANGES``), digits of any script, unusual spaces, invisible characters, apostrophe look-alikes and letters of another script inside
Latin words. Whole words in another script, curly or angle double quotes, dashes and signs stay.

Defined results: null gives null and counts as clean; an empty text stays empty; text already in that form is returned
unchanged; a word of nothing but look-alikes counts as Latin; every row is judged on its own, so ties and repeated rows are judged alike; only the key and text columns are
read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nyuzi.llm.textnorm import APOSTROPHES, CROSS_SCRIPT, HYPHENS, LATIN_AS_ASCII

#: Kinds of Unicode decomposition that change how a character looks; all others give another way of writing the same shape.
KEPT_KINDS = ("<super>", "<sub>", "<fraction>", "<noBreak>")
#: Signs that stay although they have a compatibility form.
KEPT_SIGNS = "℃℉№℗℠™℡℻℀℁℅℆…‥․‼⁇⁈⁉″‴⁗‗µ"
#: Letters of living scripts whose compatibility form is no other way to write them: Greek symbols, Armenian, Arabic, Thai to Tibetan, Hangul letters.
KEPT_RANGES = ((0x370, 0x3FF), (0x587, 0x587), (0x675, 0x678), (0xE00, 0xFFF), (0x3131, 0x318E))
INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}]"
SPACES = "[\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"


def compatibility_forms() -> dict[str, str]:
    """Every character that Unicode decomposes into another way to write it, and every digit of any script, with what is written instead."""
    out = {"\u2044": "/"}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.digit(c))
            continue
        kind, *to = unicodedata.decomposition(c).split()[:2] or [""]
        if not kind.startswith("<") or kind in KEPT_KINDS or c in KEPT_SIGNS or any(low <= code <= high for low, high in KEPT_RANGES):
            continue
        form = chr(int(to[0], 16)) if kind == "<narrow>" else unicodedata.normalize("NFKC", c)
        if not form.startswith(" "):  # accents that stand alone, and spaces, which have their own rule
            out[c] = form
    return out


def _ranges(chars: list[str]) -> str:
    """A class of characters for a regular expression."""
    out, codes = [], sorted(map(ord, chars))
    first = last = codes[0]
    for code in [*codes[1:], -1]:
        if code == last + 1:
            last = code
            continue
        out.append(f"\\x{{{first:X}}}-\\x{{{last:X}}}")
        first = last = code
    return "[" + "".join(out) + "]"


#: Bytes of text given to one statement, so that long texts do not meet in one vector.
SLICE_BYTES = 4 << 20
def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(forms: dict[str, str]) -> str:
    single = {c: "'" for c in APOSTROPHES} | {c: "-" for c in HYPHENS} | LATIN_AS_ASCII
    t = f"regexp_replace(regexp_replace(t, {_quote(INVISIBLE)}, '', 'g'), {_quote(SPACES)}, ' ', 'g')"
    t = f"translate({t}, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    cross = f"translate(w, {_quote(''.join(CROSS_SCRIPT))}, {_quote(''.join(CROSS_SCRIPT.values()))})"
    other = "[\\p{Greek}\\p{Cyrillic}\\p{Armenian}\\p{Cherokee}]"
    # a run of letters, accents and apostrophes is a word; what lies between is kept as it is
    alike = f"regexp_full_match(w, '[{''.join(CROSS_SCRIPT)}\\p{{M}}'']+')"  # no letter tells such a word from a Latin one
    word = f"CASE WHEN regexp_matches(w, '{other}') AND (regexp_matches(w, '\\p{{Latin}}') OR {alike}) THEN {cross} ELSE w END"
    mixed = f"array_to_string(list_transform(regexp_extract_all(u, '[\\p{{L}}\\p{{M}}'']+|[^\\p{{L}}\\p{{M}}'']+'), lambda w: {word}), '')"
    # few texts hold compatibility forms; only those are taken apart and joined with the table of forms
    return (
        f"WITH o AS (SELECT i, regexp_extract_all(t, '(?s).') AS cs FROM batch WHERE regexp_matches(t, '{_ranges(list(forms))}')), "
        "p AS (SELECT i, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM o), "
        "q AS (SELECT i, string_agg(coalesce(form, p.c), '' ORDER BY k) AS t FROM p LEFT JOIN forms ON forms.c = p.c GROUP BY i), "
        "s AS (SELECT batch.i, batch.t AS was, coalesce(q.t, batch.t) AS t FROM batch LEFT JOIN q ON q.i = batch.i), "
        f"a AS (SELECT i, was, {t} AS u FROM s), "
        f"b AS (SELECT i, was, CASE WHEN regexp_matches(u, '{other}') THEN {mixed} ELSE u END AS u FROM a) "
        "SELECT was AS t, nfc_normalize(u) AS u, nfc_normalize(u) IS DISTINCT FROM was AS changed FROM b ORDER BY i"
    )


FORMS = compatibility_forms()
SQL = _sql(FORMS)


def unify(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, clean_text, changed`` for each row: no shuffle, one pass over the scan's Arrow batches."""
    source = df.select(*keys, text)
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField("clean_text", T.StringType()), T.StructField("changed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})  # nothing is written beside the task
        con.register("forms", pa.table({"c": list(FORMS), "form": list(FORMS.values())}))
        con.execute("SET preserve_insertion_order = true")
        for b in batches:
            n = b.num_rows
            texts = b.column(b.schema.get_field_index(text)).cast(pa.string())
            plain = pc.fill_null(pc.string_is_ascii(texts), True)
            odd = pc.indices_nonzero(pc.invert(plain)).cast(pa.int64())
            clean, changed = texts, pa.array([False] * n)
            if len(odd):
                size = np.cumsum(pc.binary_length(texts.take(odd)).to_numpy(zero_copy_only=False))
                parts = []
                for part in np.split(np.arange(len(odd)), np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1):
                    at = odd.take(pa.array(part))
                    con.register("batch", pa.table({"i": at, "t": texts.take(at)}))
                    parts.append(con.sql(SQL).to_arrow_table())
                    con.unregister("batch")
                got, mask = pa.concat_tables(parts).combine_chunks(), pc.invert(plain)
                clean = pc.replace_with_mask(texts, mask, pa.concat_arrays(got["u"].chunks).cast(pa.string()))
                changed = pc.replace_with_mask(changed, mask, pa.concat_arrays(got["changed"].chunks))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), clean, changed], names=[*keys, "clean_text", "changed"])

    return source.mapInArrow(run, schema)
