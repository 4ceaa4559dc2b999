"""Column-level data quality profile, load by load.

Every column is unpivoted to (load, column, value) once; values are counted before anything else, so a value or load
that a third of all rows share costs one row after the map side. Regular expressions are induced by minimum
description length over all distinct values of a column, whatever their length, on a tree of shapes (exact runs, runs of any length, any
order of the same symbols, anything), with nothing but aggregations; what comes to the driver is the few expressions that cover a tenth of a column's rows each.

Defined results: null, blank and stand-in values ("n/a", "-") count as missing; a load of null is a load of its own; a column without
values has no expression and no issues but missing; a tie for the most frequent value goes to the greater value; repeated rows count
each time; an empty table gives an empty profile; a binary counts by the digest of all its bytes and its length is that in octets, while its
least and greatest values and its expressions show the first four bytes in hexadecimal; a struct that holds binaries is profiled field by field,
any other as one JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.session import cut

# Words that stand for "no value", in lower case; signs alone stand for it too.
STAND_INS = ("null", "none", "nan", "n/a", "#n/a", "<na>", "n.a.", "tbd", "unknown", "undefined", "missing", "not available", "no value", "\\n")
#: An expression counts for a column when at least this share of its rows with a value conform to it; so there are at most ten.
MAIN_SHARE = 0.1
#: Longest value that is kept as it is; longer ones stand for by their beginning and digest, with the form of the whole beside it.
VALUE_LENGTH = 256


def is_missing(value: Column) -> Column:
    """Null, blank, or a word or sign standing for "no value"."""
    bare = F.lower(F.regexp_replace(value, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    return value.isNull() | ~bare.rlike(r"[\p{L}\p{N}]") | bare.isin(*STAND_INS)


def _holds_binary(kind: T.DataType) -> bool:
    return isinstance(kind, T.BinaryType) or (isinstance(kind, T.StructType) and any(_holds_binary(f.dataType) for f in kind.fields))


def leaves(name: str, kind: T.DataType, at: Column | None = None) -> list[tuple[str, Column, T.DataType]]:
    """What a column is profiled as, ``name, column, type``: itself, or each field of a struct that holds binaries, as ``column.field``."""
    at = F.col(f"`{name}`") if at is None else at
    if isinstance(kind, T.StructType) and _holds_binary(kind):
        return [leaf for f in kind.fields for leaf in leaves(f"{name}.{f.name}", f.dataType, at.getField(f.name))]
    return [(name, at, kind)]


def profiled_names(df: DataFrame, columns: list[str]) -> list[str]:
    """The names under which ``columns`` are profiled."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [name for c in columns for name, _, _ in leaves(c, kinds[c])]


def as_value(at: Column, kind: T.DataType) -> Column:
    """``value, length, digest``: the text that is profiled and its code points; of a binary its first four bytes, its octets and the digest of all."""
    if isinstance(kind, T.BinaryType):
        return F.struct(F.hex(F.substring(at, 1, 4)).alias("value"), F.octet_length(at).alias("length"), F.md5(at).alias("digest"))
    text = F.to_json(at) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else at.cast("string")
    return F.struct(text.alias("value"), F.char_length(text).alias("length"), F.lit(None).cast("string").alias("digest"))


def value_counts(df: DataFrame, load: str, columns: list[str], group: str | None = None) -> DataFrame:
    """``load_id, grp, column_name, value, digest, form, missing, length, n``: every different value of every column in every load.

    Values over ``VALUE_LENGTH`` code points stand for by their beginning and the digest of the whole; ``form`` is what a value of the shape of the
    whole (null where the value is whole). Missing, form and length are taken from the whole value. Binaries are told
    apart by the digest of all their bytes.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(name).alias("column_name"), as_value(at, kind).alias("v")) for c in columns for name, at, kind in leaves(c, kinds[c])])
    flat = df.select(F.col(f"`{load}`").cast("string").alias("load_id"), (F.col(f"`{group}`").cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.explode(pairs).alias("p"))
    v = F.col("p.v.value")
    short = F.when(F.char_length(v) <= VALUE_LENGTH, v).otherwise(F.concat(F.substring(v, 1, VALUE_LENGTH), F.lit(" #"), F.md5(v)))
    named = flat.select("load_id", "grp", F.col("p.column_name").alias("column_name"), short.alias("value"), F.col("p.v.digest").alias("digest"), F.when(F.char_length(v) > VALUE_LENGTH, _form(v)).alias("form"), is_missing(v).alias("missing"), F.col("p.v.length").alias("length"))
    return named.groupBy("load_id", "grp", "column_name", "value", "digest").agg(F.max("form").alias("form"), F.max("missing").alias("missing"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n"))


def _form(value: Column) -> Column:
    """The plainest value of the same shape: every upper and lower case letter, other letter and digit as ``A``, ``a``, ``\u00e9`` and ``9``."""
    s = F.regexp_replace(value, r"[0-9]", "9")
    s = F.regexp_replace(s, r"[A-Z]", "A")
    s = F.regexp_replace(s, r"[a-z]", "a")
    return F.regexp_replace(s, r"[^\x00-\x7f]", "\u00e9")


def _shape(form: Column) -> Column:
    """The shape of a form: other letters as ``L``."""
    return F.regexp_replace(form, "\u00e9", "L")


def induce_expressions(counts: DataFrame) -> DataFrame:
    """``column_name, family, shape, open, mixed, n_values, n_rows, share, bits`` of the expressions that describe each column in the fewest bits.

    ``counts``: distinct ``column_name, value, digest, form, length, n`` without missing values. A value costs the bits of its symbols within
    its class; an exact shape costs its own text once, a shape of open runs also the length of each run in each value, a mixed shape (one
    repeated group of the symbols of a value, in any order, by which long texts share a shape) which symbol comes next; values that no shape
    pays for are left to ``.*`` at eight bits a character.
    """
    form = F.coalesce("form", _form(F.col("value")))
    values = counts.select("column_name", "value", "digest", "n", form.alias("form")).groupBy("column_name", "value", "digest").agg(F.sum("n").alias("n"), F.max("form").alias("form"))
    v = values.withColumn("s0", _shape(F.col("form"))).withColumn("len", F.char_length("s0"))  # of a binary its first bytes have a form
    v = v.withColumn("s1", F.regexp_replace("s0", r"([Aa9L])\1*", "$1+")).withColumn("s2", F.array_join(F.array_sort(F.array_distinct(F.split("s0", ""))), ""))
    count_of = lambda c: F.char_length("s0") - F.char_length(F.regexp_replace("s0", c, ""))
    symbol_bits = count_of("9") * 3.3219 + count_of("[Aa]") * 4.7004 + count_of("L") * 8.0
    runs = F.char_length("s1") - F.char_length(F.regexp_replace("s1", r"\+", ""))
    run_bits = runs * (1 + 2 * F.log2(1 + F.col("len") / F.greatest(F.lit(1), runs)))
    length_bits = 2 * F.log2(F.col("len") + 1.0) + 1
    mixed_bits = F.col("len") * F.log2(F.greatest(F.lit(1), F.char_length("s2"))) + length_bits
    any_bits = F.col("len") * 8.0 + length_bits
    v = v.select("column_name", "n", "s0", "s1", "s2", symbol_bits.alias("b0"), (symbol_bits + run_bits).alias("b1"), (symbol_bits + mixed_bits).alias("bm"), any_bits.alias("b2"))
    leaf = v.groupBy("column_name", "s2", "s1", "s0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("b0").alias("b0"), F.sum("b1").alias("b1"), F.sum("bm").alias("bm"), F.sum("b2").alias("b2")
    )
    # a leaf pays for its own text, or leaves its values to ".*"; the leaves are read three times below
    leaf = cut(leaf).withColumn("own0", F.col("b0") + F.char_length("s0") * 8.0).withColumn("best0", F.least("own0", "b2"))
    node = leaf.groupBy("column_name", "s2", "s1").agg(
        F.sum("best0").alias("children"), (F.sum("b1") + F.char_length(F.first("s1")) * 8.0).alias("own1"), F.sum("bm").alias("bm"), F.sum("k").alias("k1"), F.sum("n").alias("n1")
    )
    node = cut(node.withColumn("open", F.col("own1") < F.col("children")))
    top = node.groupBy("column_name", "s2").agg(
        F.sum(F.least("own1", "children")).alias("children"), (F.sum("bm") + F.char_length(F.first("s2")) * 8.0).alias("own2"), F.sum("k1").alias("k2"), F.sum("n1").alias("n2")
    )
    top = cut(top.withColumn("mixed", F.col("own2") < F.col("children")))
    chosen_mixed = top.where("mixed").select("column_name", F.col("s2").alias("family"), F.col("s2").alias("shape"), F.lit(True).alias("open"), F.lit(True).alias("mixed"), F.col("k2").alias("n_values"), F.col("n2").alias("n_rows"), F.col("own2").alias("bits"))
    node = node.join(top.where("NOT mixed").select("column_name", "s2"), ["column_name", "s2"])
    chosen_open = node.where("open").select("column_name", F.col("s1").alias("family"), F.col("s1").alias("shape"), F.lit(True).alias("open"), F.lit(False).alias("mixed"), F.col("k1").alias("n_values"), F.col("n1").alias("n_rows"), F.col("own1").alias("bits"))
    closed = leaf.alias("l").join(node.where(~F.col("open")).select("column_name", "s1").alias("m"), (F.col("l.column_name") == F.col("m.column_name")) & (F.col("l.s1") == F.col("m.s1")))
    chosen_closed = closed.where(F.col("l.own0") < F.col("l.b2")).select("l.column_name", F.col("l.s1").alias("family"), F.col("l.s0").alias("shape"), F.lit(False).alias("open"), F.lit(False).alias("mixed"), F.col("l.k").alias("n_values"), F.col("l.n").alias("n_rows"), F.col("l.own0").alias("bits"))
    chosen = chosen_mixed.unionByName(chosen_open).unionByName(chosen_closed)
    total = leaf.groupBy("column_name").agg(F.sum("n").alias("all"))
    return chosen.join(F.broadcast(total), "column_name").select("column_name", "family", "shape", "open", "mixed", "n_values", "n_rows", (F.col("n_rows") / F.col("all")).alias("share"), "bits")  # a row a column


_CLASS = {"A": "[A-Z]", "a": "[a-z]", "9": "[0-9]", "L": "[^\\x00-\\x7f]"}


def shape_regex(shape: str, open_runs: bool) -> str:
    """The regular expression of a shape: ``AAA-999`` is ``[A-Z]{3}-[0-9]{3}``, with open runs ``A+-9+`` is ``[A-Z]+-[0-9]+``."""
    out, i = [], 0
    while i < len(shape):
        c = shape[i]
        if c in _CLASS:
            if open_runs:
                out.append(_CLASS[c] + "+")
                i += 2
                continue
            j = i
            while j < len(shape) and shape[j] == c:
                j += 1
            out.append(_CLASS[c] + ("{%d}" % (j - i) if j - i > 1 else ""))
            i = j
        else:
            out.append("\\" + c if c in "\\.^$|?*+()[]{}-/" and c not in "-/" else c)
            i += 1
    return "".join(out)


def mixed_regex(symbols: str) -> str:
    """The regular expression of a mixed shape: `` ,Aa`` is ``[ ,A-Za-z]+``."""
    ranges = {"A": "A-Z", "a": "a-z", "9": "0-9", "L": "\\x80-\U0010ffff"}
    return "[" + "".join(ranges.get(c, "\\" + c if c in "\\[]^-&~|#" else c) for c in symbols) + "]+"


def main_expressions(counts: DataFrame, share: float = MAIN_SHARE, mixed: bool = False) -> dict[str, list[str]]:
    """The main regular expressions of each column, most rows first.

    An expression counts by its own share of the rows; exact shapes too rare for that count together as the open form of their family. So at
    most ``1 / share`` a column reach the driver. With ``mixed``, the mixed shapes that running text is left with count together as one
    expression, of the symbols that stand in ``share`` of the column's rows each; what holds a rarer symbol is not covered by it.
    """
    found = cut(induce_expressions(counts))
    own = found.where((F.col("share") >= share) & ~F.col("mixed")).select("column_name", "shape", "open", "mixed", "n_rows")
    rare = found.where(~F.col("open") & (F.col("share") < share)).groupBy("column_name", "family").agg(F.sum("share").alias("s"), F.sum("n_rows").alias("n_rows"))
    families = rare.where(F.col("s") >= share).select("column_name", F.col("family").alias("shape"), F.lit(True).alias("open"), F.lit(False).alias("mixed"), "n_rows")
    main = own.unionByName(families)
    if mixed:
        texts = found.where("mixed").select("column_name", F.split("shape", "").alias("symbols"), "share", "n_rows")
        common = texts.select("column_name", F.explode("symbols").alias("c"), "share").groupBy("column_name", "c").agg(F.sum("share").alias("s")).where(F.col("s") >= share)
        common = common.groupBy("column_name").agg(F.array_sort(F.collect_set("c")).alias("common"))
        met = texts.join(F.broadcast(common), "column_name").where(F.size(F.array_except("symbols", "common")) == 0)  # a row a column
        met = met.groupBy("column_name", "common").agg(F.sum("share").alias("s"), F.sum("n_rows").alias("n_rows")).where(F.col("s") >= share)
        main = main.unionByName(met.select("column_name", F.array_join("common", "").alias("shape"), F.lit(True).alias("open"), F.lit(True).alias("mixed"), "n_rows"))
    rows = main.orderBy("column_name", F.desc("n_rows"), "shape").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["column_name"], []).append(mixed_regex(r["shape"]) if r["mixed"] else shape_regex(r["shape"], r["open"]))
    return out


def profile_counts(counts: DataFrame, expressions: dict[str, list[str]]) -> DataFrame:
    """One row a load and column from its value counts; values that no expression of their column covers are nonconforming."""
    conforms = F.lit(False)
    for column, regexes in expressions.items():
        conforms = F.when(F.col("column_name") == column, F.coalesce("form", "value").rlike("^(?:" + "|".join(regexes) + ")$")).otherwise(conforms)
    n, here = F.col("n"), ~F.col("missing")
    length = F.col("length")
    return (
        counts.withColumn("bad", here & ~conforms)
        .groupBy("load_id", "grp", "column_name")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("n_null"),
            F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("n_missing"),
            F.sum(F.when(here, n).otherwise(0)).alias("n_values"),
            F.count(F.when(here, 1)).alias("n_distinct"),
            F.min(F.when(here, F.col("value"))).alias("least"),
            F.max(F.when(here, F.col("value"))).alias("greatest"),
            F.sum(F.when(F.col("bad"), n).otherwise(0)).alias("n_nonconforming"),
            F.max(F.when(here, F.struct("n", "value", "digest"))).alias("top"),
            (F.sum(F.when(here, n * length)) / F.sum(F.when(here, n))).alias("mean_length"),
        )
        .select("load_id", "grp", "column_name", "n_rows", "n_null", "n_missing", "n_values", "n_distinct", "least", "greatest", "n_nonconforming", F.when(F.col("top").isNotNull(), F.concat_ws(" #", "top.value", "top.digest")).alias("top_value"), F.coalesce(F.col("top.n"), F.lit(0)).alias("top_n"), "mean_length")
    )


def _compared(rows: DataFrame, keys: list[str], share: str, out: str) -> DataFrame:
    """``out``: a share less that of the load before of the same group, in the order of the loads' first times; null for the first."""
    before = Window.partitionBy("grp", *keys).orderBy(F.col("first_at").asc_nulls_first(), F.col("load_id").asc_nulls_first())  # a row a load
    return rows.withColumn(out, F.col(share) - F.lag(share).over(before))


def _with_order(rows: DataFrame, df: DataFrame, load: str, order: str | None) -> DataFrame:
    """``first_at``: when each load first arrived; without an ``order`` column loads follow each other by name."""
    if order is None:
        return rows.withColumn("first_at", F.lit(None).cast("string"))
    when = df.groupBy(F.col(f"`{load}`").cast("string").alias("load_id")).agg(F.min(F.col(f"`{order}`")).cast("string").alias("first_at"))
    return rows.alias("l").join(when.alias("w"), F.col("l.load_id").eqNullSafe(F.col("w.load_id")), "left").select("l.*", "first_at")


def profile(df: DataFrame, load: str, columns: list[str] | None = None, group: str | None = None, order: str | None = None) -> DataFrame:
    """The profile of every column in every load, by load and column, with each load's departure from the loads of its group.

    ``length_ratio`` is a load's mean value length over the median of its group's loads; ``conforming_change`` its conforming share less
    the median of its group's, ``conforming_step`` less that of the load before it in the order of the column ``order``.
    """
    columns = columns or [c for c in df.columns if c != load]
    counts = cut(value_counts(df, load, columns, group))
    expressions = main_expressions(counts.where(~F.col("missing")), mixed=True)
    share = F.when(F.col("n_values") > 0, 1 - F.col("n_nonconforming") / F.col("n_values"))
    rows = cut(profile_counts(counts, expressions).withColumn("ok", share))
    medians = rows.groupBy("grp", "column_name").agg(F.median("mean_length").alias("mid_length"), F.median("ok").alias("mid_ok"))
    named = F.create_map(*[x for c in profiled_names(df, columns) for x in (F.lit(c), F.lit("|".join(expressions[c])) if c in expressions else F.lit(None).cast("string"))])
    stepped = _compared(_with_order(rows, df, load, order), ["column_name"], "ok", "conforming_step")
    out = stepped.alias("r").join(medians.alias("m"), F.col("r.grp").eqNullSafe(F.col("m.grp")) & (F.col("r.column_name") == F.col("m.column_name")), "left")
    return out.select("r.*", named[F.col("r.column_name")].alias("expression"), (F.col("mean_length") / F.col("mid_length")).alias("length_ratio"), (F.col("ok") - F.col("mid_ok")).alias("conforming_change")).drop("ok", "first_at").orderBy("load_id", "column_name")


def coverage(df: DataFrame, load: str, columns: list[str] | None = None, group: str | None = None, order: str | None = None) -> DataFrame:
    """``load_id, grp, column_name, expression, n_rows, share, step``: rows with a value that each expression of a column covers in each load.

    A value counts for the first expression of its column that covers it, a null ``expression`` for none. ``step`` is the share less that in the load before
    of the same group, so a form that comes or goes shows in the load where it does; an expression that covers nothing in a load has a row of 0.
    """
    columns = columns or [c for c in df.columns if c != load]
    counts = cut(value_counts(df, load, columns, group))
    expressions = main_expressions(counts.where(~F.col("missing")), mixed=True)
    of = F.lit(None).cast("string")
    for column, regexes in expressions.items():
        for r in reversed(regexes):
            of = F.when((F.col("column_name") == column) & F.coalesce("form", "value").rlike(f"^(?:{r})$"), F.lit(r)).otherwise(of)
    met = counts.where(~F.col("missing")).groupBy("load_id", "grp", "column_name", of.alias("expression")).agg(F.sum("n").alias("n_rows"))
    # at most 1 / MAIN_SHARE expressions a column and one for the rest
    known = df.sparkSession.createDataFrame([(c, r) for c in profiled_names(df, columns) for r in [*expressions.get(c, []), None]], "column_name string, expression string")
    loads = cut(met.groupBy("load_id", "grp", "column_name").agg(F.sum("n_rows").alias("all")))
    grid = loads.join(F.broadcast(known), "column_name").alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("load_id", "grp", "column_name", "expression")]
    rows = grid.join(met.alias("b"), same, "left").select("a.load_id", "a.grp", "a.column_name", "a.expression", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) / F.col("all")).alias("share"))
    return _compared(_with_order(rows, df, load, order), ["column_name", "expression"], "share", "step").drop("first_at")


def load_issues(profiled: DataFrame, identifier: str, text: str, share: float = 0.25, least_values: int = 20, factor: float = 2.0) -> DataFrame:
    """``load_id, column_name, issue`` of loads unlike the others.

    ``missing``: a share of the rows of either column; ``malformed``: a share of the identifier's values do not conform to the column's expressions;
    ``repeated``: one value makes up a share of the text's values; ``shifted``: the mean length of the text lies beyond a factor of the
    median of its group's loads. All but ``missing`` need ``least_values`` values.
    """
    p = profiled.where(F.col("column_name").isin(identifier, text))
    enough = F.col("n_values") >= least_values
    is_text = F.col("column_name") == text
    issues = F.array_compact(
        F.array(
            F.when(F.col("n_missing") >= share * F.col("n_rows"), F.lit("missing")),
            F.when(enough & ~is_text & (F.col("n_nonconforming") >= share * F.col("n_values")), F.lit("malformed")),
            F.when(enough & is_text & (F.col("top_n") >= share * F.col("n_values")), F.lit("repeated")),
            F.when(enough & is_text & ((F.col("length_ratio") < 1 / factor) | (F.col("length_ratio") > factor)), F.lit("shifted")),
        )
    )
    return p.select("load_id", "column_name", F.explode(issues).alias("issue"))
