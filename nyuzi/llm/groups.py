"""Train, validation and test splits in which no speaker and no sentence is found on two sides.

Speakers who share a sentence are tied; components of tied speakers come from pointer jumping
(:func:`nyuzi.llm.components.connected_components`) over star links, one link per speaker and sentence, never all pairs.
The component table of speakers and sentences is persisted, a version a delivery (:func:`deliver`): on the next delivery its rows enter as
links, so a component keeps its split, new components fill what the splits lack, and a component that joins members of different splits is
quarantined.

Defined results: null and blank speakers tie nobody, their rows follow their sentence; sentences under ``min_words`` words tie
nobody (nearly everybody says "yes"), :func:`one_side` gives each of them a side instead; rows without speaker and sentence stand alone; ties in size go to the lower hash; repeated
rows are counted and placed alike; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nyuzi.llm.components import connected_components
from nyuzi.llm.prefix import buckets_for, running_sum
from nyuzi.llm.textnorm import sentence_key_udf
from nyuzi.session import cut

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def speaker_of(col) -> F.Column:
    """A speaker as compared and written: lower case without outer blanks; null if nothing is left."""
    s = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    return F.when(s != "", s)


def _said_by(utterances: DataFrame) -> DataFrame:
    """``clip_id, speaker``: every speaker of a clip once."""
    return utterances.select("clip_id", speaker_of("speaker_id").alias("speaker")).where("clip_id IS NOT NULL AND speaker IS NOT NULL").distinct()


def utterance_speakers(records: DataFrame, utterances: DataFrame) -> DataFrame:
    """``row_id, speaker, sentence, n_words`` of records with the speaker the utterances give for their clip.

    Of several speakers of one clip the alphabetically first places its records; :func:`clip_ties` ties the others to it.
    """
    who = _said_by(utterances).groupBy("clip_id").agg(F.min("speaker").alias("speaker"))
    key = records.select("row_id", "clip_id", sentence_key_udf("text").alias("key"))
    rows = key.select("row_id", "clip_id", F.when(F.col("key") != "", F.unhex(F.md5("key"))).alias("sentence"), F.when(F.col("key") != "", F.size(F.split("key", " "))).otherwise(0).alias("n_words"))
    return rows.join(who, "clip_id", "left").select("row_id", "speaker", "sentence", "n_words")


def clip_ties(records: DataFrame, utterances: DataFrame) -> DataFrame:
    """``a, b``: each further speaker of a clip that has records, with the clip's first speaker; they all say its sentence."""
    who = _said_by(utterances)
    first = who.groupBy("clip_id").agg(F.min("speaker").alias("b"), F.max("speaker").alias("last")).where("b <> last").join(records.select("clip_id"), "clip_id", "left_semi")
    return who.join(first, "clip_id").where("speaker <> b").select(F.col("speaker").alias("a"), "b")


def update_components(rows: DataFrame, prior: DataFrame | None = None, ties: DataFrame | None = None, min_words: int = 5) -> DataFrame:
    """``node, root``: the component table after a delivery; a node is a speaker (``s:``) or a sentence (``t:``), a root the least node of its component.

    ``prior`` is the table before it: its rows stand for all earlier deliveries and enter as links. Each speaker of a sentence is linked with
    the sentence's first speaker, a sentence known before also with its root; pointer jumping merges what these links join. ``ties`` are
    further speakers ``a, b`` to be linked. Sentences under ``min_words`` words link nobody and are not in the table.
    """
    return _merged(rows, prior, ties, min_words)[0]


def _merged(rows: DataFrame, prior: DataFrame | None, ties: DataFrame | None, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The table, and ``node, now``: the component that each linked node is in after the delivery."""
    spark = rows.sparkSession
    if prior is None:
        prior = spark.createDataFrame([], "node string, root string")
    said = cut(rows.select(_node("s:", F.col("speaker")).alias("s"), F.when(F.col("n_words") >= min_words, _node("t:", F.hex("sentence"))).alias("t")).distinct())
    stars = said.where("s IS NOT NULL AND t IS NOT NULL").groupBy("t").agg(F.min("s").alias("first"))
    links = said.join(stars, "t").where("s <> first").select(F.col("s").alias("a"), F.col("first").alias("b"))
    if ties is not None:
        links = links.unionByName(ties.select(_node("s:", F.col("a")).alias("a"), _node("s:", F.col("b")).alias("b")))
    links = links.unionByName(prior.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a LIKE 's:%'"))
    links = links.unionByName(stars.join(prior.select(F.col("node").alias("t"), "root"), "t").select(F.col("first").alias("a"), F.col("root").alias("b")))
    comps = connected_components(links).withColumnRenamed("root", "now")
    # sentences: with a speaker here they are in that speaker's component, else where they were, else a component of their own
    before = _now(prior.where("node LIKE 't:%'").select(F.col("node").alias("t"), F.col("root").alias("r")), comps, "r").select("t", F.col("now").alias("was"))
    heard = _now(stars.select("t", F.col("first").alias("r")), comps, "r").select("t", F.col("now").alias("via"))
    silent = said.where("t IS NOT NULL").select("t").distinct()
    sentences = silent.join(heard, "t", "left").join(before, "t", "full").select(F.col("t").alias("node"), F.coalesce("via", "was", "t").alias("root"))
    speakers = _now(said.where("s IS NOT NULL").select(F.col("s").alias("node")).union(comps.where("node LIKE 's:%'").select("node")).union(prior.where("node LIKE 's:%'").select("node")).distinct(), comps, "node")
    return cut(speakers.select("node", F.col("now").alias("root")).unionByName(sentences)), comps


def _now(df: DataFrame, comps: DataFrame, node: str) -> DataFrame:
    """``now``: the component that a node is in after all links; itself where nothing is linked to it."""
    return df.join(comps.withColumnRenamed("node", node), node, "left").withColumn("now", F.coalesce("now", node))


def tied_speakers(table: DataFrame) -> DataFrame:
    """``speaker_id, group_id`` of every speaker of a component table tied to another; ``group_id`` is the group's first speaker."""
    speakers = table.where("node LIKE 's:%'").select(F.substring("node", 3, 1 << 30).alias("speaker_id"), "root")
    several = speakers.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("speaker_id").alias("group_id")).where("n > 1")
    return speakers.join(several, "root").select("speaker_id", "group_id")


def deliver_components(deliveries: list[DataFrame], path: str, ties: DataFrame | None = None, min_words: int = 5) -> DataFrame:
    """The component table after several deliveries, written as Parquet to ``path`` in the shared folder, a version a delivery; each reads the one before."""
    spark, table = deliveries[0].sparkSession, None
    for version, rows in enumerate(deliveries):
        update_components(rows, table, None if version else ties, min_words).write.parquet(f"{path}/v{version}")
        table = spark.read.parquet(f"{path}/v{version}")
    return table


def fill(sizes: DataFrame, have: dict[str, float], splits=SPLITS, large: float = 0.01) -> DataFrame:
    """``group, split`` for new groups ``group, n``: they fill what each split lacks of its share of all rows.

    Groups of at least ``large`` of all new rows, of which there are at most 1/``large``, are placed largest first where most
    is lacking; the rest lie on one line in hash order, cut in proportion to what is still lacking.
    """
    spark = sizes.sparkSession
    new = float(sizes.agg(F.sum("n")).first()[0] or 0)
    total = new + sum(have.values())
    lack = {s: share * total - have.get(s, 0.0) for s, share in splits}
    big = sizes.where(F.col("n") >= max(1.0, large * new)).orderBy(F.desc("n"), "group").limit(int(1 / large) + 1).collect()
    placed = []
    for r in big:
        s = max(lack, key=lambda k: lack[k])
        placed.append((r["group"], s))
        lack[s] -= r["n"]
    rest = sizes.where(F.col("n") < max(1.0, large * new))
    lack = {s: max(0.0, v) for s, v in lack.items()}
    span, left = sum(lack.values()) or 1.0, float(rest.agg(F.sum("n")).first()[0] or 0)
    lined = running_sum(rest, [], F.col("group"), "n", "_at", buckets_for(rest.count())) if left else rest.withColumn("_at", F.lit(0))
    middle = F.col("_at") + F.col("n") / 2
    split, edge, bounds = F.lit(splits[-1][0]), 0.0, []
    for s, _ in splits:
        edge += lack[s] / span * left
        bounds.append((s, edge))
    for s, high in reversed(bounds[:-1]):
        split = F.when(middle < high, F.lit(s)).otherwise(split)
    out = lined.select("group", split.alias("split"))
    return out.unionByName(spark.createDataFrame(placed, "group string, split string")) if placed else out


def _node(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), col)


def place(rows: DataFrame, table: DataFrame, min_words: int = 5) -> DataFrame:
    """``row_id, group``: a row belongs to its speaker's component, else to its sentence's, else it stands alone."""
    node = F.coalesce(
        _node("s:", F.col("speaker")), F.when(F.col("n_words") >= min_words, _node("t:", F.hex("sentence"))), _node("r:", F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    )
    return rows.select("row_id", node.alias("node")).join(table.select("node", "root"), "node", "left").select("row_id", F.coalesce("root", "node").alias("group"))


def assign_splits(rows: DataFrame, prior: DataFrame | None = None, splits=SPLITS, min_words: int = 5, ties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Places every row; returns ``row_id, group, split`` and the component table to persist.

    ``prior`` is the table this returned last time: ``node, root, split``. It
    stands for all earlier deliveries, whose rows need not be here. A group whose members held different splits gets the split ``quarantine``
    until somebody decides. Rows that stand alone are in the table too, so they keep their split when they come again.
    """
    spark = rows.sparkSession
    if prior is None:
        prior = spark.createDataFrame([], "node string, root string, split string")
    merged, comps = _merged(rows, prior.select("node", "root"), ties, min_words)
    placed = cut(place(rows, merged, min_words))
    sizes = cut(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    kept = _now(prior.select(F.col("root").alias("r"), "split").distinct(), comps, "r").groupBy(F.col("now").alias("group")).agg(F.min("split").alias("low"), F.max("split").alias("high"))
    kept = cut(kept.select("group", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("quarantine").alias("split")))
    held = sizes.join(kept, "group").groupBy("split").agg(F.sum("n").alias("n")).collect()  # a row a split
    new = fill(sizes.join(kept, "group", "left_anti"), {r["split"]: float(r["n"]) for r in held if r["split"] != "quarantine"}, splits)
    chosen = cut(kept.unionByName(new))
    alone = placed.where("`group` LIKE 'r:%'").select(F.col("group").alias("node"), F.col("group").alias("root")).union(prior.where("node LIKE 'r:%'").select("node", "root")).distinct()
    table = merged.unionByName(alone).join(chosen.withColumnRenamed("group", "root"), "root").select("node", "root", "split")  # tied speakers without rows have no split yet
    return placed.join(chosen, "group").select("row_id", "group", "split"), table


def deliver(deliveries: list[DataFrame], path: str, splits=SPLITS, min_words: int = 5, ties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Several deliveries placed one after the other, the table of each written as Parquet to ``path`` (a version a delivery) and read by the next.

    Returns ``row_id, group, split`` of the rows of all deliveries by the last table, and that table: a group that a later delivery
    joined with one of another split is in quarantine with its earlier rows too.
    """
    spark, table, everything = deliveries[0].sparkSession, None, None
    for version, rows in enumerate(deliveries):
        assign_splits(rows, table, splits, min_words, None if version else ties)[1].write.parquet(f"{path}/v{version}")
        table = spark.read.parquet(f"{path}/v{version}")
        everything = rows if everything is None else everything.unionByName(rows)
    placed = place(everything, table, min_words)
    return placed.join(table.select(F.col("root").alias("group"), "split").distinct(), "group").select("row_id", "group", "split"), table


def one_side(rows: DataFrame, placed: DataFrame, prior: DataFrame | None = None, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sentences under ``min_words`` words on one side; returns ``row_id, group, split`` and ``sentence, split``, the sides to persist.

    A short sentence keeps the side it has in ``prior`` (the sides this returned last time), else gets the side that most of its rows lie on. Rows
    whose speaker lies on another side get the split ``quarantine``; rows without a speaker follow their sentence.
    """
    short = (F.col("n_words") < min_words) & F.col("sentence").isNotNull()
    said = rows.where(short).select("row_id", "sentence", F.col("speaker").isNull().alias("silent"))
    # a row_id may repeat: its copies lie on one side unless they differ in speaker, so both tables are reduced to different rows
    at = cut(said.distinct().join(placed.distinct(), "row_id").select("row_id", "sentence", "silent", "group", "split"))
    n = at.where("split <> 'quarantine'").groupBy("sentence", "split").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("silent"), 1)).alias("spoken"))
    sides = n.groupBy("sentence").agg(F.max(F.struct("spoken", "n", "split")).alias("m")).select("sentence", F.col("m.split").alias("side"))
    if prior is not None:
        old = prior.select("sentence", F.col("split").alias("kept"))
        sides = sides.join(old, "sentence", "full").select("sentence", F.coalesce("kept", "side").alias("side"))
    sides = cut(sides)
    moved = at.join(sides, "sentence").where("split <> side").select("row_id", "group", F.when(F.col("silent"), F.col("side")).otherwise("quarantine").alias("to")).distinct()
    out = placed.join(moved, ["row_id", "group"], "left").select("row_id", "group", F.coalesce("to", "split").alias("split"))
    return out, sides.withColumnRenamed("side", "split")
