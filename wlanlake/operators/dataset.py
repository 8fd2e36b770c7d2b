"""Building training sets: distributions, splits, sampling, imputation, scaling."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.labels import label_name, normalise_label
from wlanlake.functions.util import col_of, keyed_hash, strip
from wlanlake.functions.verdicts import absent_mask, standardise
from wlanlake.operators.layout import rank_by_hash, with_place
from wlanlake.operators.quantiles import exact_quantiles
from wlanlake.operators.windows import windows_with_attack
from wlanlake.session import store

SPLITS = ["train", "val", "test"]
FRACTIONS = {"train": 0.60, "val": 0.15, "test": 0.25}
CLASS_IDS = list(range(len(spec.CLASSES)))


# ---- distributions -----------------------------------------------------------------


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per class, every class listed."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    names = df.sparkSession.createDataFrame(list(enumerate(spec.CLASSES)), "label int, class string")
    filled = names.join(counts, "label", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    total = filled.agg(F.sum("count").alias("_total"))
    pct = F.when(F.col("_total") > 0, 100.0 * F.col("count") / F.col("_total")).otherwise(0.0)
    return filled.crossJoin(total).select("label", "class", "count", pct.alias("pct"))


def block_class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per block with one count column per class id."""
    return (
        df.groupBy("block_id").pivot(label, CLASS_IDS).agg(F.count(F.lit(1))).na.fill(0)
        .withColumnsRenamed({str(i): f"c{i}" for i in CLASS_IDS})
    )


def unknown_labels(df: DataFrame, raw_label: str = "raw_label") -> DataFrame:
    """Spellings that name no class, with their rows."""
    unknown = df.filter(normalise_label(raw_label).isNull())
    text = F.coalesce(strip(raw_label), F.lit(""))
    return unknown.groupBy(text.alias("raw_label")).agg(F.count(F.lit(1)).alias("count"))


def split_report(df: DataFrame, assignment: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and split, blocks per class, and the splits a class is absent from."""
    # Counts per block first: what is joined is one row per block and class.
    counts = df.groupBy("block_id", F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(assignment, "block_id")
    per_class = (
        rows.groupBy("label")
        .agg(
            F.count_distinct("block_id").alias("blocks"),
            *[
                F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).cast("long").alias(s)
                for s in SPLITS
            ],
        )
        .withColumn("class", label_name("label"))
    )
    absent = F.concat_ws(",", *[F.when(F.col(s) == 0, F.lit(s)) for s in SPLITS])
    return per_class.select("label", "class", "blocks", *SPLITS, absent.alias("absent_from"))


# ---- blocks: selection and split ----------------------------------------------------


def _totals(counts: DataFrame) -> list[int]:
    """Rows per class: one row of nine numbers."""
    row = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in CLASS_IDS]).first()
    return [int(x) for x in row]


def _rarest(totals: list[int]) -> Column:
    """(rows, id) of the attack class of a block that is rarest over all blocks; NULL without an attack."""
    return F.least(
        *[
            F.when(F.col(f"c{i}") > 0, F.struct(F.lit(totals[i]).alias("rows"), F.lit(i).alias("id")))
            for i in CLASS_IDS[1:]
        ]
    )


def _block_hash(seed: int) -> Column:
    """A repeatable number over the whole range of a long, in the order of md5 in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "block_id").cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 59)) * F.lit(16).cast("long")


def select_blocks(counts: DataFrame, max_rows: int | None, seed: int = 0) -> DataFrame:
    """Whole blocks under a row budget, those with the rarest classes first.

    The first block is always taken; one that does not fit any more is passed over. Blocks are sorted by
    range and stored. Each round takes the longest run of blocks, among those small enough for the room
    that is left, whose running total fits; what a round takes is a stretch of places and a size bound,
    so rounds hand on three numbers and no blocks. There are few rounds unless blocks almost as large
    as the budget alternate with very small ones.
    """
    totals = _totals(counts)
    if max_rows is None or sum(totals) <= max_rows:
        return counts.select("block_id")
    sizes = [F.col(f"c{i}") for i in CLASS_IDS]
    order = [F.asc_nulls_last("_rarity"), F.desc("_attacks"), F.asc("_jitter"), F.asc("block_id")]
    placed = store(
        counts.select(
            "block_id",
            reduce(add, sizes).alias("_rows"),
            reduce(add, sizes[1:]).alias("_attacks"),
            _rarest(totals)["rows"].alias("_rarity"),
            _block_hash(seed).alias("_jitter"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("block_id", "_rows", F.monotonically_increasing_id().alias("_at")),
        "select_blocks",
    )
    first = placed.agg(F.min("_at").alias("at"), F.min_by("_rows", "_at").alias("n")).first()
    taken, after, room = F.col("_at") == first["at"], first["at"], max_rows - first["n"]
    part = F.shiftright("_at", 33).alias("_part")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_at")
    while room > 0:
        fits = (F.col("_at") > after) & (F.col("_rows") <= room)
        left = placed.filter(fits).select("*", part)
        # One row per partition.
        bases = left.groupBy("_part").agg(F.sum("_rows").alias("_n")).select(
            "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
        )
        total = F.col("_base") + F.sum("_rows").over(inside)
        summed = left.join(bases, "_part").withColumn("_total", total)
        stop, used = summed.agg(
            F.min(F.when(F.col("_total") > room, F.col("_at"))),
            F.coalesce(F.sum(F.when(F.col("_total") <= room, F.col("_rows"))), F.lit(0)),
        ).first()
        if stop is None:
            return placed.filter(taken | fits).select("block_id")
        taken |= fits & (F.col("_at") < stop)
        after, room = stop, room - used
    return placed.filter(taken).select("block_id")


def grouped_split(counts: DataFrame, fractions: dict | None = None, seed: int = 0) -> DataFrame:
    """Assign whole blocks to train, val and test, with every class in as many splits as it has blocks for.

    Blocks are placed by their rarest class first (``split_by_rarest``). That leaves out what only other
    classes need; so the blocks of each class are counted per split, and while a class of three blocks (two)
    is in fewer than three splits (two), one of its smallest blocks moves to a split it misses, or two
    blocks move at once. Only moves that leave fewer such gaps over all classes are made. The counts (27
    numbers) and the smallest blocks of each class and split are all that the driver sees.
    """
    placed = store(split_by_rarest(counts, fractions, seed), "split")
    moves = _closing_moves(counts, placed)
    if not moves:
        return placed
    moved = F.broadcast(counts.sparkSession.createDataFrame(moves, "block_id string, _to string"))
    return placed.join(moved, "block_id", "left").select("block_id", F.coalesce("_to", "split").alias("split"))


def split_coverage(counts: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per class that has rows: label, its blocks, and how many splits these are in."""
    held = F.filter(
        F.array(*[F.struct(F.lit(i).alias("label"), F.col(f"c{i}").alias("n")) for i in CLASS_IDS]), lambda c: c["n"] > 0
    )
    rows = counts.join(assignment, "block_id").select("split", F.explode(held["label"]).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("split").alias("splits"))


def _gaps(cover: list[dict]) -> int:
    """How many splits classes miss that they have blocks for."""
    return sum(min(len(SPLITS), sum(c.values())) - sum(n > 0 for n in c.values()) for c in cover)


def _closing_moves(counts: DataFrame, placed: DataFrame, each: int = 8) -> list[tuple[str, str]]:
    """(block, split) of the blocks that change their split so that no class misses one it has blocks for."""
    rows = counts.join(placed, "block_id")
    row = rows.agg(
        *[F.count_if((F.col(f"c{i}") > 0) & (F.col("split") == s)).alias(f"{i}{s}") for i in CLASS_IDS for s in SPLITS]
    ).first()
    cover = [{s: row[f"{i}{s}"] for s in SPLITS} for i in CLASS_IDS]
    if not _gaps(cover):
        return []
    held = F.filter(F.array(*[F.when(F.col(f"c{i}") > 0, F.lit(i)) for i in CLASS_IDS]), lambda i: i.isNotNull())
    least = Window.partitionBy("class", "split").orderBy("rows", "block_id")
    small = (
        rows.select("block_id", "split", reduce(add, [F.col(f"c{i}") for i in CLASS_IDS]).alias("rows"), held.alias("classes"))
        .withColumn("class", F.explode("classes"))
        .withColumn("nth", F.row_number().over(least))
        .filter(F.col("nth") <= each)
        .select("block_id", "split", "rows", "classes")
        .distinct()
    )
    # At most 9 x 3 x each rows.
    blocks = {r["block_id"]: r for r in small.collect()}
    at = {b: r["split"] for b, r in blocks.items()}

    def moved(now: list[dict], block: str, to: str) -> list[dict]:
        then = [dict(c) for c in now]
        for i in blocks[block]["classes"]:
            then[i][at[block]] -= 1
            then[i][to] += 1
        return then

    def options(now: list[dict], but: str | None = None) -> list[tuple]:
        """(gaps after, rows moved, block, to), best first."""
        return sorted(
            (_gaps(moved(now, b, s)), blocks[b]["rows"], b, s) for b in blocks if b != but for s in SPLITS if s != at[b]
        )

    changed: dict[str, str] = {}
    while _gaps(cover):
        ways = options(cover)
        steps = [ways[0][2:]] if ways and ways[0][0] < _gaps(cover) else []
        if not steps:
            # No single block helps: one that opens no gap elsewhere may make room for a second.
            for gaps, _, block, to in ways:
                second = options(moved(cover, block, to), block)
                if gaps <= _gaps(cover) + 1 and second and second[0][0] < _gaps(cover):
                    steps = [(block, to), second[0][2:]]
                    break
        if not steps:
            break
        for block, to in steps:
            cover = moved(cover, block, to)
            at[block] = changed[block] = to
    return sorted(changed.items())


def split_by_rarest(counts: DataFrame, fractions: dict | None = None, seed: int = 0) -> DataFrame:
    """Assign whole blocks to train, val and test by the rarest class that each holds.

    Blocks are grouped by the rarest class they hold and measured by their rows of that class. The
    largest block of a group goes to train; of two, the other goes to test. Of three or more, the smallest
    goes to val, and the others follow in random order: the first to test, and each further one to the
    split that the middle of its rows falls into, when the rows of all these are laid end to end and cut
    at the fractions of train, test and val.
    """
    shares = fractions or FRACTIONS
    group = F.coalesce(_rarest(_totals(counts))["id"], F.lit(0))
    blocks = counts.select(
        "block_id",
        group.alias("_group"),
        F.get(F.array(*[F.col(f"c{i}") for i in CLASS_IDS]), group).alias("_rows"),
        _block_hash(seed).alias("_hash"),
    )
    size = F.struct("_rows", "block_id")
    # One row per class.
    ends = blocks.groupBy("_group").agg(
        F.max(size).alias("_most"), F.min(size).alias("_least"), F.count(F.lit(1)).alias("_blocks")
    )
    known = F.when(F.col("block_id") == F.col("_most.block_id"), "train").when(
        F.col("block_id") == F.col("_least.block_id"), F.when(F.col("_blocks") == 2, "test").otherwise("val")
    )
    placed = blocks.join(F.broadcast(ends), "_group").withColumn("split", known)
    rest = rank_by_hash(placed.filter("split IS NULL"), "_hash", "block_id", by=["_group"], weight="_rows")
    middle = (F.col("before") + F.col("_rows") / 2) / F.greatest(F.col("total"), F.lit(1))
    cut = (
        F.when((F.col("rk") == 0) | ((middle >= shares["train"]) & (middle < shares["train"] + shares["test"])), "test")
        .when(middle < shares["train"], "train")
        .otherwise("val")
    )
    ended = placed.filter("split IS NOT NULL").select("block_id", "split")
    return ended.unionByName(rest.select("block_id", cut.alias("split")))


# ---- normalisation and weights -------------------------------------------------------


def norm_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, std and "can be absent" per column, as one row of structs.

    Absent values do not count. A column without values gets mean 0, one without spread std 1.
    """
    stats = []
    for c in columns:
        x = f"cast({c} as double)"
        std = f"coalesce(stddev_pop({x}), 0D)"
        stats.append(
            f"named_struct('mean', coalesce(avg({x}), 0D), "
            f"'std', if({std} < 1e-6, 1D, {std}), "
            f"'can_be_absent', coalesce(bool_or({c} is null), false)) as {c}"
        )
    return df.selectExpr(*stats)


def stats_long(stats: DataFrame) -> DataFrame:
    """The statistics row as one row per column."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in stats.columns]
    return stats.select(F.inline(F.array(*pairs))).select("feature", "s.*")


def norm_apply(df: DataFrame, stats: DataFrame, columns: list[str], masks: bool = False) -> DataFrame:
    """Standardised columns, with statistics that were fitted elsewhere (one row)."""
    renamed = stats.select(*[F.col(c).alias(f"_stat_{c}") for c in columns])
    z = {c: standardise(c, F.col(f"_stat_{c}.mean"), F.col(f"_stat_{c}.std")) for c in columns}
    joined = df.crossJoin(F.broadcast(renamed))
    if masks:
        joined = joined.withColumns({f"{c}_absent": absent_mask(c) for c in columns})
    return joined.withColumns(z).drop(*renamed.columns)


def class_weights(df: DataFrame, label: str = "label", alpha: float = 0.5, cap: float | None = 100.0) -> DataFrame:
    """Inverse-frequency weight per class that occurs: ``(n / (k * count)) ** alpha``, capped.

    ``alpha=1`` with ``cap=None`` is the plain inverse frequency.
    """
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    raw = F.pow(F.col("_n") / (F.col("_k") * F.col("count")), F.lit(float(alpha)))
    weight = raw if cap is None else F.greatest(F.least(raw, F.lit(float(cap))), F.lit(1e-3))
    return counts.crossJoin(total).select("label", "count", weight.alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the weight of their class (at most nine rows, one per class)."""
    w = weights.select(F.col("label").alias("_label"), "weight")
    return df.join(F.broadcast(w), F.col(label).cast("int") == F.col("_label")).drop("_label")


# ---- sampling ------------------------------------------------------------------------


def select_windows(
    df: DataFrame, window: int, stride: int, ratio: float = 1.0, seed: int = 0, key: Column | None = None, **tiling
) -> DataFrame:
    """All windows with an attack, and ``ratio`` times as many without, picked by hash."""
    flagged = windows_with_attack(df, window, stride, **tiling)
    picked = flagged.withColumn("_key", keyed_hash(seed, "block_id", "start") if key is None else key)
    attack = picked.filter("has_attack")
    budget = attack.agg(F.bround(F.greatest(F.count(F.lit(1)), F.lit(1)) * F.lit(float(ratio))).alias("_budget"))
    tie = F.struct("block_id", "start")
    normal = rank_by_hash(picked.filter("not has_attack").withColumn("_tie", tie), "_key", "_tie")
    normal = normal.crossJoin(F.broadcast(budget)).filter(F.col("rk") < F.col("_budget"))
    return attack.select(*flagged.columns).unionByName(normal.select(*flagged.columns))


def subsample_rows(
    df: DataFrame, keep: float, seed: int = 0, label: str = "label", uniform: Column | None = None
) -> DataFrame:
    """A share of the normal rows and every attack row.

    Rows, not blocks: to be used after the rolling columns exist. ``uniform`` is a number
    in [0, 1) per row, by default from a hash.
    """
    if uniform is None:
        uniform = F.pmod(keyed_hash(seed, "block_id", "frame_number"), F.lit(1 << 30)) / float(1 << 30)
    return df.filter((F.col(label) > 0) | (uniform < keep))


def keep_share(df: DataFrame, max_rows: int | None) -> float:
    """The share that brings a table down to about ``max_rows`` rows."""
    if max_rows is None:
        return 1.0
    total = df.count()
    return 1.0 if total <= max_rows else max_rows / total


def oversample_minority(
    df: DataFrame, target: str = "binary_label", share: float = 0.15, key: Column | None = None,
    tie: str = "frame_number", seed: int = 42,
) -> DataFrame:
    """Repeat attack rows until they make up ``share`` of the table.

    Every attack row is kept; copies are spread evenly, the remainder by hash rank.
    """
    ratio = share / (1.0 - share)
    sizes = df.agg(
        F.count_if(F.col(target) == 0).alias("_major"), F.count_if(F.col(target) == 1).alias("_minor")
    ).withColumn("_goal", F.greatest(F.floor(F.col("_major") * ratio), F.col("_minor")))
    keyed = df.filter(F.col(target) == 1).withColumn("_key", keyed_hash(seed, tie) if key is None else key)
    minor = rank_by_hash(keyed, "_key", tie).crossJoin(F.broadcast(sizes))
    copies = F.floor(F.col("_goal") / F.col("_minor")) + F.when(
        F.col("rk") < F.col("_goal") % F.col("_minor"), 1
    ).otherwise(0)
    repeated = minor.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    major = df.filter(F.col(target) == 0).withColumn("copy", F.lit(1).cast("long"))
    return major.unionByName(repeated.select(*df.columns, "copy"))


def stratified_split(
    df: DataFrame, label: str, test_share: float = 0.2, key: Column | None = None,
    tie: str = "frame_number", seed: int = 42,
) -> DataFrame:
    """Rows with a ``split``: the same share of every class goes to test, by hash rank."""
    keyed = df.withColumn("_key", keyed_hash(seed, tie) if key is None else key)
    ranked = rank_by_hash(keyed, "_key", tie, by=[label])
    test = F.col("rk") < F.bround(F.col("n_group") * F.lit(float(test_share)))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def stratified_folds(
    df: DataFrame, label: str, folds: int = 5, tie: str = "frame_number", seed: int = 42
) -> DataFrame:
    """Rows with a ``fold``; every class is spread evenly over the folds."""
    ranked = rank_by_hash(df.withColumn("_key", keyed_hash(seed, tie)), "_key", tie, by=[label])
    return ranked.withColumn("fold", (F.col("rk") % folds).cast("int")).select(*df.columns, "fold")


def shuffle_labels(df: DataFrame, label: str, tie: str = "frame_number", seed: int = 42) -> DataFrame:
    """The same rows with their labels permuted: rows ranked by one hash meet labels ranked
    by another."""
    rows = rank_by_hash(df.withColumn("_key", keyed_hash(seed, tie)), "_key", tie)
    labels = rank_by_hash(
        df.select(tie, label).withColumn("_key", keyed_hash(seed + 1, tie)), "_key", tie
    ).select("rk", F.col(label).alias("_shuffled"))
    return (
        rows.join(labels, "rk").withColumn(label, F.col("_shuffled")).select(*df.columns)
    )


# ---- columns -------------------------------------------------------------------------


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians as one row, one column per feature; NULL where a column has no value."""
    q = exact_quantiles(train, columns, [0.5])
    return q.agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns])


def median_impute(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Absent values replaced by medians fitted on train (one row)."""
    renamed = fitted.select(*[F.col(c).alias(f"_median_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(renamed)).withColumns(filled).drop(*renamed.columns)


def zscore(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Plain z-scores with population deviations; columns without spread are only centred."""
    renamed = stats.select(*[F.col(c).alias(f"_stat_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"_stat_{c}.mean")) / F.col(f"_stat_{c}.std") for c in columns}
    return df.crossJoin(F.broadcast(renamed)).withColumns(z).drop(*renamed.columns)


def category_table(frames: list[DataFrame], column: str, absent: str = "__NA__") -> DataFrame:
    """Categories of a column over all frames with their alphabetical code."""
    values = None
    for df in frames:
        part = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(absent)).alias("category")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        values = part if values is None else values.unionByName(part)
    rows = values.groupBy("category").agg(F.sum("_n").alias("rows"))
    return with_place(rows, F.col("category"), name="code").withColumn("code", (F.col("code") - 1).cast("int"))


def align_categories(df: DataFrame, categories: DataFrame, column: str, absent: str = "__NA__") -> DataFrame:
    """Rows with the shared code of their category."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(absent))
    codes = categories.select(F.col("category").alias("_category"), F.col("code").alias(f"{column}_code"))
    return df.join(codes, value == F.col("_category")).drop("_category")


def _hex_number(c: str) -> Column:
    """Number of a text cell; a leading 0x is cut off, the rest read as decimal."""
    text = F.regexp_replace(col_of(c).cast("string"), r"^\s*0x", "")
    return F.when(F.btrim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.btrim(text).try_cast("float"))


def mixed_columns(train: DataFrame, threshold: float = 0.8) -> tuple[list[str], list[str]]:
    """Text columns of train that are mostly numbers, and those that are not."""
    texts = [c for c, t in train.dtypes if t == "string"]
    rates = train.agg(*[F.avg(_hex_number(c).isNotNull().cast("int")).alias(c) for c in texts]).first()
    numeric = [c for c in texts if (rates[c] or 0.0) >= threshold]
    return numeric, [c for c in texts if c not in numeric]


def coerce_mixed(train: DataFrame, others: list[DataFrame], threshold: float = 0.8) -> tuple[list[DataFrame], list[str], list[str]]:
    """Text columns that are mostly numbers in train become numbers everywhere."""
    numeric, categorical = mixed_columns(train, threshold)
    casts = {c: _hex_number(c) for c in numeric}
    return [d.withColumns(casts) if casts else d for d in [train, *others]], numeric, categorical


def split_overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of each side and how many are on both; copies are combined first."""
    sides = train.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        test.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    rows = sides.groupBy(*columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return rows.agg(
        F.sum("_a").alias("train_rows"),
        F.sum("_b").alias("test_rows"),
        F.sum(F.col("_a") * F.col("_b")).alias("overlap"),
    )


def union_splits(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
