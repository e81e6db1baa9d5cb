"""A tree of balls over discs, and the pairs of its leaves that the triangle inequality can't keep apart.

Discs first part by the power of two of their radius. A cell that is too full is split by rounds: its centre, the
member farthest from it and a sample of members become the centres of its parts, and every member goes to
the nearest. So every cell is a ball of known radius. Pairs of balls are then followed from the roots down,
children meeting by equality of their parents, and a pair is dropped as soon as its balls, widened by their
largest discs, can't touch. The members of the pairs of leaves left over are what must be compared.

Neighbouring leaves make up blocks, and a tile holds the leaves of two blocks that have partners there: so a member is
sent once for every block that it may meet, not for every leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.functions.vectors import TOL, sq_dist
from clustrel.shared import kept

#: Members of a leaf, twice that at most but for members that coincide; parts of a cell, about; rounds of splitting.
LEAF, PARTS, ROUNDS = 128, 48, 24
#: Members of a block, about: several parts of one cell, each of which is no larger.
BLOCK = 2048


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def tree(discs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From discs(id, features, r): members(id, features, r, cell, part, block) of the leaves, and cells(cell, parent, centre, reach, rmax, n, leaf, parts, block).

    reach is the radius of a cell's ball, rmax its largest disc. Leaves of members that all coincide, and cells that
    are still too full after ROUNDS, are dealt into several parts by a hash of the id, and these into blocks of their own.
    """
    level = F.when(F.col("r") > 0, F.floor(F.log2("r")).cast("string")).otherwise("-")
    open_ = kept(discs.select("id", "features", "r", level.alias("cell")))
    roots = kept(open_.groupBy("cell").agg(F.min_by("features", "id").alias("centre")).withColumns({"parent": F.lit(""), "block": F.lit(None).cast("string"), "group": F.col("cell")}))
    joined = open_.join(roots.select("cell", "centre"), "cell")
    open_ = kept(joined.withColumn("d", _distance(F.col("features"), F.col("centre"))).drop("centre"))
    frontier, cells, members = roots, None, None
    for round_ in range(ROUNDS + 1):
        stats = open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("reach"), F.max("r").alias("rmax"), F.max_by("features", F.struct("d", "id")).alias("far"))
        leaf = (F.col("n") <= 2 * LEAF) | (F.col("reach") == 0) | F.lit(round_ == ROUNDS)
        now = kept(frontier.join(stats, "cell").withColumns({"leaf": leaf, "parts": F.when(leaf, F.ceil(F.col("n") / (2 * LEAF))).otherwise(0).cast("int"), "block": F.coalesce("block", F.when(F.col("n") <= BLOCK, F.col("group")))}).drop("group"))
        cells = (lambda x: cells.unionByName(x) if cells else x)(now.drop("far"))
        known = open_.join(now.select("cell", "leaf", "parts", "n", "centre", "far", "block"), "cell")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        done = known.where("leaf").select("id", "features", "r", "cell", part.alias("part"), F.when(F.col("parts") == 1, _block()).otherwise(_block(part)).alias("block"))
        members = (lambda x: members.unionByName(x) if members else x)(done)
        if now.where("not leaf").isEmpty():
            break
        share = F.least(F.lit(PARTS), F.ceil(F.col("n") / LEAF)) / F.col("n")
        drawn = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(1 << 30)) / float(1 << 30) < share
        sample = known.where(~F.col("leaf")).where(drawn).groupBy("cell").agg(F.collect_set("features").alias("sample"))  # about PARTS of a cell
        split = now.where("not leaf").join(sample, "cell", "left")
        centres = F.array_distinct(F.concat(F.array("centre", "far"), F.coalesce("sample", F.array().cast("array<array<double>>"))))
        split = kept(split.select("cell", centres.alias("centres"), "block", F.ceil(F.col("n") / BLOCK).alias("groups")))
        nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(_distance(F.col("features"), c).alias("d"), i.alias("i"))))
        moved = open_.drop("d").join(split.drop("block", "groups"), "cell").withColumn("at", nearest)
        open_ = moved.select("id", "features", "r", F.concat_ws(".", "cell", F.col("at.i").cast("string")).alias("cell"), F.col("at.d").alias("d"))
        open_ = kept(open_)
        parted = split.select(F.col("cell").alias("parent"), "block", "groups", F.posexplode("centres").alias("i", "centre"))
        group = F.concat_ws(":", "parent", F.pmod(F.col("i"), F.col("groups")).cast("string"))
        frontier = parted.select(F.concat_ws(".", "parent", F.col("i").cast("string")).alias("cell"), "centre", "parent", "block", group.alias("group"))
    return members, cells.select("cell", "parent", "centre", "reach", "rmax", "n", "leaf", "parts", "block")


def _block(part: Column | None = None) -> Column:
    """The block of a leaf, or of one of its parts."""
    if part is None:
        return F.coalesce("block", "cell")
    return F.concat_ws("#", "cell", F.floor(part / max(1, BLOCK // (2 * LEAF))).cast("string"))


def leaf_pairs(cells: DataFrame, tol: float = TOL) -> DataFrame:
    """a, b, na, nb, pa, pb, ka, kb: the pairs of leaves, each with itself too, whose discs may meet; their members, parts and blocks.

    Tables of cells are joined by merging: pairs grow with the square of the leaves where no balls are apart, and files of them are far smaller than their rows.
    """
    cells = kept(cells)
    cols = ("cell", "centre", "reach", "rmax", "n", "leaf", "parts", _block().alias("block"))
    own = cells.select(F.col("parent").alias("key"), *cols)
    down = kept(own.unionByName(cells.where("leaf").select(F.col("cell").alias("key"), *cols)))
    side = lambda s: down.select(*(F.col(c).alias(c + s) for c in down.columns)).hint("merge")
    open_, found = cells.sparkSession.range(1).select(F.lit("").alias("keya"), F.lit("").alias("keyb")), None
    if cells.isEmpty():
        return cells.sparkSession.createDataFrame([], "a string, b string, na long, nb long, pa int, pb int, ka string, kb string")
    while True:
        met = open_.join(side("a"), "keya").join(side("b"), "keyb").where((F.col("keya") != F.col("keyb")) | (F.col("cella") <= F.col("cellb")))
        gap = _distance(F.col("centrea"), F.col("centreb")) - F.expr("reacha + reachb + rmaxa + rmaxb")
        slack = tol + 1e-9 * (1 + F.expr("reacha + reachb"))
        met = kept(met.where((F.col("cella") == F.col("cellb")) | (gap <= slack)).select("cella", "cellb", "na", "nb", "partsa", "partsb", "blocka", "blockb", (F.col("leafa") & F.col("leafb")).alias("end")))
        done = met.where("end").select(F.col("cella").alias("a"), F.col("cellb").alias("b"), "na", "nb", F.col("partsa").alias("pa"), F.col("partsb").alias("pb"), F.col("blocka").alias("ka"), F.col("blockb").alias("kb"))
        found = (lambda x: found.unionByName(x) if found else x)(done)
        open_ = met.where("not end").select(F.col("cella").alias("keya"), F.col("cellb").alias("keyb"))
        if open_.isEmpty():
            return found


def tiles(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """tile, alone, second, leaf, id, features, r: a tile for every pair of blocks with leaves that must be compared; alone where it is one block with itself, second where a row is of the second block."""
    per = max(1, BLOCK // (2 * LEAF))
    blocks = lambda c, k, p: F.when(F.col(p) == 1, F.array(k)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.col(p) - 1) / per).cast("int")), lambda i: F.concat_ws("#", c, i.cast("string"))))
    each = pairs.select("a", "b", F.explode(blocks("a", "ka", "pa")).alias("ka"), blocks("b", "kb", "pb").alias("kb")).select("a", "b", "ka", F.explode("kb").alias("kb")).where("a <> b or ka <= kb")
    ends = F.array(F.struct(F.col("a").alias("cell"), F.col("ka").alias("block")), F.struct(F.col("b").alias("cell"), F.col("kb").alias("block")))
    tile = F.concat_ws("/", F.least("ka", "kb"), F.greatest("ka", "kb"))
    needed = each.select(tile.alias("tile"), (F.col("ka") == F.col("kb")).alias("alone"), F.greatest("ka", "kb").alias("last"), F.explode(ends).alias("e")).select("tile", "alone", "last", "e.cell", "e.block").distinct()
    placed = members.join(needed.hint("merge"), ["cell", "block"])
    return placed.select("tile", "alone", (F.col("block") == F.col("last")).alias("second"), F.xxhash64("cell", "part").alias("leaf"), "id", "features", "r")
