"""Formulas from boxes: glyphs, fraction bars, radicals and operators on a page become one LaTeX text a line.

Three passes, each in rounds over all lines at once. First every box finds the bar that it stands on or under, or the
radical that it stands in: the narrowest of those that nothing comes between, so nested fractions take their own. Then
within each place (a line, a numerator, a radicand, an index) what is clearly smaller than the largest there becomes a script
of the box before it, or a limit of the operator that it stands over or under, and the scripts are places of their own in the
next round. Last, from the deepest level up, the texts of places go into their owners'. Rounds are as many as
formulas are nested, and each is written to the shared folder.

Boxes: by (the line), id, c (the text), box, and kind: glyph, bar, radical or operator (see ``kinds``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: What is drawn as a bar, what takes limits, and how symbols are written.
BARS, OPERATORS = ("—", "―", "─", "⎯"), ("∑", "∏", "∫", "lim", "max", "min", "⋃", "⋂")
SYMBOLS = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "lim": r"\lim", "max": r"\max", "min": r"\min", "⋃": r"\bigcup", "⋂": r"\bigcap", "→": r"\rightarrow ", "∞": r"\infty ", "π": r"\pi ", "×": r"\times ", "≤": r"\leq ", "≥": r"\geq ", "sin": r"\sin ", "cos": r"\cos ", "log": r"\log "}
SMALL, CHECK, REACH, GAP, CELL = 0.8, 0.6, 6.0, 0.5, 64.0  # shares of a line's largest letter; width of a join's cell
_ROLES = ("num", "den", "rad", "idx", "sub", "sup")


def kinds(c: Column) -> Column:
    return F.when(c.isin(*BARS), "bar").when(c == "√", "radical").when(c.isin(*OPERATORS), "operator").otherwise("glyph")


def symbol(c: Column) -> Column:
    out = c
    for told, latex in SYMBOLS.items():
        out = F.when(c == told, latex).otherwise(out)
    return out


def _measured(boxes: DataFrame, by: list[str]) -> DataFrame:
    b = F.col("box")
    rows = boxes.select(*by, "id", "c", kinds(F.col("c")).alias("kind"), b["left"].alias("l"), b["top"].alias("t"), (b["left"] + b["width"]).alias("r"), (b["top"] + b["height"]).alias("b"))
    rows = rows.withColumns({"x": (F.col("l") + F.col("r")) / 2, "y": (F.col("t") + F.col("b")) / 2, "w": F.col("r") - F.col("l")})
    height = F.max(F.when(F.col("kind") == "glyph", F.col("b") - F.col("t"))).over(W.partitionBy(*by))
    return rows.withColumn("h", F.coalesce(height, F.lit(10.0)))


def owners(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The boxes with owner and role (num, den, rad or idx) where a bar or a radical holds them, joined on cells of their width."""
    first, last = F.floor((F.col("l") - F.col("h")) / CELL), F.floor((F.col("r") + F.col("h")) / CELL)
    frames = boxes.where(F.col("kind").isin("bar", "radical")).withColumn("cell", F.explode(F.sequence(first, last)))
    frames = frames.select(*by, "cell", F.col("id").alias("owner"), F.col("kind").alias("frame"), *[F.col(c).alias(f"f{c}") for c in ("l", "t", "r", "b", "x", "y", "w")])
    pairs = boxes.withColumn("cell", F.floor(F.col("x") / CELL)).join(frames, [*by, "cell"]).where(F.col("id") != F.col("owner"))
    c = F.col
    framed = c("kind").isin("bar", "radical")
    wider = ~framed | (c("fw") > c("w"))
    reach = REACH * c("h")
    over = (c("frame") == "bar") & c("x").between(c("fl") - 1, c("fr") + 1) & wider
    above, below = over & (c("y") < c("fy")) & (c("ft") - c("b") <= reach), over & (c("y") >= c("fy")) & (c("t") - c("fb") <= reach)
    check = F.when(framed, CHECK * SMALL * c("h")).otherwise(CHECK * (c("b") - c("t")))
    under = (c("frame") == "radical") & wider & c("y").between(c("ft") - 1, c("fb") + 1) & c("x").between(c("fl") + check, c("fr") + 1)
    index = (c("frame") == "radical") & ~framed & (c("b") - c("t") < SMALL * c("h")) & (c("y") < c("fy")) & (c("y") >= c("ft") - (c("b") - c("t")) / 2) & c("x").between(c("fl") - 0.1 * c("h"), c("fl") + CHECK * c("h"))
    role = F.when(above, "num").when(below, "den").when(under, "rad").when(index, "idx")
    away = F.when(above, c("ft") - c("b")).when(below, c("t") - c("fb")).otherwise(F.lit(0.0))
    told = pairs.withColumns({"role": role, "away": away}).where("role IS NOT NULL")
    # What stands on or under a bar goes on without a gap: a subscript below a raised fraction isn't its denominator's.
    stack = W.partitionBy(*by, "owner", "role").orderBy("away", "id")
    ends = F.max(F.col("away") + F.col("b") - F.col("t")).over(stack.rowsBetween(W.unboundedPreceding, -1))
    gap = (F.col("frame") == "bar") & (F.col("away") - F.coalesce(ends, F.lit(0.0)) > GAP * F.col("h"))
    told = told.withColumn("gap", gap.cast("int")).withColumn("gaps", F.sum("gap").over(stack)).where("gaps = 0")
    # Of the bars on one side only the next one is seen; of all that is left the narrowest owns the box.
    side = F.row_number().over(W.partitionBy(*by, "id", F.when(F.col("frame") == "bar", F.col("role")).otherwise(F.col("owner").cast("string"))).orderBy("away", "fw", "owner"))
    own = F.row_number().over(W.partitionBy(*by, "id").orderBy("fw", "away", "owner"))
    held = told.withColumn("side", side).where("side = 1").withColumn("own", own).where("own = 1").select(*by, "id", "owner", "role")
    return boxes.join(held, [*by, "id"], "left")


def _sized(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The boxes with size: their height, and of bars and radicals the largest of what they hold, with the extents of it all."""
    own = F.when(F.col("kind").isin("bar", "radical"), F.lit(0.0)).otherwise(F.col("b") - F.col("t"))
    out = staged(boxes.withColumn("size", own).withColumn("level", F.lit(0)), "boxes")
    while True:
        held = out.where("owner IS NOT NULL").groupBy(*by, F.col("owner").alias("id")).agg(F.max("size").alias("s"), F.min("t").alias("low"), F.max("b").alias("high"), F.max("level").alias("deep"))
        new = out.join(held, [*by, "id"], "left").withColumns({
            "size": F.greatest("size", F.coalesce("s", F.lit(0.0))), "t": F.least("t", F.coalesce("low", F.col("t"))), "b": F.greatest("b", F.coalesce("high", F.col("b"))),
            "level": F.coalesce(F.col("deep") + 1, F.lit(0)),
        }).drop("s", "low", "high", "deep")
        new = staged(new.withColumn("y", (F.col("t") + F.col("b")) / 2), "boxes")
        if new.agg(F.sum("level")).first()[0] == out.agg(F.sum("level")).first()[0]:
            return new.drop("level")
        out = new


def scripted(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The boxes with owner and role also of scripts and limits, place by place, until every place has boxes of one size."""
    place = [*by, "owner", "role"]
    out = staged(boxes.withColumn("open", F.lit(True)), "places")
    while True:
        w, order = W.partitionBy(*place), W.partitionBy(*place).orderBy("l", "id")
        full = (F.col("size") >= SMALL * F.max("size").over(w)) | ~F.col("open")
        base = F.struct("id", "y", "size")
        seen = out.withColumn("full", full).withColumn("before", F.last(F.when(F.col("full"), base), ignorenulls=True).over(order))
        heads = seen.where((F.col("kind") == "operator") & F.col("full")).select(*[F.col(k).alias(f"_{k}") for k in place], F.struct("x", "w", "id", "y", "size").alias("head"))
        small = seen.where(~F.col("full")).select(*place, "id", "x", "y", "before")
        aside = F.abs(F.col("x") - F.col("head.x"))
        near = small.join(heads, [small[k].eqNullSafe(heads[f"_{k}"]) for k in place])
        limit = near.where(aside <= F.col("head.w") * 0.75).groupBy(*by, "id").agg(F.min_by(F.struct("head.id", "head.y", "head.size"), F.struct(aside, "head.id")).alias("limit"))
        found = small.join(limit, [*by, "id"], "left").withColumn("to", F.coalesce("limit", "before")).where("to IS NOT NULL")
        moved = found.where(F.abs(F.col("y") - F.col("to.y")) >= 0.15 * F.col("to.size")).select(*by, "id", F.col("to.id").alias("new_owner"), F.when(F.col("y") < F.col("to.y"), "sup").otherwise("sub").alias("new_role"))
        moved = staged(moved, "scripts")
        if moved.isEmpty():
            return out.drop("open")
        joined = out.join(moved, [*by, "id"], "left").withColumns({"owner": F.coalesce("new_owner", "owner"), "role": F.coalesce("new_role", "role"), "open": F.col("new_owner").isNotNull()})
        out = staged(joined.drop("new_owner", "new_role"), "places")


def texts(boxes: DataFrame, by: list[str]) -> DataFrame:
    """by and latex of each line, from the deepest places up."""
    tree = staged(boxes.select(*by, "id", "c", "kind", "l", "owner", "role", F.when(F.col("owner").isNull(), F.lit(0)).alias("depth")), "tree")
    depth = 0
    while not tree.where("depth IS NULL").isEmpty():
        upper = tree.where(F.col("depth") == depth).select(*by, F.col("id").alias("owner"), F.lit(depth + 1).alias("under"))
        tree = staged(tree.join(upper, [*by, "owner"], "left").withColumn("depth", F.coalesce("depth", "under")).drop("under"), "tree")
        depth += 1
    filled = tree.withColumns({role: F.lit(None).cast("string") for role in _ROLES})
    for level in range(depth, -1, -1):
        now = filled.where(F.col("depth") == level)
        said = (
            F.when(F.col("kind") == "bar", F.concat(F.lit(r"\frac{"), F.coalesce("num", F.lit("")), F.lit("}{"), F.coalesce("den", F.lit("")), F.lit("}")))
            .when(F.col("kind") == "radical", F.concat(F.lit(r"\sqrt"), F.coalesce(F.concat(F.lit("["), "idx", F.lit("]")), F.lit("")), F.lit("{"), F.coalesce("rad", F.lit("")), F.lit("}")))
            .otherwise(symbol(F.col("c")))
        )
        scripts = [F.coalesce(F.concat(F.lit(mark + "{"), role, F.lit("}")), F.lit("")) for mark, role in (("_", "sub"), ("^", "sup"))]
        gap = F.when((F.col("kind") == "operator") & F.col("sub").isNull() & F.col("sup").isNull(), F.lit(" ")).otherwise(F.lit(""))
        pieces = now.select(*by, "owner", "role", F.struct("l", "id", F.concat(said, gap, *scripts).alias("said")).alias("piece"))
        joined = lambda those: F.array_join(F.transform(F.sort_array(F.collect_list(those)), lambda p: p["said"]), "")
        if not level:
            return pieces.groupBy(*by).agg(F.trim(joined("piece")).alias("latex"))
        slots = pieces.groupBy(*by, F.col("owner").alias("id")).agg(*[F.nullif(joined(F.when(F.col("role") == role, F.col("piece"))), F.lit("")).alias(f"new_{role}") for role in _ROLES])
        above = filled.where(F.col("depth") < level).join(slots, [*by, "id"], "left")
        filled = staged(above.withColumns({role: F.coalesce(role, f"new_{role}") for role in _ROLES}).drop(*[f"new_{role}" for role in _ROLES]), "filled")
    raise AssertionError("a tree has a level 0")


def formulas(boxes: DataFrame, by: list[str]) -> DataFrame:
    """by and latex of each line of boxes."""
    return texts(scripted(_sized(owners(_measured(boxes, by), by), by), by), by)
