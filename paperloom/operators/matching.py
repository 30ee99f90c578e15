"""One-use matching: what is wanted, in order, takes its best partner, and each partner serves once.

The sequential rule is followed without a sequence: in each round every wanted thing points to its best partner left, and
every partner to the first, in order, that could take it; where the two point to each other, nothing before can claim that
partner any more, so the pair is final and both go. The first that is left always finds its partner, so rounds end. All
groups are matched at once; each round is a pair of windows and is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, stripped, text
from ..session import staged
from . import segment as S


def one_use(candidates: DataFrame, by: list[str], order: Column, cost: list[Column]) -> DataFrame:
    """by, wanted and donor of each pair, from candidates with by, wanted and donor; cost: the less the better, donor last."""
    left = staged(candidates.select(*by, "wanted", "donor", order.alias("order"), F.struct(*cost, "donor").alias("cost")), "candidates")
    found: list[DataFrame] = []
    while not left.isEmpty():
        best = F.row_number().over(W.partitionBy(*by, "wanted").orderBy("cost")) == 1
        first = F.row_number().over(W.partitionBy(*by, "donor").orderBy("order")) == 1
        marked = staged(left.withColumn("best", best).withColumn("pair", F.col("best") & first), "pairs")
        pairs = marked.where("pair").select(*by, "wanted", "donor")
        found.append(pairs)
        rest = marked.join(pairs.select(*by, "wanted"), [*by, "wanted"], "left_anti").join(pairs.select(*by, "donor"), [*by, "donor"], "left_anti")
        left = staged(rest.drop("best", "pair"), "candidates")
    return reduce(DataFrame.unionByName, found) if found else left.select(*by, "wanted", "donor")


def band_pairs(wanted: DataFrame, donors: DataFrame, by: list[str], across: float, down: float) -> DataFrame:
    """Pairs of a wanted place (wanted, x, y) and a donor (donor, x, y) below it by no more than ``down``, and aside by no more
    than ``across``: joined on grid cells, not on all pairs of a group."""
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    near = wanted.withColumnsRenamed({"x": "wx", "y": "wy"}).withColumn("cx", F.explode(F.sequence(cell("wx", across) - 1, cell("wx", across) + 1)))
    near = near.withColumn("cy", F.explode(F.sequence(cell("wy", down), cell("wy", down) + 1)))
    given = donors.withColumns({"cx": cell("x", across), "cy": cell("y", down)})
    both = near.join(given, [*by, "cx", "cy"]).withColumns({"dy": F.col("y") - F.col("wy"), "dx": F.abs(F.col("x") - F.col("wx"))})
    return both.where((F.col("dy") > 0) & (F.col("dy") <= down) & (F.col("dx") <= across)).drop("cx", "cy")


def nearest_donors(wanted: DataFrame, donors: DataFrame, by: list[str], across: float, down: float) -> DataFrame:
    """by, wanted and donor (null, if none is left) for each wanted place, in order of y, x and name: the nearest below it,
    first down, then across, then in the donors' own order."""
    pairs = band_pairs(wanted, donors, by, across, down)
    found = one_use(pairs, by, F.struct("wy", "wx", "wanted"), [F.col("dy"), F.col("dx"), F.col("y"), F.col("x")])
    return wanted.select(*by, "wanted").join(found, [*by, "wanted"], "left")


def table_matches(source: DataFrame, output: DataFrame, by: list[str], share: float = 0.9) -> DataFrame:
    """by, wanted, donor and different: for each source table (wanted, place, cells, region) the unused output table (donor,
    place, cells, box) of its shape that differs in the fewest cells, the first of equals, among those of which at least
    ``share`` lies in the region; different: cells that differ, of an unmatched table all."""
    shape = lambda c: F.transform(c, lambda r: F.size(r)).cast("string").alias("shape")
    a = source.select(*by, "wanted", F.col("place").alias("order"), F.flatten("cells").alias("mine"), shape("cells"), "region")
    b = output.select(*by, "donor", F.col("place").alias("at"), F.flatten("cells").alias("theirs"), shape("cells"), "box")
    differ = F.size(F.filter(F.zip_with("mine", "theirs", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    inside = S.overlap(F.col("box"), F.col("region")) >= share * S.area(F.col("box"))
    pairs = staged(a.join(b, [*by, "shape"]).where(inside).withColumn("differ", differ), "tables")
    found = one_use(pairs, by, F.struct("order", "wanted"), [F.col("differ"), F.col("at")])
    told = found.join(pairs.select(*by, "wanted", "donor", "differ"), [*by, "wanted", "donor"])
    return a.join(told, [*by, "wanted"], "left").select(*by, "wanted", "donor", F.coalesce("differ", F.size("mine")).cast("long").alias("different"))


#: Labels of choices, boxes that stand for a fraction's bar, and what a part of a fraction may be of.
LABELS, BOXES, LETTERS = "①②③④⑤", "□▢", r"A-Za-z0-9α-ωΑ-Ωπ∞"
PART = rf"^[{LETTERS}√∑∫+\-./*(){{}}\[\]\\_=^]+$"
ACROSS, DOWN = 90.0, 60.0


def _part(c: Column) -> Column:
    """Whether a text can be a fraction's numerator or denominator."""
    return (F.length(c) > 0) & (F.length(c) <= 80) & c.rlike(PART)


def _fraction(sign: Column, top: Column, below: Column) -> Column:
    return F.concat(sign, F.lit("\\frac{"), top, F.lit("}{"), below, F.lit("}"))


def _rejoined(body: Column, top: Column, below: Column) -> Column:
    """The choice of a label's body, and of the parts above and below it (null where there is none)."""
    minus = body.startswith("-") | body.startswith("−")
    rest = F.when(minus, stripped(F.substring(body, 2, 1 << 20))).otherwise(body)
    sign = F.when(minus, F.lit("-")).otherwise(F.lit(""))
    alone = body.isin("", "-", "−", "+")
    plain = F.when(top.isNotNull() & _part(rest), _fraction(sign, top, rest)).when(top.isNotNull() & below.isNotNull() & alone, _fraction(sign, top, below)).otherwise(body)
    pick = lambda pattern, k: F.regexp_extract(body, pattern, k)
    power, bar = rf"^([{LETTERS}+\-.]+){WS}*[{BOXES}]([{LETTERS}+\-.]+)?$", rf"^(-?){WS}*[{BOXES}]([{LETTERS}+\-.]+)?$"
    raised = body.rlike(power) & top.isNotNull() & below.isNotNull() & pick(power, 1).rlike(f"[{LETTERS}]")
    under = F.coalesce(below, F.nullif(pick(bar, 2), F.lit("")))
    barred = F.when(body.rlike(bar) & under.isNotNull(), _fraction(pick(bar, 1), F.coalesce(top, F.lit("1")), under)).otherwise(body)
    boxed = F.when(raised, F.concat(pick(power, 1), F.lit("^{"), _fraction(F.lit(""), top, below), F.lit("}"))).otherwise(barred)
    out = F.when(body.rlike(f"[{BOXES}]"), boxed).otherwise(plain)
    unit = rf"^(-?){WS}*[{BOXES}]([0-9]{{1,3}})$"
    return F.when(out.rlike(unit), _fraction(F.regexp_extract(out, unit, 1), F.lit("1"), F.regexp_extract(out, unit, 2))).otherwise(out)


def choice_fractions(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, stem and choices of the questions (by) among whose lines (place, text, box) two or more begin with a choice's label.

    Numerators stand above a label's line and denominators below it, in lines of their own: labels take them in their order,
    above before below, each line once, the nearest first (down, then across, then by place). What is taken leaves the stem.
    """
    b = F.col("box")
    told = lines.select(*by, "place", stripped(text("text")).alias("said"), (b["left"] + b["width"] / 2).alias("x"), b["top"].alias("y")).where("said <> ''")
    head = rf"(?s)^([{LABELS}]){WS}*(.*)$"
    told = staged(told.withColumns({"label": F.regexp_extract("said", head, 1), "body": stripped(F.regexp_extract("said", head, 2))}), "told")
    labels = told.where("label <> ''").withColumn("labels", F.count(F.lit(1)).over(W.partitionBy(*by))).where("labels >= 2")
    body = F.col("body")
    boxed, sign = body.rlike(f"[{BOXES}]"), body.isin("-", "−", "+")
    open_ = boxed | (body == "") | sign
    denominator = ~sign & _part(F.regexp_replace(body, "^[-−+]+", ""))
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")).cast("int")
    sides = F.array(F.when(open_ | denominator, F.lit(0)), F.when(open_, F.lit(1)))
    wanted = labels.withColumns({"rank": rank, "side": F.explode(F.filter(sides, lambda s: s.isNotNull()))}).withColumn("wanted", F.struct("rank", "place", "side"))
    parts = told.where((F.col("label") == "") & _part(F.col("said")) & ~F.col("said").rlike(f"[{BOXES}]")).select(*by, F.col("place").alias("donor"), "x", "y")
    # Above and below are one band: above, the part is the higher one.
    below = band_pairs(wanted.where("side = 1").select(*by, "wanted", "x", "y"), parts, by, ACROSS, DOWN).select(*by, "wanted", "donor", "dy", "dx")
    flipped = lambda t: t.withColumn("y", -F.col("y"))
    above = band_pairs(flipped(wanted.where("side = 0")).select(*by, "wanted", "x", "y"), flipped(parts), by, ACROSS, DOWN).select(*by, "wanted", "donor", "dy", "dx")
    taken = staged(one_use(below.unionByName(above), by, F.col("wanted"), [F.col("dy"), F.col("dx")]), "taken")
    given = taken.join(told.select(*by, F.col("place").alias("donor"), F.col("said").alias("given")), [*by, "donor"])
    sides_of = given.groupBy(*by, F.col("wanted.rank").alias("rank"), F.col("wanted.place").alias("place")).agg(F.max(F.when(F.col("wanted.side") == 0, F.col("given"))).alias("top"), F.max(F.when(F.col("wanted.side") == 1, F.col("given"))).alias("below"))
    made = labels.withColumn("rank", rank).join(sides_of, [*by, "rank", "place"], "left").withColumn("choice", _rejoined(body, F.col("top"), F.col("below")))
    last = made.groupBy(*by, "rank").agg(F.max_by("choice", "place").alias("choice"))  # a label that comes twice counts with its last line
    choices = last.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "choice"))), lambda c: c["choice"]).alias("choices"))
    gone = taken.select(*by, F.col("donor").alias("place"))
    rest = told.join(gone, [*by, "place"], "left_anti").join(labels.select(*by, "place"), [*by, "place"], "left_anti")
    stems = rest.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "said"))), lambda r: r["said"]), "\n").alias("stem"))
    many = choices.where(F.size("choices") >= 2).join(stems, by, "left")
    return many.select(*by, stripped(F.regexp_replace(F.coalesce("stem", F.lit("")), "\n{3,}", "\n\n")).alias("stem"), "choices")
