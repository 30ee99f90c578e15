"""Geometry whose result depends on the order of its steps: folds over the arrays of one page, which is bounded, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choices import let
from ..session import staged

_BOX = "struct<left:double,top:double,right:double,bottom:double>"
ROUNDS = 60


def listed(rows: DataFrame, by: str | list[str], order: list[str], *columns: str) -> DataFrame:
    """by and rows: each group's rows as an array of structs, in order."""
    keys = [by] if isinstance(by, str) else by
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))


def merged_once(boxes: Column, gap: float, most_width: float, most_height: float) -> Column:
    """Each box takes in, in order, the later ones that touch what it has become within the gap; a union beyond the caps isn't made."""

    def taken(state: Column, b: Column) -> Column:
        a = state["box"]
        close = (a["left"] <= b["right"] + gap) & (b["left"] <= a["right"] + gap) & (a["top"] <= b["bottom"] + gap) & (b["top"] <= a["bottom"] + gap)
        union = F.struct(F.least(a["left"], b["left"]).alias("left"), F.least(a["top"], b["top"]).alias("top"), F.greatest(a["right"], b["right"]).alias("right"), F.greatest(a["bottom"], b["bottom"]).alias("bottom"))
        return let(union, lambda u: let(close & (u["right"] - u["left"] <= most_width) & (u["bottom"] - u["top"] <= most_height), lambda ok: F.struct(F.when(ok, u).otherwise(a).alias("box"), F.when(ok, state["left"]).otherwise(F.concat(state["left"], F.array(b))).alias("left"))))

    none = F.array().cast(f"array<{_BOX}>")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        inner = F.aggregate(F.slice(rest, F.lit(2), F.greatest(F.size(rest), F.lit(1))), F.struct(F.get(rest, F.lit(0)).alias("box"), none.alias("left")), taken)
        return let(inner, lambda x: F.when(F.size(rest) > 0, F.struct(F.concat(state["out"], F.array(x["box"])).alias("out"), x["left"].alias("rest"))).otherwise(state))

    return F.aggregate(boxes, F.struct(none.alias("out"), boxes.alias("rest")), step)["out"]


def merge_page_boxes(boxes: DataFrame, by: list[str], gap: float = 4.0, most_width: float = 1e9, most_height: float = 1e9) -> DataFrame:
    """Merged boxes (left, top, right, bottom) of each page, in the order of ord, in passes until no page changes (at most ``ROUNDS``)."""
    names = ["left", "top", "right", "bottom"]
    pages = listed(boxes, by, ["ord"], *names).select(*by, F.transform("rows", lambda r: F.struct(*[r[c].cast("double").alias(c) for c in names])).alias("boxes"))
    pages, done = staged(pages.withColumn("open", F.lit(True)), "pages"), []
    for _ in range(ROUNDS):
        now = pages.where("open").withColumn("new", merged_once(F.col("boxes"), gap, most_width, most_height))
        pages = staged(now.select(*by, F.col("new").alias("boxes"), (F.size("new") < F.size("boxes")).alias("open")), "pages")
        done.append(pages.where("NOT open"))
        if pages.where("open").isEmpty():
            break
    else:
        done.append(pages.where("open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*by, F.explode("boxes").alias("b")).select(*by, *[f"b.{c}" for c in names])


def merged_segments(segments: Column, across: float, along: float) -> Column:
    """Axis-parallel segments (sorted structs of axis, start, end) on nearly one line that touch or nearly do: median axis, least
    start, largest end. A segment joins the first group whose first axis is near."""
    kind = "array<struct<first:double,axes:array<double>,start:double,end:double>>"

    def step(groups: Column, s: Column) -> Column:
        fits = F.transform(groups, lambda g: (F.abs(g["first"] - s["axis"]) <= across) & (s["start"] <= g["end"] + along) & (s["end"] >= g["start"] - along))
        new = F.struct(s["axis"].alias("first"), F.array(s["axis"]).alias("axes"), s["start"].alias("start"), s["end"].alias("end"))
        grown = lambda g: F.struct(g["first"].alias("first"), F.concat(g["axes"], F.array(s["axis"])).alias("axes"), F.least(g["start"], s["start"]).alias("start"), F.greatest(g["end"], s["end"]).alias("end"))
        return let(F.array_position(fits, F.lit(True)).cast("int"), lambda at: F.when(at == 0, F.concat(groups, F.array(new))).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == at, grown(g)).otherwise(g))).cast(kind))

    groups = F.aggregate(segments, F.array().cast(kind), step)

    def median(axes: Column) -> Column:
        n = F.size(axes)
        return (F.element_at(axes, F.floor((n + 1) / 2).cast("int")) + F.element_at(axes, F.floor(n / 2).cast("int") + 1)) / 2

    return F.transform(groups, lambda g: F.struct(median(F.array_sort(g["axes"])).alias("axis"), g["start"].alias("start"), g["end"].alias("end")))


def band_score(source: Column, output: Column, tolerance: float) -> Column:
    """Share of line bands (sorted structs of top, bottom) that find a partner within the tolerance, by two pointers over both lists."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hits"))

    def step(s: Column, _: Column) -> Column:
        a, b = F.get(source, s["i"]), F.get(output, s["j"])
        hit = (F.abs(a["top"] - b["top"]) <= tolerance) & (F.abs(a["bottom"] - b["bottom"]) <= tolerance)
        less = a["top"] < b["top"]
        moved = F.struct((s["i"] + (hit | less).cast("int")).alias("i"), (s["j"] + (hit | ~less).cast("int")).alias("j"), (s["hits"] + hit.cast("int")).alias("hits"))
        return F.when(a.isNull() | b.isNull(), s).otherwise(moved)

    total = F.size(source) + F.size(output)
    return F.when(total > 0, 2 * F.aggregate(F.concat(source, output), start, step)["hits"] / total).otherwise(F.lit(1.0))


def choice_runs(markers: Column, drift: float = 0.2, reach: float = 24.0) -> Column:
    """Which markers (structs of x and number, in reading order) are questions: runs of 1 to 5 in another lane under a question are
    choices. A lane follows its markers: its x moves a fifth of the way to each."""
    start = F.struct(F.lit(None).cast("double").alias("lane"), F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("run"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        aside = F.coalesce(F.abs(m["x"] - s["lane"]) > reach, F.lit(False))
        choice = s["lane"].isNotNull() & (m["number"] <= 5) & (aside | (m["number"] <= s["number"])) & (m["number"] == s["run"] + 1)
        lane = F.when(s["lane"].isNull() | aside, m["x"]).otherwise(s["lane"] * (1 - drift) + m["x"] * drift)
        n = m["number"].cast("long")
        return F.struct(F.when(choice, s["lane"]).otherwise(lane).alias("lane"), F.when(choice, s["number"]).otherwise(n).alias("number"), F.when(choice, n).otherwise(F.lit(0).cast("long")).alias("run"), F.concat(s["out"], F.array(~choice)).alias("out"))

    return F.aggregate(markers, start, step)["out"]


def note_places(anchors: Column, chunks: Column) -> Column:
    """For each endnote's anchor text the place (from 0) of the first chunk, at or after the one before it, that contains it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, anchor: Column) -> Column:
        places = F.transform(chunks, lambda c, i: F.when((i >= s["at"]) & F.contains(c, anchor), i))
        found = F.when(anchor != "", F.array_min(places))
        return let(found, lambda k: F.struct(F.coalesce(k, s["at"]).alias("at"), F.concat(s["out"], F.array(k)).alias("out")))

    return F.aggregate(anchors, start, step)["out"]


def clustered(rows: DataFrame, by: str, value: str, tolerance: float, anchored: bool) -> DataFrame:
    """by, cluster (from 0), low, n and mean of each group's values: a value joins the cluster before it within the tolerance of
    its first value (anchored), or of its mean so far."""
    state = "array<struct<low:double,total:double,n:bigint>>"

    def step(found: Column, v: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        centre = last["low"] if anchored else last["total"] / last["n"]
        near = F.coalesce(F.abs(v - centre) <= tolerance, F.lit(False))
        grown = F.struct(last["low"].alias("low"), (last["total"] + v).alias("total"), (last["n"] + 1).alias("n"))
        new = F.struct(v.alias("low"), v.alias("total"), F.lit(1).cast("long").alias("n"))
        return F.when(near, F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(found, F.array(new))).cast(state)

    lists = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("values"))
    out = lists.select(by, F.posexplode(F.aggregate("values", F.array().cast(state), step)).alias("cluster", "c"))
    return out.select(by, F.col("cluster").cast("long").alias("cluster"), "c.low", "c.n", (F.col("c.total") / F.col("c.n")).alias("mean"))
