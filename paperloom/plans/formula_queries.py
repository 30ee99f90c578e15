"""Formulas from boxes: each part is a line of boxes, laid out by one of seven formulas around its size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formula
from ..registry import query, table

#: Text (@: the part's size), left, top, right and bottom of each box, and what the formula reads.
FORMULAS = (
    ((("a", 0, 0, 6, 10), ("+", 7, 0, 13, 10), ("@", 14, 0, 26, 10), ("—", -2, 11, 28, 11.8), ("b", 10, 13, 16, 23)), r"\frac{a+@}{b}"),
    ((("x", 0, 10, 6, 20), ("@", 6.5, 6, 13, 12), ("y", 15, 10, 21, 20), ("2", 21.5, 18, 25, 24)), r"x^{@}y_{2}"),
    ((("√", 0, 8.5, 32, 20.5), ("x", 6, 10, 12, 20), ("+", 13, 10, 19, 20), ("@", 20, 10, 31, 20), ("3", 0, 8, 3, 13)), r"\sqrt[3]{x+@}"),
    ((("∑", 0, 4, 8, 16), ("k", 0, 17, 3.6, 23), ("=", 3.8, 17, 6, 23), ("1", 6.2, 17, 9, 23), ("@", 1, -4, 7, 2), ("k", 12, 5, 18, 15)), r"\sum_{k=1}^{@}k"),
    ((("x", 0, 10, 6, 20), ("—", 7, 5, 14, 5.5), ("1", 8.5, -1.5, 12, 4.5), ("@", 8, 6, 13.5, 12), ("+", 16, 10, 22, 20)), r"x^{\frac{1}{@}}+"),
    ((("a", 2, 0, 8, 10), ("—", 0, 11, 12, 11.8), ("@", 2, 13, 10, 23), ("—", -4, 24.5, 20, 25.3), ("b", 0, 27, 6, 37), ("2", 6.5, 25.5, 10, 31.5)), r"\frac{\frac{a}{@}}{b^{2}}"),
    ((("lim", 0, 0, 14, 10), ("n", 0, 12, 4, 18), ("→", 4.2, 12, 8, 18), ("@", 8.2, 12, 13, 18), ("√", 16, -2, 30, 11), ("n", 23, 0, 29, 10)), r"\lim_{n\rightarrow @}\sqrt{n}"),
)


def boxes(spark, d):
    one = lambda b: F.struct(F.lit(b[0]).alias("c"), *[F.lit(float(x)).alias(n) for x, n in zip(b[1:], "ltrb", strict=True)])
    shapes = F.array(*[F.array(*[one(b) for b in shape]) for shape, _ in FORMULAS])
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("line"), "p_size", F.posexplode(F.get(shapes, (F.col("p_partkey") % len(FORMULAS)).cast("int"))).alias("id", "b"))
    x, y = F.col("line") % 7 * 40.0, F.col("line") % 5 * 30.0
    box = F.struct((F.col("b.l") + x).alias("left"), (F.col("b.t") + y).alias("top"), (F.col("b.r") - F.col("b.l")).alias("width"), (F.col("b.b") - F.col("b.t")).alias("height"))
    return rows.select("line", "id", F.when(F.col("b.c") == "@", F.col("p_size").cast("string")).otherwise(F.col("b.c")).alias("c"), box.alias("box"))


@query("GEO_5_formulas", "SELECT p_partkey AS line, replace(CASE " + " ".join(f"WHEN p_partkey % {len(FORMULAS)} = {i} THEN '{latex}'" for i, (_, latex) in enumerate(FORMULAS)) + " END, '@', CAST(p_size AS VARCHAR)) AS latex FROM part")
def formulas(spark, d):
    return formula.formulas(boxes(spark, d), ["line"])
